import random

from ledgerwake.llm.components import components


def test_paths_stars_and_cycles(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(400 + i, 400 + (i + 1) % 20) for i in range(20)] + [(999, 999)]
    pairs += [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(120)]
    rng.shuffle(pairs)
    group: dict[int, int] = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = top(a), top(b)
            group[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(pairs + pairs[:50], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: top(x) for x in group} and len(got) == len(group)


def test_none(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
