import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerwake.llm import mixing
from ledgerwake.llm.tables import read


def targets_by_hand(sizes, weights=(1, 2, 3), most=3):
    """Caps one source at a time, the excess going to the others by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s]]
        if not over:
            return t | capped
        for s in over:
            capped[s] = most * sizes[s]


CASES = [
    {"a": 10, "b": 1000, "c": 5}, {"a": 0, "b": 7}, {"é": 100, "z": 3, None: 50, "Z": 1, "": 9}, {"a": 5}, {"a": 0},
    {f"s{i}": i * i for i in range(30)},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(targets_by_hand(sizes))


@pytest.mark.parametrize("sizes", CASES)
def test_words_taken(spark, sizes):
    rows, k = [], 0
    for s, n in sizes.items():
        while n > 0:
            m = min(n, 1 + (k * 7) % 13)
            rows.append((k, " ".join(["w"] * m), s))
            n, k = n - m, k + 1
        rows += [(k, None, s), (k, None, s), (k + 1, " \t", s)]
        k += 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs).cache()
    assert mixed.count() == len(rows) and mixed.where("taken > 3 * size or taken < 0").count() == 0
    got = {r["source"]: (r["t"], r["n"]) for r in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("source_size").alias("n")).collect()}
    want = targets_by_hand(sizes)
    for s, n in sizes.items():
        assert got[s][1] == n and abs(got[s][0] - want[s]) <= 0.5 + 1e-9
    copies = mixing.copies(mixed, docs.columns)
    words = {r["source"]: r["n"] for r in copies.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    assert words == {s: t for s, (t, _) in got.items() if t}


def rates_by_hand(sizes, target, most=3):
    """Rates nearest to 1 in relative entropy whose words are the target, by bisection over all documents."""
    low, high = -50.0, 50.0
    rates = lambda x: [min(most, math.exp(min(x * n, 50))) for n in sizes]
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if sum(n * r for n, r in zip(sizes, rates(x), strict=True)) < target else (low, x)
    return rates(x)


def test_rates_are_the_tilt_that_meets_the_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * min(40_000, int(rng.paretovariate(0.8)))), "abcdef"[int(rng.random() ** 2 * 6)]) for i in range(1500)]
    rows += [(9000, "w " * 100_000, "b"), (9001, "w", "zz"), (9002, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    of = {}
    for r, (d, _, s) in ((got[x[0]], x) for x in rows):
        if r["size"]:
            of.setdefault(s, []).append((d, r["size"], r["target"], r["rate"], r["taken"]))
    assert sum(len({round(x[3], 4) for x in v}) > 5 for v in of.values()) >= 2
    for v in of.values():
        sizes, target = [x[1] for x in v], v[0][2]
        assert [x[3] for x in v] == pytest.approx(rates_by_hand(sizes, target), abs=2e-6)
        assert sum(x[1] * x[3] for x in v) == pytest.approx(target, rel=2e-6)
        assert sum(x[4] for x in v) == round(target)
        # whole copies on both sides of the rate; one document may be cut
        assert sum(x[4] not in (math.floor(x[3]) * x[1], (math.floor(x[3]) + 1) * x[1]) for x in v) <= 1
        near = [(x[4] / x[1]) - x[3] for x in v]
        assert abs(sum(near) / len(near)) < 0.2


def test_solver_ends_within_its_bound(spark):
    rows = [("a", 1, 10**7), ("a", 10**6, 3), ("b", 7, 1), ("c", 1, 1), ("c", 2 * 10**7, 40), ("d", 5, 100)]
    sizes = spark.createDataFrame(rows, "source string, size long, n long")
    sources = mixing.targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    own = {r["source"]: r for r in mixing.solved(sizes, sources, 3.0).collect()}
    for s, r in own.items():
        words = sum(k * n * min(3.0, math.exp(min(r["x"] * n, 50))) for t, n, k in rows if t == s)
        assert words == pytest.approx(r["target"], rel=1e-6)


def test_long_text_clashing_names_and_ids_of_any_type(spark):
    rows = [("a", "w " * 300_000, "s", 1, "x"), (None, None, None, 2, "y"), ("b", "é ü", "s", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, size int, _x string")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "_x", "size", "source_size", "target", "rate", "taken"]
    assert {r["doc_id"]: (r["size"], r["taken"]) for r in got.collect()} == {"a": (300_000, 300_000), None: (0, 0), "b": (2, 2)}


def test_salted_join_gives_the_same(spark, small, monkeypatch):
    docs = read(spark, small, "documents").select("doc_id", "source", "text")
    rows = lambda: sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()))
    once = rows()
    assert once == rows()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert rows() == once


def test_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 9)] * 10 + [(None, "d e", None, 9)] * 4, "doc_id long, text string, source string, n_chars long")
    m = mixing.mix(docs)
    assert m.count() == 14 and m.agg(F.sum("taken")).first()[0] <= 38
    assert m.where("doc_id = 1").select("taken").distinct().count() == 1
    assert mixing.copies(m, docs.columns).columns == docs.columns


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0


def test_no_python_in_the_plan(spark, small):
    plan = mixing.mix(read(spark, small, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
