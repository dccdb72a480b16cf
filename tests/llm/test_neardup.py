import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwake.llm import neardup as N
from ledgerwake.llm.tables import read

LOWER = {c: c + 32 for c in range(65, 91)}


def weighted_sets(texts):
    """Shingle -> weight of each text, by the formulas alone: nothing of the operator's is used."""
    sets = []
    for t in texts:
        words = [w.translate(LOWER) for w in re.split("[\\x20\\x09-\\x0d]+", t or "") if w]
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets.append(collections.Counter(runs))
    df = collections.Counter(x for s in sets for x in s)
    n = len(sets)
    idf = {x: 1 + N.DAMPING * math.log((n + 1) / k) / math.log(n + 1) for x, k in df.items()}
    return [{x: (1 + math.log(k)) * idf[x] for x, k in s.items()} for s in sets]


def jaccard(a, b):
    both = sum(min(w, b[x]) for x, w in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(spark, rows, threshold=0.8):
    """Class of each row by comparing all different texts that a similarity of the threshold is possible for."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = weighted_sets([t for _, t in rows])
    own = {t or "": s for (_, t), s in zip(rows, sets, strict=True)}
    texts = sorted(own)
    span = [own[t] for t in texts]
    mass = [sum(s.values()) for s in span]
    having = collections.defaultdict(list)
    for i, s in enumerate(span):
        for x in s:
            having[x].append(i)
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(span):
        for j in {j for x in s for j in having[x] if j < i}:
            if top(i) != top(j) and min(mass[i], mass[j]) >= threshold * max(mass[i], mass[j]) and jaccard(s, span[j]) >= threshold:
                group[top(i)] = top(j)
    at = {t: i for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        if d is not None:
            least[top(at[t or ""])] = min(d, least.get(top(at[t or ""]), d))
    return sorted(str((d, least.get(top(at[t or ""])))) for d, t in rows), docs


def found(docs):
    return sorted(str((r["doc_id"], r["class_id"])) for r in N.classes(docs).collect())


def test_like_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, small, "documents").collect()]
    want, docs = brute(spark, rows)
    assert found(docs) == want


def test_large_groups_of_copies_and_near_copies(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(300)]
    rows = [(k, " ".join(base)) for k in range(1000, 1200)]
    for k in range(250):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(300)] = word()
        rows.append((k, " ".join(t)))
    passage = " ".join(word() for _ in range(60))
    rows += [(5000 + k, " ".join(word() for _ in range(90)) + " " + passage) for k in range(200)]
    want, docs = brute(spark, rows)
    got = found(docs)
    assert got == want
    assert sum(x.endswith(", 0)") for x in got) == 450 and len({x.split(", ")[1] for x in got}) == 201


def test_pairs_in_a_bucket_that_is_another_groups(spark):
    """Texts that share a passage, too little to be alike; each is alike to one other only."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = words(380)
    rows = [(k, f"{passage} {words(73)}") for k in range(1, 21)]
    for k in range(60):
        own = words(60)
        rows += [(100 + 2 * k + i, f"{passage} {own} {words(14)}") for i in (0, 1)]
    group = words(70).split()
    for k in range(60):
        t = list(group)
        t[rng.randrange(70)] = words(1)
        rows.append((1000 + k, f"{passage} {' '.join(t)}"))
    want, docs = brute(spark, rows)
    assert len({x.split(", ")[1] for x in want}) == 81
    assert found(docs) == want


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "one two"), (4, "one two"), (4, "one two"), (5, "ONE two"), (6, "two one"), (None, "one two"),
        (None, "z"), (8, "w " * 20_000), (9, "w " * 20_001), (10, " \n"),
    ]
    want, docs = brute(spark, rows)
    assert found(docs) == want
    kept = N.deduplicated(docs.selectExpr("*", "doc_id as t", "'x' as class_id", "1 as _t0")).collect()
    assert len(kept) == len({x.split(", ")[1] for x in want})  # " \n" has no word and equals nothing; one class has no id
    assert N.classes(docs.limit(0)).count() == 0 and N.deduplicated(docs.limit(0)).count() == 0


def test_one_row_of_each_class_is_kept(spark):
    rows = [
        ("b", "one two", 1), ("b", "one two", 2), ("b", "one two", 2), ("c", "one two", 3), ("d", "three", 4), (None, "four", 5),
        (None, "four", 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id string, text string, rid int")
    got = N.classes(docs).collect()
    assert sorted((str(r["class_id"]), r["class_size"]) for r in got if r["kept"]) == [("None", 2), ("b", 4), ("d", 1)] and len(got) == 7
    once = sorted(map(str, N.deduplicated(docs).collect()))
    assert len(once) == 3 and once == sorted(map(str, N.deduplicated(docs.orderBy(F.desc("rid")).repartition(3)).collect()))
    wide = docs.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert N.deduplicated(wide).count() == 3


def test_document_frequencies(spark):
    rows = [(k, f"a b c d e x{k} y{k} z{k} v{k} w{k}") for k in range(40)] + [(99, None)]
    df, n, total = N.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert n == 41 and total == 40 * 6 and df.max() == 40
    w = N.weights_of(spark.createDataFrame(rows, "doc_id long, text string"))
    s, own, counts = N.weighted(*N.K.of_texts([rows[0][1]]), w)
    assert counts.tolist() == [6] and own.max() == pytest.approx(1 + N.DAMPING, abs=0.01) and own.min() == pytest.approx(1 + N.DAMPING * math.log(42 / 40) / math.log(42), abs=0.02)
    assert N.level_weights(0).tolist() == [1.0] * 256


def test_samples_collide_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(2)
    s = np.sort(rng.integers(1, 1 << 62, 400).astype(np.uint64))
    w1, w2 = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    a, b = s[:300], s[100:]
    k = 3000
    sig = N.samples(np.concatenate([a, b]), np.concatenate([w1, w2]), np.array([300, 300]), k)
    assert (sig[0] == sig[1]).mean() == pytest.approx(N.similarity((a, w1), (b, w2)), abs=0.03)


def test_similarity():
    u = lambda *x: np.array(x, np.uint64)
    assert N.similarity((u(1, 2), np.array([1.0, 2.0])), (u(2, 3), np.array([1.0, 1.0]))) == pytest.approx(1 / 4)
    assert N.similarity((u(), np.array([])), (u(), np.array([]))) == 0
