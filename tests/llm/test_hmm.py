import collections
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwake.llm import hmm
from ledgerwake.llm import kernels as K
from ledgerwake.llm.queries import queries
from ledgerwake.llm.tables import fold, read

MEDIUM = "/root/testdata/sf0.01"


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def base(rows):
    c = collections.Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return c, n, lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))


def random_model(rng, states, symbols):
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Hmm(norm(rng.random(states)), norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, symbols))).T)


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    m = random_model(rng, 3, 4)
    lengths = np.array([1, 4, 2, 4])
    sym = rng.integers(0, 4, lengths.sum()).astype(np.int32)
    got, at = hmm.forward(m, sym, lengths), 0
    for k, n in enumerate(lengths):
        s = sym[at : at + n]
        p = sum(m.start[q[0]] * m.emit[s[0], q[0]] * math.prod(m.move[q[i - 1], q[i]] * m.emit[s[i], q[i]] for i in range(1, n)) for q in itertools.product(range(3), repeat=int(n)))
        assert got[k] == pytest.approx(math.log10(p))
        at += n


def test_a_pass_never_lowers_the_likelihood():
    rng = np.random.default_rng(2)
    m = random_model(rng, 3, 7)
    lengths = rng.integers(1, 700, 30)
    sym = rng.integers(0, 7, lengths.sum()).astype(np.int32)
    logs = []
    for _ in range(6):
        e = hmm.Expected(5, 3)
        e.add_segments(m, sym, *hmm.segments(sym, lengths), most=16)
        assert e.emit.sum() == pytest.approx(lengths.sum(), rel=1e-4)
        logs.append(e.log)
        m = e.maximised(np.full(7, 1 / 7), prior=0.0)
    assert all(b >= a - abs(a) * 1e-6 for a, b in zip(logs[1:], logs[2:], strict=False))


def test_base_and_counts_like_brute_force_and_the_model_is_better(spark):
    docs = read(spark, MEDIUM, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    c, n, log = base(rows)
    got = {r["doc_id"]: r for r in queries()["op2_hmm_scoring"](spark, MEDIUM).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        assert r["n_tokens"] == len(tokens(t)) and r["n_known"] == sum(c[w] > 0 for w in tokens(t)) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(log(t), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)


def test_small_vocabulary_splits_words_rightly(spark, monkeypatch):
    """Few symbols and few frequent words, so that most words go through the join; the score is then that of the whole model."""
    rows = [(1, "a b a c"), (2, "a b B x"), (2, "a b B x"), (3, None), (4, ""), (None, "q a"), (7, "z " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n, counts = docs.count(), hmm.count_words(docs)
    v = hmm.vocabulary(counts, n, symbols=2, frequent=3)
    m = random_model(np.random.default_rng(3), 2, v.n_symbols + 2)
    got = hmm.score(docs, v, m, counts, F.lit(False)).collect()
    assert len(got) == len(rows)
    c = collections.Counter(w for _, t in rows for w in tokens(t))
    words = [w for w in c if w is not None]
    by_hash = {int(K.words(*K.of_texts([w]))[0][0]): w for w in words}
    own = [by_hash[int(h)] for h in v.hashes[: v.n_symbols]]
    assert own[0] == b"z" and set(own) <= {b"z", b"a", b"b"} and len(own) == 2
    rare = sum(c[w] for w in words if w not in own) + 0.5 * (len(words) - len(own) + 1)
    for d, t in set(rows):
        k = tokens(t)
        sym = np.array([v.n_symbols + 1 if w is None else own.index(w) if w in own else v.n_symbols for w in k], np.int32)
        want = hmm.forward(m, sym, np.array([len(k)]))[0] + sum(math.log10((c[w] + 0.5) / rare) for w in k if w is not None and w not in own)
        mine = [r for r in got if r["doc_id"] == d and r["n_tokens"] == len(k)]
        assert mine and all(r["score"] == pytest.approx(want) for r in mine)


def test_words_of_equal_counts_fill_the_tables(spark):
    counts = spark.range(300_000).select(F.xxhash64("id").alias("h"), F.lit(3).cast("long").alias("c"))
    v = hmm.vocabulary(counts, 10)
    assert v.n_symbols == hmm.SYMBOLS and len(v.hashes) == hmm.FREQUENT and v.distinct == 300_000 and v.words == 900_000
    few = hmm.vocabulary(counts.unionByName(spark.range(5).select((-F.col("id") - 1).alias("h"), F.lit(50).cast("long").alias("c"))), 10, 4, 20)
    assert len(few.hashes) <= 20 and few.counts[:5].tolist() == [50] * 5 and few.n_symbols == 4


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = [("a", "one two one three", 1)] * 500 + [("b", "word other " * 40_000, 2), (None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, score int")
    v, m, counts = hmm.train(docs, sample=10, sample_steps=2, passes=1)
    got = hmm.score(docs, v, m, counts, F.lit(False))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    assert sorted(collections.Counter((r["doc_id"] or "", r["n_tokens"]) for r in got).items()) == [(("", 1), 1), (("a", 5), 500), (("b", 80_001), 1)]
    assert len({r["score"] for r in got if r["doc_id"] == "a"}) == 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    v, m, counts = hmm.train(docs.limit(0))
    r = {x["doc_id"]: x for x in hmm.score(docs, v, m, counts, fold(F.col("doc_id"), 5) == 1).collect()}
    assert r[1]["score"] == r[1]["base_score"] == 0 and r[1]["train_tokens"] == 0 and r[2]["n_known"] == 0
    v, m, counts = hmm.train(docs)
    assert hmm.score(docs.limit(0), v, m, counts, F.lit(True)).count() == 0
