import hashlib

import numpy as np
import pytest

from ledgerwake.llm import fingerprint as P
from ledgerwake.llm.tables import read


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def by_hand(rows):
    least = -(1 << 63)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    order = sorted(rows, key=lambda x: (least if x[0] is None else x[0], digest(x[1])), reverse=True)
    out = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out.append((d, t, t[: len(t) - cut] + n[:cut], n))
    return out


def test_edits_and_likeness(spark, small):
    docs = read(spark, small, "documents")
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r for r in P.compare_to_next(docs).collect()}
    assert len(got) == len(want)
    off = []
    for d, t, e, n in want:
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["fingerprint"] == P.fingerprints([t])[0].hex() and r["edited_fingerprint"] == P.fingerprints([e])[0].hex()
        for x, near in ((e, r["near_edited"]), (n, r["near_next"])):
            a, b = shingles(t), shingles(x)
            off.append(abs(near - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(off) < 0.03


ROWS = [
    (1, "a b c d e f"), (2, None), (None, "x"), (2, None), (5, ""), (5, "zz y"), (None, "x"),
    (7, "one two three four five six seven " * 50), (8, "日本語 🙂 é" * 20),
]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[1:2], [(3, "same text here")] * 9, [(i, f"text {i} of many") for i in range(500)]])
def test_order_of_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    got = sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in P.compare_to_next(df).collect())
    assert got == sorted(str((d, len(t), hashlib.sha256(e.encode()).hexdigest())) for d, t, e, _ in by_hand(rows))


def test_an_id_with_most_rows_is_parted(spark):
    rows = [(5, f"text {i} of many that share an id") for i in range(300)] + [(None, f"text {i} without one") for i in range(200)] + [(i, f"other {i}") for i in range(100, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len([b for b in P.splits(df, 25) if b[0] == 5]) > 8 and len([b for b in P.splits(df, 25) if b[0] < 0]) > 4
    got = sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in P.compare_to_next(df, 25).collect())
    assert got == sorted(str((d, len(t), hashlib.sha256(e.encode()).hexdigest())) for d, t, e, _ in by_hand(rows))


def test_long_texts_and_ids_of_other_types(spark):
    rows = [(1, "word " * 150_000), (2, "x"), (3, "é" * 300_000)]
    got = sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in P.compare_to_next(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert got == sorted(str((d, len(t), hashlib.sha256(e.encode()).hexdigest())) for d, t, e, _ in by_hand(rows))
    with pytest.raises(TypeError, match="integer"):
        P.compare_to_next(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_no_documents(spark):
    assert P.compare_to_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bins_are_densified_and_packed():
    a, b = P.fingerprints(["only three words", "one two three four five six"])
    assert len(a) == len(b) == P.BINS * P.BITS // 8 and a != b
    assert P.likeness([a, a, b"", b""], [a, b, b"", a]).tolist()[0] == 1 and P.likeness([b"", b""], [b"", a]).tolist() == [1, 0]
    assert P.likeness([a], [b])[0] < 0.1
