import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerwake.llm import packing
from ledgerwake.llm.queries import queries, tokenizer_path
from ledgerwake.llm.tables import read
from ledgerwake.llm.tokencount import MergeCounter, count_tokens, merged

PATH = tokenizer_path()
LIB = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "a<|endoftext|>b <|startoftext|>", "I'll don't 'S ΑΣ ΣΑΣ İstanbul", "\x1ca\x1db", "é é 日本語 ½ ٣ a​b", "🙂🙂 'LL 'RE",
    "a b　c", "x" * 5000, "<|ENDOFTEXT|>", "\x85 \x00", "ǅ ﬁ ß ẞ", "<|endoftext|>,", "a|b | |", "Foo, BAR! Ünï. ª.",
    "'s. o'... D'.",
]


def ids(t):
    return LIB.encode(t or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(spark, small):
    texts = [r["text"] for r in read(spark, small, "documents").collect()] + ODD
    c = MergeCounter(PATH)
    assert [c.count(t) for t in texts] == [len(ids(t)) for t in texts]


@pytest.mark.parametrize("before", ["a", "1", "!", "Î"])
def test_counts_after_every_code_point(before):
    # beyond two planes, which hold all letters with a case, every 29th; all of them agreed when this was written
    texts = [before + chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 29)]]
    want = [len(e.ids) for e in LIB.encode_batch_fast(texts, add_special_tokens=False)]
    c = MergeCounter(PATH)
    assert [t for t, n in zip(texts, want, strict=True) if c.count(t) != n] == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(t):
    assert _counter().count(t) == len(ids(t))
    assert np.frombuffer(_ids().encode([t])[0], "<u4").tolist() == [*ids(t), 1]


_made: dict = {}


def _counter():
    return _made.setdefault("c", None) or _made.__setitem__("c", MergeCounter(PATH)) or _made["c"]


def _ids():
    return _made.setdefault("i", None) or _made.__setitem__("i", packing.Ids(PATH, 1)) or _made["i"]


def test_merges_by_rank_then_place():
    ranks = {("a", "b"): 0, ("ab", "ab"): 1, ("b", "c"): 2, ("a", "a"): 3}
    assert merged(list("ababc"), ranks) == 2 and merged(list("aaa"), ranks) == 2 and merged(["a"], ranks) == 1 and merged([], ranks) == 0


def test_count_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "Tokens, tokens.", "x"), (3, "word " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(str, count_tokens(df, PATH).collect()))
    want = [(d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for d, t, _ in rows]
    assert len(got) == 5 and sorted((r["doc_id"] or 0, *list(r)[1:]) for r in count_tokens(df, PATH).collect()) == sorted((d or 0, *x) for d, *x in want)
    assert count_tokens(df.limit(0), PATH).count() == 0


def checked(lengths, size=2048):
    p = packing.pack_lengths(np.array(lengths, np.int64), size)
    spans = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for d, s, n, q, o in zip(*(p[k].tolist() for k in ("doc", "start", "length", "sequence", "offset")), strict=True):
        assert n > 0
        spans[d].append((s, n))
        sequences[q].append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(spans[d]):
            assert s == at
            at += k
        assert at == n
    padding = 0
    for own in sequences.values():
        at = 0
        for o, k in sorted(own):
            assert o == at
            at += k
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert set(sequences) == set(range(len(sequences)))
    return padding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=200))
def test_every_id_once_and_little_padding(lengths):
    assert checked(lengths) <= 8 * (sum(lengths) // 2048 + 2)


@pytest.mark.parametrize("lengths", [[1], [2048], [4096, 1], [1100] * 5000, [300] * 3001, [1030] * 7, [1500] * 999 + [3, 3, 9000], []])
def test_very_common_lengths(lengths):
    assert checked(lengths) <= 0.01 * sum(lengths) + 8


def test_pieces_of_documents(spark, small):
    docs = read(spark, small, "documents")
    own = {r["doc_id"]: [*ids(r["text"]), 1] for r in docs.collect()}
    seen = collections.Counter()
    for r in queries()["op5_packing"](spark, small).collect():
        part = own[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(own[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
    assert seen == {d: len(x) for d, x in own.items()}


def test_packing_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, "word " * 30_000), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, PATH, block=10_000, with_ids=True).collect()
    assert sum(r["length"] for r in got) == sum(len(ids(t)) + 1 for _, t in rows)
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack(df.limit(0), PATH).count() == 0
