import numpy as np
import pyarrow as pa
import pytest

from ledgerwake.llm import kernels as K

TEXTS = ["", None, "one", "One two  three\tfour\nfive six", " \x0b lead", "é É日本 語", "x" * 5000, "a b c d e", "\x1c\x1d a\x00b", "tail "]


def split(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("window", [7, 64, 1 << 18])
def test_words_are_those_of_bytes_split(monkeypatch, window):
    monkeypatch.setattr(K, "WINDOW", window)
    h, counts = K.words(*K.buffers(pa.array(TEXTS)))
    assert counts.tolist() == [len(split(t)) for t in TEXTS]
    seen = {}
    for w, x in zip((w for t in TEXTS for w in split(t)), h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_sliced_and_large_arrays():
    a = pa.array(TEXTS)
    h, c = K.words(*K.buffers(a))
    h2, c2 = K.words(*K.buffers(a.slice(3, 4).cast(pa.large_string())))
    at = int(c[:3].sum())
    assert c2.tolist() == c[3:7].tolist() and h2.tolist() == h[at : at + len(h2)].tolist()


def test_shingles():
    texts = ["a b c d e f", "a b c d e", "a b", "b a", "", "a b c d e"]
    s, n = K.shingles(*K.words(*K.of_texts(texts)))
    assert n.tolist() == [2, 1, 1, 1, 0, 1]
    parts = np.split(s, np.cumsum(n)[:-1])
    assert parts[0][0] == parts[1][0] == parts[5][0] and parts[2][0] != parts[3][0]


@pytest.mark.parametrize("window", [5, 1000])
def test_ngrams_do_not_depend_on_the_window(monkeypatch, window):
    buf, offs = K.of_texts(TEXTS)
    whole = K.byte_ngrams(buf, offs, (1, 2, 3), 64)
    monkeypatch.setattr(K, "WINDOW", window)
    assert (K.byte_ngrams(buf, offs, (1, 2, 3), 64) == whole).all()
    assert whole.sum(1).tolist() == [sum(max(0, len((t or "").encode()) - n + 1) for n in (1, 2, 3)) for t in TEXTS]


def test_index():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    at = K.HashIndex(keys)
    assert (at(keys) == np.arange(len(keys))).all()
    assert (at(keys + np.uint64(1)) == -1).all()
    assert K.HashIndex(keys[:0])(keys[:3]).tolist() == [-1, -1, -1]
