"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as a doubly linked list of symbols; a heap holds the adjacent pairs that
have a merge rank. The lowest rank (leftmost first) is popped, its two symbols become one, and the
pairs with its new neighbours are pushed. The count is the number of initial symbols minus the
number of merges; no token identifiers are made.

``MergeCounter`` reads a tokenizer file (.json) of the kind NFC, white space to a space, lower
case, split by a pattern, byte-level symbols, merges with an end-of-word mark. Counts are per
stretch without white space, and stretches repeat, so they are kept in a bounded table.

Which characters are letters or numbers, and what their lower case is, depends on the version of
Unicode, so a stretch that is not ASCII is normalised and split by the tokenizers library's own
parts for that; only the merging is done here.

A null text counts as empty: 0 bytes, 0 tokens. Rows are counted each for itself: repeated rows give
repeated results, equal texts have equal counts, there are no ties to break, and an empty table gives
no rows. Texts may be of any length: stretches of a text are counted one after the other. doc_id may be
of any type and null; further columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

#: Stretches whose counts a worker keeps; beyond that the table is emptied.
KEPT = 1_000_000
#: White space to str.split() but not to the tokenizer's patterns.
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")
_BLANK = re.compile("[\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def stretches(text: str) -> list[str]:
    """The maximal runs without Unicode white space."""
    if any(c in text for c in _CONTROL):
        return [x for x in _BLANK.split(text) if x]
    return text.split()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where that
    is printable and no space, else the next unused code point from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue  # one of the two has become part of another symbol
        symbols[i], symbols[j] = a + b, ""
        left -= 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return left


class MergeCounter:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a tokenizer of the kind that this counter reads")
        self.ranks = {tuple(x) if not isinstance(x, str) else tuple(x.split(" ")): i for i, x in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # for ASCII alone, where these classes are what they have always been
        self.ascii = re.compile(pattern.replace("\\p{L}", "a-zA-Z").replace("\\p{N}", "0-9").replace("\\s", "\\t-\\r "))
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special
        self.symbols = byte_symbols()
        self.kept: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Tokens of a piece that is written in byte symbols."""
        if (n := self.pieces.get(piece)) is None:
            symbols = list(piece)
            symbols[-1] += self.suffix
            n = merged(symbols, self.ranks)
            if len(self.pieces) >= KEPT:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = n
        return n

    def plain(self, text: str) -> int:
        if text.isascii():
            found = self.ascii.findall(text.lower())
            if not text.isprintable():  # control characters have symbols of their own
                found = ["".join(self.symbols[ord(c)] for c in x) for x in found]
            return sum(map(self.piece, found))
        return sum(self.piece(x) for x, _ in self.split(self.normalise(text)))

    def stretch(self, text: str) -> int:
        if self.special is not None and any(m in text for m in self.marks):
            n = len(self.special.findall(text)) + sum(self.plain(x) for x in self.special.split(text) if x)
        else:
            n = self.plain(text)
        if len(self.kept) >= KEPT:
            self.kept.clear()
        if len(text) <= 64:
            self.kept[text] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        kept, stretch = self.kept, self.stretch
        total = 0
        for x in stretches(text):
            n = kept.get(x)
            total += stretch(x) if n is None else n
        return total


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One for each worker process."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        for b in batches:
            buf, offs = K.buffers(b.column("text"))
            size = pa.array(offs[1:] - offs[:-1])
            for i, j in K.slices(buf, offs):
                n = [c.count(x) for x in b.column("text").slice(i, j - i).to_pylist()]
                over = pa.array([x > limit for x in n], pa.bool_())
                columns = [b.column("doc_id").slice(i, j - i), size.slice(i, j - i), pa.array(n, pa.int64()), over]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
