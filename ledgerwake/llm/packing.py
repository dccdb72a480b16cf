"""Packing into fixed-length sequences: shortest-pack-first over the length histogram.

Documents become token ids plus one end id; what exceeds whole sequences is a remainder of a known
length. The histogram of the remainders is packed longest first, each length into the shortest open
pack that it fits in, all documents of a length at once: a pack stands for ``m`` equal sequences and
its slots for the ranks r0 .. r0 + m - 1 of a length. Patterns are then joined back to documents by
rank.

Packs with a gap left are taken apart once more and filled by cutting documents, which matters where
one length is very common. The last pack, if it still has a gap, is parted into sequences whose
lengths are powers of two, which carry no padding. Documents are otherwise cut only at multiples of
the sequence length.

Each task packs blocks of its own rows (``BLOCK`` tokens at most, or one document), so nothing is
shuffled, memory is bounded, and no histogram meets in the driver; a lost task is run again with the
same result.

Null texts count as empty: they have the end id only. Repeated rows are packed each for itself; of equal lengths the
documents go by their order in the task. A long document is a block of its own where it has to be. An empty table gives no
rows. doc_id may be of any type and null; further columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import gc
import heapq
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokencount import byte_symbols, stretches

SIZE = 2048
#: Tokens in a block: 32 MB of ids.
BLOCK = 8 << 20
#: Stretches whose ids a worker keeps; beyond that the table is emptied.
KEPT = 1_500_000
_MARKS = ".,;:!?*#$%&)]}\"-_=+~^@/"
#: A gap of so many tokens is padded.
SMALL_GAP = 8


@dataclass(order=True)
class Pack:
    """m equal sequences; slots: (length class, first rank, start in the remainder, length)."""

    fill: int
    m: int = field(compare=False)
    slots: list[tuple[int, int, int, int]] = field(compare=False)

    def part(self, k: int) -> Pack:
        """The first k sequences; self keeps the others."""
        first = Pack(self.fill, k, self.slots)
        self.m -= k
        self.slots = [(c, r + k, s, n) for c, r, s, n in self.slots]
        return first


def shortest_first(histogram: dict[int, int], size: int) -> list[Pack]:
    done: list[Pack] = []
    heap: list[Pack] = []

    def put(p: Pack) -> None:
        if p.fill == size:
            done.append(p)
        else:
            heapq.heappush(heap, p)

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0

        while rank < n:
            if heap and heap[0].fill + length <= size:
                pack = heapq.heappop(heap)
                if pack.m > n - rank:
                    part = pack.part(n - rank)
                    heapq.heappush(heap, pack)
                    pack = part
                pack = Pack(pack.fill + length, pack.m, [*pack.slots, (length, rank, 0, length)])
                rank += pack.m
                put(pack)
            else:
                each = size // length
                q = (n - rank) // each
                k = each if q else n - rank
                q = max(q, 1)
                pack = Pack(k * length, q, [(length, rank + i * q, 0, length) for i in range(k)])
                rank += q * k
                put(pack)
    return done + heap


def filled(packs: list[Pack], size: int) -> list[Pack]:
    """The same with the gaps of these packs filled by cutting their documents."""
    done: list[Pack] = []
    heap: list[Pack] = []
    items = [(-n, c, r, s, p.m) for p in packs for c, r, s, n in p.slots]
    heapq.heapify(items)
    while items:
        n, c, r, s, m = heapq.heappop(items)
        n = -n
        if heap:
            pack = heapq.heappop(heap)
            k = min(m, pack.m)
            if pack.m > k:
                part = pack.part(k)
                heapq.heappush(heap, pack)
                pack = part
            take = min(n, size - pack.fill)
            pack = Pack(pack.fill + take, k, [*pack.slots, (c, r, s, take)])
            if size - pack.fill <= SMALL_GAP:
                done.append(pack)
            else:
                heapq.heappush(heap, pack)
            if take < n:
                heapq.heappush(items, (take - n, c, r, s + take, k))
            if m > k:
                heapq.heappush(items, (-n, c, r + k, s, m - k))
            continue
        each, gap = size // n, size % n
        cut = gap > SMALL_GAP
        q = m // (each + cut)
        if q:
            slots = [(c, r + i * q, s, n) for i in range(each)]
            if cut:
                slots.append((c, r + each * q, s, gap))
                heapq.heappush(items, (gap - n, c, r + each * q, s + gap, q))
            done.append(Pack(each * n + gap * cut, q, slots))
            r, m = r + (each + cut) * q, m - (each + cut) * q
        if m:
            pack = Pack(n * m, 1, [(c, r + i, s, n) for i in range(m)])
            if size - pack.fill <= SMALL_GAP:
                done.append(pack)
            else:
                heapq.heappush(heap, pack)
    for pack in heap:
        for power in (1 << b for b in reversed(range(size.bit_length()))):
            if pack.fill & power:
                slots, room = [], power
                while room:
                    c, r, s, n = pack.slots[0]
                    take = min(n, room)
                    slots.append((c, r, s, take))
                    room -= take
                    pack.slots = [*([(c, r, s + take, n - take)] if take < n else []), *pack.slots[1:]]
                done.append(Pack(power, pack.m, slots))
    return done


def plan(histogram: dict[int, int], size: int = SIZE) -> list[Pack]:
    """Packs for all remainders. histogram: number of remainders of each length from 1 to size - 1."""
    packs = shortest_first({k: n for k, n in histogram.items() if n}, size)
    good = [p for p in packs if size - p.fill <= SMALL_GAP]
    return good + filled([p for p in packs if size - p.fill > SMALL_GAP], size)


def pack_lengths(lengths: np.ndarray, size: int = SIZE) -> dict[str, np.ndarray]:
    """For documents of these lengths, the pieces: doc (index), start, length, sequence, offset; by sequence and offset."""
    lengths = np.asarray(lengths, np.int64)
    whole, rest = lengths // size, lengths % size
    order = np.argsort(rest, kind="stable")
    begin = np.searchsorted(rest[order], np.arange(size + 1))
    n_whole = int(whole.sum())
    doc = np.repeat(np.arange(len(lengths)), whole)
    out = [(doc, (np.arange(n_whole) - np.repeat(np.cumsum(whole) - whole, whole)) * size, np.full(n_whole, size), np.arange(n_whole), np.zeros(n_whole, np.int64))]
    sequence = n_whole
    for pack in plan({k: int(n) for k, n in enumerate(np.bincount(rest[rest > 0]))}, size):
        at = 0
        for c, r, s, n in pack.slots:
            d = order[begin[c] + r : begin[c] + r + pack.m]
            out.append((d, whole[d] * size + s, np.full(pack.m, n), sequence + np.arange(pack.m), np.full(pack.m, at)))
            at += n
        sequence += pack.m
    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
    by = np.lexsort((cols[4], cols[3]))
    return dict(zip(("doc", "start", "length", "sequence", "offset"), (x[by] for x in cols), strict=True))


class Ids:
    """Token ids of texts, little-endian unsigned 32 bits, as the tokenizers library gives them; stretches
    without white space are encoded once and kept."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.kept: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.end = np.array([end], "<u4").tobytes()
        mark = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and self.tokenizer.encode("a | b", add_special_tokens=False).ids.count(mark[0]) == 1 else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [stretches(x) if x else [] for x in texts]
        if len(self.kept) >= KEPT:
            self.kept.clear()
        kept = self.kept
        new = list(set().union(*parts).difference(kept))
        # A run of Latin letters and the marks after it are pieces of their own to the tokenizer, and case is lost on it: so the
        # ids of "Word," are those of "word" and ",".
        cores = self.cores
        if len(cores) >= KEPT:
            cores.clear()
        halves = []
        todo, tails, whole = set(), set(), []
        for x in new:
            core = x.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100") and len(x) <= 64:
                core, tail = core.lower(), x[len(core) :]
                halves.append((x, core, tail))
                if core not in cores:
                    todo.add(core)
                if tail and tail not in cores:
                    tails.add(tail)
            else:
                whole.append(x)
        tokenize, symbols = self.model.tokenize, self.symbols
        for x in todo:
            # one piece already: nothing to normalise or split, so it goes to the model itself
            cores[x] = np.array([t.id for t in tokenize(x if x.isascii() else "".join(symbols[b] for b in x.encode()))], "<u4").tobytes()
        self.fetch(list(tails), cores)
        self.fetch(whole, kept)
        for x, core, tail in halves:
            kept[x] = cores[core] + cores[tail] if tail else cores[core]
        out = [b"".join(map(kept.__getitem__, p)) + self.end for p in parts]
        for x in whole:
            if len(x) > 64:
                del kept[x]
        return out

    def fetch(self, stretches: list[str], kept: dict[str, bytes]) -> None:
        """Encodes these, many at a time with a mark between them that none of them has."""
        encode = self.tokenizer.encode_batch_fast
        plain = [x for x in stretches if "|" not in x] if self.mark is not None else []
        rest = [x for x in stretches if "|" in x] if self.mark is not None else stretches
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for group, e in zip(groups, encode([" | ".join(g) for g in groups], add_special_tokens=False) if groups else [], strict=True):
            ids = np.array(e.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            raw, at = ids.tobytes(), 0
            for x, end in zip(group, ends, strict=True):
                kept[x] = raw[4 * at : 4 * end]
                at = end + 1
        for i in range(0, len(rest), 1024):
            some = rest[i : i + 1024]
            for x, e in zip(some, encode(some, add_special_tokens=False), strict=True):
                kept[x] = np.array(e.ids, "<u4").tobytes()


_ids: dict[tuple[str, int], Ids] = {}

COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, end: int = 1, size: int = SIZE, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (binary) if asked for."""

    def emit(pid: int, first: int, doc_ids: list, kind: pa.DataType, ids: list[bytes]) -> tuple[int, pa.RecordBatch]:
        n = np.array([len(x) // 4 for x in ids], np.int64)
        p = pack_lengths(n, size)
        views = [memoryview(x) for x in ids]
        spans = [views[d][4 * s : 4 * (s + k)] for d, s, k in zip(p["doc"].tolist(), p["start"].tolist(), p["length"].tolist(), strict=True)]
        cols = [
            pa.array([doc_ids[d] for d in p["doc"].tolist()], kind), pa.array(p["start"]), pa.array(p["length"]),
            pa.array([zlib.crc32(x) for x in spans], pa.int64()), pa.array(n[p["doc"]]),
            pa.array((pid << 40) + first + p["sequence"]), pa.array(p["offset"]),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            cols.append(pa.array([x.tobytes() for x in spans], pa.binary()))
            names.append("ids")
        return int(p["sequence"].max()) + 1 if len(n) else 0, pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first = TaskContext.get().partitionId(), 0
        if (path, end) not in _ids:
            _ids[path, end] = Ids(path, end)
        coder = _ids[path, end]
        doc_ids: list = []
        ids: list[bytes] = []
        held, kind = 0, None
        gc.disable()  # nothing here makes cycles, and each full collection would visit the kept ids
        try:
            for b in batches:
                kind = b.column("doc_id").type
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    for d, x in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text").to_pylist()), strict=True):
                        if ids and held + len(x) // 4 > block:
                            k, out = emit(pid, first, doc_ids, kind, ids)
                            first += k
                            yield out
                            doc_ids, ids, held = [], [], 0
                        doc_ids.append(d)
                        ids.append(x)
                        held += len(x) // 4
            if ids:
                yield emit(pid, first, doc_ids, kind, ids)[1]
        finally:
            gc.enable()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {COLUMNS}" + ", ids binary" * with_ids)
