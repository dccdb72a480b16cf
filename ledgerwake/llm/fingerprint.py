"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle (five words; fewer where the text has fewer) is hashed once; the hash gives a bin and a
value, and each bin keeps its least value. An empty bin takes the value of the bin that a 2-universal
sequence, the same for all documents, first finds non-empty. ``BITS`` low-order bits of each bin are
stored. Two fingerprints agree by chance in a share of 2**-BITS of the bins; the likeness is corrected
for that.

Without a word there is no shingle and the fingerprint is empty ("" in hexadecimal): its likeness is 1 to
another empty one and 0 to any other. A null text counts as empty. Equal texts have equal fingerprints.

Repeated rows are rows of their own, next to each other in the order; documents of equal id and different texts go by
the texts' SHA-256. doc_id must be of an integer type (the order is by it) and may be null. The next document of a
table's only row is that row. An empty table gives no rows. A long text is held whole, with the next one, by one task
at a time. Further columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BINS, BITS = 512, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(buf: np.ndarray, offs: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(documents x bins of 64-bit least values after densification, number of shingles)"""
    s, counts = K.shingles(*K.words(buf, offs))
    n = len(counts)
    table = np.full(n * bins, _EMPTY, np.uint64)
    if len(s):
        cell = K.doc_of(counts) * bins + (s % np.uint64(bins)).astype(np.int64)
        np.minimum.at(table, cell, s // np.uint64(bins))
    table = table.reshape(n, bins)
    full = table != _EMPTY
    rows, empty = np.nonzero(~full & (counts > 0)[:, None])
    single = full.sum(1) == 1
    one = single[rows]
    if one.any():
        table[rows[one], empty[one]] = table[rows[one], full[rows[one]].argmax(1)]
        rows, empty = rows[~one], empty[~one]
    attempt = 0
    while len(rows):
        source = (K.mix(empty.astype(np.uint64) * np.uint64(0x10001) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = full[rows, source]
        table[rows[hit], empty[hit]] = table[rows[hit], source[hit]]
        rows, empty = rows[~hit], empty[~hit]
        attempt += 1
    return table, counts


def packed(table: np.ndarray, counts: np.ndarray, bits: int = BITS) -> list[bytes]:
    # the bin goes into its bits, so that copies of one value in many bins agree by chance one by one
    low = (K.mix(table + np.arange(table.shape[1], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    planes = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(table), -1)
    return [x.tobytes() if c else b"" for x, c in zip(np.packbits(planes, axis=1), counts.tolist(), strict=True)]


def fingerprints(texts: list[str | bytes | None]) -> list[bytes]:
    buf, offs = K.of_texts(texts)
    out: list[bytes] = []
    for i, j in K.slices(buf, offs, 512, 4 << 20):
        out += packed(*signatures(buf, offs[i : j + 1]))
    return out


def likeness(a: list[bytes], b: list[bytes], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of each pair, corrected for chance and held in 0 to 1."""
    out = np.array([float(not x and not y) for x, y in zip(a, b, strict=True)])
    both = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y]
    if both:
        x, y = (np.frombuffer(b"".join(v[i] for i in both), np.uint8).reshape(len(both), -1) for v in (a, b))
        differ = np.unpackbits(x ^ y, axis=1).reshape(len(both), bins, bits).any(2)
        chance = 2.0**-bits
        out[both] = np.clip(((1 - differ.mean(1)) - chance) / (1 - chance), 0, 1)
    return out


#: Rows of a range, about; and ranges, at most: what the driver holds of them is a few MB. Beyond that many, ranges have more rows.
PART_ROWS, MOST_PARTS = 8_000, 50_000
_LEAST = -(1 << 63)
#: Greater than any hexadecimal digit.
_END = "g"


def splits(docs: DataFrame, part_rows: int = PART_ROWS, least: int = 8, most: int = MOST_PARTS) -> list[tuple[int, str]]:
    """Bounds (doc_id, digest) of ranges with about part_rows rows each. An id that has the rows of several ranges is parted by
    the text's digest; null counts as an id."""
    sums = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    n, none = sums["n"], sums["none"]
    if not n:
        return []
    parts = min(most, max(least, -(-n // part_rows)))
    found = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)
    times = Counter(int(x) for x in found)
    if none * parts >= n:
        times[_LEAST] += none * parts // n
    return sorted((k, f"{(i << 16) // m:04x}" if i < m else _END) for k, m in times.items() for i in range(1, m + 1))


def compare_to_next(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Of each document, in the order of descending doc_id (null last; equal ids by a hash of the text), its fingerprint,
    the edited text's (its last floor(n_chars/3) code points replaced by the first as many of the next document's text; after
    the last comes the first), and their likenesses.

    Documents go to ranges of that order, a task each; the first document of a range goes to the range before as well, so that
    each task finds every next document in its own rows. Texts are compressed on the way, sorted by spilling, and one after the
    other decompressed.
    """
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be an integer, as documents are put in its order")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = splits(own, part_rows)
    least = _LEAST

    def part_of(doc_id: int, digest: str) -> int:
        return len(bounds) - bisect.bisect_left(bounds, (doc_id, digest))  # descending

    key = F.coalesce(F.col("doc_id"), F.lit(least))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, str]] = {}
        for b in batches:
            for k, d in zip(b.column("k").to_pylist(), b.column("d").to_pylist(), strict=True):
                p = part_of(k, d)
                if p not in best or (k, d) > best[p]:
                    best[p] = (k, d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.int32()), pa.array([x[0] for x in best.values()], pa.int64()), pa.array([x[1] for x in best.values()])],
            ["part", "k", "d"],
        )

    first = own.select(key.alias("k"), digest.alias("d")).mapInArrow(heads, "part int, k long, d string")
    # one row a range
    first = {r["part"]: (r["h"]["k"], r["h"]["d"]) for r in first.groupBy("part").agg(F.max(F.struct("k", "d")).alias("h")).collect()}
    order = sorted(first)
    before = {first[p]: order[i - 1] for i, p in enumerate(order)}

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for i, j in K.slices(*K.buffers(b.column("text"))):
                part = b.slice(i, j - i)
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in part.column("text").to_pylist()]
                keys, digests = part.column("k").to_pylist(), part.column("d").to_pylist()
                f = fingerprints(texts)
                rows = [(part_of(k, d), False, j) for j, (k, d) in enumerate(zip(keys, digests, strict=True))]
                rows += [(before[k, d], True, j) for j, (k, d) in enumerate(zip(keys, digests, strict=True)) if (k, d) in before]
                at = [j for _, _, j in rows]
                packed_texts = [z.compress(x) for x in texts]
                columns = {
                    "part": pa.array([p for p, _, _ in rows], pa.int32()),
                    "sentinel": pa.array([s for _, s, _ in rows]),
                    "k": pa.array([keys[j] for j in at], pa.int64()),
                    "doc_id": part.column("doc_id").take(pa.array(at)),
                    "d": pa.array([digests[j] for j in at]),
                    "f": pa.array([f[j] for j in at], pa.binary()),
                    "z": pa.array([packed_texts[j] for j in at], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    sent = own.select(key.alias("k"), "doc_id", digest.alias("d"), "text").mapInArrow(
        compress, "part int, sentinel boolean, k long, doc_id long, d string, f binary, z binary",
    )
    # by the number of the range itself, not by its hash: a task has one range
    dealt = sent.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "sentinel", F.desc("k"), F.desc("d"))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        held, text = None, ""
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            edited = fingerprints([x[2] for x in out])
            columns = {
                "doc_id": pa.array([x[0] for x in out], pa.int64()),
                "n_chars": pa.array([x[1] for x in out], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x[2]).hexdigest() for x in out]),
                "fingerprint": pa.array([x[3].hex() for x in out]),
                "edited_fingerprint": pa.array([x.hex() for x in edited]),
                "near_edited": pa.array(likeness([x[3] for x in out], edited)),
                "near_next": pa.array(likeness([x[3] for x in out], [x[4] for x in out])),
            }
            out.clear()
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        done = None  # the range whose sentinel has been met
        size = 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for row in b.slice(i, 256).to_pylist():
                    if row["part"] == done:
                        continue  # repeated rows at the head of the next range
                    own = z.decompress(row["z"], max_output_size=1 << 31).decode("utf-8", "surrogatepass") if row["z"] else ""
                    if held is not None:
                        n = len(text)
                        cut = n // 3
                        new = (text[: n - cut] + own[:cut]).encode("utf-8", "surrogatepass")
                        out.append((held["doc_id"], n, new, held["f"], row["f"]))
                        size += len(new)
                        if len(out) == 512 or size > 4 << 20:
                            yield flush()
                            size = 0
                    held, text = (None, "") if row["sentinel"] else (row, own)
                    done = row["part"] if row["sentinel"] else done
        if out:
            yield flush()

    return dealt.mapInArrow(
        edit,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
