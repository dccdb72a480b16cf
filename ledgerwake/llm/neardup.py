"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are runs of five words (A-Z in lower case; a text of fewer words is one shingle). A shingle's weight is
(1 + ln(occurrences)) * (1 + DAMPING * idf), idf being ln((n + 1) / documents that have it) / ln(n + 1), from 0 to 1. The
logarithm keeps two texts that repeat one line from being alike whatever else they say. The inverse document frequency
is damped, as a document's own odd shingles would else outweigh what it shares with a thousand near copies: the README
has figures of several dampings.

Document frequencies are counted over all documents in a sketch of ``CELLS`` cells, whatever the corpus: exact as long as
shingles rarely share a cell; beyond that what the others of a cell add on average is taken off, which leaves an error of
about the root of that for rare shingles and none to speak of for frequent ones. Weights are the same wherever a shingle
occurs, so the similarity is a weighted Jaccard similarity in any case.

Each text gets ``BANDS * ROWS`` samples. Texts that share all samples of a band are candidates:
in a bucket of up to ``SMALL`` different texts all pairs, in a larger one each text with the bucket's least
and with ``RING`` neighbours in an order of the band's own, which joins most of a group at the cost of a few pairs a text.
An exact join of rare shingles (see ``_left``) then takes every pair of a large bucket's texts that are not yet in one
component and may be similar. Pairs with a weighted Jaccard similarity of at least 0.8 are links; classes are the
components of links. Equal texts are one class from the start: copies are never expanded into pairs.

A null text counts as empty; all texts without a word are kept apart unless they are equal. Repeated rows are copies of
each other. A document's class is the least doc_id in it, null only where all are; one row of a class is kept, of rows
that tie for that one, the same for the whole run. doc_id may be of any type that has an order. An empty table gives no rows.
Long texts are handled in slices. Columns of the input other than doc_id and text are left out by classes(), and kept as
they are, whatever their names, by deduplicated().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import written

WORDS = 5
CELLS, BLOCKS, FINE = 1 << 22, 64, 6
DAMPING = 0.5
BANDS, ROWS = 9, 3
THRESHOLD = 0.8
SMALL, RING = 16, 2
BITS = 1 << 24
_TABLE = 1 << 14


def _summed(parts: DataFrame) -> DataFrame:
    """Arrays of counts (block, part, z), summed by block; by part first, so that no task gets a block of every task."""

    def run(t: pa.Table) -> pa.Table:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(CELLS // BLOCKS, np.uint64)
        for z in t["z"]:
            raw = unpack.decompress(z.as_py())
            total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * len(total) else np.uint64)  # a task's counts, or sums of them
        out = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        return pa.table({"block": t["block"].slice(0, 1), "part": t["part"].slice(0, 1), "z": pa.array([out], pa.binary())})

    kind = "block int, part int, z binary"
    return parts.groupBy("block", "part").applyInArrow(run, kind).withColumn("part", F.lit(0)).groupBy("block", "part").applyInArrow(run, kind)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """(number of documents that have a shingle of each cell, number of documents, sum of the cells)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for b in batches:
            buf, offs = K.buffers(b.column("text"))
            for i, j in K.slices(buf, offs, 2048):
                s, counts = K.shingles(*K.words(buf, offs[i : j + 1]), WORDS)
                np.add.at(total, np.unique(K.doc_of(counts) * CELLS + cell_of(s)) % CELLS, np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1)
        blocks = [pack.compress(x.tobytes()) for x in np.split(total, BLOCKS)]
        own = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array([own] * BLOCKS, pa.int32()), pa.array(blocks, pa.binary())],
            ["block", "part", "z"],
        )

    n = docs.count()
    out = np.zeros(CELLS, np.uint64)
    rows = _summed(docs.select("text").mapInArrow(run, "block int, part int, z binary")).collect()  # BLOCKS rows, whatever the corpus
    for r in rows:
        out[r["block"] * (CELLS // BLOCKS) : (r["block"] + 1) * (CELLS // BLOCKS)] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["z"]), np.uint64)
    return out, n, int(out.sum())


def cell_of(s: np.ndarray) -> np.ndarray:
    return (s % np.uint64(CELLS)).astype(np.int64)


def cell_levels(df: np.ndarray, total: int) -> np.ndarray:
    """log2 of each cell's frequency in steps of 1 / FINE: a byte a cell. What other shingles of the cell add on average is taken off."""
    own = np.maximum(df - (total - df.astype(np.float64)) / (CELLS - 1), 1.0)
    return np.minimum(np.rint(np.log2(own) * FINE), 255).astype(np.uint8)


def level_weights(n: int) -> np.ndarray:
    """The weight of each level: 1 for a shingle that all n documents have, 1 + DAMPING for one that a single document has."""
    idf = np.maximum(np.log(n + 1.0) - np.arange(256) / FINE * np.log(2), 0.0)
    return 1 + DAMPING * idf / np.log(n + 1.0) if n else np.ones(256)


@dataclass
class Weights:
    """Inverse document frequencies of shingles."""

    levels: np.ndarray
    table: np.ndarray

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return self.table[self.levels[cell_of(s)]]


def weights_of(docs: DataFrame) -> Weights:
    df, n, total = document_frequencies(docs)
    return Weights(cell_levels(df, total), level_weights(n))


def weighted(buf: np.ndarray, offs: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, their weights, number of them) of each document; sorted by shingle in each."""
    s, counts = K.shingles(*K.words(buf, offs), WORDS)
    doc = K.doc_of(counts)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]) if len(s) else np.zeros(0, int)
    tf = np.diff(np.append(new, len(s)))
    s = s[new]
    return s, (1 + np.log(tf)) * weights(s), np.bincount(doc[new], minlength=len(counts))


def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of Gamma(2, 1) draws r, of ln c for such c, and of uniform beta; a shingle's hash picks from each by bits of its own."""
    u = (np.arange(_TABLE) + 0.5) / _TABLE
    rng = np.random.default_rng(2010)
    gamma = lambda: -np.log(rng.permutation(u)) - np.log(rng.permutation(u))
    return gamma(), np.log(gamma()), rng.permutation(u)


_R, _LNC, _BETA = _variates()


def samples(s: np.ndarray, w: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """documents x k: a hash of each consistent weighted sample (shingle, level). Documents without shingles have 0."""
    out = np.zeros((len(counts), k), np.uint64)
    have = np.flatnonzero(counts)
    if not len(have):
        return out
    size = counts[have]
    starts = np.cumsum(size) - size
    lnw = np.log(w)
    mask = np.uint64(_TABLE - 1)
    for i in range(k):
        h = K.mix(s + np.uint64((i * 2 + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        r = _R[(h & mask).astype(np.intp)]
        beta = _BETA[(h >> np.uint64(14) & mask).astype(np.intp)]
        level = np.floor(lnw / r + beta)
        a = _LNC[(h >> np.uint64(28) & mask).astype(np.intp)] - r * (level - beta + 1)
        # the rest of the hash breaks ties of the tables
        a += (h >> np.uint64(42)).astype(np.float64) * 1e-13
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(least, size))
        pick = hit[np.searchsorted(hit, starts)]
        out[have, i] = K.mix(s[pick] + K.mix(level[pick].astype(np.int64).view(np.uint64)))
    return out


def bands(sig: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.zeros((len(sig), n_bands), np.uint64)
    for b in range(n_bands):
        for i in range(rows):
            h[:, b] = K.mix(h[:, b] + sig[:, b * rows + i] + np.uint64(b + 1))
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    every = float(a[1].sum() + b[1].sum()) - both
    return both / every if every else 0.0


def text_id() -> Column:
    """64 bits of the text's hash stand for the text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def signed(docs: DataFrame, weights: Weights) -> DataFrame:
    """t (id of the text), doc_id, rid (a number of the row's own, whose order means nothing), bands, mass (the shingles' weights
    together) and z (the compressed text) of each row; of rows with equal texts in a batch only one has the latter three.
    To be written before it is used: until then rid may change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            buf, offs = K.buffers(b.column("text"))
            for i, j in K.slices(buf, offs, 1024, 4 << 20):
                part = b.slice(i, j - i)
                _, first = np.unique(part.column("t").to_numpy(), return_index=True)
                lines = [buf[offs[i + x] : offs[i + x + 1]].tobytes() for x in first.tolist()]
                s, w, counts = weighted(*K.of_texts(lines), weights)
                h = bands(samples(s, w, counts, BANDS * ROWS)).view(np.int64).tolist()
                mass = np.bincount(K.doc_of(counts), w, len(counts)).tolist()
                keys: list = [None] * (j - i)
                masses: list = [None] * (j - i)
                z: list = [None] * (j - i)
                for k, x in enumerate(first.tolist()):
                    keys[x], masses[x], z[x] = h[k] if counts[k] else [], mass[k], pack.compress(lines[k])
                yield pa.RecordBatch.from_arrays(
                    [part.column("t"), part.column("doc_id"), pa.array(keys, pa.list_(pa.int64())), pa.array(masses, pa.float64()), pa.array(z, pa.binary())],
                    ["t", "doc_id", "bands", "mass", "z"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(text_id().alias("t"), "doc_id", "text").mapInArrow(run, f"t long, doc_id {kind}, bands array<long>, mass double, z binary")
    return rows.withColumn("rid", F.monotonically_increasing_id())


def _shared(members: DataFrame) -> DataFrame:
    """key, t, mass, n, lead of the members (key, t, mass) whose key has n > 1 of them, lead being the one with the least (t, mass);
    written, as most keys have one."""
    # written first: a join of two fresh shuffles is one whose large partitions Spark can split
    size = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "mass")).alias("lead")).where("n > 1"), "near-sizes")
    return written(members.join(size, "key"), "near-buckets")


def _alike(a: str, b: str, threshold: float) -> Column:
    """Whether two masses allow the similarity: it is at most the ratio of the lesser to the greater."""
    return F.least(a, b) >= F.greatest(a, b) * (threshold - 1e-9)


def _pairs(m: DataFrame, threshold: float) -> DataFrame:
    """Candidates a < b from buckets (see _shared): distinct pairs of texts that share a key, as the module says."""
    small = m.where(F.col("n") <= SMALL).select("key", "t", "mass")
    every = small.join(small.toDF("key", "b", "other"), "key").where(F.col("t") < F.col("b")).where(_alike("mass", "other", threshold)).select(F.col("t").alias("a"), "b")
    large = m.where(F.col("n") > SMALL)
    star = large.where((F.col("t") != F.col("lead.t")) & _alike("mass", "lead.mass", threshold)).select(F.col("lead.t").alias("a"), F.col("t").alias("b"))
    mixed = large.withColumn("h", F.xxhash64("t", "key")).withColumn("own", F.struct("t", "mass"))
    # rings of about 1000, so that no key's texts meet in one task
    ring = Window.partitionBy("key", F.pmod("h", F.ceil(F.col("n") / 1000))).orderBy("h")
    near = mixed.select("t", "mass", F.array(*(F.lead("own", i).over(ring) for i in range(1, RING + 1))).alias("others"))
    near = near.select("t", "mass", F.explode("others").alias("o")).where(F.col("o").isNotNull() & _alike("mass", "o.mass", threshold))
    near = near.select(F.least("t", "o.t").alias("a"), F.greatest("t", "o.t").alias("b"))
    return every.unionByName(star).unionByName(near).distinct()


def _perhaps(rows: DataFrame, need: DataFrame) -> DataFrame:
    """The rows whose t may be in ``need``, so that the others' texts are not shuffled. A bitmap of ``BITS`` bits, 2 MB whatever the
    corpus, is broadcast; the more ids there are, the more rows it lets through."""
    bit = F.pmod(F.col("t"), F.lit(BITS))
    maps = need.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    at = rows.withColumn("_at", F.bitmap_bit_position(bit)).withColumn("_map", F.bitmap_bucket_number(bit))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = at.join(F.broadcast(maps), "_map").withColumn("_byte", byte).where("(shiftright(_byte, cast(_at % 8 as int)) & 1) = 1")
    return hit.select(*rows.columns)


def _verified(pairs: DataFrame, table: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs whose texts have a weighted Jaccard similarity of at least the threshold."""
    pairs = written(pairs, "near-pairs")
    need = written(pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct(), "near-needed")
    few = _perhaps(table.where("z is not null").select("t", "z"), need)
    texts = written(few.join(need, "t").groupBy("t").agg(F.first("z").alias("z")), "near-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        read = lambda z: unpack.decompress(z, max_output_size=1 << 31) if z else b""
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                a, o = part.column("a").to_pylist(), part.column("b").to_pylist()
                z = dict(zip(a, part.column("za").to_pylist(), strict=True)) | dict(zip(o, part.column("zb").to_pylist(), strict=True))
                names = list(z)
                s, w, counts = weighted(*K.of_texts([read(z[k]) for k in names]), weights)
                end = np.cumsum(counts)
                span = {k: (s[e - c : e], w[e - c : e]) for k, c, e in zip(names, counts.tolist(), end.tolist(), strict=True)}
                ok = np.array([similarity(span[x], span[y]) >= threshold for x, y in zip(a, o, strict=True)], bool)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok))

    both = pairs.join(texts.toDF("a", "za"), "a").join(texts.toDF("b", "zb"), "b")
    return written(both.mapInArrow(run, "a long, b long"), "near-links")


def _rare(texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """t, c, mass, token, rest of texts (t, c, z): the rarest shingles of each, and the mass from each on, in one order for all texts. The
    shingles after them have too little mass for a similar text to share only those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                lines = [unpack.decompress(z, max_output_size=1 << 31) if z else b"" for z in part.column("z").to_pylist()]
                s, w, counts = weighted(*K.of_texts(lines), weights)
                doc = K.doc_of(counts)
                order = np.lexsort((s, -weights(s), doc))
                s, w = s[order], w[order]
                mass = np.bincount(doc, w, len(counts))
                done = np.cumsum(w) - w
                rest = mass[doc] - (done - done[(np.cumsum(counts) - counts)[doc]])
                k = np.flatnonzero(rest >= (threshold - 1e-6) * mass[doc])
                of = pa.array(doc[k])
                yield pa.RecordBatch.from_arrays(
                    [part.column("t").take(of), part.column("c").take(of), pa.array(mass[doc[k]]), pa.array(s[k].view(np.int64)), pa.array(rest[k])],
                    ["t", "c", "mass", "token", "rest"],
                )

    return texts.mapInArrow(run, "t long, c long, mass double, token long, rest double")


def _left(crowd: DataFrame, table: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Distinct pairs a < b of texts of crowd (key, t, c) in different components c, with every one that has at least the threshold's
    similarity among them: the first shingle that both have, rarest first, is one of both's ``_rare``, and what follows it has the mass
    that the similarity needs. Of a shingle's texts, those of its largest component do not meet each other."""
    parted = crowd.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high")
    need = written(crowd.join(parted.select("key"), "key", "left_semi").select("t", "c").distinct(), "near-left")
    texts = _perhaps(table.where("z is not null").select("t", "z"), need).join(need, "t").groupBy("t").agg(F.first("c").alias("c"), F.first("z").alias("z"))
    rare = written(_rare(texts, weights, threshold), "near-rare")
    per = rare.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    largest = per.groupBy("token").agg(F.max(F.struct("k", "c")).alias("p"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    several = written(rare.join(written(largest.select("token", F.col("p.c").alias("pc")), "near-shared"), "token"), "near-several")
    other = several.where("c != pc").select(
        "token", F.col("t").alias("o"), F.col("c").alias("co"), F.col("mass").alias("mo"), F.col("rest").alias("ro"),
    )
    enough = F.least("rest", "ro") * (1 + threshold) >= (F.col("mass") + F.col("mo")) * (threshold - 1e-6)
    # two others are met from both sides: one is enough
    met = several.join(other, "token").where((F.col("c") != F.col("co")) & enough & ((F.col("c") == F.col("pc")) | (F.col("t") < F.col("o"))))
    return met.select(F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b")).distinct()


def _crowd(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, t, mass, c (component) of the texts in large buckets."""
    return buckets.where(F.col("n") > SMALL).select("key", "t", "mass").join(nodes, F.col("t") == F.col("node"), "left").select("key", "t", "mass", F.coalesce("component", "t").alias("c"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, t (id of the text), class_id (the least doc_id of its class), class_size (rows), kept (true for one row of each class, one
    that has class_id): one row for each row of docs."""
    weights = weights_of(docs)
    table = written(signed(docs, weights), "near-signed")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    texts = written(table.groupBy("t").agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("rows"), first("bands"), first("mass")), "near-ids")
    buckets = _shared(texts.select("t", "mass", F.explode("bands").alias("key")))
    links = _verified(_pairs(buckets, threshold), table, weights, threshold)
    nodes = written(components(links), "near-classes")
    found = _verified(_left(_crowd(buckets, nodes), table, weights, threshold), table, weights, threshold)
    if not found.isEmpty():
        nodes = written(components(links.unionByName(found)), "near-classes")
    own = texts.join(nodes, F.col("t") == F.col("node"), "left").select("t", "row", "rows", F.coalesce("component", "t").alias("c"))
    best = own.groupBy("c").agg(F.min("row").alias("best"), F.sum("rows").alias("class_size"))
    of_text = own.join(best, "c").select("t", F.col("best.doc_id").alias("class_id"), F.col("best.rid").alias("kept_rid"), "class_size")
    rows = table.select("doc_id", "t", "rid").join(written(of_text, "near-texts-classes"), "t")
    return rows.select("doc_id", "t", "class_id", "class_size", (F.col("rid") == F.col("kept_rid")).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay: one of each class, that with the class's least doc_id. Of rows that have the same id and text that with
    the least hash of all its columns (maps aside) stays."""
    kept = classes(docs, threshold).where("kept").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")))
    rows = docs.select(text_id().alias("_t"), F.col("doc_id").alias("_d"), hashed.alias("_h"), F.struct(*own).alias("_row"))
    both = rows.join(kept, rows["_t"].eqNullSafe(kept["_t"]) & rows["_d"].eqNullSafe(kept["_d"]), "left_semi")
    return both.groupBy("_t", "_d").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
