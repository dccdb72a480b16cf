"""Hidden Markov language model.

Tokens: the words of the text, A-Z in lower case, then one end token. A state emits the frequent words
and the end as symbols of their own and all rarer words as one symbol, which the word's share among
the rare words completes; so the model is a distribution over whole texts.

Training: words are counted over all training documents. Baum-Welch starts on a bounded sample of
segments and goes on with passes over all training documents, whose expected counts are summed by task
and then across partitions. Training cuts long texts in segments; scoring does not: the scaled forward
recursion runs over each whole text.

Counts of frequent words (a bounded table) go to the tasks; a document's other words are joined with
their counts by hash of the word, so the vocabulary is never gathered. Words are told apart by a 64-bit
hash.

A null text counts as empty: it has the end token only. Without training documents the score is the
base score, and an empty table gives no rows. Repeated rows give repeated results, each row for itself; of words with equal counts
those of the least hash are the frequent ones. doc_id may be of any type and null; further columns of the input are left out,
whatever their names. A long text takes memory in proportion to its words, as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written
from .tables import hash_share

STATES = 8
#: Words, at most, that are symbols of their own; that go to the tasks with their counts.
SYMBOLS, FREQUENT = 1 << 14, 1 << 18
SEGMENT = 256
#: Different segments of training documents, about, on which Baum-Welch starts.
SAMPLE = 2500
BLOCKS = 64


@dataclass
class Vocabulary:
    """hashes and counts of the frequent words, most frequent first; the first n_symbols are symbols."""

    hashes: np.ndarray
    counts: np.ndarray
    n_symbols: int
    documents: int
    words: int
    distinct: int

    @property
    def total(self) -> int:
        return self.words + self.documents

    def base_log(self, c: np.ndarray) -> np.ndarray:
        v = self.distinct + (self.documents > 0)
        return np.log10((c + 0.5) / (self.total + 0.5 * (v + 1)))

    def rare(self) -> tuple[float, int]:
        """(denominator of a word's share among the rare words, number of rare tokens)"""
        n = self.words - int(self.counts[: self.n_symbols].sum())
        return n + 0.5 * (self.distinct - self.n_symbols + 1), n

    def symbols(self, at: np.ndarray) -> np.ndarray:
        return np.where((at >= 0) & (at < self.n_symbols), at, self.n_symbols)

    @property
    def unigram(self) -> np.ndarray:
        c = np.concatenate([self.counts[: self.n_symbols], [self.rare()[1], self.documents]]) + 0.5
        return c / c.sum()


@dataclass
class Hmm:
    start: np.ndarray
    follow: np.ndarray  # start of a segment amid a text
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def slices_of(batches: Iterator[pa.RecordBatch], most: int = 2500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def count_words(docs: DataFrame) -> DataFrame:
    """h, c: how often each word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices_of(batches):
            h, _ = K.words(*K.buffers(b.column("text")))
            u, c = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "c"])

    return written(docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-words")


def vocabulary(counts: DataFrame, documents: int, symbols: int = SYMBOLS, frequent: int = FREQUENT) -> Vocabulary:
    """The frequent words are ``frequent`` ones, or all: those of the highest levels of counts, and of the level that is the last as many
    as there is room for, by hash."""
    level = F.floor(F.log2("c") * 16)
    sums = counts.groupBy(level.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"))
    levels = sorted(((r["k"], r["n"], r["s"]) for r in sums.collect()), reverse=True)  # 1024 rows at most
    taken, full, last, share = 0, None, None, 0.0
    for k, n, _ in levels:
        if taken + n > frequent:
            last, share = k, min(1.0, 1.05 * (frequent - taken) / n)
            break
        taken, full = taken + n, k
    wanted = F.lit(False)
    if full is not None:
        wanted = wanted | (level >= full)
    if last is not None:
        wanted = wanted | ((level == last) & hash_share(F.col("h"), share))
    rows = counts.where(wanted).toArrow() if levels else pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    h, c = rows["h"].to_numpy().astype(np.int64), rows["c"].to_numpy().astype(np.int64)
    order = np.lexsort((h, -c))[:frequent]
    return Vocabulary(h[order].view(np.uint64), c[order], min(symbols, len(order)), documents, sum(x[2] for x in levels), sum(x[1] for x in levels))


def texts_as_symbols(b: pa.RecordBatch, index: K.HashIndex, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions in the vocabulary, word counts by document, symbols with the end of each document)"""
    h, counts = K.words(*K.buffers(b.column("text")))
    at = index(h)
    sym = np.full(len(h) + len(counts), v.n_symbols + 1, np.int32)
    sym[np.arange(len(h)) + K.doc_of(counts)] = v.symbols(at)
    return h, at, counts, sym


def segments(sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in sym, length, whether it begins a text) of each segment, longest first."""
    n = -(-lengths // SEGMENT)
    begin = np.cumsum(lengths) - lengths
    number = K.ragged(np.zeros(len(n), np.int64), n)
    doc = K.doc_of(n)
    start = begin[doc] + number * SEGMENT
    size = np.minimum(lengths[doc] - number * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    return start[order], size[order], number[order] == 0


class Expected:
    """Expected counts of a Baum-Welch pass."""

    def __init__(self, n_symbols: int, states: int):
        self.emit = np.zeros((n_symbols + 2, states))
        self.move, self.start, self.follow = np.zeros((states, states)), np.zeros(states), np.zeros(states)
        self.log = 0.0

    def add(self, m: Hmm, sym: np.ndarray, lengths: np.ndarray) -> None:
        self.add_segments(m, sym, *segments(sym, lengths))

    def add_segments(self, m: Hmm, sym: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, most: int = 2048) -> None:
        """Segments, longest first: where each starts in sym, its length, whether it begins a text."""
        emit, move = m.emit.astype(np.float32), m.move.astype(np.float32)
        for i in range(0, len(starts), most):
            self._chunk(m, emit, move, sym, starts[i : i + most], sizes[i : i + most], first[i : i + most])

    def _chunk(self, m: Hmm, emit: np.ndarray, move: np.ndarray, sym: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> None:
        longest = int(sizes[0])
        alive = np.searchsorted(-sizes, -np.arange(longest), "left")  # segments longer than t
        seen = [sym[starts[: alive[t]] + t] for t in range(longest)]
        alpha, scale = [], []
        a = np.where(first[:, None], m.start, m.follow).astype(np.float32) * emit[seen[0]]
        for t in range(longest):
            if t:
                a = (alpha[-1][: alive[t]] @ move) * emit[seen[t]]
            s = a.sum(1, keepdims=True)
            a /= s
            alpha.append(a)
            scale.append(s)
            self.log += float(np.log(s).sum())
        beta = np.ones((alive[-1], move.shape[0]), np.float32)
        states = move.shape[0]
        xi = np.zeros((states, states), np.float64)
        gammas = []
        for t in range(longest - 1, -1, -1):
            gammas.append(alpha[t] * beta)
            if t:
                w = emit[seen[t]] * beta / scale[t]
                xi += alpha[t - 1][: alive[t]].T @ w
                beta = np.ones((alive[t - 1], states), np.float32)
                beta[: alive[t]] = w @ move.T
        self.move += xi * m.move
        self.start += gammas[-1][first].sum(0)
        self.follow += gammas[-1][~first].sum(0)
        gamma, where = np.concatenate(gammas), np.concatenate(seen[::-1])
        for k in range(states):
            self.emit[:, k] += np.bincount(where, gamma[:, k], len(self.emit))

    def vector(self) -> np.ndarray:
        return np.concatenate([self.emit.ravel(), self.move.ravel(), self.start, self.follow, [self.log]])

    def maximised(self, unigram: np.ndarray, prior: float = 30.0) -> Hmm:
        return self.of(self.vector(), unigram, len(self.start), prior)

    @staticmethod
    def of(x: np.ndarray, unigram: np.ndarray, states: int, prior: float = 30.0) -> Hmm:
        n = len(unigram) * states
        emit, rest = x[:n].reshape(-1, states) + prior * unigram[:, None], x[n:]
        move = rest[: states * states].reshape(states, states) + 0.1
        start, follow = rest[states * states : states * states + states] + 0.1, rest[states * states + states : states * states + 2 * states] + 0.1
        return Hmm(start / start.sum(), follow / follow.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def begin(unigram: np.ndarray, states: int = STATES) -> Hmm:
    rng = np.random.default_rng(1966)
    emit = unigram[:, None] * rng.uniform(0.5, 1.5, (len(unigram), states))
    even = np.full(states, 1 / states)
    return Hmm(even, even, 0.9 * np.eye(states) + 0.1 / states, emit / emit.sum(0))


def forward(m: Hmm, sym: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of each text's probability, by the scaled forward recursion over whole texts, all at once."""
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    out = np.zeros(len(sizes))
    a = None
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
    for t, n in enumerate(alive):
        e = m.emit[sym[starts[:n] + t]]
        a = m.start * e if a is None else (a[:n] @ m.move) * e
        s = a.sum(1)
        a /= s[:, None]
        out[:n] += np.log10(s)
    back = np.empty_like(out)
    back[order] = out
    return back


def _summed(parts: DataFrame) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in t["v"].to_pylist()], 0)
        return pa.table({"block": t["block"].slice(0, 1), "part": t["part"].slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, part int, v binary"
    return parts.groupBy("block", "part").applyInArrow(run, kind).withColumn("part", F.lit(0)).groupBy("block", "part").applyInArrow(run, kind)


def baum_welch(docs: DataFrame, m: Hmm, v: Vocabulary) -> Hmm:
    """One pass over all documents: each task's expected counts, in blocks, are summed across partitions."""
    states = len(m.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, e = K.HashIndex(v.hashes), Expected(v.n_symbols, states)
        for b in slices_of(batches):
            _, _, counts, sym = texts_as_symbols(b, index, v)
            e.add(m, sym, counts + 1)
        pid = TaskContext.get().partitionId()
        blocks = np.array_split(e.vector(), BLOCKS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array([pid % 32] * BLOCKS, pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())],
            ["block", "part", "v"],
        )

    rows = _summed(docs.select("text").mapInArrow(run, "block int, part int, v binary")).collect()  # BLOCKS rows, whatever the corpus
    return Expected.of(np.concatenate([np.frombuffer(r["v"], np.float64) for r in sorted(rows, key=lambda r: r["block"])]), v.unigram, states)


def train(
    docs: DataFrame, states: int = STATES, passes: int = 2, sample: int = SAMPLE, sample_steps: int = 25,
) -> tuple[Vocabulary, Hmm | None, DataFrame]:
    """(vocabulary, model, the table h, c of all words' counts)"""
    n = docs.count()
    counts = count_words(docs)
    v = vocabulary(counts, n)
    if not n:
        return v, None, counts

    share = min(1.0, sample / (n + v.words / SEGMENT))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = K.HashIndex(v.hashes)
        for b in slices_of(batches):
            _, _, counts, sym = texts_as_symbols(b, index, v)
            rows = []
            for start, size, first in zip(*segments(sym, counts + 1), strict=True):
                raw = sym[start : start + size].tobytes()
                h = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=bytes([bool(first)])).digest(), "little", signed=True)
                if (h & 0xFFFFFFFF) < share * 2**32:
                    rows.append((h, bool(first), raw))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))],
                ["h", "first", "s"],
            )

    # equal segments have one hash and count once, so there are about ``sample``, of SEGMENT symbols at most
    few = docs.select("text").mapInArrow(gather, "h long, first boolean, s binary").dropDuplicates(["h"]).collect()
    m = begin(v.unigram, states)
    if few:
        few.sort(key=lambda r: (-len(r["s"]), r["h"]))
        sym = np.concatenate([np.frombuffer(r["s"], np.int32) for r in few])
        sizes, first = np.array([len(r["s"]) // 4 for r in few]), np.array([r["first"] for r in few])
        for _ in range(sample_steps):
            e = Expected(v.n_symbols, states)
            e.add_segments(m, sym, np.cumsum(sizes) - sizes, sizes, first)
            m = e.maximised(v.unigram)
    for _ in range(passes):
        m = baum_welch(docs, m, v)
    return v, m, counts


def score(docs: DataFrame, v: Vocabulary, m: Hmm | None, counts: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    denominator, _ = v.rare()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = K.HashIndex(v.hashes)
        base = np.append(v.base_log(v.counts.astype(float)), 0.0)
        share = np.append(np.log10((v.counts + 0.5) / denominator), 0.0)
        share[: v.n_symbols] = 0
        end = float(v.base_log(np.array([float(v.documents)]))[0])
        # a row's number stands for it: rows that repeat stay apart
        row = np.uint64(TaskContext.get().partitionId()) << np.uint64(40)
        for b in slices_of(batches):
            h, at, words, sym = texts_as_symbols(b, index, v)
            n = len(words)
            rid = K.mix(row + np.arange(n, dtype=np.uint64))
            row += np.uint64(n)
            doc = K.doc_of(words)
            log = np.bincount(doc, base[at], n) + end
            model = np.bincount(doc, share[at], n) + (forward(m, sym, words + 1) if m else 0)
            known = np.bincount(doc[at >= 0], minlength=n) + (v.documents > 0)
            rare = at < 0
            order = np.lexsort((h[rare], doc[rare]))
            rh, rd = h[rare][order], doc[rare][order]
            new = np.flatnonzero(np.r_[True, (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1])]) if len(rh) else np.zeros(0, int)
            times = np.diff(np.append(new, len(rh)))
            k = len(new)
            with_none = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(k, t)])
            ids = b.column("doc_id")
            columns = {
                "doc_id": pa.concat_arrays([ids, pa.nulls(k, ids.type)]),
                "rid": pa.array(np.r_[rid, rid[rd[new]]].view(np.int64)),
                # a document's own row has a hash that, but for chance, no word has; its n is 0, so that it adds nothing if it meets one
                "h": pa.array(np.r_[rid, rh[new]].view(np.int64)),
                "n": pa.array(np.r_[np.zeros(n, np.int64), times]),
                "n_tokens": with_none(words + 1, pa.int64()),
                "known": with_none(known, pa.int64()),
                "base": with_none(log, pa.float64()),
                "model": with_none(model, pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, rid long, h long, n long, n_tokens long, known long, base double, model double",
    )
    c = F.coalesce(F.col("c"), F.lit(0))
    v_all = v.distinct + (v.documents > 0)
    joined = rows.join(counts, "h", "left")
    each = joined.groupBy("rid").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0))).cast("long").alias("n_known"),
        (F.max("base") + F.sum(F.col("n") * F.log10((c + 0.5) / (v.total + 0.5 * (v_all + 1))))).alias("base_score"),
        (F.max("model") + F.sum(F.col("n") * F.log10((c + 0.5) / denominator))).alias("score"),
    )
    train_tokens = F.lit(v.total).cast("long").alias("train_tokens")
    score_ = (F.col("score") if m else F.col("base_score")).alias("score")
    return each.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", train_tokens, "base_score", score_)
