"""Quality classifier: Bradley-Terry pairwise ranking.

A document has the score w.x of its features x. Of a preferred and another document the first
is preferred with probability sigmoid(w.x_i - w.x_j), so w is learned by logistic loss on the
differences of features. A first model, fitted on a bounded sample, is where the optimisation
begins; it goes on over all pairs of all labelled documents, whose features are a written table.
The score at the quantile that splits off the share of rejected labels, of all labelled documents
too, becomes the threshold.

Features come from the text alone: frequencies of hashed 1- to 3-grams of character classes, and
how often words repeat. Null or empty texts have the features 0 and get a score like any other.
Equal texts get equal scores, repeated rows repeated ones. To learn from, a doc_id counts once: with its lowest
label and, of several texts, the one of the least hash. Equal scores at the threshold are all accepted. Long texts are
read whole, a window at a time. Empty tables give no rows, and without labels all is accepted. Columns of the input that have the
name of one that score() adds (score, predicted) are left out; all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.decisions import percentiles
from . import kernels as K
from .shared import written
from .tables import hash_share

DIM = 1024
#: About so many labelled documents of each class, chosen by a hash of doc_id, are what the start is fitted on.
SAMPLE = 2000
#: Scores of all documents are summed in cells of this width, each score dealt to the two cells beside it: what a document's mean over
#: all of the other class loses by that is below 2e-5. Scores further from the mean than CELLS / 2 cells count as being there.
CELL, CELLS = 1 / 32, 1 << 13
#: Steps over all labelled documents, at most, and the norm of the gradient at which they end, as a share of the first one's.
STEPS, SMALL = 25, 0.01
#: Pairs that each sampled document is in, at least.
PAIRS = 8
ADDED = ("score", "predicted")


def _classes() -> np.ndarray:
    t = np.full(256, 14, np.uint8)
    t[128:] = 15
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "\"'`", "#$%&*", "-_/=+~", ":;", "<>{}[]()\\")):
        t[[ord(c) for c in chars]] = k
    return t


CLASSES = _classes()


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    grams = K.byte_ngrams(buf, offs, (1, 2, 3), DIM, CLASSES)
    size = np.diff(offs).astype(np.float32)
    h, counts = K.words(buf, offs)
    doc = K.doc_of(counts)
    n = np.maximum(counts, 1).astype(np.float32)
    same = np.zeros(len(counts), np.float32)
    if len(h) > 1:
        same += np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(counts))
    distinct = np.zeros(len(counts), np.float32)
    if len(h):
        order = np.lexsort((h, doc))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct += np.bincount(doc[order][fresh], minlength=len(counts))
    grams /= np.maximum(size, 1)[:, None]
    extra = np.stack([same / n, distinct / n, np.log1p(distinct) / np.maximum(np.log1p(n), 1), np.minimum(size / n, 40) / 40], 1)
    return np.concatenate([np.sqrt(grams), extra * (counts > 0)[:, None]], 1).astype(np.float32)


@dataclass
class BradleyTerry:
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ self.weights

    def score(self, x: np.ndarray, cut: float) -> np.ndarray:
        """From 0 to 1, and ``cut`` at the threshold."""
        z = self.raw(x) - self.threshold + np.log(cut / (1 - cut))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(good: np.ndarray, bad: np.ndarray, share_bad: float, steps: int = 400, decay: float = 1e-4) -> BradleyTerry:
    """From the features of preferred and of other documents, and the share of the latter in the corpus.

    Without a document of one kind there is no pair: all weights are 0, and all scores are above the threshold.
    """
    if not len(good) or not len(bad):
        return BradleyTerry(np.zeros(DIM + 4), -2.0)
    x = np.concatenate([good, bad]).astype(np.float64)
    scale = x.std(0)
    scale = 1 / np.where(scale > 1e-4, scale, np.inf)
    centre = x.mean(0)
    x = (x - centre) * scale
    rng = np.random.default_rng(1952)
    m = PAIRS * max(len(good), len(bad))
    i = np.concatenate([rng.permutation(len(good)) for _ in range(-(-m // len(good)))])[:m]
    j = len(good) + np.concatenate([rng.permutation(len(bad)) for _ in range(-(-m // len(bad)))])[:m]
    w, step, ahead = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1])
    rate = 4 / max(1.0, np.linalg.norm(x[i[:512]] - x[j[:512]], axis=1).mean() ** 2) * 4
    for t in range(steps):
        s = x @ ahead
        p = 1 / (1 + np.exp(np.clip(s[i] - s[j], -60, 60)))
        g = np.bincount(i, p, len(x)) - np.bincount(j, p, len(x))
        new = ahead + rate * (x.T @ g / m - decay * ahead)
        ahead = new + t / (t + 3) * (new - w)
        w = new
    s = x @ w
    weight = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share_bad - 1e-9))
    low, high = s[order[min(at, len(s) - 1)]], s[order[min(at + 1, len(s) - 1)]]
    return BradleyTerry(w * scale, float((low + high) / 2 + centre @ (w * scale)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(good, features) of the rows of a table of features."""
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            buf, _ = K.buffers(part.column("x"))
            yield part.column("good").to_numpy().astype(bool), buf.view(np.float32).reshape(-1, DIM + 4).astype(np.float64)


def _sums(table: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(good, features)`` over all rows: a row a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for good, x in _rows(batches):
            total = total + of(good, x)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return sum(np.frombuffer(bytes(r["sums"])) for r in table.select("good", "x").mapInArrow(run, "sums binary").collect())


def _spread(table: DataFrame, v: np.ndarray, ref: float) -> tuple[np.ndarray, np.ndarray]:
    """How the scores of other and of preferred documents are spread over the cells, each summing to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CELLS)
        for good, x in _rows(batches):
            at = np.clip((x @ v - ref) / CELL + CELLS // 2, 0, CELLS - 1.001)
            cell = at.astype(np.int64)
            for k, share in ((0, 1 - (at - cell)), (1, at - cell)):
                total += np.bincount(cell + k + CELLS * good, share, 2 * CELLS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["cell", "n"])

    out = np.zeros(2 * CELLS)
    for r in table.select("good", "x").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    bad, good = out[:CELLS], out[CELLS:]
    return bad / bad.sum(), good / good.sum()


def _against(spread: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each cell the mean of f(the other's score - the cell's) over the spread of the others."""
    kernel = f(np.arange(1 - CELLS, CELLS)[::-1] * CELL)
    n = 4 * CELLS
    return np.fft.irfft(np.fft.rfft(spread, n) * np.fft.rfft(kernel, n), n)[CELLS - 1 : 2 * CELLS - 1]


def refined(table: DataFrame, start: BradleyTerry, decay: float = 1e-4) -> BradleyTerry:
    """The model of all pairs of a preferred and another document of a table (good, x), by steps of L-BFGS from ``start``.

    A document's share in the gradient is a mean over all of the other class, a function of its score alone, so each step reads the
    documents twice: for the spread of scores, and for the gradient.
    """
    sums = _sums(table, lambda good, x: np.concatenate([[good.sum(), len(good)], x.sum(0), (x * x).sum(0)]))
    if not np.size(sums) > 1 or sums[0] in (0, sums[1]):  # no document, or no pair
        return start
    (n_good, total), first, second = sums[:2].astype(int).tolist(), *np.split(sums[2:], 2)
    centre = first / total
    scale = np.sqrt(np.maximum(second / total - centre**2, 0))
    scale = 1 / np.where(scale > 1e-4, scale, np.inf)
    grid = (np.arange(CELLS) - CELLS // 2) * CELL
    soft, sigmoid = (lambda z: np.logaddexp(0, z)), (lambda z: 1 / (1 + np.exp(-np.clip(z, -700, 700))))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        bad, good = _spread(table, w * scale, float(centre @ (w * scale)))
        return float(good @ _against(bad, soft) + decay / 2 * w @ w), bad, good

    def slope(w: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        v, ref = w * scale, float(centre @ (w * scale))
        up, down = _against(bad, sigmoid) / n_good, _against(good, lambda z: sigmoid(-z)) / (total - n_good)

        def of(is_good: np.ndarray, x: np.ndarray) -> np.ndarray:
            s = x @ v - ref
            c = np.where(is_good, np.interp(s, grid, up), -np.interp(s, grid, down))
            return np.append(c @ x, c.sum())

        g = _sums(table, of)
        return decay * w - scale * (g[:-1] - centre * g[-1])

    w = np.where(scale > 0, start.weights / np.where(scale > 0, scale, 1), 0)
    value, *spread = loss(w)
    g = slope(w, *spread)
    least, past = SMALL * np.linalg.norm(g), []
    for _ in range(STEPS):
        d, held = -g, []
        for ds, dg in reversed(past):
            held.append(a := ds @ d / (ds @ dg))
            d = d - a * dg
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g)))
        for (ds, dg), a in zip(past, reversed(held), strict=True):
            d = d + (a - dg @ d / (ds @ dg)) * ds
        step = 1.0
        while (found := loss(w + step * d))[0] > value + 1e-4 * step * (g @ d) and step > 1e-3:
            step /= 4
        if found[0] >= value:
            break
        new = slope(w + step * d, *found[1:])
        if (step * d) @ (new - g) > 1e-12:
            past = [*past[-7:], (step * d, new - g)]
        w, g, value = w + step * d, new, found[0]
        if np.linalg.norm(g) <= least:
            break
    v = w * scale

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x @ v)], ["s"])

    # between the last document that is below the threshold, by the count of rejected ones, and the next
    found = percentiles(table.select("good", "x").mapInArrow(scores, "s double"), "s", {"threshold": (total - n_good - 0.5) / (total - 1)})
    return BradleyTerry(v, float(found.first()["threshold"]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> BradleyTerry:
    """Learns from labels.quality (0 or 1) of all documents for which ``usable``, an expression of doc_id, holds; ``sample`` of each class
    are for the start. Labels that are null or of null documents don't count; a document labelled twice counts by its lowest label."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))
    counts = {r["good"]: r["n"] for r in own.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, sample / n) for k, n in counts.items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = K.buffers(b.column("text"))
            for i, j in K.slices(buf, offs):
                x = features(buf, offs[i : j + 1])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("good"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "good", "x"])

    # rows of one doc_id are one group, of which tasks keep one each before they are dealt out
    texts = docs.where(usable & F.col("doc_id").isNotNull()).select("doc_id", "text").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    table = written(texts.join(own, "doc_id").select("doc_id", "good", "text").mapInArrow(gather, f"doc_id {kind}, good int, x binary"), "quality-features")
    picked = hash_share(F.col("doc_id"), share.get(1, 0.0)) & (F.col("good") == 1) | hash_share(F.col("doc_id"), share.get(0, 0.0)) & (F.col("good") == 0)
    rows = table.where(picked).select("good", "x").collect()
    rows.sort(key=lambda r: (r["good"], bytes(r["x"])))
    of = lambda k: np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["good"] == k]).reshape(-1, DIM + 4)
    model = fit(of(1), of(0), counts.get(0, 0) / max(1, sum(counts.values())))
    return refined(table, model) if min(share.values(), default=1.0) < 1 else model


def score(docs: DataFrame, model: BradleyTerry, cut: float = 0.3, keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text, unless that is kept) with score and predicted (1 if score >= cut)."""
    rest = [n for n in docs.columns if n not in ADDED and (n != "text" or keep_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = K.buffers(b.column("text"))
            for i, j in K.slices(buf, offs):
                part = b.slice(i, j - i)
                s = model.score(features(buf, offs[i : j + 1]), cut)
                found = [pa.array(s), pa.array((s >= cut).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), *found], [*rest, *ADDED])

    types = dict(docs.dtypes)
    kept = docs.select(*(F.col(f"`{n}`") for n in rest), *([] if keep_text else ["text"]))
    return kept.mapInArrow(run, ", ".join([*(f"`{n}` {types[n]}" for n in rest), "score double", "predicted int"]))
