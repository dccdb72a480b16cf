"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary logistic classifier on hashed
byte n-grams predicts it; the language whose codeword has the lowest loss, weighted by how
reliable each bit's classifier is, is chosen. The choice is flagged as ambiguous where the second
codeword is nearly as close.

A text that is null or has no letter gets ``und`` with the score 0. Without a labelled document
every text gets that. Ties go to the language that is first by code point. Equal texts get equal predictions,
repeated rows repeated ones; to learn from, equal texts of one language count once. Long texts are read whole, a
window at a time. An empty table gives no rows. Columns of the input that have the name of one that predict()
adds (lang_pred, score, ambiguous) are left out; all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written

DIM = 2048
SIZES = (1, 2, 3, 4)
#: At most so many different labelled texts are fitted on (but 20 a language), evenly over the languages, chosen by a hash of the text.
SAMPLE = 6000
ADDED = ("lang_pred", "score", "ambiguous")
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    x = np.sqrt(K.byte_ngrams(buf, offs, SIZES, DIM))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(k: int) -> np.ndarray:
    """k codewords: all ways to part up to 6 languages in two, or else 10 log2 k pseudo-random ones."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 6:
        return np.array([[1 if i == 0 or not b >> (i - 1) & 1 else -1 for b in range(1, 1 << (k - 1))] for i in range(k)], float)
    rng = np.random.default_rng(k)
    columns: list[np.ndarray] = []
    while len(columns) < int(np.ceil(10 * np.log2(k))):
        c = rng.permutation(np.where(np.arange(k) < k // 2, 1.0, -1.0))
        if not any(abs(c @ x) == k for x in columns):
            columns.append(c)
    return np.stack(columns, 1)


@dataclass
class Ecoc:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    margin: float = 0.02

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, whether it is ambiguous)"""
        if not self.code.shape[1]:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        f = x.astype(np.float64) @ self.weights + self.bias
        loss = np.zeros((len(x), len(self.languages)))
        for b, t in enumerate(self.trust):
            loss += t * np.logaddexp(0, -f[:, b : b + 1] * self.code[None, :, b])
        loss /= self.trust.sum()
        best = loss.argmin(1)
        other = np.partition(loss, 1, axis=1)[:, :2]
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * max(1, self.code.shape[1]))
        return best, p[np.arange(len(x)), best] / p.sum(1), other[:, 1] - other[:, 0] < self.margin


def fit(x: np.ndarray, y: list[str], steps: int = 120, decay: float = 1e-5) -> Ecoc:
    languages = sorted(set(y))
    code = codewords(len(languages))
    at = {k: i for i, k in enumerate(languages)}
    own = np.array([at[v] for v in y], int)
    n_bits = code.shape[1]
    w, b = np.zeros((x.shape[1] if len(x) else DIM, n_bits)), np.zeros(n_bits)
    trust = np.ones(n_bits)
    if n_bits:
        bits = code[own]
        even = 1 / np.bincount(own, minlength=len(languages))[own] / len(languages)
        x = x.astype(np.float32)
        v, vb, rate = w.copy(), b.copy(), 8.0
        for t in range(steps):
            p = even[:, None] * bits / (1 + np.exp(np.clip(bits * (x @ v.astype(np.float32) + vb), -60, 60)))
            new, nb = v + rate * (x.T @ p.astype(np.float32) - decay * v), vb + rate * 0.1 * p.sum(0)
            f = t / (t + 3)
            v, vb, w, b = new + f * (new - w), nb + f * (nb - b), new, nb
        right = ((x @ w + b) * bits > 0).astype(float)
        trust = np.maximum(2 * (even @ right) - 1, 0.01)
    return Ecoc(languages, code, w, b, trust)


def sampled(own: DataFrame, sample: int) -> DataFrame:
    """lang, text: of the different texts of each language as many as its even share of the sample, the least by a hash."""
    key = F.xxhash64("text").alias("key")
    texts = written(own.select("lang", key).distinct(), "language-texts")
    # written, so that its size is known when the join is planned and the texts need not go by language
    counts = written(texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    most = max(20, sample // max(1, counts.count()))
    # twice as many as needed at first, so that no task ranks all of a language's texts
    few = texts.join(counts, "lang").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.least(F.lit(1.0), 2.0 * most / F.col("n")) * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("key"), F.lit(1 << 30)), "key"))
    picked = written(few.withColumn("place", place).where(F.col("place") <= most).select("lang", "key"), "language-sample")
    # two numbers for each text of the sample; a text's copies are one group, of which tasks keep one each
    return own.select("lang", "text", key).join(F.broadcast(picked), ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))


def train(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Ecoc:
    """Learns from text and lang of the documents for which ``usable`` holds and neither is null."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable).select("lang", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = K.buffers(b.column("text"))
            for i, j in K.slices(buf, offs):
                x = features(buf, offs[i : j + 1]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    rows = sampled(own, sample).select("lang", "text").mapInArrow(gather, "lang string, x binary").collect()  # the sample's
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return fit(np.array([np.frombuffer(r["x"], np.float16) for r in rows]).reshape(-1, DIM), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Ecoc, keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text, unless that is kept) with lang_pred, score and ambiguous."""

    rest = [n for n in docs.columns if n not in ADDED and (n != "text" or keep_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, object)
        for b in batches:
            buf, offs = K.buffers(b.column("text"))
            for i, j in K.slices(buf, offs):
                part = b.slice(i, j - i)
                letter = np.array([t is not None and _LETTER.search(t) is not None for t in part.column("text").to_pylist()], bool) & (len(names) > 0)
                lang, score, ambiguous = np.full(j - i, UNKNOWN, object), np.zeros(j - i), np.ones(j - i, bool)
                if letter.any():
                    best, p, close = model.decode(features(buf, offs[i : j + 1]))
                    lang[letter], score[letter], ambiguous[letter] = names[best[letter]], p[letter], close[letter]
                found = [pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), *found], [*rest, *ADDED])

    types = dict(docs.dtypes)
    kept = docs.select(*(F.col(f"`{n}`") for n in rest), *([] if keep_text else ["text"]))
    return kept.mapInArrow(run, ", ".join([*(f"`{n}` {types[n]}" for n in rest), "lang_pred string", "score double", "ambiguous boolean"]))
