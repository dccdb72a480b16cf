"""A corpus pipeline over ``documents``: quality, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each
stage's result as Parquet to the shared folder and reads it again as the next one's docs. All stages but the last
return the columns of documents.

- quality: drops the documents that the Bradley-Terry ranking, learned from labels.quality of all labelled documents
  among docs, scores below the threshold.
- language: drops the documents without a letter and those whose two nearest codewords are about equally near.
- near_dedup: keeps one document of each class of near-duplicates.
- mix: the documents that the mix to target weights consists of, one row a copy.
- pack: the pieces of sequences of 2048 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.llm import langid, mixing, neardup, packing, quality
from ledgerwake.llm.queries import tokenizer_path
from ledgerwake.llm.shared import written
from ledgerwake.llm.tables import read


_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _guarded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with further columns renamed, so that they clash with none that a stage adds; and what restores names and order."""
    names = {c: c if c in _OWN else f"_further{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda df: df.select(*(F.col(n).alias(c) for c, n in names.items()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, restored = _guarded(docs)
    model = quality.train(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return restored(quality.score(docs, model, keep_text=True).where("predicted = 1"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, restored = _guarded(docs)
    found = langid.predict(docs, langid.train(docs, F.lit(True)), keep_text=True)
    return restored(found.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, restored = _guarded(docs)
    return restored(neardup.deduplicated(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, restored = _guarded(docs)
    return restored(mixing.copies(mixing.mix(docs), docs.columns))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_dedup", near_dedup_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: No SQL expresses the learned stages; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
