"""Reading the pipeline's tables, and rules that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def hash_share(key: Column, share: float) -> Column:
    """True for about this share of keys, always the same ones."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))
