"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Tables that are written at the same time.
CONCURRENT = 8
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a temporary one, on one machine only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark, "_shared_tmp"):
        spark._shared_tmp = "file://" + tempfile.mkdtemp(prefix="shared-")
    return spark._shared_tmp


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: this cuts the lineage,
    and later readers neither repeat the work nor depend on one executor's disk."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_all(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Tables that do not depend on each other, written at the same time: planning and small stages overlap, and the plan that reads
    them has their sizes to go by."""
    with ThreadPoolExecutor(CONCURRENT) as pool:
        return list(pool.map(lambda x: written(x[1], x[0]), tables.items()))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
