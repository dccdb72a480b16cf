"""Spark sessions, and this package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the queries rely on; the rest is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def session(app: str = "ledgerwake", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """For tests and benchmarks on one machine."""
    return session(**{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once a Spark application, wherever Python finds it on the driver."""
    sc = spark.sparkContext
    if not getattr(sc, "_ledgerwake_shipped", False):
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="ledgerwake-"), "ledgerwake.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"ledgerwake/{f.relative_to(root)}")
        sc.addPyFile(path)
        sc._ledgerwake_shipped = True
    return spark
