"""The daily grain over a stream of transactions, for whoever feeds the features continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import count_all, sum_if, zsum


def daily_volume(txns: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows of closed days as the watermark passes them; a transaction that comes later than ``late`` is dropped."""
    size = F.abs("amount")
    t = txns.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    a = t.groupBy("account_id", F.window("ts", "1 day")).agg(
        zsum(size).alias("daily_vol"), count_all().alias("daily_txns"), sum_if(F.col("txn_type") == "C", size).alias("daily_in"),
        sum_if(F.col("txn_type") == "D", size).alias("daily_out"),
    )
    return a.select("account_id", F.to_date("window.start").alias("day"), "daily_vol", "daily_txns", "daily_in", "daily_out")
