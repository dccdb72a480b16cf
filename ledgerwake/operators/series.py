"""Per-account series: days, months, hours, gaps between transactions, and windows of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EPS, count_all, ratio, sum_if, whole_days, whole_seconds, zsum


def daily(txns: DataFrame) -> DataFrame:
    size = F.abs("amount")
    return txns.groupBy("account_id", F.to_date("ts").alias("day")).agg(
        zsum(size).alias("daily_vol"), count_all().alias("daily_txns"), sum_if(F.col("txn_type") == "C", size).alias("daily_in"),
        sum_if(F.col("txn_type") == "D", size).alias("daily_out"),
    )


def rolling_zscore(days: DataFrame) -> DataFrame:
    """z of each active day against the 7 active days around it; two at least."""
    w = Window.partitionBy("account_id").orderBy("day").rowsBetween(-3, 3)
    v = F.col("daily_vol")
    z = F.when(F.count(v).over(w) >= 2, (v - F.avg(v).over(w)) / (F.stddev_samp(v).over(w) + EPS))
    a = days.withColumn("z", z).groupBy("account_id").agg(F.max("z").alias("m"), F.avg("z").alias("a"))
    return a.select(
        "account_id", F.coalesce("m", F.lit(0.0)).alias("rolling_7d_zscore_max"),
        F.coalesce("a", F.lit(0.0)).alias("rolling_7d_zscore_mean"),
    )


def cp_entropy(txns: DataFrame) -> DataFrame:
    """Entropy in bits of an account's transactions over its counterparties; none is one of them."""
    per = txns.groupBy("account_id", "counterparty_id").agg(count_all().alias("n"))
    # -sum p log2 p = log2 N - sum n log2 n / N, so no total has to be joined back
    a = per.groupBy("account_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return a.select("account_id", F.greatest(F.lit(0.0), F.log2("t") - F.col("s") / F.col("t")).alias("cp_entropy"))


def days_to_first(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    first = txns.groupBy("account_id").agg(F.min("ts").alias("first"))
    d = F.datediff(F.to_date("first"), F.to_date("account_opening_date"))
    return accounts.select("account_id", "account_opening_date").join(first, "account_id").select(
        "account_id", F.greatest(F.coalesce(d, F.lit(999)), F.lit(0)).alias("days_to_first_txn"),
    )


def turnover(basic: DataFrame, balance: DataFrame) -> DataFrame:
    j = basic.select("account_id", "total_volume").join(balance.select("account_id", "balance_mean"), "account_id", "left")
    return j.select("account_id", F.coalesce(F.col("total_volume") / (F.abs("balance_mean") + 1), F.lit(0.0)).alias("turnover_ratio"))


def peak_day(days: DataFrame) -> DataFrame:
    a = days.groupBy("account_id")
    return a.agg(
        ratio(F.max("daily_txns"), F.sum("daily_txns")).alias("peak_day_conc_txn"),
        ratio(F.max("daily_vol"), F.sum("daily_vol")).alias("peak_day_conc_vol"),
    )


def pass_through(days: DataFrame, version: int = 2) -> DataFrame:
    """Money that goes out on the day it comes in: its share of all volume (1), or of the larger side's (2)."""
    low, high = F.sum(F.least("daily_in", "daily_out")), F.sum(F.greatest("daily_in", "daily_out"))
    return days.groupBy("account_id").agg(F.coalesce(low / ((F.sum("daily_vol") if version == 1 else high) + EPS), F.lit(0.0)).alias("pass_through_ratio"))


def gaps(txns: DataFrame) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy("ts")
    iat = whole_seconds(F.lag("ts").over(w), F.col("ts"))
    t = txns.select("account_id", iat.alias("iat"))
    return t.groupBy("account_id").agg(
        F.avg("iat").alias("iat_mean"), F.stddev_samp("iat").alias("iat_std"), F.min("iat").alias("iat_min"),
        F.median("iat").alias("iat_median"), F.count_if(F.col("iat") < 60).alias("burst_count_60s"),
        F.count_if(F.col("iat") < 300).alias("burst_count_5min"),
    )


def monthly(txns: DataFrame, horizon: int = 60) -> DataFrame:
    size = F.abs("amount")
    m = txns.groupBy("account_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        count_all().alias("n"), zsum(size).alias("v"), F.max(size).alias("x"),
    )
    a = m.groupBy("account_id").agg(
        count_all().alias("n_active_months"), F.avg("v").alias("monthly_vol_mean"), F.stddev_samp("v").alias("monthly_vol_std"),
        F.max("v").alias("monthly_vol_max"), F.min("v").alias("monthly_vol_min"),
        F.avg("n").alias("monthly_txns_mean"), F.stddev_samp("n").alias("monthly_txns_std"), F.max("n").alias("monthly_txns_max"),
        F.max("x").alias("peak_monthly_max_txn"),
    )
    return a.select(
        "*", ratio("monthly_vol_max", "monthly_vol_mean").alias("vol_spike_ratio"),
        ratio("monthly_txns_max", "monthly_txns_mean").alias("txn_spike_ratio"),
        ratio("monthly_vol_std", "monthly_vol_mean").alias("monthly_vol_cv"),
        (F.lit(horizon) - F.col("n_active_months")).alias("n_dormant_months"),
    )


def passthrough_hours(txns: DataFrame, tolerance: float = 0.2) -> DataFrame:
    size, c, d = F.abs("amount"), F.col("txn_type") == "C", F.col("txn_type") == "D"
    h = txns.groupBy("account_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(
        F.count_if(c).alias("nc"), F.count_if(d).alias("nd"), sum_if(c, size).alias("vc"), sum_if(d, size).alias("vd"),
    )
    both = (F.col("nc") > 0) & (F.col("nd") > 0)
    return h.groupBy("account_id").agg(
        F.count_if(both).alias("passthrough_hours"),
        F.count_if(both & (F.abs(F.col("vc") - F.col("vd")) / (F.col("vc") + EPS) < tolerance)).alias("matched_passthrough_hours"),
    )


def concentration(txns: DataFrame) -> DataFrame:
    p = txns.where(F.col("counterparty_id").isNotNull()).groupBy("account_id", "counterparty_id").agg(count_all().alias("n"), zsum(F.abs("amount")).alias("v"))
    a = p.groupBy("account_id").agg(
        F.max("n").alias("top_cparty_txn_count"), F.max("v").alias("top_cparty_volume"), F.sum("n").alias("total_cparty_txns"),
        F.sum("v").alias("total_cparty_volume"), count_all().alias("n_unique_counterparties"),
    )
    return a.select(
        "*", ratio("top_cparty_txn_count", "total_cparty_txns").alias("top_cparty_concentration"),
        ratio("top_cparty_volume", "total_cparty_volume").alias("top_cparty_volume_share"),
    )


def activity_span(txns: DataFrame) -> DataFrame:
    a = txns.groupBy("account_id").agg(F.min("ts").alias("first_txn_ts"), F.max("ts").alias("last_txn_ts"))
    return a.withColumn("activity_span_days", whole_days("first_txn_ts", "last_txn_ts"))


def lifecycle(txns: DataFrame, flagged: DataFrame) -> DataFrame:
    """From the first to the last transaction of flagged accounts."""
    return activity_span(txns.join(flagged.select("account_id").distinct(), "account_id", "left_semi")).select(
        "account_id", F.col("first_txn_ts").alias("suspicious_start"), F.col("last_txn_ts").alias("suspicious_end"),
    )


def peak_window(days: DataFrame) -> DataFrame:
    """account_id, start, end: the days around the highest 7-day mean on which that mean stays at the baseline or above.

    Days without transactions count as 0; the baseline is the median of the days, else their mean, else 1. The end is the day after the last.
    """
    first = days.groupBy("account_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), count_all().alias("n"))
    every = first.select("account_id", "n", F.explode(F.sequence("lo", "hi")).alias("day")).join(
        days.select("account_id", "day", "daily_vol"), ["account_id", "day"], "left",
    ).select("account_id", "n", "day", F.coalesce("daily_vol", F.lit(0.0)).alias("v"))
    order = Window.partitionBy("account_id").orderBy("day")
    m = every.withColumn("m", F.avg("v").over(order.rowsBetween(-3, 3)))
    level = m.groupBy("account_id").agg(
        F.median("v").alias("med"), F.avg("v").alias("mean"),
        F.max(F.struct("m", (-F.datediff("day", F.lit("1970-01-01").cast("date"))).alias("later"))).alias("top"),
    )
    base = F.when(F.col("med") > 0, F.col("med")).when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    peak = F.date_add(F.lit("1970-01-01").cast("date"), -F.col("top.later"))
    level = level.select("account_id", base.alias("base"), peak.alias("peak"))
    j = m.join(level, "account_id")
    low = F.col("m") < F.col("base")
    a = j.groupBy("account_id").agg(
        F.first("peak").alias("peak"), F.first("n").alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi"),
        F.max(F.when(low & (F.col("day") < F.col("peak")), F.col("day"))).alias("before"),
        F.min(F.when(low & (F.col("day") > F.col("peak")), F.col("day"))).alias("after"),
    )
    start = F.coalesce(F.date_add("before", 1), F.col("lo"))
    end = F.coalesce(F.col("after"), F.date_add("hi", 1))
    return a.select("account_id", start.alias("suspicious_start"), end.alias("suspicious_end"))


def window_sizes(windows: DataFrame) -> DataFrame:
    d = F.datediff("suspicious_end", "suspicious_start")
    return windows.agg(
        F.avg(d).alias("mean_days"), F.median(d).cast("double").alias("median_days"), F.min(d).alias("min_days"),
        F.max(d).alias("max_days"), *(F.count_if(d < k).alias(f"under_{k}") for k in (7, 30, 90)),
    )
