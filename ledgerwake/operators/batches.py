"""Features as a batch-by-batch run merges them, for comparison with tables that were made so.

The exact features come from one plan over all rows. Where batches are aggregated apart and their results merged, a mean of
means, a maximum of distinct counts or a sum of distinct counts is not the same; these give just that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MERGES = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}

#: How merged columns are recombined; ratios are then computed from them.
BASIC = {
    "total_volume": "sum", "sum_sq_amount": "sum", "total_txns": "sum", "max_txn_amount": "max", "min_txn_amount": "min",
    "reversal_count": "sum", "credit_count": "sum", "debit_count": "sum", "credit_volume": "sum", "debit_volume": "sum",
    "n_channels": "max", "n_counterparties": "max",
}
GAPS = {"iat_mean": "mean", "iat_std": "mean", "iat_median": "mean", "iat_min": "min", "burst_count_60s": "sum", "burst_count_5min": "sum"}
BALANCES = {
    "balance_std": "mean", "balance_mean": "mean", "balance_min": "min", "balance_max": "max", "near_zero_balance_count": "sum",
    "negative_balance_count": "sum",
}
IPS = {"n_unique_ips": "sum", "n_ip_txns": "sum"}


def merged(feature: Callable[[DataFrame], DataFrame], txns: DataFrame, batch: str, batches: list, how: dict[str, str]) -> DataFrame:
    """feature of each batch by itself, merged by account as ``how`` says."""
    parts = [feature(txns.where(F.col(batch) == b)).select("account_id", *how) for b in batches]
    return reduce(DataFrame.unionByName, parts).groupBy("account_id").agg(*(_MERGES[m](c).alias(c) for c, m in how.items()))
