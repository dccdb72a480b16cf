"""Out-of-fold target encoding of transaction keys, and account statistics of the encodings.

The encoding of a key for a transaction of fold f is (S - S_f + a * prior) / (N - N_f + a) over labelled transactions; an
account without a label has no fold, so nothing is taken away and the same expression is the full encoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import EPS, count_all, ratio
from .decisions import with_before

#: Smoothing of each key.
ALPHA = {"counterparty": 50.0, "mcc": 20.0, "channel": 20.0, "pair": 60.0, "txntype": 20.0, "mcc_txn": 40.0, "cp_txn": 50.0}


def folds(labels: DataFrame, k: int = 5) -> DataFrame:
    """labels (a row an account) with a fold that is even in each class, by the order of a hash of account_id that every engine has;
    ranked by ranges, so that no task sorts all labels."""
    place = F.conv(F.substring(F.md5(F.col("account_id").cast("binary")), 1, 15), 16, 10).cast("long")
    ranked = with_before(labels.withColumn("_place", place).withColumn("_one", F.lit(1)), "_place", "_one", ("is_mule",))
    return ranked.select(*labels.columns, (F.col("_before") % k).cast("int").alias("fold"))


def prior_of(labels: DataFrame) -> DataFrame:
    return labels.agg(F.avg("is_mule").alias("prior"))


def grain(txns: DataFrame, keys: list[str]) -> DataFrame:
    """account_id, keys, n, amount (their sum): all that the statistics of these keys need of transactions."""
    return txns.groupBy("account_id", *keys).agg(count_all().alias("n"), F.sum("amount").alias("amount"))


def key_stats(per: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fold, s, n over labelled transactions, from their grain."""
    j = per.select("account_id", *keys, "n").join(labels.select("account_id", "is_mule", "fold"), "account_id")
    return j.groupBy(*keys, "fold").agg(F.sum(F.col("is_mule") * F.col("n")).alias("s"), F.sum("n").alias("n"))


def encoded(txns: DataFrame, labels: DataFrame, keys: list[str], alpha: float, k: int = 5) -> DataFrame:
    """The grain of txns with te. labels: account_id, is_mule, fold (below k). A null or unseen key has the prior. What is joined has a row
    a key, with its totals and those of each fold."""
    per = grain(txns, keys)
    known = per.dropna(subset=keys).join(labels.select("account_id", "is_mule", "fold"), "account_id")
    s, n, none = F.col("is_mule") * F.col("n"), F.col("n"), F.lit(0)
    of = lambda x: F.array(*(F.coalesce(F.sum(F.when(F.col("fold") == f, x)), none) for f in range(k)))
    total = known.groupBy(*keys).agg(F.sum(s).alias("s_all"), F.sum(n).alias("n_all"), of(s).alias("_s"), of(n).alias("_n"))
    p = F.broadcast(prior_of(labels))  # one row
    t = per.join(labels.select("account_id", "fold"), "account_id", "left").join(total, keys, "left").crossJoin(p)
    own = lambda c: F.coalesce(F.get(c, F.col("fold")), none)
    te = (F.col("s_all") - own("_s") + alpha * F.col("prior")) / (F.col("n_all") - own("_n") + alpha)
    return t.select("account_id", *keys, "n", "amount", F.coalesce(te, F.col("prior")).alias("te"), "prior")


def table(txns: DataFrame, labels: DataFrame, keys: list[str], alpha: float, k: int = 5) -> DataFrame:
    """keys, fold, te for every key and fold, and the full encoding as fold -1."""
    stats = key_stats(grain(txns, keys), labels, keys)
    total = stats.groupBy(*keys).agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    every = total.withColumn("fold", F.explode(F.sequence(F.lit(-1), F.lit(k - 1))))
    same = [every[c].eqNullSafe(stats[c]) for c in keys]
    j = every.join(stats, [*same, every["fold"] == stats["fold"]], "left").crossJoin(F.broadcast(prior_of(labels)))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        *(every[c] for c in keys), every["fold"],
        ((F.col("s_all") - z("s") + alpha * F.col("prior")) / (F.col("n_all") - z("n") + alpha)).alias("te"),
    )


def _moments(t: DataFrame) -> tuple[Column, Column, Column]:
    """Of the encodings of transactions: their number, mean, and sum of squares around it. Taken around the prior, so that little is lost."""
    d, n = F.col("te") - F.col("prior"), F.sum("n")
    off = F.sum(F.col("n") * d)
    return n, F.max("prior") + off / n, F.greatest(F.lit(0.0), F.sum(F.col("n") * d * d) - off * off / n)


def account_stats(t: DataFrame, accounts: DataFrame, labels: DataFrame, tag: str, risky: float = 0.20) -> DataFrame:
    """te_<tag>_mean, _std (of the population), _max, _amt_weighted (by signed amounts), _high_risk_ratio, from ``encoded``; the prior
    for accounts without transactions."""
    n, mean, squares = _moments(t)
    a = t.groupBy("account_id").agg(
        mean.alias("mean"), F.sqrt(squares / n).alias("std"), F.max("te").alias("max"),
        (F.sum(F.col("amount") * F.col("te")) / (F.sum("amount") + EPS)).alias("amt_weighted"),
        (F.coalesce(F.sum(F.when(F.col("te") >= risky, F.col("n"))), F.lit(0)) / n).alias("high_risk_ratio"),
    )
    return _with_prior(a, accounts, labels, tag)


def family(txns: DataFrame, accounts: DataFrame, labels: DataFrame, keys: list[str], alpha: float, tag: str) -> DataFrame:
    """te_<tag>_mean, _max, _std (of the sample), _amtw for any keys; whatever is null, as the std of one transaction, becomes the prior."""
    t = encoded(txns, labels, keys, alpha)
    n, mean, squares = _moments(t)
    a = t.groupBy("account_id").agg(
        mean.alias("mean"), F.max("te").alias("max"), F.when(n > 1, F.sqrt(squares / F.greatest(n - 1, F.lit(1)))).alias("std"),
        ratio(F.sum(F.col("amount") * F.col("te")), F.sum("amount")).alias("amtw"),
    )
    return _with_prior(a, accounts, labels, tag)


def _with_prior(a: DataFrame, accounts: DataFrame, labels: DataFrame, tag: str) -> DataFrame:
    j = accounts.select("account_id").join(a, "account_id", "left").crossJoin(F.broadcast(prior_of(labels)))
    return j.select("account_id", *(F.coalesce(F.col(c), F.col("prior")).alias(f"te_{tag}_{c}") for c in a.columns if c != "account_id"))
