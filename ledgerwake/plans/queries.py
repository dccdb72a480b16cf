"""The registered queries: operators on the driver's tables. Doubles are quantised, counts are bigint."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean_number, quantised
from ..operators import aggregates as A
from ..operators import batches as B
from ..operators import decisions as D
from ..operators import series as S
from ..operators import static as M
from ..operators import target_encoding as E
from ..sources import Tables, read_parquet, write_csv, write_parquet
from ..staging import shared_path, written, written_all
from . import end_to_end as P

#: Parameters that the test tables' dates and values call for.
AS_OF, CUT_3M, CUT_6M, MONTHS, RISKY = "2025-06-30", "2001-08-01", "2001-05-01", 83, 0.08
CENTRE = "ACCT_000007"
#: The AUC that scores must be above.
GATE = 0.45

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def shown(df: DataFrame) -> DataFrame:
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        out.append((quantised(x) if t in ("double", "float") else x.cast("bigint") if t in ("int", "tinyint", "smallint", "boolean") else x).alias(c))
    return df.select(*out)


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[f.__name__] = lambda spark, path: shown(f(Tables(spark, path)))
    return f


def all_accounts(t: Tables) -> DataFrame:
    return t.labels().select("account_id").unionByName(t.test_accounts()).distinct()


def joined_b(t: Tables) -> DataFrame:
    return A.with_additional(t.txn_b(), t.add_b())


@query
def txn_basic(t: Tables) -> DataFrame:
    return A.txn_basic(A.of_accounts(t.txn_a(), all_accounts(t)))


@query
def txn_basic_batched(t: Tables) -> DataFrame:
    return B.merged(A.txn_basic, t.txn_a().withColumn("batch", F.year("ts") % 4), "batch", [0, 1, 2, 3], B.BASIC)


@query
def iat_burst_batched(t: Tables) -> DataFrame:
    return B.merged(S.gaps, t.txn_b().withColumn("batch", F.dayofmonth("ts") % 2), "batch", [0, 1], B.GAPS)


@query
def txn_balance_batched(t: Tables) -> DataFrame:
    j = A.with_additional(t.txn_b().withColumn("batch", F.dayofmonth("ts") % 2), t.add_b(), ["batch"])
    return B.merged(A.balances, j, "batch", [0, 1], B.BALANCES)


@query
def txn_ip_batched(t: Tables) -> DataFrame:
    j = A.with_additional(t.txn_b().withColumn("batch", F.dayofmonth("ts") % 2), t.add_b(), ["batch"])
    return B.merged(A.ip_addresses, j, "batch", [0, 1], B.IPS)


def full_master(t: Tables) -> DataFrame:
    extra = t.accounts().select("account_id", F.col("segment").alias("account_segment"))
    return M.account_master(t.accounts(), t.linkage(), t.customers(), t.branches(), all_accounts(t), t.products(), t.demographics(), extra, AS_OF)


@query
def account_master(t: Tables) -> DataFrame:
    return full_master(t).select(
        "account_id", "customer_id", "account_count_per_customer", "branch_code", "branch_name", "branch_region", "n_products",
        "income_band", "account_segment", "account_age_days", "customer_age_days", "was_frozen",
    )


@query
def txn_additional_balance(t: Tables) -> DataFrame:
    return A.balances(joined_b(t))


@query
def txn_additional_ip(t: Tables) -> DataFrame:
    return A.ip_addresses(joined_b(t))


@query
def txn_additional_geo(t: Tables) -> DataFrame:
    return A.places(joined_b(t))


@query
def txn_additional(t: Tables) -> DataFrame:
    return A.additional_features(joined_b(t))


def _oof(t: Tables, keys: list[str], tag: str) -> DataFrame:
    labels, accounts = E.folds(t.labels()), all_accounts(t)
    return E.account_stats(E.encoded(t.txn_a(), labels, keys, E.ALPHA[tag]), accounts, labels, tag, RISKY)


@query
def oof_te_counterparty(t: Tables) -> DataFrame:
    return _oof(t, ["counterparty_id"], "counterparty")


@query
def oof_te_mcc(t: Tables) -> DataFrame:
    return _oof(t, ["mcc_code"], "mcc")


@query
def oof_te_channel(t: Tables) -> DataFrame:
    return _oof(t, ["channel"], "channel")


@query
def oof_te_pair(t: Tables) -> DataFrame:
    return _oof(t, ["counterparty_id", "channel"], "pair")


def _family(t: Tables, keys: list[str], tag: str) -> DataFrame:
    return E.family(t.txn_a(), all_accounts(t), E.folds(t.labels()), keys, E.ALPHA[tag], tag)


@query
def te_family_txntype(t: Tables) -> DataFrame:
    return _family(t, ["txn_type"], "txntype")


@query
def te_family_mcc_txn(t: Tables) -> DataFrame:
    return _family(t, ["mcc_code", "txn_type"], "mcc_txn")


@query
def te_family_cp_txn(t: Tables) -> DataFrame:
    return _family(t, ["counterparty_id", "txn_type"], "cp_txn")


@query
def te_full_table(t: Tables) -> DataFrame:
    return E.table(t.txn_a(), E.folds(t.labels()), ["counterparty_id"], E.ALPHA["counterparty"])


@query
def fold_assignment(t: Tables) -> DataFrame:
    return E.folds(t.labels())


@query
def cp_totals(t: Tables) -> DataFrame:
    return A.counterparties(t.txn_a())


@query
def cp_frequency(t: Tables) -> DataFrame:
    return A.cp_frequency(t.txn_a(), all_accounts(t))


@query
def mule_ip_exposure(t: Tables) -> DataFrame:
    return A.mule_ips(joined_b(t), t.labels(), all_accounts(t))


@query
def txn_subtypes(t: Tables) -> DataFrame:
    return A.sub_types(joined_b(t), all_accounts(t))


@query
def neighbor_risk(t: Tables) -> DataFrame:
    return A.neighbor_risk(t.txn_a(), t.scores().select("account_id", F.col("s1").alias("score")))


@query
def recency(t: Tables) -> DataFrame:
    return A.recency(t.txn_a(), all_accounts(t), CUT_3M, CUT_6M)


@query
def daily_volume(t: Tables) -> DataFrame:
    return S.daily(t.txn_a())


@query
def rolling_7d_zscore(t: Tables) -> DataFrame:
    return S.rolling_zscore(S.daily(t.txn_b()))


@query
def cp_entropy(t: Tables) -> DataFrame:
    return S.cp_entropy(t.txn_a())


@query
def days_to_first_txn(t: Tables) -> DataFrame:
    return S.days_to_first(t.txn_a(), t.accounts())


@query
def turnover_ratio(t: Tables) -> DataFrame:
    return S.turnover(A.txn_basic(t.txn_b()), A.balances(joined_b(t)))


@query
def peak_day_conc(t: Tables) -> DataFrame:
    return S.peak_day(S.daily(t.txn_a()))


@query
def pass_through_v1(t: Tables) -> DataFrame:
    return S.pass_through(S.daily(t.txn_b()), 1)


@query
def pass_through_v2(t: Tables) -> DataFrame:
    return S.pass_through(S.daily(t.txn_b()), 2)


@query
def iat_burst(t: Tables) -> DataFrame:
    return S.gaps(t.txn_b())


@query
def temporal_patterns(t: Tables) -> DataFrame:
    return A.temporal_patterns(t.txn_b().withColumn("amount", F.col("scaled_amount")))


@query
def round_amounts(t: Tables) -> DataFrame:
    return A.temporal_patterns(t.txn_a().withColumn("amount", F.col("round_amount")))


@query
def monthly_behavior(t: Tables) -> DataFrame:
    return S.monthly(t.txn_a(), MONTHS)


@query
def passthrough_hours(t: Tables) -> DataFrame:
    return S.passthrough_hours(t.txn_b())


@query
def cp_concentration(t: Tables) -> DataFrame:
    return S.concentration(t.txn_a())


@query
def activity_span(t: Tables) -> DataFrame:
    return S.activity_span(t.txn_b())


@query
def graph_degree(t: Tables) -> DataFrame:
    return A.graph_degree(t.txn_a())


@query
def graph_label_exposure(t: Tables) -> DataFrame:
    return A.graph_labels(t.txn_a(), t.labels())


@query
def ego_network_top10(t: Tables) -> DataFrame:
    return A.ego_network(t.txn_a(), CENTRE, t.scores().select("account_id", F.col("s1").alias("score")))


@query
def yn_encode(t: Tables) -> DataFrame:
    a = t.accounts().select("account_id", "kyc_flag", "segment")
    return M.yes_no_encoded(a, M.yes_no_columns(a))


@query
def categorical_codes(t: Tables) -> DataFrame:
    return M.coded(t.accounts().select("account_id", "segment"), "segment").select("account_id", "segment")


class Staged(Tables):
    """The tables with transactions written once, for a plan in which many features read them."""

    @cached_property
    def _a(self) -> DataFrame:
        return written(super().txn_a(), "transactions-a")

    @cached_property
    def _b(self) -> DataFrame:
        return written(super().txn_b(), "transactions-b")

    def txn_a(self) -> DataFrame:
        return self._a

    def txn_b(self) -> DataFrame:
        return self._b


#: The matrix's feature tables: those of its first version, those that the second adds, and those of the third.
V1 = [
    txn_basic, iat_burst, temporal_patterns, graph_degree, graph_label_exposure, txn_additional, monthly_behavior,
    passthrough_hours, cp_concentration, activity_span,
    oof_te_counterparty, oof_te_mcc, oof_te_channel, oof_te_pair, neighbor_risk,
]
V2 = [
    rolling_7d_zscore, cp_entropy, days_to_first_txn, turnover_ratio, peak_day_conc, pass_through_v2, cp_frequency,
    mule_ip_exposure, txn_subtypes, te_family_txntype, te_family_mcc_txn, te_family_cp_txn,
]
V3 = [recency]


def matrix(t: Tables, features: list[Callable[[Tables], DataFrame]]) -> DataFrame:
    """A table a feature family, then one join of them all."""
    own = Staged(t.spark, t.path)
    tables = written_all({f.__name__: f(own) for f in features})
    return M.feature_matrix(written(full_master(t), "master"), tables)


@query
def feature_matrix(t: Tables) -> DataFrame:
    return M.interactions(matrix(t, V1 + V2))


@query
def feature_matrix_v3(t: Tables) -> DataFrame:
    return matrix(t, V1 + V3)


@query
def train_split(t: Tables) -> DataFrame:
    train, test = M.split(t.accounts().select("account_id", "branch_code"), t.labels(), t.test_accounts())
    return train.unionByName(test.withColumn("is_mule", F.lit(-1)))


@query
def ghost_weights(t: Tables) -> DataFrame:
    j = S.pass_through(S.daily(t.txn_b()), 2).join(S.gaps(t.txn_b()), "account_id", "left")
    return j.select("account_id", D.ghost_weight(0.35, 20).alias("defensive"), D.ghost_weight(0.18, 20, 0.7).alias("robust"))


@query
def class_weight(t: Tables) -> DataFrame:
    return D.class_weight(t.labels())


@query
def prob_blend(t: Tables) -> DataFrame:
    return D.prob_blend(t.scores(), ["s1", "s2"]).select("account_id", "blend")


@query
def rank_blend(t: Tables) -> DataFrame:
    return D.rank_blend(t.scores(), ["s1", "s2"]).select("account_id", "rank_s1", "rank_s2", "rank_blend")


def scored(t: Tables) -> DataFrame:
    return t.scores().select("account_id", F.col("s1").alias("score"))


@query
def auc_by_rank(t: Tables) -> DataFrame:
    return D.auc(scored(t).join(t.labels(), "account_id"))


@query
def best_blend(t: Tables) -> DataFrame:
    return D.best_blend(t.scores().join(t.labels(), "account_id"), ["s1", "s2"])


@query
def safety_gate(t: Tables) -> DataFrame:
    return D.gate(scored(t).join(t.labels(), "account_id"), GATE)


@query
def f1_threshold_grid(t: Tables) -> DataFrame:
    return D.f1_threshold(scored(t).join(t.labels(), "account_id"))


@query
def prior_threshold(t: Tables) -> DataFrame:
    return D.prior_threshold(scored(t))


@query
def flagged_accounts(t: Tables) -> DataFrame:
    return D.flagged(scored(t))


@query
def pseudo_labels(t: Tables) -> DataFrame:
    return D.pseudo_labels(D.rank_blend(t.scores(), ["s1", "s2"]).select("account_id", F.col("rank_blend").alias("score")))


@query
def rank_displacement(t: Tables) -> DataFrame:
    return D.displacement(D.rank_blend(t.scores(), ["s1", "s2"]), "s1", "rank_blend")


@query
def lifecycle_window(t: Tables) -> DataFrame:
    return S.lifecycle(t.txn_b(), D.flagged(scored(t), 0.3))


@query
def peak_window(t: Tables) -> DataFrame:
    return S.peak_window(S.daily(t.txn_b()))


@query
def window_size_stats(t: Tables) -> DataFrame:
    return S.window_sizes(S.peak_window(S.daily(t.txn_b())))


@query
def submission(t: Tables) -> DataFrame:
    return D.submission(scored(t), S.lifecycle(t.txn_b(), D.flagged(scored(t), 0.3)))


@query
def value_counts(t: Tables) -> DataFrame:
    return A.value_counts(t.txn_a(), "channel")


@query
def null_counts(t: Tables) -> DataFrame:
    return A.null_counts(t.txn_b().join(t.add_b(), "transaction_id"))


@query
def row_count_check(t: Tables) -> DataFrame:
    return D.row_counts(submission(t), all_accounts(t))


@query
def sampled_accounts(t: Tables) -> DataFrame:
    return D.sampled(t.accounts().select("account_id"), "account_id", 100)


@query
def first_transactions(t: Tables) -> DataFrame:
    return t.txn_b().select("transaction_id", "amount").orderBy("transaction_id").limit(50)


@query
def clean_numbers(t: Tables) -> DataFrame:
    s, none = t.scores(), F.lit(float("nan"))
    odd = F.when(F.col("s1") > 0.7, F.lit(float("inf"))).when(F.col("s1") > 0.5, F.lit(float("-inf"))).when(F.col("s1") > 0.3, none).otherwise(F.col("s1"))
    return s.select("account_id", clean_number(odd).alias("zeroed"), clean_number(odd, 99.5).alias("bounded"))


@query
def log_volume(t: Tables) -> DataFrame:
    a = A.txn_basic(t.txn_a())
    return a.select("account_id", F.log1p("total_volume").alias("log_volume"), F.log1p("total_txns").alias("log_txns"))


@query
def parquet_round_trip(t: Tables) -> DataFrame:
    """Written by type, and read again by a glob over its folders, three columns of it."""
    path = shared_path(t.spark, "sink")
    write_parquet(t.txn_b().select("transaction_id", "account_id", "amount", "channel"), path, ["channel"])
    return read_parquet(t.spark, f"{path}/channel=*/*.parquet", columns=["transaction_id", "account_id", "amount"])


@query
def csv_round_trip(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "sink")
    write_csv(submission(t), path)
    found = t.spark.read.option("header", True).csv(path)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("suspicious_start", "suspicious_end")]
    return found.select("account_id", F.col("is_mule").cast("double"), *text)


@query
def limited_scan(t: Tables) -> DataFrame:
    return read_parquet(
        t.spark, f"{t.path}/events.parquet", columns=["event_id"], rows=25, with_part=True,
    ).agg(F.count("part").alias("n"), F.countDistinct("event_id").alias("events"))


@query
def stored_artefacts(t: Tables) -> DataFrame:
    """Scores, importances, threshold and parameters of a run, stored and read again: the rows of each, and the threshold."""
    path, spark = shared_path(t.spark, "artefacts"), t.spark
    P.artefacts(
        scored(t), spark.createDataFrame([("total_volume", 0.5)], "feature string, importance double"), path,
        {"trees": str(TREES), "depth": str(DEPTH)},
    )
    read = lambda name: read_parquet(spark, f"{path}/{name}")
    rows = [read(n).agg(F.lit(n).alias("artefact"), F.count(F.lit(1)).alias("rows"), F.lit(0.0).alias("value")) for n in ("scores", "importances", "parameters")]
    return reduce(
        DataFrame.unionByName,
        [*rows, read("threshold").select(F.lit("threshold").alias("artefact"), F.lit(1).cast("bigint").alias("rows"), F.col("threshold").alias("value"))],
    )


#: The size of the models that queries train.
TREES, DEPTH = 8, 4


@cache
def _trained(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict], list[str]]:
    """Out-of-fold scores, models and columns: trained once a session for each folder."""
    t = Tables(spark, path)
    m = M.interactions(matrix(t, V1 + V2))
    columns = M.numeric_columns(m)
    train, _ = M.split(m, E.folds(t.labels()), t.test_accounts())
    oof, models = D.out_of_fold(train.withColumn("weight", D.ghost_weight()), columns, trees=TREES, depth=DEPTH)
    return oof, models, columns


@query
def gbt_oof_scores(t: Tables) -> DataFrame:
    return _trained(t.spark, t.path)[0].select("account_id", "fold", "is_mule", F.col("score_gbt").alias("score"))


@query
def ensemble_oof_scores(t: Tables) -> DataFrame:
    return _trained(t.spark, t.path)[0]


@query
def feature_importance(t: Tables) -> DataFrame:
    _, models, columns = _trained(t.spark, t.path)
    return D.importances(models, columns, t.spark)


@query
def importance_pruning(t: Tables) -> DataFrame:
    _, models, columns = _trained(t.spark, t.path)
    every = D.importances(models, columns, t.spark, None)
    return every.where(F.col("feature").isin(M.important(columns, every)))


@query
def pseudo_label_scores(t: Tables) -> DataFrame:
    return P.retrained(matrix(t, [*V1, pass_through_v2]), t.labels(), t.test_accounts(), 3, TREES, DEPTH)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
