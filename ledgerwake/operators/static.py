"""Account master data and the encoded feature matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written, written_all


def account_master(
    accounts: DataFrame, linkage: DataFrame, customers: DataFrame, branches: DataFrame, targets: DataFrame,
    products: DataFrame | None = None, demographics: DataFrame | None = None, additional: DataFrame | None = None,
    as_of: str = "2025-06-30",
) -> DataFrame:
    """A row for each target account, with its customer's, product's and branch's columns, ages in days, and whether it was ever frozen."""
    per = F.count("account_id").over(Window.partitionBy("customer_id"))
    m = accounts.join(linkage.withColumn("account_count_per_customer", per), "account_id", "left").join(customers, "customer_id", "left")
    for more in (products, demographics):
        if more is not None:
            m = m.join(more.drop("name", "phone_number", "address"), "customer_id", "left")
    if additional is not None:
        m = m.join(additional, "account_id", "left")
    m = m.join(branches, "branch_code", "left").join(targets.select("account_id").distinct(), "account_id", "left_semi")
    day = lambda c: F.datediff(F.lit(as_of).cast("date"), F.to_date(c))
    return m.withColumns({"account_age_days": day("account_opening_date"), "customer_age_days": day("date_of_birth"), "was_frozen": F.col("freeze_date").isNotNull().cast("int")})


def string_columns(df: DataFrame, keep: tuple[str, ...]) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in keep]


def yes_no_columns(df: DataFrame, keep: tuple[str, ...] = ("account_id",)) -> list[str]:
    """String columns whose values are Y, N or null only: one aggregate, one row."""
    cols = string_columns(df, keep)
    if not cols:
        return []
    r = df.agg(*(F.coalesce(F.bool_and(F.col(c).isNull() | F.col(c).isin("Y", "N")), F.lit(True)).alias(c) for c in cols)).first()
    return [c for c in cols if r[c]]


def yes_no_encoded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: (F.col(c) == "Y").cast("int") for c in columns}) if columns else df


def coded(df: DataFrame, column: str) -> DataFrame:
    """Strings become codes from 0 on in the order of the values; null stays. The values' table is joined, so no window runs over all rows."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = values.withColumn("_code", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(codes, column, "left").drop(column).withColumnRenamed("_code", column)


#: The names of columns that are ids, addresses and dates, and no features.
DROPPED = (
    "customer_id", "branch_code", "branch_pin", "customer_pin", "permanent_pin", "branch_address", "branch_pin_code",
    "account_opening_date", "freeze_date", "unfreeze_date",
    "last_mobile_update_date", "last_kyc_date", "date_of_birth", "relationship_start_date", "address_last_update_date", "passbook_last_update_date",
)
#: The names of label columns that tell the label itself.
LEAKS = ("mule_flag_date", "alert_reason", "flagged_by_branch")


#: Tables that one plan joins by account. Each is sorted in the same task, a sort holds a page of memory, and the pages that a task can count on are 8.
JOINED = 6


def with_features(m: DataFrame, features: list[DataFrame]) -> DataFrame:
    """m with the columns of all feature tables, joined on account_id; of columns with one name the first stays.

    More than JOINED tables are first joined in groups, a written table each, and what all of them make is written too.
    """
    seen, own = set(m.columns), []
    for f in features:
        own.append(f.drop(*(c for c in f.columns if c in seen and c != "account_id")))
        seen |= set(f.columns)
    left = lambda a, b: a.join(b, "account_id", "left")
    grouped = len(own) > JOINED
    while len(own) > JOINED:
        ids = m.select("account_id").distinct()
        own = written_all({f"joined-{i}": reduce(left, own[i : i + JOINED], ids) for i in range(0, len(own), JOINED)})
    m = reduce(left, own, m)
    return written(m, "joined") if grouped else m


def feature_matrix(master: DataFrame, features: list[DataFrame], encode: bool = True) -> DataFrame:
    """Feature tables joined to the master on account_id; ids, dates and leaks dropped; strings as numbers."""
    m = with_features(master, features).drop(*DROPPED, *LEAKS)
    if encode:
        m = yes_no_encoded(m, yes_no_columns(m))
        for c in string_columns(m, ("account_id",)):
            m = coded(m, c)
    return m


def split(matrix: DataFrame, labels: DataFrame, test_accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return matrix.join(labels.drop(*LEAKS), "account_id"), matrix.join(test_accounts.select("account_id"), "account_id", "left_semi")


def numeric_columns(
    df: DataFrame, drop_prefixes: tuple[str, ...] = (), keep: tuple[str, ...] = ("account_id", "is_mule", "fold", "weight"),
) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if t in kinds and c not in keep and not c.startswith(tuple(drop_prefixes) or ("\0",))]


def interactions(m: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return m.withColumns({"pt_x_in_degree": F.col("pass_through_ratio") * z("in_degree"), "zscore_x_txns": F.col("rolling_7d_zscore_max") * z("total_txns")})


def important(columns: list[str], importances: DataFrame, least: float = 0.01) -> list[str]:
    """Of these columns those with a mean importance of at least ``least`` in a table feature, importance (a row a column)."""
    kept = {r["feature"] for r in importances.where(F.col("importance") >= least).collect()}
    return [c for c in columns if c in kept]


def augmented(train: DataFrame, test: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Labelled rows and the test rows that got a pseudo-label (account_id, is_mule)."""
    return train.unionByName(test.join(pseudo, "account_id"), allowMissingColumns=True)
