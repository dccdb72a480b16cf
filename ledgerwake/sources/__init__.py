"""Input tables: their schemas, readers for real files, sinks, and the test tables in the canonical form.

Canonical transactions: transaction_id, account_id, counterparty_id, amount, txn_type, channel, mcc_code, ts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _d = T.StringType(), T.DoubleType()
SCHEMAS = {
    "transactions": {"transaction_id": _s, "account_id": _s, "counterparty_id": _s, "amount": _d, "txn_type": _s, "channel": _s, "mcc_code": _s, "transaction_timestamp": _s},
    "transactions_additional": {"transaction_id": _s, "balance_after_transaction": _d, "ip_address": _s, "latitude": _d, "longitude": _d, "transaction_sub_type": _s, "part_transaction_type": _s},
    "accounts": {"account_id": _s, "branch_code": _s, "account_opening_date": _s, "freeze_date": _s},
    "customer_account_linkage": {"customer_id": _s, "account_id": _s},
    "train_labels": {"account_id": _s, "is_mule": T.IntegerType()},
    "test_accounts": {"account_id": _s},
    "scores": {"account_id": _s, "score": _d},
}


def checked(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns of the contract cast to their types and others as they are; a missing column is an error."""
    want = SCHEMAS[table]
    missing = [c for c in want if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns {missing}")
    return df.withColumns({c: F.col(c).cast(t) for c, t in want.items()})


def read_parquet(
    spark: SparkSession, path: str, table: str | None = None, columns: list[str] | None = None, rows: int | None = None,
    with_part: bool = False,
) -> DataFrame:
    """A file, a folder of part files, or a glob. with_part adds the part file's name, for whoever needs batches."""
    df = spark.read.parquet(path)
    if with_part:
        df = df.withColumn("part", F.col("_metadata.file_name"))
    if table:
        df = checked(df, table)
    if columns:
        df = df.select(*columns, *(["part"] if with_part else []))
    return df if rows is None else df.limit(rows)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Real transactions in the canonical form; a timestamp that can't be parsed is null."""
    df = read_parquet(spark, path, "transactions")
    return df.withColumn("ts", F.try_to_timestamp("transaction_timestamp").cast("timestamp_ntz")).drop("transaction_timestamp")


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """With a header. One file only for results of a bounded size, as a submission is."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def account(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("ACCT_"), F.lpad(c.cast("string"), 6, "0"))


@dataclass
class Tables:
    """The driver's tables in the canonical form."""

    spark: SparkSession
    path: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def txn_a(self) -> DataFrame:
        """Monetary transactions over years: order lines."""
        li, o, p = self.raw("lineitem"), self.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), self.raw("part").select("p_partkey", "p_brand")
        j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
        cp = F.when(F.col("l_linenumber") == 7, F.lit(None)).when(F.col("l_partkey") % 2 == 0, account("l_partkey")).otherwise(F.concat(F.lit("EXT_"), F.col("l_suppkey").cast("string")))
        price = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
        return j.select(
            account("o_custkey").alias("account_id"), cp.alias("counterparty_id"), price.alias("amount"),
            F.when(F.col("l_linestatus") == "O", "C").otherwise("D").alias("txn_type"), F.col("o_orderpriority").alias("channel"),
            F.col("p_brand").alias("mcc_code"), F.col("l_shipdate").alias("ts"),
            (F.col("l_quantity") * 100).alias("round_amount"),
        )

    def txn_b(self) -> DataFrame:
        """Transactions within a month, to the microsecond: events. scaled_amount reaches the bands of round and structured amounts."""
        k = F.get_json_object("props", "$.k").cast("int")
        sign = F.when(F.col("event_type") == "error", -1.0).otherwise(1.0)
        kind = F.when(F.col("event_type").isin("purchase", "signup"), "C").when(F.col("event_type").isin("view", "click"), "D")
        return self.raw("events").select(
            F.col("event_id").alias("transaction_id"), account("user_id").alias("account_id"),
            F.when(k != 0, account(k)).alias("counterparty_id"), (F.col("value") * sign).alias("amount"),
            kind.alias("txn_type"), F.col("event_type").alias("channel"), (k % 10).alias("mcc_code"), "ts",
            (F.floor("value") * 100 * sign).alias("scaled_amount"),
        )

    def add_b(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.raw("events").select(
            F.col("event_id").alias("transaction_id"),
            F.when(k % 7 != 0, F.col("value") * 10 - 200).alias("balance_after_transaction"),
            F.when(k % 11 != 0, F.concat(F.lit("ip_"), k.cast("string"))).alias("ip_address"),
            F.when(k % 10 != 0, (k - 50).cast("double")).alias("latitude"), F.when(k % 10 != 0, (2 * k - 100).cast("double")).alias("longitude"),
            F.when(F.col("event_type") == "error", "special").otherwise("normal").alias("transaction_sub_type"),
            F.col("event_type").alias("part_transaction_type"),
        )

    def labels(self) -> DataFrame:
        c = self.raw("customer").where(F.col("c_custkey") % 5 >= 2)
        return c.select(account("c_custkey").alias("account_id"), (F.col("c_acctbal") < 0).cast("int").alias("is_mule"))

    def test_accounts(self) -> DataFrame:
        return self.raw("customer").where(F.col("c_custkey") % 5 < 2).select(account("c_custkey").alias("account_id"))

    def accounts(self) -> DataFrame:
        first = self.raw("orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("account_opening_date"))
        c = self.raw("customer")
        return c.join(first, c["c_custkey"] == first["o_custkey"], "left").select(
            account("c_custkey").alias("account_id"), F.col("c_nationkey").alias("branch_code"), "account_opening_date",
            F.when(F.col("c_acctbal") < -500, F.lit("2001-01-01")).alias("freeze_date"),
            F.when(F.col("c_acctbal") > 5000, "Y").otherwise("N").alias("kyc_flag"), F.col("c_mktsegment").alias("segment"),
        )

    def linkage(self) -> DataFrame:
        return self.raw("customer").select(F.floor(F.col("c_custkey") / 2).alias("customer_id"), account("c_custkey").alias("account_id"))

    def customers(self) -> DataFrame:
        c = self.raw("customer").select(F.floor(F.col("c_custkey") / 2).alias("customer_id")).distinct()
        return c.withColumn(
            "date_of_birth",
            F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (F.col("customer_id") % 15000).cast("int")), "yyyy-MM-dd"),
        )

    def products(self) -> DataFrame:
        return self.customers().select("customer_id", (F.col("customer_id") % 3).cast("int").alias("n_products"))

    def demographics(self) -> DataFrame:
        return self.customers().select(
            "customer_id", F.concat(F.lit("name "), F.col("customer_id").cast("string")).alias("name"),
            (F.col("customer_id") % 7).cast("int").alias("income_band"),
        )

    def branches(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
            F.col("n_nationkey").alias("branch_code"), F.col("n_name").alias("branch_name"),
            F.col("r_name").alias("branch_region"),
        )

    def scores(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            account("c_custkey").alias("account_id"), ((k * 37 % 101) / 100.0).alias("s1"), ((k * 53 % 97) / 96.0).alias("s2"),
        )
