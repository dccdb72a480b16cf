import datetime as dt

import pytest

from ledgerwake import sources
from ledgerwake.operators import series as S
from ledgerwake.plans import end_to_end
from ledgerwake.streaming import daily_volume


def test_parts_contract_and_bad_timestamps(spark, tmp_path):
    rows = [("1", "a", "b", 1.5, "C", "x", "7", "2024-01-01 10:00:00"), ("2", "a", None, -2.0, "D", "x", "7", "no date")]
    cols = list(sources.SCHEMAS["transactions"])
    spark.createDataFrame(rows, cols).repartition(2).write.parquet(str(tmp_path / "t"))
    t = sources.read_transactions(spark, str(tmp_path / "t"))
    assert {r["transaction_id"]: r["ts"] for r in t.collect()} == {"1": dt.datetime(2024, 1, 1, 10), "2": None}
    assert sources.read_parquet(spark, str(tmp_path / "t" / "*.parquet"), columns=["amount"], rows=1).count() == 1
    assert sources.read_parquet(spark, str(tmp_path / "t"), with_part=True).select("part").distinct().count() == 2
    with pytest.raises(ValueError, match="lacks"):
        sources.read_parquet(spark, str(tmp_path / "t"), "scores")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "")], "account_id string, is_mule double, suspicious_start string")
    sources.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()
    sources.write_csv(df, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text == "account_id,is_mule,suspicious_start\na,1.0,\n"


def test_stream_of_days_equals_batch(spark, small, tmp_path):
    t = sources.Tables(spark, small).txn_b()
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = daily_volume(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["account_id"], r["day"]): (r["daily_txns"], round(r["daily_vol"], 6)) for r in spark.table("days").collect()}
    assert got == {(r["account_id"], r["day"]): (r["daily_txns"], round(r["daily_vol"], 6)) for r in S.daily(t).collect()}


def test_from_tables_to_submission(spark, small):
    t = sources.Tables(spark, small)
    scores = t.scores().selectExpr("account_id", "s1 as score")
    out = end_to_end.submission(t.txn_a(), scores, peak=True, prior=0.1).collect()
    assert len(out) == scores.count() and any(r["suspicious_start"] for r in out)
    tables = end_to_end.feature_tables(t.txn_a(), t.labels().unionByName(t.labels().limit(0)).select("account_id"), t.labels())
    assert all("account_id" in x.columns for x in tables)
