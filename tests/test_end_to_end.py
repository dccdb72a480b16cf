from pyspark.sql import functions as F

from ledgerwake.operators import decisions as D
from ledgerwake.operators import static as M
from ledgerwake.plans import end_to_end as P
from ledgerwake.plans import queries as Q
from ledgerwake.sources import Tables
from ledgerwake.staging import written


def test_from_tables_to_a_submission(spark, small, tmp_path):
    t = Tables(spark, small)
    accounts, scores = Q.all_accounts(t), t.scores().select("account_id", F.col("s1").alias("score"))
    tables = P.feature_tables(t.txn_b(), accounts, t.labels(), Q.joined_b(t), scores, ("2024-01-24", "2024-01-17"), t.accounts())
    assert len(tables) == 27 and all(x.count() == x.select("account_id").distinct().count() for x in tables)
    matrix = written(M.interactions(M.feature_matrix(t.accounts(), tables)), "matrix")
    assert matrix.count() == accounts.count() and len(matrix.columns) > 120
    oof, new = P.train_and_score(
        matrix.select("account_id", "kyc_flag", "total_volume", "in_degree", "pass_through_ratio", "burst_count_5min"),
        t.labels(), t.test_accounts(), 2, 2, 2,
    )
    oof, new = written(oof, "oof"), written(new, "new")
    assert oof.count() == t.labels().count() and new.count() == t.test_accounts().count()
    every = oof.select("account_id", "score").unionByName(new)
    assert every.where("score < 0 or score > 1 or score is null").count() == 0
    D.same_length(P.submission(t.txn_b(), every), accounts)
    P.artefacts(every, spark.createDataFrame([("x", 0.5)], "feature string, importance double"), str(tmp_path), {"trees": "2"})
    assert spark.read.parquet(f"{tmp_path}/scores").count() == accounts.count()
    assert spark.read.parquet(f"{tmp_path}/threshold").columns == ["threshold"] and spark.read.parquet(f"{tmp_path}/parameters").count() == 1
