import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwake import functions as X
from ledgerwake.operators import aggregates as A
from ledgerwake.operators import decisions as D
from ledgerwake.operators import series as S
from ledgerwake.operators import static as M
from ledgerwake.operators import target_encoding as E

COLUMNS = "account_id string, counterparty_id string, amount double, txn_type string, channel string, mcc_code string, ts timestamp_ntz"


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def txns(spark):
    rows = [
        ("a", "b", 100.0, "C", "x", "1", at("2024-06-28 22:00:00")),  # a Friday night
        ("a", "b", -100.0, "D", "x", "1", at("2024-06-28 22:00:00")),
        ("a", None, 45000.0, "D", "y", None, at("2024-06-28 22:00:30.900")),
        ("a", "c", 44999.99, "C", None, "2", at("2024-07-03 05:59:59")),
        ("a", "c", 50000.0, "C", None, "2", at("2024-07-03 06:00:00")),
        ("single", None, 7.0, "C", "x", "1", at("2024-07-01 12:00:00")),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def one(df, account="a"):
    return df.where(F.col("account_id") == account).first().asDict()


def test_basic(txns):
    r = one(A.txn_basic(txns))
    assert r["total_txns"] == 5 and r["total_volume"] == pytest.approx(140199.99) and r["reversal_count"] == 1
    assert r["n_channels"] == 3 and r["n_counterparties"] == 3  # null is a value
    assert r["credit_debit_ratio"] == pytest.approx(95099.99 / 140199.99)


def test_time_patterns(txns):
    r = one(A.temporal_patterns(txns))
    assert (r["night_txn_count"], r["weekend_txn_count"], r["structuring_count"], r["round_1k_count"]) == (4, 3, 1, 2)


def test_gaps(txns):
    r = one(S.gaps(txns))
    assert r["iat_min"] == 0 and r["burst_count_60s"] == 3 and r["burst_count_5min"] == 3
    lone = one(S.gaps(txns), "single")
    assert lone["iat_mean"] is None and lone["burst_count_5min"] == 0


def test_gap_is_elapsed_not_crossed_seconds(spark):
    t = spark.createDataFrame([("a", at("2024-01-01 00:00:00.900")), ("a", at("2024-01-01 00:00:01.200"))], "account_id string, ts timestamp_ntz")
    assert one(S.gaps(t))["iat_min"] == 0


def test_entropy_bounds(txns):
    r = one(S.cp_entropy(txns))
    assert r["cp_entropy"] == pytest.approx(-(0.4 * math.log2(0.4) * 2 + 0.2 * math.log2(0.2)))
    assert one(S.cp_entropy(txns), "single")["cp_entropy"] == 0


def test_single_day_account(txns):
    days = S.daily(txns)
    assert one(S.rolling_zscore(days), "single")["rolling_7d_zscore_max"] == 0
    w = one(S.peak_window(days), "single")
    assert (w["suspicious_start"], w["suspicious_end"]) == (dt.date(2024, 7, 1), dt.date(2024, 7, 2))


def test_pass_through_is_a_share(txns):
    for v in (1, 2):
        for r in S.pass_through(S.daily(txns), v).collect():
            assert 0 <= r["pass_through_ratio"] <= 1


def _window_by_loop(vol):
    mean = [sum(vol[max(0, i - 3) : i + 4]) / len(vol[max(0, i - 3) : i + 4]) for i in range(len(vol))]
    s = sorted(vol)
    med = (s[len(s) // 2] + s[(len(s) - 1) // 2]) / 2
    avg = sum(vol) / len(vol)
    base = med if med > 0 else avg if avg > 0 else 1.0
    lo = hi = mean.index(max(mean))
    while lo > 0 and mean[lo - 1] >= base:
        lo -= 1
    while hi < len(mean) - 1 and mean[hi + 1] >= base:
        hi += 1
    return lo, hi + 1


def test_peak_window_like_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    first = dt.date(2024, 1, 1)
    for k in range(25):
        vol = [float(rng.choice([0, 0, 1, 5, 30])) for _ in range(rng.randint(2, 40))]
        vol[0], vol[-1] = vol[0] or 2.0, vol[-1] or 2.0
        want[f"a{k}"] = tuple(first + dt.timedelta(days=x) for x in _window_by_loop(vol))
        rows += [(f"a{k}", first + dt.timedelta(days=i), v) for i, v in enumerate(vol) if v]
    got = S.peak_window(spark.createDataFrame(rows, "account_id string, day date, daily_vol double")).collect()
    assert {r["account_id"]: (r["suspicious_start"], r["suspicious_end"]) for r in got} == want


def test_hours(txns):
    r = one(S.passthrough_hours(txns))
    assert r["passthrough_hours"] == 1 and r["matched_passthrough_hours"] == 0


def test_degrees_of_an_account_with_one_side(spark):
    t = spark.createDataFrame([("a", "b", 1.0, "C", None, None, None), ("a", None, 1.0, "D", None, None, None)], COLUMNS)
    r = one(A.graph_degree(t))
    assert (r["in_degree"], r["out_degree"], r["volume_asymmetry"]) == (1, 0, pytest.approx(1))


def test_label_exposure(spark):
    t = spark.createDataFrame([("a", "m", 10.0), ("m", "a", 5.0), ("x", None, 3.0)], "account_id string, counterparty_id string, amount double")
    labels = spark.createDataFrame([("m", 1), ("a", 0)], "account_id string, is_mule int")
    r = one(A.graph_labels(t, labels))
    assert (r["n_mule_counterparties"], r["vol_sent_mule"], r["vol_recv_mule"], r["txn_sent"]) == (1, 10, 5, 1)
    assert A.graph_labels(t, labels).where("account_id = 'x'").count() == 0


def test_neighbours(spark, txns):
    t = txns.withColumn("counterparty_id", F.concat(F.lit("ACCT_"), "counterparty_id"))
    s = spark.createDataFrame([("ACCT_b", 0.5), ("ACCT_c", 1.0), ("EXT_1", 9.0)], "account_id string, score double")
    r = one(A.neighbor_risk(t, s))
    assert r["neighbor_score_count"] == 4 and r["neighbor_score_mean"] == 0.75 and r["neighbor_score_max"] == 1.0


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([("a", 1, 0), ("b", 0, 1), ("c", 0, 2)], "account_id string, is_mule int, fold int")


def test_encoding_takes_the_own_fold_off(spark, labelled):
    t = spark.createDataFrame(
        [("a", "k", 1.0), ("b", "k", 1.0), ("t", "k", 1.0), ("a", None, 1.0), ("t", "new", 1.0), ("c", "only", 2.0)],
        "account_id string, key string, amount double",
    )
    got = {(r["account_id"], r["key"]): r["te"] for r in E.encoded(t, labelled, ["key"], 2.0).collect()}
    p = 1 / 3
    assert got["a", "k"] == pytest.approx((0 + 2 * p) / (1 + 2))
    assert got["b", "k"] == pytest.approx((1 + 2 * p) / (1 + 2))
    assert got["t", "k"] == pytest.approx((1 + 2 * p) / (2 + 2))
    assert got["a", None] == got["t", "new"] == pytest.approx(p)
    assert got["c", "only"] == pytest.approx(p)  # a key of one fold only


def test_family_fills_a_lone_std_with_the_prior(spark, labelled):
    t = spark.createDataFrame([("a", "k", 1.0)], "account_id string, key string, amount double")
    r = one(E.family(t, labelled, labelled, ["key"], 2.0, "k"))
    assert r["te_k_std"] == pytest.approx(1 / 3)


def test_folds_are_even(spark):
    labels = spark.createDataFrame([(f"a{i:03}", int(i % 7 == 0)) for i in range(100)], "account_id string, is_mule int")
    n = {(r["is_mule"], r["fold"]): r["count"] for r in E.folds(labels).groupBy("is_mule", "fold").count().collect()}
    for k in (0, 1):
        own = [n[k, f] for f in range(5)]
        assert max(own) - min(own) <= 1


def test_exact_under_any_split(spark, txns):
    whole = A.txn_basic(txns).orderBy("account_id").collect()
    for n in (1, 3, 7):
        assert A.txn_basic(txns.repartition(n)).orderBy("account_id").collect() == whole


def test_auc(spark):
    f = lambda rows: D.auc(spark.createDataFrame(rows, "score double, is_mule int")).first()["auc"]
    assert f([(0.5, 1), (0.5, 0), (0.5, 0)]) == 0.5
    assert f([(0.9, 1), (0.1, 0)]) == 1.0
    assert f([(0.3, 1)]) is None


def test_f1_grid_like_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice([i / 50 for i in range(51)]), rng.randint(0, 1)) for _ in range(300)]
    best = (-1.0, 0.0)
    for i in range(1001):
        t = i * 0.001
        tp = sum(y for s, y in rows if s > t)
        n = sum(s > t for s, _ in rows)
        f1 = 2 * tp / (n + sum(y for _, y in rows))
        if f1 > best[0]:
            best = (f1, t)
    r = D.f1_threshold(spark.createDataFrame(rows, "score double, is_mule int")).first()
    assert (r["f1"], r["threshold"]) == (pytest.approx(best[0]), pytest.approx(best[1]))


def test_percentiles_like_sorting(spark):
    rng = random.Random(6)
    values = sorted(round(rng.random() ** 3, 2) for _ in range(777))
    got = D.percentiles(
        spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5), "v",
        {"a": 0.0, "b": 0.1, "c": 0.972, "d": 1.0},
    ).first()
    for name, share in (("a", 0.0), ("b", 0.1), ("c", 0.972), ("d", 1.0)):
        at = share * 776
        lo, hi = values[math.floor(at)], values[math.ceil(at)]
        assert got[name] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))
    assert D.percentiles(spark.createDataFrame([], "v double"), "v", {"a": 0.5}).first()["a"] is None


def test_values_are_kept_to_their_digits(spark):
    values = [365226649956.6612, 1.2345678, -7.0000004, 999999999.123456, 1.5e14, -3e18, 0.0, 2.5e-7]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(X.quantised("v")).collect()]
    assert got == pytest.approx(values, rel=1e-9, abs=5.1e-7)


def test_rank_ties_are_averaged(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", 0.0)], "account_id string, s double")
    assert {r["account_id"]: r["r"] for r in D.rank_share(s, "s", "r").collect()} == {"a": 0.625, "b": 0.625, "c": 1.0, "d": 0.25}


def test_encoders(spark):
    a = spark.createDataFrame([("1", "Y", "q"), ("2", None, "p"), ("3", "N", None)], "account_id string, f string, s string")
    assert M.yes_no_columns(a) == ["f"]
    assert [r["f"] for r in M.yes_no_encoded(a, ["f"]).orderBy("account_id").collect()] == [1, None, 0]
    assert {r["account_id"]: r["s"] for r in M.coded(a, "s").collect()} == {"1": 1, "2": 0, "3": None}


def test_clean_number(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (2.0,)], "x double")
    assert [r[0] for r in df.select(X.clean_number("x", 9.0)).collect()] == [0, 9, -9, 2]
    assert [r[0] for r in df.select(X.clean_number("x")).collect()] == [0, 0, 0, 2]


def test_submission_has_empty_text_without_window(spark):
    s = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "account_id string, score double")
    w = spark.createDataFrame(
        [("a", at("2024-01-01 00:00:00"), at("2024-01-02 00:00:01"))],
        "account_id string, suspicious_start timestamp_ntz, suspicious_end timestamp_ntz",
    )
    r = {x["account_id"]: x for x in D.submission(s, w).collect()}
    assert r["a"]["suspicious_end"] == "2024-01-02 00:00:01" and r["b"]["suspicious_start"] == ""
    D.same_length(s, s)
    with pytest.raises(ValueError):
        D.same_length(s, s.limit(1))


def test_training_and_gate(spark):
    rng = random.Random(1)
    rows = [(f"a{i:03}", int(i % 4 == 0), i % 3, 1.0, float(i % 4 == 0) + rng.random() * 0.5, rng.random()) for i in range(120)]
    m = spark.createDataFrame(rows, "account_id string, is_mule int, fold int, weight double, x double, y double")
    odd = m.withColumn("z", F.when(F.col("fold") == 0, float("nan")).when(F.col("fold") == 1, float("inf")))
    oof, models = D.out_of_fold(odd, ["x", "y", "z"], k=3, trees=3, depth=2)
    rows = oof.collect()
    assert len(rows) == 120 and D.passes_gate(oof, 0.9) and not D.passes_gate(oof, 1.0)
    assert all(r["score"] == pytest.approx((r["score_gbt"] + r["score_forest"]) / 2) for r in rows)
    new = D.scored_new(models, odd.where("fold = 0"), ["x", "y", "z"])
    assert new.count() == 40 and new.where("score < 0 or score > 1").count() == 0
    assert D.importances(models, ["x", "y", "z"], spark).first()["feature"] == "x"
    assert D.sampled(m, "account_id", 10).collect() == D.sampled(m, "account_id", 10).collect()


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_task_sorts_all_feature_tables(spark, no_broadcast):
    master = spark.createDataFrame([("a", "Y"), ("b", "N"), ("b", "N"), (None, "Y")], "account_id string, kyc_flag string")
    tables = [spark.createDataFrame([("a", i, -i), ("c", 9, 9)], f"account_id string, x{i} int, same int") for i in range(28)]
    tables[20] = tables[20].unionByName(tables[20])
    got = M.feature_matrix(master, tables)
    assert sorts(got) <= M.JOINED
    assert got.columns == ["account_id", "kyc_flag", "x0", "same", *(f"x{i}" for i in range(1, 28))]
    none = (None,) * 29
    want = [("a", 1, 0, 0, *range(1, 28))] * 2 + [("b", 0, *none)] * 2 + [(None, 1, *none)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_training_sees_a_matrix_that_was_joined_in_groups(spark, small, no_broadcast, monkeypatch):
    from ledgerwake.plans import queries as Q

    feature = lambda i: lambda t: t.labels().select("account_id", *(F.lit(float(i)).alias(c) for c in COLUMNS_OF.get(i, [f"x{i}"])))
    COLUMNS_OF = {0: ["pass_through_ratio", "burst_count_5min", "in_degree", "rolling_7d_zscore_max", "total_txns"]}
    features = [feature(i) for i in range(27)]
    for i, f in enumerate(features):
        f.__name__ = f"feature_{i}"
    seen = []
    monkeypatch.setattr(Q, "V1", features[:15])
    monkeypatch.setattr(Q, "V2", features[15:])

    class Model:
        class featureImportances:  # noqa: N801
            toArray = staticmethod(lambda: np.ones(seen[0][1]) / seen[0][1])  # noqa: N815

    monkeypatch.setattr(D, "out_of_fold", lambda m, columns, **_: seen.append((sorts(m), len(columns))) or (m, [{"gbt": Model}]))
    Q._trained.cache_clear()
    try:
        pruned = Q.queries()["importance_pruning"](spark, small).collect()
    finally:
        Q._trained.cache_clear()
    assert len(seen) == 1 and seen[0][0] <= M.JOINED and len(pruned) == seen[0][1] > 30


def test_rows_without_a_counterparty_are_not_joined(spark):
    rows = [("a", "x"), ("a", "x"), ("a", None), ("b", "x"), ("b", "y"), ("c", None)]
    accounts = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "account_id string")
    got = A.cp_frequency(spark.createDataFrame(rows, "account_id string, counterparty_id string"), accounts)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isnotnull(counterparty_id") == 2  # both sides
    zero = (0.0, 0, 0, 0.0, 0)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {"a": (2.0, 2, 2, 0.0, 0), "b": (1.5, 2, 1, pytest.approx(0.5**0.5), 1), "c": zero, "d": zero}
