"""Weights, training, blending, thresholds and the submission."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_number, count_all
from ..staging import written

#: The share of flagged accounts that thresholds are anchored to.
PRIOR = 0.027915


def ghost_weight(pass_through: float = 0.35, burst: int = 300, weight: float = 0.1) -> Column:
    """Low weight for accounts that look like relays: 0.1 (defensive) or 0.7 (robust, with a pass-through above 0.18)."""
    return F.when((F.col("pass_through_ratio") > pass_through) | (F.col("burst_count_5min") > burst), weight).otherwise(1.0)


def class_weight(labels: DataFrame) -> DataFrame:
    """One row: negatives / positives."""
    return labels.agg((F.count_if(F.col("is_mule") == 0) / F.nullif(F.count_if(F.col("is_mule") == 1), F.lit(0))).alias("scale_pos_weight"))


def prob_blend(scores: DataFrame, names: list[str]) -> DataFrame:
    return scores.withColumn("blend", reduce(lambda a, b: a + b, map(F.col, names)) / len(names))


#: Ranges into which values are parted to be ranked.
RANGES = 64


def with_before(per: DataFrame, value: str, count: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``per`` (a row a value, with a count; for each ``by``) with _before, the counts of all lower values, and _total.

    Values are parted by rough quantiles, summed by range, and ranked within ranges at once, so that no task sorts all of them. The
    quantiles are an aggregate of the same plan: a row of RANGES numbers for each ``by``.
    """
    by = list(by)
    cuts = F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 4 * RANGES).alias("_cuts")
    # broadcast: as many rows as there are kinds of values, one where there is no ``by``
    parted = per.join(F.broadcast(per.groupBy(*by).agg(cuts)), by) if by else per.crossJoin(F.broadcast(per.agg(cuts)))
    of = F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.col(value))), F.lit(0))
    parted = parted.withColumn("_range", of).drop("_cuts")
    sums = parted.groupBy(*by, "_range").agg(F.sum(count).alias("_s"))  # RANGES rows for each
    every = Window.partitionBy(*by)
    up = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    lower = sums.select(*by, "_range", F.coalesce(F.sum("_s").over(up), F.lit(0)).alias("_lower"), F.sum("_s").over(every).alias("_total"))
    within = F.sum(count).over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = parted.join(F.broadcast(lower), [*by, "_range"]).withColumn("_before", F.col("_lower") + F.coalesce(within, F.lit(0)))
    return ranked.drop("_range", "_lower")


def ranks(scores: DataFrame, names: dict[str, str]) -> DataFrame:
    """scores with the average rank / n of each of some columns, under the names given. All columns are ranked in one pass."""
    long = scores.select(F.explode(F.array(*(F.struct(F.lit(c).alias("_of"), F.col(c).cast("double").alias("_v")) for c in names))).alias("_x")).select("_x.*")
    per = with_before(long.groupBy("_of", "_v").agg(count_all().alias("_c")), "_v", "_c", ("_of",))
    per = per.select("_of", "_v", ((F.col("_before") + (F.col("_c") + 1) / 2) / F.col("_total")).alias("_rank"))
    for c, to in names.items():
        scores = scores.join(per.where(F.col("_of") == c).select(F.col("_v").alias(c), F.col("_rank").alias(to)), c)
    return scores


def rank_share(scores: DataFrame, name: str, to: str) -> DataFrame:
    """Average rank / n."""
    return ranks(scores, {name: to})


def rank_blend(scores: DataFrame, names: list[str]) -> DataFrame:
    ranked = ranks(scores, {n: f"rank_{n}" for n in names})
    return ranked.withColumn("rank_blend", reduce(lambda a, b: a + b, (F.col(f"rank_{n}") for n in names)) / len(names))


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the values that these shares of all values are below, interpolated, under the names given; exact, and by ranges."""
    per = with_before(df.where(F.col(value).isNotNull()).groupBy(value).agg(count_all().alias("_c")), value, "_c")
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_total") - 1)
        has = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_c"))
        low, high = F.max(F.when(has(F.floor(at)), F.col(value))), F.max(F.when(has(F.ceil(at)), F.col(value)))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return per.agg(*out)


def auc(scored: DataFrame, score: str = "score", label: str = "is_mule", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each ``by``): the area under the ROC curve, by ranks with ties averaged."""
    per = scored.groupBy(*by, score).agg(F.sum(F.col(label)).alias("p"), count_all().alias("c"))
    r = with_before(per, score, "c", by).select(*by, "p", "c", (F.col("_before") + (F.col("c") + 1) / 2).alias("rank"))
    n1, n0 = F.sum("p"), F.sum(F.col("c") - F.col("p"))
    return r.groupBy(*by).agg(((F.sum(F.col("p") * F.col("rank")) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0))).alias("auc"))


def f1_threshold(scored: DataFrame, points: int = 1001, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One row: the first of evenly spaced thresholds with the highest F1, where a score strictly above counts as positive.

    Each score is put in the last grid cell below it, so a table of cells stands for all rows.
    """
    step = (high - low) / (points - 1)
    grid = scored.sparkSession.range(points).select(F.col("id").alias("i"), (F.col("id") * step + low).alias("threshold"))
    # rounding may be off by one cell: the neighbours' bounds decide
    i = F.floor((F.col("score") - low) / step).cast("long")
    at = lambda k: k * step + low
    cell = F.when(at(i + 1) < F.col("score"), i + 1).when(at(i) < F.col("score"), i).otherwise(i - 1)
    cells = scored.select(
        F.least(F.greatest(cell, F.lit(-1)), F.lit(points - 1)).alias("i"), "is_mule",
    ).groupBy("i").agg(F.sum("is_mule").alias("tp"), count_all().alias("n"))
    total = scored.agg(F.sum("is_mule").alias("pos"))
    up = Window.orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    c = grid.join(cells, "i", "left").select(
        "i", "threshold", F.sum(z("tp")).over(up).alias("tp"), F.sum(z("n")).over(up).alias("n"),
    ).crossJoin(F.broadcast(total))
    f1 = F.when(F.col("n") + F.col("pos") > 0, 2 * F.col("tp") / F.nullif(F.col("n") + F.col("pos"), F.lit(0))).otherwise(0.0)
    return c.withColumn("f1", F.coalesce(f1, F.lit(0.0))).orderBy(F.desc("f1"), "i").limit(1).select("threshold", "f1")


def prior_threshold(scored: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row: the score that a share of ``prior`` reaches, interpolated."""
    return percentiles(scored, "score", {"threshold": 1 - prior})


def flagged(scored: DataFrame, prior: float = PRIOR) -> DataFrame:
    return scored.crossJoin(F.broadcast(prior_threshold(scored, prior))).where("score >= threshold").drop("threshold")


def pseudo_labels(scored: DataFrame, high: float = 0.995, low: float = 0.10) -> DataFrame:
    """account_id, is_mule of the scores' two ends."""
    s = scored.crossJoin(F.broadcast(percentiles(scored, "score", {"hi": high, "lo": low})))  # one row
    return s.where("score >= hi or score <= lo").select("account_id", (F.col("score") >= F.col("hi")).cast("int").alias("is_mule"))


def displacement(scores: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how far two scores' ranks are apart, and Spearman's correlation."""
    r = ranks(scores, {a: "ra", b: "rb"})
    d = F.abs(F.col("ra") - F.col("rb"))
    return r.agg(
        F.avg(d).alias("mean_shift"), F.max(d).alias("max_shift"), F.count_if(d > 0.05).alias("over_5pct"),
        F.count_if(d > 0.10).alias("over_10pct"), F.corr("ra", "rb").alias("spearman"),
    )


#: Weights of the first score that a search tries.
WEIGHTS = [i / 20 for i in range(21)]


def best_blend(scored: DataFrame, names: list[str], weights: list[float] = WEIGHTS) -> DataFrame:
    """One row: of two scores' weighted means, their rank mean, their geometric mean and the higher of both, the one with the highest AUC (the
    first of equal ones). All are ranked in one pass."""
    a, b = names
    x, y = F.col(a), F.col(b)
    ranked = rank_blend(scored, names)
    arms = [(f"mean {w:.2f}", w * x + (1 - w) * y) for w in weights]
    arms += [("rank", F.col("rank_blend")), ("geometric", F.sqrt(x * y)), ("highest", F.greatest(x, y))]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("strategy"), e.cast("double").alias("score")) for k, (n, e) in enumerate(arms))))
    found = auc(ranked.select("is_mule", rows.alias("x")).select("is_mule", "x.*"), by=("k", "strategy"))
    return found.orderBy(F.desc(F.round("auc", 12)), "k").limit(1).select("strategy", "auc")


def gate(scored: DataFrame, least: float) -> DataFrame:
    """One row: the scores' AUC, and whether it is above what there was before."""
    return auc(scored).select("auc", F.coalesce(F.col("auc") > least, F.lit(False)).alias("passes"))


def passes_gate(scored: DataFrame, least: float) -> bool:
    """Whether the scores pass the gate; the caller stops otherwise."""
    return gate(scored, least).first()["passes"]


def submission(scores: DataFrame, windows: DataFrame) -> DataFrame:
    """account_id, is_mule (the score), suspicious_start and _end as text; empty where an account has no window."""
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    j = scores.join(windows, "account_id", "left")
    return j.select(
        "account_id", F.col("score").alias("is_mule"), text("suspicious_start").alias("suspicious_start"),
        text("suspicious_end").alias("suspicious_end"),
    )


def row_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the rows of a and of b, and whether they are as many."""
    n, m = a.agg(count_all().alias("n")), b.agg(count_all().alias("expected"))
    return n.crossJoin(F.broadcast(m)).select("n", "expected", (F.col("n") == F.col("expected")).alias("same"))


def same_length(a: DataFrame, b: DataFrame) -> None:
    r = row_counts(a, b).first()
    if not r["same"]:
        raise ValueError(f"{r['n']} rows, but {r['expected']} are expected")


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of the key: the same ones in every run and engine."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f" {seed}")).cast("binary")), key).limit(n)


#: What an infinite number becomes for training.
LARGEST = 3.4e38


def assembled(matrix: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """keep, and the columns as one vector of clean numbers: null and NaN are 0, infinite ones the largest there are."""
    from pyspark.ml.feature import VectorAssembler

    clean = matrix.select(*keep, *(clean_number(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), LARGEST).alias(c) for c in columns))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(clean).select(*keep, "features")


def learners(trees: int = 20, depth: int = 4) -> dict:
    """Boosted trees, and a forest of deeper ones that see a part of the columns each."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    common = {"labelCol": "is_mule", "weightCol": "w", "seed": 42}
    forest = RandomForestClassifier(**common, numTrees=2 * trees, maxDepth=depth + 2, subsamplingRate=0.7, featureSubsetStrategy="0.6")
    return {"gbt": GBTClassifier(**common, maxIter=trees, maxDepth=depth), "forest": forest}


def scored_by(models: dict, rows: DataFrame) -> DataFrame:
    """rows (with features) with score_<name> of each model and their mean as score."""
    from pyspark.ml.functions import vector_to_array

    for name, m in models.items():
        rows = m.transform(rows).withColumn(f"score_{name}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    mean = reduce(lambda a, b: a + b, (F.col(f"score_{n}") for n in models)) / len(models)
    return rows.drop("features").withColumn("score", mean)


def out_of_fold(matrix: DataFrame, columns: list[str], k: int = 5, trees: int = 20, depth: int = 4) -> tuple[DataFrame, list[dict]]:
    """account_id, fold, is_mule, score_gbt, score_forest, score (their mean) for train rows (matrix: account_id, is_mule, fold, weight and
    columns), and the models of each fold, by name.

    Trees are grown on all executors, two models a fold; classes are balanced by weight. The rows are read from a written table.
    """
    counts = matrix.agg(F.count_if(F.col("is_mule") == 0).alias("n"), F.count_if(F.col("is_mule") == 1).alias("p")).first()
    scale = counts["n"] / max(1, counts["p"])
    weighted = matrix.withColumn("w", F.col("weight") * F.when(F.col("is_mule") == 1, scale).otherwise(1.0))
    own = ["account_id", "is_mule", "fold", "w"]
    ready = assembled(written(weighted.select(*own, *columns), "train-rows"), columns, *own)
    parts, models = [], []
    for fold in range(k):
        train = ready.where(F.col("fold") != fold)
        fitted = {name: x.fit(train) for name, x in learners(trees, depth).items()}
        models.append(fitted)
        parts.append(scored_by(fitted, ready.where(F.col("fold") == fold)).drop("w"))
    return reduce(DataFrame.unionByName, parts), models


def scored_new(models: list[dict], matrix: DataFrame, columns: list[str]) -> DataFrame:
    """account_id, score: the mean of all folds' models, for rows that none of them has seen."""
    named = {f"{i}_{name}": m for i, fitted in enumerate(models) for name, m in fitted.items()}
    return scored_by(
        named, assembled(written(matrix.select("account_id", *columns), "new-rows"), columns, "account_id"),
    ).select("account_id", "score")


def importances(models: list[dict], columns: list[str], spark, top: int | None = 25) -> DataFrame:  # noqa: ANN001
    """feature, importance: the mean over all models, the greatest first."""
    each = [m.featureImportances.toArray() for fitted in models for m in fitted.values()]
    mean = sum(each) / len(each)
    rows = sorted(zip(columns, map(float, mean), strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(rows[:top], "feature string, importance double")
