import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwake.llm import kernels as K
from ledgerwake.llm import langid, quality
from ledgerwake.llm.queries import queries
from ledgerwake.llm.tables import read

MEDIUM = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    got = queries()["op1_quality_classifier"](spark, MEDIUM)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    r = got.join(read(spark, MEDIUM, "labels"), "doc_id").where("held_out").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*"),
    ).first()
    assert r[0] >= 0.97 and r[1] > 50
    assert got.count() == read(spark, MEDIUM, "documents").count()
    assert got.where("(score >= 0.3) != (predicted = 1) or score < 0 or score > 1 or score is null").count() == 0


def test_language_on_held_out_labels(spark):
    got = queries()["op3_language_id"](spark, MEDIUM)
    r = got.join(read(spark, MEDIUM, "documents"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert r[0] >= 0.98


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "plain words of a text", "en", "clash"), (1, "plain words of a text", "en", "clash"), (2, None, "en", None),
        (3, "", "de", "x"), (4, "123 !!! ...", None, "x"), (None, "SHOUT! SHOUT! SHOUT!", "en", "x"),
        (6, "wort " * 60_000, "de", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, 0), (4, None), (9, 1)], "doc_id long, quality int")
    model = quality.train(odd.select("doc_id", "text"), labels, F.lit(True))
    got = quality.score(odd.select("doc_id", "text"), model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] > by[3] == by[2]


def test_quality_without_pairs_keeps_everything(spark, odd):
    model = quality.train(odd.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r["predicted"] for r in quality.score(odd.select("doc_id", "text"), model).collect()} == {1}
    assert quality.score(odd.select("doc_id", "text").limit(0), model).count() == 0


def test_language_of_odd_rows(spark, odd):
    model = langid.train(odd, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict(odd.select("doc_id", "text"), model).collect()}
    for k in (2, 3, 4):
        assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0)
    assert got[6]["lang_pred"] == "de"
    none = langid.train(odd.where("lang = 'xx'"), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd.select("doc_id", "text"), none).collect()} == {"und"}


def test_a_language_of_repeated_rows_is_learned(spark):
    words = {
        "fr": "le chat dort sous la table et rêve", "en": "the cat sleeps under a table and dreams",
        "de": "die Katze schläft unter dem Tisch und träumt",
    }
    rows = [(7, words["fr"], "fr")] * 3000 + [(i, f"{words[k]} {i}", k) for i in range(400) for k in ("en", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = langid.sampled(docs, 300).groupBy("lang").agg(F.count("text").alias("n"), F.countDistinct("text").alias("d")).collect()
    assert {r["lang"]: (r["n"], r["d"]) for r in picked} == {"fr": (1, 1), "en": (100, 100), "de": (100, 100)}
    model = langid.train(docs, F.lit(True), 300)
    assert model.languages == ["de", "en", "fr"]
    got = langid.predict(docs.where("doc_id in (7, 3)"), model).select("lang", "lang_pred").distinct().collect()
    assert len(got) == 3 and all(r["lang"] == r["lang_pred"] for r in got)


def test_one_text_of_a_repeated_id_is_learned_from(spark):
    rows = [(1, f"text {i} of one id")for i in range(2000)] + [(2, "a good text of words"), (3, "JUNK!!! JUNK!!! $$$")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda good, bad, share: seen.append((len(good), len(bad), share)) or fit(good, bad, share)
        quality.train(docs, labels, F.lit(True))
    finally:
        quality.fit = fit
    assert seen == [(2, 1, pytest.approx(1 / 3))]


def test_columns_that_clash(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    wide = odd.withColumn("predicted", F.lit(9)).withColumn("lang_pred", F.lit("q")).withColumn("x y", F.lit(1))
    got = quality.score(wide, quality.train(wide, labels, F.lit(True)), keep_text=True)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "x y", "score", "predicted"] and {r["predicted"] for r in got.collect()} <= {0, 1}
    got = langid.predict(wide, langid.train(wide, F.lit(True)))
    assert got.columns == ["doc_id", "lang", "predicted", "x y", "lang_pred", "score", "ambiguous"] and got.count() == odd.count()


def test_preference_is_learned_as_by_plain_descent():
    """The weights' order of documents against a slow minimisation of the same loss over all pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.zeros((60, quality.DIM + 4))
    x[:, :3] = rng.normal(size=(60, 3))
    y = x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=60) > 0
    good, bad = x[y], x[~y]
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    w = np.zeros(3)
    d = (z[y][:, None] - z[~y][None]).reshape(-1, 3)
    for _ in range(4000):
        w += 0.3 * ((d / (1 + np.exp(d @ w))[:, None]).mean(0) - 1e-4 * w)
    m = quality.fit(good, bad, len(bad) / 60)
    assert np.corrcoef(m.raw(x), z @ w)[0, 1] > 0.99
    # the quantile of the scores that splits off the share of rejected documents
    assert (m.score(x, 0.3) < 0.3).sum() == len(bad)


@pytest.mark.parametrize("k", [3, 7])
def test_decoding_like_loops(k):
    import numpy as np

    rng = np.random.default_rng(k)
    c = langid.codewords(k)
    bits = c.shape[1]
    m = langid.Ecoc([str(i) for i in range(k)], c, rng.normal(size=(5, bits)), rng.normal(size=bits), rng.uniform(0.1, 1, bits))
    x = rng.normal(size=(20, 5))
    best, _, close = m.decode(x)
    for r in range(20):
        f = [sum(x[r, i] * m.weights[i, b] for i in range(5)) + m.bias[b] for b in range(bits)]
        loss = [sum(m.trust[b] * np.log1p(np.exp(-f[b] * c[j, b])) for b in range(bits)) / m.trust.sum() for j in range(k)]
        assert best[r] == int(np.argmin(loss)) and close[r] == (sorted(loss)[1] - min(loss) < m.margin)


@pytest.mark.parametrize("k", [2, 3, 4, 6, 7, 12, 40])
def test_codewords_differ(k):
    c = langid.codewords(k)
    assert len({tuple(r) for r in c}) == k and set(c.ravel()) <= {1, -1}
    assert all(abs(col.sum()) < k for col in c.T)


def test_decoding_corrects_a_wrong_bit():
    import numpy as np

    c = langid.codewords(4)
    m = langid.Ecoc(list("abcd"), c, np.eye(c.shape[1]), np.zeros(c.shape[1]), np.ones(c.shape[1]))
    x = c * 3.0
    x[:, 0] *= -1
    best, score, close = m.decode(x)
    assert best.tolist() == [0, 1, 2, 3] and not close.any() and (score > 0.5).all()
    assert m.decode(np.zeros((1, c.shape[1])))[2].all()


def test_all_labelled_documents_are_learned_from(spark):
    words = ["plain words of a text", "JUNK!!! $$$ 123", "buy; now: <b>", "some other words, and more"]
    rows = [(i, " ".join(words[(i * 7 + k * k) % 4] for k in range(1 + i % 5)), int((i * 13) % 7 > 1)) for i in range(400)]
    rows = [(i, t + (" rare [mark]" * 3 if not good else ""), good) for i, t, good in rows]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, quality int")
    # the same from whatever sample the steps begin, and the loss of all pairs by plain arithmetic
    models = [quality.train(docs, labels, F.lit(True), n) for n in (20, 60)]
    x = quality.features(*K.of_texts([r[1] for r in rows])).astype(np.float64)
    good = np.array([r[2] for r in rows], bool)

    def loss(m):
        s, scale = x @ m.weights, x.std(0)
        w = np.where(scale > 1e-4, m.weights * scale, 0)
        return np.logaddexp(0, s[~good][None] - s[good][:, None]).mean() + 1e-4 / 2 * w @ w

    on_sample = []
    refined = quality.refined
    try:
        quality.refined = lambda table, model: on_sample.append(model) or refined(table, model)
        quality.train(docs, labels, F.lit(True), 20)
    finally:
        quality.refined = refined
    assert loss(models[0]) < loss(on_sample[0]) and loss(models[0]) == pytest.approx(loss(models[1]), rel=0.1, abs=1e-3)
    for m in models:
        s = np.sort(x @ m.weights)
        low, high = s[(~good).sum() - 1], s[(~good).sum()]
        assert m.threshold == pytest.approx((low + high) / 2)
