import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from ledgerwake.llm import kernels as K
from ledgerwake.llm import langid, mixing, packing, quality
from ledgerwake.llm.queries import tokenizer_path
from ledgerwake.llm.shared import written
from ledgerwake.llm.tables import read

from .test_neardup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = read(spark, small, "documents"), {}
    for name, f in C.STAGES:
        out[name] = (docs, written(f(spark, docs, small), name))
        docs = out[name][1]
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality", "language", "near_dedup", "mix", "pack"]
    for name, (_, out) in stages.items():
        assert name == "pack" or out.columns == COLUMNS


def test_quality_keeps_what_the_model_accepts(spark, small, stages):
    docs, out = stages["quality"]
    rows = docs.collect()
    model = quality.train(docs, read(spark, small, "labels"), F.lit(True))
    s = model.score(quality.features(*K.of_texts([r["text"] for r in rows])), 0.3)
    assert ids(out) == sorted(r["doc_id"] for r, x in zip(rows, s, strict=True) if x >= 0.3)
    assert out.join(read(spark, small, "labels").where("quality = 0"), "doc_id").count() <= 1


def test_language_drops_only_the_unclear(stages):
    docs, out = stages["language"]
    rows = docs.collect()
    model = langid.train(docs, F.lit(True))
    _, _, close = model.decode(langid.features(*K.of_texts([r["text"] for r in rows])))
    assert ids(out) == sorted(r["doc_id"] for r, c in zip(rows, close, strict=True) if not c and any(x.isalpha() for x in r["text"]))


def test_one_document_of_each_group(spark, stages):
    docs, out = stages["near_dedup"]
    want, _ = brute(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert ids(out) == sorted({eval(x)[1] for x in want})  # noqa: S307


def test_the_mix_is_near_its_targets(stages):
    docs, out = stages["mix"]
    target = {r["source"]: r["target"] for r in mixing.targets(docs.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("source_size"))).collect()}
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    assert all(abs(taken.get(s, 0) - t) <= 0.5 for s, t in target.items())


def test_packed_whole(stages):
    docs, out = stages["pack"]
    own = packing.Ids(tokenizer_path(), 1).encode([r["text"] for r in docs.collect()])
    assert out.agg(F.sum("length")).first()[0] == sum(len(x) // 4 for x in own)
    fill = np.array([r["n"] for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()])
    assert fill.max() <= 2048 and sum(2048 - x for x in fill if x & (x - 1)) <= 0.01 * fill.sum()


def test_run_is_the_stages(spark, small, stages):
    # sequence numbers depend on how the rows lie in files; what is packed does not
    assert sorted(map(str, C.run(spark, small).select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(str, stages["pack"][1].select("doc_id", "doc_tokens").distinct().collect()))


def test_columns_that_clash_and_rows_that_repeat(spark, small):
    docs = read(spark, small, "documents").limit(60)
    odd = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0)], docs.schema))
    odd = odd.withColumn("score", F.lit("x")).withColumn("size", F.lit(1)).withColumn("_t", F.lit(2)).withColumn("ambiguous", F.lit(3))
    for name, f in C.STAGES[:-1]:
        out = written(f(spark, odd, small), "odd")
        assert out.columns == odd.columns, name
        odd = out
        assert f(spark, odd.limit(0), small).count() == 0
    assert odd.count() > 20
