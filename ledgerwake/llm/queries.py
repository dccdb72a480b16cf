"""The queries opN_<name> with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, hmm, langid, mixing, neardup, nndescent, packing, quality, tokencount, warczip
from .tables import fold, read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return quality.score(docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), model)


def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    v, model, counts = hmm.train(docs.where(fold(F.col("doc_id"), 5) != 1))
    return hmm.score(docs, v, model, counts, fold(F.col("doc_id"), 5) == 1)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    return langid.predict(docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), model)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.link(read(spark, sf_dir, "embeddings"))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_to_next(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


_OP6 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
  reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c AS component_id, e.vec_id = c AS kept FROM embeddings e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id"""

_OP7 = """SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
    array_to_string(list_transform(range(40), lambda j: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(sha1(coalesce(html, '')), j + 1, 1)) - 1) + 1, 4)), '') AS bits FROM pages)"""

_OP8 = """WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY source),
  l AS (SELECT *, (sum(n) OVER () - coalesce(sum(n * 3) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
    FROM s WINDOW before AS (ORDER BY n / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t AS (SELECT source, n, CAST(coalesce(least((SELECT arg_min(level, n / w) FROM l WHERE level * w <= n * 3) * w, n * 3), n * 3) AS DOUBLE) AS target FROM l),
  sizes AS (SELECT source, size, count(*) AS k FROM d WHERE size > 0 GROUP BY ALL),
  halves(step, source, target, low, high) AS (
    SELECT 0, source, target, least(ln(target / n), 0), CASE WHEN target > n THEN ln(3) ELSE 0 END FROM t WHERE n > 0 UNION ALL
    SELECT step + 1, source, target, CASE WHEN words < target THEN (low + high) / 2 ELSE low END, CASE WHEN words < target THEN high ELSE (low + high) / 2 END FROM (
      SELECT a.step, a.source, a.target, a.low, a.high, sum(z.k * z.size * exp(least((a.low + a.high) / 2 * z.size, ln(3)))) AS words
      FROM halves a JOIN sizes z ON z.source IS NOT DISTINCT FROM a.source WHERE a.step < 70 GROUP BY ALL)),
  r AS (SELECT d.*, t.n, t.target, CASE WHEN d.size > 0 THEN least(CAST(floor(exp(least((x.low + x.high) / 2 * d.size, ln(3))) * 1048576 + CAST(0.5 AS DOUBLE)) AS BIGINT), 3 * 1048576) ELSE 0 END AS grain
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN halves x ON x.step = 70 AND x.source IS NOT DISTINCT FROM d.source),
  v AS (SELECT *, grain // 1048576 * size AS whole, CASE WHEN grain < 3 * 1048576 THEN size ELSE 0 END AS free, h // 1048576 - grain % 1048576 * 1048576 AS v FROM r),
  p AS (SELECT *, CAST(round(target) AS BIGINT) - sum(whole) OVER (PARTITION BY source) - coalesce(sum(free) OVER (PARTITION BY source ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missing FROM v)
SELECT doc_id, size, n AS source_size, target, CAST(whole + greatest(0, least(free, missing)) AS BIGINT) AS taken FROM p"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express: links of embeddings by all pairs, archives' contents, and the mix."""
    return {"op6_nn_descent": _OP6, "op7_warc_zip": _OP7, "op8_source_mixing": _OP8}
