"""The queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.cluster import ship
from spanveil.llm import extract, licenses, linedup, maxent, mixing, nearcopy, pieces, pii, quality, resample, suffix, topk, whiten


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, proof="lossless")
    return coded.select("doc_id", F.greatest(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "lossless")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"))
    said = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("spans", F.array_join(said, ","))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(_read(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("id") % 100 == 0), 10).select("query_id", "rank", "vec_id", "score")


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_read(spark, sf_dir, "documents"))


def op7_nearcopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopy.report(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.assign(_read(spark, sf_dir, "documents"))
    size = F.col("_mix_size")
    return rows.select(
        "doc_id",
        size.alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (size * F.size("_mix_takes")).cast("long").alias("taken"),
        F.col("_mix_takes").alias("shards"),
    )


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return extract.extract(pages, extract.train(pages))


def op10_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.report(_read(spark, sf_dir, "documents"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(_read(spark, sf_dir, "embeddings"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.sample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.dedup(_read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


# CRC-32 by its table: eight steps of the polynomial for each of 256 bytes, then a fold over a word's bytes.
_RESAMPLE = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), texts AS (
  SELECT doc_id, true AS own, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark
), numbered AS (
  SELECT row_number() OVER () AS r, *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
), flat AS (
  SELECT r, own, unnest(words) AS w FROM numbered
), hashed AS (
  SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || hex(encode(w))[2 * i + 1 : 2 * i + 2] AS BIGINT)),
    lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT w FROM flat), crc
), f AS (SELECT r, own, b FROM flat JOIN hashed USING (w)),
n AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f GROUP BY b),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n),
gain AS (
  SELECT b, CAST(floor(1000 * ln(CAST((n.t + 1) * (total.s + 10000) AS DOUBLE) / CAST((n.s + 1) * (total.t + 10000) AS DOUBLE))) AS BIGINT) AS g FROM n, total
), weight AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM f JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM numbered LEFT JOIN weight USING (r) WHERE own
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": _TOPK, "op12_resample": _RESAMPLE}
