"""Domain tables derived from the driver's tables, as DataFrames and as the same definitions in DuckDB SQL.

prompts    a document is a prompt, its language the dataset, its first line the origin query
raw        one outcome record for each prompt and candidate: every field is a slice of one SHA-256 digest of
           'doc_id:model', so both engines make the same rows; `hard` prompts are solved by nobody
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Candidate id, pool position, price for a million input and output tokens, base skill in thousandths.
POOL = (
    ("m0", 0, 1, 2, 520),
    ("m1", 1, 1, 3, 560),
    ("m2", 2, 2, 4, 600),
    ("m3", 3, 2, 8, 650),
    ("m4", 4, 3, 12, 690),
    ("m5", 5, 5, 15, 720),
    ("m6", 6, 10, 30, 790),
    ("m7", 7, 15, 60, 800),
)
MODEL_IDS = tuple(row[0] for row in POOL)
REFERENCE = "m6"
HELD_OUT = "de"
SEED = 3407
#: 2 ** 32, what a slice of eight hexadecimal digits is below.
SLICE = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_slice(digest: Column, at: int) -> Column:
    """Eight hexadecimal digits of a digest, from position `at`, as a number."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")


def pool(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POOL, "model_id string, idx int, in_price long, out_price long, skill long")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("doc:"), "lang", F.lit(":"), F.col("doc_id").cast("string")).alias("prompt_id"),
        "doc_id",
        F.col("text").alias("prompt"),
        F.substring_index("text", "\n", 1).alias("origin_query"),
        F.col("lang").alias("dataset"),
        F.col("source").alias("source_split"),
    )


def raw_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool has a fixed size, so it is exploded into each prompt: no join, no shuffle."""
    models = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(i).alias("idx"), F.lit(a).cast("long").alias("in_price"), F.lit(b).cast("long").alias("out_price"), F.lit(s).cast("long").alias("skill")) for m, i, a, b, s in POOL])
    rows = prompts(spark, sf_dir).select("prompt_id", "doc_id", "dataset", "source_split", F.length("prompt").alias("n"), hex_slice(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":d")), 256), 1).alias("hd"), F.inline(models))
    h = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "model_id"), 256)
    rows = rows.withColumn("h", h)
    s = lambda at: hex_slice(F.col("h"), at)
    hard = F.col("hd") % 1000
    tokens_in = F.floor((F.col("n") + 3) / F.lit(4)).cast("bigint")
    rows = rows.select(
        "prompt_id", "doc_id", "dataset", "source_split", "model_id", "idx", "skill", hard.alias("hard"), tokens_in.alias("input_tokens"),
        F.when(s(33) % 211 == 0, F.lit(0).cast("bigint")).otherwise(s(25) % 500 + 1).alias("output_tokens"),
        F.when(s(41) % 101 == 0, F.lit(None)).otherwise(F.when((hard < 880) & (s(1) % 1000 < F.col("skill")), 1.0).otherwise(0.0)).alias("raw_score"),
        (s(9) % 97 == 0).alias("generation_failure"), (s(49) % 53 != 0).alias("has_output"), (s(17) % 89 == 0).alias("free"), (s(57) % 1000).alias("noise"), "in_price", "out_price",
    )
    cost = F.when(F.col("free"), F.lit(0.0)).otherwise((F.col("input_tokens") * F.col("in_price") + F.col("output_tokens") * F.col("out_price")).cast("double") / 1e6)
    p = F.floor((F.col("skill") * 6 + (1000 - F.col("hard")) * 3 + F.col("noise")) / F.lit(10)).cast("double") / 1000.0
    return rows.select("prompt_id", "doc_id", "dataset", "source_split", "model_id", "idx", "raw_score", cost.alias("raw_cost_usd"), "input_tokens", "output_tokens", "generation_failure", "has_output", p.alias("p"))


_POOL_SQL = ", ".join(str(row) for row in POOL)

#: DuckDB twins of the tables above and of what the operators derive from them; prefix of every oracle query.
BASE_SQL = rf"""WITH RECURSIVE pool(model_id, idx, in_price, out_price, skill) AS (VALUES {_POOL_SQL}),
prompts AS (
  SELECT 'doc:' || lang || ':' || doc_id AS prompt_id, doc_id, text AS prompt, split_part(text, chr(10), 1) AS origin_query,
         lang AS dataset, source AS source_split FROM documents),
digests AS (
  SELECT p.prompt_id, p.doc_id, p.dataset, p.source_split, m.model_id, m.idx, m.in_price, m.out_price, m.skill,
         CAST('0x' || substr(sha256(p.doc_id || ':d'), 1, 8) AS BIGINT) % 1000 AS hard,
         CAST((length(p.prompt) + 3) // 4 AS BIGINT) AS input_tokens, sha256(p.doc_id || ':' || m.model_id) AS h
  FROM prompts p CROSS JOIN pool m),
raw AS (
  SELECT prompt_id, doc_id, dataset, source_split, model_id, idx, input_tokens,
    CASE WHEN CAST('0x' || substr(h, 33, 8) AS BIGINT) % 211 = 0 THEN 0 ELSE CAST('0x' || substr(h, 25, 8) AS BIGINT) % 500 + 1 END AS output_tokens,
    CASE WHEN CAST('0x' || substr(h, 41, 8) AS BIGINT) % 101 = 0 THEN NULL
         WHEN hard < 880 AND CAST('0x' || substr(h, 1, 8) AS BIGINT) % 1000 < skill THEN 1e0 ELSE 0e0 END AS raw_score,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % 97 = 0 AS generation_failure,
    CAST('0x' || substr(h, 49, 8) AS BIGINT) % 53 <> 0 AS has_output,
    CASE WHEN CAST('0x' || substr(h, 17, 8) AS BIGINT) % 89 = 0 THEN 0e0
         ELSE CAST(input_tokens * in_price + (CASE WHEN CAST('0x' || substr(h, 33, 8) AS BIGINT) % 211 = 0 THEN 0 ELSE CAST('0x' || substr(h, 25, 8) AS BIGINT) % 500 + 1 END) * out_price AS DOUBLE) / 1e6 END AS raw_cost_usd,
    CAST((skill * 6 + (1000 - hard) * 3 + CAST('0x' || substr(h, 57, 8) AS BIGINT) % 1000) // 10 AS DOUBLE) / 1e3 AS p
  FROM digests),
masked AS (
  SELECT *, raw_score IS NOT NULL AND NOT generation_failure AND (has_output OR output_tokens > 0) AS label_available,
         isfinite(raw_cost_usd) AND raw_cost_usd > 0 AS cost_available, input_tokens > 0 AND output_tokens > 0 AS tokens_available FROM raw),
outcomes AS (
  SELECT *, CASE WHEN label_available THEN CAST(raw_score AS TINYINT) END AS success, CASE WHEN cost_available THEN raw_cost_usd END AS cost_usd,
         label_available AND cost_available AND tokens_available AS eligible FROM masked),
complete AS (SELECT prompt_id FROM outcomes WHERE eligible GROUP BY prompt_id HAVING count(DISTINCT model_id) = 8),
matrix AS (SELECT o.* FROM outcomes o SEMI JOIN complete c ON o.prompt_id = c.prompt_id),
keyed AS (
  SELECT prompt_id, doc_id, dataset, prompt, sha256(lower(trim(regexp_replace(prompt, '[\x20\x09-\x0D]+', ' ', 'g')))) AS text_group FROM prompts),
split_of AS (
  SELECT prompt_id, dataset, text_group, CASE WHEN b < 700 THEN 'train' WHEN b < 850 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, CAST('0x' || substr(sha256('{SEED}:' || text_group), 1, 8) AS BIGINT) % 1000 AS b FROM keyed)),
parts AS (SELECT m.*, s.split, s.text_group FROM matrix m JOIN split_of s USING (prompt_id)),
costs AS (SELECT model_id, idx, avg(cost_usd) AS c FROM parts WHERE split = 'train' GROUP BY ALL)
"""
