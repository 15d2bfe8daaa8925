"""Queries of the preparation operators: sources, projections, joins, aggregates, identities, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathfold.functions.text import prompt_features
from pathfold.operators import prep
from pathfold.plans.bridge import BASE_SQL, HELD_OUT, MODEL_IDS, SEED, pool, prompts, raw_outcomes, table
from pathfold.plans.registry import query


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.normalize_outcomes(raw_outcomes(spark, sf_dir))


def complete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.complete_case(prompts(spark, sf_dir).select("prompt_id"), outcomes(spark, sf_dir), len(MODEL_IDS)).where("complete").select("prompt_id")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the complete prompts. A complete prompt has all its outcomes in one row range of the scan, so the
    count over a window by prompt needs the one shuffle that the split needs anyway."""
    rows = outcomes(spark, sf_dir)
    have = F.count_if(F.col("eligible")).over(Window.partitionBy("prompt_id"))
    return rows.withColumn("_n", have).where(F.col("_n") == len(MODEL_IDS)).drop("_n")


def split_column():
    return F.when(F.col("bucket") < 700, "train").when(F.col("bucket") < 850, "validation").otherwise("test")


def text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("prompt_id", "doc_id", "dataset", "prompt", F.sha2(prep.normalized_text(F.col("prompt")), 256).alias("text_group"))


def split_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), "text_group"), 256)
    rows = text_groups(spark, sf_dir).withColumn("bucket", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000)
    return rows.select("prompt_id", "text_group", split_column().alias("split"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).join(split_of(spark, sf_dir), "prompt_id")


@query(
    "normalize_outcomes",
    BASE_SQL
    + """SELECT prompt_id, model_id, label_available, cost_available, tokens_available, CAST(success AS INT) AS success, round(cost_usd, 9) AS cost_usd,
  CASE WHEN cost_available THEN 'benchmark_record' ELSE 'unavailable' END AS cost_source, eligible FROM outcomes""",
)
def normalize_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).select(
        "prompt_id", "model_id", "label_available", "cost_available", "tokens_available", F.col("success").cast("int").alias("success"), F.round("cost_usd", 9).alias("cost_usd"), "cost_source", "eligible"
    )


@query(
    "unavailable_reason",
    BASE_SQL
    + """SELECT concat_ws(';', CASE WHEN NOT label_available THEN 'missing_or_failed_label' END, CASE WHEN NOT cost_available THEN 'missing_or_invalid_cost' END,
  CASE WHEN NOT tokens_available THEN 'missing_or_invalid_tokens' END) AS unavailable_reason, count(*) AS n FROM outcomes GROUP BY 1""",
)
def unavailable_reason(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("unavailable_reason").agg(F.count("*").alias("n"))


@query(
    "output_failure",
    """SELECT conv_id, turn, starts_with(t, 'processing failed:') OR starts_with(t, 'generation failed:') OR starts_with(t, 'failed to generate') OR starts_with(t, 'error:') AS failed
FROM (SELECT conv_id, turn, lower(trim(CASE WHEN turn % 7 = 3 THEN ' Error: ' || text WHEN turn % 7 = 5 THEN 'FAILED TO GENERATE' ELSE text END)) AS t FROM conversations)""",
)
def output_failure(spark, sf_dir):
    text = F.when(F.col("turn") % 7 == 3, F.concat(F.lit(" Error: "), "text")).when(F.col("turn") % 7 == 5, "FAILED TO GENERATE").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prep.output_failure(text).alias("failed"))


@query("explode_records", """SELECT conv_id, turn, role, sha256(text) AS text_sha256, length(text) > 0 AS has_output FROM conversations""")
def explode_records(spark, sf_dir):
    """Nested records back to rows, with derived hashes and flags."""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("records"))
    return nested.select("conv_id", F.inline("records")).select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), (F.length("text") > 0).alias("has_output"))


@query(
    "path_identity",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '([^/]*)$', 1) AS leaf,
  regexp_extract(url, '([0-9]+)$', 1) = CAST(page_id AS VARCHAR) AS agrees FROM pages""",
)
def path_identity(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(u, "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract(u, "([^/]*)$", 1).alias("leaf"), (F.regexp_extract(u, "([0-9]+)$", 1) == F.col("page_id").cast("string")).alias("agrees")
    )


@query(
    "file_inventory",
    """SELECT source AS source_file, count(*) AS records, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(DISTINCT sha256(text)) AS distinct_texts, min(sha256(text)) AS least_sha256 FROM documents GROUP BY source""",
)
def file_inventory(spark, sf_dir):
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_file")).agg(
        F.count("*").alias("records"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct(h).alias("distinct_texts"), F.min(h).alias("least_sha256")
    )


@query("field_presence", "SELECT k AS field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def field_presence(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query("read_part", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 33, 99, 1000, 1234, 14999)")
def read_part(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").where(F.col("o_orderkey").isin(1, 7, 33, 99, 1000, 1234, 14999))


@query(
    "normalize_sources",
    """SELECT 'choice:' || item_id AS record_id, 'multiple_choice' AS task_type, text AS prompt, NULL AS tests FROM benchmark
UNION ALL SELECT 'math:' || page_id, 'math', url, NULL FROM pages
UNION ALL SELECT 'code:' || event_id, 'code', event_type, CAST(json_array_length(json_keys(props)) AS VARCHAR) FROM events""".replace(
        "json_array_length(json_keys(props))", "len(json_keys(props))"
    ),
)
def normalize_sources(spark, sf_dir):
    """Three sources with layouts of their own become one record type."""
    none = F.lit(None).cast("string").alias("tests")
    choice = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("choice:"), F.col("item_id").cast("string")).alias("record_id"), F.lit("multiple_choice").alias("task_type"), F.col("text").alias("prompt"), none)
    math = table(spark, sf_dir, "pages").select(F.concat(F.lit("math:"), F.col("page_id").cast("string")).alias("record_id"), F.lit("math").alias("task_type"), F.col("url").alias("prompt"), none)
    code = table(spark, sf_dir, "events").select(F.concat(F.lit("code:"), F.col("event_id").cast("string")).alias("record_id"), F.lit("code").alias("task_type"), F.col("event_type").alias("prompt"), F.size(F.json_object_keys("props")).cast("string").alias("tests"))
    return choice.unionByName(math).unionByName(code)


_ORDERED = (17, 3, 250, 8, 99, 4, 31, 120, 77, 61)


@query("ordered_subset", "SELECT list_position([17, 3, 250, 8, 99, 4, 31, 120, 77, 61], doc_id) - 1 AS pos, doc_id, lang FROM documents WHERE doc_id IN (17, 3, 250, 8, 99, 4, 31, 120, 77, 61)")
def ordered_subset(spark, sf_dir):
    wanted = spark.createDataFrame(list(enumerate(_ORDERED)), "pos int, doc_id long")
    return table(spark, sf_dir, "documents").join(F.broadcast(wanted), "doc_id").select("pos", "doc_id", "lang").orderBy("pos")


@query("select_tasks", BASE_SQL + "SELECT dataset, model_id, count(*) AS n FROM raw WHERE dataset IN ('en', 'de') AND model_id IN ('m0', 'm3', 'm6') GROUP BY ALL")
def select_tasks(spark, sf_dir):
    tasks = spark.createDataFrame([("en",), ("de",)], "dataset string")
    models = spark.createDataFrame([("m0",), ("m3",), ("m6",)], "model_id string")
    rows = raw_outcomes(spark, sf_dir).join(F.broadcast(tasks), "dataset", "left_semi").join(F.broadcast(models), "model_id", "left_semi")
    return rows.groupBy("dataset", "model_id").agg(F.count("*").alias("n"))


@query("split_filter", BASE_SQL + "SELECT prompt_id, model_id FROM parts WHERE split = 'validation'")
def split_filter(spark, sf_dir):
    return parts(spark, sf_dir).where("split = 'validation'").select("prompt_id", "model_id")


_FEATURES_SQL = r"""
  CAST(length(t) AS BIGINT) AS character_length, CAST(len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS BIGINT) AS word_count,
  CAST((length(t) + 3) // 4 AS BIGINT) AS token_estimate, CAST(CASE WHEN length(t) = 0 THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END AS BIGINT) AS line_count,
  CAST((length(t) - length(replace(t, '```', ''))) // 3 AS BIGINT) AS code_fence_count,
  CAST(regexp_matches(t, '```|(^|[^\p{L}\p{N}_])(?:def |class |import |SELECT |function\s*\(|#include)') AS BIGINT) AS contains_code,
  CAST(regexp_matches(t, '\\(?:frac|sqrt|sum|int|boxed)|\$|[=^∑∫√]|\d\s*[+*/<>]\s*\d') AS BIGINT) AS contains_math,
  CAST(len(regexp_extract_all(t, '(?m)^\s*(?:[A-J][.)]|\([A-J]\))\s+')) AS BIGINT) AS answer_choice_count,
  CAST(len(regexp_extract_all(t, '[0-9]')) AS BIGINT) AS digit_count, CAST(length(t) - length(replace(t, '?', '')) AS BIGINT) AS question_mark_count,
  CAST(length(t) - length(translate(t, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')) AS BIGINT) AS punctuation_count,
  CAST(length(t) - length(replace(t, ',', '')) AS BIGINT) AS comma_count, CAST(length(t) - length(replace(t, '.', '')) AS BIGINT) AS period_count,
  CAST(length(t) - length(replace(t, ':', '')) AS BIGINT) AS colon_count, CAST(length(t) - length(replace(t, ';', '')) AS BIGINT) AS semicolon_count,
  CAST(length(t) - length(translate(t, '()[]{}', '')) AS BIGINT) AS bracket_count"""


@query("prompt_features", BASE_SQL + f"SELECT prompt_id, {_FEATURES_SQL} FROM (SELECT prompt_id, prompt AS t FROM prompts)")
def features(spark, sf_dir):
    return prompts(spark, sf_dir).select("prompt_id", *[c.alias(n) for n, c in prompt_features(F.col("prompt")).items()])


@query("page_features", f"SELECT page_id, {_FEATURES_SQL} FROM (SELECT page_id, html AS t FROM pages)")
def page_features(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in prompt_features(F.col("html")).items()])


@query("feature_allowlist", BASE_SQL + f"SELECT prompt_id, character_length, comma_count FROM (SELECT prompt_id, {_FEATURES_SQL} FROM (SELECT prompt_id, prompt AS t FROM prompts)) WHERE character_length > 3000")
def feature_allowlist(spark, sf_dir):
    f = prompt_features(F.col("prompt"))
    return prompts(spark, sf_dir).select("prompt_id", f["character_length"].alias("character_length"), f["comma_count"].alias("comma_count")).where("character_length > 3000")


# -- joins and coverage ---------------------------------------------------------------------------------------------

_GRID_SQL = """, held AS (SELECT * FROM outcomes WHERE (doc_id + idx) % 41 <> 0),
grid AS (
  SELECT p.prompt_id, p.dataset, m.model_id, h.prompt_id IS NOT NULL AS present, coalesce(h.eligible, false) AS eligible, coalesce(h.label_available, false) AS label_available,
         coalesce(h.cost_available, false) AS cost_available, coalesce(h.tokens_available, false) AS tokens_available
  FROM prompts p CROSS JOIN pool m LEFT JOIN held h ON h.prompt_id = p.prompt_id AND h.model_id = m.model_id)
"""
_COVERAGE_SQL = """count(*) AS expected_pairs, count(*) FILTER (present) AS present_pairs, count(*) FILTER (eligible) AS eligible_pairs, count(*) FILTER (label_available) AS labeled_pairs,
  count(*) FILTER (cost_available) AS priced_pairs, count(*) FILTER (tokens_available) AS valid_token_pairs, count(*) - count(*) FILTER (present) AS missing_pairs,
  round(count(*) FILTER (eligible) / count(*), 9) AS coverage, round(count(*) FILTER (label_available) / count(*), 9) AS outcome_coverage FROM grid GROUP BY """


def _grid(spark, sf_dir):
    """Some outcomes are left out, so that the grid has gaps."""
    held = outcomes(spark, sf_dir).where((F.col("doc_id") + F.col("idx")) % 41 != 0)
    return prep.coverage_grid(prompts(spark, sf_dir).select("prompt_id", "dataset", "source_split"), pool(spark), held)


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("coverage_grid", BASE_SQL + _GRID_SQL + "SELECT prompt_id, model_id, present, eligible, label_available, cost_available, tokens_available FROM grid")
def coverage_grid(spark, sf_dir):
    return _grid(spark, sf_dir).drop("dataset", "source_split")


for _name, _keys in (("coverage_by_model", ("model_id",)), ("coverage_by_dataset", ("dataset",)), ("coverage_by_model_dataset", ("dataset", "model_id"))):

    @query(_name, BASE_SQL + _GRID_SQL + f"SELECT {', '.join(_keys)}, {_COVERAGE_SQL}{', '.join(_keys)}")
    def coverage_by(spark, sf_dir, keys=_keys):
        return _rounded(prep.coverage_table(_grid(spark, sf_dir), *keys), "coverage", "outcome_coverage")


@query(
    "complete_case",
    BASE_SQL
    + "SELECT p.prompt_id, CAST(coalesce(a.n, 0) AS BIGINT) AS available_models, CAST(8 - coalesce(a.n, 0) AS BIGINT) AS missing_models, coalesce(a.n, 0) = 8 AS complete FROM prompts p LEFT JOIN (SELECT prompt_id, count(DISTINCT model_id) AS n FROM outcomes WHERE eligible GROUP BY 1) a USING (prompt_id)",
)
def complete_case(spark, sf_dir):
    return prep.complete_case(prompts(spark, sf_dir).select("prompt_id"), outcomes(spark, sf_dir), len(MODEL_IDS))


@query("missingness_by_dataset", BASE_SQL + "SELECT dataset, count(*) AS prompts, count(*) FILTER (c.prompt_id IS NOT NULL) AS complete_prompts FROM prompts p LEFT JOIN complete c USING (prompt_id) GROUP BY dataset")
def missingness_by_dataset(spark, sf_dir):
    found = prep.complete_case(prompts(spark, sf_dir).select("prompt_id", "dataset"), outcomes(spark, sf_dir), len(MODEL_IDS))
    return found.groupBy("dataset").agg(F.count("*").alias("prompts"), F.count_if("complete").alias("complete_prompts"))


@query("unknown_keys", "SELECT l_orderkey AS orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 5) GROUP BY 1")
def unknown_keys(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 13 != 5).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(known, "l_orderkey", "left_anti").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.count("*").alias("n"))


@query("join_splits", BASE_SQL + "SELECT split, model_id, count(*) AS n, round(sum(cost_usd), 6) AS cost FROM parts GROUP BY ALL")
def join_splits(spark, sf_dir):
    return parts(spark, sf_dir).groupBy("split", "model_id").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost"))


@query("matched_subset", BASE_SQL + "SELECT a.prompt_id, a.success - b.success AS delta FROM matrix a JOIN matrix b USING (prompt_id) WHERE a.model_id = 'm7' AND b.model_id = 'm0' AND a.doc_id % 2 = 0 AND b.doc_id % 3 = 0".replace("a.success - b.success", "CAST(a.success AS INT) - CAST(b.success AS INT)"))
def matched_subset(spark, sf_dir):
    rows = matrix(spark, sf_dir).select("prompt_id", "doc_id", "model_id", F.col("success").cast("int").alias("y"))
    a = rows.where("model_id = 'm7' AND doc_id % 2 = 0").select("prompt_id", F.col("y").alias("a"))
    b = rows.where("model_id = 'm0' AND doc_id % 3 = 0").select("prompt_id", F.col("y").alias("b"))
    return a.join(b, "prompt_id").select("prompt_id", (F.col("a") - F.col("b")).alias("delta"))


# -- audits ---------------------------------------------------------------------------------------------------------


@query(
    "audit_summary",
    BASE_SQL
    + """SELECT count(*) AS records, count(DISTINCT prompt_id) AS prompts, count(DISTINCT model_id) AS models, count(DISTINCT dataset) AS datasets, count(DISTINCT source_split) AS files,
  count(*) FILTER (raw_score IS NULL) AS null_scores, count(*) FILTER (raw_score = 0) AS zero_scores, count(*) FILTER (raw_score = 1) AS one_scores, count(*) FILTER (raw_cost_usd = 0) AS zero_costs,
  count(*) FILTER (output_tokens = 0) AS zero_outputs, count(*) FILTER (generation_failure) AS failures, count(*) FILTER (NOT has_output) AS without_output,
  count(*) FILTER (generation_failure AND raw_score = 1) AS failed_but_scored, CAST(min(input_tokens) AS BIGINT) AS min_input_tokens, CAST(max(input_tokens) AS BIGINT) AS max_input_tokens,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(raw_cost_usd), 6) AS cost FROM raw""",
)
def audit_summary(spark, sf_dir):
    c = F.col
    return raw_outcomes(spark, sf_dir).agg(
        F.count("*").alias("records"), F.countDistinct("prompt_id").alias("prompts"), F.countDistinct("model_id").alias("models"), F.countDistinct("dataset").alias("datasets"), F.countDistinct("source_split").alias("files"),
        F.count_if(c("raw_score").isNull()).alias("null_scores"), F.count_if(c("raw_score") == 0).alias("zero_scores"), F.count_if(c("raw_score") == 1).alias("one_scores"), F.count_if(c("raw_cost_usd") == 0).alias("zero_costs"),
        F.count_if(c("output_tokens") == 0).alias("zero_outputs"), F.count_if("generation_failure").alias("failures"), F.count_if(~c("has_output")).alias("without_output"),
        F.count_if(c("generation_failure") & (c("raw_score") == 1)).alias("failed_but_scored"), F.min("input_tokens").alias("min_input_tokens"), F.max("input_tokens").alias("max_input_tokens"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("raw_cost_usd"), 6).alias("cost"),
    )


@query("duplicate_counts", "SELECT count(*) AS duplicated_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_counts(spark, sf_dir):
    found = prep.duplicate_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return found.agg(F.count("*").alias("duplicated_keys"), F.sum(F.col("n") - 1).alias("surplus_rows"))


@query("index_conflicts", "SELECT sha256(text) AS text_sha256, count(DISTINCT lang || source) AS variants FROM documents GROUP BY 1 HAVING count(DISTINCT lang || source) > 1")
def index_conflicts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.countDistinct(F.concat("lang", "source")).alias("variants")).where("variants > 1")


@query(
    "dataset_inventory",
    BASE_SQL + "SELECT dataset, count(*) AS rows, count(DISTINCT prompt_id) AS prompts, count(DISTINCT model_id) AS models, count(DISTINCT source_split) AS files, count(*) FILTER (raw_score IS NULL) AS null_scores, count(*) FILTER (raw_cost_usd = 0) AS zero_costs FROM raw GROUP BY dataset",
)
def dataset_inventory(spark, sf_dir):
    return raw_outcomes(spark, sf_dir).groupBy("dataset").agg(
        F.count("*").alias("rows"), F.countDistinct("prompt_id").alias("prompts"), F.countDistinct("model_id").alias("models"), F.countDistinct("source_split").alias("files"),
        F.count_if(F.col("raw_score").isNull()).alias("null_scores"), F.count_if(F.col("raw_cost_usd") == 0).alias("zero_costs"),
    )


@query("score_histogram", BASE_SQL + "SELECT dataset, raw_score, count(*) AS n FROM raw GROUP BY ALL")
def score_histogram(spark, sf_dir):
    return raw_outcomes(spark, sf_dir).groupBy("dataset", "raw_score").agg(F.count("*").alias("n"))


@query(
    "raw_coverage",
    BASE_SQL
    + """SELECT d.dataset, s.source_split, m.model_id, count(r.prompt_id) AS records, count(r.prompt_id) FILTER (r.raw_score IS NOT NULL) AS scored
FROM (SELECT DISTINCT dataset FROM prompts) d CROSS JOIN (SELECT DISTINCT source_split FROM prompts) s CROSS JOIN pool m
LEFT JOIN raw r ON r.dataset = d.dataset AND r.source_split = s.source_split AND r.model_id = m.model_id GROUP BY ALL""",
)
def raw_coverage(spark, sf_dir):
    """Zero rows stay: the grid is made of the distinct values, and counts are joined to it."""
    p = prompts(spark, sf_dir)
    grid = p.select("dataset").distinct().crossJoin(p.select("source_split").distinct()).crossJoin(F.broadcast(pool(spark).select("model_id")))
    counts = raw_outcomes(spark, sf_dir).groupBy("dataset", "source_split", "model_id").agg(F.count("*").alias("records"), F.count("raw_score").alias("scored"))
    return grid.join(counts, ["dataset", "source_split", "model_id"], "left").fillna(0, ["records", "scored"])


@query("stale_statistics", BASE_SQL + """SELECT model_id, n AS actual, expected, abs(n - expected) > 0 AS stale FROM (SELECT model_id, idx, count(*) FILTER (eligible) AS n FROM outcomes GROUP BY ALL)
JOIN (SELECT model_id, count(*) FILTER (doc_id % 97 <> 96 OR idx <> 3) AS expected FROM outcomes WHERE eligible GROUP BY 1) USING (model_id)""")
def stale_statistics(spark, sf_dir):
    """Recorded statistics against those of the rows."""
    rows = outcomes(spark, sf_dir).where("eligible")
    recorded = rows.groupBy("model_id").agg(F.count_if((F.col("doc_id") % 97 != 96) | (F.col("idx") != 3)).alias("expected"))
    actual = rows.groupBy("model_id").agg(F.count("*").alias("actual"))
    return actual.join(recorded, "model_id").withColumn("stale", F.abs(F.col("actual") - F.col("expected")) > 0)


@query("sample_head", BASE_SQL + "SELECT prompt_id, model_id, CAST(success AS INT) AS success FROM outcomes ORDER BY prompt_id, model_id LIMIT 80")
def sample_head(spark, sf_dir):
    return outcomes(spark, sf_dir).select("prompt_id", "model_id", F.col("success").cast("int").alias("success")).orderBy("prompt_id", "model_id").limit(80)


@query(
    "embedding_norms",
    "SELECT label, count(*) AS n, count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) < 1e-5) AS unit, count(*) FILTER (len(embedding) = 64) AS full_length FROM embeddings GROUP BY label",
)
def embedding_norms(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.abs(norm - 1) < 1e-5).alias("unit"), F.count_if(F.size("embedding") == 64).alias("full_length"))


@query("pool_violations", BASE_SQL + "SELECT count(*) NOT BETWEEN 5 AND 8 AS bad_size, count(*) <> count(DISTINCT model_id) AS repeated, count(*) FILTER (skill NOT BETWEEN 0 AND 1000) AS out_of_range FROM pool")
def pool_violations(spark, sf_dir):
    return pool(spark).agg((~F.count("*").between(5, 8)).alias("bad_size"), (F.count("*") != F.countDistinct("model_id")).alias("repeated"), F.count_if(~F.col("skill").between(0, 1000)).alias("out_of_range"))


@query("registry_violations", "SELECT s_suppkey AS key, s_acctbal < 0 AS negative, s_nationkey NOT IN (SELECT n_nationkey FROM nation) AS unknown_group FROM supplier WHERE s_acctbal < 0 OR s_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def registry_violations(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit(True).alias("known"))
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(known), F.col("s_nationkey") == F.col("k"), "left")  # a nation each: fixed size
    return rows.select(F.col("s_suppkey").alias("key"), (F.col("s_acctbal") < 0).alias("negative"), F.col("known").isNull().alias("unknown_group")).where("negative OR unknown_group")


@query("pool_counts", "SELECT coalesce(lang, '__all__') AS lang, coalesce(source, '__all__') AS source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def pool_counts(spark, sf_dir):
    cube = table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"))
    return cube.fillna("__all__", ["lang", "source"])


# -- identities and splits ------------------------------------------------------------------------------------------


def grouped_prompts(spark, sf_dir):
    p = prompts(spark, sf_dir)
    return p.join(prep.leakage_groups(p, "prompt", "origin_query"), "prompt_id").select("prompt_id", "dataset", "leakage_group")


_GROUPS_SQL = r""", nk AS (
  SELECT DISTINCT prompt_id, k FROM (SELECT prompt_id, '0:' || lower(trim(regexp_replace(prompt, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k FROM prompts
    UNION ALL SELECT prompt_id, '1:' || lower(trim(regexp_replace(origin_query, '[\x20\x09-\x0D]+', ' ', 'g'))) FROM prompts) WHERE length(k) > 2),
reach AS (SELECT prompt_id AS a, prompt_id AS b FROM prompts UNION SELECT r.a, y.prompt_id FROM reach r JOIN nk x ON x.prompt_id = r.b JOIN nk y ON y.k = x.k),
leaks AS (SELECT a AS prompt_id, sha256(min(b)) AS leakage_group FROM reach GROUP BY a),
grouped AS (SELECT p.prompt_id, p.dataset, l.leakage_group FROM prompts p JOIN leaks l USING (prompt_id)),
strata AS (SELECT leakage_group, string_agg(DISTINCT dataset, '|' ORDER BY dataset) AS stratum FROM grouped GROUP BY 1)
"""


def _apportion_sql(source: str, regime: str, fractions: tuple, labels: tuple) -> str:
    ideal = [f"n * {f!r}::DOUBLE" for f in fractions]
    rest = [f"({x} - floor({x}))" for x in ideal]
    spare = f"(n - {' - '.join(f'floor({x})' for x in ideal)})"
    bound, cases = "0", ""
    for i, label in enumerate(labels):
        ahead = " + ".join(f"CAST({rest[j]} > {rest[i]} OR ({rest[j]} = {rest[i]} AND {str(j < i).lower()}) AS INT)" for j in range(len(labels)))
        bound += f" + floor({ideal[i]}) + CAST(({ahead}) < {spare} AS INT)"
        cases += f"WHEN r <= {bound} THEN '{label}' "
    return f"""SELECT leakage_group, CASE {cases} ELSE '{labels[-1]}' END AS label FROM (
  SELECT leakage_group, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{SEED}:{regime}:' || leakage_group), leakage_group) AS r FROM {source})"""


@query("leakage_groups", BASE_SQL + _GROUPS_SQL + "SELECT prompt_id, leakage_group FROM leaks")
def leakage_groups(spark, sf_dir):
    return grouped_prompts(spark, sf_dir).drop("dataset")


@query("group_strata", BASE_SQL + _GROUPS_SQL + "SELECT * FROM strata")
def group_strata(spark, sf_dir):
    return prep.group_strata(grouped_prompts(spark, sf_dir))


@query("hash_order", BASE_SQL + _GROUPS_SQL + f"SELECT leakage_group, stratum, CAST(row_number() OVER (PARTITION BY stratum ORDER BY sha256('{SEED}:standard:' || leakage_group), leakage_group) AS INT) AS rank FROM strata")
def hash_order(spark, sf_dir):
    return prep.hash_rank(prep.group_strata(grouped_prompts(spark, sf_dir)), SEED, "standard")


@query("standard_split", BASE_SQL + _GROUPS_SQL + f"SELECT g.prompt_id, g.dataset, g.leakage_group, s.label AS standard_split FROM grouped g JOIN ({_apportion_sql('strata', 'standard', (0.7, 0.15, 0.15), ('train', 'validation', 'test'))}) s USING (leakage_group)")
def standard_split(spark, sf_dir):
    return prep.standard_split(grouped_prompts(spark, sf_dir), SEED)


@query(
    "ood_split",
    BASE_SQL
    + _GROUPS_SQL
    + f""", tested AS (SELECT DISTINCT leakage_group FROM grouped WHERE dataset = '{HELD_OUT}'),
rest AS (SELECT leakage_group, string_agg(DISTINCT dataset, '|' ORDER BY dataset) AS stratum FROM grouped WHERE leakage_group NOT IN (SELECT leakage_group FROM tested) GROUP BY 1)
SELECT g.prompt_id, g.dataset, g.leakage_group, CASE WHEN dataset = '{HELD_OUT}' THEN 'test' ELSE coalesce(s.label, 'excluded_overlap') END AS ood_split
FROM grouped g LEFT JOIN ({_apportion_sql('rest', 'ood', (0.85, 0.15), ('train', 'validation'))}) s USING (leakage_group)""",
)
def ood_split(spark, sf_dir):
    return prep.ood_split(grouped_prompts(spark, sf_dir), SEED, (HELD_OUT,))


_STANDARD_SQL = f"""SELECT 'standard' AS regime, g.prompt_id, g.dataset, g.leakage_group, s.label AS split FROM grouped g JOIN ({_apportion_sql('strata', 'standard', (0.7, 0.15, 0.15), ('train', 'validation', 'test'))}) s USING (leakage_group)"""
_TESTED_SQL = f""", tested AS (SELECT DISTINCT leakage_group FROM grouped WHERE dataset = '{HELD_OUT}'),
rest AS (SELECT leakage_group, string_agg(DISTINCT dataset, '|' ORDER BY dataset) AS stratum FROM grouped WHERE leakage_group NOT IN (SELECT leakage_group FROM tested) GROUP BY 1)
"""
_OOD_SQL = f"""SELECT 'ood' AS regime, g.prompt_id, g.dataset, g.leakage_group, CASE WHEN dataset = '{HELD_OUT}' THEN 'test' ELSE coalesce(s.label, 'excluded_overlap') END AS split
FROM grouped g LEFT JOIN ({_apportion_sql('rest', 'ood', (0.85, 0.15), ('train', 'validation'))}) s USING (leakage_group)"""


@query(
    "split_violations",
    BASE_SQL
    + _GROUPS_SQL
    + _TESTED_SQL
    + f""", both_ AS ({_STANDARD_SQL} UNION ALL {_OOD_SQL}),
crossing AS (SELECT regime, count(*) AS n FROM (SELECT regime, leakage_group FROM both_ WHERE split <> 'excluded_overlap' GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY 1)
SELECT b.regime, count(*) AS prompts, count(DISTINCT prompt_id) - (SELECT count(*) FROM prompts) AS keys_off, coalesce(any_value(c.n), 0) AS crossing_groups,
  count(*) FILTER (b.regime = 'ood' AND dataset = '{HELD_OUT}' AND split <> 'test') AS held_out_elsewhere, count(*) FILTER (split = 'excluded_overlap') AS excluded
FROM both_ b LEFT JOIN crossing c USING (regime) GROUP BY 1""",
)
def split_violations(spark, sf_dir):
    """The checks of both splits: every prompt once, no group in two parts, the held-out dataset in test only."""
    rows = grouped_prompts(spark, sf_dir)
    standard = prep.standard_split(rows, SEED).select(F.lit("standard").alias("regime"), "prompt_id", "dataset", "leakage_group", F.col("standard_split").alias("split"))
    both = standard.unionByName(prep.ood_split(rows, SEED, (HELD_OUT,)).select(F.lit("ood").alias("regime"), "prompt_id", "dataset", "leakage_group", F.col("ood_split").alias("split")))
    excluded = F.col("split") == "excluded_overlap"
    crossing = both.where(~excluded).groupBy("regime", "leakage_group").agg(F.countDistinct("split").alias("d")).groupBy("regime").agg(F.count_if(F.col("d") > 1).alias("crossing_groups"))
    held = (F.col("regime") == "ood") & (F.col("dataset") == HELD_OUT) & (F.col("split") != "test")
    counts = both.groupBy("regime").agg(F.count("*").alias("prompts"), F.countDistinct("prompt_id").alias("keys"), F.count_if(held).alias("held_out_elsewhere"), F.count_if(excluded).alias("excluded"))
    expected = prompts(spark, sf_dir).agg(F.count("*").alias("expected"))
    joined = counts.join(crossing, "regime", "left").crossJoin(F.broadcast(expected))  # one row
    return joined.select("regime", "prompts", (F.col("keys") - F.col("expected")).alias("keys_off"), F.coalesce("crossing_groups", F.lit(0)).alias("crossing_groups"), "held_out_elsewhere", "excluded")


@query("split_counts", BASE_SQL + "SELECT dataset, split, count(*) AS n FROM split_of GROUP BY ALL")
def split_counts(spark, sf_dir):
    return split_of(spark, sf_dir).join(prompts(spark, sf_dir).select("prompt_id", "dataset"), "prompt_id").groupBy("dataset", "split").agg(F.count("*").alias("n"))


_FOLDS_SQL = f""", ranked AS (SELECT DISTINCT dataset, text_group FROM keyed),
folds AS (SELECT dataset, text_group, (row_number() OVER (PARTITION BY dataset ORDER BY sha256('{SEED}:fold:' || text_group), text_group) - 1) % 5 AS fold FROM ranked),
roles AS (SELECT k.prompt_id, k.dataset, f.fold AS own, r.fold, CASE WHEN f.fold = r.fold THEN 'test' WHEN f.fold = (r.fold + 1) % 5 THEN 'validation' ELSE 'train' END AS role
  FROM keyed k JOIN folds f USING (dataset, text_group) CROSS JOIN (SELECT unnest(range(5)) AS fold) r)
"""


def crossfit_roles(spark, sf_dir):
    keyed = text_groups(spark, sf_dir)
    groups = keyed.select("dataset", "text_group").distinct()
    ordered = groups.withColumn("order", F.sha2(F.concat(F.lit(f"{SEED}:fold:"), "text_group"), 256))
    folds = prep.ranked(ordered, ["dataset"], "order", "text_group").select("dataset", "text_group", ((F.col("rank") - 1) % 5).cast("bigint").alias("own"))
    rows = keyed.join(folds, ["dataset", "text_group"]).select("prompt_id", "dataset", "own", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(5)])).alias("fold"))
    return rows.withColumn("role", F.when(F.col("own") == F.col("fold"), "test").when(F.col("own") == (F.col("fold") + 1) % 5, "validation").otherwise("train"))


@query("crossfit_folds", BASE_SQL + _FOLDS_SQL + "SELECT prompt_id, fold, role FROM roles")
def crossfit_folds(spark, sf_dir):
    return crossfit_roles(spark, sf_dir).select("prompt_id", "fold", "role")


@query("fold_roles", BASE_SQL + _FOLDS_SQL + f"SELECT prompt_id, role FROM roles WHERE fold = 2 AND (role <> 'test' OR dataset = '{HELD_OUT}')")
def fold_roles(spark, sf_dir):
    return crossfit_roles(spark, sf_dir).where((F.col("fold") == 2) & ((F.col("role") != "test") | (F.col("dataset") == HELD_OUT))).select("prompt_id", "role")


@query("source_holdout", BASE_SQL + "SELECT p.prompt_id, d.dataset AS held_out, CASE WHEN p.dataset = d.dataset THEN 'validation' ELSE 'train' END AS role FROM split_of p CROSS JOIN (SELECT DISTINCT dataset FROM prompts) d WHERE p.split = 'train'")
def source_holdout(spark, sf_dir):
    rows = split_of(spark, sf_dir).where("split = 'train'").join(prompts(spark, sf_dir).select("prompt_id", "dataset"), "prompt_id")
    held = rows.select(F.col("dataset").alias("held_out")).distinct()
    return rows.crossJoin(held).select("prompt_id", "held_out", F.when(F.col("dataset") == F.col("held_out"), "validation").otherwise("train").alias("role"))
