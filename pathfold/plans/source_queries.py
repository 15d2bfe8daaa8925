"""Queries of the sources and sinks: each writes what a source would hold to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathfold.plans.bridge import table
from pathfold.plans.registry import query
from pathfold.sources import archives, frozen, readers, sinks
from pathfold.sources.storage import freeze, shared_path


_RUNS_SQL = """WITH runs AS (
  SELECT lang AS dataset, coalesce(source, 'none') AS source_split, 'm' || doc_id % 3 AS model_id, doc_id // 600 AS piece, length(text) AS cost, doc_id FROM documents),
files AS (SELECT dataset, source_split, model_id, piece, count(*) AS records, CAST(sum(cost) AS DOUBLE) AS record_cost_sum, dataset = 'de' AND model_id = 'm2' AS renamed FROM runs GROUP BY ALL)
"""


def _runs(spark, sf_dir):
    """Result files (archive, member, body): documents as records, an archive for each source, a file for each language, candidate
    and 600 ids. Headers of German files of m2 name another model than their path."""
    docs = table(spark, sf_dir, "documents").select("lang", F.coalesce("source", F.lit("none")).alias("source"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), F.floor(F.col("doc_id") / 600).alias("piece"), "doc_id", "text")
    cost = F.length("text").cast("double")
    record = F.struct(F.col("doc_id").alias("index"), F.col("text").alias("prompt"), F.substring_index("text", "\n", 1).alias("origin_query"), F.lit("x").alias("raw_output"), F.lit("p").alias("prediction"), F.lit("g").alias("ground_truth"), F.lit(1.0).alias("score"), cost.alias("cost"), F.length("text").cast("bigint").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens"))
    files = docs.groupBy("lang", "source", "model", "piece").agg(F.sort_array(F.collect_list(record)).alias("records"), F.sum(cost).alias("cost"))  # 200 records at most
    named = F.when((F.col("lang") == "de") & (F.col("model") == "m2"), "m2-old").otherwise(F.col("model"))
    body = F.to_json(F.struct(F.col("lang").alias("dataset_name"), F.col("source").alias("split"), named.alias("model_name"), F.size("records").cast("bigint").alias("counts"), F.lit(1.0).alias("performance"), "cost", F.lit(False).alias("demo"), "records"))
    member = F.concat_ws("/", F.lit("release"), "lang", "source", "model", F.concat(F.lit("run-"), F.col("piece").cast("string"), F.lit(".json")))
    return files.select(F.col("source").alias("archive"), member.alias("member"), body.alias("body"))


def _archived(spark, sf_dir):
    """(written, members): what executors wrote as archives, and the archives read back."""
    path = shared_path(spark, "archives")
    written = freeze(archives.write(_runs(spark, sf_dir), path), "archived")
    return written, readers.read_archive(spark, path)


@query("archive_records", _RUNS_SQL + "SELECT dataset, CASE WHEN dataset = 'de' AND model_id = 'm2' THEN 'm2-old' ELSE model_id END AS model_id, count(*) AS records, count(*) FILTER (dataset <> 'de' OR model_id <> 'm2') AS agreeing, CAST(sum(cost) AS BIGINT) AS tokens FROM runs GROUP BY ALL")
def archive_records(spark, sf_dir):
    """Records of all result files of all archives, with the identity that their headers give."""
    _, members = _archived(spark, sf_dir)
    found = readers.explode_results(members)
    return found.groupBy("dataset", "model_id").agg(F.count("*").alias("records"), F.count_if("header_agrees").alias("agreeing"), F.sum("input_tokens").alias("tokens"))


@query(
    "archive_inventory",
    _RUNS_SQL
    + """SELECT 'release/' || dataset || '/' || source_split || '/' || model_id || '/run-' || piece || '.json' AS member, records, records AS reported_counts, record_cost_sum, true AS intact, NOT renamed AS path_agrees, renamed AND piece = 0 AS pinned,
  CASE WHEN renamed AND piece > 0 THEN 'identity' END AS problem FROM files""",
)
def archive_inventory(spark, sf_dir):
    """A row for each file of the archives: counts, exact costs, whether bytes and digest are those written, and whether a header
    that disagrees with the path is pinned. Only the first files of the renamed model are."""
    written, members = _archived(spark, sf_dir)
    files = written.select("member").where(F.col("member").rlike("^release/de/[^/]*/m2/run-0[.]json$"))
    pinned = files.select("member", F.lit("de").alias("dataset"), F.split("member", "/")[2].alias("source_split"), F.lit("m2-old").alias("model_id"))
    found = freeze(archives.inventory(members, pinned), "inventory")
    kept = written.select("member", F.col("bytes").alias("wb"), F.col("sha256").alias("ws"))
    rows = found.join(kept, "member", "left").join(archives.problems(found), "member", "left")
    return rows.select("member", "records", "reported_counts", "record_cost_sum", ((F.col("bytes") == F.col("wb")) & (F.col("sha256") == F.col("ws"))).alias("intact"), "path_agrees", "pinned", "problem")


@query("jsonl_records", "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def jsonl_records(spark, sf_dir):
    """JSON lines with blank lines between them."""
    path = shared_path(spark, "jsonl")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    rows.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit(""))).alias("value")).write.text(path)
    return readers.read_jsonl(spark, path, "event_id long, user_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("request_file", "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN turn % 5 = 4 THEN 'no_prompt' END AS problem FROM conversations WHERE conv_id >= 0 UNION ALL SELECT 'repeated_id' FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1)) WHERE problem IS NOT NULL GROUP BY 1")
def request_file(spark, sf_dir):
    """Requests of a JSON lines file and what is wrong with them: turns share their conversation's id."""
    path = shared_path(spark, "requests")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.when(F.col("turn") % 5 != 4, F.col("text")).alias("prompt"))
    rows.write.json(path)
    return readers.request_problems(readers.read_requests(spark, path)).groupBy("problem").agg(F.count("*").alias("n"))


#: Loaders, and the task types that an entry may name.
_LOADERS, _TYPES = ("choice", "math", "code", "unknown"), ("multiple_choice", "math", "code")


@query("manifest_check", f"SELECT n_name AS name, {list(_TYPES)}[1 + CAST(n_nationkey % 3 AS INT)] = CASE {list(_LOADERS)}[1 + CAST(n_regionkey % 4 AS INT)] WHEN 'choice' THEN 'multiple_choice' WHEN 'unknown' THEN '' ELSE {list(_LOADERS)}[1 + CAST(n_regionkey % 4 AS INT)] END AS fits FROM nation")
def manifest_check(spark, sf_dir):
    """A manifest with an entry for each nation, and whether its loader fits the task type."""
    path = shared_path(spark, "manifest")
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    entries = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), pick(_LOADERS, F.col("n_regionkey") % 4).alias("loader"), pick(_TYPES, F.col("n_nationkey") % 3).alias("task_type"), F.concat("n_name", F.lit(".jsonl")).alias("path"))
    entries.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)  # one document, a row for each benchmark
    return readers.read_manifest(spark, path).select("name", "fits")


@query(
    "config_check",
    """SELECT n_name AS name, unnest(list_filter([CASE WHEN n_nationkey % 2 = 1 THEN 'fractions' END, CASE WHEN n_nationkey % 4 <> 1 THEN 'validation' END,
  CASE WHEN n_nationkey % 10 NOT BETWEEN 4 AND 7 OR n_regionkey = 0 THEN 'models' END, CASE WHEN n_nationkey % 3 = 0 THEN 'holdout' END], lambda x: x IS NOT NULL)) AS problem FROM nation""",
)
def config_check(spark, sf_dir):
    """Settings of each nation's campaign, and what is wrong with them."""
    path, k = shared_path(spark, "configs"), F.col("n_nationkey").cast("int")
    models = F.transform(F.sequence(F.lit(0), k % 10), lambda i: F.concat(F.lit("m"), F.when(F.col("n_regionkey") == 0, F.lit("0")).otherwise(i.cast("string"))))
    models = F.when((F.col("n_regionkey") == 0) & (k % 10 == 0), F.array(F.lit("m0"), F.lit("m0"))).otherwise(models)
    fractions = F.array(F.lit(0.7), F.when(k % 2 == 0, F.lit(0.15)).otherwise(F.lit(0.2)), F.lit(0.15))
    table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), fractions.alias("standard_fractions"), (k % 4 * 0.5).alias("ood_validation_fraction"), models.alias("models"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("n_name")).alias("ood_held_out_datasets")
    ).write.json(path)
    return readers.config_problems(readers.read_configs(spark, path))


@query("artifact_freeze", "SELECT 'customer' AS name, count(*) AS n, CAST(CAST(sum(CAST(c_acctbal AS DECIMAL(28, 10))) AS DECIMAL(28, 10)) AS VARCHAR) AS spend, true AS verified, true AS refused FROM customer UNION ALL SELECT 'nation', count(*), NULL, true, true FROM nation")
def artifact_freeze(spark, sf_dir):
    """Tables frozen with a manifest, verified by hash, count and exact spend, and never overwritten."""
    from pyspark.errors import AnalysisException

    folder = shared_path(spark, "frozen")
    tables = {name: table(spark, sf_dir, name) for name in ("customer", "nation")}
    manifest, refused = sinks.write_artifacts(tables, folder, spend={"customer": "c_acctbal"}), []
    for name, df in tables.items():
        try:
            sinks.write_artifacts({name: df}, folder)
        except AnalysisException:
            refused.append(name)
    changed = sinks.verify_artifacts(spark, folder)
    return manifest.select("name", F.col("rows").alias("n"), "spend", (~F.col("name").isin(changed)).alias("verified"), F.col("name").isin(refused).alias("refused"))


@query("frozen_copies", "SELECT 'customer' AS name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, true AS intact, true AS refused FROM customer UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT), true, true FROM orders")
def frozen_copies(spark, sf_dir):
    """Files of two tables frozen as they are: read from the copies, compared with the record, and refused a second time."""
    folder, keys = shared_path(spark, "frozen-files"), {"customer": "c_custkey", "orders": "o_orderkey"}
    given = {name: f"{sf_dir}/{name}.parquet" for name in keys}
    frozen.freeze_files(spark, given, folder, {"campaign": "demo"})
    try:
        frozen.freeze_files(spark, given, folder, {"campaign": "again"})
        refused = False
    except frozen.Refused:
        refused = True
    wrong = frozen.differences(spark, folder).agg(F.count("*").alias("wrong"))
    rows = None
    for name, key in keys.items():
        own = spark.read.parquet(f"{folder}/data/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key).alias("keys"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.crossJoin(F.broadcast(wrong)).select("name", "n", "keys", (F.col("wrong") == 0).alias("intact"), F.lit(refused).alias("refused"))  # one row


@query("report_lines", "SELECT '| ' || event_type || ' | ' || count(*) || ' |' AS line FROM events GROUP BY event_type UNION ALL SELECT '| event_type | n |' UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '# Events' UNION ALL SELECT '## By type'")
def report_lines(spark, sf_dir):
    """A report's lines: titles, and a summary as a Markdown table."""
    body = sinks.markdown_table(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")))
    return spark.createDataFrame([(x,) for x in ["# Events", "## By type", *body.splitlines()]], "line string")
