"""Sources: result archives, JSON lines, the CSV ledger, requests, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed layout of a result file's records.
RECORD = (
    "struct<index:bigint,prompt:string,origin_query:string,raw_output:string,prediction:string,ground_truth:string,score:double,cost:double,prompt_tokens:bigint,completion_tokens:bigint>"
)
RESULT_FILE = f"dataset_name string, split string, model_name string, counts bigint, performance double, cost double, demo boolean, records array<{RECORD}>"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Members of tar.gz archives as rows (archive, member, bytes, sha256, body), one archive a task, streamed member by member.
    A path that is absolute or climbs, a link or a repeated member is an error: archives are not trusted."""
    from pathfold.sources import archives

    archives.register(spark)
    return spark.read.format("result_archive").load(path)


def explode_results(members: DataFrame) -> DataFrame:
    """Records of result files: identity from the member's path, checked against the file's own header."""
    parsed = members.select("archive", "member", "sha256", F.from_json("body", RESULT_FILE, {"mode": "FAILFAST"}).alias("f"), F.split("member", "/").alias("p"))
    n = F.size("p")
    named = parsed.withColumns({"path_dataset": F.get("p", n - 4), "path_split": F.get("p", n - 3), "path_model": F.get("p", n - 2)})
    agrees = (F.col("path_dataset") == F.col("f.dataset_name")) & (F.col("path_split") == F.col("f.split")) & (F.col("path_model") == F.col("f.model_name"))
    rows = named.select("member", "sha256", agrees.alias("header_agrees"), F.col("f.dataset_name").alias("dataset"), F.col("f.split").alias("source_split"), F.col("f.model_name").alias("model_id"), F.inline("f.records"))
    return rows.select(
        F.concat_ws(":", "dataset", F.sha2("prompt", 256)).alias("prompt_id"), "dataset", "source_split", "model_id", "member", "header_agrees", F.col("index").alias("source_index"), "prompt", "origin_query",
        F.col("score").alias("raw_score"), F.col("cost").alias("raw_cost_usd"), F.col("prompt_tokens").alias("input_tokens"), F.col("completion_tokens").alias("output_tokens"),
        (F.length(F.trim(F.coalesce("raw_output", F.lit("")))) > 0).alias("has_output"), "raw_output",
    )


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. Strict: a bad line is an error; else its text is kept in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV ledger with a header; quotes may hold line breaks, empty cells are null, a cell of the wrong type is an error."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines from 1, whatever blocks the files are read in: lines are counted by block, and a block
    begins after the lines of those before it."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.withColumn("at", F.monotonically_increasing_id())  # a block's lines are neighbours
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(blocks.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def jsonl_problems(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, value) of the lines that are neither blank nor a JSON object of the schema."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("it", parsed)
    return lines.where(F.col("it").isNull() | F.col("it._corrupt_record").isNotNull() | ~F.startswith(F.trim("value"), F.lit("{"))).select("file", "line", "value")


def read_requests(spark: SparkSession, path: str | None = None, prompt: str | None = None) -> DataFrame:
    """Requests (id, prompt, order) from JSON lines, or one from a text."""
    if prompt is not None:
        return spark.createDataFrame([("request", prompt)], "id string, prompt string")
    return read_jsonl(spark, path, "id string, prompt string")


def request_problems(requests: DataFrame) -> DataFrame:
    """(id, problem) of requests that cannot be routed: a blank, missing or repeated id, or a missing prompt."""
    blank = requests.select("id", F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "blank_id").when(F.col("prompt").isNull(), "no_prompt").alias("problem")).where("problem IS NOT NULL")
    repeated = requests.groupBy("id").count().where("count > 1").select("id", F.lit("repeated_id").alias("problem"))
    return blank.unionByName(repeated)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document of benchmark entries; a loader that does not fit the task type is marked."""
    rows = spark.read.option("multiLine", True).schema("name string, loader string, task_type string, path string").json(path)
    fits = F.create_map(*[F.lit(x) for x in ("choice", "multiple_choice", "math", "math", "code", "code")])
    return rows.withColumn("fits", F.coalesce(F.try_element_at(fits, F.col("loader")) == F.col("task_type"), F.lit(False)))


def verify_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files below path against expected(file, bytes, sha256): (file, problem) of those that are missing, surplus or different.
    Hashing runs where the files are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("found_bytes"), F.sha2("content", 256).alias("found_sha256"))
    both = found.join(expected, "file", "full")
    problem = (
        F.when(F.col("found_bytes").isNull(), "missing").when(F.col("bytes").isNull(), "surplus").when(F.col("found_bytes") != F.col("bytes"), "size").when(F.col("found_sha256") != F.col("sha256"), "sha256")
    )
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")


#: Fixed layout of split settings.
CONFIG = "name string, standard_fractions array<double>, ood_validation_fraction double, models array<string>, ood_held_out_datasets array<string>"


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Settings, one JSON object a file or a line; what is no such object is an error."""
    return spark.read.schema(CONFIG).option("mode", "FAILFAST").json(path)


def config_problems(configs: DataFrame) -> DataFrame:
    """(name, problem) of split settings: fractions that are no partition, a validation share that is none, repeated models or other
    than five to eight, an empty holdout. Missing settings are wrong ones."""
    f, models = F.col("standard_fractions"), F.col("models")
    rules = {
        "fractions": (F.size(f) == 3) & F.forall(f, lambda x: x >= 0) & (F.abs(F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x) - 1) <= 1e-12),
        "validation": (F.col("ood_validation_fraction") > 0) & (F.col("ood_validation_fraction") < 1),
        "models": F.size(models).between(5, 8) & (F.size(F.array_distinct(models)) == F.size(models)),
        "holdout": F.size("ood_held_out_datasets") > 0,
    }
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), name) for name, good in rules.items()]))
    return configs.select("name", F.explode(wrong).alias("problem"))
