"""Preparing the outcome matrix: availability masks, coverage, complete cases, audits, identities and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.functions.unicode_text import normalize_exact
from pathfold.sources.storage import ensure_checkpoints

#: Texts with which a failed generation begins (compared after trimming and lower-casing).
FAILURE_PREFIXES = ("processing failed:", "generation failed:", "failed to generate", "error:")
REASONS = (("label_available", "missing_or_failed_label"), ("cost_available", "missing_or_invalid_cost"), ("tokens_available", "missing_or_invalid_tokens"))
COVERAGE_MASKS = ("present", "eligible", "label_available", "cost_available", "tokens_available")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))


def output_failure(text: Column, prefixes: tuple[str, ...] = FAILURE_PREFIXES) -> Column:
    low = F.lower(F.trim(text))
    return reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in prefixes])


def normalize_outcomes(rows: DataFrame) -> DataFrame:
    """Masks and nullable labels. A paid answer without text keeps its score; zero or invalid costs are unavailable."""
    tokens = reduce(lambda a, b: a & b, [finite(F.col(c)) & (F.col(c) > 0) & (F.col(c) % 1 == 0) for c in ("input_tokens", "output_tokens")])
    generated = F.col("has_output") | F.coalesce(F.col("output_tokens") > 0, F.lit(False))
    masks = rows.withColumns(
        {
            "label_available": F.col("raw_score").isNotNull() & ~F.col("generation_failure") & generated,
            "cost_available": finite(F.col("raw_cost_usd")) & F.coalesce(F.col("raw_cost_usd") > 0, F.lit(False)),
            "tokens_available": F.coalesce(tokens, F.lit(False)),
        }
    )
    return masks.withColumns(
        {
            "success": F.when(F.col("label_available"), F.col("raw_score").cast("tinyint")),
            "cost_usd": F.when(F.col("cost_available"), F.col("raw_cost_usd")),
            "cost_source": F.when(F.col("cost_available"), "benchmark_record").otherwise("unavailable"),
            "eligible": F.col("label_available") & F.col("cost_available") & F.col("tokens_available"),
            "unavailable_reason": F.concat_ws(";", *[F.when(~F.col(m), name) for m, name in REASONS]),
        }
    )


def duplicate_pairs(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; none may, as outcomes are never averaged."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage_grid(prompts: DataFrame, models: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every prompt with every model, and the outcome's masks; absent outcomes have all masks false."""
    masks = outcomes.select("prompt_id", "model_id", F.lit(True).alias("present"), *COVERAGE_MASKS[1:])
    grid = prompts.crossJoin(F.broadcast(models.select("model_id")))  # the pool has a fixed size
    joined = grid.join(masks, ["prompt_id", "model_id"], "left")
    return joined.withColumns({m: F.coalesce(F.col(m), F.lit(False)) for m in COVERAGE_MASKS})


def coverage_table(grid: DataFrame, *keys: str) -> DataFrame:
    n = lambda m: F.count_if(F.col(m)).alias({"label_available": "labeled_pairs", "cost_available": "priced_pairs", "tokens_available": "valid_token_pairs"}.get(m, f"{m}_pairs"))
    counts = grid.groupBy(*keys).agg(F.count("*").alias("expected_pairs"), *[n(m) for m in COVERAGE_MASKS])
    return counts.withColumns(
        {
            "missing_pairs": F.col("expected_pairs") - F.col("present_pairs"),
            "coverage": F.col("eligible_pairs") / F.col("expected_pairs"),
            "outcome_coverage": F.col("labeled_pairs") / F.col("expected_pairs"),
        }
    )


def complete_case(prompts: DataFrame, outcomes: DataFrame, models: int) -> DataFrame:
    """For each prompt its eligible models, missing models and whether it is complete."""
    have = outcomes.where("eligible").groupBy("prompt_id").agg(F.countDistinct("model_id").alias("available_models"))
    joined = prompts.join(have, "prompt_id", "left").withColumn("available_models", F.coalesce("available_models", F.lit(0)))
    return joined.withColumn("missing_models", F.lit(models) - F.col("available_models")).withColumn("complete", F.col("missing_models") == 0)


def normalized_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def exact_text(text: Column) -> Column:
    """NFKC, case folding and collapsed white space. Texts in ASCII without separators U+001C to U+001F only need built-in functions;
    the others go to a pandas UDF."""
    other = text.rlike(r"[^\x00-\x1B\x20-\x7F]")
    return F.when(other, normalize_exact(F.when(other, text))).otherwise(normalized_text(text))


def leakage_groups(prompts: DataFrame, *keys: str) -> DataFrame:
    """Connected components of prompts that share any of the normalised keys, named by the SHA-256 of the smallest
    prompt_id. Labels move over digests of the keys until none changes; each round is checkpointed. Empty keys join nothing."""
    ensure_checkpoints(prompts.sparkSession)
    normal = [prompts.select("prompt_id", F.lit(str(i)).alias("i"), exact_text(F.col(k)).alias("text")).where(F.length("text") > 0) for i, k in enumerate(keys)]
    edges = reduce(DataFrame.unionByName, normal).select("prompt_id", F.unhex(F.substring(F.sha2(F.concat_ws(":", "i", "text"), 256), 1, 32)).alias("key"))
    edges = edges.distinct().checkpoint()
    labels = prompts.select("prompt_id", F.col("prompt_id").alias("label"))
    while True:
        by_key = edges.join(labels, "prompt_id").groupBy("key").agg(F.min("label").alias("least"))
        new = edges.join(by_key, "key").groupBy("prompt_id").agg(F.min("least").alias("least"))
        # The label of a label: a pointer jump, so long chains take few rounds.
        step = labels.join(new, "prompt_id", "left").select("prompt_id", "label", F.least("label", F.coalesce("least", "label")).alias("next"))
        roots = step.select(F.col("prompt_id").alias("next"), F.col("next").alias("root"))
        step = step.join(roots, "next", "left").select("prompt_id", "label", F.least("next", F.coalesce("root", "next")).alias("next")).checkpoint()
        changed = step.where(F.col("label") != F.col("next")).limit(1).count()
        labels = step.select("prompt_id", F.col("next").alias("label"))
        if not changed:
            return labels.select("prompt_id", F.sha2("label", 256).alias("leakage_group"))


def group_strata(prompts: DataFrame) -> DataFrame:
    """Each group's stratum: its distinct datasets, sorted, joined by a bar."""
    return prompts.groupBy("leakage_group").agg(F.array_join(F.sort_array(F.collect_set("dataset")), "|").alias("stratum"))


def ranked(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """rows with `rank` from 1 within keys by (order, tie), order being a hexadecimal digest. Rows are counted by the digest's
    first three digits, and ranked within them: a key is cut into 4,096 even slices, so one key may hold all rows."""
    part = rows.withColumn("_slice", F.substring(order, 1, 3))
    counts = part.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order, tie))
    joined = part.withColumn("rank", within).join(counts.withColumn("_before", before), [*keys, "_slice"])
    return joined.withColumn("rank", (F.col("rank") + F.col("_before")).cast("int")).drop("_slice", "_n", "_before")


def hash_rank(groups: DataFrame, seed: int, regime: str) -> DataFrame:
    order = F.sha2(F.concat(F.lit(f"{seed}:{regime}:"), "leakage_group"), 256)
    return ranked(groups.withColumn("_order", order), ["stratum"], "_order", "leakage_group").select(*groups.columns, "rank")


def apportioned(ranks: DataFrame, fractions: tuple[float, ...], labels: tuple[str, ...]) -> DataFrame:
    """Whole groups to labels by largest remainder within each stratum; earlier labels win ties."""
    sized = ranks.join(ranks.groupBy("stratum").agg(F.count("*").alias("n")), "stratum")
    ideal = [F.col("n") * F.lit(f) for f in fractions]
    base = [F.floor(x) for x in ideal]
    rest = [x - b for x, b in zip(ideal, base, strict=True)]
    spare = F.col("n") - reduce(lambda a, b: a + b, base)
    bound = F.lit(0)
    out = F.lit(labels[-1])
    cases = []
    for i in range(len(labels)):
        ahead = reduce(lambda a, b: a + b, [(rest[j] > rest[i]).cast("int") + ((rest[j] == rest[i]) & F.lit(j < i)).cast("int") for j in range(len(labels))])
        bound = bound + base[i] + (ahead < spare).cast("int")
        cases.append((F.col("rank") <= bound, labels[i]))
    for when, label in reversed(cases):
        out = F.when(when, label).otherwise(out)
    return sized.withColumn("label", out)


def standard_split(prompts: DataFrame, seed: int, fractions: tuple[float, ...] = (0.7, 0.15, 0.15)) -> DataFrame:
    groups = apportioned(hash_rank(group_strata(prompts), seed, "standard"), fractions, ("train", "validation", "test"))
    return prompts.join(groups.select("leakage_group", F.col("label").alias("standard_split")), "leakage_group")


def ood_split(prompts: DataFrame, seed: int, held_out: tuple[str, ...], validation: float = 0.15) -> DataFrame:
    """Held-out datasets test; other prompts of their groups are excluded; the rest is split train/validation."""
    held = F.col("dataset").isin(*held_out)
    tested = prompts.where(held).select("leakage_group").distinct()
    groups = apportioned(hash_rank(group_strata(prompts.join(tested, "leakage_group", "left_anti")), seed, "ood"), (1 - validation, validation), ("train", "validation"))
    marked = prompts.join(groups.select("leakage_group", "label"), "leakage_group", "left")
    return marked.withColumn("ood_split", F.when(held, "test").otherwise(F.coalesce("label", F.lit("excluded_overlap")))).drop("label")
