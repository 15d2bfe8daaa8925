"""Mixing sources to target weights by repeating documents.

The size of a document is its number of words. Sources share the total of all sizes by weight; a source's target
stops at `ceiling` times its size, and what is cut off is shared again by weight among the others until no target
is above. That fixed point has a closed form: with sources in the order of size / weight, the first k are at their
ceiling and the others get the same amount for each unit of weight. A document is then emitted floor(rate) times,
rate = target / source size, plus once more if a hash-seeded uniform number is below the rate's fraction.

Defined results: a null source is a source of its own, ordered last; a null or empty text has size 0 and takes 0;
where all sizes are 0, all targets are 0; repeated rows with one id share the draw, so a rerun agrees; rows without an
id draw by their texts; texts of any length are counted whole; an empty table gives an empty result; columns of the input with clashing names are kept apart by working on own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.llm.common import WORD, hash_unit, sized

WEIGHTS = (5, 2, 1)
CEILING = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(id_: Column, text: Column) -> Column:
    """What a row draws by: its id, or its text where it has none."""
    return F.coalesce(id_.cast("string"), F.concat(F.lit("null:"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))).alias("draw")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """From rows (source, size): source, source_size, target. One row for each source, summed before any shuffle."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"))
    # Fewest words for each unit of weight first; those reach their ceiling first.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * ceiling
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    share = (F.sum("source_size").over(everything) - capped).cast("double") / left
    scanned = weighed.withColumn("share", share).withColumn("fits", F.col("share") * F.col("weight") <= F.col("source_size") * ceiling)
    # From the first source that fits on, all get that source's share.
    level = F.first(F.when(F.col("fits"), F.col("share")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(level.isNull(), (F.col("source_size") * ceiling).cast("double")).otherwise(level * F.col("weight"))
    return scanned.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target, rate, copies and taken = copies * size."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _draw(F.col(id_col), F.col(text_col)))
    return _planned(rows, seed, weights, ceiling)


def _planned(rows: DataFrame, seed: str, weights: tuple[int, ...], ceiling: int) -> DataFrame:
    targets = sized(source_targets(rows.select("source", "size"), weights, ceiling), "mix-targets")
    here, there = rows.alias("d"), targets.alias("t")
    joined = here.join(there, F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = joined.withColumn("rate", rate).withColumn("copies", F.floor("rate") + (hash_unit(seed, F.col("draw")) < F.col("rate") - F.floor("rate")).cast("long"))
    return drawn.withColumn("taken", F.col("copies") * F.col("size")).drop("draw")


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """The mix itself: each document's row as often as the plan says, with the columns of the input. The targets join
    by source (a row each), and copies are made in place, so no document is shuffled."""
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _draw(F.col(id_col), F.col(text_col)))
    planned = _planned(held, seed, weights, ceiling)
    repeated = planned.where(F.col("copies") > 0).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("row.*")
