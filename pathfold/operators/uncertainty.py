"""Bootstrap bounds over whole groups within strata.

A replicate's mean is sum(mult * sum_g) / sum(mult * n_g) over groups, so rows are summed by group once and only
(replicate, group, multiplicity) is resampled; prompt rows are never copied. Draw k of a stratum with n groups takes
group sha256(seed:replicate:stratum:k) mod n, so any engine makes the same draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.operators.prep import ranked
from pathfold.sources.storage import freeze

#: Rows of group sums that are broadcast at most; a row has a digest, a few keys and a few numbers.
MOST_BROADCAST = 200_000
#: Fixed value: parts over which the replicates of all strata are dealt.
PARTS = 128


def group_sums(rows: DataFrame, values: list[str], *keys: str) -> DataFrame:
    """(keys, stratum, text_group, n, values...) and each group's number in its stratum."""
    sums = rows.groupBy(*keys, F.col("dataset").alias("stratum"), "text_group").agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values])
    return numbered(sums, *keys)


def numbered(sums: DataFrame, *keys: str) -> DataFrame:
    """sums(stratum, text_group, ...) with g, the number of its group in its stratum from 0, whatever else tells rows apart. A
    stratum may hold any number of groups: they are counted by slices of their digests."""
    groups = sums.select(*keys, "stratum", "text_group").distinct()
    ranks = ranked(groups, [*keys, "stratum"], "text_group", "text_group").withColumn("g", F.col("rank") - 1).drop("rank")
    return sums.join(ranks, [*keys, "stratum", "text_group"])


def multiplicities(groups: DataFrame, replicates: int, seed: int) -> DataFrame:
    """groups(stratum, g) -> (replicate, stratum, g, mult) of the groups that a replicate draws."""
    sizes = groups.select("stratum", "g").distinct().groupBy("stratum").agg(F.count("*").alias("groups"))
    draws = sizes.select("stratum", "groups", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    # A few rows of strata become all draws, so they are dealt first; the count below needs no other shuffle.
    draws = draws.repartition(PARTS, "replicate", "stratum")
    draws = draws.select("stratum", "groups", "replicate", F.explode(F.sequence(F.lit(0), (F.col("groups") - 1).cast("int"))).alias("k"))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), "stratum", F.col("k").cast("string")), 256)
    drawn = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("groups")).cast("int")
    return draws.groupBy("replicate", "stratum", drawn.alias("g")).agg(F.count("*").alias("mult"))


def replicate_means(groups: DataFrame, values: list[str], replicates: int, seed: int, *keys: str) -> DataFrame:
    """For each replicate, key and metric ('__micro__', '__macro__' or a stratum) the means of the values."""
    groups = freeze(groups, "groups")
    # Draws are many more than their dealt rows, by whose size they would be taken for broadcasts. Up to a checked size the groups
    # are broadcast, and the draws stay where they were made until their sums are taken; beyond it both are dealt by group.
    few = groups.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    drawn = multiplicities(groups, replicates, seed).join(F.broadcast(groups) if few else groups.hint("shuffle_hash"), ["stratum", "g"])
    sets = drawn.groupBy(*keys, "replicate", "stratum").agg(F.sum(F.col("mult") * F.col("n")).alias("n"), *[F.sum(F.col("mult") * F.col(v)).alias(v) for v in values])
    return _levels(freeze(sets, "replicate-sets"), values, *keys, "replicate")  # read once for each level


def observed_means(groups: DataFrame, values: list[str], *keys: str) -> DataFrame:
    sets = groups.groupBy(*keys, "stratum").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in values])
    return _levels(sets, values, *keys)


def _levels(sets: DataFrame, values: list[str], *keys: str) -> DataFrame:
    each = sets.select(*keys, F.col("stratum").alias("metric"), *[(F.col(v) / F.col("n")).alias(v) for v in values])
    whole = sets.groupBy(*keys).agg(*[(F.sum(v) / F.sum("n")).alias(v) for v in values], *[F.avg(F.col(v) / F.col("n")).alias(f"macro_{v}") for v in values])
    micro = whole.select(*keys, F.lit("__micro__").alias("metric"), *values)
    macro = whole.select(*keys, F.lit("__macro__").alias("metric"), *[F.col(f"macro_{v}").alias(v) for v in values])
    return micro.unionByName(macro).unionByName(each)


def max_t(means: DataFrame, observed: DataFrame, value: str, keys: list[str], blocks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, metric, delta, standard_error) and (blocks, replicate, max_t); combinations without variance have no say
    and the maximum is never below 0."""
    means = means.withColumnRenamed(value, "_value")
    errors = means.groupBy(*keys, "metric").agg(F.stddev_samp("_value").alias("standard_error")).join(observed.select(*keys, "metric", F.col(value).alias("delta")), [*keys, "metric"])
    joined = means.join(errors, [*keys, "metric"])
    t = F.when(F.col("standard_error") > 1e-12, (F.col("_value") - F.col("delta")) / F.col("standard_error")).otherwise(F.lit(0.0))
    return errors, joined.groupBy(*blocks, "replicate").agg(F.greatest(F.max(t), F.lit(0.0)).alias("max_t"))
