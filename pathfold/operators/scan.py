"""Running totals and exact quantiles within keys of any size, by ranges instead of windows over a whole key.

Rows are dealt into ranges of (keys, order) and written; a range's rows lie in one partition, and so does at most a
range's share of a hot key. Each range is summed by key, the sums of a key's ranges are scanned (a row for each range and
key), and what came before a range is added to the running totals within it. Only keys that go on from one range to the next
need that, of which a range has one at most, so the table of what came before has fewer rows than there are ranges and is
broadcast.

A quantile counts equal values once, finds from the ranges' counts which range holds each wanted rank, and looks at
the rows of these ranges only.

Defined results: null is a key of its own and the least in every order; rows that are equal in keys and order
come in any order, dealt over ranges like others; an empty table gives an empty one; columns of the rows go along
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.sources.storage import freeze

_KINDS = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)), "max": (F.max, lambda a, b: F.greatest(a, b))}


def dealt(held: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """held with `part`, the number of its range of the columns `by`; written, so that ranges stay as they are."""
    tied = held.withColumn("tie", F.monotonically_increasing_id())  # equal rows need not lie in one range
    ranges = tied.repartitionByRange(parts, *by, "tie") if parts else tied.repartitionByRange(*by, "tie")
    return freeze(ranges.withColumn("part", F.spark_partition_id()), "ranges")


def _same(a: str, b: str, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def running(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, tuple[str, Column]], parts: int | None = None) -> DataFrame:
    """df with a column for each of totals, (kind, value) under its name: the sum, xor or max of value over the key's rows up
    to and with this one, ascending in order."""
    ks, os, vs = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))], [f"v{i}" for i in range(len(totals))]
    kinds = [_KINDS[kind] for kind, _ in totals.values()]
    held = df.select(F.struct(*df.columns).alias("row"), *[F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)], *[o.alias(n) for o, n in zip(order, os, strict=True)], *[v.alias(n) for (_, v), n in zip(totals.values(), vs, strict=True)])
    rows = dealt(held, [*ks, *os], parts)
    upto = Window.partitionBy("part", *ks).orderBy(*os, "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("row", "part", *ks, *[total(v).over(upto).alias(v) for v, (total, _) in zip(vs, kinds, strict=True)])
    sums = rows.groupBy("part", *ks).agg(*[total(v).alias(v) for v, (total, _) in zip(vs, kinds, strict=True)])
    ahead = Window.partitionBy(*ks).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", *ks, *[total(v).over(ahead).alias(f"b{v}") for v, (total, _) in zip(vs, kinds, strict=True)], F.count("*").over(ahead).alias("ranges"))
    offsets = F.broadcast(before.where(F.col("ranges") > 0))  # fewer rows than ranges
    joined = local.alias("a").join(offsets.alias("b"), _same("a", "b", ["part", *ks]), "left")
    out = [F.when(F.col("b.ranges").isNull() | F.col(f"b.b{v}").isNull(), F.col(f"a.{v}")).when(F.col(f"a.{v}").isNull(), F.col(f"b.b{v}")).otherwise(add(F.col(f"b.b{v}"), F.col(f"a.{v}"))).alias(name) for name, v, (_, add) in zip(totals, vs, kinds, strict=True)]
    return joined.select("a.row.*", *out)


def quantiles(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...], counted: str | None = None, parts: int | None = None) -> DataFrame:
    """(keys, q): q[i] is the quantile points[i] of the key's values, interpolated linearly between the two nearest ranks. Null
    values do not count; keys without others have no row. counted names a column that says how often a row counts."""
    ks = [f"k{i}" for i in range(len(keys))]
    named = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)], F.col(value).cast("double").alias("v"), (F.col(counted) if counted else F.lit(1)).cast("long").alias("n"))
    rows = dealt(named.groupBy(*ks, "v").agg(F.sum("n").alias("n")).where("n > 0"), [*ks, "v"], parts)
    sums = rows.groupBy("part", *ks).agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy(*ks).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select("part", *ks, "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*ks)).alias("total"))
    wanted = ranges.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in points])).alias("i", "p"))
    wanted = wanted.withColumn("at", F.col("p") * (F.col("total") - 1))
    wanted = wanted.select("part", *ks, "n", "before", "i", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    wanted = wanted.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select("part", *ks, "before", "i", "at", "rank")
    upto = Window.partitionBy("part", *ks).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    looked = rows.alias("a").join(wanted.select("part", *ks).distinct().alias("b"), _same("a", "b", ["part", *ks]), "left_semi")
    looked = looked.withColumn("upto", F.sum("n").over(upto))
    first, last = F.col("b.before") + F.col("a.upto") - F.col("a.n"), F.col("b.before") + F.col("a.upto")
    met = looked.alias("a").join(wanted.alias("b"), _same("a", "b", ["part", *ks]) & (F.col("b.rank") >= first) & (F.col("b.rank") < last))
    each = met.groupBy(*[F.col(f"b.{k}").alias(k) for k in ks], F.col("b.i").alias("i")).agg(F.min("a.v").alias("lo"), F.max("a.v").alias("hi"), F.max(F.col("b.at") - F.floor("b.at")).alias("f"))
    point = (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")).alias("x")
    found = each.groupBy(*ks).agg(F.sort_array(F.collect_list(F.struct("i", point))).alias("q"))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, ks, strict=True)], F.transform("q", lambda x: x["x"]).alias("q"))
