"""Exact top-k search among binary codes by incremental multi-index hashing.

A code of `bits` bits is cut into segments. Any code within distance r of a query differs from it by at most
floor(r / segments) bits in some segment. For each query the search radius of the segments grows one segment at a
time; after radius q in segments 0..j, every code at distance up to q * segments + j has been a candidate. Candidates
are verified by their full distance, and the search of a query ends when its k-th verified distance is covered.

Codes and queries are first reduced to distinct codes (of a code's owners only the k smallest ids can be answers), so
repeated codes cannot weigh on any task. Each code is dealt once for each segment, by the segment's leading bits: the
parts of the index. A query first meets its own part of each segment; its k-th distance there is a bound, and with
radius q of a segment covered only parts whose leading bits differ in at most q bits can hold anything nearer. So in the
second round it meets those parts and no others, and each of them is searched with growing radius up to the bound. The
codes are shuffled twice whatever the number of queries; queries only go where they may find something. Parts with more
than BLOCK_CODES codes are cut into tiles, and the queries of a part into blocks. Nothing but the sizes of the parts is
broadcast (at most segments * 2**MOST_BITS numbers).

Defined results: a vector that is null, holds a null or NaN, or has not `bits` numbers has no code: it is no query
and no answer, and neither is a null id. Ties go to the smaller id; repeated rows with one id and code count once; an id
with several codes is an answer with each and asks with each, its answers being ranked together; with fewer than k codes
all are answers; a query is among its own answers, at distance 0; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.llm.common import dealt_join, materialize

#: Codes of a part or tile, queries of a block, and leading bits of a segment that name its parts, at most.
BLOCK_CODES, BLOCK_QUERIES, MOST_BITS = 1 << 16, 1 << 12, 14
#: Blocks of queries that are wanted at least, as searching takes long and queries take few bytes.
WANTED_BLOCKS = 8
#: Partitions of the tiles at most; a tile is small in bytes and long in time, so its size must not decide.
MOST_PARTITIONS = 4096


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Bit i of the code is 1 where number i is above 0; null where the vector has no code. At most 64 bits."""
    fits = (F.size(vector) == bits) & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.lit(True))
    powers = F.array(*[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("bigint") for i in range(bits)])
    numbered = F.transform(vector, lambda x, i: F.when(x > 0, F.get(powers, i)).otherwise(F.lit(0).cast("bigint")))
    code = F.aggregate(numbered, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))
    return F.when(fits, code)


class SegmentIndex:
    """Tables of one block of codes: for each segment, the codes in the order of that segment's value."""

    def __init__(self, codes: np.ndarray, bits: int, segments: int):
        self.codes = codes.astype(np.uint64)
        edges = [bits * i // segments for i in range(segments + 1)]
        self.parts = [(lo, hi - lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        assert max(w for _, w in self.parts) <= 16
        self.order, self.offsets = [], []
        for lo, width in self.parts:
            value = self.value(self.codes, lo, width)
            self.order.append(np.argsort(value, kind="stable"))
            self.offsets.append(np.concatenate(([0], np.cumsum(np.bincount(value, minlength=1 << width)))))

    @staticmethod
    def value(codes: np.ndarray, lo: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(lo)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def search(self, query: int, k: int, ids: np.ndarray, bound: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k best by (distance, id). Exact, up to distance `bound` if that is given."""
        n, m = len(self.codes), len(self.parts)
        query = np.uint64(query)
        seen = np.zeros(n, dtype=bool)
        places, distances = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for radius in range(max(w for _, w in self.parts) + 1):
            for j, (lo, width) in enumerate(self.parts):
                if radius <= width:
                    keys = int(self.value(query, lo, width)) ^ masks(width, radius)
                    a, size = self.offsets[j][keys], self.offsets[j][keys + 1] - self.offsets[j][keys]
                    full = np.flatnonzero(size)
                    a, size = a[full], size[full]
                    at = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
                    new = self.order[j][at]
                    new = new[~seen[new]]
                    if len(new):
                        seen[new] = True
                        far = np.bitwise_count(self.codes[new] ^ query).astype(np.int64)
                        places, distances = np.concatenate((places, new)), np.concatenate((distances, far))
                        if len(places) > 4 * k:
                            places, distances = self._best(places, distances, k, ids)
                covered = radius * m + j  # every code this near has been verified
                if (len(places) >= k and np.partition(distances, k - 1)[k - 1] <= covered) or (bound is not None and bound <= covered):
                    return self._best(places, distances, k, ids)
            if seen.all():
                break
        return self._best(places, distances, k, ids)

    @staticmethod
    def _best(places: np.ndarray, distances: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids[places], distances))[:k]
        return places[order], distances[order]


_masks: dict[tuple[int, int], np.ndarray] = {}


def masks(width: int, ones: int) -> np.ndarray:
    """All numbers of `width` bits of which `ones` are set."""
    if (width, ones) not in _masks:
        every = np.arange(1 << width, dtype=np.int64)
        _masks[width, ones] = every[np.bitwise_count(every.astype(np.uint32)) == ones]
    return _masks[width, ones]


class _Parts:
    """The parts of the index over distinct (code, id) rows: segment s of `segments`, named by its `lead` leading bits."""

    def __init__(self, codes: DataFrame, n: int, bits: int, segments: int):
        self.codes, self.bits, self.segments = codes, bits, segments
        edges = [bits * i // segments for i in range(segments + 1)]
        self.width = min(hi - lo for lo, hi in zip(edges[:-1], edges[1:], strict=True))
        self.tops = edges[1:]
        self.lead = min(MOST_BITS, self.width, max(0, (-(-n // BLOCK_CODES) - 1).bit_length()))
        # One part holds every code, so one segment's part is enough.
        self.used = range(segments if self.lead else 1)

    def leading(self, code: Column, s: int) -> Column:
        return F.shiftrightunsigned(code, self.tops[s] - self.lead).bitwiseAND((1 << self.lead) - 1).cast("int") if self.lead else F.lit(0)

    def of(self, code: Column) -> Column:
        """The code's own part of each segment."""
        return F.array(*[F.struct(F.lit(s).alias("s"), self.leading(code, s).alias("part")) for s in self.used])

    def within(self, code: Column, bound: Column) -> Column:
        """The other parts that may hold codes within distance bound = q * segments + j: those that differ in 1 to q bits for
        the segments up to j, in 1 to q - 1 for the others."""
        every = F.sequence(F.lit(0), F.lit((1 << self.lead) - 1))

        def near(s: int) -> Column:
            radius = F.floor((bound - s) / F.lit(self.segments))
            own = self.leading(code, s)
            masks_ = F.filter(every, lambda x: (F.bit_count(x) >= 1) & (F.bit_count(x) <= radius))
            return F.transform(masks_, lambda x: F.struct(F.lit(s).alias("s"), own.bitwiseXOR(x).alias("part")))

        return F.concat(*[near(s) for s in self.used])

    def searched(self, visits: DataFrame, k: int) -> DataFrame:
        """visits(q, bound, s, part), q being a query's code -> (q, code, id, distance): the k best of each visited tile."""
        bits, segments = self.bits, self.segments
        dealt = self.codes.select("code", "id", F.inline(self.of(F.col("code"))))
        tiles = dealt.groupBy("s", "part").agg(F.ceil(F.count("*") / F.lit(BLOCK_CODES)).cast("int").alias("tiles"))
        asked = visits.groupBy("s", "part").agg(F.count("*").alias("asked"))
        total = visits.count()
        block = max(1, min(BLOCK_QUERIES, -(-total // WANTED_BLOCKS)))
        sizes = materialize(tiles.join(asked, ["s", "part"]).select("s", "part", "tiles", F.ceil(F.col("asked") / F.lit(block)).cast("int").alias("blocks")), "parts")
        groups = sizes.agg(F.sum(F.col("tiles").cast("bigint") * F.col("blocks"))).first()[0] or 1
        sizes = F.broadcast(sizes)  # segments * 2 ** MOST_BITS rows at most
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = dealt.join(sizes, ["s", "part"]).select("s", "part", F.pmod(F.xxhash64("code", "id"), F.col("tiles")).cast("int").alias("tile"), every("blocks").alias("block"), "code", "id")
        right = visits.join(sizes, ["s", "part"]).select("s", "part", every("tiles").alias("tile"), F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int").alias("block"), "q", "bound")

        def tile(key, held, wanted):
            import pandas as pd

            ids, codes, out = held["id"].to_numpy(), held["code"].to_numpy(dtype=np.int64), []
            if len(ids) and len(wanted):
                index = SegmentIndex(codes.view(np.uint64), bits, segments)
                for q, bound in zip(wanted["q"].to_numpy(dtype=np.int64), wanted["bound"].tolist(), strict=True):
                    places, distances = index.search(int(q.view(np.uint64)), k, ids, int(bound))
                    out.append((np.full(len(places), q), codes[places], ids[places], distances))
            parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 4
            return pd.DataFrame(dict(zip(("q", "code", "id", "distance"), parts, strict=True)))

        n, keys = max(1, min(groups, MOST_PARTITIONS)), ["s", "part", "tile", "block"]
        return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInPandas(tile, "q long, code long, id long, distance long")


def _first(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("distance", "id", "code")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, segments: int = 4) -> DataFrame:
    """codes(id, code), queries(id, code) -> query_id, rank (from 1), id, distance."""
    known = lambda df: df.select("id", "code").where(F.col("id").isNotNull() & F.col("code").isNotNull()).distinct()
    # Of a code's owners the k smallest ids; the limit holds before the shuffle too.
    owners = known(codes).withColumn("distance", F.lit(0))
    codes = materialize(_first(owners, k, "code").select("code", "id"), "codes")
    queries = materialize(known(queries).select(F.col("id").alias("query_id"), F.col("code").alias("q")), "queries")
    parts = _Parts(codes, codes.count(), bits, segments)
    asked = queries.select("q").distinct().withColumn("bound", F.lit(bits))
    found = materialize(_first(parts.searched(asked.select("q", "bound", F.inline(parts.of(F.col("q")))), k).distinct(), k, "q"), "own-parts")
    if parts.lead:
        # The k-th distance bounds what is left to look for; without k answers everything is.
        bounds = found.groupBy("q").agg(F.when(F.max("rank") >= k, F.max("distance")).otherwise(F.lit(bits)).cast("int").alias("bound"))
        bounds = asked.select("q").join(bounds, "q", "left").select("q", F.coalesce("bound", F.lit(bits)).alias("bound"))
        more = parts.searched(materialize(bounds.select("q", "bound", F.inline(parts.within(F.col("q"), F.col("bound")))), "visits"), k)
        found = _first(found.drop("rank").unionByName(more).distinct(), k, "q")
    # Repeated query codes meet their answers again; a hot one is dealt over tasks.
    many = queries.groupBy("q").agg(F.count("*").alias("many"))
    answers = dealt_join(queries, found.select("q", "code", "id", "distance").join(many, "q"), ["q"], F.col("query_id"), 1 << 16)
    return _first(answers, k, "query_id").select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")


def search_vectors(rows: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, bits: int = 64, segments: int = 4) -> DataFrame:
    """Sign codes of vectors; queries are the rows where is_query holds (an expression over `id`)."""
    coded = rows.select(F.col(id_col).cast("long").alias("id"), sign_code(F.col(vector_col), bits).alias("code"))
    return top_k(coded, coded.where(is_query), k, bits, segments)
