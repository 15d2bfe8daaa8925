"""Success heads: one penalised logistic regression for each candidate of the pool, on TF-IDF or dense features.

Vocabularies, document frequencies and scaling cover all training rows. Fits begin on a bounded sample of
these: the `most_rows` rows whose ids hash lowest, and of them as many as have `most_entries` features other than zero
together, which is what is broadcast. A fit minimises |w|^2 / 2 + C * sum(loss), the intercept being one of the weights,
by Newton steps whose systems are solved by conjugate gradients. The fits of all heads, folds and penalties are rows of a
table, so executors share them. `fitted_on_all` fits every row: gradients and products with the Hessian are sums over packed blocks of
sparse rows, for all heads in one pass; the driver holds a few matrices of vocabulary x heads and some directions of the vocabulary's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfold.sources.storage import freeze

MOST_ROWS, MOST_ENTRIES = 20_000, 8_000_000
#: Terms of a sample before each fold takes its own vocabulary of 50,000 from them.
MOST_TERMS = 400_000
TOLERANCE = 1e-6


@dataclass
class Rows:
    """Sparse rows: those of row i are places starts[i]:starts[i + 1] of columns and values. labels is rows x heads, NaN unknown."""

    ids: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    labels: np.ndarray
    marks: dict[str, np.ndarray]

    def take(self, chosen: np.ndarray) -> Rows:
        """The rows where chosen holds."""
        sizes = np.diff(self.starts)
        entries = np.repeat(chosen, sizes)
        starts = np.concatenate(([0], np.cumsum(sizes[chosen])))
        return Rows(self.ids[chosen], starts, self.columns[entries], self.values[entries], self.labels[chosen], {k: v[chosen] for k, v in self.marks.items()})


class Fit:
    """Minimises |w|^2 / 2 + c * sum(loss) over the weights and the intercept, which is the last of w."""

    def __init__(self, rows: Rows, width: int):
        self.own = np.repeat(np.arange(len(rows.starts) - 1), np.diff(rows.starts))
        self.rows, self.width, self.n = rows, width, len(rows.starts) - 1

    def forward(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.own, self.rows.values * w[self.rows.columns], self.n) + w[-1]

    def back(self, u: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.rows.columns, self.rows.values * u[self.own], self.width), u.sum())

    def solve(self, y: np.ndarray, c: float, w: np.ndarray | None = None, most: int = 100) -> np.ndarray:
        w = np.zeros(self.width + 1) if w is None else w.copy()
        z = self.forward(w)
        loss = lambda w, z: w @ w / 2 + c * np.sum(np.logaddexp(0, z) - y * z)
        now, first = loss(w, z), None
        for _ in range(most):
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            g = w + c * self.back(p - y)
            size = np.sqrt(g @ g)
            first = first or np.sqrt((e := c * self.back(0.5 - y)) @ e)
            if size <= TOLERANCE * max(first, 1e-12):
                break
            step = self._direction(g, c * p * (1 - p), min(0.1, np.sqrt(size)) * size)
            along, slope, t = self.forward(step), g @ step, 1.0
            while (new := loss(w + t * step, z + t * along)) > now + 1e-4 * t * slope and t > 1e-10:
                t /= 2
            w, z, now = w + t * step, z + t * along, new
        return w

    def _direction(self, g: np.ndarray, curve: np.ndarray, enough: float) -> np.ndarray:
        """The Newton step: (I + X' diag(curve) X) d = -g, by conjugate gradients."""
        d, r = np.zeros_like(g), -g
        s, rr = r.copy(), r @ r
        for _ in range(250):
            if np.sqrt(rr) <= enough:
                break
            hs = s + self.back(curve * self.forward(s))
            a = rr / (s @ hs)
            d, r = d + a * s, r - a * hs
            before, rr = rr, r @ r
            s = r + rr / before * s
        return d


def fit_one(rows: Rows, head: int, c: float, width: int, start: np.ndarray | None = None) -> tuple[np.ndarray | None, float]:
    """(weights with the intercept last, prevalence); no weights where there is one class only."""
    known = ~np.isnan(rows.labels[:, head])
    rows = rows if known.all() else rows.take(known)
    y = rows.labels[:, head]
    prevalence = float(y.mean()) if len(y) else 0.0
    if prevalence in (0.0, 1.0):
        return None, prevalence
    return Fit(rows, width).solve(y, c, start), prevalence


def predicted(rows: Rows, weights: np.ndarray | None, prevalence: float, width: int) -> np.ndarray:
    if weights is None:
        return np.full(len(rows.starts) - 1, prevalence)
    return 1 / (1 + np.exp(-np.clip(Fit(rows, width).forward(weights), -500, 500)))


def log_loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log1p(-p))) if len(y) else float("nan")


def weighed(counts: Rows, by: Rows, min_df: int = 2, max_features: int = 50_000) -> Callable[[Rows], Rows]:
    """A function that gives rows of term counts their TF-IDF weights, with the vocabulary and frequencies of `by`: (1 + ln tf) *
    (ln((1 + n) / (1 + df)) + 1), of unit length. Columns must be numbered in the order of their terms, which settles ties."""
    width = int(max(counts.columns.max(initial=-1), by.columns.max(initial=-1))) + 1
    df = np.bincount(by.columns, minlength=width)
    total = np.bincount(by.columns, by.values, width)
    order = np.lexsort((np.arange(width), -total))
    order = order[df[order] >= min_df][:max_features]
    idf = np.zeros(width)
    idf[order] = np.log((1.0 + len(by.ids)) / (1 + df[order])) + 1

    def transform(rows: Rows) -> Rows:
        kept = idf[rows.columns] > 0
        own = np.repeat(np.arange(len(rows.ids)), np.diff(rows.starts))[kept]
        columns = rows.columns[kept]
        w = (1 + np.log(rows.values[kept])) * idf[columns]
        length = np.sqrt(np.bincount(own, w * w, len(rows.ids)))
        starts = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(rows.ids)))))
        return Rows(rows.ids, starts, columns, w / length[own], rows.labels, rows.marks)

    return transform


def sampled(rows: DataFrame, heads: tuple[str, ...], marks: tuple[str, ...] = (), most_rows: int = MOST_ROWS, most_entries: int = MOST_ENTRIES) -> Rows:
    """rows(id, columns array<int>, values array<double>, labels map<head, double>, marks) -> the bounded sample of them."""
    order = F.xxhash64("id")
    rows = rows.withColumn("_order", order)
    sizes = rows.select("_order", "id", F.size("columns").alias("n")).orderBy("_order", "id").limit(most_rows).collect()
    within = int(np.searchsorted(np.cumsum([r.n for r in sizes]), most_entries, "right")) if sizes else 0
    last = sizes[within - 1] if within else None
    if last is None:
        kept = rows.limit(0)
    else:
        kept = rows.where((F.col("_order") < last[0]) | ((F.col("_order") == last[0]) & (F.col("id") <= F.lit(last[1]))))
    table = kept.select("id", "columns", "values", F.array(*[F.element_at("labels", F.lit(h)) for h in heads]).alias("y"), *marks).toArrow().combine_chunks()
    order = np.argsort(np.array(table.column("id").to_pylist(), dtype=object), kind="stable")
    table = table.take(order)
    lists = [table.column(c).combine_chunks() for c in ("columns", "values", "y")]
    flat = lambda x, kind: x.flatten().to_numpy(zero_copy_only=False).astype(kind)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists[0].to_pylist()]))) if len(table) else np.zeros(1, dtype=int)
    labels = flat(lists[2], float).reshape(-1, len(heads))
    return Rows(np.array(table.column("id").to_pylist(), dtype=object), starts.astype(np.int64), flat(lists[0], np.int64), flat(lists[1], float), labels, {m: np.array(table.column(m).to_pylist(), dtype=object) for m in marks})


def each(spark, tasks: DataFrame, rows: Rows, work: Callable[[Rows, dict], list[tuple]], schema: str) -> DataFrame:
    """work(rows, task) for every row of tasks, dealt over the executors; rows are broadcast, bounded as the sample is."""
    shared = spark.sparkContext.broadcast(rows)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for frame in frames:
            out = [row for task in frame.to_dict("records") for row in work(shared.value, task)]
            yield pd.DataFrame(out, columns=names)

    n = tasks.count()
    return tasks.repartition(max(1, n)).mapInPandas(run, schema) if n else spark.createDataFrame([], schema)


def fitted_heads(spark, rows: Rows, heads: tuple[str, ...], width: int, c: float = 1.0) -> DataFrame:
    """(model_id, prevalence, weights): for each head its weights, intercept last; null with one class only."""
    tasks = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, model_id string")

    def work(rows: Rows, task: dict) -> list[tuple]:
        weights, prevalence = fit_one(rows, task["i"], c, width)
        return [(task["model_id"], prevalence, None if weights is None else weights.tolist())]

    return each(spark, tasks, rows, work, "model_id string, prevalence double, weights array<double>")


# -- on all rows ----------------------------------------------------------------------------------------------------


#: Numbers other than zero of a packed block (half a megabyte), blocks of a file, and such numbers that are multiplied at once.
BLOCK, BLOCKS_OF_FILE, AT_ONCE = 150_000, 7, 1_000_000


def packed(features: DataFrame, labels: DataFrame, heads: tuple[str, ...]) -> DataFrame:
    """features(id, columns, values) with labels(id, labels) as blocks of sparse rows: (starts, columns, values, table, factors, y), packed. Where
    features have `parts` and `factor`, a value is part * factor * the scale of its column, which AllRows knows. Values of at most 256 kinds
    are places of a table of them; columns take two bytes where that is enough."""
    apart = "parts" in features.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        flat = lambda x, kind: x.flatten().to_numpy(zero_copy_only=False).astype(kind)
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column(0).offsets.to_numpy()))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
                columns, values, factors, y = (batch.column(i).slice(first, last - first) for i in range(4))
                starts = np.concatenate(([0], np.cumsum(np.diff(columns.offsets.to_numpy()))))
                columns, values, table = flat(columns, np.int32), flat(values, float), np.zeros(0)
                if columns.max(initial=0) < 1 << 16:
                    columns = columns.astype(np.uint16)
                if len(np.unique(values[:10_000])) <= 256 and len(kinds := np.unique(values)) <= 256:
                    values, table = np.searchsorted(kinds, values).astype(np.uint8), kinds
                row = [starts.astype(np.int64), columns, values, table, factors.to_numpy(zero_copy_only=False).astype(float), flat(y, float)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["starts", "columns", "values", "table", "factors", "y"])
                first = last

    y = F.array(*[F.element_at("labels", F.lit(h)) for h in heads]).alias("y")
    joined = features.join(labels, "id").select("columns", F.col("parts" if apart else "values"), F.col("factor") if apart else F.lit(1.0).alias("factor"), y)
    return joined.mapInArrow(run, "starts binary, columns binary, values binary, table binary, factors binary, y binary")


class _Block:
    """Packed blocks as one: products with it and with its transpose, the intercept last."""

    #: Entries of a row from which rows are multiplied one by one, for all columns of the weights at once.
    LONG = 32

    def __init__(self, rows: list[tuple], width: int, count: int, which: list[int]):
        parts = [self._read(*row) for row in rows]
        sizes, self.columns, self.values, self.factors, y = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.starts, self.width = np.concatenate(([0], np.cumsum(sizes))), width
        self.own, y = np.repeat(np.arange(len(sizes)), sizes), y.reshape(-1, count)[:, which]
        self.known = ~np.isnan(y)
        self.y = np.where(self.known, y, 0.0)

    @staticmethod
    def _read(starts, columns, values, table, factors, y) -> tuple:
        starts, table = np.frombuffer(starts, np.int64), np.frombuffer(table, float)
        columns = np.frombuffer(columns, np.uint16 if len(columns) == 2 * starts[-1] else np.int32).astype(np.intp)
        values = table.take(np.frombuffer(values, np.uint8)) if len(table) else np.frombuffer(values, float)
        return np.diff(starts), columns, values, np.frombuffer(factors, float), np.frombuffer(y, float)

    @classmethod
    def together(cls, batches: Iterator, *of) -> Iterator[_Block]:
        """Blocks of AT_ONCE entries or a little more."""
        held, entries = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append([c[i].as_buffer() for c in batch.columns])
                entries += np.frombuffer(held[-1][0], np.int64)[-1]
                if entries >= AT_ONCE:
                    yield cls(held, *of)
                    held, entries = [], 0
        if held:
            yield cls(held, *of)

    def forward(self, w: np.ndarray) -> np.ndarray:
        n = len(self.factors)
        if len(self.values) < self.LONG * n:
            z = np.stack([np.bincount(self.own, self.values * x.take(self.columns), n) for x in np.ascontiguousarray(w.T)], axis=1)
        else:
            z, w, ends = np.zeros((n, w.shape[1])), np.ascontiguousarray(w), self.starts.tolist()
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                np.dot(self.values[a:b], w.take(self.columns[a:b], axis=0), out=z[i])
        return z * self.factors[:, None] + w[-1]

    def back(self, u: np.ndarray) -> np.ndarray:
        v = np.ascontiguousarray((u * self.factors[:, None]).T)
        return np.vstack((np.stack([np.bincount(self.columns, self.values * x.take(self.own), self.width) for x in v], axis=1), u.sum(axis=0)))


class AllRows:
    """Sums over all rows of packed blocks, for all heads at once. A task adds what it reads and passes on one matrix (or a few numbers);
    matrices are added once more by TREE tasks, so that the driver gets as many of them, whatever the data. scale: what the columns
    are multiplied by."""

    TREE = 16

    def __init__(self, blocks: DataFrame, width: int, count: int, scale: np.ndarray | None = None):
        self.blocks, self.width, self.count, self.passes = blocks, width, count, 0
        self.scale = np.append(np.ones(width) if scale is None else scale, 1.0)[:, None]

    def _sum(self, work, given: np.ndarray, size: int, heads: list[int] | None = None) -> np.ndarray:
        """The sum of work(block, given), arrays of `size` numbers, over all blocks; of some heads only, if they are named. What is given
        is broadcast and removed again, so that passes leave nothing on disk."""
        width, count = self.width, self.count
        shared = self.blocks.sparkSession.sparkContext.broadcast(given)
        which = list(range(count)) if heads is None else heads
        self.passes += 1

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros(size)
            for block in _Block.together(batches, width, count, which):
                total += work(block, shared.value).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "sum"])

        def add(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros(size)
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    total += np.frombuffer(x, dtype=float)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

        parts = self.blocks.mapInArrow(run, "k int, sum binary")
        if size > 1000 and self.blocks.rdd.getNumPartitions() > self.TREE:
            parts = parts.select("sum").repartition(self.TREE).mapInArrow(add, "sum binary")
        try:
            return sum((np.frombuffer(r.sum, dtype=float) for r in parts.select("sum").collect()), np.zeros(size))
        finally:
            shared.destroy()

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """X' (p - y) of each head."""
        return self.sloped(w)[0]

    def sloped(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """X' (p - y) and the sum of p (1 - p) of each head."""

        def work(block, w):
            p = np.where(block.known, _logistic(block.forward(w)), 0.0)
            return np.append(block.back(p - block.y), (p * (1 - p)).sum(axis=0))

        found = self._sum(work, w * self.scale, w.size + self.count)
        return found[: w.size].reshape(w.shape) * self.scale, found[w.size :]

    def curved(self, w: np.ndarray, d: np.ndarray, going: np.ndarray) -> np.ndarray:
        """X' p (1 - p) X d of each head that is going; 0 of others."""
        which = np.flatnonzero(going).tolist()
        both, out = np.hstack((w[:, which], d[:, which])) * self.scale, np.zeros_like(w)

        def work(block, both):
            z, along = np.hsplit(block.forward(both), 2)
            p = _logistic(z)
            return block.back(np.where(block.known, p * (1 - p), 0.0) * along)

        out[:, which] = self._sum(work, both, both.size // 2, which).reshape(len(w), len(which)) * self.scale
        return out

    def stepped(self, w: np.ndarray, d: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps x heads): the summed losses at w + step * d; X' (p - y) and the sum of p (1 - p) of each head at w + d."""
        both, n = np.hstack((w, d)) * self.scale, len(steps) * self.count

        def work(block, both):
            z, along = np.hsplit(block.forward(both), 2)
            losses = [np.where(block.known, np.logaddexp(0, z + t * along) - block.y * (z + t * along), 0.0).sum(axis=0) for t in steps]
            p = np.where(block.known, _logistic(z + along), 0.0)
            return np.concatenate((*losses, block.back(p - block.y).ravel(), (p * (1 - p)).sum(axis=0)))

        found = self._sum(work, both, n + w.size + self.count)
        return found[:n].reshape(len(steps), self.count), found[n : n + w.size].reshape(w.shape) * self.scale, found[n + w.size :]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Subspace:
    """Directions that any head has tried and what its Hessian made of them. The heads' Hessians have the same rows and differ in the curvature
    p (1 - p) only, so, for a curvature of 1 in all, the largest eigenvectors within these directions precondition every head's systems. At
    most MOST directions of the vocabulary's length are held, by the driver."""

    MOST, KEPT = 160, 16

    def __init__(self, width: int):
        self.tried, self.made, self.held = np.empty((self.MOST, width)), np.empty((self.MOST, width)), 0
        self.values, self.vectors = np.zeros(0), self.tried[:0]

    def add(self, s: np.ndarray, made: np.ndarray) -> None:
        """s and X' p (1 - p) X s / sum(p (1 - p)) of one head."""
        if self.held == self.MOST:
            self.close()
        length = np.sqrt(s @ s)
        self.tried[self.held], self.made[self.held] = s / length, made / length
        self.held += 1

    def close(self) -> None:
        """Keep the largest eigenvectors only, from now on in use."""
        s, q = self.tried[: self.held], self.made[: self.held]
        size, turn = np.linalg.eigh(s @ s.T)
        sound = size > 1e-8 * size[-1]
        turn = turn[:, sound] / np.sqrt(size[sound])
        inner = turn.T @ (s @ q.T) @ turn
        values, axes = np.linalg.eigh((inner + inner.T) / 2)
        last = np.flatnonzero(values > 1e-12 * max(values[-1], 0.0))[-self.KEPT :]
        turn = (turn @ axes[:, last]).T
        self.held, self.values = len(last), values[last]
        self.tried[: self.held], self.made[: self.held] = turn @ s, turn @ q
        self.vectors = self.tried[: self.held].copy()

    def apply(self, r: np.ndarray, curve: np.ndarray) -> np.ndarray:
        """r of each head (a column) by the approximate inverse of I + curve * the matrix, but for a factor."""
        if not len(self.values):
            return r
        level = 1 + self.values[:, None] * curve
        return r + self.vectors.T @ ((level[0] / level - 1) * (self.vectors @ r))


def refined(rows: AllRows, w: np.ndarray, c: float, fixed: np.ndarray, most: int = 30) -> np.ndarray:
    """Weights (width + 1, heads) that minimise |w|^2 / 2 + c * sum(loss) over all rows, from w on, by Newton steps for all heads at
    once; heads in `fixed` stay. A pass over the rows for each product, one for each step's length and the gradient there; where w is the
    solution already, two. A step's system is solved as far as the step is likely to be right, as Newton's error is the square of the last."""
    w = w.copy()
    gradient, curve = rows.sloped(w)
    start = rows.sloped(np.zeros_like(w))[0]
    first = np.maximum(c * np.sqrt((start * start).sum(axis=0)), 1e-12)
    space, steps = Subspace(len(w)), 0.5 ** np.arange(12)
    for _ in range(most):
        g = w + c * gradient
        size = np.sqrt((g * g).sum(axis=0))
        active = ~fixed & (size > 2 * TOLERANCE * first)
        if not active.any():
            break
        enough = np.maximum(np.minimum(0.1, size / first) * size, TOLERANCE * first)
        d, r = np.zeros_like(g), np.where(active, -g, 0.0)
        z = space.apply(r, c * curve)
        s, rz, going = z.copy(), (r * z).sum(axis=0), active.copy()
        for _ in range(250):
            going &= np.sqrt((r * r).sum(axis=0)) > enough
            if not going.any():
                break
            made = rows.curved(w, s, going)
            for h in np.flatnonzero(going & (curve > 0)):
                space.add(s[:, h], made[:, h] / curve[h])
            hs = np.where(going, s + c * made, 0.0)
            a = np.where(going, rz / np.where(going, (s * hs).sum(axis=0), 1.0), 0.0)
            d, r = d + a * s, r - a * hs
            z = space.apply(r, c * curve)
            before, rz = rz, np.where(going, (r * z).sum(axis=0), rz)
            s = np.where(going, z + rz / np.where(before > 0, before, 1.0) * s, s)
        losses, ahead, curve_ahead = rows.stepped(w, d, np.concatenate(([0.0], steps)))
        losses = np.stack([((w + t * d) ** 2).sum(axis=0) / 2 for t in (0.0, *steps)]) + c * losses
        good = losses[1:] <= losses[0] + 1e-4 * steps[:, None] * (g * d).sum(axis=0) + 1e-12 * np.abs(losses[0])
        t = np.where(good.any(axis=0), steps[good.argmax(axis=0)], 0.0) * active
        if not t.any():
            break
        w = w + t * d
        gradient, curve = (ahead, curve_ahead) if (t[active] == 1).all() else rows.sloped(w)
        space.close()
    return w


def fitted_on_all(features: DataFrame, labels: DataFrame, heads: tuple[str, ...], width: int, c: float = 1.0, scale: np.ndarray | None = None) -> tuple[DataFrame, AllRows]:
    """(model_id, prevalence, weights) fitted on every row of features(id, columns, values) with labels(id, labels): from the bounded sample's
    solution where that holds all rows, from 0 otherwise, as the solution of a part is no nearer. The prevalence is that of all rows
    too, and one class among them gives null weights. With `scale`, features have the parts and factors that `packed` takes."""
    spark = features.sparkSession
    joined = features.join(labels, "id")
    rows, entries = joined.agg(F.count("*"), F.coalesce(F.sum(F.size("columns")), F.lit(0))).first()
    start = np.zeros((width + 1, len(heads)))
    if rows <= MOST_ROWS and entries <= MOST_ENTRIES:
        started = {r.model_id: r for r in fitted_heads(spark, sampled(joined, heads), heads, width, c).collect()}  # a row for each head
        start = np.stack([np.zeros(width + 1) if started[h].weights is None else np.array(started[h].weights) for h in heads], axis=1)
    shares = {r.model_id: r.p for r in labels.select(F.explode("labels").alias("model_id", "y")).groupBy("model_id").agg(F.avg("y").alias("p")).collect()}
    fixed = np.array([shares.get(h) in (None, 0.0, 1.0) for h in heads])
    found = AllRows(freeze(packed(features, labels, heads), "sparse-blocks", BLOCKS_OF_FILE), width, len(heads), scale)
    w = refined(found, start, c, fixed)
    out = [(h, float(shares.get(h) or 0.0), None if fixed[i] else w[:, i].tolist()) for i, h in enumerate(heads)]
    return spark.createDataFrame(out, "model_id string, prevalence double, weights array<double>"), found


def probabilities(features: DataFrame, fitted: list, id_col: str = "id") -> DataFrame:
    """features(id, columns, values) scored by all heads at once -> (id, p array in the heads' order). The weights are one
    array for each column: vocabulary * heads numbers, which bounds the broadcast."""
    spark = features.sparkSession
    width = max((len(h.weights) for h in fitted if h.weights is not None), default=1)
    matrix = np.array([h.weights if h.weights is not None else np.zeros(width) for h in fitted], dtype=float)
    shared = spark.sparkContext.broadcast((matrix, [None if h.weights is not None else h.prevalence for h in fitted]))

    @F.pandas_udf("array<double>")
    def score(columns, values):
        import pandas as pd

        w, constant = shared.value
        out = []
        for c, v in zip(columns, values, strict=True):
            z = w[:, c] @ v + w[:, -1]
            p = 1 / (1 + np.exp(-z))
            out.append([x if k is None else k for x, k in zip(p.tolist(), constant, strict=True)])
        return pd.Series(out)

    return features.withColumn("p", score(F.col("columns"), F.col("values")))


def dense(features: Column) -> tuple[Column, Column]:
    """columns and values of a dense array."""
    return F.sequence(F.lit(0), F.size(features) - 1).alias("columns"), features.alias("values")
