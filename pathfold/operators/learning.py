"""Learning operators: TF-IDF in relational form, scaling, penalised logistic heads, and their use."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.operators.prep import ranked
from pathfold.sources.storage import freeze

#: Inverse penalties that are tried.
PENALTIES = (0.1, 1.0, 10.0)


#: Code points of texts whose terms are counted at once; a longer text is counted alone.
TERM_CHARS = 2_000_000
#: Documents whose terms are numbered at once.
NUMBERED_ROWS = 500


def _counted(texts: list[str], bigrams: bool):
    """(sizes, terms, tf): the number of distinct terms of each text, and all of them end to end. Words become numbers of a
    dictionary, pairs of neighbours pairs of numbers, and one sort counts them for all texts."""
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    found = [re.findall(r"\w{2,}", t.lower()) for t in texts]
    sizes = np.array([len(x) for x in found])
    coded = pa.array([w for x in found for w in x], pa.string()).dictionary_encode()
    del found
    words, at, own = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), sizes)
    wide = len(words) + 1  # a term is (word, 0) or (word, 1 + next word)
    keys = (own * wide + at) * wide
    if bigrams and len(at) > 1:
        inside = own[1:] == own[:-1]
        keys = np.concatenate((keys, keys[:-1][inside] + 1 + at[1:][inside]))
    keys, tf = np.unique(keys, return_counts=True)
    first, second = keys // wide % wide, keys % wide - 1
    one = words.take(pa.array(first))
    terms = pc.if_else(pa.array(second < 0), one, pc.binary_join_element_wise(one, words.take(pa.array(np.maximum(second, 0))), " ")) if len(keys) else pa.array([], pa.string())
    return np.bincount(keys // wide // wide, minlength=len(texts)), terms, tf


def term_counts(docs: DataFrame, id_col: str, text_col: str, bigrams: bool = True) -> DataFrame:
    """(id, terms, tf): each row's distinct terms with their counts, rows without terms left out. Counting within a document
    needs no shuffle, but Spark's aggregates would make one of all terms; so it is done in Arrow batches where the text is, a few
    megabytes of text at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(ids, texts: list[str]):
            sizes, terms, tf = _counted(texts, bigrams)
            some = np.flatnonzero(sizes)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[some]))), pa.int32())
            return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], names=["id", "terms", "tf"])

        for batch in batches:
            held, first, size = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                if held and size + len(text) > TERM_CHARS:
                    yield out(batch.column(0).slice(first, len(held)), held)
                    held, first, size = [], i, 0
                held.append(text)
                size += len(text)
            if held:
                yield out(batch.column(0).slice(first, len(held)), held)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, terms array<string>, tf array<bigint>")


def vocabulary(counted: DataFrame, min_df: int = 2, max_features: int | None = 50_000) -> DataFrame:
    """(term, df, total): terms in min_df documents or more; of these the max_features most frequent in the corpus, ties by term."""
    each = counted.select(F.inline(F.arrays_zip("terms", "tf"))).groupBy("terms").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    kept = each.orderBy(F.desc("total"), "terms").limit(max_features) if max_features else each
    return kept.select(F.col("terms").alias("term"), "df", "total")


def numbered(counted: DataFrame, words: list[str], idf: np.ndarray | None = None) -> DataFrame:
    """(id, columns, values): counts of the terms in `words` by their places there, in order; with idf their TF-IDF weights, of
    unit length in each document, and what these are made of: a weight is parts * idf * factor. `words` is broadcast: it is a
    vocabulary of bounded size."""
    import pyarrow as pa

    shared = counted.sparkSession.sparkContext.broadcast((pa.array(words, pa.string()), idf))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow.compute as pc

        known, idf = shared.value

        def weigh(columns, counts):
            part = 1 + np.log(counts)
            w = part * idf[columns]
            length = np.sqrt(w @ w) if len(w) else 1.0
            return w / length, part, 1 / length

        for batch in (b.slice(at, NUMBERED_ROWS) for b in batches for at in range(0, b.num_rows, NUMBERED_ROWS)):
            listed, tf = batch.column(1), batch.column(2)
            place = pc.fill_null(pc.index_in(listed.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            count, sizes = tf.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(listed.offsets.to_numpy())
            ends = np.cumsum(sizes)
            columns, values, parts, factors = [], [], [], []
            for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                kept = a + np.flatnonzero(place[a:b] >= 0)
                kept = kept[np.argsort(place[kept])]
                columns.append(place[kept])
                if idf is None:
                    values.append(count[kept])
                    continue
                for listed_, x in zip((values, parts, factors), weigh(place[kept], count[kept]), strict=True):
                    listed_.append(x)
            out = {"id": batch.column(0), "columns": pa.array(columns, pa.list_(pa.int32())), "values": pa.array(values, pa.list_(pa.float64()))}
            if idf is not None:
                out |= {"parts": pa.array(parts, pa.list_(pa.float64())), "factor": pa.array(factors, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = counted.schema["id"].dataType.simpleString()
    more = "" if idf is None else ", parts array<double>, factor double"
    return counted.select("id", "terms", "tf").mapInArrow(run, f"id {kind}, columns array<int>, values array<double>{more}")


@dataclass
class Tfidf:
    """A fitted vocabulary: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of unit length in each document."""

    words: list[str]
    idf: np.ndarray

    @classmethod
    def fit(cls, counted: DataFrame, n: int, min_df: int = 2, max_features: int = 50_000) -> Tfidf:
        """On the counts of n documents. The vocabulary goes to the driver: max_features terms at most."""
        rows = sorted(vocabulary(counted, min_df, max_features).select("term", "df").collect())
        return cls([r[0] for r in rows], np.log((1.0 + n) / (1 + np.array([r[1] for r in rows], dtype=float))) + 1)

    def transform(self, counted: DataFrame) -> DataFrame:
        """(id, columns, values) for every document with a term of the vocabulary or another."""
        return self.apart(counted).select("id", "columns", "values")

    def apart(self, counted: DataFrame) -> DataFrame:
        """The same with parts and factor: a value is part * idf * factor."""
        return numbered(counted, self.words, self.idf)


def tfidf(docs: DataFrame, id_col: str, text_col: str, min_df: int = 2, max_features: int = 50_000, bigrams: bool = True) -> tuple[Tfidf, DataFrame]:
    """The vocabulary fitted on docs, and (id, columns, values) of each document that has a term."""
    counted = freeze(term_counts(docs, id_col, text_col, bigrams), "term-counts")
    fitted = Tfidf.fit(counted, docs.count(), min_df, max_features)
    return fitted, fitted.transform(counted)


def standard_scale(df: DataFrame, fit_on: DataFrame, *columns: str) -> DataFrame:
    """Subtract the mean and divide by the population deviation of fit_on; a constant column is divided by 1."""
    stats = fit_on.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s")) for c in columns}
    return joined.withColumns(scaled).drop(*[f"{c}_{x}" for c in columns for x in "ms"])


def with_intercept(features: Column, label: Column, id_: Column) -> tuple[Column, Column]:
    """Features with a constant in front, and the label; for half of the rows all are negated and the label is flipped. The
    logistic loss is the same, but the constant now varies, so that Spark penalises its weight like any other."""
    flip = F.pmod(F.xxhash64(id_), F.lit(2)) == 1
    signed = F.transform(F.concat(F.array(F.lit(1.0)), features), lambda x: F.when(flip, -x).otherwise(x))
    return signed, F.when(flip, 1 - label).otherwise(label).cast("double")


def fit_head(rows: DataFrame, penalty: float, features_col: str = "features", label_col: str = "label", id_col: str = "id"):
    """L2 logistic regression with a penalised intercept, minimising sum(loss) + |w|^2 / (2 C): (weights, intercept). With one
    class it is a constant: (None, prevalence)."""
    from pyspark.ml.functions import array_to_vector

    n, ones = rows.agg(F.count("*"), F.sum(label_col)).first()
    if not n or ones in (0, n):
        return None, (float(ones) / n if n else 0.0)
    x, y = with_intercept(F.col(features_col), F.col(label_col), F.col(id_col))
    ready = rows.select(array_to_vector(x).alias("x"), y.alias("y"))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / (penalty * n), elasticNetParam=0.0, standardization=False, fitIntercept=False, maxIter=300, tol=1e-10).fit(ready)
    w = model.coefficients.toArray()
    return w[1:], float(w[0])


def head_probability(features: Column, weights, intercept: float) -> Column:
    """1 / (1 + exp(-z)) with z summed in a plain fold, which cross-checks the library's own transform."""
    if weights is None:
        return F.lit(intercept)
    terms_ = F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    z = F.aggregate(terms_, F.lit(intercept), lambda acc, t: acc + t)
    return 1 / (1 + F.exp(-z))


def token_chunks(tokens: Column, size: int) -> Column:
    """Chunks of at most `size` tokens; without tokens one empty chunk."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size))
    return F.transform(starts, lambda s: F.slice(tokens, s, F.lit(size)))


def pooled(rows: DataFrame, owner: str, vector: str, weight: str) -> DataFrame:
    """Weighted mean of an owner's vectors, of unit length; a zero mean is an error."""
    each = rows.select(owner, weight, F.posexplode(vector).alias("i", "x"))
    sums = each.groupBy(owner, "i").agg((F.sum(F.col("x").cast("double") * F.col(weight)) / F.sum(weight)).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(owner)))
    safe = F.when(length > 0, F.col("x") / length).otherwise(F.raise_error(F.lit("a pooled vector has no length")))
    listed = sums.select(owner, F.struct("i", safe.alias("x")).alias("s")).groupBy(owner).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return listed.select(owner, F.transform("s", lambda s: s["x"]).alias(vector))


def profile_folds(rows: DataFrame, group: str, stratum: str, folds: int, seed: int) -> DataFrame:
    """(group, fold): whole groups to folds. Groups with the same rows of each stratum are alike; they are dealt round by a hash,
    beginning at a fold that their profile's hash names, so each fold has as many of them as any other, or one more. Ranks
    are counted within slices of the hash, so no task sees all groups of a profile."""
    each = rows.groupBy(group, stratum).agg(F.count("*").alias("n")).groupBy(group).agg(F.sort_array(F.collect_list(F.concat_ws(":", F.col(stratum), F.col("n").cast("string")))).alias("p"))
    profiles = each.select(group, F.sha2(F.array_join("p", "|"), 256).alias("profile"), F.sha2(F.concat(F.lit(f"{seed}:profile:"), F.col(group)), 256).alias("order"))
    first = F.conv(F.substring("profile", 1, 8), 16, 10).cast("bigint")
    return ranked(profiles, ["profile"], "order", group).select(group, ((first + F.col("rank") - 1) % folds).cast("int").alias("fold"))
