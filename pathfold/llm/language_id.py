"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A text's words (runs of letters, lower-cased) are cut into character n-grams with word borders; each n-gram and each
whole word hashes to one of BUCKETS embeddings. A text is the average of its embeddings; a linear softmax names the
language. Training is plain stochastic gradient descent in numpy on a bounded sample of labelled rows, taken by a hash
of the id from all training rows: at most 1.2 * `per_label` whole texts for each label, and `most_bytes` of them over
all labels (each has an equal share of these, and one text at least). Every label trains; more than `max_labels`
different ones are an error, as the column can hardly hold languages then. A fifth of the sample calibrates: a temperature that minimises its log loss, and the lowest confidence at which the accepted
part reaches PRECISION; predictions below that are marked `rejected`.

Prediction covers every whole text. As the model is linear, the embeddings are multiplied by the softmax weights
once, and a word's contribution is computed once for each distinct word.

Defined results: a null text, or one without letters, is `und` with score 0 and not rejected; rows with a null label
never train; repeated rows agree; ties go to the first label by code point; without any labelled row all are
`und`; very long texts are predicted whole; other columns, whatever their names, are ignored; an empty table gives none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.llm.common import hash_unit
from pathfold.llm.textvec import Block, Memo, blocks
from pathfold.llm.workers import tidied

BUCKET_BITS, DIM, SIZES = 14, 16, (1, 2, 3, 4)
PRECISION = 0.99
UNKNOWN = "und"
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower case."""
    if not _tables:
        n = 0x33000  # no letters are assigned beyond
        _tables.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(n)]))
        _tables.append(np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(n)], dtype=np.uint32))
    return _tables[0], _tables[1]


def _folded(texts: list[str]) -> tuple[Block, np.ndarray, np.ndarray]:
    block = Block(texts)
    is_letter, lower = _letters()
    small = np.minimum(block.codes, len(is_letter) - 1)
    block.codes = lower[small]
    s, e = block.runs(is_letter[small])
    return block, s, e


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of '<word>', word after word, and the number of them for each word."""
    block = Block([f"<{w.lower()}>" for w in words])
    first, last = block.starts, block.ends
    starts, ends, owners = [first + 1], [last - 1], [np.arange(len(words))]
    length = last - first
    for n in SIZES:
        count = np.maximum(length - n + 1, 0)
        own = np.repeat(np.arange(len(words)), count)
        s = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]
        starts.append(s)
        ends.append(s + n)
        owners.append(own)
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    hashes = block.hashes(np.concatenate(starts)[order], np.concatenate(ends)[order])
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.bincount(own, minlength=len(words))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def words(self, words: list[str]) -> list[np.ndarray]:
        """For each word the sum of its weights, then the number of its n-grams."""
        bucket, count = subwords(words)
        sums = np.add.reduceat(self.weights[bucket], np.cumsum(count) - count, axis=0)
        return list(np.column_stack((sums, count)).astype(np.float32))

    def memo(self) -> Memo:
        return Memo(self.words, dtype=np.float32)

    def predict(self, texts: list[str | None], memo: Memo) -> tuple[list[str], np.ndarray]:
        k = len(self.labels)
        names: list[str] = []
        scores: list[np.ndarray] = []
        for _, group in blocks(texts):
            block, s, e = _folded(group)
            total = np.zeros((len(group), k + 1))
            if len(s) and k:
                rows = memo.rows(block, s, e)
                values = memo.flat.reshape(-1, k + 1)[memo.at[rows] // (k + 1)]
                own = block.owner(s)
                head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                total[own[head]] = np.add.reduceat(values.astype(np.float64), head, axis=0)
            known = total[:, -1] > 0
            p = self.probabilities(total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias)
            best = p.argmax(axis=1) if k else np.zeros(len(group), dtype=int)
            names += [self.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            scores.append(np.where(known, p.max(axis=1, initial=0), 0.0))
        return names, np.concatenate(scores) if scores else np.empty(0)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        if not logits.shape[1]:
            return logits
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 12, rate: float = 4.0, batch: int = 32, seed: int = 7) -> Model:
    """Stochastic gradient descent on a four-fifths part of the rows; the rest calibrates."""
    names = sorted(set(labels))
    buckets, rng = 1 << BUCKET_BITS, np.random.default_rng(seed)
    if not names:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0)
    target = np.array([names.index(x) for x in labels])
    rows: list[tuple[np.ndarray, np.ndarray] | None] = []
    held = Memo(lambda words: np.split((got := subwords(words))[0], np.cumsum(got[1])[:-1]))
    for _, group in blocks(texts):
        block, s, e = _folded(group)
        own = block.owner(s)
        row = held.rows(block, s, e) if len(s) else np.empty(0, dtype=np.int64)
        for i in range(len(group)):
            ids, _ = held.gather(row[np.searchsorted(own, i) : np.searchsorted(own, i, "right")])
            if len(ids):
                seen, count = np.unique(ids, return_counts=True)
                rows.append((seen, (count / len(ids)).astype(np.float32)))
            else:
                rows.append(None)
    usable = rng.permutation([i for i, r in enumerate(rows) if r is not None])
    if not len(usable):
        return Model([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0)
    cut = max(1, len(usable) - len(usable) // 5)
    train, check = usable[:cut], usable[cut:]
    table = rng.normal(0, 0.1, (buckets, DIM)).astype(np.float32)
    softmax, bias = np.zeros((DIM, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    # Rare labels count as much as frequent ones.
    share = np.bincount(target[train], minlength=len(names)) / len(train)
    weight = 1 / (np.maximum(share, 1e-9) * max(1, (share > 0).sum()))
    # One embedding moves by the mean gradient of the texts that hold it, so its step must offset the average's 1/n.
    for epoch in range(epochs):
        order = rng.permutation(train)
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = np.zeros((len(part), buckets), dtype=np.float32)
            for k, i in enumerate(part.tolist()):
                x[k, rows[i][0]] = rows[i][1]
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            hidden = x @ table[used]
            z = hidden @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), target[part]] -= 1
            p *= (weight[target[part]] / len(part))[:, None]
            back = p @ softmax.T
            softmax -= step * hidden.T @ p
            bias -= 0.1 * step * p.sum(axis=0)
            table[used] -= 10 * step * (x.T @ back)
    model = Model(names, (table @ softmax).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    if len(check):
        _calibrate(model, [rows[i] for i in check], target[check])
    return model


def _calibrate(model: Model, rows: list, target: np.ndarray) -> None:
    logits = np.array([model.weights[seen].T @ part + model.bias for seen, part in rows])
    losses = []
    grid = np.geomspace(0.05, 20, 60)
    for t in grid:
        model.temperature = float(t)
        losses.append(-np.log(np.maximum(model.probabilities(logits)[np.arange(len(target)), target], 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    p = model.probabilities(logits)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = (p.argmax(axis=1) == target)[order]
    good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= PRECISION)
    model.threshold = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0


def training_sample(
    docs: DataFrame, eligible: Column, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_label: int = 600, max_labels: int = 2000, most_bytes: int = 256 << 20, seed: str = "langid"
) -> tuple[list[str], list[str]]:
    """About per_label rows of each label, drawn by a hash of the id from all eligible rows; what reaches the driver is
    bounded by rows and by bytes, as the module says."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).where(eligible & F.col("text").isNotNull() & F.col("label").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"{label_col} has more than {max_labels} different labels")
    if not counts:
        return [], []
    pairs = [F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_label / n))]
    drawn = rows.withColumn("u", hash_unit(seed, F.col("doc_id").cast("string"))).where(F.col("u") < F.element_at(F.create_map(*pairs), F.col("label")))
    # Repeated ids share their number, so each label's rows are counted as well; the limit holds before the shuffle.
    order = Window.partitionBy("label").orderBy("u", "doc_id", F.octet_length("text"))
    ranked = drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= int(1.2 * per_label))
    so_far = F.sum(F.octet_length("text").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = ranked.withColumn("bytes", so_far).where((F.col("bytes") <= most_bytes // len(counts)) | (F.col("rank") == 1))
    got = sorted(kept.select("u", "doc_id", "text", "label").collect(), key=lambda r: (r[0], r[1], r[2]))
    return [r[2] for r in got], [r[3] for r in got]


def identify(docs: DataFrame, fitted: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; the model travels with the tasks (a table of fixed size)."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        memo = own.memo()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                names, scores = own.predict(part.column(1).to_pylist(), memo)
                refused = (scores < own.threshold) & np.array([x != UNKNOWN for x in names], dtype=bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(refused, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, lang_pred string, score double, rejected boolean")
