"""Alignment of two tokenizers over the same texts, with corpus-wide link counts in id-striped dense matrices.

1.  Every text is encoded by both (A byte-level BPE of space + text, B pieces of text), the tokens' bytes are compared with
    space + text, and the byte offsets where tokens end cut the text into segments. A segment is one link: the A and the
    B token that overlap there. Where both end, a group ends. All of this is vectorised over a batch of texts.
2.  A batch's links are sorted by stripe of STRIPE A ids, pair and document, and a row for each stripe holds its pairs, the
    number of documents of each, and documents and occurrences packed to bytes (`packed`). Pairs are counted for the
    batch before anything moves.
3.  Counting: rows go to (stripe, salt); a task adds them with np.add.at into one dense block of STRIPE x |B| counts and
    emits what is not zero; the salts of a stripe are added the same way.
4.  Scoring: a stripe's links and its counts go to the same partition, the counts first. They are put into the dense block, its
    row maxima give the best counts, and the links stream by: for each document the links with a best count and the sum
    of counts. Those are added by batch.

A stripe of a third of all links is dealt over as many tasks as its bytes ask for (SALT_BYTES), each with a block of its own; blocks
are bounded by the vocabularies alone. Counts are of documents, so a pair is held once for each document, with its occurrences.

Defined results: null and empty texts, and texts whose A or B bytes differ from space + text (U+2581 in a text reads as a
space), have no tokens; special tokens' strings are plain text; repeated rows are documents of their own and null ids stay;
texts of any length are taken whole; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm.byte_bpe import encoder
from pathfold.llm.common import materialize
from pathfold.llm.piece_bpe import SPACE, model
from pathfold.llm.workers import release, tidied

#: A ids of a stripe: a dense block has STRIPE x |B| counts of eight bytes.
STRIPE = 256
#: Documents and code points of a batch whose links are sorted at once.
DOCS, CHARS = 512, 1_500_000
#: Packed bytes of links that a task scores.
SALT_BYTES = 16 << 20


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenBytes:
    """Bytes of every id of a vocabulary, end to end."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        total = int(size.sum())
        begin = np.cumsum(size) - size
        return self.flat[np.arange(total) + np.repeat(self.at[ids] - begin, size)]


def spelled(n: int) -> np.ndarray:
    """Decimal numbers below n with what may follow one: ',' at i, '|' at n + i, ';' at 2 * n + i."""
    return np.array([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(n)], dtype=object)


class Pair:
    """Both tokenizers of this process, with what their ids look like."""

    def __init__(self, bpe: str, pieces: str):
        self.a, self.b = encoder(bpe, special_as_text=True), model(pieces)
        alphabet, vocabulary = byte_alphabet(), self.a.tokenizer.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            entries[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.a_bytes = TokenBytes(entries)
        self.b_bytes = TokenBytes([bytes([self.b.byte_of[i]]) if i in self.b.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.b.pieces)])
        self.ids = max(len(entries), len(self.b.pieces))
        self.spelled = spelled(self.ids)


_pairs: dict[tuple[str, str], Pair] = {}


def pair(bpe: str, pieces: str) -> Pair:
    key = (bpe, pieces)
    if key not in _pairs:
        _pairs[key] = Pair(bpe, pieces)
    return _pairs[key]


class Aligned:
    """The tokens, groups and links of some texts. Positions count the bytes of all texts with tokens, end to end."""

    def __init__(self, texts: list[str | None], tok: Pair):
        n = len(texts)
        raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        ids_a, ids_b = tok.a.encode([" " + t if t else "" for t in texts]), tok.b.encode(texts)
        # Bytes of all tokens beside the texts' own; a text with a difference has no tokens.
        want = np.frombuffer(b"".join(raw), dtype=np.uint8)
        size = np.array([len(x) for x in raw], dtype=np.int64)
        good = size > 0
        for ids, table in ((ids_a, tok.a_bytes), (ids_b, tok.b_bytes)):
            flat = np.concatenate(ids) if n else np.empty(0, dtype=np.int64)
            own = np.repeat(np.arange(n), [len(x) for x in ids])
            made = np.bincount(own, weights=table.size[flat], minlength=n).astype(np.int64)
            good &= made == size
            fits = (made == size)[own]
            got, there = table.joined(flat[fits]), np.repeat(made == size, size)
            begin = np.cumsum(np.where(made == size, size, 0))
            wrong = np.flatnonzero(got != want[there])
            good[np.searchsorted(begin, wrong, side="right")] = False
        empty = np.empty(0, dtype=np.int64)
        ids_a, ids_b = [[x if g else empty for x, g in zip(ids, good.tolist(), strict=True)] for ids in (ids_a, ids_b)]
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.concatenate([*ids, empty]).astype(np.int64) for ids in (ids_a, ids_b))
        # Flags on the places of all bytes: where an A or a B token ends.
        doc_ends, total = np.cumsum(np.where(good, size, 0)), int(size[good].sum()) + 1
        ends = np.zeros((2, total), dtype=bool)
        ends[0, np.cumsum(tok.a_bytes.size[self.a])] = ends[1, np.cumsum(tok.b_bytes.size[self.b])] = True
        either, both = ends[0] | ends[1], ends[0] & ends[1]
        per_doc = lambda flags: np.diff(np.cumsum(flags)[doc_ends], prepend=0).astype(np.int64)
        self.n_links, self.n_groups = per_doc(either), per_doc(both)
        cuts = np.flatnonzero(either)
        self.here, shared = ends[:, cuts], both[cuts]
        self.group = np.cumsum(shared) - shared
        own_a, own_b = (np.cumsum(x) - x for x in self.here)
        self.link_a, self.link_b = self.a[own_a], self.b[own_b]
        self.doc = np.repeat(np.arange(n), self.n_links)
        self.shared, self.tok = shared, tok

    def groups(self) -> list[bytes]:
        """'a1,a2|b1;a3|b2,b3' of each text."""
        if not len(self.shared):
            return [b""] * len(self.n_a)
        last = np.flatnonzero(self.shared)
        upto_a, upto_b = (np.cumsum(x)[last] for x in self.here)  # tokens up to the end of each group
        group_a, group_b = (self.group[x] for x in self.here)
        # A's tokens of a group, then B's: a token's place is its own number and that of the other side's before it.
        place_a = np.arange(len(self.a)) + np.concatenate(([0], upto_b))[group_a]
        place_b = np.arange(len(self.b)) + upto_a[group_b]
        said = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        said[place_a], said[place_b] = self.a, self.b
        said[place_a[upto_a - 1]] += self.tok.ids
        said[place_b[upto_b - 1]] += 2 * self.tok.ids
        words = self.tok.spelled[said].tolist()
        upto = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        return [b"".join(words[lo:hi])[:-1] for lo, hi in zip(upto[:-1], upto[1:], strict=True)]

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, doc, occurrences), by pair and document; pair is a * width + b."""
        key = ((self.link_a * width + self.link_b) << 20) | self.doc
        key, many = np.unique(key, return_counts=True)
        return key >> 20, key & ((1 << 20) - 1), many


def pack(values: np.ndarray, kind: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype=kind).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


_ROWS = "batch string, i int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, stripe int, pairs binary, docs binary, many binary, size long"


def aligned(docs: DataFrame, bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Rows of two kinds. With stripe null: a document, by batch and place i, with its figures and the SHA-256 of its groups (the groups
    themselves if `texts`). With a stripe: the batch's packed links there."""

    def batches_of(batches: Iterator) -> Iterator:
        """At most DOCS documents or CHARS code points at once, or one longer text."""
        for batch in batches:
            ids, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held, size = 0, 0
            for i, t in enumerate(texts_):
                if i > held and (i - held >= DOCS or size + len(t or "") > CHARS):
                    yield ids[held:i], texts_[held:i]
                    held, size = i, 0
                size += len(t or "")
            if ids:
                yield ids[held:], texts_[held:]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tok, part = pair(bpe, pieces), TaskContext.get().partitionId()
        width = len(tok.b.pieces)
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _ROWS.split(", ")])
        for number, (ids, texts_) in enumerate(batches_of(batches)):
            it = Aligned(texts_, tok)
            name = f"{part}-{number}"
            said = it.groups()
            rows = {"batch": [name] * len(ids), "i": list(range(len(ids))), "doc_id": ids, "n_a": it.n_a.tolist(), "n_b": it.n_b.tolist(), "n_groups": it.n_groups.tolist(), "n_links": it.n_links.tolist(),
                    "groups": [g.decode() if texts else hashlib.sha256(g).hexdigest() if g else "" for g in said]}
            yield pa.RecordBatch.from_pydict({f.name: pa.array(rows.get(f.name, [None] * len(ids)), f.type) for f in schema}, schema=schema)
            pairs, doc, many = it.links(width)
            del it, said, rows
            stripe = pairs // (STRIPE * width)
            cut = np.flatnonzero(np.diff(np.concatenate(([-1], stripe, [-1]))))
            out: dict[str, list] = {"batch": [], "stripe": [], "pairs": [], "docs": [], "many": [], "size": []}
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own, counts = np.unique(pairs[lo:hi] - int(stripe[lo]) * STRIPE * width, return_counts=True)
                out["batch"].append(name)
                out["stripe"].append(int(stripe[lo]))
                out["pairs"].append(pack(np.concatenate((np.diff(own, prepend=0), counts)), "<u4"))
                out["docs"].append(pack(doc[lo:hi], "<u2"))
                out["many"].append(pack(many[lo:hi], "<u4"))
                out["size"].append(sum(len(out[c][-1]) for c in ("pairs", "docs", "many")))
            yield pa.RecordBatch.from_pydict({f.name: pa.array(out.get(f.name, [None] * len(out["batch"])), f.type) for f in schema}, schema=schema)
            release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), _ROWS)


def _streams(frame: DataFrame, keys: list[str], first: list[str], run, schema: str) -> DataFrame:
    """run over partitions that hold whole keys, whose rows come in the order (keys, first)."""
    return frame.repartition(*keys).sortWithinPartitions(*keys, *first).mapInArrow(tidied(run), schema)


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """(stripe, pairs, counts): packed numbers of documents that hold each pair of a stripe."""

    def added(kind: str):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            key, block = None, np.zeros(STRIPE * width, dtype=np.int64)

            def emit() -> pa.RecordBatch:
                found = np.flatnonzero(block)
                data = pack(np.concatenate((np.diff(found, prepend=0), block[found])), "<i8")
                block[found] = 0
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([data], pa.binary())], names=["stripe", "pairs"])

            for batch in batches:
                for stripe, salt, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if (stripe, salt) != key:
                        if key is not None:
                            yield emit()
                        key = (stripe, salt)
                    both = unpack(data, kind).astype(np.int64)
                    half = len(both) // 2
                    np.add.at(block, np.cumsum(both[:half]), both[half:])
            if key is not None:
                yield emit()

        return run

    salted = _streams(links.select("stripe", "salt", "pairs"), ["stripe", "salt"], [], added("<u4"), "stripe int, pairs binary")
    return _streams(salted.select("stripe", F.lit(0).alias("salt"), "pairs"), ["stripe"], [], added("<i8"), "stripe int, pairs binary")


def scores(links: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """links(stripe, salt, batch, pairs, docs, many) beside counts(stripe, salt, pairs) -> (batch, docs, best, sums), packed: for each
    of the row's documents its links with a best count, and the sum of its links' counts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, block, best, filled = None, np.zeros(STRIPE * width, dtype=np.int64), None, None
        for batch in batches:
            out: list[tuple] = []
            for stripe, salt, name, pairs, docs, many in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                both = unpack(pairs, "<i8" if name is None else "<u4").astype(np.int64)
                half = len(both) // 2
                at = np.cumsum(both[:half])
                if name is None:  # the counts of a key come before its links
                    if filled is not None:
                        block[filled] = 0
                    np.add.at(block, at, both[half:])
                    key, filled, best = (stripe, salt), at, block.reshape(STRIPE, width).max(axis=1)
                    continue
                if (stripe, salt) != key:
                    raise ValueError("links of a stripe without its counts")
                found = np.repeat(block[at], both[half:])
                top = np.repeat(block[at] == best[at // width], both[half:])
                doc, times = unpack(docs, "<u2"), unpack(many, "<u4").astype(np.int64)
                here, place = np.unique(doc, return_inverse=True)
                n_best, total = np.zeros(len(here), dtype=np.int64), np.zeros(len(here), dtype=np.int64)
                np.add.at(n_best, place, np.where(top, times, 0))
                np.add.at(total, place, found * times)
                out.append((name, pack(here, "<u2"), pack(n_best, "<u4"), pack(total, "<i8")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary(), pa.binary()))], names=["batch", "docs", "best", "sums"])

    none = F.lit(None)
    known = counts.select("stripe", "salt", none.cast("string").alias("batch"), "pairs", none.cast("binary").alias("docs"), none.cast("binary").alias("many"))
    both = known.unionByName(links.select(*known.columns))
    return _streams(both, ["stripe", "salt"], [F.col("batch").asc_nulls_first()], run, "batch string, docs binary, best binary, sums binary")


def by_document(found: DataFrame) -> DataFrame:
    """(batch, i, n_best, count_sum): the stripes' figures added; a batch has DOCS documents at most."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name, sums = None, np.zeros((2, DOCS), dtype=np.int64)

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([name] * DOCS, pa.string()), pa.array(np.arange(DOCS), pa.int32()), pa.array(sums[0].copy()), pa.array(sums[1].copy())], names=["batch", "i", "n_best", "count_sum"])
            sums[:] = 0
            return out

        for batch in batches:
            for batch_name, docs, best, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if batch_name != name:
                    if name is not None:
                        yield emit()
                    name = batch_name
                at = unpack(docs, "<u2")
                sums[0, at] += unpack(best, "<u4")
                sums[1, at] += unpack(total, "<i8")
        if name is not None:
            yield emit()

    return _streams(found, ["batch"], [], run, "batch string, i int, n_best long, count_sum long").where(F.col("count_sum") > 0)


def align(docs: DataFrame, bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (or, with `texts`, groups)."""
    rows = materialize(aligned(docs, bpe, pieces, id_col, text_col, texts), "alignment")
    links = rows.where(F.col("stripe").isNotNull())
    loads = links.groupBy("stripe").agg(F.sum("size").alias("size"))
    salts = F.ceil(F.col("size") / F.lit(SALT_BYTES)).cast("int").alias("salts")
    # A row for each stripe, of which there are |A| / STRIPE.
    salted = links.join(F.broadcast(loads.select("stripe", salts)), "stripe").withColumn("salt", F.pmod(F.xxhash64("batch"), F.col("salts")).cast("int"))
    width = len(pair(bpe, pieces).b.pieces)
    counts = materialize(pair_counts(salted, width), "pair-counts").join(F.broadcast(loads.select("stripe", salts)), "stripe")
    counts = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "pairs")
    found = by_document(scores(salted, counts, width))
    out = rows.where(F.col("stripe").isNull()).join(found, ["batch", "i"], "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.col("groups").alias("groups" if texts else "groups_sha256"))
