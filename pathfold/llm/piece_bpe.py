"""SentencePiece BPE encoding and decoding by suffix-array matching.

For each batch the text is cut into segments that no piece crosses (a run of spaces and what follows it; characters
that occur in no longer piece stand alone). Segments not met before are concatenated and indexed: a suffix array over
the first MAX characters of every position, in which each piece's range of occurrences is found by binary search.
The occurrences are the edges of the segments; sorted by position they answer "which piece spans [a, b)". Relaxation
then joins neighbouring tokens along the best edge of each segment (highest score, leftmost first), all segments
at once, until no edge joins two neighbours - the model's merge order. Characters without a piece become bytes.

Models: BPE with identity normalisation, a dummy prefix and byte fallback. Defined results: a null text is the empty
text and has no ids; U+2581 in a text reads as a space, as the model's own alphabet demands; null ids stay; repeated rows
give repeated rows; texts of any length are taken whole, and a long run without spaces is relaxed alone, in linear time; an empty
table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm.textvec import Block, Memo, blocks
from pathfold.llm.workers import release, tidied

SPACE = "▁"
#: Segments longer than this are relaxed one at a time with a heap, not in rounds.
LONG = 64
#: Code points of a batch that is indexed at once.
BATCH_CHARS = 700_000


class PieceBpe:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.max = max(len(self.pieces[i]) for i in normal)
        letters = sorted({c for i in normal for c in self.pieces[i]})
        #: Dense 16-bit letters: 0 ends a segment, 1 is any character without a piece.
        self.letter = np.ones(0x110000, dtype=np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        assert len(letters) < 0xFFFD
        self.lone = np.ones(0x110000, dtype=bool)
        self.lone[[ord(c) for i in normal if len(self.pieces[i]) > 1 for c in self.pieces[i]]] = False
        score = np.array([sp.get_score(i) for i in normal])
        self.ids = np.array(normal, dtype=np.int64)
        self.lengths = np.array([len(self.pieces[i]) for i in normal], dtype=np.int64)
        _, self.rank = np.unique(-score, return_inverse=True)
        grid = np.zeros((len(normal), self.max), dtype=">u2")
        for k, i in enumerate(normal):
            grid[k, : len(self.pieces[i])] = self.letter[[ord(c) for c in self.pieces[i]]]
        self.low = self._keys(grid)
        high = grid.copy()
        high[np.arange(self.max) >= self.lengths[:, None]] = 0xFFFF
        self.high = self._keys(high)
        self.memo = Memo(self._segments)
        self.single = {self.pieces[i]: i for i in normal if len(self.pieces[i]) == 1}

    def _keys(self, grid: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(grid).view(f"S{2 * self.max}").ravel()

    # -- encoding ---------------------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, group in blocks(texts, BATCH_CHARS):
            block = Block([" " + t.replace(SPACE, " ") if t else "" for t in group])
            codes, n = block.codes, len(block.codes)
            space, lone = codes == 32, self.lone[codes]
            lone[space] = False
            start = np.zeros(n + 1, dtype=bool)
            start[1:n] = (space[1:] & ~space[:-1]) | lone[1:] | lone[:-1]
            start[[0, n]] = True
            start[block.starts] = True
            start[block.ends] = True
            at = np.flatnonzero(start)
            s, e = at[:-1], at[1:]
            keep = np.ones(len(s), dtype=bool)
            joint = np.searchsorted(s, block.ends[:-1])
            keep[joint] = False  # the newlines that join the texts
            s, e = s[keep], e[keep]
            ids, size = self.memo.gather(self.memo.rows(block, s, e)) if len(s) else (np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64))
            upto = np.concatenate(([0], np.cumsum(size)))
            first, last = upto[np.searchsorted(s, block.starts)], upto[np.searchsorted(s, block.ends)]
            out += [ids[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        return out

    def edges(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of all pieces in the concatenated segments: sorted keys position * 32 + length, and the index
        of the piece in self.ids."""
        n = len(letters)
        padded = np.concatenate((letters, np.zeros(self.max, dtype=np.uint16)))
        grid = np.lib.stride_tricks.sliding_window_view(padded, self.max)[:n].astype(">u2")
        # Nothing counts beyond the end of a segment.
        zero = np.flatnonzero(letters == 0)
        left = zero[np.minimum(np.searchsorted(zero, np.arange(n)), len(zero) - 1)] - np.arange(n)
        grid[np.arange(self.max) >= left[:, None]] = 0
        keys = self._keys(grid)
        suffixes = np.argsort(keys, kind="stable")
        ordered = keys[suffixes]
        lo, hi = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        found = np.flatnonzero(hi > lo)
        size = (hi - lo)[found]
        begin = np.cumsum(size) - size
        position = suffixes[np.arange(int(size.sum())) + np.repeat(lo[found] - begin, size)]
        piece = np.repeat(found, size)
        key = position * 32 + self.lengths[piece]
        order = np.argsort(key, kind="stable")
        return key[order], piece[order]

    def _segments(self, texts: list[str]) -> list[list[int]]:
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(size + 1) - 1
        letters = self.letter[np.where(codes == 32, ord(SPACE), codes)]
        letters[ends] = 0
        key, piece = self.edges(letters)
        none = np.int64(1) << 40

        def best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Rank of the piece that spans [a, b), or none."""
            want = np.where(b - a <= self.max, a * 32 + (b - a), -1)
            i = np.minimum(np.searchsorted(key, want), len(key) - 1) if len(key) else np.zeros(len(a), dtype=np.int64)
            return np.where(key[i] == want, self.rank[piece[i]], none) if len(key) else np.full(len(a), none)

        made: list[list[int]] = [[] for _ in texts]
        long = size > LONG
        for k in np.flatnonzero(long).tolist():
            made[k] = self._emit_one(codes, self._relax_long(int(ends[k] - size[k]), int(ends[k]), best), key, piece)
        # Tokens of the other segments, in order; `own` is the segment's number.
        active = np.flatnonzero(~long)
        inside = np.repeat(~long, size + 1)
        inside[ends] = False
        a = np.flatnonzero(inside)
        own = np.repeat(np.arange(len(texts)), size + 1)[a]
        b = a + 1
        done_a, done_b, done_own = [], [], []
        joins = np.full(len(a), none, dtype=np.int64)
        joins[:-1] = np.where(own[1:] == own[:-1], best(a[:-1], b[1:]), none)
        while len(a):
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            run = np.diff(np.append(head, len(a)))
            least = np.minimum.reduceat(joins, head)
            still = np.repeat(least < none, run)
            if not still.all():
                done_a.append(a[~still])
                done_b.append(b[~still])
                done_own.append(own[~still])
                a, b, own, joins = a[still], b[still], own[still], joins[still]
                continue
            hit = np.flatnonzero(joins == np.repeat(least, run))
            hit = hit[np.concatenate(([True], own[hit][1:] != own[hit][:-1]))]  # the leftmost of each segment
            b[hit] = b[hit + 1]
            keep = np.ones(len(a), dtype=bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            a, b, own, joins = a[keep], b[keep], own[keep], joins[keep]
            at = moved[hit]
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(a)]
                joins[i] = np.where(own[i] == own[i + 1], best(a[i], b[i + 1]), none)
            joins[-1] = none
        if done_a:
            a, b, own = np.concatenate(done_a), np.concatenate(done_b), np.concatenate(done_own)
            order = np.argsort(a, kind="stable")
            a, b, own = a[order], b[order], own[order]
            want = a * 32 + (b - a)
            i = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            ids = np.where(key[i] == want, self.ids[piece[i]], -1) if len(key) else np.full(len(a), -1)
            known = ids >= 0
            cut = np.searchsorted(own, active)
            stop = np.searchsorted(own, active, "right")
            listed, clean = ids.tolist(), np.concatenate(([0], np.cumsum(~known)))
            for k, x, y in zip(active.tolist(), cut.tolist(), stop.tolist(), strict=True):
                made[k] = listed[x:y] if clean[x] == clean[y] else [j for t in range(x, y) for j in ([listed[t]] if listed[t] >= 0 else self._bytes(codes[a[t]]))]
        return made

    def _bytes(self, code: int) -> list[int]:
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[x] for x in chr(code).encode("utf-8", "surrogatepass")]

    def _relax_long(self, start: int, end: int, best) -> list[tuple[int, int]]:
        none = 1 << 40
        n = end - start
        right = list(range(1, n + 1))  # end of the token that starts here
        left = list(range(-1, n - 1))  # start of the token before
        alive = [True] * n
        spot = np.arange(start, end - 1)
        heap = [(int(r), i, i + 2) for i, r in enumerate(best(spot, spot + 2).tolist()) if r < none]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = right[i]
            if j < n and right[j] - i <= self.max and (r := int(best(np.array([start + i]), np.array([start + right[j]]))[0])) < none:
                heapq.heappush(heap, (r, i, right[j]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or right[j] != stop:
                continue
            alive[j] = False
            right[i] = stop
            if stop < n:
                left[stop] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        out, i = [], 0
        while i < n:
            out.append((start + i, start + right[i]))
            i = right[i]
        return out

    def _emit_one(self, codes: np.ndarray, tokens: list[tuple[int, int]], key: np.ndarray, piece: np.ndarray) -> list[int]:
        out: list[int] = []
        want = np.array([a * 32 + min(b - a, 31) for a, b in tokens])
        i = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        hit = key[i] == want if len(key) else np.zeros(len(want), dtype=bool)
        for (a, _), k, h in zip(tokens, i.tolist(), hit.tolist(), strict=True):
            out += [int(self.ids[piece[k]])] if h else self._bytes(codes[a])
        return out

    # -- decoding ---------------------------------------------------------------------------------------------

    def decode(self, ids) -> str:
        """Text of the ids: pieces joined, byte pieces as UTF-8 (U+FFFD where they are not), the dummy prefix dropped."""
        ids = ids.tolist() if hasattr(ids, "tolist") else list(ids)
        pieces = self.pieces
        if self.byte_of.keys().isdisjoint(ids) and self.silent.isdisjoint(ids):
            text = "".join([pieces[i] for i in ids])
        else:
            parts = []
            for is_byte, run in itertools.groupby((i for i in ids if i not in self.silent), key=self.byte_of.__contains__):
                parts.append(bytes(self.byte_of[i] for i in run).decode("utf-8", "replace") if is_byte else "".join([pieces[i] for i in run]))
            text = "".join(parts)
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, PieceBpe] = {}


def model(path: str) -> PieceBpe:
    """The model of this process; its memo lives as long as the worker."""
    if path not in _models:
        _models[path] = PieceBpe(path)
    return _models[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, piece_ids, round_trip (decoding gives the text again) and, if asked for, the decoded text. One row for
    each row of the input; no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ids = bpe.encode(texts)
                back = [bpe.decode(x) for x in ids]
                same = [(t or "").replace(SPACE, " ") == b for t, b in zip(texts, back, strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                columns = [part.column(0), lists, pa.array(same, pa.bool_())] + [pa.array(back, pa.string())] * decoded
                del texts, ids, back
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece_ids", "round_trip", "decoded"][: len(columns)])
                del lists, columns
                release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, piece_ids array<int>, round_trip boolean" + ", decoded string" * decoded)


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_chars, round_trip; ids stay in the task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ids = bpe.encode(texts)
                back = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array(list(map(len, back)), pa.int64()),
                        pa.array([(t or "").replace(SPACE, " ") == b for t, b in zip(texts, back, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_chars", "round_trip"],
                )
                release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, round_trip boolean")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """doc_id and text of stored ids; a null list is the empty text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidied(run), "doc_id long, text string")
