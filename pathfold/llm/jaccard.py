"""Exact n-gram Jaccard join of documents, and its connected groups, by prefix trees.

1.  Each text becomes its set of distinct n-word shingles (64-bit hashes). Texts with equal sets are one class, named by
    a fingerprint of the set; everything below is about classes.
2.  Shingles are ordered globally: those found to be frequent last, the rest by hash. Which are called frequent only
    steers cost - any total order gives the same answer - so that list may be bounded (HOT) and broadcast. A bitmap of each
    set (a bit or more for a shingle) bounds from above what two sets share: a bit that only one has is a shingle that
    only one has.
3.  Prefix filter: two sets that reach the threshold share a shingle among the first n - ceil(t * n) + 1 of each. Prefixes
    are dealt by shingle; a shingle in one prefix only is dropped.
4.  Round one: classes meet under their first remaining shingle. Those without a class of a near enough size go; a
    prefix-tree join on what is left of the prefixes drops those that cannot reach the threshold with anyone; only the
    others' whole sets are moved, and a prefix-tree join on these links them. Most copies are connected now. Groups
    above TILE are cut into tiles that share an anchor.
5.  Round two: shingles whose classes are not yet all in one component are taken up, one for each distinct list of
    classes, in pairs of tiles, and go the same way. So every pair sharing a prefix shingle is either connected, or met
    in round one, or is judged here: no link is lost.

Nothing is collected but HOT and a few counts. Classes are named by 64-bit fingerprints: n classes collide with
probability n * n / 2**65.

Defined results: a text without words has no shingles and no links; one with fewer than n words has one shingle, its
whole sequence; a document with a null id links others like any, but has no say in a component's id (null where all of its
documents have none); an empty table gives an empty one; repeated rows are copies; one id may have several texts, each
in its own group; other columns, whatever their names, are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.llm.common import dealt_join, discard, materialize, sized
from pathfold.llm.components import components
from pathfold.llm.shingle_trie import NEVER, Trie, Union, required
from pathfold.llm.textvec import Block, blocks, mix
from pathfold.llm.workers import release, tidied

HOT, HOT_LEAST, HOT_LOCAL = 1 << 18, 12, 3
#: Classes and shingles of a tile: what is compared in one place at a time.
TILE, TILE_SHINGLES = 1024, 1 << 19
#: Prefix entries of a bucket, and bytes of sets of a bucket, that one task handles at a time.
BUCKET_ENTRIES, BUCKET_BYTES = 500_000, 4 << 20
_K, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(1 << 63)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes (63 bits) of each text."""
    block = Block(texts).lowered_ascii()
    s, e = block.words()
    if not len(s):
        return [np.empty(0, dtype=np.uint64)] * len(texts)
    word = block.hashes(s, e)
    first, last = np.searchsorted(s, block.starts), np.searchsorted(s, block.ends)
    m = max(len(word) - n + 1, 0)
    acc = mix(word[:m] + _K)
    for j in range(1, n):
        acc = mix(acc * _K + word[j : j + m])
    acc >>= np.uint64(1)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(acc[a : b - n + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64) + _K
            for w in word[a:b]:
                whole = mix(whole * _K + w)
            out.append(whole >> np.uint64(1))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(shingles: np.ndarray) -> bytes:
    """The set's hashes modulo a power of two that is at least its size, as bits."""
    size = 1 << max(6, (len(shingles) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of a group of sets (each a number of 64-bit words that is a power of two), by their lengths."""

    def __init__(self, bits: list[np.ndarray], n: np.ndarray):
        self.bits, self.n = bits, n
        length = np.array([len(x) for x in bits])
        self.own = {w: np.flatnonzero(length == w) for w in np.unique(length).tolist()}
        self.tables = {(w, w): np.stack([bits[i] for i in at]) for w, at in self.own.items()}

    def table(self, words: int, to: int) -> np.ndarray:
        """The bitmaps of `words` words, folded to `to`."""
        if (words, to) not in self.tables:
            self.tables[words, to] = folded(self.table(words, 2 * to))
        return self.tables[words, to]

    def most_shared(self, k: int, ok: np.ndarray) -> np.ndarray:
        """For the sets where ok holds, what they share with set k at most; -1 for the others."""
        most, n = np.full(len(self.n), -1), self.n
        for words, at in self.own.items():
            picked = ok[at]
            if not picked.any():
                continue
            to, mine = min(words, len(self.bits[k])), self.bits[k]
            while len(mine) > to:
                mine = folded(mine)
            theirs, rows = self.table(words, to)[picked], at[picked]
            most[rows] = np.minimum(n[k] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64), n[rows] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
        return most


def folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - (-(-percent * n // 100)) + 1


def _pieces(batches: Iterator, n: int) -> Iterator:
    """(ids, sets) of a few texts at a time."""
    for batch in batches:
        ids = batch.column(0)
        for first, group in blocks(batch.column(1).to_pylist()):
            yield ids.slice(first, len(group)), shingle_sets(group, n), first, batch


def _fingerprints(n: int, local: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size, seen = [], 0, set()

        names = ["kind", "id", "mark", "n", "v", "bits"]

        def frequent(arrays: list[np.ndarray]):
            u, c = np.unique(np.concatenate(arrays), return_counts=True) if arrays else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
            u, c = u[c >= local], c[c >= local]
            none = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), dtype=np.int32)), none, none, pa.array(c.astype(np.int64)), pa.array(u.astype(np.int64)), pa.nulls(len(u), pa.binary())], names=names)

        for ids, sets, first, batch in _pieces(batches, n):
            marks, bits = ([f(x) if len(x) else None for x in sets] for f in (fingerprint, bitmap))
            count = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(count, dtype=np.int32)), ids, batch.column(2).slice(first, count), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks, pa.int64()), pa.array(bits, pa.binary())], names=names)
            for mark, x in zip(marks, sets, strict=True):
                if mark is not None and mark not in seen:
                    seen.add(mark)
                    held.append(x)
                    size += len(x)
            if size > 2_000_000:
                yield frequent(held)
                held, size = [], 0
        yield frequent(held)

    return run


def ordered(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The shingles as signed numbers in the global order: hot ones last, else by hash."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        shingles = np.where(hot[at] == shingles, shingles | _TOP, shingles)
    return np.sort((shingles ^ _TOP).view(np.int64))


def _prefixes(n: int, percent: int, buckets: int, shared):
    """Blobs of (element, class) pairs by bucket; buckets from `buckets` on hold hot elements, dealt by class."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hot, seen = shared.value, set()
        elements, owners, size = [], [], 0

        def flush():
            e, o = np.concatenate(elements), np.concatenate(owners)
            bucket = mix(e.view(np.uint64)) % np.uint64(buckets)
            is_hot = e >= 0
            bucket = np.where(is_hot, np.uint64(buckets) + mix(o.view(np.uint64)) % np.uint64(buckets), bucket).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            e, o, bucket = e[order], o[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            stop = np.append(cut[1:], len(e))
            rows = [(int(bucket[a]), e[a:b].tobytes(), o[a:b].tobytes()) for a, b in zip(cut.tolist(), stop.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "e", "o"])

        for _, sets, *_ in _pieces(batches, n):
            for x in sets:
                if len(x) and (mark := fingerprint(x)) not in seen:
                    seen.add(mark)
                    p = prefix_length(len(x), percent)
                    elements.append(ordered(x, hot)[:p])
                    owners.append(np.full(p, mark, dtype=np.int64))
                    size += p
            if size > 500_000:
                yield flush()
                elements, owners, size = [], [], 0
        if elements:
            yield flush()

    return run


def _shared_elements(buckets: int):
    """Pairs (element, class) whose element has two classes or more; hot elements all stay."""

    def run(key, table):
        import pyarrow as pa

        e = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column("e")])
        o = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column("o")])
        order = np.lexsort((o, e))
        e, o = e[order], o[order]
        new = np.ones(len(e), dtype=bool)
        new[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1])
        e, o = e[new], o[new]
        if key[0].as_py() < buckets and len(e):
            head = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
            many = np.repeat(np.diff(np.append(head, len(e))) > 1, np.diff(np.append(head, len(e))))
            e, o = e[many], o[many]
        release()
        return pa.table({"e": pa.array(e), "sig": pa.array(o)})

    return run


def _ranks(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays with each element replaced by its rank among all of theirs."""
    _, inverse = np.unique(np.concatenate(arrays), return_inverse=True)
    return np.split(inverse.astype(np.int64), np.cumsum([len(x) for x in arrays])[:-1])


def link_sets(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among ascending sets, as many as connect what reaches the threshold."""
    ranks = _ranks(sets)
    tree, size, join, links = Trie(ranks), np.array([len(x) for x in sets]), Union(len(sets)), []
    group = np.arange(len(sets))
    for i in range(len(sets) - 1):
        need = required(size[i], size, percent)
        need = np.where((np.arange(len(sets)) > i) & (group != group[i]) & (need <= np.minimum(size, size[i])), need, NEVER)
        if (need == NEVER).all():
            continue
        found, _ = tree.probe(ranks[i], need)
        for j in found.tolist():
            if join.join(i, j):
                links.append((i, j))
        if len(found):
            group = np.array([join.root(k) for k in range(len(sets))])
    return links


def _groups(table, *names: str):
    """Row ranges of equal keys after sorting by them."""
    keys = [table.column(c).to_numpy() for c in names]
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    head = np.flatnonzero(change)
    return [order[a:b] for a, b in zip(head.tolist(), np.append(head[1:], len(order)).tolist(), strict=True)]


def _verify(percent: int):
    def run(key, table):
        import pyarrow as pa

        sig, blobs, a, b = table.column("sig").to_numpy(), table.column("shingles"), [], []
        for rows in _groups(table, "g", "i", "j"):
            rows = rows[np.unique(sig[rows], return_index=True)[1]]
            if len(rows) > 1:
                for x, y in link_sets([np.frombuffer(blobs[k].as_buffer(), dtype=np.int64) for k in rows.tolist()], percent):
                    a.append(sig[rows[x]])
                    b.append(sig[rows[y]])
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _partners(k: int, i: int, j: int, percent: int, n: np.ndarray, comp: np.ndarray, home: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What row k of a tile pair must share with each row, and which of the rows after it are to be judged against it: in another
    component, not met before, in the other tile of the pair, near enough in size."""
    need = required(n[k], n, percent)
    ok = (np.arange(len(n)) > k) & (comp != comp[k]) & (home != home[k]) & (need <= np.minimum(n, n[k]))
    return need, ok & (block != block[k]) if i != j else ok


_FACTS = ("n", "comp", "home", "block")


def _near_bits(percent: int):
    """Of each tile pair the rows with a partner that their bitmaps allow."""

    def run(key, table):
        import pyarrow as pa

        blobs, picked = table.column("bits"), []
        i_, j_, facts = table.column("i").to_numpy(), table.column("j").to_numpy(), [table.column(c).to_numpy() for c in _FACTS]
        for rows in _groups(table, "g", "i", "j"):
            own = [x[rows] for x in facts]
            if len(rows) < 2 or (own[1] == own[1][0]).all():
                continue
            maps, chosen = Bitmaps([np.frombuffer(blobs[k].as_buffer(), dtype=np.uint64) for k in rows.tolist()], own[0]), np.zeros(len(rows), dtype=bool)
            for k in range(len(rows) - 1):
                need, ok = _partners(k, i_[rows[0]], j_[rows[0]], percent, *own)
                if chosen[k]:
                    ok &= ~chosen
                if ok.any():
                    near = maps.most_shared(k, ok) >= need
                    if near.any():
                        chosen |= near
                        chosen[k] = True
            picked.append(rows[chosen])
        out = table.drop_columns(["bits", "bucket"]).take(pa.array(np.concatenate(picked) if picked else np.empty(0, dtype=np.int64)))
        release()
        return out

    return run


def _candidates(percent: int):
    """Of each tile pair the classes with a partner whose prefixes allow the threshold; a pair is judged only where the element
    is the least that both prefixes hold."""

    def run(key, table):
        import pyarrow as pa

        sig, g = table.column("sig").to_numpy(), table.column("g").to_numpy()
        i_, j_, facts = table.column("i").to_numpy(), table.column("j").to_numpy(), [table.column(c).to_numpy() for c in _FACTS]
        prefixes = table.column("prefix").combine_chunks()
        at, values = prefixes.offsets.to_numpy(), prefixes.values.to_numpy()
        picked = []
        for rows in _groups(table, "g", "i", "j"):
            own = [x[rows] for x in facts]
            if len(rows) < 2 or (own[1] == own[1][0]).all():
                continue
            sets, size = [values[at[k] : at[k + 1]] for k in rows.tolist()], own[0]
            ranks = _ranks(sets)
            tree, rest = Trie(ranks), size - prefix_length(size, percent)
            chosen = np.zeros(len(rows), dtype=bool)
            for k in range(len(rows)):
                need, ok = _partners(k, i_[rows[0]], j_[rows[0]], percent, *own)
                if not ok.any() or (chosen[k] and chosen[ok].all()):
                    continue
                need = np.where(ok, np.maximum(need - np.maximum(rest, rest[k]), 1), NEVER)
                for m in tree.probe(ranks[k], need)[0].tolist():
                    if not (chosen[k] and chosen[m]) and np.intersect1d(sets[k], sets[m], assume_unique=True)[0] == g[rows[0]]:
                        chosen[[k, m]] = True
            picked.append(rows[chosen])
        picked = np.concatenate(picked) if picked else np.empty(0, dtype=np.int64)
        release()
        return pa.table({"g": pa.array(g[picked]), "i": pa.array(i_[picked]), "j": pa.array(j_[picked]), "sig": pa.array(sig[picked])})

    return run


def _tiles() -> Column:
    """Tiles of a group of rows with sizes n."""
    return F.greatest(F.ceil(F.count("*") / F.lit(TILE)), F.ceil(F.sum("n") / F.lit(TILE_SHINGLES))).cast("int")


class JaccardJoin:
    """The steps of the join over rows (doc_id, text)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80):
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        marked = self.docs.withColumn("mark", text_mark(F.col("text")))
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        self.scratch: list[DataFrame] = []
        marks = materialize(marked.mapInArrow(tidied(_fingerprints(words, HOT_LOCAL)), "kind int, id long, mark long, n long, v long, bits binary"), "fingerprints")
        self.rows = marks.where("kind = 0").select(F.col("id").alias("doc_id"), "mark", "n", F.col("v").alias("sig"))
        frequent = marks.where("kind = 1").groupBy("v").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "v").limit(HOT)
        self.hot = self.spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in frequent.select("v").collect()], dtype=np.int64)).view(np.uint64))
        self.classes = materialize(marks.where("kind = 0 and v is not null").groupBy(F.col("v").alias("sig")).agg(F.min("id").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("doc_id"), "mark")).alias("own"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")

    def _cut(self, df: DataFrame, name: str) -> DataFrame:
        """df written to the shared folder until the components are known."""
        self.scratch.append(materialize(df, name))
        return self.scratch[-1]

    def survivors(self) -> DataFrame:
        total = self.classes.agg(F.sum("n")).first()[0] or 0
        buckets = max(8, math.ceil(total * (100 - self.percent) / 100 / BUCKET_ENTRIES))
        blobs = self.docs.mapInArrow(tidied(_prefixes(self.words, self.percent, buckets, self.hot)), "bucket int, e binary, o binary")
        return self._cut(blobs.groupBy("bucket").applyInArrow(_shared_elements(buckets), "e long, sig long"), "prefixes")

    def _whole_sets(self, members: DataFrame) -> DataFrame:
        """members(g, i, j, sig) with the classes' whole sets, in the global order."""
        words, hot = self.words, self.hot

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            seen: set[int] = set()
            for _, sets, *_ in _pieces(batches, words):
                new = {m: x for x in sets if len(x) and (m := fingerprint(x)) not in seen}
                seen |= new.keys()
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([ordered(x, hot.value).tobytes() for x in new.values()], pa.binary())], names=["sig", "shingles"])

        # A class's text is known by id and mark: several texts may have one id, or none.
        wanted = sized(members.select("sig").distinct().join(self.classes, "sig").select("own.doc_id", "own.mark"), "wanted", 1_000_000).alias("w")  # 16 MB of numbers at most
        docs = self.docs.withColumn("mark", text_mark(F.col("text"))).alias("d")
        texts = docs.join(wanted, (F.col("d.mark") == F.col("w.mark")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi").select("doc_id", "text")
        # Repeated rows give a set once a task; the join below and _verify take repeats as one.
        return texts.mapInArrow(tidied(run), "sig long, shingles binary").join(members, "sig")

    def _links(self, members: DataFrame) -> DataFrame:
        """Links within the groups of members(g, i, j, sig)."""
        members = sized(members, "members", 500_000)  # five numbers a row
        total = members.join(self.classes.select("sig", "n"), "sig").agg(F.sum("n")).first()[0] or 0
        buckets = max(8, math.ceil(8 * total / BUCKET_BYTES))
        whole = self._whole_sets(members).withColumn("bucket", F.pmod(F.xxhash64("g", "i", "j"), F.lit(buckets)))
        return materialize(whole.groupBy("bucket").applyInArrow(_verify(self.percent), "a long, b long"), "links")

    def _judged(self, rows: DataFrame, facts: DataFrame) -> DataFrame:
        """Of rows(g, i, j, block, sig, n, comp, home) those whose bitmaps, and then prefixes, leave them a partner: (g, i, j, sig)."""
        rows = self._cut(rows.select("g", "i", "j", "block", "sig", "n", "comp", "home"), "judged")
        bits = rows.join(self.classes.select("sig", "bits"), "sig").withColumn("bucket", self._bucket(rows, F.col("n") / 4 + 64))
        near = self._cut(bits.groupBy("bucket").applyInArrow(_near_bits(self.percent), rows.schema), "near-bits")
        dealt = near.join(facts.select("sig", "prefix"), "sig").withColumn("bucket", self._bucket(near, F.col("n") * (8 * (100 - self.percent) / 100)))
        return dealt.groupBy("bucket").applyInArrow(_candidates(self.percent), "g long, i int, j int, sig long")

    @staticmethod
    def _bucket(rows: DataFrame, size: Column) -> Column:
        """Numbers of buckets of rows(g, i, j, ...) of `size` bytes each, whole tile pairs in each."""
        total = rows.agg(F.sum(size)).first()[0] or 0
        return F.pmod(F.xxhash64("g", "i", "j"), F.lit(max(8, math.ceil(total / BUCKET_BYTES))))

    def _close(self, rows: DataFrame) -> DataFrame:
        """Of rows(g, sig, n, ...) those with a neighbour in g whose size is near enough for the threshold. Sizes that are
        near enough are in the same class of sizes or in neighbouring ones, so only (g, class) sums are compared."""
        percent, width = self.percent, math.log(100 / self.percent) * (1 + 1e-9) if self.percent < 100 else 1e-12
        rows = rows.withColumn("_size", F.floor(F.log("n") / F.lit(width)))
        sums = rows.groupBy("g", "_size").agg(F.count("*").alias("many"), F.min("n").alias("_lo"), F.max("n").alias("_hi"))
        classes = Window.partitionBy("g").orderBy("_size")  # a few dozen classes at most
        above = F.when(F.lead("_size").over(classes) == F.col("_size") + 1, F.lead("_lo").over(classes))
        below = F.when(F.lag("_size").over(classes) == F.col("_size") - 1, F.lag("_hi").over(classes))
        near = sums.withColumns({"_up": above, "_down": below})
        near = near.where((F.col("many") > 1) | (100 * F.col("_hi") >= percent * F.col("_up")) | (100 * F.col("_down") >= percent * F.col("_lo")))
        near = self._cut(near.select("g", "_size", "many", (F.col("many") > 1).alias("_several"), "_up", "_down"), "near-sizes")
        ok = F.col("_several") | (100 * F.col("n") >= percent * F.col("_up")) | (100 * F.col("_down") >= percent * F.col("n"))
        return dealt_join(rows, near, ["g", "_size"], F.col("sig"), TILE).where(ok).drop("_size", "_several", "_up", "_down")

    def _possible(self, rows: DataFrame) -> DataFrame:
        """rows(g, m, times, sig, n, wide, ...) without the lists of two classes that cannot link. These share `times`
        shingles that nobody else has, and at most `wide` others each; beyond their prefixes at most the rest of one."""
        both = Window.partitionBy("g")  # two rows each
        n, least = F.col("n"), F.min("wide").over(both)
        prefix = n - F.ceil(n * self.percent / F.lit(100)) + 1
        need = F.ceil(F.lit(self.percent) * F.sum("n").over(both) / F.lit(100 + self.percent)) - F.max(n - prefix).over(both)
        pairs = rows.where("m = 2").withColumn("_may", F.col("times") + least >= need).where("_may").drop("_may")
        return rows.where("m > 2").unionByName(pairs).drop("m", "times", "wide")

    def links(self) -> DataFrame:
        """Links (a, b) between class fingerprints that connect all classes which reach the threshold."""
        pairs = self.survivors()
        prefixes = pairs.groupBy("sig").agg(F.sort_array(F.collect_list("e")).alias("prefix"))
        facts = self._cut(prefixes.join(self.classes.select("sig", "n"), "sig"), "facts")
        alone = F.xxhash64("sig", F.lit("alone"))

        first = self._cut(self._close(facts.select("sig", "n", F.element_at("prefix", 1).alias("g"))), "round-one-groups")
        sizes = self._cut(first.groupBy("g").agg(F.count("*").alias("many"), _tiles().alias("tiles"), F.min("sig").alias("anchor")), "round-one-sizes")
        own = self._cut(dealt_join(first, sizes, ["g"], F.col("sig"), TILE).select("g", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int").alias("i"), "sig", "n"), "round-one")
        anchors = sizes.where("tiles > 1").select("g", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"), F.col("anchor").alias("sig"))
        anchors = anchors.join(facts.select("sig", "n"), "sig").select("g", "i", "sig", "n")
        met = own.unionByName(anchors).distinct().select("g", "i", F.col("i").alias("j"), F.lit(0).alias("block"), "sig", "n", F.col("sig").alias("comp"), alone.alias("home"))
        one = self._links(self._judged(met, facts))

        grouped = components(one)
        lists = pairs.groupBy("e").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y"))
        kept = lists.groupBy("m", "x", "y").agg(F.min("e").alias("e"), F.count("*").alias("times")).where("m > 1").select("e", "m", "times")
        # An anchor sits in several tiles; its own tile is the one its fingerprint names.
        homes = own.select("sig", F.xxhash64("g", "i").alias("home"))
        wide = pairs.join(lists.where("m > 2").select("e"), "e").groupBy("sig").agg(F.count("*").alias("wide"))
        known = self.classes.select("sig", "n").join(wide, "sig", "left").join(grouped, F.col("sig") == F.col("node"), "left").join(homes, "sig", "left")
        known = known.select("sig", "n", F.coalesce("wide", F.lit(0)).alias("wide"), F.coalesce("component", "sig").alias("comp"), F.coalesce("home", alone).alias("home"))
        joined = pairs.join(kept, "e").join(known, "sig").select(F.col("e").alias("g"), "m", "times", "sig", "n", "wide", "comp", "home")
        labelled = self._cut(self._close(self._cut(self._possible(joined), "possible")), "lists")
        open_ = labelled.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many"), _tiles().alias("tiles")).where("lo <> hi").select("g", "many", "tiles")
        rows = dealt_join(labelled, self._cut(open_, "open"), ["g"], F.col("sig"), TILE).withColumn("block", F.pmod(F.xxhash64("sig", F.lit(2)), F.col("tiles")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = rows.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sig", "n", "comp", "home")
        return one.unionByName(self._links(self._judged(rows, facts)))

    def labelled(self) -> DataFrame:
        """doc_id, mark (of the text), n, comp (the group's name; null without shingles) and component_id for every row."""
        groups = components(self.links())
        named = self.classes.join(groups, F.col("sig") == F.col("node"), "left").select("sig", "rep", F.coalesce("component", "sig").alias("comp"))
        least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
        lookup = materialize(named.join(least, "comp").select("sig", "comp", "component_id"), "components")
        discard(*self.scratch)
        self.scratch.clear()
        return self.rows.join(lookup, "sig", "left").select("doc_id", "mark", "n", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row."""
        return self.labelled().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def text_mark(text: Column) -> Column:
    """64 bits that stand for a text beside its id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links, one's own included."""
    return JaccardJoin(docs, id_col, text_col, words, percent).result()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with the columns of the input: the one with the smallest id (a null one is last), and
    with several texts under that id the one whose text's mark is smallest. Rows go by id and text, so an id's other
    texts stay if they are their own group's first. Documents without shingles are nobody's copy and stay. Of rows
    that repeat both id and text one stays."""
    rows = materialize(JaccardJoin(docs, id_col, text_col, words, percent).labelled().select("doc_id", "mark", "comp").distinct(), "labelled")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    copies = rows.where("comp is not null")
    first = copies.groupBy("comp").agg(F.min(place).alias("first"), F.count("*").alias("many"))
    gone = dealt_join(copies, first, ["comp"], F.col("doc_id"), TILE).where(place != F.col("first")).select("doc_id", "mark").distinct().alias("g")
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("mark")).alias("h")
    left = held.join(gone, F.col("h.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("h.mark") == F.col("g.mark")), "left_anti").select("row.*")
    return left.dropDuplicates([id_col, text_col]) if _repeats(docs, id_col) else left


def _repeats(docs: DataFrame, id_col: str) -> bool:
    return bool(docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
