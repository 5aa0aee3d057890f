"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

1. Counts of all shingles of all documents, in a table of 2 ** SKETCH_BITS hash buckets of fixed size, give the global order:
   shingles of rare buckets first, equal counts by hash. Any order common to all documents is exact; counts only make it quick.
2. Texts with the same set of shingles become one set, kept by its 128-bit key.
3. Each set of n shingles is indexed by its first n - ceil(t n) + 1 shingles; shingles that only one set indexes drop out,
   and of shingles that index the same sets one stays: a pair fails in one such block if it fails in any.
4. In each block (sets that index one shingle) pairs pass the length filter, the positional filter and a suffix filter: the
   Hamming distance of two parity bitmaps is never above the size of the symmetric difference. A bitmap's width follows the
   difference that its set may have, and the wider of two is folded. Blocks are read in a sorted stream.
5. First a block hands on a spanning forest of its surviving pairs, at most as many rows as it has sets. Blocks above `chunk`
   sets are cut into chunks twice, by two hashes, so that most of a large group is connected at linear cost.
6. Pairs are counted exactly on the texts, once each, and links make components. A block with a failed pair between two
   components, or a large one with more than one component, is read again: every component hands on its `few` nearest pairs
   with others; a block that held back a pair comes again with eight times as many, until none holds back. So no link
   that would connect two components is lost, and a pair is handed on only while its ends are not connected, by the first of
   the open blocks that its sets share: if it fails a filter there, it fails for good.
   A large block's main component meets the other sets of the block in pairs of chunks; its own sets are not compared again.
7. Components of the links: a bounded number of links in one task, more by hooking and pointer jumping in tables.

Defined results: null and empty texts, and texts without words, have 0 shingles and are linked with nothing; texts with
fewer words than a shingle count as one shingle; a document with a null id is linked like any other, its component_id is the
smallest id among those it reaches, null if there is none; rows that share an id are judged each by its own text; repeated
rows each come back; an empty table gives no rows; extra columns are ignored. Shingles are compared by a 64-bit hash; very
long texts are hashed in parts of bounded size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast, durable, in_arrow, mix, salted_join, small_batches, table, texts, unused, word_hashes

SMALL = 6
SKETCH_BITS = 20
SKETCH_PART = 12  # bits of a bucket's place in its part of the table
LEAST_BITS = 256
OPEN_LISTED = 64
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(raw: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; a text of fewer words is one shingle."""
    h = word_hashes(raw)
    if not len(h):
        return h
    if len(h) < k:
        return mix(np.asarray([sum(int(x) * int(_ODD[i]) for i, x in enumerate(h)) + len(h) & 0xFFFFFFFFFFFFFFFF], np.uint64))
    n = len(h) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += mix(h[i : i + n] + _ODD[i]) * _ODD[i]
    return np.unique(mix(total))


def _ceil_share(n: int, percent: int) -> int:
    return (n * percent + 99) // 100


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """A class of frequency for each bucket: about four for every doubling of the count. 2 ** SKETCH_BITS bytes at any size."""
    parts, width = 1 << (SKETCH_BITS - SKETCH_PART), 1 << SKETCH_PART

    def count(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in small_batches(batches):
            found = np.concatenate([shingles(raw, k) for _, raw in texts(batch.column(0))])
            counts += np.bincount((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        if counts.any():
            rows = counts.reshape(parts, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([r.astype("<u2" if r.max() < 1 << 16 else "<u8").tobytes() for r in rows], pa.binary())], names=["part", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, "<u2" if len(x) == 2 * width else "<u8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.round(4 * np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())], names=["part", "classes"])

    got = in_arrow(docs.select("text"), count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, classes binary").collect()  # 256 rows of 4 KB
    out = np.zeros((parts, width), np.uint8)
    for r in got:
        out[r["part"]] = np.frombuffer(r["classes"], np.uint8)
    return out.reshape(-1)


def _signature(s: np.ndarray, percent: int = 80) -> bytes:
    """Parities of a set's hashes by bucket; eight buckets at least for each element in which a partner may differ."""
    differ = len(s) * 2 * (100 - percent) // (100 + percent)
    bits = max(LEAST_BITS, 1 << (8 * differ - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sign: np.ndarray, words: int) -> np.ndarray:
    """A parity bitmap, as 64-bit words, of fewer buckets: those that fall together add their parities."""
    while len(sign) > words:
        sign = sign[: len(sign) // 2] ^ sign[len(sign) // 2 :]
    return sign


def _distance(x: bytes, y: bytes) -> int:
    if len(x) != len(y):
        few = min(len(x), len(y)) // 8
        x, y = (_folded(np.frombuffer(z, np.uint64), few).tobytes() for z in (x, y))
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def _fingerprint():
    """With the id, what tells rows of other texts apart before their sets are known."""
    return F.xxhash64("text")


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, print (of the text), n (shingles), set (128-bit key; null if empty), prefix (rare-first) and signature of every document."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(_sketch(docs, words))

    def build(batches):
        order = classes.value
        for batch in small_batches(batches):
            n, keys, prefixes, signs = [], [], [], []
            for _, raw in texts(batch.column(2)):
                s = shingles(raw, words)
                n.append(len(s))
                if len(s):
                    p = len(s) - _ceil_share(len(s), percent) + 1
                    c = order[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    keys.append(_key(s))
                    prefixes.append(s[np.argsort(c, kind="stable")[:p]].view(np.int64))
                    signs.append(_signature(s, percent))
                else:
                    keys.append(None)
                    prefixes.append(None)
                    signs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["doc_id", "print", "n", "set", "prefix", "signature"])

    return in_arrow(_plain(docs), build, "doc_id long, print long, n long, set binary, prefix array<long>, signature binary")


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, print and text, whatever the types of `docs`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", _fingerprint().alias("print"), "text")


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _roots(parent, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(pairs: list[tuple[int, int, int]], m: int) -> list[tuple[int, int]]:
    """Of (distance, x, y) with x < y: for each set the pair with its smallest partner, then what still connects, nearest first.

    Places follow the sets' keys, so blocks with alike members hand on the same pairs.
    """
    parent, out, least = list(range(m)), [], {}
    for _, x, y in pairs:
        if x < least.get(y, m):
            least[y] = x
    for _, x, y in [(0, x, y) for y, x in least.items()] + sorted(pairs):
        u, v = _roots(parent, x), _roots(parent, y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def _nearest(pairs: list[tuple[int, int, int]], comp: list, few: int | None) -> list[tuple[int, int]]:
    """Of (distance, x, y): pairs that are among the `few` nearest of either end's component, or all."""
    if few is None:
        return [(x, y) for _, x, y in pairs]
    out, had = [], {}
    for _, x, y in sorted(pairs):
        u, v = had.get(comp[x], 0), had.get(comp[y], 0)
        if u < few or v < few:
            out.append((x, y))
            had[comp[x]], had[comp[y]] = u + 1, v + 1
    return out


def _few_pairs(n: list, pos: list, sign: list, side: list, percent: int, comp: list | None = None) -> list[tuple[int, int, int]]:
    """Pairs of a handful of sets that pass all filters, without arrays. Bitmaps are bytes, or numbers of equal width."""
    m, near = len(n), []
    for x in range(m - 1):
        for y in range(x + 1, m):
            a, b = n[x], n[y]
            if min(a, b) * 100 < max(a, b) * percent or (side[x] == side[y] != 2) or comp is not None and comp[x] == comp[y]:
                continue
            need = -(-percent * (a + b) // (100 + percent))
            if 1 + min(pos[x], pos[y]) + min(a - 1 - pos[x], b - 1 - pos[y]) < need:
                continue
            far = (sign[x] ^ sign[y]).bit_count() if isinstance(sign[x], int) else _distance(sign[x], sign[y])
            if far <= a + b - 2 * need:
                near.append((far, x, y))
    return near


class _Bitmaps:
    """The bitmaps of sets in the order of their sizes, by width; of two widths the smaller counts."""

    def __init__(self, sign: list[np.ndarray]):
        self.width = np.asarray([len(x) for x in sign])
        self.place = np.zeros((2, len(sign)), np.int64)  # row in the table of a set's own width, and of the width below
        self.tables: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own, wide = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            self.place[0, own], self.place[1, wide] = np.arange(len(own)), len(own) + np.arange(len(wide))
            self.tables[w] = np.stack([sign[k] for k in own] + [_folded(sign[k], w) for k in wide])
        self.sign = sign

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of places i < j."""
        far = np.empty(len(i), np.int32)
        for w, table_ in self.tables.items():
            own = np.flatnonzero((self.width[i] == w) & (self.width[j] <= 2 * w))
            for s in range(0, len(own), max(1, 131_072 // w)):
                k = own[s : s + max(1, 131_072 // w)]
                other = np.where(self.width[j[k]] == w, self.place[0, j[k]], self.place[1, j[k]])
                far[k] = np.bitwise_count(table_[self.place[0, i[k]]] ^ table_[other]).sum(1)
        for k in np.flatnonzero(self.width[j] > 2 * self.width[i]).tolist():  # no such pair passes the length filter at 50 % or more
            far[k] = np.bitwise_count(self.sign[i[k]] ^ _folded(self.sign[j[k]], len(self.sign[i[k]]))).sum()
        return far


def _block_pairs(n: np.ndarray, pos: np.ndarray, sign, side: np.ndarray, percent: int, comp: list | None, few: int | None = None, rows: int = 64) -> list[tuple[int, int]]:
    """Pairs of a block, in the order of its sets' keys, that pass all filters: their forest or, given components, the `few`
    nearest between each and others. `side`: 0 and 1 in a pair of chunks, 2 in a block of its own. `sign`: 64-bit words."""
    m = len(n)
    if m <= SMALL:
        near = _few_pairs(n.tolist(), pos.tolist(), [x.tobytes() for x in sign], side.tolist(), percent, comp)
        return _forest(near, m) if comp is None else _nearest(near, comp, few)
    order = np.argsort(n, kind="stable")
    n, pos, side, maps = n[order], pos[order], side[order], _Bitmaps([sign[k] for k in order.tolist()])
    group = None if comp is None else np.unique(np.asarray(comp, object), return_inverse=True)[1][order]
    least, kept = np.full(m, m), []
    for at in range(0, m - 1, rows):
        i = np.arange(at, min(m, at + rows))
        # the length filter bounds how far a strip reaches
        end = int(np.searchsorted(n, n[i[-1]] * 100 // percent, side="right"))
        j = np.arange(at, end)
        a, b = n[i][:, None], n[j][None]
        need = -(-percent * (a + b) // (100 + percent))
        low = np.minimum(pos[i][:, None], pos[j][None])
        ok = (j[None] > i[:, None]) & (a * 100 >= b * percent) & (1 + low + np.minimum(a - 1 - pos[i][:, None], b - 1 - pos[j][None]) >= need)
        ok &= (side[i][:, None] == 2) | (side[i][:, None] != side[j][None])
        if group is not None:
            ok &= group[i][:, None] != group[j][None]
        p, q = np.nonzero(ok)
        if not len(p):
            continue
        far = maps.distances(i[p], j[q])
        near = far <= a[p, 0] + b[0, q] - 2 * need[p, q]
        x, y = order[i[p[near]]], order[j[q[near]]]
        x, y = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(least, y, x)
        kept.append((far[near], x.astype(np.int32), y.astype(np.int32)))
    if not kept:
        return []
    far, x, y = (np.concatenate(c) for c in zip(*kept, strict=True))
    if comp is not None:
        return _nearest(list(zip(far.tolist(), x.tolist(), y.tolist(), strict=True)), comp, few)
    # pairs that the smallest partners connect already need no second look
    label = np.minimum(np.arange(m), least)
    while True:
        up = label[label]
        if (up == label).all():
            break
        label = up
    open_ = (label[x] != label[y]) | (least[y] == x)
    return _forest(list(zip(far[open_].tolist(), x[open_].tolist(), y[open_].tolist(), strict=True)), m)


_DEALT = ["token", "c0", "c1", "set", "n", "pos", "signature", "side"]


def _first_chunks(blocks: DataFrame, chunk: int) -> DataFrame:
    """A block's rows as they are; of a block above `chunk` sets each row in a chunk by either of two hashes."""
    chunks = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    parts = [F.pmod(F.xxhash64("set"), chunks).cast("int"), chunks + F.pmod(F.xxhash64("set", F.lit(1)), chunks).cast("int")]
    dealt = blocks.withColumn("c0", F.explode(F.when(F.col("size") > chunk, F.array(*parts)).otherwise(F.array(F.lit(0)))))
    return dealt.withColumns({"c1": F.col("c0"), "side": F.lit(2)})


def _main_components(blocks: DataFrame, chunk: int) -> DataFrame:
    """token, main, k: the largest component (comp) of each block above `chunk` sets, and how many of its sets it has."""
    per = blocks.where(F.col("size") > chunk).groupBy("token", "comp").agg(F.count("*").alias("k"))
    return per.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("top")).select("token", F.col("top.comp").alias("main"), F.col("top.k").alias("k"))


def _open_chunks(blocks: DataFrame, main: DataFrame, chunk: int) -> DataFrame:
    """Rows of open blocks (with comp), dealt so that all sets of different components of a block meet.

    A block above `chunk` sets is cut: chunks of its largest component (`main`) meet all chunks of its other sets, and these
    meet each other. A row is dealt to all its chunks at once, so `blocks` is read once for the small and once for the large.
    """
    whole = blocks.where(F.col("size") <= chunk).withColumns({"c0": F.lit(0), "c1": F.lit(0), "side": F.lit(2)})
    own = F.col("comp") == F.col("main")
    chunks = {True: F.ceil(F.col("k") / F.lit(chunk)).cast("int"), False: F.greatest(F.ceil((F.col("size") - F.col("k")) / F.lit(chunk)), F.lit(1)).cast("int")}
    cut = blocks.where(F.col("size") > chunk).join(main, "token").withColumns({"main": own, "ours": F.pmod(F.xxhash64("set"), F.when(own, chunks[True]).otherwise(chunks[False])).cast("int"), "m": chunks[True], "o": chunks[False]})
    ours, others = F.col("ours"), F.sequence(F.lit(0), F.col("o") - 1)

    def to(c0, c1, side):
        return F.struct(c0.alias("c0"), c1.alias("c1"), side.alias("side"))

    # c0 below zero: the main component's chunk (side 0) against one of the others (side 1)
    first = F.transform(others, lambda c: to(-1 - ours, c, F.lit(0)))
    second = F.transform(F.sequence(-F.col("m"), F.lit(-1)), lambda c: to(c, ours, F.lit(1)))
    third = F.transform(others, lambda c: to(F.least(ours, c), F.greatest(ours, c), F.when(c == ours, 2).when(ours < c, 0).otherwise(1)))
    dealt = cut.withColumn("to", F.explode(F.when(F.col("main"), first).otherwise(F.concat(second, third))))
    return whole.unionByName(dealt.select(*blocks.columns, "to.c0", "to.c1", "to.side"))


def _pairs(dealt: DataFrame, percent: int, few: int | None = None) -> DataFrame:
    """token, a, b, more: pairs that the chunks hand on, and whether a chunk holds back some. With a column `comp`, the
    `few` nearest between each component and others; else forests."""
    known = "comp" in dealt.columns
    names = _DEALT + ["comp", "tokens"] * known

    def join(batches):
        held, key = [], None

        def flush():
            cols = list(zip(*held, strict=True))
            sign = [np.frombuffer(x, np.uint64) for x in cols[6]]
            comp = cols[8] if known else None
            got = _block_pairs(np.asarray(cols[4]), np.asarray(cols[5]), sign, np.asarray(cols[7]), percent, comp, few)
            # a chunk holds back nothing if no component has used its share
            used: dict = {}
            if known and few is not None:
                for x, y in got:
                    for c in (comp[x], comp[y]):
                        used[c] = used.get(c, 0) + 1
            more = max(used.values(), default=0) >= (few or 1)
            if known:  # of the open blocks that two sets share one hands them on
                kept = [(x, y) for x, y in got if not cols[9][x] or not cols[9][y] or key[0] == min(set(cols[9][x]).intersection(cols[9][y]))]
                got = kept or [(0, 0)] * more  # a set with itself tells only that more is held back
            return [(key[0], min(cols[3][x], cols[3][y]), max(cols[3][x], cols[3][y]), more) for x, y in got]

        def batch_of(rows):
            t, a, b, more = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(more, pa.bool_())], names=["token", "a", "b", "more"])

        made = []
        for batch in small_batches(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:3] != key:
                    if len(held) > 1:
                        made += flush()
                    held, key = [], row[:3]
                    if len(made) > 4096:
                        yield batch_of(made)
                        made = []
                held.append(row)
        if len(held) > 1:
            made += flush()
        if made:
            yield batch_of(made)

    return dealt.select(names).repartition("token", "c0", "c1").sortWithinPartitions("token", "c0", "c1", "set").mapInArrow(join, "token long, a binary, b binary, more boolean")


def _texts_of(sets: DataFrame, docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """set, text: a text of each of `sets` (set), compressed.

    Few sets are sent to the scan, so other texts are not shuffled; many meet the texts in a shuffle. A text is found by id
    and fingerprint, and is taken only if its shingles are the set's own.
    """
    ends = durable(sets.join(reps.select("set", "row"), "set").select("set", F.col("row.doc_id").alias("id"), F.col("row.print").alias("own")))
    plain = _plain(docs).where(F.col("text").isNotNull())

    def pack(batches):
        for batch in small_batches(batches):
            keys = batch.column(0).to_pylist()
            kept = [(keys[i], zlib.compress(raw.tobytes())) for i, raw in texts(batch.column(1)) if _key(shingles(raw, words)) == keys[i]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.binary()), pa.array([t for _, t in kept], pa.binary())], names=["set", "text"])

    own = plain.join(checked_broadcast(ends), F.col("print").eqNullSafe(F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("set", "text")
    packed = in_arrow(own, pack, "set binary, text binary")
    return packed.groupBy("set").agg(F.min("text").alias("text"))  # rows that are repeated


def _unpacked(text: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(text), np.uint8)


def _verify(pairs: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b, linked for distinct pairs: exact counts on the texts of the sets."""

    def count(batches):
        last: tuple = (None, None)
        for batch in small_batches(batches):
            linked = []
            for key, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if last[0] != key:
                    last = key, shingles(_unpacked(x), words)
                p, q = last[1], shingles(_unpacked(y), words)
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    # few pairs are sent to the texts, which then travel once for each pair; many meet them in a shuffle
    known = checked_broadcast(pairs.select("a", "b"))
    first = held.select(F.col("set").alias("a"), F.col("text").alias("ta")).join(known, "a")
    second = held.select(F.col("set").alias("b"), F.col("text").alias("tb")).join(known, "b")
    return in_arrow(first.join(second, ["a", "b"]).select("a", "b", "ta", "tb"), count, "a binary, b binary, linked boolean")


def components(links: DataFrame, in_one_task: int = 500_000) -> DataFrame:
    """set, comp (the smallest set of its component) of all ends of `links` (a, b).

    Up to `in_one_task` links, some 20 MB, are joined by one task; more by `_components_in_tables`.
    """
    edges = durable(links.select("a", "b").where("a != b").distinct())
    if edges.limit(in_one_task + 1).count() > in_one_task:
        return _components_in_tables(edges)

    def join(batches):
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = sorted((root(a), root(b)))
                parent[v] = u
        if parent:
            names = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([root(x) for x in names], pa.binary())], names=["set", "comp"])

    return durable(edges.repartition(1).mapInArrow(join, "set binary, comp binary"))


def _components_in_tables(edges: DataFrame) -> DataFrame:
    """`components` of any number of distinct edges; rounds grow with the logarithm of a component's length. Each round
    hooks on the smallest neighbouring label and jumps along it."""
    both = durable(edges.select(F.col("a").alias("set"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("set"), F.col("a").alias("to"))))
    labels = durable(both.groupBy("set").agg(F.min("to").alias("m")).select("set", F.least("set", "m").alias("comp")))
    while True:
        # the smallest label among neighbours, offered both to the set and to the label it has now
        offers = both.join(labels.withColumnsRenamed({"set": "to", "comp": "offer"}), "to").join(labels, "set").where("offer < comp")
        new = offers.select("set", "offer").unionByName(offers.select(F.col("comp").alias("set"), "offer"))
        best = new.groupBy("set").agg(F.min("offer").alias("offer"))
        hooked = labels.join(best, "set", "left").select("set", F.least("comp", "offer").alias("next"), "comp")
        jumped = hooked.alias("x").join(hooked.select(F.col("set").alias("next"), F.col("next").alias("far")), "next", "left").select("set", F.least("next", "far").alias("comp"), (F.least("next", "far") < F.col("comp")).alias("moved"))
        labels = durable(jumped)
        if labels.where("moved").isEmpty():
            return labels.select("set", "comp")
        labels = labels.select("set", "comp")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    ends = pairs.join(comp.withColumnsRenamed({"set": "a", "comp": "ca"}), "a", "left").join(comp.withColumnsRenamed({"set": "b", "comp": "cb"}), "b", "left")
    return ends.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _blocks(reps: DataFrame) -> DataFrame:
    """token, size, set, pos: the sets that each shingle indexes, of shingles that index the same sets only the smallest."""
    postings = reps.select("set", F.posexplode("prefix").alias("pos", "token"))
    # a shingle indexes a set once, so two 64-bit sums without carry tell its sets
    shared = postings.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("set")).alias("h"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("g")).where("size > 1")
    kept = durable(shared.groupBy("size", "h", "g").agg(F.min("token").alias("token")).select("token", "size"))
    # one row a token against its sets, in a shuffle at every size: Spark splits a token that most sets share
    return postings.join(kept, "token")


def _linked(steps: Scratch, reps: DataFrame, docs: DataFrame, words: int, percent: int, chunk: int, few: int = 1) -> DataFrame:
    """set, comp of the sets that have links."""
    blocks = steps.table("blocks", _blocks(reps))
    about = reps.select("set", "n", "signature")
    pairs = steps.table("pairs", _pairs(_first_chunks(blocks.join(about, "set"), chunk), percent))
    new = durable(pairs.select("a", "b").distinct())
    told = held = None
    turn = 0
    while True:
        ends = new.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        ends = ends if held is None else durable(ends.join(held.select("set"), "set", "left_anti"))
        if held is None or not ends.isEmpty():
            texts_ = steps.table(f"held{turn}", _texts_of(ends, docs, reps, words))
            held = texts_ if held is None else held.unionByName(texts_)
        found = durable(_verify(new, held, words, percent))
        told = found if told is None else told.unionByName(found)
        comp = components(told.where("linked").select("a", "b"))
        if turn == 0:
            # a failed pair matters only if no other links connect its ends; chunks of a large block may hide one
            failed = _apart(told.where("not linked").select("a", "b"), comp)
            tokens = pairs.join(failed, ["a", "b"], "left_semi").select("token").unionByName(blocks.where(F.col("size") > chunk).select("token")).distinct()
        else:
            tokens = pairs.where("more").select("token").distinct()
        inside = blocks.join(checked_broadcast(durable(tokens)), "token", "left_semi").join(comp, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
        several = durable(inside.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("token"))
        if several.isEmpty():
            return comp
        steps.drop(f"open{turn - 1}")
        open_ = steps.table(f"open{turn}", inside.join(checked_broadcast(several), "token", "left_semi"))
        # a set's open blocks, if few: only these find out which block hands on a pair, others hand on twice
        lists = open_.groupBy("set").agg(F.collect_list("token").alias("tokens")).withColumn("tokens", F.when(F.size("tokens") <= OPEN_LISTED, F.col("tokens")))
        known = steps.table(f"known{turn}", about.join(lists, "set"))  # a row a set, so the rows of the blocks meet one table
        main = checked_broadcast(durable(_main_components(open_, chunk)))
        pairs = steps.table(f"pairs{turn}", _pairs(_open_chunks(open_.join(known, "set"), main, chunk), percent, few))
        steps.drop(f"known{turn}")
        new = durable(pairs.where("a <> b").select("a", "b").distinct().join(told.select("a", "b"), ["a", "b"], "left_anti"))
        turn, few = turn + 1, 8 * few


def _members(docs: DataFrame, words: int, percent: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, print, n and set of each row; and for each set the first row (doc_id, print) and the smallest id of its component."""
    steps = Scratch(docs.sparkSession)
    try:
        wide = steps.table("wide", shingle_sets(docs, words, percent))
        # the smallest row, those without an id last
        row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("row")
        reps = steps.table("reps", wide.where(F.col("set").isNotNull()).groupBy("set").agg(row, F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"), F.any_value("signature").alias("signature")))
        sets = durable(wide.select("doc_id", "print", "n", "set"))
        steps.drop("wide")
        firsts = durable(reps.select("set", "row"))
        comp = _linked(steps, reps, docs, words, percent, chunk)
    finally:
        steps.drop()
    member = firsts.join(comp, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    smallest = member.groupBy("comp").agg(F.min("row").alias("first"))
    return sets, member.select("set", "comp").join(smallest, "comp").select("set", "first")


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, chunk: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text): one component links 100 |x & y| >= percent |x | y|."""
    sets, by_set = _members(docs, words, percent, chunk)
    joined = salted_join(sets.select("doc_id", F.col("n").alias("n_shingles"), "set"), by_set.select("set", F.col("first.doc_id").alias("component_id")), "set")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, chunk: int = 1024) -> DataFrame:
    """One row of each component: that with the smallest doc_id, null last, then the smallest text hash. Texts without words
    stay; of rows that repeat an id and its text one stays."""
    sets, by_set = _members(docs, words, percent, chunk)
    rows = durable(salted_join(sets.select("doc_id", "print", "set"), by_set, "set"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("print") == F.col("first.print"))
    alone = F.col("set").isNull()
    names = unused(docs.columns, "gone_id", "gone_print")
    named = [F.col(c).alias(n) for c, n in zip(("doc_id", "print"), names, strict=True)]
    gone = durable(rows.where(~alone & ~own).select(*named).distinct())
    # rows of one id and text are of one set; those that stay are told by both
    twice = durable(rows.where(F.when(alone, F.col("doc_id").isNotNull()).otherwise(own)).groupBy("doc_id", "print").agg(F.count("*").alias("k")).where("k > 1").select(*named))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col(names[1]))
    kept = docs.join(checked_broadcast(gone), here, "left_anti")
    if twice.isEmpty():
        return kept
    twice = checked_broadcast(twice)
    return kept.join(twice, here, "left_anti").unionByName(kept.join(twice, here, "left_semi").dropDuplicates(["doc_id", "text"]))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under three-word shingles at 90 %."""
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=90)


_W = r"'[^\x20\x09-\x0D]+'"
OP2_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_W}) as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from i join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 90 * (p.n + q.n - k)),
c as (select doc_id as x, doc_id as root from d union select e.y, c.root from c join e on e.x = c.x)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(c.root) as component_id
from d left join n using (doc_id) join c on c.x = d.doc_id group by d.doc_id
"""
