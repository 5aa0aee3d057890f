"""Benchmark decontamination: a BM25 inverted index of the test items with block-max WAND, queried by every passage.

The items are the index's documents, the passages of the training texts its queries. Impacts are BM25 weights divided by
what an item scores against itself, so one threshold holds for all items: the share of an item's weight that a passage holds.
Passages are windows of twice the longest item, each shifted by half, so an item that a text holds lies whole in one of them.
Items stand by length in blocks. For all passages of a text at once, the block maxima of their words are summed, which skips
every block that cannot reach the threshold; in the others WAND pivots retrieve every item above it. Retrieved pairs are
verified on five-word shingles of question and answer or, as an edited word breaks up to five of these, by alignment: an
item whose words need few edits (a word replaced, left out or put in) to stand in the text is held by it. The answer is
aligned by itself only where there is a real one.

The index holds items of at most `index_bytes` of text. A larger benchmark is taken in several such blocks, one pass each,
so what is sent to the executors never grows. Numbers of items, document frequencies and mean length are those of all items
in each, so the blocks don't show in the scores.

Defined results: null and empty texts and items without words match nothing; an item of fewer than five words is one
shingle; equal items match alike; repeated rows give repeated pairs; empty tables on either side give no rows; texts are read
whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_broadcast, durable, in_arrow, mix, small_batches, table, texts, word_hashes

K1, B = 1.2, 0.75
BLOCK = 8
GRAM = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: np.ndarray) -> np.ndarray:
    """Hashes of a text's words, by letters and digits in lower case: marks beside a word don't hide it."""
    return word_hashes(raw, plain=True)


def grams(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of the k-word shingles of word hashes, in order; fewer words are one shingle."""
    if not len(h):
        return h
    k = min(k, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = mix(total * _STEP + h[i : i + len(total)])
    return total


def edits(item: np.ndarray, text: np.ndarray) -> int:
    """The least words to replace, leave out or put in that make the item out of any stretch of the text."""
    ramp = np.arange(len(text) + 1)
    cost = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item):
        put = np.minimum(cost[:-1] + (text != word), cost[1:] + 1)
        cost = np.minimum.accumulate(np.concatenate([[i + 1], put]) - ramp) + ramp
    return int(cost.min())


def allowed(n: int, overlap: float) -> int:
    """Edits under which a part of n words is the same: half of what `overlap` leaves, or two where it leaves as many.

    Texts made from one template differ in more: three words of 21 make another text.
    """
    return min(int((1 - overlap) * n + 1e-9), max(2, int((1 - overlap) / 2 * n + 1e-9)))


class Index:
    """Postings with impacts, block maxima and the shingles to verify by."""

    def __init__(self, items: list[tuple[object, str | None, str | None]], counts: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        """Items are (id, question, answer); without an answer the last third of the words counts as it.

        `counts` are, for a part of a benchmark, those of all items: how many have words, their mean length, words in
        order and how many items hold each.
        """
        self.ids, self.parts, self.sizes, self.whole, words = [], [], [], [], []
        for key, question, answer in sorted(items, key=lambda r: len(r[1] or "") + len(r[2] or "")):  # blocks of alike lengths have tight maxima
            q, a = (words_of(np.frombuffer((x or "").encode("utf-8", "replace"), np.uint8)) for x in (question, answer))
            whole = (q, a) if len(a) else (q,)
            if not len(a):
                cut = len(q) - len(q) // 3
                q, a = q[:cut], q[cut:]
            both = np.concatenate([q, a])
            if len(both):
                self.ids.append(key)
                self.parts.append((np.unique(grams(q)), np.unique(grams(a))))
                self.sizes.append((len(q), len(a)))
                self.whole.append(whole)
                words.append(both)
        n = len(self.ids)
        self.longest = max((len(w) for w in words), default=0)
        self.vocab = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        mean = sum(map(len, words)) / n if n else 1.0
        posts: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        df = np.zeros(len(self.vocab))
        rows = []
        for w in words:
            v, tf = np.unique(np.searchsorted(self.vocab, w), return_counts=True)
            df[v] += 1
            rows.append((v, tf, len(w)))
        if counts:
            n_all, mean, known, held = counts
            df = held[np.searchsorted(known, self.vocab)].astype(float)
        else:
            n_all = n
        idf = np.log(1 + (n_all - df + 0.5) / (df + 0.5))
        for item, (v, tf, length) in enumerate(rows):
            s = idf[v] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            for t, x in zip(v.tolist(), (s / s.sum()).tolist(), strict=True):
                posts[t].append((item, x))
        self.items = [[p[0] for p in post] for post in posts]
        self.impacts = [[p[1] for p in post] for post in posts]
        # block maxima of each term, in one array with a pointer for each term
        self.blocks = max(1, -(-n // BLOCK))
        pointer, block, most = [0], [], []
        for own, impact in zip(self.items, self.impacts, strict=True):
            for item, x in zip(own, impact, strict=True):
                if len(block) > pointer[-1] and block[-1] == item // BLOCK:
                    most[-1] = max(most[-1], x)
                else:
                    block.append(item // BLOCK)
                    most.append(x)
            pointer.append(len(block))
        self.pointer, self.block, self.most = np.asarray(pointer), np.asarray(block, np.int64), np.asarray(most)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocab >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and vocabulary numbers of the words that the index knows."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
        v = np.searchsorted(self.vocab, h[at])
        v[v == len(self.vocab)] = 0
        good = self.vocab[v] == h[at]
        return at[good], v[good]

    def candidates(self, passage: np.ndarray, terms: np.ndarray, count: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose block maxima reach `least`, from distinct (passage, term) pairs of `count` passages."""
        size = self.pointer[terms + 1] - self.pointer[terms]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first - self.pointer[terms], size)
        key = np.repeat(passage, size) * self.blocks + self.block[at]
        if count * self.blocks <= 1 << 20:
            total = np.bincount(key, self.most[at], count * self.blocks)
            found = np.flatnonzero(total >= least - 1e-9)
        else:
            own, back = np.unique(key, return_inverse=True)
            found = own[np.bincount(back, self.most[at]) >= least - 1e-9]
        return found // self.blocks, found % self.blocks

    def within(self, terms: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """Items of one block whose impacts over distinct `terms` sum to `least` or more: WAND, bounded by the block's maxima."""
        low, high = block * BLOCK, (block + 1) * BLOCK
        cursors = []  # item, place, term, bound
        for t in terms:
            own = self.items[t]
            k = bisect_left(own, low)
            if k < len(own) and own[k] < high:
                m = bisect_left(self.block, block, int(self.pointer[t]), int(self.pointer[t + 1]))
                cursors.append([own[k], k, t, self.most[m]])
        out = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[3]
                if total >= least - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            goal = cursors[pivot][0]
            if cursors[0][0] == goal:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors if c[0] == goal)
                if score >= least - 1e-9:
                    out.append((goal, score))
                goal += 1
            for c in cursors:
                own = self.items[c[2]]
                while c[1] < len(own) and own[c[1]] < goal:
                    c[1] += 1
                c[0] = own[c[1]] if c[1] < len(own) else high
            cursors = [c for c in cursors if c[0] < high]
        return out

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items whose impacts over `terms` (distinct) sum to `least` or more."""
        found = self.candidates(np.zeros(len(terms), np.int64), np.asarray(terms, np.int64), 1, least)[1]
        return [x for b in found.tolist() for x in self.within(terms, b, least)]

    def _found(self, at: np.ndarray, v: np.ndarray, starts: np.ndarray, length: int, least: float, chunk: int = 2048):
        """(passage, [(item, score)]) of the passages that retrieve anything. Word `at[i]` of the text is term `v[i]`."""
        low, high = np.searchsorted(at, starts), np.searchsorted(at, starts + length)
        for first in range(0, len(starts), chunk):
            a, size = low[first : first + chunk], high[first : first + chunk] - low[first : first + chunk]
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - a, size)
            own = np.unique(np.repeat(np.arange(len(size)), size) * len(self.vocab) + v[place])
            passage, terms = own // len(self.vocab), own % len(self.vocab)
            hits: dict[int, list[tuple[int, float]]] = {}
            for k, b in zip(*(x.tolist() for x in self.candidates(passage, terms, len(size), least)), strict=True):
                i, j = np.searchsorted(passage, [k, k + 1])
                hits.setdefault(k, []).extend(self.within(terms[i:j].tolist(), b, least))
            for k, found in hits.items():
                if found:
                    yield first + k, found

    def matches(self, h: np.ndarray, least: float, overlap: float) -> list[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word of the passage), the best passage of each item."""
        at, v = self.lookup(h)
        if not len(at):
            return []
        stride = max(32, self.longest)
        starts = np.arange(0, max(1, len(h) - stride), stride)
        best: dict[int, tuple[tuple[int, float, float, float, int], bool]] = {}
        for k, found in self._found(at, v, starts, 2 * stride, least):
            have = np.unique(grams(h[starts[k] : starts[k] + 2 * stride]))
            short: dict[int, np.ndarray] = {}
            for item, score in found:
                shares = []
                for part, size in zip(self.parts[item], self.sizes[item], strict=True):
                    if size < GRAM:
                        if size not in short:
                            short[size] = np.unique(grams(h[starts[k] : starts[k] + 2 * stride], size)) if size else have
                        own = short[size]
                    else:
                        own = have
                    shares.append(float(np.isin(part, own).mean()) if len(part) else 1.0)
                held, near = min(shares) >= overlap, False  # by shingles of this passage alone
                if not held:
                    # an edited copy may be longer than the item, and so than what a passage is sure to hold
                    around = h[max(0, starts[k] - stride // 4 - 1) : starts[k] + 2 * stride + stride // 4 + 1]
                    whole = self.whole[item]
                    if all(np.isin(x, around).mean() >= overlap for x in whole if len(x)):
                        wrong = [edits(x, around) for x in whole]
                        if all(e <= allowed(len(x), overlap) for e, x in zip(wrong, whole, strict=True)):
                            shares = [1 - e / max(len(x), 1) for e, x in zip(wrong, whole, strict=True)] * (3 - len(whole))
                            near = True
                if held or near:
                    row = (item, round(score, 6), round(shares[0], 6), round(shares[1], 6), int(starts[k]))
                    if item not in best or (row[1:4], held) > (best[item][0][1:4], best[item][1]):
                        best[item] = row, held
        return sorted(row for row, _ in best.values())


def _counts(items: DataFrame, part) -> tuple[int, float, DataFrame]:
    """Items with words, their mean length, and a table of each part's words with the number of items that hold them, of all items."""

    def own_words(batches):
        for batch in small_batches(batches):
            parts, words, sizes = [], [], []
            for k, (_, q), (_, a) in zip(batch.column(0).to_pylist(), texts(batch.column(1)), texts(batch.column(2)), strict=True):
                both = np.concatenate([words_of(q), words_of(a)])
                if len(both):
                    own = np.unique(both).view(np.int64)
                    parts += [np.full(len(own), k, np.int32)]
                    words += [own]
                    sizes += [np.append(len(both), np.zeros(len(own) - 1, np.int64))]  # an item's length stands with its first word
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (parts, words, sizes)], names=["part", "word", "size"])

    rows = in_arrow(items.select(part.cast("int").alias("part"), F.col("question").cast("string"), F.col("answer").cast("string")), own_words, "part int, word long, size long")
    words = durable(rows.groupBy("part", "word").agg(F.count("*").alias("n"), F.sum((F.col("size") > 0).cast("long")).alias("items"), F.sum("size").alias("size")))
    total = words.agg(F.sum("items").alias("n"), F.sum("size").alias("size")).first()
    held = words.select("part", "word", F.sum("n").over(Window.partitionBy("word")).alias("n"))  # a word has a row for each part at most
    return total["n"] or 0, (total["size"] or 0) / (total["n"] or 1), durable(held)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, question: str = "text", answer: str | None = None, least: float = 0.75, overlap: float = 0.8, index_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, passage: a row for each document and item that it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage long"
    columns = ["item_id", F.col(question).alias("question"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer")]
    items = benchmark.select(*columns)
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)) + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(size / index_bytes * 1.25)) if size > index_bytes else 1
    out, dealt, counts = None, F.pmod(F.xxhash64("item_id", "question"), F.lit(blocks)), None
    if blocks > 1:
        n, mean, held = _counts(items, dealt)
    for k in range(blocks):
        own = items.where(dealt == k) if blocks > 1 else items
        if blocks > 1:
            rows = held.where(F.col("part") == k).select("word", "n").toArrow()
            word = rows["word"].to_numpy().view(np.uint64)
            order = np.argsort(word)
            counts = n, mean, word[order], rows["n"].to_numpy()[order]
        got = sorted(((r["item_id"], r["question"], r["answer"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0], r[1] or "", r[2] or ""))  # index_bytes at most, give or take a hash
        index = spark.sparkContext.broadcast(Index(got, counts))

        def scan(batches, index=index):
            known = index.value
            for batch in small_batches(batches):
                ids, rows = batch.column(0).to_pylist(), []
                for i, raw in texts(batch.column(1)):
                    if len(raw):
                        rows += [(ids[i], known.ids[m[0]], *m[1:]) for m in known.matches(words_of(raw), least, overlap)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage"])

        part = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item. Rows without an id are never dropped."""
    found = durable(find_contaminated(docs, benchmark).select("doc_id").where(F.col("doc_id").isNotNull()).distinct())
    return docs.join(checked_broadcast(found), "doc_id", "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
