"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get integer numbers of blocks ("seats") by highest quotients target / (2 k + 1). Every source's documents are
dealt to shards by a hash of their id; a second apportionment gives each shard its quota of the source's blocks. In a
shard the documents stand in a seeded order, end to end, and are cut into blocks of `block_tokens` words, or fewer, so that
the smallest source has `least_blocks`: its short last block then weighs little. The quota is spread over the blocks from a
seeded start, so a block is used floor or ceil (quota / blocks) times.

Only one row for each source and each shard comes to the driver: sources are bounded by the weights that a mixture
names, shards by `max_shards`. Shards are windows of bounded size however large one source is.

Defined results: a null or empty text has size 0 and takes 0; null is a source of its own, ordered last; an empty table
gives no rows; repeated rows and equal ids are separate documents, dealt by id and text, so null ids spread over all shards
and reruns take the same words of each text; very long texts are counted whole and may span shards' blocks as any other;
extra columns are ignored, and a column of `keep` that has the name of a result gives way to it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, durable, table, unused

CYCLE = (3.0, 1.0, 2.0)


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size; what is over goes to the others by weight."""
    out, free = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0 and weights[i] > 0]
    left = float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), at most caps[i] each; equal quotients go to the lower index.

    The quotient of the last seat is bracketed first, so only a few seats are dealt one by one whatever their number.
    """
    v = np.asarray(votes, float)
    cap = np.full(len(v), np.iinfo(np.int64).max) if caps is None else np.asarray(caps, np.int64)
    cap = np.where(v > 0, cap, 0)
    seats = int(min(seats, int(min(float(cap.astype(float).sum()), 2.0**62))))
    if seats <= 0:
        return [0] * len(v)

    def at(quotient: float) -> np.ndarray:
        return np.minimum(np.maximum(0, np.floor((v / quotient + 1) / 2)), cap).astype(np.int64)

    high, low = float(v.max()) * 2, float(v[v > 0].min()) / (4.0 * seats + 4)
    for _ in range(200):
        mid = math.sqrt(high * low)
        if at(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    out = at(high)
    heap = [(-v[i] / (2 * out[i] + 1), i) for i in range(len(v)) if out[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < cap[i]:
            heapq.heappush(heap, (-v[i] / (2 * out[i] + 1), i))
    return out.tolist()


def cycle_weights(names: Sequence[str | None]) -> list[float]:
    """3, 1, 2 and again, in the order of the names."""
    return [CYCLE[i % len(CYCLE)] for i in range(len(names))]


def mix_sources(
    docs: DataFrame,
    weights: Callable[[Sequence[str | None]], Sequence[float]] = cycle_weights,
    share: float = 1.5,
    most: float = 2.0,
    block_tokens: int = 32,
    least_blocks: int = 64,
    shard_tokens: int = 1 << 20,
    max_shards: int = 1 << 16,
    seed: int = 17,
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, after the columns named in `keep`.

    `weights` maps the sources, in code point order with null last, to their weights.
    """
    if most > 2:
        raise ValueError("blocks are used twice at most")
    made = ("size", "source_size", "target", "taken")
    keep = [c for c in keep if c not in made]
    inner = unused(list(keep), "print_of_text", "sid", "shard", "parts", "name", "stop", "quota", "blocks")
    mark, sid, shard, n_parts, name, end, n_quota, n_blocks = inner
    sized = durable(docs.select("doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")], F.xxhash64("text").alias(mark), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    # one row for each source; the mixture's own weights are as many
    per = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    per.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    names, sizes = [r["source"] for r in per], [int(r["n"]) for r in per]
    total = sum(sizes)
    aims = targets(sizes, list(weights(names)), share * total, most)
    width = max(shard_tokens, -(-total // max_shards))
    parts = [max(1, -(-n // width)) for n in sizes]

    block_tokens = min(block_tokens, max(1, min((n for n in sizes if n > 0), default=0) // least_blocks))
    spark = docs.sparkSession
    plan = spark.createDataFrame([(i, n, int(s), float(t), int(p)) for i, (n, s, t, p) in enumerate(zip(names, sizes, aims, parts, strict=True))], f"{sid} int, {name} string, source_size long, target double, {n_parts} int")
    # a row for each source, as small as the mixture's weights
    dealt = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col(name))).withColumn(shard, F.pmod(F.xxhash64(F.lit(seed), "doc_id", mark), F.col(n_parts)).cast("int"))
    shards = dealt.groupBy(F.col(sid).alias("sid"), F.col(shard).alias("shard")).agg(F.sum("size").alias("n")).orderBy("sid", "shard").collect()  # at most max_shards and a row for each source

    blocks = [-(-int(r["n"]) // block_tokens) for r in shards]
    by_source: dict[int, list[int]] = {}
    for k, r in enumerate(shards):
        by_source.setdefault(r["sid"], []).append(k)
    room = [2 * sum(blocks[k] for k in by_source.get(i, [])) for i in range(len(names))]
    seats = sainte_lague(aims, round(sum(aims) / block_tokens), room)
    quota = [0] * len(shards)
    for i, own in by_source.items():
        for k, q in zip(own, sainte_lague([int(shards[k]["n"]) for k in own], seats[i], [2 * blocks[k] for k in own]), strict=True):
            quota[k] = q
    quotas = spark.createDataFrame([(int(r["sid"]), int(r["shard"]), int(q), int(b)) for r, q, b in zip(shards, quota, blocks, strict=True)], f"{sid} int, {shard} int, {n_quota} long, {n_blocks} long")

    order = Window.partitionBy(sid, shard).orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", mark), "doc_id", mark, "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn(end, F.sum("size").over(order)).join(F.broadcast(quotas), [sid, shard])
    start, stop = F.col(end) - F.col("size"), F.col(end)
    # uses of blocks 0 .. b - 1 from a seeded start: whole numbers throughout, so reruns agree
    turn = F.pmod(F.xxhash64(F.lit(seed + 2), sid, shard), F.greatest(F.col(n_blocks), F.lit(1)))

    def used(b):
        return F.floor((b * F.col(n_quota) + turn) / F.greatest(F.col(n_blocks), F.lit(1))).cast("long")

    def words_before(x):
        """Words the mix takes of the shard's first x words."""
        b = F.floor(x / F.lit(block_tokens)).cast("long")
        return used(b) * F.lit(block_tokens) + (used(b + 1) - used(b)) * (x - b * F.lit(block_tokens))

    return laid.select(*keep, *[c for c in ("doc_id",) if c not in keep], "size", "source_size", "target", F.when(F.col("size") > 0, words_before(stop) - words_before(start)).otherwise(F.lit(0)).cast("long").alias("taken"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150% of their words."""
    return mix_sources(table(spark, sf_dir, "documents"))
