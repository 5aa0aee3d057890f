"""What the operators of this subpackage share: durable tables, word hashing, deterministic samples."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract are runs of characters outside these separators.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Scratch:
    """Tables of one operator's steps, as Parquet in the shared checkpoint folder, each deleted as soon as it is done with.

    A checkpoint stays until the driver collects its garbage; large steps are better here.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{checkpoint_folder(spark)}/graphloom-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        schema = df.schema
        with _cleanup(self.spark):
            df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete one table, or all."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's own checkpoint folder; where none is named, a temporary one is set on one machine, an error raised on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def _cleanup(spark: SparkSession):
    """Within, the shuffle files of an execution are deleted when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut.

    The folder is the one that the session names in spark.checkpoint.dir. Shuffle files of the steps before are deleted when it is written,
    not when the driver happens to collect its garbage.
    """
    checkpoint_folder(df.sparkSession)
    with _cleanup(df.sparkSession):
        return df.checkpoint(eager=True)


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int = 16, how: str = "left") -> DataFrame:
    """Join `big` with `small`, which has one row for each key, where one key may hold most rows of `big`.

    Rows of a key go to `salts` tasks; `small` is repeated that often, so its size is multiplied by a constant.
    """
    salt = unused(big.columns + small.columns, "salt")[0]
    # the salt follows from the row itself, so that a task run again deals its rows alike
    left = big.withColumn(salt, F.pmod(F.xxhash64(*[c for c, t in big.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, salt], how).drop(salt)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none of `columns` is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and null flags of a string column, without copies of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    nulls = np.asarray(column.is_null()) if column.null_count else np.zeros(n, bool)
    return raw, offs, nulls


#: Ids that may be broadcast, some 5 MB with their keys; more meet the documents in a shuffle.
BROADCAST_IDS = 200_000


def checked_broadcast(ids: DataFrame) -> DataFrame:
    """`ids` (durable, a few columns wide), marked for broadcast only if they are at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


#: Bytes that are handled at once; arrays of eight bytes a character stay under some 30 MB.
PIECE = 1 << 20
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_VALUES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MARKS = _SEP.copy()
_MARKS[:128] = True
for _a, _b in ("09", "AZ", "az"):
    _MARKS[ord(_a) : ord(_b) + 1] = False
_PLAIN_VALUES = np.where(_MARKS, np.uint64(0), _VALUES)
_VALUES[_SEP] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (splitmix64), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64))
    return _POWERS


def word_starts(piece: np.ndarray, plain: bool = False) -> np.ndarray:
    """Where words start in one text or part of a text."""
    sep = (_MARKS if plain else _SEP)[piece]
    word = ~sep
    word[1:] &= sep[:-1]
    return np.flatnonzero(word)


def word_hashes(raw: np.ndarray, fold: bool = True, plain: bool = False) -> np.ndarray:
    """64-bit hashes of the words of one text, in order; A-Z count as a-z if `fold`, ASCII marks as separators if `plain`.

    Long texts are cut at separators into parts of about PIECE bytes, so memory stays bounded by the longest word.
    """
    out, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + PIECE)
        while end < n:  # to the next separator
            stop = np.flatnonzero(_SEP[raw[end : end + 4096]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(n, end + 4096)
        piece = raw[at:end]
        at = end
        starts = word_starts(piece, plain)
        if len(starts):
            own = _FOLD[piece[starts[0] :]] if fold else piece[starts[0] :]
            starts = starts - starts[0]
            spans = np.diff(np.append(starts, len(own)))
            place = np.arange(len(own)) - np.repeat(starts, spans)
            out.append(mix(np.add.reduceat((_PLAIN_VALUES if plain else _VALUES)[own] * _powers(int(spans.max()))[place], starts)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def texts(column: pa.Array):
    """Yield (index, bytes) of a string column's texts; a null text has no bytes."""
    raw, offs, nulls = utf8(column)
    for i in range(len(nulls)):
        yield i, raw[offs[i] : offs[i + 1]] if not nulls[i] else raw[:0]


def small_batches(batches, limit: int = 8 << 20):
    """Arrow batches cut so that none has much more than `limit` bytes; one long row stays whole."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * limit / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


#: Rows of a batch between the JVM and Python. Texts may be very long, so few at once; a batch also ends at BATCH_BYTES.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """`df.mapInArrow` with batches of bounded size: the session's limits on rows and bytes of a batch are lowered, if above,
    and stay so, as plans read them when they run. Batches of Spark's 10,000 rows would be held several times in an executor."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"[^0-9-]", "", conf.get(name)) or 0)
        if not 0 < now <= most:
            conf.set(name, most)
    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, compute, fields: str, carry: list[str], text: str = "text") -> DataFrame:
    """Columns `carry` of `df` with new columns `fields` (DDL), which `compute` makes of Arrow string arrays.

    `compute` gets one pa.Array of texts of a few MB and returns one pa.Array for each field. Rows keep their order in
    a partition; nothing is shuffled. A new column takes the place of one of the same name.
    """
    spark = df.sparkSession
    new = spark.createDataFrame([], fields).schema
    carry = [c for c in carry if c not in new.names]
    own = df.select(*carry, F.col(text).cast("string").alias(unused(df.columns, "text_in")[0]))
    schema = type(new)([*own.schema.fields[:-1], *new.fields])

    def run(batches):
        for batch in small_batches(batches):
            table_ = pa.Table.from_batches([batch])
            made = compute(table_.column(len(carry)).combine_chunks())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], names=[*carry, *new.names])

    return in_arrow(own, run, schema)


def crc_fold(n: int, column: str = "doc_id"):
    """crc32 of a column as text, mod n; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))
