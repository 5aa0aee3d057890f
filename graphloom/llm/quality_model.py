"""Quality classifier by attention-based multiple-instance learning, in numpy.

A document is a bag of passages of PASSAGE bytes, all of its text. Each passage is encoded by shares of pairs of character
classes (letters by case, digits, blanks, marks, bytes above ASCII), by how far it repeats itself and by its length. A tanh
layer, gated attention (tanh times sigmoid) and a softmax over the document's passages weigh them; the weighted
representation gives the score. Only document labels are seen in training.

Training sees at most `per_class` labelled documents of either class, the ones with the smallest hash of their id, and at
most `excerpt` characters of each, from a hashed place: a bounded sample. Both bound the fit only; every text is scored whole.

Defined results: a null or empty text is a bag of one empty passage and gets that bag's score; without labels of both classes
all scores are the share of label 1 (0.5 without labels); rows with a null id are scored, never learned from; labels that
disagree on a document count as the smaller one; repeated rows are scored each for itself; very long texts are bags of as
many passages as they have; an empty table gives no rows; extra columns are ignored, or kept as the caller asks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_fold, map_texts, table, texts

PASSAGE = 512
EXCERPT = 8192
CLASSES = 16
PRIOR = 48
LAGS = range(2, 34)
N_FEATURES = CLASSES * CLASSES + 3
HIDDEN, GATE = 24, 12
_CLASS = np.full(256, 15, np.uint8)
_CLASS[128:] = 14
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".", ",;:", "!?", "|/\\", "#$%&*", "<>=+^~", "\"'`", "()[]{}", "-_@"]):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[0] = 15


def passages(raw: np.ndarray) -> np.ndarray:
    """Rows of PASSAGE bytes; the last ends with the text, a short or empty text is one row padded by zeros."""
    n = max(1, -(-len(raw) // PASSAGE))
    out = np.zeros((n, PASSAGE), np.uint8)
    whole = len(raw) // PASSAGE
    out[:whole] = raw[: whole * PASSAGE].reshape(whole, PASSAGE)
    if whole < n:
        tail = raw[-PASSAGE:]
        out[-1, : len(tail)] = tail
    return out


def encode(data: np.ndarray, prior: np.ndarray | float = 0.0) -> np.ndarray:
    """(passages, features): roots of the shares of class pairs, self-similarity at its best lag, length.

    Shares are smoothed by PRIOR characters of the `prior` shares, so a few words don't look like an extreme.
    """
    n = len(data)
    out = np.empty((n, N_FEATURES), np.float32)
    for at in range(0, n, 128):
        d = data[at : at + 128]
        c = _CLASS[d].astype(np.int32)
        pair = c[:, :-1] * CLASSES + c[:, 1:] + (np.arange(len(d), dtype=np.int32) * CLASSES * CLASSES)[:, None]
        real = d[:, 1:] > 0
        counts = np.bincount(pair[real], minlength=len(d) * CLASSES * CLASSES).reshape(len(d), -1)
        size = np.maximum(real.sum(1), 1)
        out[at : at + 128, :-3] = np.sqrt((counts + PRIOR * prior) / (size[:, None] + PRIOR))
        same = np.zeros(len(d), np.float32)
        for lag in LAGS:
            same = np.maximum(same, ((d[:, lag:] == d[:, :-lag]) & real[:, lag - 1 :]).sum(1))
        out[at : at + 128, -3] = same / (size + PRIOR)
        out[at : at + 128, -2] = np.count_nonzero(d, axis=1) / PASSAGE
        out[at : at + 128, -1] = counts[:, CLASSES + 1] / (size + PRIOR)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(p: dict, x: np.ndarray, bag: np.ndarray, n: int):
    """Scores of `n` bags; `bag` gives each passage's bag, in order."""
    h = np.tanh(((x - p["mean"]) / p["std"]) @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    a = (t * s) @ p["a"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, bag, a)
    e = np.exp(a - top[bag])
    weight = e / np.bincount(bag, e, n)[bag]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, bag, weight[:, None] * h)
    return h, t, s, weight, z, _sigmoid(z @ p["out"] + p["bias"][0])


def _gradients(p: dict, fixed: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the mean weighted cross-entropy of the bags (passages `x`, each in its `bag`), with a small decay of `w`."""
    n = len(y)
    h, t, s, w, z, score = _forward(p | fixed, x, bag, n)
    d = (score - y) * weight / n
    dz = d[:, None] * p["out"]
    dh = w[:, None] * dz[bag]
    dw = (h * dz[bag]).sum(1)
    da = w * (dw - np.bincount(bag, w * dw, n)[bag])
    gate = da[:, None] * p["a"]
    dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
    dh += dt @ p["v"].T + ds @ p["u"].T
    dx = dh * (1 - h * h)
    return {"out": z.T @ d, "bias": np.array([d.sum()]), "a": (t * s).T @ da, "v": h.T @ dt, "u": h.T @ ds, "w": ((x - fixed["mean"]) / fixed["std"]).T @ dx + 1e-4 * p["w"], "b": dx.sum(0)}


def train(raws: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 32, rate: float = 0.004, seed: int = 11) -> dict:
    """Parameters from texts and 0/1 labels, by Adam; classes weigh alike. Short parts of the texts are learned too."""
    rng = np.random.default_rng(seed)
    prior = np.square(encode(np.concatenate([passages(r) for r in raws]))[:, :-3]).mean(0) if raws else np.zeros(CLASSES * CLASSES, np.float32)
    parts = []
    for r in raws:
        at, size = rng.integers(0, max(1, len(r) - 40)), rng.integers(8, 200)
        parts.append(r[at : at + size])
    bags, y = [encode(passages(r), prior) for r in [*raws, *parts]], np.concatenate([y, y])
    p = {"w": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATE)), "u": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "out": rng.normal(0, 0.3, HIDDEN), "bias": np.zeros(1)}
    every = np.concatenate(bags) if bags else np.zeros((1, N_FEATURES))
    fixed = {"pairs": prior, "mean": every.mean(0), "std": every.std(0) + 0.02, "prior": float(y.mean()) if len(y) else 0.5, "learned": len(set(y.tolist())) == 2}
    if not fixed["learned"]:
        return p | fixed
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.concatenate([bags[i] for i in pick])
            bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            g = _gradients(p, fixed, x, bag, y[pick], weight[pick])
            step += 1
            for k, q in g.items():
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | fixed


def scores(p: dict, raws: list[np.ndarray]) -> np.ndarray:
    """The score of each text."""
    if not p["learned"]:
        return np.full(len(raws), p["prior"])
    out = []
    for at in range(0, len(raws), 256):
        rows = [passages(r) for r in raws[at : at + 256]]
        bag = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        out.append(_forward(p, encode(np.concatenate(rows), p["pairs"]), bag, len(rows))[-1])
    return np.round(np.concatenate(out), 6) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, learn=None, per_class: int = 500, excerpt: int = EXCERPT) -> dict:
    """The model, trained on labelled documents for which `learn` holds (default: crc32 of the id mod 4 is not 2)."""
    learn = crc_fold(4) != 2 if learn is None else learn
    rank = F.xxhash64(F.lit(7), "doc_id")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learn).select("doc_id", "quality", rank.alias("rank"))
    nearest = known.withColumn("n", F.dense_rank().over(Window.partitionBy("quality").orderBy("rank", "doc_id"))).where(F.col("n") <= per_class)
    chosen = nearest.groupBy("doc_id").agg(F.min("quality").alias("quality"))  # 2 * per_class rows at most
    start = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.greatest(F.length("text") - excerpt, F.lit(1))).cast("int") + 1
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.col("text").substr(start, F.lit(excerpt)).alias("part")).orderBy(rank, "doc_id", "part").limit(4 * per_class).collect()  # in order: rows that repeat an id give the same fit each time
    rows.sort(key=lambda r: (r["doc_id"], r["part"]))
    return train([np.frombuffer(r["part"].encode("utf-8", "replace"), np.uint8) for r in rows], np.asarray([r["quality"] for r in rows], float))


def score_quality(docs: DataFrame, model: dict, carry: list[str], least: float = 0.7) -> DataFrame:
    """Columns `carry` with score and predicted (1 if the score is `least` or more)."""

    def run(column: pa.Array) -> list[pa.Array]:
        s = scores(model, [raw for _, raw in texts(column)])
        return [pa.array(s, pa.float64()), pa.array((s >= least).astype(np.int32), pa.int32())]

    return map_texts(docs, run, "score double, predicted int", carry)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select("doc_id", "text", (F.coalesce(crc_fold(4), F.lit(-1)) == 2).alias("held_out")), model, ["doc_id", "held_out"])
