"""Language ID by a byte convolutional network: multi-width filters, max pooling, softmax; trained and run in numpy.

Texts are cut into windows of WINDOW bytes, all of them. For each window the filters of widths 2, 3 and 4 over byte
embeddings are pooled by their maximum; a softmax over the pooled values gives log probabilities, which a document
averages over its windows by their bytes. For prediction the filters are folded into tables over byte pairs, so a
position costs two look-ups.

Training sees at most `per_language` documents of each of the `max_languages` most frequent languages, one excerpt of
`excerpt` characters each, from a hashed place: a bounded sample, chosen by a hash of the id over all documents. These three
parameters bound the fit only; every text is predicted whole. A language beyond the `max_languages` most frequent is not
learned, so a caller with more labelled languages raises the bound.

The pipeline's stage asks the same network for texts that show no language: there it learns two classes more from made texts,
NOTHING (random letters, digits and keys) and OTHER (made languages of syllables in several scripts, so that a language without
labels is not taken for nothing). A text goes if the odds of its windows for NOTHING are together ODDS to one, on their
geometric mean SHOWN to one, and none of them is SHOWN to one against it, so a text that holds a language somewhere stays. A text without a window of `LEAST_BYTES` bytes is
too short to tell and stays. Without any labels only texts without a letter go.

Defined results: a null or empty text, or one without any letter, is `und` with score 0; null languages and null ids are
never learned from; no labelled rows at all make every text `und`; a single language is learned as such; repeated rows
are judged each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_fold, map_texts, table, texts, unused

WINDOW = 256
EXCERPT = 1024
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
UNDETERMINED = "und"
NOTHING, OTHER = "\0nothing", "\0other"
LEAST_BYTES = 64
ODDS = 1000
SHOWN = 9
_KINDS = [  # letters, and how long their runs are
    ("0123456789abcdef", 24, 80), (string.ascii_letters + "0123456789+/", 40, 200), (string.ascii_lowercase, 1, 14),
    (string.ascii_letters + "0123456789", 4, 24), ("asdfghjkl;qwertyuiop", 3, 20), (string.ascii_uppercase + "0123456789", 8, 40),
]
_SCRIPTS = [  # vowels and consonants; the first two count most, as runs of NOTHING are Latin too
    ("aeiou", "bcdfghjklmnprstvwz"), ("aeiouyäöåáéíóúüâêôőűąęõ", "bcdfghjklmnpqrstvwxzčšžłńśćżđğışţ"), ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
    ("аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"), ("אוי", "בגדהחטכלמנספצקרשת"), ("اوي", "بتثجحخدذرزسشصطعفقكلمنه"),
    ("ािीुूेैो", "कखगघचछजझटडणतदधनपफबभमयरलवशसह"), ("あいうえおかきくけこさしすせそ", "日本語中国人大学生時間私山川田"),
    ("的一是不了", "人我在有他这为之大来以个中上们"),
]


def windows(raw: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """All bytes of a text as rows of `length` bytes, the last one padded by zeros."""
    n = -(-len(raw) // length)
    out = np.zeros(n * length, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, length)


def _columns(x: np.ndarray, w: int) -> np.ndarray:
    """(batch, length, dim) to (batch, length - w + 1, w * dim)."""
    n = x.shape[1] - w + 1
    return np.concatenate([x[:, k : k + n] for k in range(w)], axis=2)


def train(samples: list[tuple[bytes, str]], steps: int = 260, batch: int = 48, rate: float = 0.01, seed: int = 5) -> dict:
    """Parameters of the network from (text bytes, language) pairs, by Adam on cross-entropy; the same for the same pairs."""
    names = sorted({lang for _, lang in samples})
    rows, labels = [], []
    for text, lang in samples:
        for w in windows(np.frombuffer(text, np.uint8)):
            if np.count_nonzero(w) >= 16 or len(text) < 16:
                rows.append(w)
                labels.append(names.index(lang))
    rng = np.random.default_rng(seed)
    p = {"emb": rng.normal(0, 0.5, (256, DIM)).astype(np.float32), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(names)))).astype(np.float32), "bias": np.zeros(max(1, len(names)), np.float32)}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32)
        p[f"b{w}"] = np.zeros(FILTERS, np.float32)
    if len(names) > 1 and rows:
        data, y = np.stack(rows), np.asarray(labels)
        by = [np.flatnonzero(y == k) for k in range(len(names))]
        by = [b for b in by if len(b)]
        m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by])  # languages are seen alike often
            grads = _gradients(p, data[pick], y[pick])
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {"names": names, **p}


def _gradients(p: dict, data: np.ndarray, y: np.ndarray) -> dict:
    x = p["emb"][data]
    n, who = len(data), np.arange(len(data))
    cols, best, pooled = {}, {}, []
    for w in WIDTHS:
        cols[w] = _columns(x, w)
        z = cols[w] @ p[f"w{w}"] + p[f"b{w}"]
        best[w] = z.argmax(1)
        pooled.append(np.maximum(np.take_along_axis(z, best[w][:, None], 1)[:, 0], 0))
    h = np.concatenate(pooled, 1)
    logits = h @ p["out"] + p["bias"]
    e = np.exp(logits - logits.max(1, keepdims=True))
    d = e / e.sum(1, keepdims=True)
    d[who, y] -= 1
    d /= n
    g = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
    back = (d @ p["out"].T) * (h > 0)
    for i, w in enumerate(WIDTHS):
        own = back[:, i * FILTERS : (i + 1) * FILTERS]
        at = cols[w][who[:, None], best[w]]  # (batch, filters, w * dim)
        g[f"w{w}"] = np.einsum("bf,bfd->df", own, at)
        g[f"b{w}"] = own.sum(0)
        flow = np.einsum("bf,df->bfd", own, p[f"w{w}"])
        for k in range(w):
            np.add.at(g["emb"], data[who[:, None], best[w] + k], flow[:, :, k * DIM : (k + 1) * DIM])
    return g


@functools.lru_cache(maxsize=1)
def made_texts(n: int = 150) -> list[tuple[bytes, str]]:
    """`n` texts each of NOTHING and OTHER, the same each time."""
    rng, out = np.random.default_rng(7), []
    for i in range(n):
        letters, low, high = _KINDS[i % len(_KINDS)]
        runs = [rng.choice(list(letters), rng.integers(low, high + 1)) for _ in range(2 * EXCERPT // (low + high) + 1)]
        out.append(((" " if rng.random() < 0.7 else "\n").join("".join(x) for x in runs)[:EXCERPT].encode(), NOTHING))
    for i in range(n):
        vowels, consonants = (rng.permutation(list(x))[: rng.integers(len(x) // 2, len(x)) + 1] for x in _SCRIPTS[i % 3 if i % 3 < 2 else 2 + i // 3 % (len(_SCRIPTS) - 2)])
        v, c = rng.dirichlet(np.ones(len(vowels))), rng.dirichlet(np.ones(len(consonants)))
        closed = 0.6 * rng.random()
        words = []
        for _ in range(120):
            syllables = rng.integers(1, 5)
            several = rng.random((syllables, 4)) < (0.85, 0.15, 0.12, closed)
            v_, c_ = rng.choice(vowels, (syllables, 2), p=v), rng.choice(consonants, (syllables, 3), p=c)
            letters, used = np.column_stack([c_[:, :2], v_, c_[:, 2]]), np.insert(several, 2, True, 1)
            words.append("".join(letters[used]))
        share = 1 / np.arange(1, len(words) + 1)
        out.append((" ".join(rng.choice(words, 260, p=share / share.sum())).capitalize()[:EXCERPT].encode(), OTHER))
    return out


_FOLDED: dict = {}


def _fold(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Tables over pairs of bytes: what the first two, and the next two, bytes add to every filter."""
    key = p["emb"].tobytes()[:64] + p["w4"].tobytes()[:64]
    if key not in _FOLDED:
        part = lambda w, k: p["emb"] @ p[f"w{w}"][k * DIM : (k + 1) * DIM]
        first = np.concatenate([(part(w, 0)[:, None] + part(w, 1)[None] + p[f"b{w}"]).reshape(65536, FILTERS) for w in WIDTHS], 1)
        third = np.broadcast_to(part(3, 2)[:, None], (256, 256, FILTERS)).reshape(65536, FILTERS)
        last = (part(4, 2)[:, None] + part(4, 3)[None]).reshape(65536, FILTERS)
        _FOLDED.clear()
        _FOLDED[key] = np.ascontiguousarray(first), np.ascontiguousarray(np.concatenate([third, last], 1))
    return _FOLDED[key]


def log_probabilities(p: dict, data: np.ndarray, block: int = 32) -> np.ndarray:
    """(windows, languages) log probabilities, `block` windows at a time."""
    first, rest = _fold(p)
    out = np.empty((len(data), len(p["bias"])), np.float32)
    for at in range(0, len(data), block):
        w = data[at : at + block].astype(np.int32)
        pair = w[:, :-1] * 256 + w[:, 1:]
        a = first.take(pair, axis=0)  # (block, length - 1, 48): position i
        b = rest.take(pair, axis=0)  # what position i + 2 adds
        pooled = np.concatenate(
            [
                a[:, :, :FILTERS].max(1),
                (a[:, :-1, FILTERS : 2 * FILTERS] + np.concatenate([b[:, 2:, :FILTERS], rest[(w[:, -1] * 256)][:, None, :FILTERS]], 1)).max(1),
                (a[:, :-2, 2 * FILTERS :] + b[:, 2:, FILTERS:]).max(1),
            ],
            1,
        )
        z = np.maximum(pooled, 0) @ p["out"] + p["bias"]
        z -= z.max(1, keepdims=True)
        out[at : at + block] = z - np.log(np.exp(z).sum(1, keepdims=True))
    return out


def has_letter(raw: np.ndarray) -> bool:
    if (((raw | 32) >= 97) & ((raw | 32) <= 122)).any():
        return True
    return bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def predict(p: dict, column: pa.Array) -> list[pa.Array]:
    """lang_pred and score of each text of an Arrow column."""
    langs, scores, held, where = [], [], [], []
    for i, raw in texts(column):
        langs.append(UNDETERMINED)
        scores.append(0.0)
        if p["names"] and has_letter(raw):
            held.append((i, raw))
    # windows of many texts at once, in rows of bounded number
    for at in range(0, len(held), 256):
        part = held[at : at + 256]
        rows = [windows(raw) for _, raw in part]
        where = np.repeat(np.arange(len(part)), [len(r) for r in rows])
        data = np.concatenate(rows)
        weight = np.count_nonzero(data, axis=1).astype(np.float64)
        logs = log_probabilities(p, data).astype(np.float64)
        total = np.zeros((len(part), logs.shape[1]))
        np.add.at(total, where, logs * weight[:, None])
        total /= np.maximum(np.bincount(where, weight, len(part)), 1)[:, None]
        e = np.exp(total - total.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        for (i, _), k, s in zip(part, e.argmax(1), e.max(1), strict=True):
            langs[i], scores[i] = p["names"][k], round(float(s), 6)
    return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]


def shows_language(p: dict, column: pa.Array) -> list[bool]:
    """Whether each text has a letter and is not NOTHING throughout, if the network knows NOTHING."""
    out, k = [], p["names"].index(NOTHING) if NOTHING in p["names"] else None
    for _, raw in texts(column):
        told, odds, n, at = has_letter(raw), 0.0, 0, 0
        nothing = told and k is not None
        data = windows(raw) if nothing else ()
        while nothing and at < len(data):  # to the first part that shows a language
            part = data[at : at + 256]
            logs = log_probabilities(p, part[np.count_nonzero(part, axis=1) >= LEAST_BYTES])[:, k].astype(np.float64)
            rest = np.log(np.maximum(-np.expm1(logs), 1e-9))
            nothing, odds, at = bool((logs - rest > -math.log(SHOWN)).all()), odds + float((logs - rest).sum()), at + 256
            n += len(logs)
        out.append(told and not (nothing and odds >= max(math.log(ODDS), n * math.log(SHOWN))))
    return out


def fit(docs: DataFrame, learn=None, per_language: int = 150, max_languages: int = 256, excerpt: int = EXCERPT, made: tuple[tuple[bytes, str], ...] = (), steps: int = 260) -> dict:
    """The network, trained on the documents for which `learn` holds (default: crc32 of the id mod 3 is not 1), and on `made` texts."""
    learn = crc_fold(3) != 1 if learn is None else learn
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & learn)
    rank = F.xxhash64(F.lit(3), "doc_id")
    frequent = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    chosen = known.select("lang", rank.alias("rank")).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("n") <= per_language)
    bounds = chosen.groupBy("lang").agg(F.max("rank").alias("bound")).join(frequent.select("lang"), "lang").collect()  # at most max_languages rows
    if not bounds:
        return train([])
    limit = docs.sparkSession.createDataFrame([(r["lang"], r["bound"]) for r in bounds], "lang string, bound long")
    start = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.greatest(F.length("text") - excerpt, F.lit(1))).cast("int") + 1
    rows = known.join(F.broadcast(limit), "lang").where(rank <= F.col("bound")).select("doc_id", "lang", F.col("text").substr(start, F.lit(excerpt)).alias("part")).orderBy(rank, "lang", "part").limit(2 * per_language * len(bounds)).collect()  # in order: rows that repeat an id give the same fit each time
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["part"]))
    return train([(r["part"].encode("utf-8", "replace"), r["lang"]) for r in rows] + list(made), steps)


def identify(docs: DataFrame, model: dict, carry: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns `carry` of `docs` with lang_pred and score, or as `names` call them."""
    return map_texts(docs, lambda column: predict(model, column), f"`{names[0]}` string, `{names[1]}` double", carry)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that show a language: those without a letter go, and those of which the network finds every window to be
    NOTHING. Texts of several languages, and of languages without labels, stay; no document's own label counts."""
    told = unused(docs.columns, "told")[0]
    model = fit(docs, made=tuple(made_texts()), steps=400)
    return map_texts(docs, lambda column: [pa.array(shows_language(model, column), pa.bool_())], f"`{told}` boolean", docs.columns).where(F.col(told)).drop(told)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text", (F.coalesce(crc_fold(3), F.lit(-1)) == 1).alias("held_out")), fit(docs), ["doc_id", "held_out"])
