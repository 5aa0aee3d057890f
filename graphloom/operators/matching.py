"""Entity resolution: normalised equality, character n-gram TF-IDF, vectors; then routing.

Candidates: canonical_id, canonical_name, entity_type, position. Incoming: incoming_id, incoming_name, entity_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import char_ngrams, dot, normalize_name, route_similarity

RESOLUTION = ("incoming_id", "incoming_name", "entity_type", "canonical_id", "canonical_name", "similarity_score", "match_method", "decision")


def exact_match(incoming: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first candidate of the type with the same normalised name, for each incoming row that has one."""
    left = incoming.withColumn("nn", normalize_name(F.col("incoming_name")))
    right = candidates.withColumn("nn", normalize_name(F.col("canonical_name"))).where("nn <> ''").groupBy("entity_type", "nn").agg(F.min_by(F.struct("canonical_id", "canonical_name"), F.struct("position", "canonical_id")).alias("c"))
    return left.join(right, ["entity_type", "nn"]).select("incoming_id", "incoming_name", "entity_type", "c.canonical_id", "c.canonical_name", F.lit(1.0).alias("similarity_score"), F.lit("NORMALIZED_EXACT_MATCH").alias("match_method"), F.lit("AUTO_MATCH").alias("decision"))


def tfidf_scores(incoming: DataFrame, candidates: DataFrame) -> DataFrame:
    """incoming_id, canonical_id, position, score over pairs that share an n-gram.

    The corpus of an incoming name is its type's candidates and the name itself. So a term's document frequency is that
    of the candidates, plus one for terms of the incoming name; only shared terms need a join, and a candidate's norm is
    its norm without the name, corrected on them.
    """
    n = candidates.groupBy("entity_type").agg(F.count("*").alias("n"))
    c = candidates.select("entity_type", "canonical_id", "position", F.explode(char_ngrams(F.col("canonical_name"))).alias("term")).groupBy("entity_type", "canonical_id", "position", "term").agg(F.count("*").alias("tf"))
    df = c.groupBy("entity_type", "term").agg(F.count("*").alias("df")).join(n, "entity_type")
    i = incoming.select("incoming_id", "entity_type", F.explode(char_ngrams(F.col("incoming_name"))).alias("term")).groupBy("incoming_id", "entity_type", "term").agg(F.count("*").alias("ti")).join(n, "entity_type").join(df.drop("n"), ["entity_type", "term"], "left")
    total = F.col("n") + 2  # one plus the documents: the candidates and the name
    with_name, without = F.log(total / (F.coalesce("df", F.lit(0)) + 2)) + 1, F.log(total / (F.col("df") + 1)) + 1
    i = i.withColumn("idf", with_name)
    own = i.groupBy("incoming_id").agg(F.sqrt(F.sum((F.col("ti") * F.col("idf")) ** 2)).alias("ni"))
    base = c.join(df, ["entity_type", "term"]).groupBy("entity_type", "canonical_id").agg(F.sum((F.col("tf") * without) ** 2).alias("nc"))
    shared = i.where("df is not null").withColumn("old", without).select("incoming_id", "entity_type", "term", "ti", "idf", "old").join(c, ["entity_type", "term"])
    sums = shared.groupBy("incoming_id", "entity_type", "canonical_id", "position").agg(F.sum(F.col("ti") * F.col("tf") * F.col("idf") ** 2).alias("dot"), F.sum(F.col("tf") ** 2 * (F.col("idf") ** 2 - F.col("old") ** 2)).alias("more"))
    return sums.join(own, "incoming_id").join(base, ["entity_type", "canonical_id"]).select("incoming_id", "canonical_id", "position", (F.col("dot") / (F.col("ni") * F.sqrt(F.col("nc") + F.col("more")))).alias("score"))


def tfidf_match(incoming: DataFrame, candidates: DataFrame, auto: float = 0.82, review: float = 0.60) -> DataFrame:
    """The best candidate of the type by TF-IDF, first position among equals; without a shared n-gram the first, at 0."""
    best = tfidf_scores(incoming, candidates).groupBy("incoming_id").agg(F.max_by(F.struct("canonical_id", "score"), F.struct(F.round("score", 12), -F.col("position"))).alias("b"))
    first = candidates.groupBy("entity_type").agg(F.min_by("canonical_id", "position").alias("first_id"))
    names = candidates.select("entity_type", "canonical_id", "canonical_name")
    rows = incoming.join(first, "entity_type").join(best, "incoming_id", "left").withColumn("canonical_id", F.coalesce("b.canonical_id", "first_id")).withColumn("score", F.coalesce("b.score", F.lit(0.0)))
    return rows.join(names, ["entity_type", "canonical_id"]).select("incoming_id", "incoming_name", "entity_type", "canonical_id", "canonical_name", F.round("score", 4).alias("similarity_score"), F.lit("TFIDF_CHAR_NGRAM").alias("match_method"), route_similarity(F.col("score"), auto, review).alias("decision"))


def resolve(incoming: DataFrame, candidates: DataFrame) -> DataFrame:
    """Exact matches; the others by TF-IDF."""
    exact = exact_match(incoming, candidates)
    rest = incoming.join(exact.select("incoming_id"), "incoming_id", "left_anti")
    return exact.unionByName(tfidf_match(rest, candidates))


def top_k_vectors(queries: DataFrame, vectors: DataFrame, k: int = 3, kind: str = "label", key: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """The k nearest vectors of the same kind by dot product; equal scores by id. Ranks are limited before the shuffle."""
    left = queries.select(F.col(key).alias("query_id"), kind, F.col(vector).alias("__q"))
    pairs = vectors.select(kind, F.col(key).alias("candidate_id"), F.col(vector).alias("__v")).join(left, kind)
    if skip_self:
        pairs = pairs.where("query_id <> candidate_id")
    scored = pairs.select("query_id", kind, "candidate_id", dot(F.col("__q"), F.col("__v")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "candidate_id"))
    return scored.withColumn("candidate_rank", rank).where(F.col("candidate_rank") <= k).select("query_id", kind, "candidate_rank", "candidate_id", F.round("score", 4).alias("similarity_score"))


def first_rank(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("candidate_rank") == 1)
