"""Column functions on names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(c: Column) -> Column:
    """Lower case with everything but a-z and 0-9 removed; null becomes the empty string."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def char_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside words, each word with one space on either side, with repeats."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_word(w: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))))

    return F.flatten(F.transform(padded, of_word))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two number arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def severity_bucket(score: Column) -> Column:
    """Critical from 9, High from 7, Medium from 4, else Low."""
    return F.when(score >= 9, "Critical").when(score >= 7, "High").when(score >= 4, "Medium").otherwise("Low")


def route_similarity(score: Column, auto: float = 0.82, review: float = 0.60) -> Column:
    """AUTO_MATCH, REVIEW or NEW_ENTITY by the unrounded score."""
    return F.when(score >= auto, "AUTO_MATCH").when(score >= review, "REVIEW").otherwise("NEW_ENTITY")


def route_decision(decision: Column, confidence: Column, score: Column, least_confidence: float = 0.85, least_score: float = 0.75) -> Column:
    """AUTO_APPROVE, CREATE_NEW or REVIEW by a decider's answer and the score, rounded to four places."""
    sure = confidence >= least_confidence
    return F.when((decision == "REUSE") & sure & (F.round(score, 4) >= least_score), "AUTO_APPROVE").when((decision == "NEW_ENTITY") & sure, "CREATE_NEW").otherwise("REVIEW")


def describe(kind: Column, name: Column, detail: Column) -> Column:
    """One line about an entity, from its kind, name and detail."""
    return F.concat(name, F.lit(" is a "), F.coalesce(detail, F.lit("unknown")), F.lit(" "), F.lower(kind), F.lit("."))


def redact(message: Column, secret: str) -> Column:
    """A message without a secret."""
    return F.replace(message, F.lit(secret), F.lit("[REDACTED]")) if secret else message


#: What to tell a caller about an HTTP status of a model service.
HTTP_HINTS = {400: "The request was not accepted.", 401: "Check the key.", 403: "The key lacks permission.", 404: "Check the model's name.", 429: "Too many requests; wait.", 500: "The service failed; try again.", 503: "The service is busy; try again."}


def http_hint(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in HTTP_HINTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("Unknown error."))


def utc_timestamp() -> Column:
    """Now, as ISO 8601 in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
