"""Evaluation of retrieval on labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate_details(labelled: DataFrame, packages: DataFrame, key: str = "question_id") -> DataFrame:
    """For each labelled question: detection, matched and missing facts, coverage and success flags.

    A fact is matched if its text, in lower case, is part of the context's text.
    """
    context = packages.select(key, F.col("detected_entity.entity_id").alias("detected_entity_id"), F.lower(F.to_json("graph_context")).alias("__text"))
    rows = labelled.join(context, key, "left")
    text = F.coalesce("__text", F.lit(""))
    matched = F.filter("expected_facts", lambda f: F.contains(text, F.lower(f)))
    missing = F.filter("expected_facts", lambda f: ~F.contains(text, F.lower(f)))
    rows = rows.withColumns({"__matched": matched, "__missing": missing, "entity_resolution_correct": F.col("detected_entity_id").eqNullSafe(F.col("expected_entity_id"))})
    coverage = F.when(F.size("expected_facts") > 0, F.size("__matched") / F.size("expected_facts")).otherwise(0.0)
    return rows.select(
        key,
        "question",
        "expected_entity_id",
        "detected_entity_id",
        "entity_resolution_correct",
        F.array_join("expected_facts", " | ").alias("expected_facts"),
        F.array_join("__matched", " | ").alias("matched_facts"),
        F.array_join("__missing", " | ").alias("missing_facts"),
        coverage.alias("retrieval_coverage"),
        (coverage == 1).alias("retrieval_success"),
        ((coverage == 1) & F.col("entity_resolution_correct")).alias("end_to_end_success"),
    )


def evaluate_summary(details: DataFrame) -> DataFrame:
    def rate(c: str):
        return F.coalesce(F.round(F.avg(F.col(c).cast("double")) * 100, 2), F.lit(0.0))

    return details.agg(
        F.count("*").alias("total_test_questions"),
        rate("entity_resolution_correct").alias("entity_resolution_accuracy_percent"),
        rate("retrieval_coverage").alias("average_retrieval_coverage_percent"),
        rate("retrieval_success").alias("retrieval_success_rate_percent"),
        rate("end_to_end_success").alias("end_to_end_success_rate_percent"),
    )
