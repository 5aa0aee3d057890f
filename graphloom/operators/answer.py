"""Answers bound to evidence, with a trace; generators are replaceable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import utc_timestamp
from .models import Ask, in_batches

#: A generator adds answer, evidence, entities_used, confidence and evidence_status to context packages.
Generator = Callable[[DataFrame], DataFrame]
FAILED = "The answer could not be generated; the evidence follows."
NO_EVIDENCE = "The graph holds no evidence for this question."


def template_generator(packages: DataFrame) -> DataFrame:
    """The default: names the entity and lists its facts."""
    e = F.col("detected_entity")
    return packages.withColumns(
        {
            "answer": F.concat(e["entity_name"], F.lit(": "), F.array_join("graph_context", ", ")),
            "evidence": F.col("graph_context"),
            "entities_used": F.array(e["entity_id"]),
            "confidence": F.lit(1.0),
            "evidence_status": F.lit("SUPPORTED"),
        }
    )


def by_batch(ask: Ask) -> Generator:
    """A generator that calls a model in the executors; packages that raise there are answered as PARTIAL with their facts."""
    made = "answer string, evidence array<string>, entities_used array<string>, confidence double, evidence_status string"

    def failed(package, error):
        return {"answer": FAILED, "evidence": package["graph_context"], "entities_used": [], "confidence": 0.0, "evidence_status": "PARTIAL"}

    return lambda packages: in_batches(packages, ask, made, failed)


def answer(packages: DataFrame, generator: Generator = template_generator) -> DataFrame:
    """Answers to all packages: a fixed one without evidence, the generator's otherwise, PARTIAL ones if it raises."""
    empty = F.array().cast("array<string>")
    found, rest = packages.where("status = 'SUCCESS'"), packages.where("status <> 'SUCCESS'")
    fixed = rest.withColumns({"detected_entity": F.when(F.col("status") == "NO_CONTEXT", F.col("detected_entity")), "answer": F.lit(NO_EVIDENCE), "evidence": empty, "entities_used": empty, "confidence": F.lit(0.0), "evidence_status": F.lit("INSUFFICIENT")})
    try:
        made = generator(found)
    except Exception:  # noqa: BLE001 - a model's failure must not stop the batch
        made = found.withColumns({"answer": F.lit(FAILED), "evidence": F.col("graph_context"), "entities_used": empty, "confidence": F.lit(0.0), "evidence_status": F.lit("PARTIAL")})
    return made.unionByName(fixed)


def trace(answers: DataFrame) -> DataFrame:
    """question_id and a JSON text of question, entity, context, answer and time; null fields are written."""
    return answers.select("question_id", F.to_json(F.struct("question", "status", "detected_entity", "graph_context", "answer", "evidence", "entities_used", "confidence", "evidence_status", utc_timestamp().alias("generated_at")), {"ignoreNullFields": "false"}).alias("trace"))
