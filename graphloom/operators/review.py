"""From decisions to a final mapping: prompts, deciders, reviewers, new ids, agreement."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import describe, normalize_name, route_decision
from .models import Ask, in_batches

#: A decider turns rows with incoming_name, top_name, top_id and top_vector_score into model_decision, selected_canonical_id,
#: selected_canonical_name, model_confidence and reasoning.
Decider = Callable[[DataFrame], DataFrame]

#: Prefixes of new ids by type.
PREFIXES = {"ThreatActor": "TA", "Malware": "MAL"}


def build_prompt(candidates: DataFrame) -> DataFrame:
    """incoming_id and the text that a model would be asked, candidates in order of their rank."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("candidate_rank", "canonical_id", "canonical_name", "similarity_score"))), lambda c: F.concat(c["candidate_rank"].cast("string"), F.lit(". "), c["canonical_id"], F.lit(" "), c["canonical_name"], F.lit(" ("), c["similarity_score"].cast("decimal(18,4)").cast("string"), F.lit(")")))
    asked = candidates.groupBy("incoming_id", "incoming_name", "entity_type").agg(lines.alias("lines"))
    return asked.select("incoming_id", F.concat_ws("\n", F.concat(F.lit("Is this "), F.lower("entity_type"), F.lit(" one of the known ones? "), F.col("incoming_name")), F.array_join("lines", "\n"), F.lit("Answer REUSE, NEW_ENTITY or UNCERTAIN, with a confidence.")).alias("prompt"))


def rule_decider(rows: DataFrame) -> DataFrame:
    """The default: equal normalised names are reused, far ones are new, all else is uncertain."""
    same = normalize_name(F.col("incoming_name")) == normalize_name(F.col("top_name"))
    far = F.col("top_vector_score") < 0.60
    reuse = F.when(same, True)
    return rows.withColumns(
        {
            "model_decision": F.when(same, "REUSE").when(far, "NEW_ENTITY").otherwise("UNCERTAIN"),
            "selected_canonical_id": F.when(reuse, F.col("top_id")),
            "selected_canonical_name": F.when(reuse, F.col("top_name")),
            "model_confidence": F.when(same, 1.0).when(far, 0.9).otherwise(0.0),
            "reasoning": F.when(same, "equal names").when(far, "no similar name").otherwise("similar, not equal"),
        }
    )


def by_batch(ask: Ask) -> Decider:
    """A decider that calls a model in the executors; rows that raise there are UNCERTAIN with confidence 0, all others keep their answer."""
    made = "model_decision string, selected_canonical_id string, selected_canonical_name string, model_confidence double, reasoning string"

    def failed(row, error):
        return {"model_decision": "UNCERTAIN", "selected_canonical_id": None, "selected_canonical_name": None, "model_confidence": 0.0, "reasoning": type(error).__name__}

    return lambda rows: in_batches(rows, ask, made, failed)


def decide(rows: DataFrame, decider: Decider = rule_decider) -> DataFrame:
    """A decider's answers; if it raises when called, every row is UNCERTAIN with confidence 0. A model that may fail on a row is given by `by_batch`."""
    try:
        return decider(rows)
    except Exception as error:  # noqa: BLE001 - a model's failure must not stop the batch
        none = F.lit(None).cast("string")
        return rows.withColumns({"model_decision": F.lit("UNCERTAIN"), "selected_canonical_id": none, "selected_canonical_name": none, "model_confidence": F.lit(0.0), "reasoning": F.lit(type(error).__name__)})


def routed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("routing_decision", route_decision(F.col("model_decision"), F.col("model_confidence"), F.col("top_vector_score")))


def apply_review(rows: DataFrame, reviews: DataFrame, prefixes: Mapping[str, str] = PREFIXES, first: int = 9000) -> DataFrame:
    """`rows` with reviewer_decision, final_decision, final id and name, review_status and agreement.

    Reviews are looked up by incoming_name; of several of a name the first by decision, id and name holds. New entities, created automatically or by a reviewer, draw ids from one
    counter for each type, in the order of `position`; types without a prefix share the constant NEW_UNKNOWN.
    """
    first_review = F.min(F.struct("reviewer_decision", "canonical_id", "canonical_name")).alias("said")
    known = reviews.groupBy("incoming_name").agg(first_review).select("incoming_name", "said.reviewer_decision", F.col("said.canonical_id").alias("__id"), F.col("said.canonical_name").alias("__name"))
    joined = rows.join(known, "incoming_name", "left")
    route, said = F.col("routing_decision"), F.col("reviewer_decision")
    final = F.when(route == "AUTO_APPROVE", "REUSE").when(route == "CREATE_NEW", "NEW_ENTITY").when(said.isin("REUSE", "NEW_ENTITY"), said).otherwise("UNRESOLVED")
    status = F.when(route == "AUTO_APPROVE", "AUTO_APPROVED").when(route == "CREATE_NEW", "AUTO_CREATED").when(said.isin("REUSE", "NEW_ENTITY"), "REVIEWED").otherwise("PENDING")
    marked = joined.withColumns({"reviewer_decision": F.when(route == "REVIEW", said), "final_decision": final, "review_status": status})
    minted = mint_ids(marked.where("final_decision = 'NEW_ENTITY'"), prefixes, first)
    marked = marked.join(minted, "incoming_id", "left")
    auto = F.col("review_status") == "AUTO_APPROVED"
    reuse = F.col("final_decision") == "REUSE"
    return marked.withColumns(
        {
            "final_canonical_id": F.when(auto, F.col("selected_canonical_id")).when(reuse, F.col("__id")).otherwise(F.col("new_id")),
            "final_canonical_name": F.when(auto, F.col("selected_canonical_name")).when(reuse, F.col("__name")).when(F.col("final_decision") == "NEW_ENTITY", F.col("incoming_name")),
            "agreement": F.col("model_decision") == F.col("final_decision"),
        }
    ).drop("__id", "__name", "new_id")


def mint_ids(rows: DataFrame, prefixes: Mapping[str, str] = PREFIXES, first: int = 9000, width: int = 65536) -> DataFrame:
    """incoming_id, new_id: prefix and a running number by type in the order of `position`, one for each id.

    Numbers run within ranges of `width` positions, after the counts of the ranges before: no task holds a whole type.
    """
    once = rows.groupBy("incoming_id").agg(F.min(F.struct("position", "entity_type")).alias("at"))
    once = once.select("incoming_id", "at.position", "at.entity_type", F.floor(F.col("at.position") / width).alias("range"))
    sizes = once.groupBy("entity_type", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("entity_type").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("entity_type").alias("kind"), F.col("range").alias("within"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rows = once.join(starts, F.col("entity_type").eqNullSafe(F.col("kind")) & F.col("range").eqNullSafe(F.col("within")))
    number = F.col("start") + F.row_number().over(Window.partitionBy("entity_type", "range").orderBy("position", "incoming_id"))
    prefix = F.lit(None).cast("string")
    for kind, p in prefixes.items():
        prefix = F.when(F.col("entity_type") == kind, p).otherwise(prefix)
    return rows.select("incoming_id", F.when(prefix.isNull(), "NEW_UNKNOWN").otherwise(F.concat(prefix, (F.lit(first) + number).cast("string"))).alias("new_id"))


def final_mapping(reviewed: DataFrame) -> DataFrame:
    return reviewed.select("incoming_id", "incoming_name", "entity_type", "final_decision", F.col("final_canonical_id").alias("canonical_id"), F.col("final_canonical_name").alias("canonical_name"))


def feedback(reviewed: DataFrame) -> DataFrame:
    return reviewed.select("incoming_id", "incoming_name", "entity_type", "top_vector_score", "model_decision", "model_confidence", "selected_canonical_id", "selected_canonical_name", "reasoning", "routing_decision", "reviewer_decision", "final_decision", "final_canonical_id", "final_canonical_name", "agreement")


def review_summary(reviewed: DataFrame) -> DataFrame:
    """One row of counts and the agreement rate over resolved rows."""
    done = F.col("final_decision") != "UNRESOLVED"
    return reviewed.agg(
        F.count("*").alias("total_entities"),
        F.count_if(F.col("routing_decision") == "AUTO_APPROVE").alias("auto_approved"),
        F.count_if(F.col("routing_decision") == "REVIEW").alias("review_cases"),
        F.count_if(F.col("routing_decision") == "CREATE_NEW").alias("auto_created"),
        F.when(F.count_if(done) > 0, F.round(F.count_if(done & F.col("agreement")) / F.count_if(done) * 100, 2)).otherwise(0.0).alias("model_final_agreement_percent"),
    )


def described(rows: DataFrame, kind: str, name: str, detail: str) -> DataFrame:
    return rows.withColumn("canonical_description", describe(F.col(kind), F.col(name), F.col(detail)))
