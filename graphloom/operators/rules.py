"""Semantic rules over a graph and their weighted score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_bucket
from .graph import TYPE

#: Weights of a rule's severity.
WEIGHTS = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}


@dataclass(frozen=True)
class RuleSpec:
    """Entities of a class must have an edge: outgoing (`out`) or incoming (`in`)."""

    rule_id: str
    rule_name: str
    severity: str
    class_name: str
    predicate: str
    direction: str = "out"


def _members(triples: DataFrame, class_name: str) -> DataFrame:
    return triples.where((F.col("predicate") == TYPE) & (F.col("object") == class_name)).select(F.col("subject").alias("entity")).distinct()


def _result(rows: DataFrame, rule_id: str, name: str, severity: str, passed: Column, ok: Column, failed: Column) -> DataFrame:
    return rows.select(F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(severity).alias("severity"), "entity", F.when(passed, "PASS").otherwise("FAIL").alias("status"), F.when(passed, ok).otherwise(failed).alias("message"))


def edge_rules(triples: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """A row for each rule and entity, from one join of all typed entities with the distinct ends of all rules' edges."""
    spark = triples.sparkSession
    table = spark.createDataFrame([(r.rule_id, r.rule_name, r.severity, r.class_name, r.predicate, r.direction) for r in rules], "rule_id string, rule_name string, severity string, class string, predicate string, direction string")
    table = F.broadcast(table)  # the rules themselves
    entities = triples.where(F.col("predicate") == TYPE).select(F.col("subject").alias("entity"), F.col("object").alias("class")).distinct().join(table, "class")
    used = triples.where(F.col("predicate").isin(*{r.predicate for r in rules}))
    ends = used.select("predicate", F.inline(F.array(F.struct(F.col("subject").alias("entity"), F.lit("out").alias("direction")), F.struct(F.col("object").alias("entity"), F.lit("in").alias("direction"))))).distinct().withColumn("found", F.lit(True))
    rows = entities.join(ends, ["entity", "predicate", "direction"], "left")
    passed = F.col("found").isNotNull()
    text = F.concat(F.col("predicate"), F.when(F.col("direction") == "out", " leads from ").otherwise(" leads to "), F.lit("the entity"))
    return rows.select("rule_id", "rule_name", "severity", "entity", F.when(passed, "PASS").otherwise("FAIL").alias("status"), F.when(passed, text).otherwise(F.concat(F.lit("no "), text)).alias("message"))


def bucket_rule(triples: DataFrame, class_name: str, score: str, label: str, rule_id: str, name: str, severity: str = "High", bucket=severity_bucket) -> DataFrame:
    """An entity's label must be the bucket of its score; entities without either are skipped, first values count."""
    values = triples.where(F.col("predicate").isin(score, label)).groupBy(F.col("subject").alias("entity")).agg(F.min(F.when(F.col("predicate") == score, F.expr("try_cast(object as double)"))).alias("s"), F.min(F.when(F.col("predicate") == label, F.col("object"))).alias("l"))
    rows = _members(triples, class_name).join(values, "entity").where(F.col("s").isNotNull() & F.col("l").isNotNull()).withColumn("b", bucket(F.col("s")))
    return _result(rows, rule_id, name, severity, F.col("l") == F.col("b"), F.format_string("%s fits the score", "l"), F.format_string("%s, but the score says %s", "l", "b"))


def path_rule(triples: DataFrame, class_name: str, paths: Sequence[Sequence[str]], rule_id: str, name: str, severity: str) -> DataFrame:
    """An entity must start each of `paths` (predicates to follow): semi joins, never a product of paths."""
    rows = _members(triples, class_name)
    for i, path in enumerate(paths):
        ends = None
        for predicate in reversed(path):
            step = triples.where(F.col("predicate") == predicate).select("subject", "object")
            ends = (step if ends is None else step.join(ends.withColumnRenamed("subject", "object"), "object", "left_semi")).select("subject").distinct()
        rows = rows.join(ends.select(F.col("subject").alias("entity"), F.lit(True).alias(f"p{i}")), "entity", "left")
    passed = F.lit(True)
    for i in range(len(paths)):
        passed = passed & F.col(f"p{i}").isNotNull()
    return _result(rows, rule_id, name, severity, passed, F.lit("path complete"), F.lit("path incomplete"))


def quality_score(results: DataFrame, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """One row: checks, passed, failed and the weighted share of passes in per cent."""
    weight = F.lit(0)
    for severity, w in weights.items():
        weight = F.when(F.col("severity") == severity, w).otherwise(weight)
    ok = F.col("status") == "PASS"
    return results.agg(
        F.count("*").alias("total_checks"),
        F.count_if(ok).alias("passed_checks"),
        F.count_if(~ok).alias("failed_checks"),
        F.when(F.sum(weight) > 0, F.round(F.sum(F.when(ok, weight).otherwise(0)) / F.sum(weight) * 100, 2)).otherwise(0.0).alias("quality_score_percent"),
    )
