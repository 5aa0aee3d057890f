"""Profiling and referential integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_rows(table: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one; nulls count as equal."""
    return table.groupBy(*table.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_ids(table: DataFrame, *keys: str) -> DataFrame:
    """One row: how many rows repeat an earlier id."""
    return table.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_ids"))


def null_counts(table: DataFrame) -> DataFrame:
    """(column, nulls) for each column, in one pass."""
    names = table.columns
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in names])))


def profile_table(table: DataFrame, name: str, key: str | None) -> DataFrame:
    """dataset, rows, columns, missing_values, duplicate_rows, duplicate_ids."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in table.columns), F.lit(0))
    head = table.agg(F.count("*").alias("rows"), missing.alias("missing_values"))
    ids = duplicate_ids(table, key) if key else table.sparkSession.range(1).select(F.lit(0).cast("long").alias("duplicate_ids"))
    one = F.lit(1).alias("one")
    joined = head.select(one, "*").join(duplicate_rows(table).select(one, "*"), "one").join(ids.select(one, "*"), "one")  # each is one row
    return joined.select(F.lit(name).alias("dataset"), "rows", F.lit(len(table.columns)).cast("long").alias("columns"), "missing_values", "duplicate_rows", "duplicate_ids")


def broken_references(edges: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Edges whose `column` is no known id."""
    return edges.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_anti")


def relationship_counts(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relationship").isNotNull()).groupBy("relationship").agg(F.count("*").alias("edges"))


def relationship_quality(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: edges, kinds, broken sources, broken targets, repeated edges; one pass over the edges and two joins."""
    known = ids.select(F.col(ids.columns[0]).alias("__id")).distinct().withColumn("__known", F.lit(True))
    per = edges.groupBy("source_id", "relationship", "target_id").agg(F.count("*").alias("n"))
    seen = per.join(known.select(F.col("__id").alias("source_id"), F.col("__known").alias("s")), "source_id", "left").join(known.select(F.col("__id").alias("target_id"), F.col("__known").alias("t")), "target_id", "left")
    return seen.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_relationships"),
        F.count_distinct("relationship").alias("relationship_types"),
        F.coalesce(F.sum(F.when(F.col("s").isNull(), F.col("n"))), F.lit(0)).alias("invalid_source_references"),
        F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("n"))), F.lit(0)).alias("invalid_target_references"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_relationships"),
    )
