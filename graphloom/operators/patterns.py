"""Graph patterns as joins: required hops, optional groups and whole investigations as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_view(triples: DataFrame, predicate: str, source: str, target: str) -> DataFrame:
    """The edges of one predicate as (source, target)."""
    return triples.where(F.col("predicate") == predicate).select(F.col("subject").alias(source), F.col("object").alias(target))


def property_view(triples: DataFrame, key: str, properties: Mapping[str, str]) -> DataFrame:
    """(key, one column for each property), one row for each combination of values: all must be there."""
    out = None
    for prop, name in properties.items():
        own = triples.where(F.col("predicate") == prop).select(F.col("subject").alias(key), F.col("object").alias(name))
        out = own if out is None else out.join(own, key)
    return out


def hop(rows: DataFrame, edges: DataFrame, on: str, nodes: DataFrame | None = None) -> DataFrame:
    """Follow edges from column `on`; `nodes` adds required columns of the target, matched by the target's name."""
    out = rows.join(edges, on)
    return out if nodes is None else out.join(nodes, [c for c in nodes.columns if c in edges.columns and c != on])


def optional_hop(rows: DataFrame, block: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join with a block that was joined within: the whole block matches or all its columns are null."""
    return rows.join(block, on, "left")


def numeric_filter(rows: DataFrame, column: str, least: float) -> DataFrame:
    """Rows whose text reads as a number of `least` or more; others drop out."""
    return rows.where(F.expr(f"try_cast(`{column}` as double)") >= least)
