"""The star schema as a graph: which tables are classes, which keys are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import ClassSpec, edges_to_triples, join_parts, tables_to_triples
from ..session import table

CLASSES = {
    "region": ClassSpec("Region", "r_regionkey", {"r_name": "regionName"}, "region/"),
    "nation": ClassSpec("Nation", "n_nationkey", {"n_name": "nationName"}, "nation/"),
    "customer": ClassSpec("Customer", "c_custkey", {"c_name": "customerName", "c_acctbal": "customerBalance", "c_mktsegment": "segment"}, "customer/"),
    "supplier": ClassSpec("Supplier", "s_suppkey", {"s_name": "supplierName", "s_acctbal": "supplierBalance"}, "supplier/"),
    "part": ClassSpec("Part", "p_partkey", {"p_name": "partName", "p_type": "partType", "p_retailprice": "price"}, "part/"),
    "orders": ClassSpec("Order", "o_orderkey", {"o_orderstatus": "orderStatus", "o_orderpriority": "priority", "o_totalprice": "orderTotal"}, "order/"),
}
PREDICATES = {"IN_REGION": "inRegion", "LIVES_IN": "livesIn", "BASED_IN": "basedIn", "PLACED_BY": "placedBy", "CONTAINS": "contains", "SUPPLIED_BY": "suppliedBy"}
#: (relationship, table, source column, source prefix, target column, target prefix, distinct)
EDGES = (
    ("IN_REGION", "nation", "n_nationkey", "nation/", "n_regionkey", "region/", False),
    ("LIVES_IN", "customer", "c_custkey", "customer/", "c_nationkey", "nation/", False),
    ("BASED_IN", "supplier", "s_suppkey", "supplier/", "s_nationkey", "nation/", False),
    ("PLACED_BY", "orders", "o_orderkey", "order/", "o_custkey", "customer/", False),
    ("CONTAINS", "lineitem", "l_orderkey", "order/", "l_partkey", "part/", True),
    ("SUPPLIED_BY", "lineitem", "l_partkey", "part/", "l_suppkey", "supplier/", True),
)


def edges(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """(source_id, relationship, target_id) of the named relationships, or of all."""
    out = None
    for name, source, a, pa, b, pb, distinct in EDGES:
        if names and name not in names:
            continue
        keys = table(spark, d, source).select(a, b)
        keys = keys.distinct() if distinct else keys  # numbers, before they become text
        rows = keys.select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("source_id"), F.lit(name).alias("relationship"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("target_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, spec in CLASSES.items():
        rows = table(spark, d, name).select(spec.uri(spec.key).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def triples(spark: SparkSession, d: str, classes=tuple(CLASSES), relationships=tuple(PREDICATES)) -> DataFrame:
    """The set of triples of some classes and relationships; only their tables and columns are read.

    The tables' keys are unique, edges are made distinct where they are not, and parts differ in subject or predicate.
    """
    parts = [tables_to_triples(table(spark, d, c), CLASSES[c]) for c in classes]
    if relationships:
        parts.append(edges_to_triples(edges(spark, d, *relationships), PREDICATES))
    return join_parts(*parts)


#: The edges as SQL, for the checks.
EDGES_SQL = " union all ".join(f"select {'distinct ' if distinct else ''}'{pa}' || {a}::varchar as source_id, '{name}' as relationship, '{pb}' || {b}::varchar as target_id from {source}" for name, source, a, pa, b, pb, distinct in EDGES)


def edge_sql(name: str) -> str:
    _, source, a, pa, b, pb, distinct = next(e for e in EDGES if e[0] == name)
    return f"select {'distinct ' if distinct else ''}'{pa}' || {a}::varchar as source_id, '{name}' as relationship, '{pb}' || {b}::varchar as target_id from {source}"


def class_sql(name: str) -> str:
    """The triples of a class as (subject, predicate, object)."""
    spec = CLASSES[name]
    doubles = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice"}
    subject = f"'{spec.prefix}' || {spec.key}::varchar"
    parts = [f"select {subject} as subject, 'rdf:type' as predicate, '{spec.name}' as object from {name}"]
    parts += [f"select {subject}, '{p}', {c + '::decimal(18,2)::varchar' if c in doubles else c} from {name} where {c} is not null" for c, p in spec.properties.items()]
    return " union ".join(parts)


def triples_sql(classes=tuple(CLASSES), relationships=tuple(PREDICATES)) -> str:
    parts = [class_sql(c) for c in classes]
    parts += [f"select source_id, '{PREDICATES[r]}', target_id from ({edge_sql(r)})" for r in relationships]
    return " union ".join(parts)
