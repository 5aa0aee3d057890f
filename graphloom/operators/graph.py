"""Tables to triples and back: graph construction, views and statistics.

A triple is (subject, predicate, object, object_kind, datatype, graph). The set of triples is the set of distinct
(subject, predicate, object). Null objects make no triple.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "rdf:type"
TRIPLE = "subject string, predicate string, object string, object_kind string, datatype string, graph string"


@dataclass(frozen=True)
class ClassSpec:
    """How a table's rows become entities: class name, id column, prefix of ids, column to property."""

    name: str
    key: str
    properties: Mapping[str, str]
    prefix: str = ""
    datatypes: Mapping[str, str] = field(default_factory=dict)

    def uri(self, c: Column | str) -> Column:
        return entity_uri(F.col(c) if isinstance(c, str) else c, self.prefix)


def entity_uri(c: Column, prefix: str) -> Column:
    """An entity's identifier: prefix and trimmed id."""
    return F.concat(F.lit(prefix), F.trim(c.cast("string")))


def as_text(c: Column, dtype: str) -> Column:
    """A value as the text of a literal; doubles with two decimals, so that engines agree."""
    return c.cast("decimal(18,2)").cast("string") if dtype in ("double", "float") else c.cast("string")


def tables_to_triples(table: DataFrame, spec: ClassSpec, graph: str = "instances") -> DataFrame:
    """A type triple and one triple for each mapped column, in one pass over the table."""
    kinds = dict(table.dtypes)
    made = [F.struct(F.lit(TYPE).alias("predicate"), F.lit(spec.name).alias("object"), F.lit("iri").alias("object_kind"), F.lit(None).cast("string").alias("datatype"))]
    for column, prop in spec.properties.items():
        made.append(F.struct(F.lit(prop).alias("predicate"), as_text(F.col(column), kinds[column]).alias("object"), F.lit("literal").alias("object_kind"), F.lit(spec.datatypes.get(column, "xsd:decimal" if kinds[column] == "double" else "xsd:string")).alias("datatype")))
    return table.where(F.col(spec.key).isNotNull()).select(spec.uri(spec.key).alias("subject"), F.inline(F.array(*made))).where(F.col("object").isNotNull()).withColumn("graph", F.lit(graph))


def map_edges(edges: DataFrame, predicates: Mapping[str, str]) -> DataFrame:
    """Edges (source_id, relationship, target_id) with their predicate; names without one are left out.

    An expression and no join: a filter on the predicate reaches the edges' tables and prunes those of other names.
    """
    predicate = F.lit(None).cast("string")
    for name, own in predicates.items():
        predicate = F.when(F.col("relationship") == name, own).otherwise(predicate)
    return edges.withColumn("predicate", predicate).where(F.col("predicate").isNotNull())


def unmapped_edges(edges: DataFrame, predicates: Mapping[str, str]) -> DataFrame:
    """The edges whose name has no predicate."""
    names = edges.sparkSession.createDataFrame([(k,) for k in predicates], "relationship string")
    return edges.join(F.broadcast(names), "relationship", "left_anti")


def edges_to_triples(edges: DataFrame, predicates: Mapping[str, str], prefix: str = "", graph: str = "instances") -> DataFrame:
    """One triple for each mapped edge; rows that repeat an edge still count as rows here."""
    mapped = map_edges(edges, predicates).where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    return mapped.select(entity_uri(F.col("source_id"), prefix).alias("subject"), "predicate", entity_uri(F.col("target_id"), prefix).alias("object"), F.lit("iri").alias("object_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(graph).alias("graph"))


def join_parts(*graphs: DataFrame) -> DataFrame:
    """All triples of graphs that are sets and have none in common, such as tables with unique ids: nothing is compared."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out


def union_graphs(*graphs: DataFrame) -> DataFrame:
    """The set of the triples of any graphs."""
    return join_parts(*graphs).dropDuplicates(["subject", "predicate", "object"])


def graph_stats(triples: DataFrame) -> DataFrame:
    return triples.groupBy("graph").agg(F.count("*").alias("triples"))


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("predicate").agg(F.count("*").alias("triples"))


def subjects(triples: DataFrame, predicate: str, obj: str) -> DataFrame:
    return triples.where((F.col("predicate") == predicate) & (F.col("object") == obj)).select("subject").distinct()


def objects(triples: DataFrame, subject: str, predicate: str) -> DataFrame:
    return triples.where((F.col("subject") == subject) & (F.col("predicate") == predicate)).select("object")


def inspect_ontology(triples: DataFrame, kinds: Sequence[str] = ("owl:Class", "owl:ObjectProperty", "owl:DatatypeProperty")) -> DataFrame:
    """The distinct subjects of each kind, sorted."""
    return triples.where((F.col("predicate") == TYPE) & F.col("object").isin(*kinds)).select(F.col("object").alias("kind"), "subject").distinct().orderBy("kind", "subject")


def wide_view(triples: DataFrame, class_name: str, properties: Sequence[str], checked: bool = True) -> DataFrame:
    """One row for each subject with its first value of each property; only subjects of the class if `checked`."""
    picked = [F.min(F.when(F.col("predicate") == p, F.col("object"))).alias(p) for p in properties]
    is_class = F.max((F.col("predicate") == TYPE) & (F.col("object") == class_name)).alias("__is")
    rows = triples.where(F.col("predicate").isin(TYPE, *properties)).groupBy("subject").agg(is_class, *picked)
    return (rows.where("__is") if checked else rows).drop("__is")


def neighborhood(triples: DataFrame, entity: str, direction: str = "both") -> DataFrame:
    """Edges around one entity: out, in, or both as a bag, where a loop comes twice."""
    out = triples.where(F.col("subject") == entity).select(F.lit("out").alias("direction"), "predicate", F.col("object").alias("other"))
    into = triples.where((F.col("object") == entity) & (F.col("object_kind") == "iri")).select(F.lit("in").alias("direction"), "predicate", F.col("subject").alias("other"))
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def literal_graph(spark: SparkSession, rows: Sequence[tuple], graph: str) -> DataFrame:
    """Triples given as (subject, predicate, object, object_kind, datatype), e.g. to plant faults."""
    return spark.createDataFrame([(*r, graph) for r in rows], TRIPLE)


def ancestors(triples: DataFrame, depth: int = 16) -> dict[str, set[str]]:
    """For each class in a subclass edge itself and all classes above; hierarchies deeper than `depth` raise."""
    edges = triples.where(F.col("predicate") == "rdfs:subClassOf").select(F.col("subject").alias("class"), F.col("object").alias("ancestor")).distinct()
    rows = edges.limit(100_001).collect()  # classes of an ontology, not instances
    if len(rows) > 100_000:
        raise ValueError("over 100,000 subclass edges are no ontology")
    above: dict[str, set[str]] = {}
    for r in rows:
        above.setdefault(r["class"], set()).add(r["ancestor"])
        above.setdefault(r["ancestor"], set())
    closed = {}
    for name in above:
        found, new = {name}, {name}
        for _ in range(depth + 1):
            new = {x for c in new for x in above[c]} - found
            if not new:
                break
            found |= new
        else:
            raise ValueError(f"class hierarchy deeper than {depth}")
        closed[name] = found
    return closed


def subclass_closure(triples: DataFrame, depth: int = 16) -> DataFrame:
    """(class, ancestor) pairs of the ontology, reflexive."""
    closed = ancestors(triples, depth)
    return triples.sparkSession.createDataFrame(sorted((c, a) for c, up in closed.items() for a in up), "class string, ancestor string")
