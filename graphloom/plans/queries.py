"""Every operator as a query over the star schema, beside SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import describe, normalize_name, severity_bucket
from ..functions.text import route_decision as route_by_model
from ..functions.text import route_similarity as route_by_score
from ..operators import answer, evaluate, graph, matching, patterns, profile, retrieval, review, rules, shapes
from ..session import table
from ..sources import io
from . import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


TABLES = {"region": 3, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11}
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(names: str, rows: list[tuple]) -> str:
    text = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


# --- profiling -----------------------------------------------------------------------------------------------------


def _profile_sql(name: str) -> str:
    cols = COLUMNS[name].split()
    missing = " + ".join(f"count(*) filter ({c} is null)" for c in cols)
    return f"select '{name}' as dataset, count(*) as rows, {len(cols)}::bigint as columns, {missing} as missing_values, count(*) - (select count(*) from (select distinct * from {name})) as duplicate_rows, count(*) - count(distinct {cols[0]}) as duplicate_ids from {name}"


@query(" union all ".join(_profile_sql(t) for t in COLUMNS))
def profile_summary(spark, d):
    out = None
    for name in COLUMNS:
        t = table(spark, d, name)
        row = profile.profile_table(t, name, t.columns[0])
        out = row if out is None else out.unionByName(row)
    return out


@query(" union all ".join(f"select '{t}' as dataset, '{c}' as column_name, count(*) filter ({c} is null) as nulls from {t}" for t in ("customer", "orders") for c in COLUMNS[t].split()))
def null_counts_by_column(spark, d):
    one, two = (profile.null_counts(table(spark, d, t)).select(F.lit(t).alias("dataset"), "*") for t in ("customer", "orders"))
    return one.unionByName(two)


@query("select sum(n - 1)::bigint as duplicate_ids from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)")
def duplicate_ids(spark, d):
    return profile.duplicate_ids(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"select relationship, count(*) as edges from ({star.EDGES_SQL}) group by relationship")
def relationship_type_counts(spark, d):
    return profile.relationship_counts(star.edges(spark, d))


BAD = [("order/none", "PLACED_BY", "customer/0"), ("customer/0", "LIVES_IN", "nation/none")]
_IDS_SQL = " union all ".join(f"select '{s.prefix}' || {s.key}::varchar as id from {t}" for t, s in star.CLASSES.items())
_EDGES_BAD = f"({star.EDGES_SQL} union all select * from {sql_values('source_id, relationship, target_id', BAD)})"


def _edges_bad(spark, d):
    return star.edges(spark, d).unionByName(values(spark, "source_id string, relationship string, target_id string", BAD))


@query(f"select source_id, relationship, target_id from {_EDGES_BAD} where source_id not in (select id from ({_IDS_SQL})) union all select source_id, relationship, target_id from {_EDGES_BAD} where target_id not in (select id from ({_IDS_SQL}))")
def broken_references(spark, d):
    e, ids = _edges_bad(spark, d), star.entity_ids(spark, d)
    return profile.broken_references(e, ids, "source_id").select("source_id", "relationship", "target_id").unionByName(profile.broken_references(e, ids, "target_id").select("source_id", "relationship", "target_id"))


@query(f"select count(*) as total_relationships, count(distinct relationship) as relationship_types, count(*) filter (source_id not in (select id from ({_IDS_SQL}))) as invalid_source_references, count(*) filter (target_id not in (select id from ({_IDS_SQL}))) as invalid_target_references, count(*) - (select count(*) from (select distinct * from {_EDGES_BAD})) as duplicate_relationships from {_EDGES_BAD}")
def relationship_quality(spark, d):
    return profile.relationship_quality(_edges_bad(spark, d), star.entity_ids(spark, d))


# --- graph construction --------------------------------------------------------------------------------------------


@query(star.triples_sql(("customer", "nation"), ()))
def triples_from_tables(spark, d):
    return star.triples(spark, d, ("customer", "nation"), ()).select("subject", "predicate", "object")


ODD = [("a", "LIVES_IN", "b"), ("a", "KNOWS", "b"), (" c ", "PLACED_BY", "d")]


@query(f"select trim(source_id) as subject, case relationship when 'LIVES_IN' then 'livesIn' else 'placedBy' end as predicate, trim(target_id) as object from {sql_values('source_id, relationship, target_id', ODD)} where relationship <> 'KNOWS'")
def edge_mapping(spark, d):
    return graph.edges_to_triples(values(spark, "source_id string, relationship string, target_id string", ODD), star.PREDICATES).select("subject", "predicate", "object")


@query(f"select source_id, relationship, target_id from {sql_values('source_id, relationship, target_id', ODD)} where relationship = 'KNOWS'")
def edge_mapping_skipped(spark, d):
    return graph.unmapped_edges(values(spark, "source_id string, relationship string, target_id string", ODD), star.PREDICATES).select("source_id", "relationship", "target_id")


@query(f"select predicate, count(*) as triples from ({star.triples_sql()}) group by predicate")
def triple_counts_by_predicate(spark, d):
    return graph.predicate_counts(star.triples(spark, d))


FAULTY = [("order/x", "rdf:type", "Order", "iri", None), ("order/x", "orderTotal", "free", "literal", "xsd:decimal")]


@query(f"select graph, count(*) as triples from (select *, 'instances' as graph from ({star.triples_sql(('region', 'nation'), ('IN_REGION',))}) union all select s, p, o, 'faults' from {sql_values('s, p, o, k, t', FAULTY)}) group by graph")
def graph_stats_with_faults(spark, d):
    return graph.graph_stats(graph.union_graphs(star.triples(spark, d, ("region", "nation"), ("IN_REGION",)), graph.literal_graph(spark, FAULTY, "faults")))


ONTOLOGY = [(s.name, "rdf:type", "owl:Class", "iri", None) for s in star.CLASSES.values()] + [(p, "rdf:type", "owl:ObjectProperty", "iri", None) for p in star.PREDICATES.values()] + [(p, "rdf:type", "owl:DatatypeProperty", "iri", None) for s in star.CLASSES.values() for p in s.properties.values()]


@query(f"select distinct o as kind, s as subject from {sql_values('s, p, o, k, t', ONTOLOGY)}")
def ontology_inspection(spark, d):
    return graph.inspect_ontology(graph.literal_graph(spark, ONTOLOGY, "ontology"))


@query("select 'customer/' || c_custkey::varchar as subject, c_name as customerName, c_mktsegment as segment from customer")
def wide_view(spark, d):
    return graph.wide_view(star.triples(spark, d, ("customer",), ()), "Customer", ["customerName", "segment"])


@query(f"select 'out' as direction, predicate, object as other from ({star.triples_sql()}) where subject = 'customer/7'")
def neighborhood_out(spark, d):
    return graph.neighborhood(star.triples(spark, d), "customer/7", "out")


@query(f"with t as ({star.triples_sql()}) select 'out' as direction, predicate, object as other from t where subject = 'customer/7' union all select 'in', predicate, subject from t where object = 'customer/7'")
def neighborhood_both(spark, d):
    return graph.neighborhood(star.triples(spark, d), "customer/7", "both")


# --- patterns ------------------------------------------------------------------------------------------------------


@query("select 'nation/' || n_nationkey::varchar as nation, n_name as nation_name, r_name as region_name from nation join region on n_regionkey = r_regionkey")
def bgp_1hop(spark, d):
    t = star.triples(spark, d, ("nation", "region"), ("IN_REGION",))
    rows = patterns.property_view(t, "nation", {"nationName": "nation_name"})
    return patterns.hop(rows, patterns.edge_view(t, "inRegion", "nation", "region"), "nation", patterns.property_view(t, "region", {"regionName": "region_name"})).select("nation", "nation_name", "region_name")


@query("select c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal >= 5000")
def bgp_2hop(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").where("c_acctbal >= 5000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_name", "n_name", "r_name")


@query("select p_name, n_name, count(*) as pairs from (select distinct l_partkey, l_suppkey from lineitem) join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by p_name, n_name")
def bgp_3hop(spark, d):
    e = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    rows = e.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("p_name", "n_name").agg(F.count("*").alias("pairs"))


@query("select 'part/' || p_partkey::varchar as subject, p_name as name, p_retailprice::decimal(18,2)::varchar as price from part where p_retailprice::decimal(18,2) >= 950 order by p_retailprice desc")
def bgp_filter_numeric(spark, d):
    t = star.triples(spark, d, ("part",), ())
    return patterns.numeric_filter(patterns.property_view(t, "subject", {"partName": "name", "price": "price"}), "price", 950.0).orderBy(F.desc(F.expr("try_cast(price as double)")))


@query("select n_name, customers, suppliers, customers * suppliers as rows from nation join (select c_nationkey, count(*) as customers from customer group by 1) on c_nationkey = n_nationkey join (select s_nationkey, count(*) as suppliers from supplier group by 1) on s_nationkey = n_nationkey")
def bgp_two_branch(spark, d):
    """Both branches of a nation: the bag product's size, from counts of either branch."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return table(spark, d, "nation").join(c, "n_nationkey").join(s, "n_nationkey").select("n_name", "customers", "suppliers", (F.col("customers") * F.col("suppliers")).alias("rows"))


@query(
    """select c_name, n_name, r_name, o_orderkey, p_name, s_name, l_quantity from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
    where r_name = 'ASIA' and o_orderpriority = '1-URGENT' and l_quantity >= 40"""
)
def bgp_full_investigation(spark, d):
    """Customers of a region, their urgent orders, what these contain and who supplies it: filters first, dimensions by size."""
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").where("l_quantity >= 40").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select("c_name", "n_name", "r_name", "o_orderkey", "p_name", "s_name", "l_quantity")


@query("select o_orderkey, p_name, s_name from orders left join (select l_orderkey, p_name, s_name from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey where p_type = 'PROMO') on l_orderkey = o_orderkey")
def optional_nested(spark, d):
    block = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey").join(table(spark, d, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    return patterns.optional_hop(table(spark, d, "orders").select("o_orderkey"), block, "o_orderkey").select("o_orderkey", "p_name", "s_name")


@query("select n_name, c_name, s_name from nation left join (select * from customer where c_acctbal > 9900) on c_nationkey = n_nationkey left join (select * from supplier where s_acctbal > 9000) on s_nationkey = n_nationkey")
def optional_sibling_product(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"), "c_name")
    s = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    return patterns.optional_hop(patterns.optional_hop(table(spark, d, "nation"), c, "n_nationkey"), s, "n_nationkey").select("n_name", "c_name", "s_name")


@query("select p_name, count(distinct l_orderkey) as orders from part join lineitem on l_partkey = p_partkey group by p_name")
def inverse_edge(spark, d):
    e = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct()
    return e.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("p_name", "l_orderkey").distinct().groupBy("p_name").agg(F.count("*").alias("orders"))


# The same patterns over triples, hop by hop, where the forms above join the wide tables.

_TWO_HOPS = "select c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal::decimal(18,2) >= 5000 order by c_name"


@query(_TWO_HOPS)
def triples_2hop(spark, d):
    """Customers of a balance, their nation and region; ordered by name."""
    t = star.triples(spark, d, ("customer", "nation", "region"), ("LIVES_IN", "IN_REGION"))
    rows = patterns.numeric_filter(patterns.property_view(t, "customer", {"customerName": "c_name", "customerBalance": "balance"}), "balance", 5000)
    rows = patterns.hop(rows, patterns.edge_view(t, "livesIn", "customer", "nation"), "customer", patterns.property_view(t, "nation", {"nationName": "n_name"}))
    rows = patterns.hop(rows, patterns.edge_view(t, "inRegion", "nation", "region"), "nation", patterns.property_view(t, "region", {"regionName": "r_name"}))
    return rows.select("c_name", "n_name", "r_name").orderBy("c_name")


@query("select distinct 'order/' || o_orderkey::varchar as order_uri, 'part/' || p_partkey::varchar as part, p_name, 'supplier/' || s_suppkey::varchar as supplier, n_name from orders join lineitem l on l.l_orderkey = o_orderkey join part on p_partkey = l.l_partkey join (select distinct l_partkey as pk, l_suppkey as sk from lineitem) e on e.pk = p_partkey join supplier on s_suppkey = e.sk join nation on s_nationkey = n_nationkey where o_totalprice::decimal(18,2) >= 450000")
def triples_3hop(spark, d):
    """Orders of a total, their parts, all suppliers of these and the suppliers' nations: every combination is a row."""
    t = star.triples(spark, d, ("orders", "part", "nation"), ("CONTAINS", "SUPPLIED_BY", "BASED_IN"))
    rows = patterns.numeric_filter(patterns.property_view(t, "order", {"orderTotal": "total"}), "total", 450000)
    rows = patterns.hop(rows, patterns.edge_view(t, "contains", "order", "part"), "order", patterns.property_view(t, "part", {"partName": "p_name"}))
    rows = patterns.hop(rows, patterns.edge_view(t, "suppliedBy", "part", "supplier"), "part")
    rows = patterns.hop(rows, patterns.edge_view(t, "basedIn", "supplier", "nation"), "supplier", patterns.property_view(t, "nation", {"nationName": "n_name"}))
    return rows.select(F.col("order").alias("order_uri"), "part", "p_name", "supplier", "n_name")


@query("select n_name, c_name, s_name from nation join customer on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey where c_acctbal::decimal(18,2) >= 9000 and s_acctbal::decimal(18,2) >= 9000")
def triples_two_branches(spark, d):
    """Rich customers and rich suppliers of a nation: the bag product of both branches, as rows."""
    t = star.triples(spark, d, ("nation", "customer", "supplier"), ("LIVES_IN", "BASED_IN"))
    rows = patterns.property_view(t, "nation", {"nationName": "n_name"})
    for predicate, node, name, balance in (("livesIn", "customer", "customerName", "customerBalance"), ("basedIn", "supplier", "supplierName", "supplierBalance")):
        rich = patterns.numeric_filter(patterns.property_view(t, node, {name: f"{node[0]}_name", balance: f"{node}_balance"}), f"{node}_balance", 9000)
        rows = patterns.hop(rows, patterns.edge_view(t, predicate, node, "nation"), "nation", rich)
    return rows.select("n_name", "c_name", "s_name")


@query(
    """select distinct c_name, n_name, r_name, o_orderkey::varchar as o_orderkey, 'part/' || p_partkey::varchar as part, p_name, s_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    join orders on o_custkey = c_custkey join lineitem l on l.l_orderkey = o_orderkey join part on p_partkey = l.l_partkey join (select distinct l_partkey as pk, l_suppkey as sk from lineitem) e on e.pk = p_partkey
    join supplier on s_suppkey = e.sk where r_name = 'ASIA' and o_orderpriority = '1-URGENT' and o_totalprice::decimal(18,2) >= 400000 order by c_name, o_orderkey, part, s_name"""
)
def triples_full_investigation(spark, d):
    """Region, nation, customer, urgent large order, part and supplier as one pattern over triples, from the rarest end; ordered."""
    t = star.triples(spark, d)
    rows = patterns.property_view(t, "region", {"regionName": "r_name"}).where("r_name = 'ASIA'")
    rows = patterns.hop(rows, patterns.edge_view(t, "inRegion", "nation", "region"), "region", patterns.property_view(t, "nation", {"nationName": "n_name"}))
    rows = patterns.hop(rows, patterns.edge_view(t, "livesIn", "customer", "nation"), "nation", patterns.property_view(t, "customer", {"customerName": "c_name"}))
    orders = patterns.numeric_filter(patterns.property_view(t, "order", {"priority": "priority", "orderTotal": "total"}).where("priority = '1-URGENT'"), "total", 400000)
    rows = patterns.hop(rows, patterns.edge_view(t, "placedBy", "order", "customer"), "customer", orders)
    rows = patterns.hop(rows, patterns.edge_view(t, "contains", "order", "part"), "order", patterns.property_view(t, "part", {"partName": "p_name"}))
    rows = patterns.hop(rows, patterns.edge_view(t, "suppliedBy", "part", "supplier"), "part", patterns.property_view(t, "supplier", {"supplierName": "s_name"}))
    return rows.select("c_name", "n_name", "r_name", F.substring("order", 7, 20).alias("o_orderkey"), "part", "p_name", "s_name").orderBy("c_name", "o_orderkey", "part", "s_name")


@query("select p_name, 'order/' || o.l_orderkey::varchar as order_uri from part join (select distinct l_partkey, l_orderkey from lineitem) o on l_partkey = p_partkey where p_retailprice::decimal(18,2) >= 950")
def triples_inverse_edge(spark, d):
    """From parts of a price back along `contains` to the orders."""
    t = star.triples(spark, d, ("part",), ("CONTAINS",))
    rows = patterns.numeric_filter(patterns.property_view(t, "part", {"partName": "p_name", "price": "price"}), "price", 950)
    return patterns.hop(rows, patterns.edge_view(t, "contains", "order", "part"), "part").select("p_name", F.col("order").alias("order_uri"))


# --- sources and sinks: what is written reads back the same ---------------------------------------------------------


def _there(spark, name: str) -> str:
    """A folder for one query's files, where driver and executors share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/graphloom-{name}-{uuid.uuid4().hex}"


_SUPPLIERS = "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier"


@query(_SUPPLIERS)
def csv_round_trip(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    io.write_csv(rows, path := _there(spark, "csv"))
    return io.read_csv(spark, path, ", ".join(f"{c} {t}" for c, t in rows.dtypes))


@query(_SUPPLIERS)
def json_round_trip(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    io.write_json(rows, path := _there(spark, "json"))
    return spark.read.schema(rows.schema).json(path)


@query("select s_name as value from supplier")
def text_round_trip(spark, d):
    io.write_text(table(spark, d, "supplier").select("s_name"), path := _there(spark, "text"))
    return spark.read.text(path)


@query(f"select subject, predicate, object from ({star.triples_sql(('nation', 'region'), ('IN_REGION',))})")
def parquet_round_trip(spark, d):
    """Triples stored by predicate: a pattern then reads its own files."""
    io.write_parquet(star.triples(spark, d, ("nation", "region"), ("IN_REGION",)), path := _there(spark, "parquet"), "predicate")
    return io.read_parquet(spark, path).select("subject", "predicate", "object")


@query("select 'ex:r' || r_regionkey::varchar as subject, 'rdf:type' as predicate, 'ex:Region' as object from region union all select 'ex:r' || r_regionkey::varchar, 'ex:name', r_name from region")
def turtle_round_trip(spark, d):
    t = graph.tables_to_triples(table(spark, d, "region"), graph.ClassSpec("ex:Region", "r_regionkey", {"r_name": "ex:name"}, "ex:r"))
    io.write_turtle(t, path := _there(spark, "turtle"), {"ex": "http://example.org/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xsd": "http://www.w3.org/2001/XMLSchema#"})
    return io.read_turtle(spark, path).select("subject", "predicate", "object")


# --- shapes --------------------------------------------------------------------------------------------------------

_ORDER = lambda path, component, parameter: shapes.Constraint("OrderShape", "Order", path, component, parameter)
_CUSTOMER = lambda path, component, parameter: shapes.Constraint("CustomerShape", "Customer", path, component, parameter)


def _violations(spark, d, classes, relationships, *constraints):
    return shapes.validate(star.triples(spark, d, classes, relationships), constraints).select("focus", "path", "component", "value")


def _shape_sql(prefix, key, path, component, value, source, where):
    return f"select '{prefix}' || {key}::varchar as focus, '{path}' as path, '{component}' as component, {value} as value from {source} where {where}"


MIN_COUNT = _shape_sql("order/", "o_orderkey", "contains", "minCount", "null::varchar", "orders", "o_orderkey not in (select l_orderkey from lineitem)")
MAX_COUNT = "select 'order/' || l_orderkey::varchar as focus, 'contains' as path, 'maxCount' as component, null::varchar as value from lineitem group by l_orderkey having count(distinct l_partkey) > 8"


@query(MIN_COUNT)
def shape_min_count(spark, d):
    return _violations(spark, d, ("orders",), ("CONTAINS",), _ORDER("contains", "minCount", 1))


@query(MAX_COUNT)
def shape_max_count(spark, d):
    return _violations(spark, d, ("orders",), ("CONTAINS",), _ORDER("contains", "maxCount", 8))


@query(_shape_sql("customer/", "c_custkey", "customerName", "pattern", "c_name", "customer", "not regexp_matches(c_name, '^Customer#[0-9]{8}[0-4]$')"))
def shape_pattern(spark, d):
    return _violations(spark, d, ("customer",), (), _CUSTOMER("customerName", "pattern", "^Customer#[0-9]{8}[0-4]$"))


@query(_shape_sql("customer/", "c_custkey", "segment", "minLength", "c_mktsegment", "customer", "length(c_mktsegment) < 9"))
def shape_min_length(spark, d):
    return _violations(spark, d, ("customer",), (), _CUSTOMER("segment", "minLength", 9))


@query(_shape_sql("order/", "o_orderkey", "orderStatus", "in", "o_orderstatus", "orders", "o_orderstatus not in ('F', 'O')"))
def shape_in(spark, d):
    return _violations(spark, d, ("orders",), (), _ORDER("orderStatus", "in", ("F", "O")))


@query(_shape_sql("customer/", "c_custkey", "customerBalance", "minInclusive", "c_acctbal::decimal(18,2)::varchar", "customer", "c_acctbal::decimal(18,2) < 0"))
def shape_min_inclusive(spark, d):
    return _violations(spark, d, ("customer",), (), _CUSTOMER("customerBalance", "minInclusive", 0.0))


MAX_INCLUSIVE = _shape_sql("order/", "o_orderkey", "orderTotal", "maxInclusive", "o_totalprice::decimal(18,2)::varchar", "orders", "o_totalprice::decimal(18,2) > 400000")


@query(MAX_INCLUSIVE)
def shape_max_inclusive(spark, d):
    return _violations(spark, d, ("orders",), (), _ORDER("orderTotal", "maxInclusive", 400000.0))


@query(_shape_sql("customer/", "c_custkey", "customerName", "datatype", "c_name", "customer", "true"))
def shape_datatype(spark, d):
    return _violations(spark, d, ("customer",), (), _CUSTOMER("customerName", "datatype", "xsd:decimal"))


@query("select 'order/' || o_orderkey::varchar as focus, 'placedBy' as path, 'class' as component, 'customer/' || o_custkey::varchar as value from orders")
def shape_class(spark, d):
    """Customers are left out of the graph, so no target has its class."""
    return _violations(spark, d, ("orders",), ("PLACED_BY",), _ORDER("placedBy", "class", "Customer"))


_REPORT = (_ORDER("contains", "minCount", 1), _ORDER("contains", "maxCount", 8), _ORDER("orderTotal", "maxInclusive", 400000.0), _ORDER("orderStatus", "maxCount", 1))


@query(f"select component, count(*) as violations from ({MIN_COUNT} union all {MAX_COUNT} union all {MAX_INCLUSIVE}) group by component")
def shape_report(spark, d):
    return _violations(spark, d, ("orders",), ("CONTAINS",), *_REPORT).groupBy("component").agg(F.count("*").alias("violations"))


@query(f"select count(*) = 0 as conforms, count(*) as violations from ({MIN_COUNT} union all {MAX_COUNT} union all {MAX_INCLUSIVE})")
def shape_conforms(spark, d):
    return shapes.conforms(_violations(spark, d, ("orders",), ("CONTAINS",), *_REPORT))


# --- rules ---------------------------------------------------------------------------------------------------------

FORWARD = rules.RuleSpec("R1", "Order contains parts", "High", "Order", "contains")
INVERSE = rules.RuleSpec("R2", "Customer has orders", "Medium", "Customer", "placedBy", "in")
_R1 = "select 'R1' as rule_id, 'High' as severity, 'order/' || o_orderkey::varchar as entity, case when o_orderkey in (select l_orderkey from lineitem) then 'PASS' else 'FAIL' end as status from orders"
_R2 = "select 'R2' as rule_id, 'Medium' as severity, 'customer/' || c_custkey::varchar as entity, case when c_custkey in (select o_custkey from orders) then 'PASS' else 'FAIL' end as status from customer"
_SHORT = ("rule_id", "severity", "entity", "status")


@query(_R1)
def rules_forward(spark, d):
    return rules.edge_rules(star.triples(spark, d, ("orders",), ("CONTAINS",)), [FORWARD]).select(*_SHORT)


@query(_R2)
def rules_inverse(spark, d):
    return rules.edge_rules(star.triples(spark, d, ("customer",), ("PLACED_BY",)), [INVERSE]).select(*_SHORT)


_R3 = "select 'R3' as rule_id, 'High' as severity, 'order/' || o_orderkey::varchar as entity, case when (case when o_totalprice::decimal(18,2) >= 350000 then '1-URGENT' when o_totalprice::decimal(18,2) >= 200000 then '2-HIGH' else '5-LOW' end) = o_orderpriority then 'PASS' else 'FAIL' end as status from orders"


@query(_R3)
def rule_bucket_consistency(spark, d):
    tier = lambda s: F.when(s >= 350000, "1-URGENT").when(s >= 200000, "2-HIGH").otherwise("5-LOW")
    return rules.bucket_rule(star.triples(spark, d, ("orders",), ()), "Order", "orderTotal", "priority", "R3", "Priority fits the total", "High", tier).select(*_SHORT)


_R4 = "select 'R4' as rule_id, 'Critical' as severity, 'order/' || o_orderkey::varchar as entity, case when o_orderkey in (select l_orderkey from lineitem join (select distinct l_partkey as p from lineitem) on p = l_partkey) and o_custkey in (select c_custkey from customer) then 'PASS' else 'FAIL' end as status from orders"


@query(_R4)
def rule_complete_path(spark, d):
    t = star.triples(spark, d, ("orders",), ("CONTAINS", "SUPPLIED_BY", "PLACED_BY", "LIVES_IN"))
    return rules.path_rule(t, "Order", [["contains", "suppliedBy"], ["placedBy", "livesIn"]], "R4", "Complete order", "Critical").select(*_SHORT)


_R5 = "select 'R5' as rule_id, 'High' as severity, 'customer/' || c_custkey::varchar as entity, case when c_nationkey in (select n_nationkey from nation) then 'PASS' else 'FAIL' end as status from customer"


@query(_R5)
def rule_infrastructure_path(spark, d):
    return rules.path_rule(star.triples(spark, d, ("customer",), ("LIVES_IN", "IN_REGION")), "Customer", [["livesIn", "inRegion"]], "R5", "Customer has a region", "High").select(*_SHORT)


@query(f"select count(*) as total_checks, count(*) filter (status = 'PASS') as passed_checks, count(*) filter (status = 'FAIL') as failed_checks, round(sum(case when status = 'PASS' then w else 0 end)::double / sum(w) * 100, 2) as quality_score_percent from (select *, case severity when 'Critical' then 4 when 'High' then 3 when 'Medium' then 2 else 1 end as w from ({_R1} union all {_R2} union all {_R3}))")
def quality_score(spark, d):
    return rules.quality_score(rules_forward(spark, d).unionByName(rules_inverse(spark, d)).unionByName(rule_bucket_consistency(spark, d)))


# --- matching ------------------------------------------------------------------------------------------------------

INCOMING = [(i, n, "part") for i, n in enumerate(["Blue-Anvil", "coldgear", "LARGE WIDGET!", "old  rod", "blu anvill", "hot gizmos", "newplated", "grey hammer", "xyzzy", "red-rings", "small  bolts"])]


def _candidates(spark, d):
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("canonical_name")).agg(F.min("p_partkey").alias("canonical_id"))
    return names.select("canonical_id", "canonical_name", F.lit("part").alias("entity_type"), F.col("canonical_id").alias("position"))


def _incoming(spark):
    return values(spark, "incoming_id int, incoming_name string, entity_type string", INCOMING)


_CAND = "cand as (select min(p_partkey) as canonical_id, p_name as canonical_name from part group by p_name)"
_INC = f"inc as (select * from {sql_values('incoming_id, incoming_name, entity_type', INCOMING)})"
_NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_EXACT = f"exact as (select incoming_id, incoming_name, canonical_id, canonical_name, 1.0::double as similarity_score, 'NORMALIZED_EXACT_MATCH' as match_method, 'AUTO_MATCH' as decision from inc join cand on {_NORM.format('incoming_name')} = {_NORM.format('canonical_name')})"


def _grams_sql(source: str, key: str, name: str) -> str:
    word = f"select {key}, ' ' || w || ' ' as w from (select {key}, unnest(regexp_split_to_array(lower({name}), '\\s+')) as w from {source}) where w <> ''"
    size = f"select {key}, w, unnest(range(2, least(4, length(w)) + 1)) as n from ({word})"
    gram = f"select {key}, substring(w, i, n) as term from (select {key}, w, n, unnest(range(1, length(w) - n + 2)) as i from ({size}))"
    return f"select {key}, term, count(*) as tf from ({gram}) group by {key}, term"


_TFIDF = f"""
c as ({_grams_sql("cand", "canonical_id", "canonical_name")}), i as ({_grams_sql("inc", "incoming_id", "incoming_name")}),
df as (select term, count(*) as df from c group by term), n as (select count(*) as n from cand),
wi as (select incoming_id, i.term, tf * (ln((n + 2.0) / (coalesce(df, 0) + 2.0)) + 1) as w from i cross join n left join df on df.term = i.term),
wc as (select x.incoming_id, c.canonical_id, c.term, c.tf * (ln((n + 2.0) / (df + case when i.term is null then 1.0 else 2.0 end)) + 1) as w from inc x cross join n cross join c join df on df.term = c.term left join i on i.incoming_id = x.incoming_id and i.term = c.term),
ni as (select incoming_id, sqrt(sum(w * w)) as norm from wi group by 1), nc as (select incoming_id, canonical_id, sqrt(sum(w * w)) as norm from wc group by 1, 2),
s as (select nc.incoming_id, nc.canonical_id, coalesce(sum(wi.w * wc.w), 0) / (any_value(ni.norm) * any_value(nc.norm)) as score from nc join ni using (incoming_id) join wc using (incoming_id, canonical_id) left join wi on wi.incoming_id = wc.incoming_id and wi.term = wc.term group by 1, 2),
best as (select *, row_number() over (partition by incoming_id order by round(score, 12) desc, canonical_id) as k from s),
tfidf as (select incoming_id, incoming_name, canonical_id, canonical_name, round(score, 4) as similarity_score, 'TFIDF_CHAR_NGRAM' as match_method, case when score >= 0.82 then 'AUTO_MATCH' when score >= 0.6 then 'REVIEW' else 'NEW_ENTITY' end as decision from best join inc using (incoming_id) join cand using (canonical_id) where k = 1)"""
_RESOLVED = ("incoming_id", "incoming_name", "canonical_id", "canonical_name", "similarity_score", "match_method", "decision")


@query(f"with {_CAND}, {_INC}, {_EXACT} select * from exact")
def resolve_exact(spark, d):
    return matching.exact_match(_incoming(spark), _candidates(spark, d)).select(*_RESOLVED)


@query(f"with {_CAND}, {_INC}, {_TFIDF} select * from tfidf")
def resolve_tfidf(spark, d):
    return matching.tfidf_match(_incoming(spark), _candidates(spark, d)).select(*_RESOLVED)


@query(f"with {_CAND}, {_INC}, {_EXACT}, {_TFIDF} select * from exact union all select * from tfidf where incoming_id not in (select incoming_id from exact)")
def resolve_route(spark, d):
    return matching.resolve(_incoming(spark), _candidates(spark, d)).select(*_RESOLVED)


_TOP3 = "select q.vec_id as query_id, q.label, c.vec_id as candidate_id, list_inner_product(q.embedding::double[], c.embedding::double[]) as score from embeddings q join embeddings c on q.label = c.label and q.vec_id <> c.vec_id where q.vec_id % 100 = 0"
_RANKED = f"select query_id, label, row_number() over (partition by query_id order by round(score, 9) desc, candidate_id)::int as candidate_rank, candidate_id, round(score, 4) as similarity_score from ({_TOP3}) qualify candidate_rank <= 3"


@query(_RANKED)
def vector_top3(spark, d):
    e = table(spark, d, "embeddings")
    return matching.top_k_vectors(e.where("vec_id % 100 = 0"), e)


@query(f"select query_id, candidate_id, similarity_score from ({_RANKED}) where candidate_rank = 1")
def vector_rank1(spark, d):
    return matching.first_rank(vector_top3(spark, d)).select("query_id", "candidate_id", "similarity_score")


ANSWERS = [(1, "REUSE", 0.85, 0.75), (2, "REUSE", 0.85, 0.74995), (3, "REUSE", 0.84, 0.9), (4, "NEW_ENTITY", 0.85, 0.1), (5, "NEW_ENTITY", 0.8, 0.1), (6, "UNCERTAIN", 0.99, 0.99), (7, "REUSE", 0.9, 0.7499)]


@query(f"select id, case when decision = 'REUSE' and confidence >= 0.85 and round(score, 4) >= 0.75 then 'AUTO_APPROVE' when decision = 'NEW_ENTITY' and confidence >= 0.85 then 'CREATE_NEW' else 'REVIEW' end as routing from (select id, decision, confidence::double as confidence, score::double as score from {sql_values('id, decision, confidence, score', ANSWERS)})")
def route_decision(spark, d):
    rows = values(spark, "id int, decision string, confidence double, score double", ANSWERS)
    return rows.select("id", route_by_model(F.col("decision"), F.col("confidence"), F.col("score")).alias("routing"))


@query("select p_partkey, case when p_retailprice / 1000 >= 0.82 + 0.15 then 'AUTO_MATCH' when p_retailprice / 1000 >= 0.6 + 0.33 then 'REVIEW' else 'NEW_ENTITY' end as decision, case when p_size >= 9 then 'Critical' when p_size >= 7 then 'High' when p_size >= 4 then 'Medium' else 'Low' end as bucket, p_name || ' is a ' || p_brand || ' ' || lower(p_type) || '.' as description, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as normalized from part")
def scalar_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", route_by_score(F.col("p_retailprice") / 1000, 0.82 + 0.15, 0.6 + 0.33).alias("decision"), severity_bucket(F.col("p_size")).alias("bucket"), describe(F.col("p_type"), F.col("p_name"), F.col("p_brand")).alias("description"), normalize_name(F.col("p_name")).alias("normalized"))


# --- review --------------------------------------------------------------------------------------------------------

MAPPED = [
    (1, "i1", "Blue Anvil", "ThreatActor", "blue anvil", "P1", 0.9),
    (2, "i2", "grey hammer", "ThreatActor", "blue anvil", "P1", 0.2),
    (3, "i3", "blue anvils", "Malware", "blue anvil", "P1", 0.8),
    (4, "i4", "odd thing", "Malware", "red rod", "P2", 0.7),
    (5, "i5", "other", "Malware", "red rod", "P2", 0.65),
    (6, "i6", "new thing", "Gadget", "red rod", "P2", 0.1),
]
REVIEWS = [("blue anvils", "REUSE", "P1", "blue anvil"), ("odd thing", "NEW_ENTITY", None, None)]


def _reviewed(spark):
    rows = values(spark, "position int, incoming_id string, incoming_name string, entity_type string, top_name string, top_id string, top_vector_score double", MAPPED)
    return review.apply_review(review.routed(review.decide(rows)), values(spark, "incoming_name string, reviewer_decision string, canonical_id string, canonical_name string", REVIEWS))


_REVIEWED = f"""
with m as (select * from {sql_values('position, incoming_id, incoming_name, entity_type, top_name, top_id, top_vector_score', MAPPED)}), v as (select * from {sql_values('incoming_name, reviewer_decision, canonical_id, canonical_name', REVIEWS)}),
a as (select *, {_NORM.format('incoming_name')} = {_NORM.format('top_name')} as same from m),
b as (select *, case when same then 'REUSE' when top_vector_score < 0.6 then 'NEW_ENTITY' else 'UNCERTAIN' end as model_decision, case when same then 1.0 when top_vector_score < 0.6 then 0.9 else 0.0 end::double as model_confidence from a),
r as (select *, case when model_decision = 'REUSE' and model_confidence >= 0.85 and top_vector_score >= 0.75 then 'AUTO_APPROVE' when model_decision = 'NEW_ENTITY' and model_confidence >= 0.85 then 'CREATE_NEW' else 'REVIEW' end as routing_decision from b),
f as (select r.*, v.canonical_id as vid, v.canonical_name as vname, case when routing_decision = 'REVIEW' then v.reviewer_decision end as reviewer_decision, case when routing_decision = 'AUTO_APPROVE' then 'REUSE' when routing_decision = 'CREATE_NEW' then 'NEW_ENTITY' else coalesce(v.reviewer_decision, 'UNRESOLVED') end as final_decision from r left join v using (incoming_name)),
k as (select *, 9000 + row_number() over (partition by entity_type, final_decision = 'NEW_ENTITY' order by position) as num from f),
z as (select *, case when routing_decision = 'AUTO_APPROVE' then top_id when final_decision = 'REUSE' then vid when final_decision = 'NEW_ENTITY' then case entity_type when 'ThreatActor' then 'TA' || num when 'Malware' then 'MAL' || num else 'NEW_UNKNOWN' end end as canonical_id, case when routing_decision = 'AUTO_APPROVE' then top_name when final_decision = 'REUSE' then vname when final_decision = 'NEW_ENTITY' then incoming_name end as canonical_name from k)
"""


@query(_REVIEWED + "select incoming_id, incoming_name, entity_type, final_decision, canonical_id, canonical_name from z")
def review_final_mapping(spark, d):
    return review.final_mapping(_reviewed(spark))


@query(_REVIEWED + "select incoming_id, model_decision, model_confidence, routing_decision, reviewer_decision, final_decision, model_decision = final_decision as agreement from z")
def review_feedback(spark, d):
    return review.feedback(_reviewed(spark)).select("incoming_id", "model_decision", "model_confidence", "routing_decision", "reviewer_decision", "final_decision", "agreement")


@query(_REVIEWED + "select count(*) as total_entities, count(*) filter (routing_decision = 'AUTO_APPROVE') as auto_approved, count(*) filter (routing_decision = 'REVIEW') as review_cases, count(*) filter (routing_decision = 'CREATE_NEW') as auto_created, round(count(*) filter (final_decision <> 'UNRESOLVED' and model_decision = final_decision)::double / count(*) filter (final_decision <> 'UNRESOLVED') * 100, 2) as model_final_agreement_percent from z")
def review_summary(spark, d):
    return review.review_summary(_reviewed(spark))


@query("select 'c' || c_custkey::varchar as incoming_id, case c_mktsegment when 'BUILDING' then 'BLD' when 'MACHINERY' then 'MAC' end || (9000 + row_number() over (partition by c_mktsegment order by c_custkey))::varchar as new_id from customer where c_mktsegment in ('BUILDING', 'MACHINERY') union all select 'c' || c_custkey::varchar, 'NEW_UNKNOWN' from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')")
def mint_ids(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("incoming_id"), F.col("c_mktsegment").alias("entity_type"), F.col("c_custkey").alias("position"))
    return review.mint_ids(rows, {"BUILDING": "BLD", "MACHINERY": "MAC"})


@query(f"with t as ({_RANKED}) select query_id, 'Is this vector one of the known ones? v' || query_id::varchar || chr(10) || string_agg(candidate_rank::varchar || '. ' || candidate_id::varchar || ' v' || candidate_id::varchar || ' (' || similarity_score::decimal(18,4)::varchar || ')', chr(10) order by candidate_rank) || chr(10) || 'Answer REUSE, NEW_ENTITY or UNCERTAIN, with a confidence.' as prompt from t group by query_id")
def decision_prompts(spark, d):
    rows = vector_top3(spark, d).select(F.col("query_id").alias("incoming_id"), F.concat(F.lit("v"), F.col("query_id").cast("string")).alias("incoming_name"), F.lit("vector").alias("entity_type"), "candidate_rank", F.col("candidate_id").cast("string").alias("canonical_id"), F.concat(F.lit("v"), F.col("candidate_id").cast("string")).alias("canonical_name"), "similarity_score")
    return review.build_prompt(rows).withColumnRenamed("incoming_id", "query_id")


# --- retrieval -----------------------------------------------------------------------------------------------------


def _questions(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"))


def _catalog(spark, d):
    return retrieval.build_catalog([(table(spark, d, "benchmark"), "item_id", "text", "Item")])


_DETECTED = f"select doc_id as question_id, item_id::varchar as entity_id from (select doc_id, item_id, row_number() over (partition by doc_id order by length(nn) desc, item_id::varchar) as k from (select doc_id, {_NORM.format('text')} as nq from documents) join (select item_id, {_NORM.format('text')} as nn from benchmark) on nn <> '' and contains(nq, nn)) where k = 1"


@query(_DETECTED)
def detect_entity(spark, d):
    return retrieval.detect_entities(_questions(spark, d), _catalog(spark, d)).select("question_id", "entity_id")


ASKED = [(1, "Where is NATION_3?", "nation/3", ["region/3"]), (2, "Tell me about nation 11 please", "nation/11", ["nation/11", "region/1"]), (3, "And AFRICA?", "region/0", ["AFRICA"]), (4, "hm", "region/9", ["x"]), (5, "Nothing known here", "region/9", [])]


#: The templates' graph over the star schema: customers as actors, suppliers as malware, parts as vulnerabilities.
_THREATS = {
    "customer": [graph.ClassSpec("ThreatActor", "c_custkey", {"c_name": "actorName", "c_mktsegment": "actorType", "c_nationkey": "primaryMotivation"}, "actor/")],
    "supplier": [graph.ClassSpec("Malware", "s_suppkey", {"s_name": "malwareName", "s_nationkey": "malwareType"}, "malware/")],
    "part": [graph.ClassSpec("Vulnerability", "p_partkey", {"p_name": "cveId", "p_brand": "severity", "p_size": "cvssScore"}, "cve/")],
    "nation": [graph.ClassSpec("Campaign", "n_nationkey", {"n_name": "campaignName", "n_regionkey": "attackVector"}, "campaign/"), graph.ClassSpec("Domain", "n_nationkey", {"n_name": "domainName"}, "domain/")],
    "region": [graph.ClassSpec("Organization", "r_regionkey", {"r_name": "organizationName", "r_regionkey": "industry"}, "organization/"), graph.ClassSpec("IPAddress", "r_regionkey", {"r_name": "ipAddress"}, "ip/")],
}
#: (predicate, table, source column, source prefix, target column, target prefix, condition); some targets are not there.
_THREAT_EDGES = (
    ("usesMalware", "customer", "c_custkey", "actor/", "c_custkey", "malware/", "true"),
    ("exploits", "supplier", "s_suppkey", "malware/", "s_suppkey", "cve/", "s_acctbal > 1000"),
    ("communicatesWith", "supplier", "s_suppkey", "malware/", "s_nationkey", "domain/", "s_acctbal < 5000"),
    ("resolvesTo", "nation", "n_nationkey", "domain/", "n_regionkey", "ip/", "n_regionkey <> 2"),
    ("attributedToCampaign", "customer", "c_custkey", "actor/", "c_nationkey", "campaign/", "c_acctbal > 0"),
    ("targets", "nation", "n_nationkey", "campaign/", "n_regionkey", "organization/", "n_regionkey <> 3"),
)


def _threats(spark, d):
    parts = [graph.tables_to_triples(table(spark, d, name), spec) for name, specs in _THREATS.items() for spec in specs]
    for predicate, name, a, pa, b, pb, where in _THREAT_EDGES:
        rows = table(spark, d, name).where(where).select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("source_id"), F.lit(predicate).alias("relationship"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("target_id"))
        parts.append(graph.edges_to_triples(rows, {predicate: predicate}))
    return graph.join_parts(*parts)


_THREATS_SQL = """
with ip as (select n_nationkey as k, r_name as ip_address from nation join region on r_regionkey = n_regionkey where n_regionkey <> 2),
net as (select s_suppkey, n_name as domain_name, ip_address from supplier join nation on n_nationkey = s_nationkey left join ip on k = n_nationkey where s_acctbal < 5000),
cve as (select s_suppkey, p_name as cve, p_brand as severity, p_size::double as cvss from supplier join part on p_partkey = s_suppkey where s_acctbal > 1000),
mal as (select s.s_suppkey, s_name as malware_name, s_nationkey::varchar as malware_type, cve, severity, cvss, domain_name, ip_address from supplier s left join cve using (s_suppkey) left join net using (s_suppkey)),
org as (select n_nationkey as k, r_name as organization_name, r_regionkey::varchar as industry from nation join region on r_regionkey = n_regionkey where n_regionkey <> 3),
cam as (select c_custkey, n_name as campaign_name, n_regionkey::varchar as attack_vector, organization_name, industry from customer join nation on n_nationkey = c_nationkey left join org on k = n_nationkey where c_acctbal > 0)
"""


@query(_THREATS_SQL + "select 'actor/' || c.c_custkey::varchar as entity_id, c_name as actor_name, c_mktsegment as actor_type, c_nationkey::varchar as primary_motivation, malware_name, malware_type, cve, severity, cvss, domain_name, ip_address, campaign_name, attack_vector, organization_name, industry from customer c left join mal on s_suppkey = c.c_custkey left join cam on cam.c_custkey = c.c_custkey")
def actor_context(spark, d):
    return retrieval.actor_context(_threats(spark, d))


@query(_THREATS_SQL + "select 'malware/' || s_suppkey::varchar as entity_id, malware_name, malware_type, c_name as associated_actor, cve, severity, cvss, domain_name, ip_address from mal left join customer on c_custkey = s_suppkey")
def malware_context(spark, d):
    return retrieval.malware_context(_threats(spark, d))


def _asked(spark, d):
    questions = values(spark, "question_id int, question string, expected_entity_id string, expected_facts array<string>", ASKED)
    t = star.triples(spark, d, ("nation", "region"), ("IN_REGION",)).persist()  # patterns read it once for each predicate
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    key = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    catalog = retrieval.build_catalog([(n.withColumn("id", key("n_nationkey", "nation/")), "id", "n_name", "Nation"), (r.withColumn("id", key("r_regionkey", "region/")), "id", "r_name", "Region")])
    found = retrieval.detect_entities(questions, catalog)
    asked = questions.select("question_id", "question")
    return questions, retrieval.context_package(asked, found, retrieval.context_by_type(t, found))


_ASKED_SQL = f"""
with recursive q as (select * from (values {', '.join(f"({i}, '{t}', '{e}', {f!r}::varchar[])" for i, t, e, f in ASKED)}) v(question_id, question, expected_entity_id, expected_facts)),
cat as (select 'nation/' || n_nationkey::varchar as entity_id, n_name as entity_name, 0 as part from nation union all select 'region/' || r_regionkey::varchar, r_name, 1 from region),
h as (select question_id, entity_id, entity_name, row_number() over (partition by question_id order by length({_NORM.format('entity_name')}) desc, part, entity_id) as k from q join cat on contains({_NORM.format('question')}, {_NORM.format('entity_name')})),
e as (select * from h where k = 1),
t as ({star.triples_sql(('nation', 'region'), ('IN_REGION',))}),
c as (select question_id, list_sort(list_distinct(list(object))) as facts from e join t on t.subject = e.entity_id group by question_id),
p as (select q.*, e.entity_id, e.entity_name, coalesce(c.facts, []::varchar[]) as facts, case when e.entity_id is null then 'ENTITY_NOT_FOUND' when c.facts is null then 'NO_CONTEXT' else 'SUCCESS' end as status from q left join e using (question_id) left join c using (question_id)),
x as (select *, list_filter(expected_facts, lambda f: len(list_filter(facts, lambda g: contains(lower(g), lower(f)))) > 0) as matched, list_filter(expected_facts, lambda f: len(list_filter(facts, lambda g: contains(lower(g), lower(f)))) = 0) as missing from p),
y as (select *, case when len(expected_facts) > 0 then len(matched)::double / len(expected_facts) else 0.0 end::double as coverage, entity_id is not distinct from expected_entity_id as right_one from x)
"""


@query(_ASKED_SQL + "select question_id, status, entity_id, array_to_string(facts, ' | ') as context from p")
def context_package(spark, d):
    return _asked(spark, d)[1].select("question_id", "status", F.col("detected_entity.entity_id").alias("entity_id"), F.array_join("graph_context", " | ").alias("context"))


@query(_ASKED_SQL + f"select question_id, case when status = 'SUCCESS' then entity_name || ': ' || array_to_string(facts, ', ') else '{answer.NO_EVIDENCE}' end as answer, case when status = 'SUCCESS' then 'SUPPORTED' else 'INSUFFICIENT' end as evidence_status from p")
def answers(spark, d):
    return answer.answer(_asked(spark, d)[1]).select("question_id", "answer", "evidence_status")


@query(_ASKED_SQL + f"select question_id, case when status = 'SUCCESS' then entity_name || ': ' || array_to_string(facts, ', ') else '{answer.NO_EVIDENCE}' end as answer, question, status, case when status <> 'ENTITY_NOT_FOUND' then entity_id end as entity_id, case when status = 'SUCCESS' then array_to_string(facts, ' | ') else '' end as evidence, true as is_time from p")
def answer_trace(spark, d):
    field = lambda name: F.get_json_object("trace", f"$.{name}").alias(name)
    evidence = F.array_join(F.from_json(F.get_json_object("trace", "$.evidence"), "array<string>"), " | ").alias("evidence")
    time = F.get_json_object("trace", "$.generated_at").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}").alias("is_time")
    traced = answer.trace(answer.answer(_asked(spark, d)[1]))
    return traced.select("question_id", field("answer"), field("question"), field("status"), F.get_json_object("trace", "$.detected_entity.entity_id").alias("entity_id"), evidence, time)


@query(_ASKED_SQL + "select question_id, entity_id as detected_entity_id, right_one as entity_resolution_correct, array_to_string(matched, ' | ') as matched_facts, array_to_string(missing, ' | ') as missing_facts, coverage as retrieval_coverage, coverage = 1 and right_one as end_to_end_success from y")
def evaluate_details(spark, d):
    questions, package = _asked(spark, d)
    return evaluate.evaluate_details(questions, package).select("question_id", "detected_entity_id", "entity_resolution_correct", "matched_facts", "missing_facts", "retrieval_coverage", "end_to_end_success")


@query(_ASKED_SQL + "select count(*) as total_test_questions, round(avg(right_one::int::double) * 100, 2) as entity_resolution_accuracy_percent, round(avg(coverage) * 100, 2) as average_retrieval_coverage_percent, round(avg((coverage = 1)::int::double) * 100, 2) as retrieval_success_rate_percent, round(avg((coverage = 1 and right_one)::int::double) * 100, 2) as end_to_end_success_rate_percent from y")
def evaluate_summary(spark, d):
    questions, package = _asked(spark, d)
    return evaluate.evaluate_summary(evaluate.evaluate_details(questions, package))


@query("select doc_id as question_id from documents where length(text) >= 100")
def valid_questions(spark, d):
    return retrieval.valid_questions(_questions(spark, d), least=100).select("question_id")
