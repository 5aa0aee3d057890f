"""Questions to entities to context: detection, templates, context packages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_name
from .graph import neighborhood
from .patterns import edge_view, optional_hop, property_view

#: A catalog up to this size is sent to the texts; a larger one meets them on shared character grams.
CATALOG_BYTES = 8 << 20
GRAM = 8


def build_catalog(parts: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """entity_id, entity_name, entity_type, position from (table, id column, name column, type), in the given order."""
    out = None
    for k, (table, key, name, kind) in enumerate(parts):
        own = table.select(F.col(key).cast("string").alias("entity_id"), F.col(name).alias("entity_name"), F.lit(kind).alias("entity_type"), F.struct(F.lit(k).alias("part"), F.col(key).cast("string").alias("key")).alias("position"))
        out = own if out is None else out.unionByName(own)
    return out


def detect_entities(questions: DataFrame, catalog: DataFrame, key: str = "question_id", text: str = "question", gram: int = GRAM) -> DataFrame:
    """For each question the entity with the longest normalised name that it contains; equal lengths by position.

    A catalog of up to CATALOG_BYTES is sent to the texts as an automaton, which reads each text once whatever the number of
    names. Beyond that names of `gram` characters or more meet the texts on their first gram and are then verified; shorter
    names, few in kind, are looked up through every substring of their lengths.
    """
    names = catalog.withColumn("nn", normalize_name(F.col("entity_name"))).where("nn <> ''").groupBy("nn").agg(F.min_by(F.struct("entity_id", "entity_name", "entity_type", "position"), "position").alias("e"))
    size = names.agg(F.coalesce(F.sum(F.length("nn") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    q = questions.select(F.col(key).alias(key), normalize_name(F.col(text)).alias("nq"))
    if size > CATALOG_BYTES:
        return _detect_by_grams(q, names, key, gram)
    spark = questions.sparkSession
    rows = names.orderBy(F.desc(F.length("nn")), "e.position").select("nn", "e.entity_id", "e.entity_name", "e.entity_type").collect()  # CATALOG_BYTES at most
    known = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "rank long, entity_id string, entity_name string, entity_type string")
    sent = spark.sparkContext.broadcast([r["nn"] for r in rows])
    schema = q.select(key).withColumn("rank", F.lit(0).cast("long")).schema
    found = q.where("nq <> ''").mapInArrow(lambda batches: _first_names(batches, sent.value), schema)
    best = found.groupBy(key).agg(F.min("rank").alias("rank"))
    return best.join(F.broadcast(known), "rank").select(key, "entity_id", "entity_name", "entity_type")


def _first_names(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """key, rank of the first of `names` that each text of (key, text) holds; texts without one give no row."""
    automaton = ahocorasick.Automaton()
    for k, name in enumerate(names):
        automaton.add_word(name, k)
    if names:
        automaton.make_automaton()
    for batch in batches:
        best = [min((k for _, k in automaton.iter(t)), default=None) if names else None for t in batch.column(1).to_pylist()]
        ranks = pa.array(best, pa.int64())
        held = ranks.is_valid()
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(held), ranks.filter(held)], names=[batch.schema.names[0], "rank"])


def _detect_by_grams(q: DataFrame, names: DataFrame, key: str, gram: int) -> DataFrame:
    """`detect_entities` with a catalog of any size, from (key, nq) and (nn, e): all steps are joins."""
    # normalised text is ASCII, so bytes are characters and a gram is cut in constant time
    names = names.withColumn("probe", F.expr(f"substring(cast(nn as binary), 1, {gram})"))
    real = None
    for r in names.select(F.octet_length("probe").alias("n")).distinct().collect():  # at most `gram` sizes
        own = names.where(F.octet_length("probe") == r["n"]).select("probe", "nn", "e")
        grams = F.explode(F.expr(f"transform(sequence(1, length(nq) - {r['n']} + 1), i -> substring(cast(nq as binary), i, {r['n']}))")).alias("probe")
        # grams meet the catalog without the texts, which follow for real candidates only
        probes = q.where(F.length("nq") >= r["n"]).select(key, grams).distinct().join(own, "probe").select(key, "nn", "e")
        hits = probes.join(q, key).where(F.contains(F.col("nq"), F.col("nn"))).select(key, "nn", "e")
        real = hits if real is None else real.unionByName(hits)
    best = real.groupBy(key).agg(F.min_by("e", F.struct(-F.length("nn"), F.col("e.position"))).alias("e"))
    return best.select(key, "e.entity_id", "e.entity_name", "e.entity_type")


def actor_context(triples: DataFrame) -> DataFrame:
    """One row for each actor, malware and campaign combination; each optional group matches whole or is null."""
    actor = property_view(triples, "actor", {"actorName": "actor_name", "actorType": "actor_type", "primaryMotivation": "primary_motivation"})
    cve = edge_view(triples, "exploits", "malware", "vulnerability").join(property_view(triples, "vulnerability", {"cveId": "cve", "severity": "severity", "cvssScore": "cvss"}), "vulnerability").withColumn("cvss", F.expr("try_cast(cvss as double)")).drop("vulnerability")
    net = edge_view(triples, "communicatesWith", "malware", "domain").join(property_view(triples, "domain", {"domainName": "domain_name"}), "domain")
    ip = edge_view(triples, "resolvesTo", "domain", "ip").join(property_view(triples, "ip", {"ipAddress": "ip_address"}), "ip").drop("ip")
    net = optional_hop(net, ip, "domain").drop("domain")
    malware = edge_view(triples, "usesMalware", "actor", "malware").join(property_view(triples, "malware", {"malwareName": "malware_name", "malwareType": "malware_type"}), "malware")
    malware = optional_hop(optional_hop(malware, cve, "malware"), net, "malware").drop("malware")
    org = edge_view(triples, "targets", "campaign", "organization").join(property_view(triples, "organization", {"organizationName": "organization_name", "industry": "industry"}), "organization").drop("organization")
    campaign = edge_view(triples, "attributedToCampaign", "actor", "campaign").join(property_view(triples, "campaign", {"campaignName": "campaign_name", "attackVector": "attack_vector"}), "campaign")
    campaign = optional_hop(campaign, org, "campaign").drop("campaign")
    return optional_hop(optional_hop(actor, malware, "actor"), campaign, "actor").withColumnRenamed("actor", "entity_id")


def malware_context(triples: DataFrame) -> DataFrame:
    """One row for each malware with its actor, vulnerability and infrastructure, where there are any."""
    malware = property_view(triples, "malware", {"malwareName": "malware_name", "malwareType": "malware_type"})
    actor = edge_view(triples, "usesMalware", "actor", "malware").join(property_view(triples, "actor", {"actorName": "associated_actor"}), "actor").drop("actor")
    cve = edge_view(triples, "exploits", "malware", "vulnerability").join(property_view(triples, "vulnerability", {"cveId": "cve", "severity": "severity", "cvssScore": "cvss"}), "vulnerability").withColumn("cvss", F.expr("try_cast(cvss as double)")).drop("vulnerability")
    net = edge_view(triples, "communicatesWith", "malware", "domain").join(property_view(triples, "domain", {"domainName": "domain_name"}), "domain")
    ip = edge_view(triples, "resolvesTo", "domain", "ip").join(property_view(triples, "ip", {"ipAddress": "ip_address"}), "ip").drop("ip")
    net = optional_hop(net, ip, "domain").drop("domain")
    return optional_hop(optional_hop(optional_hop(malware, actor, "malware"), cve, "malware"), net, "malware").withColumnRenamed("malware", "entity_id")


def generic_context(triples: DataFrame, entity: str) -> DataFrame:
    """Outgoing (predicate, object) of one entity."""
    return neighborhood(triples, entity, "out").select("predicate", F.col("other").alias("object"))


def context_by_type(triples: DataFrame, detected: DataFrame, key: str = "question_id", both: bool = False) -> DataFrame:
    """(key, fact) rows for detected entities: their template's values by type, or the edges around them.

    `both` adds incoming edges to the generic branch.
    """

    def facts(context: DataFrame, kind: str) -> DataFrame:
        values = [F.col(c).cast("string") for c in context.columns if c != "entity_id"]
        return detected.where(F.col("entity_type") == kind).select(key, "entity_id").join(context, "entity_id").select(key, F.explode(F.array_compact(F.array(*values))).alias("fact"))

    other = detected.where(~F.col("entity_type").isin("ThreatActor", "Malware")).select(key, "entity_id")
    generic = other.join(triples.select(F.col("subject").alias("entity_id"), F.col("object").alias("fact")), "entity_id").select(key, "fact")
    if both:
        generic = generic.unionByName(other.join(triples.where("object_kind = 'iri'").select(F.col("object").alias("entity_id"), F.col("subject").alias("fact")), "entity_id").select(key, "fact"))
    return facts(actor_context(triples), "ThreatActor").unionByName(facts(malware_context(triples), "Malware")).unionByName(generic)


def context_package(questions: DataFrame, detected: DataFrame, facts: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    """question, status, detected_entity and graph_context (sorted, distinct facts) of each question."""
    gathered = facts.groupBy(key).agg(F.sort_array(F.collect_set("fact")).alias("graph_context"))
    rows = questions.join(detected, key, "left").join(gathered, key, "left").withColumn("graph_context", F.coalesce("graph_context", F.array().cast("array<string>")))
    status = F.when(F.col("entity_id").isNull(), "ENTITY_NOT_FOUND").when(F.size("graph_context") == 0, "NO_CONTEXT").otherwise("SUCCESS")
    return rows.select(key, text, status.alias("status"), F.when(F.col("entity_id").isNotNull(), F.struct("entity_id", "entity_name", "entity_type")).alias("detected_entity"), "graph_context")


def valid_questions(questions: DataFrame, text: str = "question", least: int = 3) -> DataFrame:
    return questions.where(F.length(text) >= least)
