"""Known results on the small security graph."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import describe, http_hint, normalize_name, redact, severity_bucket
from graphloom.operators import answer, evaluate, graph, matching, patterns, profile, retrieval, review, rules, shapes
from graphloom.sources import fixtures, io


@pytest.fixture(scope="module")
def triples(spark):
    return fixtures.security_graph(spark).cache()


@pytest.fixture(scope="module")
def faulty(spark):
    return fixtures.security_graph(spark, faulty=True).cache()


def sem(triples):
    out = rules.edge_rules(triples, fixtures.RULES).unionByName(rules.bucket_rule(triples, "Vulnerability", "cvssScore", "severity", "SEM009", "Severity fits the score"))
    out = out.unionByName(rules.path_rule(triples, "ThreatActor", [["usesMalware", "exploits"], ["attributedToCampaign", "targets"]], "SEM010", "Complete actor path", "Critical"))
    return out.unionByName(rules.path_rule(triples, "Malware", [["communicatesWith", "resolvesTo"]], "SEM011", "Infrastructure path", "High"))


def test_sizes(triples, faulty):
    assert triples.where("graph = 'instances'").count() == 165
    assert triples.where("graph = 'ontology'").count() == 152 and triples.count() == 317
    assert faulty.count() == 332
    kinds = {r["kind"]: r["n"] for r in graph.inspect_ontology(triples).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"owl:Class": 9, "owl:ObjectProperty": 6, "owl:DatatypeProperty": 21}
    assert len(fixtures.shape_constraints()) > 60 and len({(c.shape, c.path) for c in fixtures.shape_constraints()}) == 27 - 1


def test_labels_and_comments(triples):
    said = {(r["subject"], r["predicate"]): r["object"] for r in triples.where("predicate in ('rdfs:label', 'rdfs:comment')").collect()}
    assert said["attributedToCampaign", "rdfs:label"] == "attributed to campaign" and said["IPAddress", "rdfs:label"] == "IP address"
    described = {r["subject"] for r in triples.where("predicate = 'rdf:type' and object in ('owl:Ontology', 'owl:Class', 'owl:ObjectProperty')").collect()}
    assert {s for s, p in said if p == "rdfs:comment"} == described


def test_ontology_through_turtle(triples, tmp_path):
    """The layout in which ontologies are shipped: a line for each predicate, sections as comments, no blank before the end."""
    text = """# ======
# 1. CLASSES
# ======
@prefix ex:   <http://example.org/x/> .
@prefix rdf:  <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl:  <http://www.w3.org/2002/07/owl#> .

ex:Tool
    rdf:type owl:Class ;
    rdfs:subClassOf ex:Thing ;
    rdfs:label "Tool" ;
    rdfs:comment "A tool; with marks, # and \\"quotes\\"." .


# Tool -> Tool

ex:needs
    rdf:type owl:ObjectProperty ;
    rdfs:domain ex:Tool ;
    rdfs:range ex:Tool, ex:Thing ."""
    got = [r[:3] for r in (tuple(x) for x in io.parse_turtle(text))]
    assert got == [
        ("ex:Tool", "rdf:type", "owl:Class"), ("ex:Tool", "rdfs:subClassOf", "ex:Thing"), ("ex:Tool", "rdfs:label", "Tool"), ("ex:Tool", "rdfs:comment", 'A tool; with marks, # and "quotes".'),
        ("ex:needs", "rdf:type", "owl:ObjectProperty"), ("ex:needs", "rdfs:domain", "ex:Tool"), ("ex:needs", "rdfs:range", "ex:Tool"), ("ex:needs", "rdfs:range", "ex:Thing"),
    ]


def test_texts_of_datatypes(spark):
    values = {"xsd:integer": ("-12", "1.0"), "xsd:boolean": ("true", "yes"), "xsd:double": ("-1.5E3", "1,5"), "xsd:date": ("2026-02-28", "2026-13-01"), "xsd:dateTime": ("2026-02-28T10:00:00Z", "2026-02-28 10:00"), "xsd:string": ("any", None)}
    rows = [(f"{k}{i}", p, v, kind, t) for i, (d, pair) in enumerate(values.items()) for k, text in zip("ab", pair, strict=True) if text for p, v, kind, t in (("rdf:type", "Thing", "iri", None), (d, text, "literal", d))]
    found = shapes.validate(graph.literal_graph(spark, rows, "t"), [shapes.Constraint("S", "Thing", d, "datatype", d, "m") for d in values])
    assert sorted(r["value"] for r in found.collect()) == sorted(bad for _, bad in values.values() if bad)


def test_rules(triples, faulty):
    assert rules.quality_score(sem(triples)).first() == (54, 53, 1, 97.08)
    assert rules.quality_score(sem(faulty)).first() == (60, 54, 6, 88.31)
    assert [r["entity"] for r in sem(triples).where("status = 'FAIL'").collect()] == ["TA005"]


def test_shapes(triples, faulty):
    c = fixtures.shape_constraints()
    assert shapes.conforms(shapes.validate(triples, c)).first() == (True, 0)
    found = shapes.validate(faulty, c)
    assert {(r["focus"], r["component"]) for r in found.collect()} == {("CVE_INVALID_001", "maxInclusive"), ("CVE_INVALID_002", "in"), ("TA999", "minCount")}
    assert shapes.report(found).count() == 3


def test_subclass_instances_are_checked(spark, triples):
    found = shapes.validate(triples, [shapes.Constraint("s", "Infrastructure", "label", "minCount", 1)])
    assert found.count() == 10


def test_resolution(spark):
    actors, malware = fixtures.fixture(spark, "threat_actors"), fixtures.fixture(spark, "malware")
    pool = actors.select(F.col("actor_id").alias("canonical_id"), F.col("actor_name").alias("canonical_name"), F.lit("ThreatActor").alias("entity_type"), F.col("actor_id").alias("position"))
    pool = pool.unionByName(malware.select(F.col("malware_id").alias("canonical_id"), F.col("malware_name").alias("canonical_name"), F.lit("Malware").alias("entity_type"), F.col("malware_id").alias("position")))
    pool = pool.withColumn("position", F.regexp_extract("position", "([0-9]+)", 1).cast("int"))
    got = {r["incoming_id"]: r for r in matching.resolve(fixtures.fixture(spark, "incoming"), pool).collect()}
    assert sum(r["match_method"] == "NORMALIZED_EXACT_MATCH" for r in got.values()) == 8
    assert (got["INC005"]["canonical_name"], got["INC005"]["similarity_score"], got["INC005"]["decision"]) == ("Crimson Fox", 0.0876, "NEW_ENTITY")
    assert (got["INC010"]["canonical_name"], got["INC010"]["similarity_score"], got["INC010"]["decision"]) == ("SilentLoader", 0.0804, "NEW_ENTITY")
    only = matching.tfidf_match(fixtures.fixture(spark, "incoming").where("incoming_id = 'INC001'"), pool).first()
    assert (only["canonical_id"], only["similarity_score"]) == ("TA001", 0.4493)


def test_review(spark):
    incoming = fixtures.fixture(spark, "incoming").withColumn("position", F.regexp_extract("incoming_id", "([0-9]+)", 1).cast("int"))
    rows = incoming.withColumns({"top_name": F.lit("SolarDrop"), "top_id": F.lit("MAL001"), "top_vector_score": F.lit(0.8)})
    done = review.apply_review(review.routed(review.decide(rows)), fixtures.fixture(spark, "reviews"))
    ids = {r["incoming_id"]: r["final_canonical_id"] for r in done.collect()}
    assert ids["INC006"] == "MAL001" and ids["INC005"] == "TA9001" and ids["INC010"] == "MAL9001" and ids["INC003"] == "TA002"
    total = review.review_summary(done).first()
    assert total[:4] == (10, 1, 9, 0) and total[4] == 10.0
    assert review.final_mapping(done).count() == review.feedback(done).count() == 10

    def broken(_):
        raise RuntimeError("down")

    assert {r["model_decision"] for r in review.decide(rows, broken).collect()} == {"UNCERTAIN"}


def test_a_row_that_a_model_fails_on_is_uncertain(spark):
    rows = spark.range(40).selectExpr("id", "cast(id as string) as incoming_name", "struct(id as a) as nested", "'old' as reasoning")

    def ask(batch):
        if (batch["id"] % 7 == 3).any():
            raise ValueError("no answer")
        answers = batch[["id"]].copy()
        answers["model_decision"], answers["selected_canonical_id"], answers["selected_canonical_name"], answers["model_confidence"], answers["reasoning"] = "REUSE", batch["incoming_name"], None, 0.9, "asked"
        return answers

    got = review.decide(rows, review.by_batch(ask)).collect()
    assert len(got) == 40 and all(r["nested"]["a"] == r["id"] for r in got)
    for r in got:
        want = ("UNCERTAIN", None, 0.0, "ValueError") if r["id"] % 7 == 3 else ("REUSE", str(r["id"]), 0.9, "asked")
        assert (r["model_decision"], r["selected_canonical_id"], r["model_confidence"], r["reasoning"]) == want
    assert {r["reasoning"] for r in review.by_batch(lambda batch: batch.head(0))(rows).collect()} == {"ValueError"}  # too few answers
    assert review.by_batch(ask)(rows.limit(0)).count() == 0


def test_a_package_that_a_generator_fails_on_is_partial(spark):
    entity = "struct(cast(id as string) as entity_id, 'n' as entity_name) as detected_entity"
    packages = spark.range(6).selectExpr("cast(id as int) as question_id", "'q' as question", "if(id = 5, 'NO_CONTEXT', 'SUCCESS') as status", entity, "array('fact', cast(id as string)) as graph_context")

    def ask(batch):
        if 2 in set(batch["question_id"]):
            raise TimeoutError
        return batch.assign(answer="a", evidence=batch["graph_context"], entities_used=[["e"]] * len(batch), confidence=1.0, evidence_status="SUPPORTED")

    got = {r["question_id"]: r for r in answer.answer(packages, answer.by_batch(ask)).collect()}
    assert {k: r["evidence_status"] for k, r in got.items()} == {0: "SUPPORTED", 1: "SUPPORTED", 2: "PARTIAL", 3: "SUPPORTED", 4: "SUPPORTED", 5: "INSUFFICIENT"}
    assert got[2]["evidence"] == ["fact", "2"] and got[2]["answer"] == answer.FAILED and got[3]["entities_used"] == ["e"]


def test_ids_are_minted_across_ranges_once_for_each(spark):
    rows = [(f"i{k}", ["ThreatActor", "Malware", "Gadget", None][k % 4], k * 3) for k in range(60)] + [("i0", "ThreatActor", 500), ("none", "Malware", None)]
    got = {r["incoming_id"]: r["new_id"] for r in review.mint_ids(spark.createDataFrame(rows, "incoming_id string, entity_type string, position int"), width=16).collect()}
    assert len(got) == 61 and got["none"] == "MAL9001"  # no position comes first
    assert [got[f"i{k}"] for k in range(0, 60, 4)] == [f"TA{9001 + n}" for n in range(15)]
    assert [got[f"i{k}"] for k in range(1, 60, 4)] == [f"MAL{9002 + n}" for n in range(15)]
    assert {got[f"i{k}"] for k in range(60) if k % 4 > 1} == {"NEW_UNKNOWN"}


def test_reviews_that_repeat_a_name_make_no_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x", "Malware", "p", "P", 0.7), (2, "a", "x", "Malware", "p", "P", 0.7)], "position int, incoming_id string, incoming_name string, entity_type string, top_name string, top_id string, top_vector_score double")
    said = spark.createDataFrame([("x", "REUSE", "M2", "m2"), ("x", "REUSE", "M1", "m1"), ("x", "NEW_ENTITY", None, None)], "incoming_name string, reviewer_decision string, canonical_id string, canonical_name string")
    got = review.apply_review(review.routed(review.decide(rows)), said).collect()
    assert [(r["final_decision"], r["final_canonical_id"]) for r in got] == [("NEW_ENTITY", "MAL9001")] * 2


def catalog(spark):
    f = lambda n: fixtures.fixture(spark, n)
    return retrieval.build_catalog([(f("threat_actors"), "actor_id", "actor_name", "ThreatActor"), (f("malware"), "malware_id", "malware_name", "Malware"), (f("campaigns"), "campaign_id", "campaign_name", "Campaign"), (f("organizations"), "organization_id", "organization_name", "Organization"), (f("domains"), "domain_id", "domain_name", "Domain"), (f("vulnerabilities"), "cve_id", "cve_id", "Vulnerability")])


def test_evaluation(spark, triples):
    questions = fixtures.fixture(spark, "labelled_questions")
    detected = retrieval.detect_entities(questions, catalog(spark))
    package = retrieval.context_package(questions.select("question_id", "question"), detected, retrieval.context_by_type(triples, detected, both=True))
    details = evaluate.evaluate_details(questions, package)
    assert evaluate.evaluate_summary(details).first() == (10, 100.0, 100.0, 100.0, 100.0)
    unknown = spark.createDataFrame([(1, "who knows?"), (2, "hi")], "question_id int, question string")
    none = retrieval.detect_entities(unknown, catalog(spark))
    said = answer.answer(retrieval.context_package(unknown, none, retrieval.context_by_type(triples, none)))
    assert {r["evidence_status"] for r in said.collect()} == {"INSUFFICIENT"}
    assert retrieval.valid_questions(unknown).count() == 1
    assert answer.trace(answer.answer(package)).count() == 10


def test_contexts(triples):
    actors = retrieval.actor_context(triples)
    assert len(actors.columns) == 15 and actors.where("entity_id = 'TA001'").count() == 2
    lone = actors.where("entity_id = 'TA005'").collect()
    assert len(lone) == 1 and lone[0]["campaign_name"] is None and lone[0]["cvss"] == 8.8
    assert len(retrieval.malware_context(triples).columns) == 9 and retrieval.malware_context(triples).count() == 5
    assert retrieval.generic_context(triples, "CAM001").count() == 6
    assert graph.neighborhood(triples, "MAL001").count() == 7


def test_profile(spark):
    edges = fixtures.fixture(spark, "relationships")
    ids = fixtures.fixture(spark, "threat_actors").select(F.col("actor_id").alias("id"))
    assert profile.relationship_quality(edges, ids).first() == (29, 6, 20, 29, 0)
    assert profile.broken_references(edges, ids, "source_id").count() == 20
    odd = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    assert profile.profile_table(odd, "odd", "k").first() == ("odd", 3, 2, 2, 1, 1)


def test_unknown_edges(spark):
    edges = spark.createDataFrame([("a", "KNOWS", "b"), ("a", "TARGETS", "b"), ("a", "TARGETS", "b"), (None, "TARGETS", "b")], "source_id string, relationship string, target_id string")
    assert graph.unmapped_edges(edges, fixtures.PREDICATES).count() == 1
    assert graph.edges_to_triples(edges, fixtures.PREDICATES).count() == 2


def test_optional_group_is_all_or_nothing(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    block = spark.createDataFrame([("a", "m")], "k string, m string").join(spark.createDataFrame([("x", 1)], "m string, n int"), "m")
    assert all(r["m"] is None and r["n"] is None for r in patterns.optional_hop(left, block, "k").collect())


def test_turtle_round_trip(spark, triples, tmp_path):
    own = triples.where("graph = 'instances'").withColumns({c: F.when(F.col("object_kind") == "iri", F.concat(F.lit("ex:"), c)).otherwise(F.col(c)) if c == "object" else F.concat(F.lit("ex:"), c) for c in ("subject", "object")}).withColumn("predicate", F.when(F.col("predicate") == "rdf:type", "rdf:type").otherwise(F.concat(F.lit("ex:"), "predicate")))
    path = str(tmp_path / "ttl")
    io.write_turtle(own, path, {"ex": "http://example.org/x/", "xsd": "http://www.w3.org/2001/XMLSchema#"})
    back = io.read_turtle(spark, path)
    key = ["subject", "predicate", "object", "object_kind", "datatype"]
    assert sorted(map(str, own.select(key).collect())) == sorted(map(str, back.select(key).collect()))


def test_turtle_subset():
    got = io.parse_turtle('@prefix ex: <http://e/> .\n# note\nex:a a ex:B ; ex:p "x\\"y", 1.5 ; ex:q [ ex:r ex:s ] , ( "u" "v" ) .\n<http://e/c> ex:p true .')
    assert ("ex:a", "ex:p", 'x"y', "literal", "xsd:string") in got and ("ex:a", "ex:p", "1.5", "literal", "xsd:decimal") in got
    assert ("ex:c", "ex:p", "true", "literal", "xsd:boolean") in got and len(got) == 11


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", "NA"), ("2", None)], "id string, name string")
    io.write_csv(rows, str(tmp_path / "c"))
    assert sorted(io.read_csv(spark, str(tmp_path / "c"), "id string, name string").collect()) == sorted(rows.collect(), key=lambda r: r["id"])
    io.write_json(rows, str(tmp_path / "j"))
    assert io.read_json(spark, str(tmp_path / "j"), "id string, name string").where("name is null").count() == 1
    io.write_parquet(rows, str(tmp_path / "p"), "id")
    assert io.read_parquet(spark, str(tmp_path / "p")).count() == 2
    io.write_text(rows.select("id"), str(tmp_path / "t"))


def test_functions(spark):
    row = spark.range(1).select(normalize_name(F.lit("Ápt-29 x")), normalize_name(F.lit(None)), severity_bucket(F.lit(3.95)), severity_bucket(F.lit(15.5)), redact(F.lit("key abc!"), "abc"), http_hint(F.lit(429)), describe(F.lit("Malware"), F.lit("A"), F.lit("Loader"))).first()
    assert tuple(row) == ("pt29x", "", "Low", "Critical", "key [REDACTED]!", "Too many requests; wait.", "A is a Loader malware.")
