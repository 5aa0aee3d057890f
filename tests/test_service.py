from graphloom.operators.retrieval import build_catalog
from graphloom.service import GraphService
from graphloom.sources import fixtures


def test_service(spark):
    catalog = build_catalog([(fixtures.fixture(spark, "threat_actors"), "actor_id", "actor_name", "ThreatActor"), (fixtures.fixture(spark, "malware"), "malware_id", "malware_name", "Malware")])
    service = GraphService(fixtures.security_graph(spark).cache(), catalog)
    assert all(hasattr(service, call) for call in service.about().first()["calls"])
    assert service.health().first()[:1] == ("ok",) and service.health().first()["entities"] == 10
    assert [r["entity_id"] for r in service.entity("solar-drop").collect()] == ["MAL001"]
    assert service.entity("nobody").count() == 0
    asked = spark.createDataFrame([(1, "What does HydraBot do?"), (2, "Who?"), (3, "x")], "question_id int, question string")
    got = {r["question_id"]: r for r in service.ask(asked).collect()}
    assert set(got) == {1, 2} and got[2]["evidence_status"] == "INSUFFICIENT"
    assert got[1]["evidence_status"] == "SUPPORTED" and "203.0.113.50" in got[1]["evidence"]
    assert service.retrieve(asked).where("status = 'SUCCESS'").count() == 1

    def broken(_):
        raise RuntimeError("down")

    assert GraphService(service.triples, catalog, broken).ask(asked).where("evidence_status = 'PARTIAL'").count() == 1
