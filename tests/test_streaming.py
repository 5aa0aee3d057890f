from pyspark.sql import functions as F

from graphloom.operators.retrieval import build_catalog
from graphloom.sources import fixtures
from graphloom.streaming.detect import detect_stream


def test_stream_of_questions(spark, tmp_path):
    fixtures.fixture(spark, "labelled_questions").select("question_id", "question").write.parquet(str(tmp_path / "in"))
    catalog = build_catalog([(fixtures.fixture(spark, "threat_actors"), "actor_id", "actor_name", "ThreatActor")])
    stream = spark.readStream.schema("question_id int, question string").parquet(str(tmp_path / "in"))
    detect_stream(stream, catalog, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).select("question_id", F.col("entity_id")).collect()
    assert {r["question_id"]: r["entity_id"] for r in found} == {1: "TA001", 2: "TA001", 3: "TA001", 8: "TA003", 10: "TA004"}
