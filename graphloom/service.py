"""The calls that an application makes: about, health, entity, retrieve and ask, each from DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import utc_timestamp
from .operators import answer, retrieval


class GraphService:
    """A graph with its catalog and a generator of answers. HTTP, if wanted, is a thin layer over these methods."""

    def __init__(self, triples: DataFrame, catalog: DataFrame, generator: answer.Generator = answer.template_generator):
        self.triples, self.catalog, self.generator = triples, catalog, generator

    def about(self) -> DataFrame:
        """One row: the service's name and its calls."""
        return self.catalog.sparkSession.createDataFrame([("graphloom", ["about", "health", "entity", "retrieve", "ask"])], "service string, calls array<string>")

    def health(self) -> DataFrame:
        """One row: status, triples, entities, time."""
        entities = self.catalog.agg(F.count("*").alias("entities")).withColumn("one", F.lit(1))
        return self.triples.agg(F.count("*").alias("triples")).withColumn("one", F.lit(1)).join(entities, "one").select(F.when(F.col("triples") > 0, "ok").otherwise("empty").alias("status"), "triples", "entities", utc_timestamp().alias("time"))

    def entity(self, name: str) -> DataFrame:
        """The entity that a name or sentence mentions; no row if none."""
        asked = self.catalog.sparkSession.createDataFrame([(1, name)], "question_id int, question string")
        return retrieval.detect_entities(asked, self.catalog).drop("question_id")

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Context packages of questions (question_id, question) of three characters or more."""
        asked = retrieval.valid_questions(questions)
        found = retrieval.detect_entities(asked, self.catalog)
        return retrieval.context_package(asked, found, retrieval.context_by_type(self.triples, found))

    def ask(self, questions: DataFrame) -> DataFrame:
        """Answers to questions, each bound to the evidence that was retrieved."""
        return answer.answer(self.retrieve(questions), self.generator)
