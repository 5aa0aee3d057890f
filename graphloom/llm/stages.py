"""The stages of the corpus pipeline: one operator each, from documents to documents, with all columns of its input.

Defined results, for every stage: an empty table gives no rows; extra columns are kept; texts are read whole, however long.

- language_id: texts without a letter, null and empty ones among them, go, and texts that the network finds to be no language
  throughout (random letters, keys, dumps); short texts stay; repeated rows are judged each for itself.
- ngram_jaccard: of a group the row with the smallest id stays, null last, then by a hash of the text; texts without words
  stay, as they are linked with nothing; of rows that repeat an id and its text one stays.
- decontaminate: rows with a null id or text are never dropped; rows that share an id go together.
- pii: every row stays; null texts stay null; n_chars, if there, is the new length.
- mix: size, source_size, target and taken are added, in place of columns of these names; documents of which nothing is
  taken, null and empty texts among them, go; null is a source of its own; ties and repeated rows are dealt by id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, jaccard, language, mixing, personal
from .common import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that show a language; those without a letter, or of random letters throughout, go."""
    return language.keep_identified(docs).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group that five-word shingles link at 0.8 or more."""
    return jaccard.drop_near_copies(docs, words=5, percent=80).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; n_chars follows the new text."""
    return personal.redact(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with their text and how many words it takes."""
    return mixing.mix_sources(docs, keep=docs.columns).where(F.col("taken") > 0)
