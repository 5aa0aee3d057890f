"""Readers and writers: CSV, Parquet, JSON, plain text and the Turtle subset that graphs of this kind use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import TRIPLE, TYPE


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headered CSV file with a fixed schema. Empty fields are null; words like NA are data."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, each over any number of lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """Triples partitioned by predicate let every pattern read its own files only."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are written."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_text(lines: DataFrame, path: str) -> None:
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<iri><[^>\s]*>)|(?P<text>"(?:[^"\\]|\\.)*")(?P<type>\^\^\S+?(?=[\s;,.\])]))?|(?P<prefix>@prefix)|(?P<mark>[;,\[\]()])|(?P<dot>\.(?=\s|$))|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?=[\s;,.\])])|(?P<name>[A-Za-z_][\w-]*)?:(?P<local>[\w.-]*[\w-])?|(?P<word>a|true|false)(?=\s)')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def parse_turtle(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """(subject, predicate, object, object_kind, datatype) of a Turtle text: prefixes, `a`, `;`, `,`, strings, numbers,
    booleans, blank nodes in brackets and lists. Names keep their prefix (`ex:x`); IRIs under a declared prefix get it."""
    out: list[tuple[str, str, str, str, str | None]] = []
    prefixes: dict[str, str] = {}
    tokens: list[tuple[str, str, str | None]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"not understood at {text[at : at + 40]!r}")
        at = m.end()
        if m["iri"]:
            tokens.append(("iri", m["iri"][1:-1], None))
        elif m["text"] is not None:
            tokens.append(("literal", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m["text"][1:-1]), m["type"][2:] if m["type"] else "xsd:string"))
        elif m["prefix"]:
            tokens.append(("prefix", "", None))
        elif m["mark"] or m["dot"]:
            tokens.append(("mark", m["mark"] or ".", None))
        elif m["number"]:
            tokens.append(("literal", m["number"], "xsd:decimal" if "." in m["number"] else "xsd:integer"))
        elif m["word"]:
            tokens.append(("name", TYPE, None) if m["word"] == "a" else ("literal", m["word"], "xsd:boolean"))
        elif m[0].strip() and not m[0].startswith("#"):
            tokens.append(("name", f"{m['name'] or ''}:{m['local'] or ''}", None))
    place, blanks = 0, 0

    def short(kind: str, value: str) -> str:
        if kind == "iri":
            for p, base in prefixes.items():
                if base and value.startswith(base) and len(value) > len(base):
                    return f"{p}:{value[len(base) :]}"
        return value

    def node() -> tuple[str, str, str | None]:
        nonlocal place, blanks
        kind, value, datatype = tokens[place]
        place += 1
        if (kind, value) == ("mark", "["):
            blanks += 1
            name = f"_:b{blanks}"
            predicates(name, "]")
            return name, "iri", None
        if (kind, value) == ("mark", "("):
            items = []
            while tokens[place][:2] != ("mark", ")"):
                items.append(node())
            place += 1
            head = "rdf:nil"
            for obj in reversed(items):
                blanks += 1
                cell = f"_:b{blanks}"
                out.append((cell, "rdf:first", *obj))
                out.append((cell, "rdf:rest", head, "iri", None))
                head = cell
            return head, "iri", None
        return (value, "literal", datatype) if kind == "literal" else (short(kind, value), "iri", None)

    def predicates(subject: str, end: str) -> None:
        nonlocal place
        while tokens[place][:2] != ("mark", end):
            predicate = node()[0]
            while True:
                out.append((subject, predicate, *node()))
                if tokens[place][:2] != ("mark", ","):
                    break
                place += 1
            while tokens[place][:2] == ("mark", ";"):
                place += 1
        place += 1

    while place < len(tokens):
        if tokens[place][0] == "prefix":
            prefixes[tokens[place + 1][1][:-1]] = tokens[place + 2][1]
            place += 4
        else:
            predicates(node()[0], ".")
    return out


def read_turtle(spark: SparkSession, path: str, graph: str = "instances") -> DataFrame:
    """Triples of Turtle files, each parsed whole by one task; the set of triples. For ontologies, shapes and small graphs."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column("value").to_pylist():
                rows = parse_turtle(text or "")
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["subject", "predicate", "object", "object_kind", "datatype"])

    return spark.read.text(path, wholetext=True).mapInArrow(parse, TRIPLE.rpartition(",")[0]).withColumn("graph", F.lit(graph)).dropDuplicates(["subject", "predicate", "object"])


def turtle_lines(triples: DataFrame) -> DataFrame:
    """One Turtle statement for each subject; a subject's triples are gathered, never the graph."""
    text = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.replace("object", F.lit("\\"), F.lit("\\\\")), '"', r'\\"'), "\n", r"\\n"), F.lit('"'), F.when(F.col("datatype").isNotNull() & (F.col("datatype") != "xsd:string"), F.concat(F.lit("^^"), "datatype")).otherwise(""))
    pair = F.concat(F.when(F.col("predicate") == TYPE, "a").otherwise(F.col("predicate")), F.lit(" "), F.when(F.col("object_kind") == "iri", F.col("object")).otherwise(text))
    return triples.groupBy("subject").agg(F.array_sort(F.collect_set(pair)).alias("pairs")).select(F.concat("subject", F.lit(" "), F.array_join("pairs", " ; "), F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    head = triples.sparkSession.createDataFrame([(f"@prefix {p}: <{base}> .",) for p, base in prefixes.items()], "value string")
    body = turtle_lines(triples).withColumn("k", F.lit(1))
    head.withColumn("k", F.lit(0)).unionByName(body).repartition(1).sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)  # one file, as readers of Turtle expect
