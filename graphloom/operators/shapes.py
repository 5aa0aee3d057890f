"""Shape validation: constraints as rows, violations as rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import TYPE, ancestors

VIOLATION = ("shape", "path", "component", "focus", "value", "message")


@dataclass(frozen=True)
class Constraint:
    """One component of a property shape. `parameter` is a number, a pattern, a class, a datatype or a list of values."""

    shape: str
    target_class: str
    path: str
    component: str
    parameter: object
    message: str = ""


def validate(triples: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """Violations, one for each focus and path (counts) or each value (all others). `triples` is a set.

    All counts are one aggregation by subject. All tests of values are one join of the values with their subjects' classes,
    and tests of a value's class one more. A class stands for all below it in the ontology.
    """
    above = ancestors(triples)
    below = {t: sorted({t} | {c for c, up in above.items() if t in up}) for t in {c.target_class for c in constraints} | {c.parameter for c in constraints if c.component == "class"}}
    kind = F.col("predicate") == TYPE
    out = None

    def in_class(name: str):
        return kind & F.col("object").isin(*below[name])

    def paths(own: list[Constraint]):
        return F.col("predicate").isin(*sorted({c.path for c in own}))

    counted = [c for c in constraints if c.component in ("minCount", "maxCount")]
    if counted:
        targets, named = sorted({c.target_class for c in counted}), sorted({c.path for c in counted})
        per = triples.where(paths(counted) | kind & F.col("object").isin(*{x for t in targets for x in below[t]})).groupBy(F.col("subject").alias("focus"))
        rows = per.agg(*[F.max(in_class(t)).alias(f"is{k}") for k, t in enumerate(targets)], *[F.count_if(F.col("predicate") == p).alias(f"n{k}") for k, p in enumerate(named)])
        found = []
        for c in counted:
            n = F.col(f"n{named.index(c.path)}")
            found.append(F.when(F.col(f"is{targets.index(c.target_class)}") & ((n < c.parameter) if c.component == "minCount" else (n > c.parameter)), _row(c, F.lit(None).cast("string"))))
        out = _add(out, rows.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v"), "focus"))
    each = [c for c in constraints if c.component not in ("minCount", "maxCount")]
    if each:
        targets = sorted({c.target_class for c in each})
        focus = triples.where(kind & F.col("object").isin(*{x for t in targets for x in below[t]})).groupBy(F.col("subject").alias("focus")).agg(*[F.max(in_class(t)).alias(f"is{k}") for k, t in enumerate(targets)])
        values = triples.where(paths(each)).select(F.col("subject").alias("focus"), "predicate", F.col("object").alias("value"), "datatype").join(focus, "focus")

        def holds(c: Constraint):
            return F.col(f"is{targets.index(c.target_class)}") & (F.col("predicate") == c.path)

        tests = [c for c in each if c.component != "class"]
        if tests:
            found = [F.when(holds(c) & _bad(c), _row(c, F.col("value"))) for c in tests]
            out = _add(out, values.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v"), "focus"))
        classes = [c for c in each if c.component == "class"]
        if classes:
            wanted = [F.when(holds(c), F.struct(F.lit(c.parameter).alias("class"), _row(c, F.col("value")).alias("v"))) for c in classes]
            asked = values.select("focus", "value", F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("w")).select("focus", "value", "w.class", "w.v")
            held = [F.when(in_class(p), F.lit(p)) for p in sorted({c.parameter for c in classes})]
            members = triples.where(kind).select(F.col("subject").alias("value"), F.explode(F.filter(F.array(*held), lambda x: x.isNotNull())).alias("class"))
            out = _add(out, asked.join(members, ["value", "class"], "left_anti").select("v", "focus"))
    return out


def _row(c: Constraint, value):
    return F.struct(F.lit(c.shape).alias("shape"), F.lit(c.path).alias("path"), F.lit(c.component).alias("component"), value.alias("value"), F.lit(c.message).alias("message"))


def _add(out, found):
    found = found.select("v.shape", "v.path", "v.component", "focus", "v.value", "v.message")
    return found if out is None else out.unionByName(found)


#: What the text of a literal must look like, by its datatype; others take any text.
LEXICAL = {
    "xsd:integer": r"^[+-]?[0-9]+$",
    "xsd:boolean": r"^(true|false|0|1)$",
    "xsd:double": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "xsd:date": r"^-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "xsd:dateTime": r"^-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
}


def _bad(c: Constraint):
    value, number = F.col("value"), F.expr("try_cast(value as double)")
    if c.component == "pattern":
        return ~value.rlike(c.parameter)
    if c.component == "minLength":
        return F.length(value) < c.parameter
    if c.component == "in":
        return ~value.isin(*c.parameter)
    if c.component == "minInclusive":
        return number.isNull() | (number < c.parameter)
    if c.component == "maxInclusive":
        return number.isNull() | (number > c.parameter)
    if c.component == "datatype":
        wrong = ~F.col("datatype").eqNullSafe(c.parameter)
        if c.parameter == "xsd:decimal":
            return wrong | number.isNull()
        return wrong | ~value.rlike(LEXICAL[c.parameter]) if c.parameter in LEXICAL else wrong
    raise ValueError(c.component)


def conforms(violations: DataFrame) -> DataFrame:
    """One row: whether there is no violation, and how many there are."""
    return violations.agg((F.count("*") == 0).alias("conforms"), F.count("*").alias("violations"))


def report(violations: DataFrame) -> DataFrame:
    """One line of text for each violation."""
    return violations.select(F.concat_ws(" | ", "shape", "path", "component", "focus", F.coalesce("value", F.lit("-")), "message").alias("line"))
