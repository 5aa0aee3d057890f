"""Operators that SQL can express, against it; all queries' columns and digests."""

import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from parity import connect, same  # noqa: E402

from graphloom.llm import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert same(registry.queries()[name](spark, DATA), connect(DATA), registry.oracle_sql()[name]) == ""


def test_no_python_in_native_plan(spark):
    plan = registry.queries()["op3_quality_rules"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


@pytest.mark.parametrize("name", ["op8_secret_scans", "op10_personal_data"])
def test_digests(spark, name):
    rows = registry.queries()[name](spark, DATA).collect()
    base = {"op8_secret_scans": ("assign", "access", "hex"), "op10_personal_data": ("email", "ip", "card", "phone")}[name]
    for r in rows:
        spans = [s for s in r["spans"].split(",") if s]
        own = [s for s in spans if s.split(":")[0] in base]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == r["base_sha256"]
        assert [sum(s.startswith(k + ":") for s in own) for k in base] == [r[f"n_{k}"] for k in base]
