"""URL filters: a tree of path templates for each host, judged by smoothed labelled purity.

1. Segments that are numbers, dates or long hexadecimal codes become classes at once (a file ending stays).
2. Level by level, from the root, a node whose children are many and thinly used is generalised: its children become `*`.
   Each level is two aggregations over the distinct paths, not pages, that still share a node with enough others.
3. From the deepest level up, branches whose share of bad labels does not differ significantly from that of all other branches
   of their parent together (two-proportion z-test with continuity correction) are merged, and go on as one branch of the level above; the others stand
   alone. Merging ends at the host. A branch is a template at first, later all that was merged below a node; a level is two
   aggregations over the branches that reach it.
4. A template is rejected if its smoothed share of bad labels reaches `least`; smoothing adds `weight` labels at the corpus' rate.

Rules come before the tree: of those that fit a host or one of its parent domains and start the path, the longest wins.

Everything is an aggregation or a join on a path's hash, whose hot keys are salted; nothing is gathered by host. Rules are
a bounded list given by the caller.

Defined results: a null URL, or one without `://`, has an empty host and path and is judged like every other host; a template
without labels has the corpus' rate, without any labels all are allowed; labels that disagree on a page count as bad;
repeated rows each come back; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, durable, salted_join, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_EXTENSION = r"(\.[A-Za-z][A-Za-z0-9]{0,5})?$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def by_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):  # the longest is tried first
        domain, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(path: Column) -> Column:
    """A path's segments with numbers, dates and codes as classes."""

    def one(segment: Column) -> Column:
        out = segment
        for pattern, name in ((r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "<id>"), (r"^(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{16,}", "<hex>"), (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>"), (r"^[0-9]+", "<n>")):
            out = F.regexp_replace(out, pattern + _EXTENSION, name + "$1")
        return out

    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), one)


def templates(paths: DataFrame, children: int, thin: float) -> DataFrame:
    """`paths` (key, host, segments, pages, labelled, bad) with `template` after generalisation and `steps`, the nodes above it.

    A node with fewer distinct paths below it than `children` can have no wide node below either, so its paths keep their
    segments and leave; a level reads only the paths that are left. Levels end at the deepest node with so many paths.
    """
    rows, done, level = durable(paths.withColumns({"template": F.col("host"), "steps": F.array("host")})), [], 0
    while not rows.isEmpty():
        rows = rows.withColumn("node", F.sha2(F.col("template"), 256)).withColumn("step", F.get(F.col("segments"), F.lit(level)))
        per_child = rows.where(F.col("step").isNotNull()).groupBy("node", "step").agg(F.sum("pages").alias("pages"), F.count("*").alias("paths"))
        nodes = per_child.groupBy("node").agg(F.count("*").alias("n"), F.sum("pages").alias("all_pages"), F.sum("paths").alias("all_paths")).where(F.col("all_paths") >= children)
        nodes = nodes.select("node", ((F.col("n") >= children) & (F.col("all_pages") < thin * F.col("n"))).alias("wide"))
        # nodes are fewer than paths, but one node may have most of them
        here = durable(salted_join(rows, nodes, "node", salts=8))
        on = F.col("wide").isNotNull() & F.col("step").isNotNull()
        rest = F.array_join(F.slice("segments", level + 1, 2147483647), "/")
        last = F.when(F.col("wide"), F.lit("*")).otherwise(F.col("step"))
        ended = F.col("step").isNull()
        done.append(here.where(~on).withColumns({"template": F.when(ended, F.col("template")).otherwise(F.concat("template", F.lit("/"), rest)), "steps": F.when(ended, F.col("steps")).otherwise(F.concat("steps", F.array(rest)))}).select(*paths.columns, "template", "steps"))
        rows = here.where(on).withColumns({"template": F.concat("template", F.lit("/"), last), "steps": F.concat("steps", F.array(last))}).select(*paths.columns, "template", "steps")
        level += 1
    return functools.reduce(DataFrame.unionByName, done) if done else rows


def branches(leaves: DataFrame, alike: float) -> DataFrame:
    """`leaves` (template, steps, labelled, bad) with `branch`: the template itself, or the highest node whose branches it merged with."""
    scratch = Scratch(leaves.sparkSession)
    waiting, done = scratch.table("leaves", leaves.withColumns({"branch": F.col("template"), "depth": F.size("steps") - 1})), []
    deepest = waiting.agg(F.max("depth").alias("depth")).first()["depth"] or 0
    share, both = F.col("bad") / F.greatest("labelled", F.lit(1)), F.col("all_bad") / F.greatest("all_labelled", F.lit(1))
    rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    spread = F.sqrt(both * (1 - both) * (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
    step = (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(rest, F.lit(1))) / 2  # continuity: one label alone says little
    differs = (F.col("labelled") > 0) & (rest > 0) & (F.abs(share - rest_bad / F.greatest(rest, F.lit(1))) - step > F.lit(alike) * F.greatest(spread, F.lit(1e-9)))
    for level in range(deepest, 0, -1):
        here = waiting.where(F.col("depth") == level).withColumn("parent", F.concat_ws("/", F.slice("steps", 1, level)))
        units = here.groupBy("branch", "parent").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        pool = units.groupBy("parent").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        tested = salted_join(units, pool, "parent", salts=8).select("branch", differs.alias("differs"))
        moved = salted_join(here, tested, "branch", salts=8)  # one branch may hold most templates
        merged = moved.withColumns({"branch": F.when(F.col("differs"), F.col("branch")).otherwise(F.concat("parent", F.lit("/~"))), "depth": F.lit(level - 1), "alone": F.col("differs")})
        columns = waiting.columns
        # a table, as a checkpoint keeps the constraints of its plan, which multiply from level to level
        above = scratch.table(f"above{level}", waiting.where(F.col("depth") < level).withColumn("alone", F.lit(False)).unionByName(merged.select(*columns, "alone")))
        done.append(above.where("alone").select(columns))
        waiting = above.where("not alone").select(columns)
    out = durable(functools.reduce(DataFrame.unionByName, done, waiting))
    scratch.drop()
    return out


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    children: int = 8,
    thin: float = 20.0,
    alike: float = 1.96,
    weight: float = 10.0,
    least: float = 0.6,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each row of `pages` (page_id, url).

    `labels` (page_id, bad 0 or 1) covers some of the pages. `purity` is the smoothed share of bad labels.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("segments", lexical(F.col("path"))).withColumn("key", F.sha2(F.concat_ws("\n", F.col("host"), F.array_join("segments", "/")), 256))
    parsed = durable(parsed.withColumn("ruled", by_rules(F.col("host"), F.col("path"), rules)))
    known = labels.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    marked = parsed.select("page_id", "key", "host", "segments").join(known, "page_id", "left")
    paths = marked.groupBy("key").agg(F.first("host").alias("host"), F.first("segments").alias("segments"), F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = durable(templates(paths, children, thin))

    rate = tree.agg((F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("rate")).first()["rate"] or 0.0
    leaves = tree.groupBy("template", "steps").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    grouped = branches(leaves, alike)
    merged = grouped.groupBy("branch").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).withColumn("purity", (F.col("b") + F.lit(weight * rate)) / (F.col("n") + F.lit(weight)))
    judged = salted_join(grouped.select("template", "branch"), merged.select("branch", "purity"), "branch", salts=8)
    by_key = salted_join(tree.select("key", "template"), judged.select("template", "purity"), "template", salts=8)  # one template may hold most paths
    out = salted_join(parsed, by_key, "key", salts=8)
    found = F.when(F.col("purity") >= least, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce(F.col("ruled.verdict"), found).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on all pages' URLs; a page is bad if the document whose number its path names is labelled of low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    numbered = pages.select("page_id", F.expr("try_cast(regexp_extract(url, '(?s)^.*?://[^/?#]*/[^/?#]*/([0-9]{1,18})', 1) as bigint)").alias("doc_id")).where(F.col("doc_id").isNotNull())
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    marked = numbered.join(labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return judge_urls(pages, marked)
