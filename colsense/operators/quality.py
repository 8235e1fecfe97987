"""Checks of nested enrichment records, and plans for governance tables."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


@F.pandas_udf(BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    """Whether a pattern is a regular expression of Python; Java's differ."""

    def ok(p) -> bool:
        try:
            re.compile(p)
            return True
        except (re.error, TypeError):
            return False

    return patterns.map(ok)


@F.pandas_udf(BooleanType())
def matched(values: pd.Series, patterns: pd.Series) -> pd.Series:
    """Whether a value fits a pattern of Python; a broken pattern fits nothing."""
    known: dict = {}

    def fit(v, p):
        if p not in known:
            try:
                known[p] = re.compile(p)
            except (re.error, TypeError):
                known[p] = None
        return bool(known[p] and known[p].search(v or ""))

    return pd.Series([fit(v, p) for v, p in zip(values, patterns)])


def checks(payloads: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(code, check, passed) of payloads (code, prototypes, patterns, hints, anti array<struct<value,tag>>, parent_path array).

    A check without anything to look at passes.
    """
    p = payloads
    rows = []
    pats = p.select("code", F.explode("patterns").alias("pattern"))
    rows.append(pats.withColumn("ok", compiles("pattern")).groupBy("code").agg(F.min("ok").alias("passed")).select("code", F.lit("patterns_compile").alias("check"), "passed"))
    fits = p.select("code", F.explode("prototypes").alias("value"), "patterns").select("code", "value", F.explode("patterns").alias("pattern")).withColumn("ok", matched("value", "pattern"))
    per = fits.groupBy("code", "value").agg(F.max("ok").alias("ok"))
    rows.append(per.groupBy("code").agg((F.avg(F.col("ok").cast("double")) >= 0.5).alias("passed")).select("code", F.lit("prototypes_match").alias("check"), "passed"))
    tags = p.select("code", F.explode("anti").alias("a")).select("code", F.col("a.tag").alias("tag")).join(nodes.select(F.col("code").alias("tag"), F.lit(True).alias("known")), "tag", "left")
    rows.append(tags.groupBy("code").agg(F.min(F.coalesce("known", F.lit(False))).alias("passed")).select("code", F.lit("confusables_exist").alias("check"), "passed"))
    rows.append(p.join(paths, "code", "left").select("code", F.lit("path_consistent").alias("check"), F.coalesce(F.col("parent_path") == F.col("path"), F.lit(False)).alias("passed")))
    rows.append(p.select("code", F.lit("hints_present").alias("check"), F.exists("hints", lambda h: F.trim(h) != "").alias("passed")))
    rows.append(p.select("code", F.lit("no_contradiction").alias("check"), (F.size(F.array_intersect("prototypes", F.transform("anti", lambda a: a["value"]))) == 0).alias("passed")))
    found = reduce(DataFrame.union, rows)
    names = F.explode(F.array(*map(F.lit, ("patterns_compile", "prototypes_match", "confusables_exist", "path_consistent", "hints_present", "no_contradiction")))).alias("check")
    return p.select("code", names).join(found, ["code", "check"], "left").select("code", "check", F.coalesce("passed", F.lit(True)).alias("passed"))


def report(found: DataFrame) -> DataFrame:
    """(code, n, n_failed, failed) of a suite of checks."""
    bad = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))), ",")
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("passed")).alias("n_failed"), bad.alias("failed"))


def annotation_text() -> Column:
    """Label, description, up to 10 values, 10 names, 5 patterns and the path of a payload as text."""
    part = lambda name, c, k: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(c, 1, k), ", ")))
    return F.concat_ws(" | ", F.col("label"), F.col("description"), part("values", F.col("prototypes"), 10), part("names", F.col("hints"), 10), part("patterns", F.col("patterns"), 5), part("path", F.col("parent_path"), 99))


def to_build(wanted: DataFrame, built: DataFrame) -> DataFrame:
    """Rows whose content key is not built yet."""
    return wanted.join(built.select("content_key"), "content_key", "left_anti")


def final(artifacts: DataFrame, signature: DataFrame) -> DataFrame:
    """(artifact, final, reasons) of artifacts (artifact, signature, current, complete) against the vocabulary's signature."""
    j = artifacts.crossJoin(F.broadcast(signature.select(F.col("signature").alias("now"))))
    reasons = F.array_compact(F.array(F.when(F.col("signature") != F.col("now"), F.lit("signature")), F.when(~F.col("current"), F.lit("not_current")), F.when(~F.col("complete"), F.lit("incomplete"))))
    return j.select("artifact", (F.size(reasons) == 0).alias("final"), F.array_join(reasons, ",").alias("reasons"))


def table_problem(name: Column, columns: Column) -> Column:
    """The first rule that a generated table breaks, or null; columns: array<struct<name,labelled,values>>."""
    names = F.transform(columns, lambda c: F.lower(c["name"]))
    return (
        F.when((F.trim(name) == "") | (F.length(name) > 80), "table_name")
        .when(F.size(columns) < 2, "few_columns")
        .when(F.exists(columns, lambda c: (F.trim(c["name"]) == "") | (F.length(c["name"]) > 80)), "column_name")
        .when(F.size(F.array_distinct(names)) < F.size(names), "duplicate_column")
        .when(F.exists(columns, lambda c: F.exists(c["values"], lambda v: (F.trim(v) == "") | (F.length(v) > 80))), "value")
        .when(F.size(F.filter(columns, lambda c: c["labelled"])) != 1, "labelled_columns")
    )


# Governance.


def sync_plan(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(type_name, depth, action): create or skip, parents first."""
    j = wanted.join(existing.select("type_name", F.lit(True).alias("there")), "type_name", "left")
    return j.select("type_name", "depth", F.when(F.col("there"), "skip").otherwise("create").alias("action"), F.dense_rank().over(Window.orderBy("depth")).alias("wave"))


def tag_plan(wanted: DataFrame, existing: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, add, error) of wanted tags (entity, tags) against existing ones."""
    j = wanted.join(existing.withColumnRenamed("tags", "have"), "entity", "left").join(entities.select("entity", F.lit(True).alias("known")), "entity", "left")
    add = F.array_sort(F.array_except("tags", F.coalesce("have", F.array().cast("array<string>"))))
    return j.select("entity", F.array_join(F.when(F.col("known"), add).otherwise(F.array().cast("array<string>")), ",").alias("add"), F.when(F.col("known").isNull(), "unknown entity").alias("error"))


def policies(specs: DataFrame) -> DataFrame:
    """(tag, kind, policy): an access row and a masking row for each tag."""
    kinds = F.array(F.struct(F.lit("access").alias("kind"), F.concat("tag", F.lit("_access")).alias("policy")), F.struct(F.lit("mask").alias("kind"), F.concat("tag", F.lit("_mask")).alias("policy")))
    return specs.select("tag", F.inline(kinds))


def merge_roles(have: DataFrame, add: DataFrame) -> DataFrame:
    """(role, users): the union of both sides' users; doing it twice changes nothing."""
    j = have.join(add.withColumnRenamed("users", "more"), "role", "full")
    none = F.array().cast("array<string>")
    return j.select("role", F.array_sort(F.array_union(F.coalesce("users", none), F.coalesce("more", none))).alias("users"))


def glossary(terms: DataFrame) -> DataFrame:
    """(term, forms, category) parsed from texts like ``Category: x; forms: a, b``."""
    forms = F.filter(F.transform(F.split(F.regexp_extract("text", r"forms:\s*([^;]*)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return terms.select("term", forms.alias("forms"), F.trim(F.regexp_extract("text", r"(?i)category:\s*([^;]*)", 1)).alias("category"))


def lineage(runs: DataFrame) -> DataFrame:
    """(run_id, event): an event with inputs and outputs as JSON text."""
    side = lambda c: F.transform(F.col(c), lambda n: F.struct(F.lit("db").alias("namespace"), n.alias("name")))
    return runs.select("run_id", F.to_json(F.struct(F.col("state").alias("eventType"), F.struct(F.col("run_id").alias("runId")).alias("run"), side("inputs").alias("inputs"), side("outputs").alias("outputs"))).alias("event"))


def versions(rows: DataFrame) -> DataFrame:
    """rows (source, created, archived) with ``version`` from 1 on and one active row for each source: the newest that isn't archived."""
    w = Window.partitionBy("source")
    v = rows.withColumn("version", F.row_number().over(w.orderBy("created")))
    newest = F.max(F.when(~F.col("archived"), F.col("version"))).over(w)
    return v.withColumn("active", F.col("version").eqNullSafe(newest))


def current(rows: DataFrame) -> DataFrame:
    """rows (taxonomy, created, status) with one ``current`` for each taxonomy: the newest ready one; older ones are superseded."""
    w = Window.partitionBy("taxonomy").orderBy(F.col("created").desc())
    r = F.row_number().over(Window.partitionBy("taxonomy", F.col("status") == "ready").orderBy(F.col("created").desc()))
    return rows.withColumn("state", F.when((F.col("status") == "ready") & (r == 1), "current").when(F.col("status") == "ready", "superseded").otherwise(F.col("status"))).withColumn("place", F.row_number().over(w))


def reconcile(on_disk: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(run_id, problem) of complete runs on disk without their registry rows."""
    done = on_disk.where("complete")
    miss = lambda t, name: done.join(t.select("run_id"), "run_id", "left_anti").select("run_id", F.lit(name).alias("problem"))
    return miss(runs, "missing_run").union(miss(artifacts, "missing_artifact"))


def leaks(rows: DataFrame, key: str, json: str, markers: list[str], skip: str) -> DataFrame:
    """(key, path, marker): forbidden markers in the keys or strings of nested JSON, one manifest key left out.

    Objects are opened level by level as maps of JSON text.
    """
    level = rows.select(key, F.lit("$").alias("path"), F.col(json).alias("v"))
    flat = None
    for _ in range(4):
        opened = level.where(F.startswith("v", F.lit("{"))).select(key, "path", F.explode(F.from_json("v", "map<string,string>")).alias("k", "x")).where(F.col("k") != skip)
        here = opened.select(key, F.concat_ws(".", "path", "k").alias("path"), F.concat_ws("=", "k", F.when(~F.startswith("x", F.lit("{")), F.col("x"))).alias("text"))
        flat = here if flat is None else flat.union(here)
        level = opened.select(key, F.concat_ws(".", "path", "k").alias("path"), F.col("x").alias("v"))
    m = F.explode(F.array(*map(F.lit, markers))).alias("marker")
    return flat.select(key, "path", "text", m).where(F.contains(F.lower("text"), F.col("marker"))).select(key, "path", "marker")
