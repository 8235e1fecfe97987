"""Queries of nested records (Q), governance (V), sources (S) and further projections (P)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colsense.operators import quality as Q
from colsense.operators import taxonomy as T
from colsense.sources import readers as R
from colsense.sources import sinks
from colsense.sources.cells import table_shapes, to_cells

from . import query
from .inputs import CELLS, CUSTOMERS, NODES, PAIRS, cells, nodes, pairs, read


def payloads(spark, d):
    """A payload for each nation: its customers' segments as prototypes, a pattern that some miss, a broken one for every seventh."""
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    seg = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("prototypes"))
    k = F.col("n_nationkey")
    j = n.join(seg, n.n_nationkey == seg.c_nationkey)
    code = F.concat_ws(".", "n_regionkey", "n_nationkey")
    anti = F.array(F.struct(F.when(k % 4 == 0, F.col("prototypes")[0]).otherwise("nothing").alias("value"), F.when(k % 3 == 0, "9.9").otherwise("0").alias("tag")))
    return j.select(
        code.alias("code"), F.col("n_name").alias("label"), F.concat(F.lit("nation "), k).alias("description"), "prototypes",
        F.array(F.when(k % 7 == 0, "(").otherwise("^[A-F]")).alias("patterns"), F.array(F.when(k % 5 == 0, " ").otherwise("hint")).alias("hints"), anti.alias("anti"),
        F.array(F.when(k % 6 == 0, "wrong").otherwise(F.col("n_regionkey").cast("string"))).alias("parent_path"),
    )


_PAY = "pay AS (SELECT n_regionkey || '.' || n_nationkey AS code, n_nationkey AS k, (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey) AS pr FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer))"
_CHECKS = f"{_PAY}, ch AS (SELECT code, 'patterns_compile' AS ck, k % 7 <> 0 AS passed FROM pay UNION ALL SELECT code, 'prototypes_match', k % 7 <> 0 AND len(list_filter(pr, lambda v: v < 'G')) * 2 >= len(pr) FROM pay UNION ALL SELECT code, 'confusables_exist', k % 3 <> 0 FROM pay UNION ALL SELECT code, 'path_consistent', k % 6 <> 0 FROM pay UNION ALL SELECT code, 'hints_present', k % 5 <> 0 FROM pay UNION ALL SELECT code, 'no_contradiction', k % 4 <> 0 FROM pay)"


def checked(spark, d):
    n = nodes(spark, d)
    paths = n.where("parent_code IS NOT NULL").select("code", F.array("parent_code").alias("path"))
    return Q.checks(payloads(spark, d), n, paths)


@query("q01_q06_checks", f"WITH {_CHECKS} SELECT code, ck AS \"check\", passed FROM ch")
def q01(spark, d):
    return checked(spark, d)


@query("q07_report", f"WITH {_CHECKS} SELECT code, count(*) AS n, count(*) FILTER (WHERE NOT passed) AS n_failed, coalesce(string_agg(CASE WHEN NOT passed THEN ck END, ',' ORDER BY ck), '') AS failed FROM ch GROUP BY 1")
def q07(spark, d):
    return Q.report(checked(spark, d))


@query("q08_annotation_text", f"WITH {_PAY} SELECT code, 'NATION_' || k || ' | nation ' || k || ' | values: ' || array_to_string(pr, ', ') || ' | names: ' || CASE WHEN k % 5 = 0 THEN ' ' ELSE 'hint' END || ' | patterns: ' || CASE WHEN k % 7 = 0 THEN '(' ELSE '^[A-F]' END || ' | path: ' || CASE WHEN k % 6 = 0 THEN 'wrong' ELSE split_part(code, '.', 1) END AS text FROM pay")
def q08(spark, d):
    return payloads(spark, d).select("code", Q.annotation_text().alias("text"))


@query("q09_to_build", f"WITH {NODES} SELECT code FROM nodes WHERE code NOT LIKE '1.%'")
def q09(spark, d):
    keys = T.content_keys(nodes(spark, d))
    return Q.to_build(keys, keys.where("code LIKE '1.%'")).select("code")


@query("q10_final", "SELECT o_orderkey AS artifact, o_orderkey % 3 > 0 AND o_orderstatus = 'F' AND o_totalprice > 100000 AS final, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'signature' END, CASE WHEN o_orderstatus <> 'F' THEN 'not_current' END, CASE WHEN o_totalprice <= 100000 THEN 'incomplete' END) AS reasons FROM orders")
def q10(spark, d):
    sig = T.signature(nodes(spark, d))
    a = read(spark, d, "orders").crossJoin(F.broadcast(sig.select("signature")))
    a = a.select(F.col("o_orderkey").alias("artifact"), F.when(F.col("o_orderkey") % 3 == 0, "old").otherwise(F.col("signature")).alias("signature"), (F.col("o_orderstatus") == "F").alias("current"), (F.col("o_totalprice") > 100000).alias("complete"))
    return Q.final(a, sig)


@query("q11_generated_tables", "WITH t AS (SELECT p_partkey, p_partkey % 6 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 'table_name' WHEN 1 THEN 'few_columns' WHEN 2 THEN 'duplicate_column' WHEN 3 THEN 'value' WHEN 4 THEN 'labelled_columns' END AS problem FROM t")
def q11(spark, d):
    k = F.col("p_partkey") % 6
    col = lambda n, lab, v: F.struct(n.alias("name"), lab.alias("labelled"), F.array(v).alias("values"))
    one = col(F.lit("a"), F.lit(True), F.when(k == 3, " ").otherwise(F.col("p_name")))
    two = col(F.when(k == 2, "A").otherwise("b"), k == 4, F.col("p_brand"))
    columns = F.when(k == 1, F.array(one)).otherwise(F.array(one, two))
    return read(spark, d, "part").select("p_partkey", Q.table_problem(F.when(k == 0, " ").otherwise(F.col("p_brand")), columns).alias("problem"))


@query("v01_sync_plan", f"WITH {NODES} SELECT 'T_' || regexp_replace(code, '[^A-Za-z0-9]', '_', 'g') AS type_name, len(string_split(code, '.')) - 1 AS depth, CASE WHEN code LIKE '0%' THEN 'skip' ELSE 'create' END AS action, len(string_split(code, '.')) AS wave FROM nodes")
def v01(spark, d):
    n = nodes(spark, d)
    t = T.type_export(n.withColumn("x", F.lit(1))).select("type_name").distinct()
    want = n.select(F.concat(F.lit("T_"), F.regexp_replace("code", "[^A-Za-z0-9]", "_")).alias("type_name"), (F.size(F.split("code", r"\.")) - 1).alias("depth"))
    return Q.sync_plan(want.join(t, "type_name", "left_semi"), want.where("type_name LIKE 'T\\_0%'"))


@query("v02_tag_plan", "SELECT c_custkey AS entity, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'pii' ELSE c_mktsegment || ',pii' END AS \"add\", CASE WHEN c_custkey % 11 = 0 THEN 'unknown entity' END AS error FROM customer")
def v02(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    want = c.select("entity", F.array(F.lit("pii"), "c_mktsegment").alias("tags"))
    have = c.where("entity % 2 = 0").select("entity", F.array("c_mktsegment").alias("tags"))
    return Q.tag_plan(want, have, c.where("entity % 11 > 0"))


@query("v03_policies", "SELECT DISTINCT c_mktsegment AS tag, kind, c_mktsegment || '_' || kind AS policy FROM customer, (SELECT unnest(['access', 'mask']) AS kind)")
def v03(spark, d):
    return Q.policies(read(spark, d, "customer").select(F.col("c_mktsegment").alias("tag")).distinct())


@query("v04_roles", "SELECT c_mktsegment AS role, string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) AS users FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 GROUP BY 1")
def v04(spark, d):
    c = read(spark, d, "customer")
    side = lambda q: c.where(q).groupBy(F.col("c_mktsegment").alias("role")).agg(F.collect_set(F.col("c_nationkey").cast("string")).alias("users"))
    return Q.merge_roles(side("c_custkey % 2 = 0"), side("c_custkey % 3 = 0")).select("role", F.array_join("users", ",").alias("users"))


@query("v05_glossary", "SELECT p_partkey AS term, p_name || '|' || p_brand AS forms, p_type AS category FROM part")
def v05(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("term"), F.concat(F.lit("Category: "), "p_type", F.lit("; forms: "), "p_name", F.lit(", "), "p_brand").alias("text"))
    return Q.glossary(p).select("term", F.array_join("forms", "|").alias("forms"), "category")


@query("v06_lineage", "SELECT o_orderkey AS run_id, '{\"eventType\":\"' || o_orderstatus || '\",\"run\":{\"runId\":' || o_orderkey || '},\"inputs\":[{\"namespace\":\"db\",\"name\":\"customer\"}],\"outputs\":[{\"namespace\":\"db\",\"name\":\"out\"}]}' AS event FROM orders")
def v06(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("state"), F.array(F.lit("customer")).alias("inputs"), F.array(F.lit("out")).alias("outputs"))
    return Q.lineage(o)


@query("v07_v08_versions", "WITH v AS (SELECT o_custkey AS source, o_orderkey AS created, o_orderstatus = 'P' AS archived, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders) SELECT source, created, version, coalesce(version = max(CASE WHEN NOT archived THEN version END) OVER (PARTITION BY source), false) AS active FROM v")
def v07(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("created"), (F.col("o_orderstatus") == "P").alias("archived"))
    return Q.versions(o).select("source", "created", "version", "active")


@query("v09_current", "WITH r AS (SELECT o_custkey AS taxonomy, o_orderkey AS created, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'building' END AS status FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY taxonomy, status ORDER BY created DESC) AS r FROM r) SELECT taxonomy, created, CASE WHEN status = 'ready' AND r = 1 THEN 'current' WHEN status = 'ready' THEN 'superseded' ELSE status END AS state FROM k")
def v09(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("taxonomy"), F.col("o_orderkey").alias("created"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("building").alias("status"))
    return Q.current(o).select("taxonomy", "created", "state")


@query("v10_reconcile", "SELECT o_orderkey AS run_id, 'missing_run' AS problem FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'missing_artifact' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0")
def v10(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("complete"))
    return Q.reconcile(o, o.where("run_id % 5 > 0"), o.where("run_id % 7 > 0"))


@query("p05_oversplit_repair", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ', ' || p_brand || ', ' || p_type ELSE p_name END AS description, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS x1, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS x2 FROM part")
def p05(spark, d):
    k = F.col("p_partkey") % 3 == 0
    q = F.lit('"')
    rows = read(spark, d, "part").select("p_partkey", F.when(k, F.concat(q, "p_name")).otherwise(F.col("p_name")).alias("description"), F.col("p_brand").alias("x1"), F.when(k, F.concat("p_type", q)).otherwise(F.col("p_type")).alias("x2"))
    return R.repair_oversplit(rows)


@query("p10_snapshot_shape", f"WITH {CUSTOMERS}, {PAIRS} SELECT id, pred AS code, round(least(conf + 0.02, 1), 6) AS pl, round(1 - conf, 6) AS uncertainty FROM pairs")
def p10(spark, d):
    return pairs(spark, d).select("id", F.col("pred").alias("code"), F.round(F.least(F.col("conf") + 0.02, F.lit(1.0)), 6).alias("pl"), F.round(1 - F.col("conf"), 6).alias("uncertainty"))


@query("p11_targets", f"WITH {CELLS} SELECT DISTINCT \"table\", \"column\" FROM cells WHERE \"table\" = 'part' AND \"column\" IN ('p_brand', 'p_name')")
def p11(spark, d):
    """The grammar ``table:part,column:p_brand|p_name`` as a filter."""
    wanted = dict(x.split(":") for x in "table:part,column:p_brand|p_name".split(","))
    return cells(spark, d).select("table", "column").distinct().where(F.col("table").isin(wanted["table"].split("|")) & F.col("column").isin(wanted["column"].split("|")))


@query("p13_sensitivity", "SELECT p_brand || '' AS brand, count(*) AS n, count(*) FILTER (WHERE p_type LIKE 'S%' OR p_type LIKE 'P%') AS sensitive FROM part GROUP BY 1")
def p13(spark, d):
    s = F.startswith("p_type", F.lit("S")) | F.startswith("p_type", F.lit("P"))
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.count_if(s).alias("sensitive"))


@query("p14_p17_proposals", f"WITH {CUSTOMERS}, {PAIRS} SELECT id, CASE WHEN id % 17 = 0 THEN 'row_review' WHEN truth = pred THEN 'confirm' WHEN conf < 0.2 THEN 'insufficient' WHEN conf >= 0.7 AND truth LIKE pred || '.%' THEN 'high_apply' ELSE 'manual_review' END AS route FROM pairs")
def p14(spark, d):
    p = pairs(spark, d)
    shape = T.correction_shape(F.col("truth"), F.col("pred"))
    route = F.when(F.col("id") % 17 == 0, "row_review").when(shape == "confirm", "confirm").when(F.col("conf") < 0.2, "insufficient").when((F.col("conf") >= 0.7) & (shape == "loosening"), "high_apply").otherwise("manual_review")
    return p.select("id", route.alias("route"))


@query("p15_leaks", "SELECT event_id, '$.note.deep' AS path, 'answer' AS marker FROM events WHERE event_id % 9 = 0 UNION ALL SELECT event_id, '$.event', 'click' FROM events WHERE event_type = 'click'")
def p15(spark, d):
    e = read(spark, d, "events")
    nested = F.struct(F.when(F.col("event_id") % 9 == 0, "the ANSWER key").otherwise("none").alias("deep"))
    js = F.to_json(F.struct(F.col("event_type").alias("event"), nested.alias("note"), F.lit("answer").alias("manifest")))
    return Q.leaks(e.select("event_id", js.alias("j")), "event_id", "j", ["answer", "click"], "manifest")


@query("p16_canonical_votes", f"WITH {NODES}, {CUSTOMERS} SELECT entity, CASE entity % 3 WHEN 0 THEN mid WHEN 1 THEN top ELSE 'what' END AS code, CASE entity % 3 WHEN 0 THEN (SELECT label FROM nodes WHERE code = mid) WHEN 1 THEN (SELECT label FROM nodes WHERE code = top) END AS label FROM cust")
def p16(spark, d):
    """Codes and region mnemonics become codes; anything else stays; labels are filled in."""
    from .inputs import customers

    n = nodes(spark, d)
    top = n.where("parent_code IS NULL").select(F.col("mnemonic").alias("said"), F.col("code").alias("by_name"), F.col("code").alias("top"))
    c = customers(spark, d).join(F.broadcast(top.select("top", "said")), "top")
    k = F.col("entity") % 3
    v = c.select("entity", F.when(k == 0, F.col("mid")).when(k == 1, F.col("said")).otherwise("what").alias("said"))
    j = v.join(F.broadcast(top.select("said", "by_name")), "said", "left").withColumn("code", F.coalesce("by_name", "said"))
    return j.join(F.broadcast(n.select("code", "label")), "code", "left").select("entity", "code", "label")


# Sources and sinks that are read back.


@query("s01_csv_folder", "SELECT 'documents' AS \"table\", c AS \"column\", doc_id AS k, CASE c WHEN 'doc_id' THEN CAST(doc_id AS VARCHAR) WHEN 'text, as it is' THEN nullif(text, '') WHEN 'lang' THEN lang ELSE source END AS value FROM documents, (SELECT unnest(['doc_id', 'text, as it is', 'lang', 'source']) AS c)")
def s01(spark, d):
    """The documents go out as CSV, with the line breaks, quotes and commas of their texts, and come back as cells, numbered by the key column of their row."""
    folder = sinks.shared_folder(spark)
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("text, as it is"), "lang", "source")
    docs.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{folder}/documents.csv")
    long = R.csv_folder(spark, f"{folder}/documents.csv", sample=1 << 24)
    key = long.where("`column` = 'doc_id'").select(F.col("table").alias("t"), F.col("row_ix").alias("r"), F.col("value").cast("long").alias("k"))
    return long.join(key, (F.col("table") == F.col("t")) & (F.col("row_ix") == F.col("r"))).select(F.lit("documents").alias("table"), "column", "k", "value")


@query("s03_discovery", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")))
def s03(spark, d):
    """The tables of a database that are found by its catalogue, and their rows."""
    name = f"found_{abs(hash(d)) % 10**8}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    for t in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"):
        spark.sql(f"DROP TABLE IF EXISTS {name}.{t}")
        spark.catalog.createTable(f"{name}.{t}", path=f"{d.rstrip('/')}/{t}.parquet", source="parquet")
    out = None
    for r in R.discover(spark, name).collect():
        part = spark.table(f"{name}.{r['table']}").agg(F.lit(r["table"]).alias("table"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s02_s11_key_join", "SELECT c_custkey AS column_id, c_mktsegment AS code FROM customer")
def s02(spark, d):
    """A blind release with its answer key joined only on request."""
    c = read(spark, d, "customer")
    rel = c.select(F.col("c_nationkey").cast("string").alias("table_id"), F.col("c_custkey").alias("column_id"), F.col("c_name").alias("column_name"), F.array("c_name").alias("sample_values"))
    key = c.select(F.col("c_nationkey").cast("string").alias("table_id"), F.col("c_custkey").alias("column_id"), F.col("c_mktsegment").alias("reference_code"))
    return R.blind_release(rel, 10, key).select("column_id", "code")


@query("s05_distinct_probe", "SELECT 'p_brand' AS \"column\", count(DISTINCT p_brand) AS distinct_count FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part")
def s05(spark, d):
    return R.distinct_probe(read(spark, d, "part").select("p_brand", "p_size", "p_type"))


@query("s10_blind_release", "SELECT c_custkey AS column_id, len(list(c_name) OVER (PARTITION BY c_nationkey)) AS n_siblings FROM customer")
def s10(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("table_id"), F.col("c_custkey").alias("column_id"), F.col("c_name").alias("column_name"), F.array("c_name").alias("sample_values"))
    return R.blind_release(c).select("column_id", F.size("siblings").cast("long").alias("n_siblings"))


@query("s13_value_free", "SELECT 'part' AS \"table\", 'p_name,p_brand,p_type,p_size,p_retailprice' AS columns UNION ALL SELECT 'pages', 'url,html'")
def s13(spark, d):
    """Surrogate keys are left out; names end in key or id."""
    s = table_shapes({"part": read(spark, d, "part").withColumnRenamed("p_partkey", "p_key"), "pages": read(spark, d, "pages"), "other": read(spark, d, "nation")})
    return R.value_free_tables(s, "pa", surrogate=False).select("table", F.array_join("columns", ",").alias("columns"))


@query("s15_ddl_types", "SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) t(\"column\", type)")
def s15(spark, d):
    """The DDL text of a table's own schema."""
    folder = sinks.shared_folder(spark)
    c = table_shapes({"customer": read(spark, d, "customer")})
    ddl = c.select(F.lit("CREATE TABLE customer (").alias("value")).distinct().union(c.select(F.concat_ws(" ", F.lit(" "), "column", F.concat("type", F.lit(",")))))
    ddl.coalesce(1).write.text(folder)
    return R.ddl_types(spark, folder)


@query("s16_paired_answers", "SELECT 'part' AS \"table\", 'p_name' AS \"column\", '1.1.9' AS code UNION ALL SELECT 'part', 'p_type', '2'")
def s16(spark, d):
    p = read(spark, d, "part").select("p_name", F.col("p_brand").alias("attr_1_1_9"), "p_type", F.col("p_size").alias("code_2_0"), "p_retailprice")
    return R.paired_answers(table_shapes({"part": p}))


@query("s17_answer_key", "SELECT CAST(c_custkey AS VARCHAR) AS entity, c_mktsegment AS code FROM customer")
def s17(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity"), F.col("c_mktsegment").alias("code"))
    return R.answer_key(c, ["entity"])


@query("s18_reference_map", "WITH r AS (SELECT p_partkey AS n, 't' || p_partkey % 3 AS t, 'p_' || lower(p_brand) AS c, p_type AS code FROM part), k AS (SELECT n, code, c AS key, 0 AS tier FROM r UNION ALL SELECT n, code, t || '.' || c, 0 FROM r UNION ALL SELECT n, code, regexp_replace(c, '^[a-z]+_', ''), 1 FROM r) SELECT key, arg_max(code, (-tier, CASE WHEN tier = 0 THEN n ELSE -n END)) AS code FROM k GROUP BY 1")
def s18(spark, d):
    p = read(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("n"), F.concat(F.lit("t"), F.col("p_partkey") % 3).alias("table"), F.concat(F.lit("p_"), F.lower("p_brand")).alias("column"), F.lit(None).cast("string").alias("mnemonic"), F.col("p_type").alias("code"))
    return R.reference_map(rows, nodes(spark, d))


@query("s19_reference_json", "SELECT 'k' || p_partkey AS key, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_type END AS mnemonic, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS code FROM part")
def s19(spark, d):
    k = F.col("p_partkey")
    obj = F.to_json(F.struct(F.col("p_type").alias("mnemonic"), F.col("p_brand").alias("code")))
    v = F.when(k % 3 == 0, F.concat(F.lit('"'), "p_type", F.lit('"'))).when(k % 3 == 1, obj).otherwise("null")
    return R.reference_json(read(spark, d, "part").select(F.concat(F.lit('{"k'), k, F.lit('":'), v, F.lit("}")).alias("value")))


@query("s21_manifest", "SELECT 'c' || n_nationkey AS collection, 't' || n_regionkey AS \"table\", c.col AS \"column\", CASE WHEN n_regionkey < 3 THEN 'A' || n_regionkey ELSE 'other' END AS anchor, n_regionkey < 3 AS mapped FROM nation, (SELECT unnest(['id', 'name']) AS col) c")
def s21(spark, d):
    n = read(spark, d, "nation")
    tables = F.array(F.struct(F.concat(F.lit("t"), "n_regionkey").alias("name"), F.array(F.lit("id"), F.lit("name")).alias("columns")))
    rows = n.select(F.concat(F.lit("c"), "n_nationkey").alias("name"), F.col("n_regionkey").cast("string").alias("genus"), tables.alias("tables"))
    anchors = read(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("genus"), F.concat(F.lit("A"), "r_regionkey").alias("anchor"))
    return R.manifest(rows, anchors, "other")


@query("s23_s25_predictions_sink", f"WITH {CUSTOMERS}, {PAIRS} SELECT split_part(truth, '.', 2) AS table_id, id AS column_id, pred AS predicted_code FROM pairs")
def s25(spark, d):
    """Written as sets of codes, collapsed to the first one, read back."""
    path = f"{sinks.shared_folder(spark)}/predictions"
    p = pairs(spark, d).select(F.split("truth", r"\.")[1].alias("table_id"), F.col("id").alias("column_id"), F.concat("pred", F.lit("|9.9")).alias("code"))
    sinks.predictions(p, path)
    return spark.read.parquet(path)


@query("s24_snapshot", "SELECT 'n' || c_nationkey AS \"table\", count(*) AS n_rows FROM customer GROUP BY 1")
def s24(spark, d):
    path = sinks.shared_folder(spark)
    sinks.snapshot(read(spark, d, "customer").withColumn("table", F.concat(F.lit("n"), "c_nationkey")), path)
    return spark.read.schema("`table` string, n_rows long").json(f"{path}/manifest")


@query("s26_holdout_tables", "SELECT 'part' AS \"table\", p_name, p_brand FROM part")
def s26(spark, d):
    """Cells pivoted back to wide CSV and read again."""
    path = f"{sinks.shared_folder(spark)}/tables"
    c = to_cells(read(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "part", "p_partkey", ["p_name", "p_brand"])
    sinks.holdout_tables(c, path, ["p_name", "p_brand"])
    return spark.read.option("header", True).csv(path).select("table", "p_name", "p_brand")


@query("s28_clean_export", "SELECT p_partkey AS partkey, p_name AS name FROM part")
def s28(spark, d):
    path = f"{sinks.shared_folder(spark)}/clean"
    sinks.clean_export(read(spark, d, "part").select("p_partkey", "p_name", "p_brand"), ["p_brand"], path, "p_")
    return spark.read.parquet(path)


@query("s30_labelled_corpus", "SELECT p_partkey, sha1('part' || chr(31) || p_name || chr(31) || p_brand || chr(30) || p_type || chr(31) || p_size) AS content_hash FROM part")
def s30(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.lit("part").alias("table"), F.col("p_name").alias("column"), F.array("p_brand", "p_type").alias("values"), F.col("p_size").cast("string").alias("code"))
    return R.labelled_corpus(p).select("p_partkey", "content_hash")


@query("s31_payload_flat", f"WITH {_PAY} SELECT code, array_to_string(pr, '|') AS prototypes FROM pay")
def s31(spark, d):
    return R.payload_flat(payloads(spark, d).drop("anti")).select("code", "prototypes")


@query("s32_strided", "WITH n AS (SELECT p_brand AS relation, p_partkey AS col, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part) SELECT relation, col AS \"column\" FROM n WHERE n % 5 = 0 AND n / 5 < 14")
def s32(spark, d):
    return R.strided(read(spark, d, "part").select(F.col("p_brand").alias("relation"), F.col("p_partkey").alias("column")), 5)


@query("w04_previous_and_next", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def w04(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))
