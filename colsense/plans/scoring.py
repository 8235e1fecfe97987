"""Queries of matching (J), evaluation (E), convergence (C) and grouping sets (W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colsense.operators import evaluate as E
from colsense.operators import loop as L
from colsense.operators import match as M
from colsense.operators import taxonomy as T
from colsense.sources.cells import table_shapes

from . import query
from .hierarchy import PLACED, placed
from .inputs import CELLS, CLOSURE, CUSTOMERS, NODES, PAIRS, cells, closure, customers, nodes, pairs, read

PW = f"WITH {CUSTOMERS}, {PAIRS}"


def rnd(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Matching.


@query(
    "j01_name_match",
    f"WITH {NODES}, c AS (SELECT c_custkey AS entity, lower(CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'nation ' || c_nationkey ELSE left(c_mktsegment, 6) END) AS name FROM customer), k AS (SELECT code, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS key, 0.7::DOUBLE AS mass FROM nodes UNION ALL SELECT code, trim(regexp_replace(lower(left(label, 6)), '[^a-z0-9]+', ' ', 'g')), 0.5::DOUBLE FROM nodes), m AS (SELECT entity, code, max(mass) AS mass FROM c JOIN k ON c.name = k.key WHERE length(key) > 1 GROUP BY 1, 2) SELECT entity, code, mass FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mass DESC, code) AS r FROM m) WHERE r = 1",
)
def j01(spark, d):
    c = read(spark, d, "customer")
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.col("c_mktsegment")).when(k == 1, F.concat(F.lit("nation_"), "c_nationkey")).otherwise(F.substring("c_mktsegment", 1, 6))
    return M.name_match(c.select(F.col("c_custkey").alias("entity"), name.alias("name")), nodes(spark, d))


@query("j02_token_attach", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT * FROM (VALUES ('1', 'ring'), ('2', 'widget'), ('3', 'red'), ('4', 'small ring')) t(code, token)) SELECT name, min(code) AS code FROM n JOIN t ON contains(lower(name), token) OR contains(token, lower(name)) GROUP BY 1")
def j02(spark, d):
    tokens = spark.createDataFrame([("1", "ring"), ("2", "widget"), ("3", "red"), ("4", "small_ring")], "code string, token string")
    return M.token_attach(read(spark, d, "part").select(F.col("p_name").alias("name")), tokens)


@query("j03_apply_reference", f"WITH {CELLS}, c AS (SELECT DISTINCT \"table\", \"column\" FROM cells) SELECT \"table\", \"column\", CASE WHEN \"column\" = 'url' THEN 'A' WHEN \"table\" = 'customer' AND \"column\" = 'c_name' THEN 'B' WHEN regexp_replace(\"column\", '^[a-z]+_', '') = 'name' THEN 'C' END AS code FROM c")
def j03(spark, d):
    ref = spark.createDataFrame([("url", "A"), ("customer.c_name", "B"), ("name", "C")], "key string, code string")
    return M.apply_reference(cells(spark, d).select("table", "column").distinct(), ref)


@query("j04_key_check", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 > 0) SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_left, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_right, (SELECT min(CAST(k AS VARCHAR)) FROM a WHERE k NOT IN (SELECT k FROM b)) AS first_left, (SELECT min(CAST(k AS VARCHAR)) FROM b WHERE k NOT IN (SELECT k FROM a)) AS first_right")
def j04(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return M.key_check(a, read(spark, d, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("k")), "k")


@query("j05_answer_association", f"WITH {NODES}, {CUSTOMERS} SELECT entity, leaf AS code, mid AS genus, row_number() OVER (PARTITION BY mid ORDER BY entity) AS ordinal FROM cust")
def j05(spark, d):
    """Each answer's genus and its place within it."""
    g = T.genus_of(closure(spark, d), nodes(spark, d))
    j = customers(spark, d).select("entity", F.col("leaf").alias("code")).join(F.broadcast(g), "code")
    return j.withColumn("ordinal", F.row_number().over(Window.partitionBy("genus").orderBy("entity")))


@query("j06_foreign_keys", "SELECT * FROM (VALUES ('events', 'user_id', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)), ('labels', 'doc_id', NULL, NULL), ('benchmark', 'item_id', NULL, NULL), ('conversations', 'conv_id', NULL, NULL), ('documents', 'doc_id', NULL, NULL), ('embeddings', 'vec_id', NULL, NULL), ('events', 'event_id', NULL, NULL), ('pages', 'page_id', NULL, NULL), ('doc', 'page_id', 'pages', 'page_id')) t(\"table\", \"column\", target, target_key)")
def j06(spark, d):
    """Over the schemas of all tables and of one that points to pages."""
    names = ("events", "labels", "benchmark", "conversations", "documents", "embeddings", "pages")
    shapes = table_shapes({t: read(spark, d, t) for t in names} | {"doc": read(spark, d, "pages").select("page_id")})
    return M.foreign_keys(shapes)


_EDGES = [("lineitem.orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders.customer", "orders", "o_custkey", "customer", "c_custkey"), ("customer.nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("nation.region", "nation", "n_regionkey", "region", "r_regionkey"), ("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey"), ("lineitem.supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels.documents", "labels", "doc_id", "documents", "doc_id"), ("events.customer", "events", "user_id", "customer", "c_custkey")]


@query("j07_integrity", " UNION ALL ".join(f"SELECT '{e}' AS edge, count(*) AS checked, count(*) FILTER (WHERE {c} NOT IN (SELECT {k} FROM {p})) AS orphans, count(*) FILTER (WHERE {c} NOT IN (SELECT {k} FROM {p})) = 0 AS ok FROM {t}" for e, t, c, p, k in _EDGES))
def j07(spark, d):
    return M.integrity([(e, read(spark, d, t), c, read(spark, d, p), k) for e, t, c, p, k in _EDGES])


@query("j08_predictions_to_ids", "SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey IS NULL) AS unjoined FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 > 0) ON o_custkey = c_custkey")
def j08(spark, d):
    c = read(spark, d, "customer").where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("hit"))
    return read(spark, d, "orders").select("o_custkey").join(c, "o_custkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("hit IS NULL")).alias("unjoined"))


@query("j09_sample_overlap", "WITH s AS (SELECT DISTINCT o_custkey AS row_id, o_orderpriority AS value FROM orders), c AS (SELECT DISTINCT o_orderstatus AS col, o_orderpriority AS value FROM orders WHERE o_orderkey % 3 = 0), h AS (SELECT row_id, col, count(*) AS hits FROM s JOIN c USING (value) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY hits DESC, col) AS r, count(*) OVER (PARTITION BY row_id) AS n FROM h), t AS (SELECT row_id, count(*) AS total FROM s GROUP BY 1) SELECT t.row_id, r.col AS \"column\", coalesce(hits, 0) AS hits, CASE WHEN total < 2 THEN 'insufficient' WHEN hits IS NULL THEN 'no_match' WHEN n = 1 THEN 'unique' ELSE 'best_overlap' END AS status FROM t LEFT JOIN r ON r.row_id = t.row_id AND r.r = 1")
def j09(spark, d):
    o = read(spark, d, "orders")
    return M.sample_overlap(o.select(F.col("o_custkey").alias("row_id"), F.col("o_orderpriority").alias("value")), o.where("o_orderkey % 3 = 0").select(F.col("o_orderstatus").alias("column"), F.col("o_orderpriority").alias("value")))


@query("j10_coverage_gate", "SELECT c_custkey AS entity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j10(spark, d):
    """Targets without a prediction."""
    done = read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("entity"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("entity")).join(done, "entity", "left_anti")


@query("j11_merge_shards", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer")
def j11(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    merged = M.merge_shards(*[c.where(f"c_custkey % 3 = {k}") for k in range(3)], key="c_custkey")
    return merged.agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query(
    "j12_resolve_code",
    f"WITH {NODES}, {CLOSURE}, p AS (SELECT c.code, string_agg(upper(left(n.label, 6)), '.' ORDER BY c.distance DESC) AS path FROM clo c JOIN nodes n ON n.code = c.ancestor GROUP BY 1), w AS (SELECT path AS raw FROM p UNION SELECT code FROM nodes UNION SELECT DISTINCT upper(left(label, 6)) FROM nodes UNION SELECT 'nothing') , byp AS (SELECT path AS raw, code FROM p), bym AS (SELECT upper(left(label, 6)) AS raw, min(code) AS code FROM nodes GROUP BY 1) SELECT w.raw, coalesce(byp.code, n.code, bym.code) AS code, CASE WHEN byp.code IS NOT NULL THEN 'path' WHEN n.code IS NOT NULL THEN 'code' WHEN bym.code IS NOT NULL THEN 'mnemonic' ELSE 'none' END AS how FROM (SELECT w.raw FROM w) w LEFT JOIN (SELECT raw, min(code) AS code FROM byp GROUP BY 1 HAVING count(*) = 1) byp USING (raw) LEFT JOIN nodes n ON n.code = w.raw LEFT JOIN bym USING (raw) WHERE w.raw NOT IN (SELECT raw FROM byp GROUP BY 1 HAVING count(*) > 1)",
)
def j12(spark, d):
    """Paths that two nodes share are left out on both sides."""
    n = nodes(spark, d)
    p = T.paths(closure(spark, d), n)
    twice = p.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("path").alias("raw"))
    raw = p.select(F.col("path").alias("raw")).union(n.select("code")).union(n.select("mnemonic")).union(n.limit(1).select(F.lit("nothing"))).distinct().join(twice, "raw", "left_anti")
    return M.resolve_code(raw, n, p)


@query("j14_alignment", f"WITH {NODES}, m AS (SELECT DISTINCT upper(left(label, 6)) AS m FROM nodes), r AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'NONE' || p_size ELSE 'BUILDI' END AS m FROM part) SELECT 'systemic' AS alignment, (SELECT count(DISTINCT m) FROM r) AS n_mnemonics, (SELECT count(DISTINCT m) FROM r WHERE m NOT IN (SELECT m FROM m)) AS n_missing, (SELECT count(*) FROM r WHERE m NOT IN (SELECT m FROM m)) AS n_columns")
def j14(spark, d):
    ref = read(spark, d, "part").select(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("NONE"), "p_size")).otherwise("BUILDI").alias("mnemonic"))
    return M.alignment(ref, nodes(spark, d))


@query("j15_scope_delta", f"WITH {CELLS}, c AS (SELECT DISTINCT \"table\", \"column\" FROM cells) SELECT count(*) FILTER (WHERE \"table\" NOT IN ('customer', 'part') OR \"column\" = 'p_type') AS new_columns, count(DISTINCT \"table\") FILTER (WHERE \"table\" NOT IN ('customer', 'part')) AS new_tables FROM c")
def j15(spark, d):
    c = cells(spark, d).select("table", "column").distinct()
    return M.scope_delta(c, c.where("`table` IN ('customer', 'part') AND `column` <> 'p_type'"))


@query("j16_pair_overlap", "WITH a AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_size < 25), b AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_retailprice > 950) SELECT (SELECT count(*) FROM a WHERE v IN (SELECT v FROM b)) AS shared, (SELECT count(*) FROM a WHERE v NOT IN (SELECT v FROM b)) AS only_a, (SELECT count(*) FROM b WHERE v NOT IN (SELECT v FROM a)) AS only_b")
def j16(spark, d):
    p = read(spark, d, "part")
    a, b = p.where("p_size < 25").select(F.col("p_brand").alias("v"), F.lit(1).alias("a")).distinct(), p.where("p_retailprice > 950").select(F.col("p_brand").alias("v"), F.lit(1).alias("b")).distinct()
    return a.join(b, "v", "full").agg(F.count_if(F.expr("a = 1 AND b = 1")).alias("shared"), F.count_if(F.expr("b IS NULL")).alias("only_a"), F.count_if(F.expr("a IS NULL")).alias("only_b"))


@query("j17_working_set", "SELECT c_custkey AS entity, c_name AS name, count(o_orderkey) AS n_votes, count(DISTINCT o_orderpriority) AS n_codes, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def j17(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("n_votes"), F.countDistinct("o_orderpriority").alias("n_codes"), F.max("o_totalprice").alias("top"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    return c.join(o, "entity", "left").select("entity", "name", F.coalesce("n_votes", F.lit(0)).alias("n_votes"), F.coalesce("n_codes", F.lit(0)).alias("n_codes"), "top")


@query("j18_vote_agreement", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'no_signals' WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'all_agree' ELSE 'partial_agree' END WHEN o_orderstatus = 'F' THEN 'partial_agree' WHEN o_orderstatus = 'P' THEN 'partial_agree' ELSE 'disagree_all' END AS agreement FROM orders")
def j18(spark, d):
    """Three voters: always F or P by parity twice, and the status."""
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    none = F.lit(None).cast("string")
    votes = F.when(k % 11 == 0, F.array(none, none, none)).otherwise(F.array(F.lit("F"), F.when(k % 2 == 0, "F").otherwise("P"), s))
    return read(spark, d, "orders").select("o_orderkey", M.vote_agreement(votes).alias("agreement"))


@query("j19_conflicts", f"{PW} SELECT id AS entity, truth AS code, CASE WHEN id % 13 > 0 THEN pred END AS pred FROM pairs WHERE id % 13 = 0 OR truth <> pred")
def j19(spark, d):
    p = pairs(spark, d)
    return M.conflicts(p.select(F.col("id").alias("entity"), F.col("truth").alias("code")), p.where("id % 13 > 0").select(F.col("id").alias("entity"), "pred"))


@query("j20_corrections", f"{PW} SELECT id AS entity, truth AS old, pred AS new FROM pairs WHERE conf >= 0.5 AND truth <> pred")
def j20(spark, d):
    p = pairs(spark, d)
    return M.apply_corrections(p.select(F.col("id").alias("entity"), F.col("truth").alias("code")), p.where("conf >= 0.5").select(F.col("id").alias("entity"), F.col("pred").alias("code")))[1]


@query("j21_p12_weighted_reference", "WITH w AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 1.0 ELSE 0.5 END * CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 1 END AS weight FROM labels), r AS (SELECT d.doc_id AS entity, d.source AS label, coalesce(w.weight, 1.0)::DOUBLE AS weight FROM documents d LEFT JOIN w USING (doc_id) WHERE coalesce(w.weight, 1.0) > 0) SELECT entity, label, weight FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM r) WHERE n >= 2")
def j21(spark, d):
    w = F.when(F.col("toxic") == 1, 0.0).when(F.col("quality") == 1, 1.0).otherwise(0.5) * F.when(F.col("doc_id") % 5 == 0, 0.5).otherwise(1.0)
    weights = read(spark, d, "labels").select(F.col("doc_id").alias("entity"), w.alias("weight"))
    return M.weighted_reference(read(spark, d, "documents").select(F.col("doc_id").alias("entity"), F.col("source").alias("label")), weights)


@query("j22_tiered_reference", "WITH p AS (SELECT o_orderkey AS entity, o_orderstatus AS old, o_orderpriority AS tag, o_orderkey % 3 = 0 AS passed, o_orderpriority NOT LIKE '5%' AS inv, min(CASE WHEN o_orderkey % 3 = 0 OR o_totalprice > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderstatus) = 1 AS always FROM orders) SELECT entity, CASE WHEN passed AND inv THEN tag ELSE old END AS code, CASE WHEN passed AND inv THEN 1 WHEN always THEN 2 ELSE 3 END AS tier FROM p")
def j22(spark, d):
    o = read(spark, d, "orders")
    passed = F.col("o_orderkey") % 3 == 0
    by_tag = o.groupBy("o_orderstatus").agg(F.min(passed | (F.col("o_totalprice") > 1000)).alias("always_passed"))
    rows = o.join(F.broadcast(by_tag), "o_orderstatus").select(F.col("o_orderkey").alias("entity"), F.col("o_orderstatus").alias("old"), F.col("o_orderpriority").alias("tag"), passed.alias("passed"), (~F.col("o_orderpriority").like("5%")).alias("in_vocabulary"), "always_passed")
    return M.tiered(rows)


@query("j23_decision_check", f"WITH {NODES}, {CUSTOMERS}, dd AS (SELECT entity, CASE WHEN entity % 17 = 0 THEN 'x' ELSE leaf END AS code, CASE entity % 19 WHEN 0 THEN 'sure' ELSE 'high' END AS confidence, CASE entity % 23 WHEN 0 THEN ' ' ELSE 'because' END AS reasoning FROM cust WHERE entity % 29 > 0) SELECT coalesce(dd.entity, c.entity) AS entity, CASE WHEN c.entity IS NULL THEN 'unknown_column' WHEN dd.entity IS NULL THEN 'missing' WHEN dd.code = 'x' THEN 'unknown_code' WHEN confidence = 'sure' THEN 'bad_confidence' ELSE 'no_reasoning' END AS problem FROM dd FULL JOIN (SELECT entity FROM cust WHERE entity % 31 > 0) c ON c.entity = dd.entity WHERE c.entity IS NULL OR dd.entity IS NULL OR dd.code = 'x' OR confidence = 'sure' OR trim(reasoning) = ''")
def j23(spark, d):
    c = customers(spark, d)
    e = F.col("entity")
    dec = c.where("entity % 29 > 0").select("entity", F.when(e % 17 == 0, "x").otherwise(F.col("leaf")).alias("code"), F.when(e % 19 == 0, "sure").otherwise("high").alias("confidence"), F.when(e % 23 == 0, " ").otherwise("because").alias("reasoning"))
    return M.decision_check(dec, c.where("entity % 31 > 0"), nodes(spark, d))


# Evaluation.

_CLASS = "x AS (SELECT truth AS code, 1 AS t, 0 AS p, truth = pred AS hit FROM pairs UNION ALL SELECT pred, 0, 1, truth = pred FROM pairs), c AS (SELECT code, sum(t) AS support, sum(p) AS predicted, sum(CASE WHEN hit THEN t ELSE 0 END) AS tp FROM x GROUP BY 1), pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"


@query("e01_overall", f"{PW}, {_CLASS} SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f")
def e01(spark, d):
    return rnd(E.overall(pairs(spark, d)), "accuracy", "macro_f1")


@query("e02_per_class", f"{PW}, {_CLASS} SELECT code, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def e02(spark, d):
    return rnd(E.per_class(pairs(spark, d)), "precision", "recall", "f1")


@query("e03_confusion", f"{PW} SELECT truth, pred, count(*) AS n FROM pairs GROUP BY 1, 2")
def e03(spark, d):
    return E.confusion(pairs(spark, d))


@query("e04_hierarchical_accuracy", f"{PW} SELECT count(*) AS n, count(*) FILTER (WHERE truth = pred OR truth LIKE pred || '.%' OR pred LIKE truth || '.%') AS on_path FROM pairs")
def e04(spark, d):
    return pairs(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(E.on_path(F.col("truth"), F.col("pred"))).alias("on_path"))


@query("e05_epistemic", f"{PW}, b AS (SELECT id, truth, len(string_split(pred, '.')) - 1 AS depth, conf AS bel, least(1, conf + 0.1 * (id % 5)) AS pl, pred FROM pairs) SELECT depth, count(*) AS n, round(avg(bel), 6) AS mean_bel, round(avg(pl), 6) AS mean_pl, round(avg(pl - bel), 6) AS mean_gap, count(*) FILTER (WHERE bel >= 0.7) AS committed, round(avg(CASE WHEN bel >= 0.7 THEN CASE WHEN truth = pred OR truth LIKE pred || '.%' THEN 1 ELSE 0 END END), 6) AS cautious_accuracy FROM b GROUP BY 1")
def e05(spark, d):
    p = pairs(spark, d).withColumn("pl", F.least(F.lit(1.0), F.col("conf") + 0.1 * (F.col("id") % 5))).withColumn("depth", F.size(F.split("pred", r"\.")) - 1)
    ok = ((F.col("truth") == F.col("pred")) | F.startswith("truth", F.concat("pred", F.lit(".")))).cast("double")
    sure = F.col("conf") >= 0.7
    return rnd(p.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_bel"), F.avg("pl").alias("mean_pl"), F.avg(F.col("pl") - F.col("conf")).alias("mean_gap"), F.count_if(sure).alias("committed"), F.avg(F.when(sure, ok)).alias("cautious_accuracy")), "mean_bel", "mean_pl", "mean_gap", "cautious_accuracy")


@query("e06_run_summary", f"{PW} SELECT count(*) AS n, round(count(*) FILTER (WHERE id % 13 > 0) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE id % 13 > 0 AND truth = pred) / count(*) FILTER (WHERE id % 13 > 0), 6) AS accuracy, round(avg(conf), 6) AS mean_conf FROM pairs")
def e06(spark, d):
    p = pairs(spark, d)
    has = F.col("id") % 13 > 0
    return rnd(p.agg(F.count(F.lit(1)).alias("n"), (F.count_if(has) / F.count(F.lit(1))).alias("coverage"), (F.count_if(has & (F.col("truth") == F.col("pred"))) / F.count_if(has)).alias("accuracy"), F.avg("conf").alias("mean_conf")), "coverage", "accuracy", "mean_conf")


_FAILS = "fails AS (SELECT *, CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN 'zz' ELSE pred END AS q FROM pairs), modes AS (SELECT id, truth, q, CASE WHEN truth = q THEN NULL WHEN q IS NULL THEN 'missing' WHEN q NOT IN (SELECT code FROM nodes) THEN 'hallucinated' WHEN truth LIKE q || '.%' THEN 'parent' WHEN q LIKE truth || '.%' THEN 'child' WHEN regexp_replace(truth, '\\.[^.]*$', '') = regexp_replace(q, '\\.[^.]*$', '') THEN 'sibling' ELSE 'wrong_subtree' END AS mode FROM fails)"


def fails(spark, d):
    p = pairs(spark, d)
    q = F.when(F.col("id") % 17 == 0, F.lit(None)).when(F.col("id") % 19 == 0, "zz").otherwise(F.col("pred"))
    return p.select("id", "truth", q.alias("pred"), "conf").join(nodes(spark, d).select(F.col("code").alias("pred"), F.lit(True).alias("known")), "pred", "left")


@query("e07_failure_modes", f"WITH {NODES}, {CUSTOMERS}, {PAIRS}, {_FAILS} SELECT coalesce(mode, 'right') AS mode, count(*) AS n FROM modes GROUP BY 1")
def e07(spark, d):
    m = E.failure_mode(F.col("truth"), F.col("pred"), F.coalesce(F.col("known"), F.lit(False)))
    return fails(spark, d).groupBy(F.coalesce(m, F.lit("right")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query("e08_ancestry_modes", f"WITH {NODES}, {CUSTOMERS}, {PAIRS}, {_FAILS} SELECT CASE WHEN q IS NULL THEN 'dropped' WHEN truth LIKE q || '.%' THEN 'ancestor' WHEN q LIKE truth || '.%' THEN 'descendant' WHEN split_part(truth, '.', 1) = split_part(q, '.', 1) THEN 'sibling_subtree' ELSE 'cross_subtree' END AS mode, count(*) AS n FROM modes WHERE q IS NULL OR truth <> q GROUP BY 1")
def e08(spark, d):
    f = fails(spark, d).where("pred IS NULL OR truth <> pred")
    return f.groupBy(E.ancestry_mode(F.col("truth"), F.col("pred")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query("e09_iteration_scores", f"WITH {NODES}, {CUSTOMERS}, {PAIRS}, {_FAILS} SELECT id % 4 AS iteration, count(*) FILTER (WHERE q IS NOT NULL) AS scored, 0 AS unscorable, count(*) FILTER (WHERE q IS NULL) AS missing_in_run, round(100 * count(*) FILTER (WHERE truth = q) / count(*) FILTER (WHERE q IS NOT NULL), 4) AS strict_pct, round(100 * count(*) FILTER (WHERE truth = q OR truth LIKE q || '.%' OR q LIKE truth || '.%') / count(*) FILTER (WHERE q IS NOT NULL), 4) AS on_path_pct, " + ", ".join(f"count(*) FILTER (WHERE mode = '{m}') AS {m}" for m in ("hallucinated", "parent", "child", "sibling", "wrong_subtree")) + " FROM modes GROUP BY 1")
def e09(spark, d):
    return E.score(fails(spark, d).withColumn("iteration", F.col("id") % 4), "iteration")


@query("e10_grouped_errors", f"{PW}, e AS (SELECT * FROM pairs WHERE truth <> pred), r AS (SELECT *, row_number() OVER (PARTITION BY truth, pred ORDER BY id) AS r, count(*) OVER (PARTITION BY truth, pred) AS n FROM e) SELECT truth, pred, max(n) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS examples FROM r WHERE r <= 5 GROUP BY 1, 2")
def e10(spark, d):
    e = E.grouped_errors(pairs(spark, d).where("truth <> pred"), ["truth", "pred"], "id")
    return e.select("truth", "pred", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("e11_trend", f"{PW}, s AS (SELECT id % 5 AS iteration, 100 * count(*) FILTER (WHERE truth = pred) / count(*) AS pct FROM pairs GROUP BY 1) SELECT iteration, round(pct, 6) AS pct, round(pct - lag(pct) OVER (ORDER BY iteration), 6) AS delta FROM s")
def e11(spark, d):
    s = pairs(spark, d).groupBy((F.col("id") % 5).alias("iteration")).agg((100 * F.count_if(F.col("truth") == F.col("pred")) / F.count(F.lit(1))).alias("pct"))
    return rnd(E.trend(s, "iteration", "pct"), "pct", "delta")


@query("e12_placement_rates", f"WITH {NODES}, {CUSTOMERS}, {PAIRS}, {PLACED} SELECT placement, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM placed GROUP BY 1")
def e12(spark, d):
    p = placed(spark, d).groupBy("placement").agg(F.count(F.lit(1)).alias("n"))
    return p.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("e13_harm_ranking", f"WITH {NODES}, {CUSTOMERS}, {PAIRS}, {_FAILS}, s AS (SELECT split_part(truth, '.', 1) AS run, 100 * count(*) FILTER (WHERE truth = q) / count(*) - 2 * 100 * count(*) FILTER (WHERE mode = 'wrong_subtree') / count(*) - 0.5 * 100 * count(*) FILTER (WHERE mode = 'parent') / count(*) AS v FROM modes GROUP BY 1) SELECT run, round(v, 4) AS composite, rank() OVER (ORDER BY round(v, 4) DESC) AS place FROM s")
def e13(spark, d):
    """Strict accuracy less the harm of each kind of error; one row for each run."""
    f = fails(spark, d).withColumn("mode", E.failure_mode(F.col("truth"), F.col("pred"), F.coalesce(F.col("known"), F.lit(False))))
    pct = lambda c: 100 * F.count_if(c) / F.count(F.lit(1))
    s = f.groupBy(F.substring_index("truth", ".", 1).alias("run")).agg(F.round(pct(F.col("truth") == F.col("pred")) - 2 * pct(F.col("mode") == "wrong_subtree") - 0.5 * pct(F.col("mode") == "parent"), 4).alias("composite"))
    return s.withColumn("place", F.rank().over(Window.orderBy(F.col("composite").desc())))


@query("e14_threshold_sweep", f"{PW}, t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS t) SELECT t AS threshold, count(*) AS covered, count(*) FILTER (WHERE truth = pred) AS hits, round(count(*) FILTER (WHERE truth = pred) / count(*), 6) AS precision FROM pairs, t WHERE conf >= t GROUP BY 1")
def e14(spark, d):
    t = F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7, 0.9)))).alias("threshold")
    hit = F.count_if(F.col("truth") == F.col("pred"))
    return pairs(spark, d).select("*", t).where("conf >= threshold").groupBy("threshold").agg(F.count(F.lit(1)).alias("covered"), hit.alias("hits"), F.round(hit / F.count(F.lit(1)), 6).alias("precision"))


@query("e15_two_arms", f"{PW}, a AS (SELECT id, truth, CASE WHEN id % 11 > 0 THEN pred END AS pa, CASE WHEN id % 7 > 0 THEN CASE WHEN id % 3 = 0 THEN truth ELSE pred END END AS pb FROM pairs), o AS (SELECT CASE WHEN pa IS NULL AND pb IS NULL THEN 'uncovered' WHEN coalesce(pa = truth, false) AND coalesce(pb = truth, false) THEN 'both_right' WHEN coalesce(pa = truth, false) THEN 'a_only' WHEN coalesce(pb = truth, false) THEN 'b_only' WHEN pa IS NULL OR pb IS NULL THEN 'one_covered' ELSE 'both_wrong' END AS outcome FROM a) SELECT outcome, count(*) AS n FROM o GROUP BY 1")
def e15(spark, d):
    p = pairs(spark, d).withColumnRenamed("id", "entity")
    a = p.where("entity % 11 > 0").select("entity", "pred")
    b = p.where("entity % 7 > 0").select("entity", F.when(F.col("entity") % 3 == 0, F.col("truth")).otherwise(F.col("pred")).alias("pred"))
    return E.two_arms(a, b, p.select("entity", "truth")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("e16_w01_coverage_rollup", f"{PW}, c AS (SELECT split_part(truth, '.', 1) AS top, id % 9 > 0 AS seen, id % 9 > 0 AND id % 5 > 0 AS tagged FROM pairs) SELECT top, grouping(top) AS total, count(*) AS n, count(*) FILTER (WHERE NOT seen) AS never_seen, count(*) FILTER (WHERE seen AND NOT tagged) AS declined, count(*) FILTER (WHERE tagged) AS tagged FROM c GROUP BY ROLLUP (top)")
def e16(spark, d):
    seen, tagged = F.col("id") % 9 > 0, (F.col("id") % 9 > 0) & (F.col("id") % 5 > 0)
    c = pairs(spark, d).select(F.substring_index("truth", ".", 1).alias("top"), seen.alias("seen"), tagged.alias("tagged"))
    return c.rollup("top").agg(F.grouping("top").cast("long").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("seen")).alias("never_seen"), F.count_if(F.col("seen") & ~F.col("tagged")).alias("declined"), F.count_if("tagged").alias("tagged"))


@query("e17_flips", f"{PW}, f AS (SELECT truth, pred, CASE WHEN id % 4 = 0 THEN truth ELSE pred END AS vote FROM pairs) SELECT count(*) AS flips, count(*) FILTER (WHERE vote = truth) AS vote_right, count(*) FILTER (WHERE pred = truth) AS fused_right FROM f WHERE vote <> pred")
def e17(spark, d):
    f = pairs(spark, d).withColumn("vote", F.when(F.col("id") % 4 == 0, F.col("truth")).otherwise(F.col("pred"))).where("vote <> pred")
    return f.agg(F.count(F.lit(1)).alias("flips"), F.count_if(F.expr("vote = truth")).alias("vote_right"), F.count_if(F.expr("pred = truth")).alias("fused_right"))


@query("e18_e26_buckets", f"{PW} SELECT CASE WHEN conf < 0.05 THEN '0' WHEN conf < 0.1 THEN '1' WHEN conf < 0.2 THEN '2' WHEN conf < 0.4 THEN '3' WHEN conf < 0.6 THEN '4' WHEN conf < 0.8 THEN '5' ELSE '6' END AS bucket, count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1 ELSE 0 END), 6) AS accuracy, round(median(conf), 6) AS median_conf FROM pairs GROUP BY 1")
def e18(spark, d):
    c = F.col("conf")
    b = F.when(c < 0.05, "0").when(c < 0.1, "1").when(c < 0.2, "2").when(c < 0.4, "3").when(c < 0.6, "4").when(c < 0.8, "5").otherwise("6")
    return rnd(pairs(spark, d).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"), F.median("conf").alias("median_conf")), "accuracy", "median_conf")


_ECE = "b AS (SELECT {g} least(floor(conf * 15), 14) AS bin, count(*) AS n, avg(conf) AS c, avg(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS a FROM pairs GROUP BY ALL)"


@query("e19_calibration_error", f"{PW}, {_ECE.format(g='')} SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def e19(spark, d):
    return rnd(E.calibration_error(pairs(spark, d).withColumn("hit", F.col("truth") == F.col("pred"))), "ece")


@query("e20_class_calibration", f"{PW}, {_ECE.format(g='truth,')} SELECT truth, round(sum(n * abs(c - a)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1 HAVING sum(n) >= 5")
def e20(spark, d):
    return rnd(E.calibration_error(pairs(spark, d).withColumn("hit", F.col("truth") == F.col("pred")), 15, "truth").where("n >= 5"), "ece")


@query("e22_mass_percentiles", f"{PW} SELECT round(avg(conf), 6) AS mean, round(quantile_cont(conf, 0.5), 6) AS p50, round(quantile_cont(conf, 0.95), 6) AS p95, max(conf) AS top, round(stddev_pop(conf), 6) AS sd FROM pairs")
def e22(spark, d):
    return rnd(pairs(spark, d).agg(F.avg("conf").alias("mean"), F.percentile("conf", 0.5).alias("p50"), F.percentile("conf", 0.95).alias("p95"), F.max("conf").alias("top"), F.stddev_pop("conf").alias("sd")), "mean", "p50", "p95", "sd")


@query("e27_root_consistency", f"{PW}, c AS (SELECT split_part(truth, '.', 2) AS tbl, split_part(pred, '.', 1) AS root, count(*) AS n FROM pairs GROUP BY 1, 2) SELECT tbl, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS modal_share FROM c GROUP BY 1")
def e27(spark, d):
    c = pairs(spark, d).groupBy(F.split("truth", r"\.")[1].alias("tbl"), F.substring_index("pred", ".", 1).alias("root")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("tbl").agg(F.sum("n").alias("n"), F.round(F.max("n") / F.sum("n"), 6).alias("modal_share")).select("tbl", "n", "modal_share")


@query("e28_reference_overlap", f"{PW} SELECT count(*) AS shared, count(*) FILTER (WHERE truth = pred) AS matched, count(DISTINCT pred) AS n_codes FROM pairs WHERE id % 3 = 0")
def e28(spark, d):
    p = pairs(spark, d)
    j = p.select("id", "truth").join(p.where("id % 3 = 0").select("id", "pred"), "id")
    return j.agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.expr("truth = pred")).alias("matched"), F.countDistinct("pred").alias("n_codes"))


@query("e29_reliability", "SELECT o_orderpriority AS tag, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS pass_rate FROM orders GROUP BY 1")
def e29(spark, d):
    ok = F.count_if(F.col("o_orderstatus") == "F")
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.count(F.lit(1)).alias("n"), ok.alias("passed"), F.round(ok / F.count(F.lit(1)), 6).alias("pass_rate"))


@query("e30_uplift_gate", f"{PW}, a AS (SELECT truth AS code, avg(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS cos, avg(CASE WHEN truth = pred OR id % 5 = 0 THEN 1 ELSE 0 END) AS fused FROM pairs GROUP BY 1) SELECT count(*) AS n_codes, count(*) FILTER (WHERE fused < cos) AS regressions, round(avg(fused) - avg(cos), 6) AS uplift, avg(fused) - avg(cos) > 0.02 AS deployable FROM a")
def e30(spark, d):
    right = F.col("truth") == F.col("pred")
    a = pairs(spark, d).groupBy("truth").agg(F.avg(right.cast("double")).alias("cos"), F.avg((right | (F.col("id") % 5 == 0)).cast("double")).alias("fused"))
    up = F.avg("fused") - F.avg("cos")
    return a.agg(F.count(F.lit(1)).alias("n_codes"), F.count_if(F.expr("fused < cos")).alias("regressions"), F.round(up, 6).alias("uplift"), (up > 0.02).alias("deployable"))


@query("e31_weight_coverage", "WITH w AS (SELECT source, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 0.5 ELSE 1 END AS w FROM documents) SELECT source AS code, count(*) AS n, count(*) FILTER (WHERE w > 0) AS kept, CAST(sum(w) AS DOUBLE) AS weight, count(*) FILTER (WHERE w > 0) < 35 AS needs_augmentation FROM w GROUP BY 1")
def e31(spark, d):
    k = F.col("doc_id")
    w = F.when(k % 4 == 0, 0.0).when(k % 3 == 0, 0.5).otherwise(1.0)
    return read(spark, d, "documents").groupBy(F.col("source").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_if(w > 0).alias("kept"), F.sum(w).alias("weight"), (F.count_if(w > 0) < 35).alias("needs_augmentation"))


@query("e32_trace_terms", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, round(count(*) FILTER (WHERE contains(lower(text), 'the')) / count(*), 6) AS cites FROM conversations GROUP BY 1")
def e32(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.round(F.count_if(F.contains(F.lower("text"), F.lit("the"))) / F.count(F.lit(1)), 6).alias("cites"))


@query("e33_w02_coverage_cube", f"{PW}, c AS (SELECT split_part(truth, '.', 1) AS top, CASE WHEN conf >= 0.5 THEN 'high' ELSE 'low' END AS rung, truth = pred AS hit FROM pairs) SELECT top, rung, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM c GROUP BY CUBE (top, rung)")
def e33(spark, d):
    c = pairs(spark, d).select(F.substring_index("truth", ".", 1).alias("top"), F.when(F.col("conf") >= 0.5, "high").otherwise("low").alias("rung"), (F.col("truth") == F.col("pred")).alias("hit"))
    return c.cube("top", "rung").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


@query("e34_class_deltas", f"{PW}, a AS (SELECT truth AS code, count(*) AS n, avg(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS acc, avg(CASE WHEN truth = pred AND id % 4 > 0 THEN 1 ELSE 0 END) AS base FROM pairs GROUP BY 1) SELECT code, n, round(acc, 6) AS acc, round(acc - base, 6) AS delta FROM a")
def e34(spark, d):
    p = pairs(spark, d)
    hit = F.col("truth") == F.col("pred")
    a = p.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("acc"))
    b = p.groupBy("truth").agg(F.avg((hit & (F.col("id") % 4 > 0)).cast("double")).alias("base"))
    return a.join(b, "truth", "full").select(F.col("truth").alias("code"), "n", F.round("acc", 6).alias("acc"), F.round(F.col("acc") - F.col("base"), 6).alias("delta"))


@query("e35_subset_change", "WITH b AS (SELECT o_custkey AS entity, o_orderpriority AS code, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2), a AS (SELECT o_custkey AS entity, o_orderpriority AS code, row_number() OVER (PARTITION BY o_custkey ORDER BY sum(o_totalprice) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2), t AS (SELECT c_custkey AS entity, '1-URGENT' AS code FROM customer), j AS (SELECT t.entity, coalesce(b.r, 1 << 30) AS o, coalesce(a.r, 1 << 30) AS n FROM t LEFT JOIN b ON b.entity = t.entity AND b.code = t.code LEFT JOIN a ON a.entity = t.entity AND a.code = t.code) SELECT CASE WHEN n < o THEN 'improved' WHEN n > o THEN 'regressed' ELSE 'unchanged' END AS change, count(*) AS n FROM j GROUP BY 1")
def e35(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("entity")
    ranked = lambda c: o.select("entity", "code", F.row_number().over(w.orderBy(F.col(c).desc(), "code")).alias("rank"))
    truth = read(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.lit("1-URGENT").alias("truth"))
    return E.subset_change(ranked("n"), ranked("v"), truth)


# Convergence: days of events are iterations, users are entities.

_ITER = "it AS (SELECT user_id AS entity, CAST(day(ts) AS INT) AS iteration, avg(value) / 100 AS gap, count(*) / 20.0::DOUBLE AS k, 1 - avg(value) / 100 AS bel, CASE WHEN max(event_type) = 'view' THEN 'v' END AS label FROM events GROUP BY 1, 2)"


def iterations(spark, d):
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("iteration"))
    return e.agg((F.avg("value") / 100).alias("gap"), (F.count(F.lit(1)) / 20.0).alias("k"), (1 - F.avg("value") / 100).alias("bel"), F.when(F.max("event_type") == "view", "v").alias("label"))


_MET = f"{_ITER}, met AS (SELECT iteration, avg(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END) AS coverage, avg(k) FILTER (WHERE label IS NOT NULL) AS mean_k, max(k) FILTER (WHERE label IS NOT NULL) AS max_k, avg(gap) FILTER (WHERE label IS NOT NULL) AS mean_gap, avg(bel) FILTER (WHERE label IS NOT NULL) AS mean_bel, avg(CASE WHEN bel < 0.3 OR gap > 0.5 THEN 1 ELSE 0 END) FILTER (WHERE label IS NOT NULL) AS frac_unclear FROM it GROUP BY 1)"
_MCOLS = ("coverage", "mean_k", "max_k", "mean_gap", "mean_bel", "frac_unclear")


@query("c01_agreement", "WITH v AS (SELECT o_custkey AS entity, o_orderstatus AS channel, o_orderpriority AS code, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS rank FROM orders GROUP BY 1, 2, 3), p AS (SELECT entity, channel, bool_or(rank = 1 AND code = '1-URGENT') AS ok FROM v GROUP BY 1, 2) SELECT entity, count(*) FILTER (WHERE ok) AS n_agree, count(*) FILTER (WHERE ok) >= 2 AS locked FROM p GROUP BY 1")
def c01(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("channel"), F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("entity", "channel").orderBy(F.col("n").desc(), "code"))
    return L.agreement(o.withColumn("rank", r).withColumn("vote", F.lit("1-URGENT")), 2)


@query("c02_disagreements", f"{PW}, r AS (SELECT id AS entity, truth AS vote, pred, conf AS m, (id % 50) / 100.0::DOUBLE AS k, CASE WHEN id % 3 = 0 THEN pred ELSE truth END AS ind FROM pairs) SELECT entity, CASE WHEN ind <> vote AND m >= 0.45 THEN 0 ELSE 1 END AS priority, CASE WHEN ind <> vote AND m >= 0.45 THEN m ELSE k END AS score FROM r WHERE (ind <> vote AND m >= 0.45) OR (pred <> vote AND k > 0.2)")
def c02(spark, d):
    p = pairs(spark, d).select(F.col("id").alias("entity"), F.col("truth").alias("vote"), "pred", F.col("conf").alias("independent_mass"), ((F.col("id") % 50) / 100.0).alias("k"), F.when(F.col("id") % 3 == 0, F.col("pred")).otherwise(F.col("truth")).alias("independent"))
    return L.disagreements(p)


@query("c03_uncertain", f"WITH {_ITER} SELECT entity, iteration FROM it WHERE (round(gap, 9) > 0.18 OR round(bel, 9) < 0.45) AND label IS NULL")
def c03(spark, d):
    rows = iterations(spark, d).withColumns({"gap": F.round("gap", 9), "bel": F.round("bel", 9), "margin": F.lit(1.0), "locked": F.col("label").isNotNull()})
    return L.uncertain(rows).select("entity", "iteration")


@query("c04_metrics", f"WITH {_MET} SELECT iteration, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MCOLS) + " FROM met")
def c04(spark, d):
    return rnd(L.metrics(iterations(spark, d)), *_MCOLS)


@query("c05_c06_residual", f"WITH {_MET} SELECT iteration, round(sqrt((pow(mean_gap / 0.18, 2) + pow(frac_unclear / 0.25, 2) + pow(mean_k / 0.2, 2) + pow(coverage / 0.2, 2)) / 4), 6) AS residual FROM met")
def c06(spark, d):
    m = L.metrics(iterations(spark, d))
    return m.select("iteration", F.round(L.residual(F.col("mean_gap"), F.col("frac_unclear"), F.col("mean_k"), F.col("coverage")), 6).alias("residual"))


@query("c07_contraction", f"WITH {_MET} SELECT iteration, round(mean_gap / lag(mean_gap) OVER (ORDER BY iteration), 6) AS ratio, round((mean_gap - first_value(mean_gap) OVER (ORDER BY iteration)) / nullif(row_number() OVER (ORDER BY iteration) - 1, 0), 6) AS slope FROM met")
def c07(spark, d):
    return rnd(L.contraction(L.metrics(iterations(spark, d)), "mean_gap").select("iteration", "ratio", "slope"), "ratio", "slope")


@query("c08_plateau", f"WITH {_MET}, x AS (SELECT iteration, round(mean_gap, 9) AS g FROM met) SELECT iteration, coalesce(g - lag(g, 1) OVER w >= -1e-6 AND lag(g, 1) OVER w - lag(g, 2) OVER w >= -1e-6, false) AS plateau FROM x WINDOW w AS (ORDER BY iteration)")
def c08(spark, d):
    return L.plateau(rnd(L.metrics(iterations(spark, d)), "mean_gap", digits=9), "mean_gap").select("iteration", "plateau")


@query("c09_trajectories", f"WITH {_ITER}, r AS (SELECT entity, iteration, coalesce(gap / nullif(lag(gap) OVER w, 0), k / nullif(lag(k) OVER w, 0)) AS x FROM it WINDOW w AS (PARTITION BY entity ORDER BY iteration)) SELECT entity, count(*) AS n, round(arg_max(x, iteration), 6) AS last_ratio FROM r GROUP BY 1")
def c09(spark, d):
    return rnd(L.trajectories(iterations(spark, d)), "last_ratio")


@query("c10_c12_revisit")
def c10(spark, d):
    """Customers whose segment is voted by three of their orders; uncertain ones are asked again about the next three, by rotation.

    The priorities of orders stand for segments, both in order of their names; a vote's
    confidence is the share of the three that agree.
    """
    from colsense.operators import fusion, sampling
    from colsense.sources.sinks import write_down

    from .inputs import Frame, masses
    from .pipeline import classify

    frame = Frame(spark, d)
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", "o_orderpriority")
    nth = lambda df, c, name: df.select(c).distinct().withColumn("nth", F.row_number().over(Window.orderBy(c))).withColumnRenamed(c, name)  # noqa: E731  five names each
    segments = nth(read(spark, d, "customer"), "c_mktsegment", "segment").join(nth(orders, "o_orderpriority", "o_orderpriority"), "nth").drop("nth")
    pool = write_down(orders.join(customers(spark, d).select("entity", "mid"), "entity").join(F.broadcast(segments), "o_orderpriority").select("entity", "o_orderkey", F.concat_ws(".", "mid", "segment").alias("code")))

    def ask(again, i):
        rows = sampling.sliding(pool.join(again, "entity", "left_semi"), ["entity"], "o_orderkey", 3, i)
        return rows.groupBy("entity", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(F.max_by("code", F.struct("n", "code")).alias("code"), (F.max("n") / F.sum("n")).alias("confidence"))

    def fuse(evidence, votes):
        voted = fusion.vote_masses(votes.withColumn("rank", F.lit(1))).withColumn("source", F.lit("vote"))
        return classify(evidence.unionByName(voted.select("entity", "source", "focal", "mass")), frame, ["name", "pattern", "vote"])

    fixed = write_down(masses(spark, d).where("source <> 'vote'").select("entity", "source", "focal", "mass"))
    out, _, log, tag = L.revisit(fixed, ask(pool.select("entity").distinct(), 0), fuse, ask, write_down, L.Stops(most=3))
    return out.select("entity", "code", "vote", "round", "gap", "bel", F.lit(tag).alias("outcome"), F.lit(len(log) - 1).alias("rounds"))


@query("c11_vote_sources", "WITH v AS (SELECT user_id AS entity, event_type AS code, value AS confidence, CAST(day(ts) AS INT) AS iteration, CASE event_type WHEN 'click' THEN 'direct' WHEN 'view' THEN 'propagated' ELSE 'revisit' END AS source, event_id FROM events), f AS (SELECT entity, iteration, source, max(confidence) AS confidence FROM v GROUP BY 1, 2, 3) SELECT entity, source, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY iteration DESC, CASE source WHEN 'revisit' THEN 2 WHEN 'direct' THEN 1 ELSE 0 END DESC) AS r FROM f) WHERE r = 1")
def c11(spark, d):
    e = read(spark, d, "events")
    t = F.col("event_type")
    src = F.when(t == "click", "direct").when(t == "view", "propagated").otherwise("revisit")
    v = e.groupBy(F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("iteration"), src.alias("source")).agg(F.max("value").alias("confidence")).withColumn("code", F.lit("x"))
    return rnd(L.vote_sources(v).select("entity", "source", "confidence"), "confidence")


@query("c13_conflict_report", f"WITH {_ITER} SELECT entity, iteration, round(k, 6) AS k, round(gap, 6) AS gap, rank() OVER (PARTITION BY iteration ORDER BY round(k, 9) DESC, entity) AS place FROM it WHERE k > 0.05")
def c13(spark, d):
    r = iterations(spark, d).where("k > 0.05").withColumn("place", F.rank().over(Window.partitionBy("iteration").orderBy(F.round("k", 9).desc(), "entity")))
    return rnd(r.select("entity", "iteration", "k", "gap", "place"), "k", "gap")
