"""Queries of evidence fusion (D)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from colsense.operators import fusion as D
from colsense.operators import taxonomy as T
from colsense.sources.sinks import write_down

from . import query
from .inputs import CLOSURE, CUSTOMERS, FRAME, MASSES, NODES, PAIRS, SOURCES, Frame, customers, fused_sql, masses, read

BASE = f"WITH {NODES}, {CLOSURE}, {CUSTOMERS}, {MASSES}, {FRAME}"
TWO = f"{BASE}, {fused_sql(['name', 'pattern'])}"
ALL3 = f"{BASE}, {fused_sql(SOURCES)}"
_BELIEF = "bel AS (SELECT f.entity, b.focal, sum(f.mass) AS bel FROM fused f JOIN meet m ON m.f1 = f.focal AND m.f12 = f.focal JOIN fr b ON b.focal = m.f2 GROUP BY 1, 2), pl AS (SELECT f.entity, m.f2 AS focal, sum(f.mass) AS pl FROM fused f JOIN meet m ON m.f1 = f.focal GROUP BY 1, 2), iv AS (SELECT pl.entity, pl.focal, coalesce(bel, 0) AS bel, pl FROM pl LEFT JOIN bel USING (entity, focal))"
_R = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def fused(spark, d, sources=SOURCES, rule="dempster"):
    f = Frame(spark, d)
    return f, write_down(D.combine_all(masses(spark, d), f.meet, sources, rule))


@query("d01_frame", f"WITH {NODES}, {FRAME} SELECT s.focal, s.size FROM sizes s")
def d01(spark, d):
    return Frame(spark, d).frame.select("focal", "size")


@query("d01_meet", f"WITH {NODES}, {FRAME} SELECT f1, f2, f12 FROM meet")
def d01b(spark, d):
    return Frame(spark, d).meet


@query("d02_invalid", f"{BASE}, bad AS (SELECT entity, source, focal, CASE WHEN entity % 9 = 0 AND source = 'vote' THEN mass * 0.5 ELSE mass END AS mass FROM masses) SELECT entity, source, round(sum(mass), 6) AS total FROM bad GROUP BY 1, 2 HAVING abs(sum(mass) - 1) > 1e-9")
def d02(spark, d):
    m = masses(spark, d).withColumn("mass", F.when((F.col("entity") % 9 == 0) & (F.col("source") == "vote"), F.col("mass") * 0.5).otherwise(F.col("mass")))
    return rounded(D.invalid(m), "total")


@query("d02_normalised", f"{BASE}, bad AS (SELECT entity, source, focal, CASE WHEN entity % 9 = 0 AND source = 'vote' THEN mass * 0.5 ELSE mass END AS mass FROM masses) SELECT entity, source, focal, round(mass / sum(mass) OVER (PARTITION BY entity, source), 6) AS mass FROM bad")
def d02b(spark, d):
    m = masses(spark, d).withColumn("mass", F.when((F.col("entity") % 9 == 0) & (F.col("source") == "vote"), F.col("mass") * 0.5).otherwise(F.col("mass")))
    return rounded(D.normalise(m), "mass")


@query("d07_dempster_two", f"{TWO} SELECT entity, focal, {_R('mass', 'k')} FROM fused")
def d07(spark, d):
    return rounded(fused(spark, d, ["name", "pattern"])[1], "mass", "k")


@query("d08_yager_two", f"{BASE}, {fused_sql(['name', 'pattern'], 'yager')} SELECT entity, focal, {_R('mass', 'k')} FROM fused")
def d08(spark, d):
    return rounded(fused(spark, d, ["name", "pattern"], "yager")[1], "mass", "k")


@query("d09_dempster_three", f"{ALL3} SELECT entity, focal, {_R('mass', 'k')} FROM fused")
def d09(spark, d):
    return rounded(fused(spark, d)[1], "mass", "k")


@query("d09_yager_three", f"{BASE}, {fused_sql(SOURCES, 'yager')} SELECT entity, focal, {_R('mass', 'k')} FROM fused")
def d09b(spark, d):
    return rounded(fused(spark, d, rule="yager")[1], "mass", "k")


@query("d03_d04_intervals", f"{TWO}, {_BELIEF} SELECT entity, focal, {_R('bel', 'pl')}, round(pl - bel, 6) AS gap FROM iv")
def d03(spark, d):
    f, x = fused(spark, d, ["name", "pattern"])
    return rounded(D.intervals(x, f.subset(), f.meet), "bel", "pl", "gap")


_PIG = "pig AS (SELECT f.entity, m.code, sum(f.mass / s.size) AS p FROM fused f JOIN sizes s USING (focal) JOIN mem m USING (focal) GROUP BY 1, 2)"


@query("d05_pignistic", f"{TWO}, {_PIG} SELECT entity, code, {_R('p')} FROM pig")
def d05(spark, d):
    f, x = fused(spark, d, ["name", "pattern"])
    return rounded(D.pignistic(x, f.members, f.frame), "p")


@query("d06_committed", f"{ALL3}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mass DESC, focal) AS r FROM fused WHERE focal <> 'Z' AND NOT suffix(focal, '*')) SELECT entity, focal AS code, {_R('mass')} FROM r WHERE r = 1")
def d06(spark, d):
    return rounded(D.committed(fused(spark, d)[1]), "mass")


@query("d10_not_vacuous", f"{BASE}, m AS (SELECT * FROM masses WHERE NOT (entity % 4 = 0 AND source = 'vote' AND focal <> 'Z')), n AS (SELECT *, count(*) OVER (PARTITION BY entity, source) AS n FROM m) SELECT entity, source, focal, {_R('mass')} FROM n WHERE n > 1 OR NOT (focal = 'Z' OR suffix(focal, '*'))")
def d10(spark, d):
    m = masses(spark, d).where(~((F.col("entity") % 4 == 0) & (F.col("source") == "vote") & (F.col("focal") != "Z")))
    return rounded(D.not_vacuous(m), "mass")


@query(
    "d11_d12_reliability",
    "WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 AS s1, l_quantity / 50 - l_discount AS s2 FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest(0.6 / (1 + exp(-(s1 - 0.40) / 0.10)) + 0.4 * tanh((s1 - s2) / 0.05), 0.05), 0.95), 6) AS alpha, round(tanh((s1 - s2) / 0.05), 6) AS weight FROM s",
)
def d11(spark, d):
    s1, s2 = F.col("l_quantity") / 50, F.col("l_quantity") / 50 - F.col("l_discount")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(read(spark, d, "lineitem").select(*keys, D.reliability(s1, s2).alias("alpha"), D.margin_weight(s1, s2).alias("weight")), "alpha", "weight")


_ALPHAS = {"name": 0.9, "pattern": 0.5, "vote": 0.7}
_SCALED = "scaled AS (SELECT entity, source, focal, mass * CASE source WHEN 'name' THEN 0.9 WHEN 'pattern' THEN 0.5 ELSE 0.7 END AS mass FROM masses WHERE focal <> 'Z')"


@query("d16_scaled", f"{BASE}, {_SCALED} SELECT entity, source, focal, {_R('mass')} FROM scaled UNION ALL SELECT entity, source, 'Z', round(1 - sum(mass), 6) FROM scaled GROUP BY 1, 2")
def d16(spark, d):
    alphas = spark.createDataFrame(list(_ALPHAS.items()), "source string, alpha double")
    return rounded(D.scaled(masses(spark, d), alphas), "mass")


_FIREDSQL = "fired AS (SELECT c_custkey AS entity, p AS pattern, ((c_custkey % 7) + k) / 10.0::DOUBLE AS fraction FROM customer, (SELECT * FROM (VALUES ('email_pattern', 1), ('url_pattern', 2), ('phone_pattern', 3)) t(p, k)) WHERE (c_custkey + k) % 3 > 0)"


@query(
    "d17_pattern_masses",
    f"WITH {_FIREDSQL}, t AS (SELECT * FROM (VALUES ('email_pattern', 'CONTACT.EMAIL'), ('url_pattern', 'TECH.URL')) t(pattern, code)), per AS (SELECT entity, code, max(fraction) AS f FROM fired JOIN t USING (pattern) GROUP BY 1, 2), m AS (SELECT entity, code, 0.75 * avg(f) OVER (PARTITION BY entity) / count(*) OVER (PARTITION BY entity) AS m FROM per) SELECT entity, code AS focal, round(m, 6) AS mass FROM m UNION ALL SELECT entity, 'Z', round(1 - sum(m), 6) FROM m GROUP BY 1",
)
def d17(spark, d):
    kinds = spark.createDataFrame([("email_pattern", 1), ("url_pattern", 2), ("phone_pattern", 3)], "pattern string, k int")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("entity")).join(F.broadcast(kinds))
    fired = c.where((F.col("entity") + F.col("k")) % 3 > 0).select("entity", "pattern", ((F.col("entity") % 7 + F.col("k")) / 10.0).alias("fraction"))
    targets = spark.createDataFrame([("email_pattern", "CONTACT.EMAIL"), ("url_pattern", "TECH.URL")], "pattern string, code string")
    return rounded(D.pattern_masses(fired, targets), "mass")


_VOTES = "votes AS (SELECT o_custkey AS entity, CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE o_orderpriority END AS code, count(*) / sum(count(*)) OVER (PARTITION BY o_custkey) AS confidence, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rank FROM orders GROUP BY o_custkey, o_orderpriority)"


def votes(spark, d):
    from pyspark.sql import Window

    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("entity")
    return o.select(
        "entity", F.when(~F.col("o_orderpriority").like("4%"), F.col("o_orderpriority")).alias("code"), (F.col("n") / F.sum("n").over(w)).alias("confidence"), F.row_number().over(w.orderBy(F.col("n").desc(), "o_orderpriority")).alias("rank")
    )


@query(
    "d19_vote_masses",
    f"WITH {_VOTES}, f AS (SELECT *, max(CASE WHEN rank = 1 THEN confidence * 0.8 END) OVER (PARTITION BY entity) AS first, sum(CASE WHEN rank > 1 THEN confidence END) OVER (PARTITION BY entity) AS tot FROM votes), m AS (SELECT entity, coalesce(code, 'Z') AS focal, sum(CASE WHEN rank = 1 THEN first ELSE (0.8 - first) * confidence / tot END) AS m FROM f GROUP BY 1, 2), z AS (SELECT * FROM m UNION ALL SELECT entity, 'Z', 1 - sum(m) FROM m GROUP BY 1) SELECT entity, focal, round(sum(m), 6) AS mass FROM z GROUP BY 1, 2",
)
def d19(spark, d):
    return rounded(D.vote_masses(votes(spark, d), 0.2), "mass")


@query("d20_d21_probability_masses", f"WITH {_VOTES}, p AS (SELECT entity, coalesce(code, 'Z') AS focal, sum(confidence) * (1 - least(0.75, 0.55 + 1.6 * (entity % 10) / 100.0)) AS m FROM votes GROUP BY entity, 2), z AS (SELECT * FROM p UNION ALL SELECT entity, 'Z', 1 - sum(m) FROM p GROUP BY 1) SELECT entity, focal, round(sum(m), 6) AS mass FROM z GROUP BY 1, 2")
def d20(spark, d):
    p = votes(spark, d).select("entity", "code", F.col("confidence").alias("p"))
    return rounded(D.probability_masses(p, D.variance_discount((F.col("entity") % 10) / 100.0)), "mass")


_ALPHA = "deep AS (SELECT ancestor AS code, max(distance) + 1 AS dd FROM clo GROUP BY 1), alpha AS (SELECT n.code, 1.0::DOUBLE / d.dd - coalesce(1.0::DOUBLE / p.dd, 0) AS alpha FROM nodes n JOIN deep d USING (code) LEFT JOIN deep p ON p.code = n.parent_code)"
_PROBS = "probs AS (SELECT entity, mid AS code, 0.5 + (entity % 4) * 0.1::DOUBLE AS p FROM cust UNION ALL SELECT entity, CASE WHEN mid = '1.1' THEN '0.0' ELSE '1.1' END, 0.5 - (entity % 4) * 0.1::DOUBLE FROM cust)"


@query(
    "d22_reweight_by_distance",
    f"WITH {NODES}, {CLOSURE}, {CUSTOMERS}, {_ALPHA}, {_PROBS}, up AS (SELECT c.code, c.ancestor, a.alpha FROM clo c JOIN alpha a ON a.code = c.ancestor WHERE len(string_split(c.code, '.')) = 2), t AS (SELECT code, sum(alpha) AS s FROM up GROUP BY 1), b AS (SELECT x.code AS a, y.code AS b, sum(x.alpha) AS s FROM up x JOIN up y USING (ancestor) GROUP BY 1, 2), dist AS (SELECT t1.code AS a, t2.code AS b, sqrt(greatest(t1.s + t2.s - 2 * coalesce(b.s, 0), 0)) AS d FROM t t1 CROSS JOIN t t2 LEFT JOIN b ON b.a = t1.code AND b.b = t2.code), far AS (SELECT x.entity, x.code, x.p, sum(y.p * d) AS d FROM probs x JOIN probs y USING (entity) JOIN dist ON dist.a = x.code AND dist.b = y.code GROUP BY 1, 2, 3) SELECT entity, code, round(p * exp(-d) / sum(p * exp(-d)) OVER (PARTITION BY entity), 6) AS p FROM far",
)
def d22(spark, d):
    f = Frame(spark, d)
    codes = f.nodes.where(F.size(F.split("code", r"\.")) == 2)
    dist = T.tree_distance(f.clo, T.path_weights(f.clo, f.nodes), codes)
    c = customers(spark, d)
    share = 0.5 + (F.col("entity") % 4) * 0.1
    probs = c.select("entity", F.col("mid").alias("code"), share.alias("p")).union(c.select("entity", F.when(F.col("mid") == "1.1", "0.0").otherwise("1.1"), 1 - share))
    return rounded(D.reweight_by_distance(probs, dist), "p")


_HEAD = "dir AS (SELECT *, regexp_replace(focal, '[*]$', '') AS code FROM fused WHERE focal <> 'Z'), head AS (SELECT entity, code, mass FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(mass, 12) DESC, len(string_split(code, '.')) DESC, code) AS r FROM dir WHERE len(string_split(code, '.')) > 1) WHERE r = 1)"


@query("d23_headline", f"{ALL3}, {_HEAD} SELECT entity, code, {_R('mass')}, 'direct' AS how FROM head")
def d23(spark, d):
    f, x = fused(spark, d)
    return rounded(D.headline(x, f.members, f.frame), "mass")


@query("d24_evidence", f"{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, source ORDER BY round(mass, 12) DESC, focal) AS r FROM masses WHERE focal <> 'Z') SELECT entity, string_agg(source || '=' || focal, '; ' ORDER BY source) AS evidence FROM r WHERE r = 1 GROUP BY 1")
def d24(spark, d):
    """The sources' strongest elements; the masses in the text are left out here, as decimals print differently."""
    return D.evidence_text(masses(spark, d)).select("entity", F.regexp_replace("evidence", r" \([0-9.]+\)", "").alias("evidence"))


@query("m13_top_masses", f"{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, source ORDER BY round(mass, 12) DESC, focal) AS rank FROM masses WHERE focal <> 'Z') SELECT entity, source, rank, focal, {_R('mass')} FROM r WHERE rank <= 3")
def m13(spark, d):
    return rounded(D.top_masses(masses(spark, d)), "mass")


@query(
    "d25_margin",
    f"{ALL3}, {_BELIEF}, {_HEAD}, top AS (SELECT h.entity, h.code, iv.bel FROM head h LEFT JOIN iv ON iv.entity = h.entity AND iv.focal = h.code), oth AS (SELECT t.entity, max(iv.bel) AS o FROM top t JOIN iv ON iv.entity = t.entity AND iv.bel > 0 WHERE NOT EXISTS (SELECT 1 FROM meet m WHERE m.f1 = t.code AND m.f2 = iv.focal) GROUP BY 1) SELECT t.entity, round(CASE WHEN o IS NULL THEN 1 ELSE greatest(coalesce(bel, 0) - o, 0) END, 6) AS margin FROM top t LEFT JOIN oth USING (entity)",
)
def d25(spark, d):
    f, x = fused(spark, d)
    iv = D.belief(x, f.subset())
    return rounded(D.margin(iv, D.headline(x, f.members, f.frame), f.meet), "margin")


@query("d26_needs_clarification", f"{ALL3}, {_BELIEF}, {_HEAD} SELECT h.entity, round(bel, 6) < 0.4 OR round(pl - bel, 6) > 0.3 AS unclear FROM head h JOIN iv ON iv.entity = h.entity AND iv.focal = h.code")
def d26(spark, d):
    f, x = fused(spark, d)
    head = write_down(D.headline(x, f.members, f.frame).select("entity", F.col("code").alias("focal")))
    iv = rounded(D.intervals_of(head, x, f.subset(), f.meet), "bel", "gap")
    return iv.join(head, ["entity", "focal"]).select("entity", D.needs_clarification(F.col("bel"), F.col("gap"), 0.4, 0.3).alias("unclear"))


@query(
    "d27_belief_path",
    f"{ALL3}, {_BELIEF}, {_HEAD}, w AS (SELECT iv.entity, regexp_replace(iv.focal, '[*]$', '') AS code, arg_max(struct_pack(b := bel, p := pl), suffix(iv.focal, '*')) AS x FROM iv GROUP BY 1, 2) SELECT h.entity, h.code, c.ancestor, c.distance, round(round(coalesce(x.b, 0), 9), 3) AS bel, round(round(coalesce(x.p, 0), 9), 3) AS pl FROM head h JOIN clo c ON c.code = h.code LEFT JOIN w ON w.entity = h.entity AND w.code = c.ancestor",
)
def d27(spark, d):
    f, x = fused(spark, d)
    head = write_down(D.headline(x, f.members, f.frame))
    iv = rounded(D.intervals_of(D.path_elements(head, f.clo), x, f.subset(), f.meet), "bel", "pl", digits=9)
    return D.belief_path(iv, head, f.clo)


_BELIEVED = "deep AS (SELECT *, regexp_replace(focal, '[*]$', '') AS code, suffix(focal, '*') AS wide FROM iv WHERE focal <> 'Z'), ranked AS (SELECT *, len(string_split(code, '.')) - 1 AS depth, row_number() OVER (PARTITION BY entity, split_part(code, '.', 1), wide ORDER BY round(bel, 12) DESC, len(string_split(code, '.')) DESC, focal) AS r FROM deep), believed AS (SELECT entity, focal, bel, depth FROM ranked WHERE round(bel, 9) >= 0.5 OR (r = 1 AND round(bel, 9) >= 0.05))"


@query("d28_believed", f"{TWO}, {_BELIEF}, {_BELIEVED} SELECT entity, focal, {_R('bel')}, depth FROM believed")
def d28(spark, d):
    f, x = fused(spark, d, ["name", "pattern"])
    return rounded(D.believed(rounded(D.belief(x, f.subset()), "bel", digits=9), 0.5), "bel")


@query("d29_cautious", f"{TWO}, {_BELIEF}, c AS (SELECT *, regexp_replace(focal, '[*]$', '') AS code FROM iv WHERE focal <> 'Z' AND round(bel, 3) >= 0.6), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY len(string_split(code, '.')) DESC, round(bel, 9) DESC, code) AS r FROM c) SELECT entity, code, round(bel, 3) AS bel FROM r WHERE r = 1")
def d29(spark, d):
    f, x = fused(spark, d, ["name", "pattern"])
    return D.cautious(rounded(D.belief(x, f.subset()), "bel", digits=9), 0.6)


@query("d30_promoted", f"{TWO}, {_BELIEF}, {_BELIEVED}, {_HEAD}, best AS (SELECT entity, regexp_replace(focal, '[*]$', '') AS better FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY depth DESC, round(bel, 12) DESC, focal) AS r FROM believed WHERE round(bel, 9) >= 0.5) WHERE r = 1), own AS (SELECT h.entity, h.code, coalesce(iv.bel, 0) AS bel, better FROM head h LEFT JOIN iv ON iv.entity = h.entity AND iv.focal = h.code LEFT JOIN best ON best.entity = h.entity), p AS (SELECT *, round(bel, 9) < 0.5 AND better IS NOT NULL AND better <> code AS promoted FROM own) SELECT entity, CASE WHEN promoted THEN better ELSE code END AS code, promoted FROM p".replace(" AS (SELECT", " AS MATERIALIZED (SELECT"))
def d30(spark, d):
    f, x = fused(spark, d, ["name", "pattern"])
    iv = rounded(D.belief(x, f.subset()), "bel", digits=9)
    return D.promoted(iv, D.headline(x, f.members, f.frame), 0.5)


@query("d31_independent_consensus", f"{TWO}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mass DESC, focal) AS r FROM fused WHERE focal <> 'Z' AND NOT suffix(focal, '*')) SELECT entity, focal AS code, {_R('mass', 'k')} FROM r WHERE r = 1")
def d31(spark, d):
    """The tiers that don't depend on votes: names and patterns alone."""
    x = fused(spark, d, ["name", "pattern"])[1]
    k = x.groupBy("entity").agg(F.first("k").alias("k"))
    return rounded(D.committed(x).join(k, "entity"), "mass", "k")


@query("d32_classify", f"{ALL3}, {_BELIEF}, {_HEAD}, kk AS (SELECT entity, max(k) AS k FROM fused GROUP BY 1) SELECT h.entity, h.code, n.label, round(iv.bel, 6) AS bel, round(iv.pl, 6) AS pl, round(iv.pl - iv.bel, 6) AS gap, round(kk.k, 6) AS k FROM head h JOIN iv ON iv.entity = h.entity AND iv.focal = h.code JOIN nodes n ON n.code = h.code JOIN kk ON kk.entity = h.entity")
def d32(spark, d):
    from .pipeline import classify

    return rounded(classify(masses(spark, d), Frame(spark, d), SOURCES), "bel", "pl", "gap", "k")


# The whole result row (D32) with the evidence text (D24). Every ninth customer has no evidence, every fifth no vote.
_H = lambda x: f"(CAST(floor(round({x}, 9) * 100 + 0.5) AS BIGINT) // 100 || '.' || lpad(CAST(CAST(floor(round({x}, 9) * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0'))"
_INDEP = re.sub(r"\b([spq])(\d)\b", r"i\1\2", fused_sql(["name", "pattern"]).replace("fused", "indep"))
_ROWS = (
    f"{BASE}, " + f"{fused_sql(SOURCES)}, {_INDEP}, {_BELIEF}, {_HEAD}".replace("FROM masses", "FROM mf").replace("JOIN masses", "JOIN mf")
).replace("fr AS (SELECT code AS focal", "mm AS (SELECT * FROM masses WHERE entity % 9 <> 0 AND NOT (entity % 5 = 0 AND source = 'vote')), mf AS (SELECT * FROM mm UNION ALL SELECT DISTINCT entity, 'vote', 'Z', 1.0::DOUBLE FROM mm WHERE entity % 5 = 0), fr AS (SELECT code AS focal", 1)
_ROW_PARTS = f"""i9 AS MATERIALIZED (SELECT entity, focal, regexp_replace(focal, '[*]$', '') AS code, suffix(focal, '*') AS wide, round(bel, 9) AS bel, round(pl, 9) AS pl FROM iv),
 ow AS (SELECT entity, code, arg_max(struct_pack(b := bel, p := pl), wide) AS x FROM i9 GROUP BY 1, 2), kk AS (SELECT entity, max(k) AS k FROM fused GROUP BY 1),
 an AS MATERIALIZED (SELECT h.entity, h.code, n.label, upper(n.label[1:6]) AS mnemonic, h.mass, coalesce(x.b, 0) AS bel, coalesce(x.p, 0) AS pl, k, CASE WHEN h.code IN (SELECT parent_code FROM nodes WHERE parent_code IS NOT NULL) THEN 'internal' ELSE 'leaf' END AS top_kind FROM head h LEFT JOIN ow ON ow.entity = h.entity AND ow.code = h.code LEFT JOIN nodes n ON n.code = h.code JOIN kk ON kk.entity = h.entity),
 tm AS (SELECT *, row_number() OVER (PARTITION BY entity, source ORDER BY round(mass, 12) DESC, focal) AS r FROM mm WHERE focal <> 'Z'),
 pt AS (SELECT entity, {", ".join(f"max(CASE WHEN source = '{s}' THEN '{s}→' || regexp_replace(focal, '[*]$', '') || '(' || {_H('mass')} || ')' END) AS p{k}" for k, s in enumerate(SOURCES))} FROM tm WHERE r = 1 GROUP BY 1),
 rv AS (SELECT a.entity, arg_min(struct_pack(c := i.code, b := i.bel), struct_pack(b := -round(i.bel, 9), o := i.code)) AS x FROM an a JOIN i9 i ON i.entity = a.entity AND i.wide AND round(i.bel, 9) >= 0.15 AND split_part(i.code, '.', 1) <> split_part(a.code, '.', 1) GROUP BY 1),
 ev AS (SELECT a.entity, 'dst(' || {" || ', ' || ".join(f"coalesce(p{k}, '{s}=0.000')" for k, s in enumerate(SOURCES))} || ') → ' || coalesce(a.label, a.code) || ' [Bel=' || {_H('a.bel')} || ', Pl=' || {_H('a.pl')} || ', K=' || {_H('a.k')} || ']' || coalesce(' [competing: ' || coalesce(n.label, rv.x.c) || ' (' || rv.x.c || ') Bel=' || {_H('rv.x.b')} || ']', '') AS evidence FROM an a LEFT JOIN pt USING (entity) LEFT JOIN rv USING (entity) LEFT JOIN nodes n ON n.code = rv.x.c),
 es AS (SELECT entity, string_agg(source || ': ' || t, '; ' ORDER BY source) AS evidence_sources FROM (SELECT entity, source, string_agg(focal || ' ' || {_H('mass')}, ', ' ORDER BY r) AS t FROM tm WHERE r <= 3 GROUP BY 1, 2) GROUP BY 1),
 bp AS (SELECT a.entity, string_agg(c.ancestor || ' ' || {_H('round(coalesce(ow.x.b, 0), 3)')}, ' < ' ORDER BY c.distance) AS belief_path FROM an a JOIN clo c ON c.code = a.code LEFT JOIN ow ON ow.entity = a.entity AND ow.code = c.ancestor GROUP BY 1),
 rk AS (SELECT *, len(string_split(code, '.')) - 1 AS depth, row_number() OVER (PARTITION BY entity, split_part(code, '.', 1), wide ORDER BY round(bel, 12) DESC, len(string_split(code, '.')) DESC, focal) AS r FROM i9 WHERE focal <> 'Z'),
 bv AS (SELECT * FROM rk WHERE bel >= 0.5 OR (r = 1 AND bel >= 0.05)), cs AS (SELECT entity, string_agg(focal || ' ' || {_H('bel')}, ', ' ORDER BY depth, focal) AS cross_subtree_belief FROM bv GROUP BY 1),
 cc AS (SELECT entity, code AS cautious_code FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY len(string_split(code, '.')) DESC, round(bel, 12) DESC, code) AS r FROM i9 WHERE focal <> 'Z' AND round(bel, 3) >= 0.7) WHERE r = 1),
 be AS (SELECT entity, code AS better FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY depth DESC, round(bel, 12) DESC, focal) AS r2 FROM bv WHERE bel >= 0.5) WHERE r2 = 1),
 pr AS (SELECT h.entity, CASE WHEN coalesce(i.bel, 0) < 0.5 AND better <> h.code THEN better END AS cautious_promoted_code FROM head h LEFT JOIN i9 i ON i.entity = h.entity AND i.focal = h.code LEFT JOIN be ON be.entity = h.entity),
 tp AS (SELECT h.entity, h.code, i.bel FROM head h LEFT JOIN i9 i ON i.entity = h.entity AND i.focal = h.code), ot AS (SELECT t.entity, max(i.bel) AS o FROM tp t JOIN i9 i ON i.entity = t.entity AND i.bel > 0 WHERE NOT EXISTS (SELECT 1 FROM meet m WHERE m.f1 = t.code AND m.f2 = i.focal) GROUP BY 1),
 mg AS (SELECT t.entity, CASE WHEN o IS NULL THEN 1 ELSE greatest(coalesce(bel, 0) - o, 0) END AS margin FROM tp t LEFT JOIN ot USING (entity)),
 al AS (SELECT entity, focal AS independent_top1_code, round(mass, 4) AS independent_top1_mass, round(k, 4) AS independent_top1_conflict FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mass DESC, focal) AS r FROM indep WHERE focal <> 'Z' AND NOT suffix(focal, '*')) WHERE r = 1),
 vt AS (SELECT entity, focal AS llm_code, mass AS llm_confidence FROM mm WHERE source = 'vote' AND focal <> 'Z' AND NOT suffix(focal, '*'))"""


@query("d32_result_rows", f"{_ROWS}, {_ROW_PARTS} SELECT c.entity, an.code AS predicted_code, coalesce(an.label, '') AS predicted_label, coalesce(mnemonic, '') AS predicted_annotation, round(coalesce(an.mass, 0), 4) AS confidence, round(coalesce(an.bel, 0), 4) AS belief, round(coalesce(an.pl, 1), 4) AS plausibility, round(coalesce(an.pl - an.bel, 1), 4) AS uncertainty, round(coalesce(an.k, 0), 4) AS conflict, coalesce(round(an.bel, 6) < 0.8 OR round(an.pl - an.bel, 6) > 0.2, false) AS needs_clarification, top_kind, round(margin, 4) AS top1_margin, coalesce(evidence, '') AS evidence, coalesce(evidence_sources, '') AS evidence_sources, belief_path, cautious_code, cross_subtree_belief, cautious_promoted_code, leaf AS reference_code, coalesce(n.label, '') AS reference_label, CASE WHEN an.code IS NOT NULL THEN leaf = an.code END AS matches_reference, llm_code, round(coalesce(llm_confidence, 0), 4) AS llm_confidence, independent_top1_code, independent_top1_mass, independent_top1_conflict FROM cust c LEFT JOIN an USING (entity) LEFT JOIN mg USING (entity) LEFT JOIN ev USING (entity) LEFT JOIN es USING (entity) LEFT JOIN bp USING (entity) LEFT JOIN cs USING (entity) LEFT JOIN cc USING (entity) LEFT JOIN pr USING (entity) LEFT JOIN al USING (entity) LEFT JOIN vt USING (entity) LEFT JOIN nodes n ON n.code = leaf")
def d32b(spark, d):
    from .pipeline import result_rows

    m = write_down(masses(spark, d).where((F.col("entity") % 9 != 0) & ~((F.col("entity") % 5 == 0) & (F.col("source") == "vote"))))
    who = customers(spark, d)
    votes = m.where((F.col("source") == "vote") & (F.col("focal") != "Z") & ~F.endswith("focal", F.lit("*"))).select("entity", F.col("focal").alias("llm_code"), F.col("mass").alias("llm_confidence"))
    return result_rows(who.select("entity"), m, Frame(spark, d), SOURCES, ["name", "pattern"], votes, who.select("entity", F.col("leaf").alias("reference_code")))


_STEPS = [0.25, 0.5, 0.75, 1.0]
_CELLS = "grid AS (SELECT a.i + 4 * b.i + 16 * c.i AS grid, (a.i + 1) / 4.0::DOUBLE AS an, (b.i + 1) / 4.0::DOUBLE AS ap, (c.i + 1) / 4.0::DOUBLE AS av FROM range(4) a(i), range(4) b(i), range(4) c(i)), m2 AS (SELECT grid * 1000000000 + entity AS entity, source, focal, mass * CASE source WHEN 'name' THEN an WHEN 'pattern' THEN ap ELSE av END AS mass FROM masses, grid WHERE focal <> 'Z'), m3 AS (SELECT * FROM m2 UNION ALL SELECT entity, source, 'Z', 1 - sum(mass) FROM m2 GROUP BY 1, 2)"


@query(
    "d33_d34_alpha_sweep",
    f"{BASE}, {_CELLS}, "
    + fused_sql(SOURCES).replace("FROM masses", "FROM m3").replace("JOIN masses", "JOIN m3")
    + f", {_PIG.replace('GROUP BY', "WHERE f.focal <> 'Z' GROUP BY")}, pick AS (SELECT entity, arg_min(code, struct_pack(p := -round(p, 9), c := code)) AS code FROM pig GROUP BY 1), r AS (SELECT pick.entity // 1000000000 AS grid, count(*) AS n, count(*) FILTER (WHERE pick.code = cust.leaf) AS correct FROM pick JOIN cust ON cust.entity = pick.entity % 1000000000 GROUP BY 1) SELECT CAST(grid AS BIGINT) AS grid, n, correct, 0 AS fallbacks, round(correct / n, 6) AS accuracy, round((correct - max(CASE WHEN grid = 63 THEN correct END) OVER ()) / n, 6) AS delta FROM r",
)
def d34(spark, d):
    """Three sources, four steps each: 64 cells."""
    f = Frame(spark, d)
    truth = customers(spark, d).select("entity", F.col("leaf").alias("truth"))
    return D.alpha_sweep(write_down(masses(spark, d)), truth, f.meet, f.frame, f.members, SOURCES, _STEPS)


_KNOWN = "m2 AS (SELECT m.*, fr.focal IS NOT NULL AND m.focal <> 'Z' AS known FROM masses m LEFT JOIN fr USING (focal)), m3 AS (SELECT entity, source, focal, mass FROM m2 WHERE known UNION ALL SELECT entity, source, 'Z', 1 - coalesce(sum(mass) FILTER (WHERE known), 0) FROM m2 GROUP BY 1, 2)"


@query("d33_rehydrated", f"{BASE}, {_KNOWN}, {fused_sql(SOURCES).replace('FROM masses', 'FROM m3').replace('JOIN masses', 'JOIN m3')} SELECT entity, focal, {_R('mass', 'k')} FROM fused")
def d33(spark, d):
    """Masses as JSON text, with an element that the taxonomy doesn't have, read back and fused."""
    f = Frame(spark, d)
    own = masses(spark, d).groupBy("entity", "source").agg(F.collect_list(F.struct("focal", "mass")).alias("m"))
    text = own.select("entity", "source", F.to_json(F.map_from_entries(F.concat("m", F.array(F.struct(F.lit("9.9.GONE").alias("focal"), F.lit(0.5).alias("mass")))))).alias("masses"))
    return rounded(D.combine_all(write_down(D.rehydrated(text, f.frame)), f.meet, SOURCES), "mass", "k")


_SIMS = "sims AS (SELECT entity, code, 0.2 + ((entity * 7 + row_number() OVER (PARTITION BY entity ORDER BY code) * 13) % 97) / 120.0 AS s FROM cust JOIN nodes ON nodes.parent_code = cust.mid)"


def sims(spark, d):
    from pyspark.sql import Window

    n = Frame(spark, d).nodes.where("parent_code IS NOT NULL").select("code", F.col("parent_code").alias("mid"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy("code"))
    j = customers(spark, d).select("entity", "mid").join(F.broadcast(n), "mid").withColumn("k", rank)
    return j.select("entity", "code", (0.2 + ((F.col("entity") * 7 + F.col("k") * 13) % 97) / 120.0).alias("s"))


@query("d13_significant_subtree", f"WITH {NODES}, {CLOSURE}, {CUSTOMERS}, {_SIMS}, top AS (SELECT entity, arg_max(code, (round(s, 12), code)) AS code FROM sims GROUP BY 1) SELECT entity, top.code, n.parent_code AS ancestor FROM top JOIN nodes n ON n.code = top.code")
def d13(spark, d):
    """All candidates are children of one nation, so it holds the whole mass."""
    return D.significant_subtree(sims(spark, d), Frame(spark, d).clo)


@query("d15_union_element", f"WITH {NODES}, {CUSTOMERS}, {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(s, 12) DESC, code) AS r FROM sims), o AS (SELECT entity, string_agg(code, '|' ORDER BY code) AS focal, least(greatest(max(s), 0), 1) AS m FROM r WHERE r <= 3 GROUP BY 1) SELECT entity, focal, round(m, 6) AS mass FROM o UNION ALL SELECT entity, 'Z', round(1 - m, 6) FROM o")
def d15(spark, d):
    return rounded(D.union_element(sims(spark, d), 3), "mass")


@query("d36_inference_belief", f"WITH {NODES}, {CUSTOMERS}, {_SIMS}, r AS (SELECT entity, s / sum(s) OVER (PARTITION BY entity) AS p, row_number() OVER (PARTITION BY entity ORDER BY round(s, 12) DESC, code) AS r FROM sims) SELECT entity, round(max(CASE WHEN r = 1 THEN p END), 6) AS bel, round(least(1, max(CASE WHEN r = 1 THEN p END) + greatest(0, 1 - sum(CASE WHEN r <= 3 THEN p ELSE 0 END))), 6) AS pl FROM r GROUP BY 1")
def d36(spark, d):
    """Belief is the best probability; what the best three leave open is added for plausibility."""
    from pyspark.sql import Window

    s = sims(spark, d)
    by = Window.partitionBy("entity")
    r = s.withColumn("p", F.col("s") / F.sum("s").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.round("s", 12).desc(), "code")))
    first = F.max(F.when(F.col("r") == 1, F.col("p")))
    return r.groupBy("entity").agg(F.round(first, 6).alias("bel"), F.round(F.least(F.lit(1.0), first + F.greatest(F.lit(0.0), 1 - F.sum(F.when(F.col("r") <= 3, F.col("p")).otherwise(0.0)))), 6).alias("pl"))


@query("d37_absent_axes", "WITH m AS (SELECT * FROM (VALUES ('en', ['agent', 'time', 'place']), ('fr', ['agent', 'time']), ('de', ['place']), ('es', ['agent'])) t(module, axes)), r AS (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN ['agent'] WHEN 1 THEN ['time', 'place'] ELSE ['agent', 'time', 'place'] END AS have FROM documents) SELECT doc_id, len(list_filter(axes, lambda a: NOT list_contains(have, a))) AS n_absent, list_contains(axes, 'time') AND NOT list_contains(have, 'time') AS time_claim_blocked FROM r JOIN m ON m.module = r.lang")
def d37(spark, d):
    """Required axes of a module minus those that are resolved; a claim on an unresolved axis is blocked."""
    need = spark.createDataFrame([("en", ["agent", "time", "place"]), ("fr", ["agent", "time"]), ("de", ["place"]), ("es", ["agent"])], "lang string, axes array<string>")
    k = F.col("doc_id") % 3
    have = F.when(k == 0, F.array(F.lit("agent"))).when(k == 1, F.array(F.lit("time"), F.lit("place"))).otherwise(F.array(F.lit("agent"), F.lit("time"), F.lit("place")))
    absent = F.array_except("axes", have)
    return read(spark, d, "documents").select("doc_id", "lang").join(F.broadcast(need), "lang").select("doc_id", F.size(absent).cast("long").alias("n_absent"), F.array_contains(absent, "time").alias("time_claim_blocked"))


@query("d38_belief_invariants", f"{TWO}, {_BELIEF}, t AS (SELECT entity, sum(mass) AS t FROM fused GROUP BY 1), up AS (SELECT a.bel AS bel, b.bel AS above FROM iv a JOIN nodes n ON n.code = a.focal JOIN iv b ON b.entity = a.entity AND b.focal = n.parent_code || '*') SELECT 'mass_sums_to_one' AS invariant, count(*) AS n, count(*) FILTER (WHERE abs(t - 1) > 1e-9) AS violations FROM t UNION ALL SELECT 'belief_below_plausibility', count(*), count(*) FILTER (WHERE bel > pl + 1e-9) FROM iv UNION ALL SELECT 'belief_grows_upwards', count(*), count(*) FILTER (WHERE bel > above + 1e-9) FROM up")
def d38(spark, d):
    f, x = fused(spark, d, ["name", "pattern"])
    return D.invariants(x, f.subset(), f.meet, f.nodes)


@query("d39_inflection", f"WITH {CUSTOMERS}, {PAIRS}, g AS (SELECT unnest(range(1, 10)) AS g), c AS (SELECT split_part(truth, '.', 1) AS tier, g, avg(CASE WHEN truth = pred AND conf >= g / 10.0 THEN 1.0 ELSE 0.0 END) AS acc FROM pairs, g GROUP BY 1, 2), s AS (SELECT *, lag(acc) OVER (PARTITION BY tier ORDER BY g) AS b FROM c) SELECT tier, min(CASE WHEN b >= 0.3 AND acc < 0.3 THEN g END) AS at, CASE WHEN min(CASE WHEN b >= 0.3 AND acc < 0.3 THEN g END) IS NOT NULL THEN 'falling' WHEN max(acc) < 0.3 THEN 'flat-lo' ELSE 'flat' END AS kind FROM s GROUP BY 1")
def d39(spark, d):
    """At which confidence the share of right and confident answers falls below 30 %, by root."""
    from .inputs import pairs

    g = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("g")
    hit = (F.col("truth") == F.col("pred")) & (F.col("conf") >= F.col("g") / 10.0)
    curve = pairs(spark, d).select("*", g).groupBy(F.substring_index("truth", ".", 1).alias("tier"), "g").agg(F.avg(hit.cast("double")).alias("acc"))
    return D.inflection(curve, "tier", "g", "acc", 0.3)


# Two variants of five weights of the names' evidence; a cell is an entity's copy.
_SWEEP = f"""{BASE}, sw AS (SELECT v, g FROM range(2) a(v), range(5) b(g)), m2 AS (SELECT (v * 5 + g) * 1000000000 + entity AS entity, source, focal, mass * CASE WHEN source = 'vote' AND v = 1 THEN 0 WHEN source = 'name' THEN g / 4.0::DOUBLE ELSE 1 END AS mass FROM masses, sw WHERE focal <> 'Z'),
 m3 AS (SELECT * FROM m2 WHERE mass > 0 UNION ALL SELECT * FROM (SELECT entity, source, 'Z', 1 - sum(mass) AS mass FROM m2 GROUP BY 1, 2) WHERE mass > 1e-15)"""
_CURVE = f"{_SWEEP}, {fused_sql(SOURCES)}, {_HEAD}, cv AS (SELECT CASE v WHEN 0 THEN 'all' ELSE 'no_vote' END AS variant, cust.top AS tier, g / 4.0::DOUBLE AS value, count(*) AS n, avg(CASE WHEN h.code = cust.leaf THEN 1.0 ELSE 0.0 END) AS accuracy FROM cust, sw LEFT JOIN head h ON h.entity = (v * 5 + g) * 1000000000 + cust.entity GROUP BY 1, 2, 3)".replace("FROM masses WHERE source", "FROM m3 WHERE source").replace("JOIN masses", "JOIN m3")


@query("d39_parameter_sweep", f"{_CURVE} SELECT variant, tier, value, n, round(accuracy, 6) AS accuracy FROM cv")
def d39b(spark, d):
    return rounded(name_sweep(spark, d), "accuracy")


@query("d39_sweep_inflection", f"{_CURVE}, s AS (SELECT *, lag(accuracy) OVER (PARTITION BY variant, tier ORDER BY value) AS b FROM cv), c AS (SELECT variant, tier, min(CASE WHEN (b < 0.5 AND accuracy >= 0.5) OR (b >= 0.5 AND accuracy < 0.5) THEN value END) AS at, arg_min(CASE WHEN b < 0.5 THEN 'rising' ELSE 'falling' END, value) FILTER (WHERE (b < 0.5 AND accuracy >= 0.5) OR (b >= 0.5 AND accuracy < 0.5)) AS kind, max(accuracy) AS most FROM s GROUP BY 1, 2) SELECT variant, tier, \"at\", coalesce(kind, CASE WHEN most < 0.5 THEN 'flat-lo' ELSE 'flat' END) AS kind FROM c")
def d39c(spark, d):
    """At which weight of the names each root's share of right answers crosses one half, with and without votes."""
    curve = name_sweep(spark, d).withColumn("by", F.concat_ws("|", "variant", "tier"))
    out = D.inflection(curve, "by", "value", "accuracy", 0.5)
    return out.select(F.substring_index("by", "|", 1).alias("variant"), F.substring_index("by", "|", -1).alias("tier"), "at", "kind")


def name_sweep(spark, d):
    f = Frame(spark, d)
    truth = customers(spark, d).select("entity", F.col("leaf").alias("truth"), F.col("top").alias("tier"))
    return write_down(D.parameter_sweep(masses(spark, d), truth, f.meet, f.members, f.frame, SOURCES, "name", [0.0, 0.25, 0.5, 0.75, 1.0], {"all": [], "no_vote": ["vote"]}))


@query("d40_shortlist", f"{TWO}, {_BELIEF}, {_BELIEVED}, {_HEAD}, ca AS (SELECT entity, code FROM (SELECT entity, regexp_replace(focal, '[*]$', '') AS code, row_number() OVER (PARTITION BY entity ORDER BY len(string_split(focal, '.')) DESC, round(bel, 9) DESC, regexp_replace(focal, '[*]$', '')) AS r FROM iv WHERE focal <> 'Z' AND round(round(bel, 9), 3) >= 0.6) WHERE r = 1), u AS (SELECT entity, regexp_replace(focal, '[*]$', '') AS code FROM believed UNION SELECT entity, code FROM head UNION SELECT entity, code FROM ca), p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY len(string_split(code, '.')) DESC, code) AS place FROM u) SELECT entity, code, place FROM p WHERE place <= 3")
def d40(spark, d):
    f, x = fused(spark, d, ["name", "pattern"])
    iv = write_down(rounded(D.belief(x, f.subset()), "bel", digits=9))
    return D.shortlist(D.believed(iv, 0.5), D.headline(x, f.members, f.frame), D.cautious(iv, 0.6))
