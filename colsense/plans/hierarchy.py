"""Queries of taxonomies (T) and set operations (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsense.operators import taxonomy as T

from . import query
from .inputs import CLOSURE, CUSTOMERS, NODES, PAIRS, closure, nodes, pairs, read

W = f"WITH {NODES}, {CLOSURE}"


@query("t01_build", "SELECT CAST(n_nationkey AS VARCHAR) || '.1' AS code, CAST(n_nationkey AS VARCHAR) AS parent_code, n_name AS label, 2 AS n_aliases FROM nation")
def t01(spark, d):
    n = read(spark, d, "nation")
    rec = n.select(F.concat("n_nationkey", F.lit(".1")).alias("id"), F.lit("").alias("parent_code"), F.col("n_name").alias("label"), F.concat(F.lower("n_name"), F.lit(" | x, ")).alias("common_names"))
    return T.build(rec).select("code", "parent_code", "label", F.size("aliases").alias("n_aliases"))


@query("t02_nearest_present", "WITH x AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, p_size || '.' || (p_partkey % 3) AS b, p_size || '.' || (p_partkey % 3) || '.' || p_partkey AS c FROM part), n AS (SELECT DISTINCT a AS code FROM x UNION SELECT b FROM x WHERE p_partkey % 2 = 0 UNION SELECT c FROM x) SELECT x.c AS code, CASE WHEN b IN (SELECT code FROM n) THEN b ELSE a END AS parent FROM x")
def t02(spark, d):
    p = read(spark, d, "part")
    a = F.col("p_size").cast("string")
    b = F.concat_ws(".", a, F.col("p_partkey") % 3)
    c = F.concat_ws(".", b, F.col("p_partkey"))
    codes = p.select(a.alias("code")).union(p.where("p_partkey % 2 = 0").select(b)).union(p.select(c)).distinct()
    return T.nearest_present(codes).where(F.size(F.split("code", r"\.")) == 3)


@query("t03_t04_closure", f"{W} SELECT code, ancestor, distance FROM clo")
def t03(spark, d):
    return T.closure(nodes(spark, d))


@query("t03_closure_of_dots", f"{W} SELECT code, ancestor, distance FROM clo")
def t03b(spark, d):
    return closure(spark, d)


@query("t04_descendants", f"{W} SELECT ancestor, count(*) AS n FROM clo WHERE distance > 0 GROUP BY 1")
def t04(spark, d):
    return T.descendants(closure(spark, d)).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


@query("t05_leaves", f"WITH {NODES} SELECT code FROM nodes WHERE code NOT IN (SELECT parent_code FROM nodes WHERE parent_code IS NOT NULL)")
def t05(spark, d):
    return T.leaves(nodes(spark, d))


@query("t05_children", f"WITH {NODES} SELECT parent_code AS code, string_agg(code, ',' ORDER BY code) AS children FROM nodes WHERE parent_code IS NOT NULL GROUP BY 1")
def t05b(spark, d):
    return T.children(nodes(spark, d)).select("code", F.array_join("children", ",").alias("children"))


@query("t06_ghosts", f"WITH {NODES}, kept AS (SELECT * FROM nodes WHERE NOT (len(string_split(code, '.')) = 2 AND TRY_CAST(split_part(code, '.', 2) AS INT) % 3 = 0)), p AS (SELECT DISTINCT array_to_string(string_split(code, '.')[1:k], '.') AS code FROM kept, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= len(string_split(code, '.'))) SELECT code FROM p WHERE code NOT IN (SELECT code FROM kept)")
def t06(spark, d):
    """Every third nation's row is taken out first."""
    parts = F.split("code", r"\.")
    gone = (F.size(parts) == 2) & (F.get(parts, F.lit(1)).try_cast("int") % 3 == 0)
    return T.ghosts(nodes(spark, d).where(~gone))


@query("t07_paths", f"{W} SELECT c.code, string_agg(upper(left(n.label, 6)), '.' ORDER BY c.distance DESC) AS path FROM clo c JOIN nodes n ON n.code = c.ancestor GROUP BY 1")
def t07(spark, d):
    return T.paths(closure(spark, d), nodes(spark, d))


@query("t08_compose", f"WITH {NODES} SELECT code, label FROM nodes UNION ALL SELECT CAST(p_size AS VARCHAR), 'size' FROM (SELECT DISTINCT p_size FROM part) WHERE CAST(p_size AS VARCHAR) NOT IN (SELECT code FROM nodes)")
def t08(spark, d):
    sizes = read(spark, d, "part").select(F.col("p_size").cast("string").alias("code"), F.lit("size").alias("label")).distinct()
    return T.compose(nodes(spark, d).select("code", "label"), sizes)


@query(
    "t09_findings",
    f"WITH {NODES}, norm AS (SELECT code, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS n FROM nodes) SELECT 'label_collision' AS finding, n AS subject FROM norm GROUP BY n HAVING count(DISTINCT code) > 1 UNION ALL SELECT DISTINCT 'alias_shadowed', a.code || ':' || a.n FROM norm a JOIN norm b ON a.n = b.n AND a.code <> b.code",
)
def t09(spark, d):
    return T.findings(nodes(spark, d))


@query("t10_genera", f"WITH {NODES} SELECT code FROM nodes WHERE parent_code IS NOT NULL AND code IN (SELECT parent_code FROM nodes)")
def t10(spark, d):
    return T.genera(nodes(spark, d))


_GENUS = "genus AS (SELECT code, CASE WHEN len(string_split(code, '.')) = 3 THEN parent_code ELSE code END AS genus FROM nodes)"


@query("t11_genus", f"WITH {NODES}, {_GENUS} SELECT code, genus FROM genus g WHERE genus IN (SELECT parent_code FROM nodes) OR len(string_split(code, '.')) = 3")
def t11(spark, d):
    return T.genus_of(closure(spark, d), nodes(spark, d))


@query("t12_neighbourhood", f"{W}, seed AS (SELECT code FROM nodes WHERE code LIKE '1.%' AND len(string_split(code, '.')) = 2), near AS (SELECT code FROM seed UNION SELECT n.parent_code FROM nodes n JOIN seed s ON n.code = s.code UNION SELECT n.code FROM nodes n JOIN seed s ON n.parent_code = s.code) SELECT DISTINCT ancestor AS code FROM clo JOIN near USING (code)")
def t12(spark, d):
    n = nodes(spark, d)
    seeds = n.where("code LIKE '1.%' AND size(split(code, '[.]')) = 2").select("code")
    return T.neighbourhood(n, closure(spark, d), seeds, 1)


@query("t13_lift", f"{W}, frame AS (SELECT code FROM nodes WHERE len(string_split(code, '.')) = 1 OR code LIKE '0.%' AND len(string_split(code, '.')) = 2), b AS (SELECT c.code, arg_min(c.ancestor, c.distance) AS lifted FROM clo c JOIN frame f ON f.code = c.ancestor GROUP BY 1) SELECT n.code, lifted FROM nodes n LEFT JOIN b USING (code)")
def t13(spark, d):
    n = nodes(spark, d)
    depth = F.size(F.split("code", r"\."))
    return T.lift(n, closure(spark, d), n.where((depth == 1) | (F.col("code").like("0.%") & (depth == 2))))


@query("t14_closed_frame", f"{W}, {CUSTOMERS} SELECT DISTINCT ancestor AS code FROM clo WHERE code IN (SELECT leaf FROM cust WHERE entity IN (SELECT o_custkey FROM orders))")
def t14(spark, d):
    from .inputs import customers

    ordered = read(spark, d, "orders").select(F.col("o_custkey").alias("entity"))
    return T.closed_frame(customers(spark, d).join(ordered, "entity", "left_semi").select(F.col("leaf").alias("code")), closure(spark, d))


_NEAR = "near AS (SELECT code, ancestor AS neighbour FROM clo WHERE distance <= 1 UNION SELECT c.code, n.code FROM clo c JOIN nodes n ON n.parent_code = c.ancestor WHERE c.distance = 1 UNION SELECT ancestor, code FROM clo WHERE distance = 1)"


@query("t15_near", f"{W}, {_NEAR} SELECT code, neighbour FROM near")
def t15(spark, d):
    return T.near(closure(spark, d), nodes(spark, d))


_INDEX = "idx AS (SELECT norm, arg_min(code, (tier, -len(string_split(code, '.')), code)) AS code FROM (SELECT code, 0 AS tier, regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g') AS norm FROM nodes UNION ALL SELECT code, 1, regexp_replace(lower(trim(upper(left(label, 6)))), '[^a-z0-9]+', '_', 'g') FROM nodes UNION ALL SELECT code, 2, regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g') FROM nodes) WHERE norm <> '' GROUP BY 1)"


@query("t16_name_index", f"WITH {NODES}, {_INDEX} SELECT norm, code FROM idx")
def t16(spark, d):
    return T.name_index(nodes(spark, d))


@query(
    "t17_derive_reference",
    f"WITH {NODES}, {_INDEX}, c AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'attr_1_' || p_size WHEN p_partkey % 3 = 1 THEN 'row_id' ELSE 'nation_' || (p_partkey % 25) END AS col FROM part) SELECT col AS \"column\", CASE WHEN regexp_matches(col, '^attr_') THEN '1.' || split_part(col, '_', 3) WHEN col = 'row_id' THEN '0.1' ELSE idx.code END AS code FROM c LEFT JOIN idx ON idx.norm = c.col",
)
def t17(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("attr_1_"), "p_size")).when(k % 3 == 1, F.lit("row_id")).otherwise(F.concat(F.lit("nation_"), k % 25))
    columns = read(spark, d, "part").select(name.alias("column")).distinct()
    return T.derive_reference(columns, T.name_index(nodes(spark, d)), "0.1")


@query("t18_type_export", f"WITH {NODES} SELECT 'T_' || regexp_replace(code, '[^A-Za-z0-9]', '_', 'g') AS type_name, coalesce('T_' || regexp_replace(parent_code, '[^A-Za-z0-9]', '_', 'g'), 'classification') AS super_type, label FROM nodes")
def t18(spark, d):
    return T.type_export(nodes(spark, d)).select("type_name", F.col("super_types")[0].alias("super_type"), F.col("attributes.label").alias("label"))


_ALPHA = "deep AS (SELECT ancestor AS code, max(distance) + 1 AS dd FROM clo GROUP BY 1), alpha AS (SELECT n.code, 1.0::DOUBLE / d.dd - coalesce(1.0::DOUBLE / p.dd, 0) AS alpha FROM nodes n JOIN deep d USING (code) LEFT JOIN deep p ON p.code = n.parent_code)"


@query("t19_path_weights", f"{W}, {_ALPHA} SELECT code, round(alpha, 6) AS alpha FROM alpha")
def t19(spark, d):
    return T.path_weights(closure(spark, d), nodes(spark, d)).withColumn("alpha", F.round("alpha", 6))


@query(
    "t20_tree_distance",
    f"{W}, {_ALPHA}, up AS (SELECT c.code, c.ancestor, a.alpha FROM clo c JOIN alpha a ON a.code = c.ancestor WHERE len(string_split(c.code, '.')) = 2), t AS (SELECT code, sum(alpha) AS s FROM up GROUP BY 1), b AS (SELECT x.code AS a, y.code AS b, sum(x.alpha) AS s FROM up x JOIN up y USING (ancestor) GROUP BY 1, 2) SELECT t1.code AS a, t2.code AS b, round(sqrt(greatest(t1.s + t2.s - 2 * coalesce(b.s, 0), 0)), 6) AS distance FROM t t1 CROSS JOIN t t2 LEFT JOIN b ON b.a = t1.code AND b.b = t2.code",
)
def t20(spark, d):
    """Between all nations: 25 nodes; the taxonomy is bounded, so its pairs are too."""
    n, clo = nodes(spark, d), closure(spark, d)
    codes = n.where(F.size(F.split("code", r"\.")) == 2)
    return T.tree_distance(clo, T.path_weights(clo, n), codes).withColumn("distance", F.round("distance", 6))


PLACED = f"{_GENUS}, placed AS (SELECT id, truth, pred, CASE WHEN truth = pred THEN 'exact' WHEN truth LIKE pred || '.%' THEN 'ancestor' WHEN pred LIKE truth || '.%' THEN 'descendant' WHEN g.genus = h.genus THEN 'same_genus' ELSE 'miss' END AS placement FROM pairs p LEFT JOIN genus g ON g.code = p.truth LEFT JOIN genus h ON h.code = p.pred)"


def placed(spark, d):
    n, clo = nodes(spark, d), closure(spark, d)
    return T.placement(pairs(spark, d), clo, T.genus_of(clo, n))


@query("t21_placement", f"WITH {NODES}, {CUSTOMERS}, {PAIRS}, {PLACED} SELECT id, truth, pred, placement FROM placed")
def t21(spark, d):
    return placed(spark, d)


_SHAPE = "CASE WHEN truth = pred THEN 'confirm' WHEN pred LIKE truth || '.%' THEN 'tightening' WHEN truth LIKE pred || '.%' THEN 'loosening' WHEN regexp_replace(truth, '\\.?[^.]*$', '') = regexp_replace(pred, '\\.?[^.]*$', '') THEN 'sibling' WHEN split_part(truth, '.', 1) = split_part(pred, '.', 1) THEN 'subtree' ELSE 'other_tree' END"


@query("t22_correction_shape", f"WITH {CUSTOMERS}, {PAIRS} SELECT id, {_SHAPE} AS shape FROM pairs")
def t22(spark, d):
    return pairs(spark, d).select("id", T.correction_shape(F.col("truth"), F.col("pred")).alias("shape"))


@query(
    "t23_path_walk",
    f"WITH {NODES}, {CUSTOMERS}, w AS (SELECT DISTINCT upper(left(r_name, 6)) || '.' || CASE WHEN c_nationkey % 4 = 0 THEN 'NOPE' ELSE upper(left(c_mktsegment, 6)) END AS path, CAST(r_regionkey AS VARCHAR) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT path, code, 1 AS bad_index, split_part(path, '.', 2) AS bad_segment FROM w",
)
def t23(spark, d):
    """Paths that leave out the nation stop at their second segment."""
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    seg = F.when(F.col("c_nationkey") % 4 == 0, "NOPE").otherwise(F.upper(F.substring("c_mktsegment", 1, 6)))
    wanted = j.select(F.concat_ws(".", F.upper(F.substring("r_name", 1, 6)), seg).alias("path")).distinct()
    return T.path_walk(wanted, nodes(spark, d), 4)


@query("t24_signature", f"WITH {NODES} SELECT sha256('[' || string_agg('\"' || code || '\"', ',' ORDER BY code) || ']') AS signature, count(*) AS n_codes FROM nodes")
def t24(spark, d):
    return T.signature(nodes(spark, d))


@query("t24_content_keys", f"WITH {NODES}, h AS (SELECT code, sha256(code || chr(31) || label || chr(31) || upper(left(label, 6)) || chr(31) || coalesce(parent_code, '')) AS h FROM nodes) SELECT code, left(h, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS content_key FROM h")
def t24b(spark, d):
    return T.content_keys(nodes(spark, d))


@query("t25_compatibility", f"WITH {NODES}, {CUSTOMERS}, w AS (SELECT DISTINCT leaf AS code FROM cust WHERE entity % 5 < 3 UNION SELECT 'x.' || (entity % 4) FROM cust) SELECT 'partial' AS compatibility, count(*) FILTER (WHERE n.code IS NULL) AS n_missing, count(*) FILTER (WHERE w.code IS NULL) AS n_extra, count(*) FILTER (WHERE n.code = w.code) AS n_common FROM nodes n FULL JOIN w ON n.code = w.code")
def t25(spark, d):
    from .inputs import customers

    c = customers(spark, d)
    want = c.where("entity % 5 < 3").select(F.col("leaf").alias("code")).union(c.select(F.concat(F.lit("x."), F.col("entity") % 4))).distinct()
    return T.compatibility(nodes(spark, d), want)


@query("t26_term_support", f"WITH {NODES}, n AS (SELECT code, lower(label) AS l FROM nodes), w AS (SELECT code, 1 AS w FROM nodes WHERE len(string_split(code, '.')) = 1 UNION ALL SELECT n.code, 3 FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) c JOIN n ON n.l = lower(c.s) UNION ALL SELECT n.code, 1 FROM region r JOIN n ON n.l = lower(r.r_name)) SELECT nodes.code, CAST(coalesce(sum(w), 0) AS BIGINT) AS support FROM nodes LEFT JOIN w USING (code) GROUP BY 1")
def t26(spark, d):
    n = nodes(spark, d)
    anchors = n.where(F.size(F.split("code", r"\.")) == 1)
    return T.term_support(n, anchors, read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct(), read(spark, d, "region").select(F.col("r_name").alias("name")))


@query("t27_depth_histogram", f"WITH {NODES} SELECT len(string_split(code, '.')) - 1 AS depth, count(*) AS n FROM nodes GROUP BY 1")
def t27(spark, d):
    return T.depth_histogram(closure(spark, d))



@query("t28_descend", f"WITH {CUSTOMERS} SELECT entity, CASE WHEN 0.3 + (entity % 5) * 0.1 > 0.45 THEN leaf ELSE mid END AS code, 0.6::DOUBLE AS weight FROM cust")
def t28(spark, d):
    from .inputs import customers

    c = customers(spark, d)
    none = F.lit(None).cast("string")
    options = (
        c.select("entity", none.alias("parent"), F.col("mid").alias("option"), F.lit(0.6).alias("prob"))
        .union(c.where("mid <> '0.0'").select("entity", none, F.lit("0.0"), F.lit(0.25)))
        .union(c.select("entity", "mid", "leaf", 0.3 + (F.col("entity") % 5) * 0.1))
        .union(c.select("entity", "mid", "mid", F.lit(0.45)))
    )
    return T.descend(options)


@query("t29_focus", f"{W}, {CUSTOMERS}, {PAIRS}, {_NEAR} SELECT id, neighbour AS code FROM pairs JOIN near ON near.code = truth UNION SELECT id, neighbour FROM pairs JOIN near ON near.code = pred")
def t29(spark, d):
    return T.focus(pairs(spark, d), T.near(closure(spark, d), nodes(spark, d)), "truth", "pred")


@query("o01_union_with_check", "SELECT count(*) AS n, count(DISTINCT k) AS keys, count(*) - count(DISTINCT k) AS overlap FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 50 = 0)")
def o01(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    both = c.where("k % 2 = 0").unionByName(c.where("k % 2 = 1 OR k % 50 = 0"))
    per = both.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") - 1).alias("overlap"))


@query("o02_differences", "SELECT 'left' AS side, c_mktsegment || c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT 'left', c_mktsegment || c_nationkey FROM customer WHERE c_custkey % 3 = 0 UNION (SELECT 'right', c_mktsegment || c_nationkey FROM customer WHERE c_custkey % 3 = 0 EXCEPT SELECT 'right', c_mktsegment || c_nationkey FROM customer WHERE c_custkey % 2 = 0)")
def o02(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.concat("c_mktsegment", "c_nationkey").alias("v"))
    a, b = c.where("c_custkey % 2 = 0").select("v"), c.where("c_custkey % 3 = 0").select("v")
    return a.subtract(b).select(F.lit("left").alias("side"), "v").union(b.subtract(a).select(F.lit("right"), "v"))


@query("o03_intersection", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09")
def o03(spark, d):
    li = read(spark, d, "lineitem")
    return li.where("l_quantity > 49").select(F.col("l_suppkey").alias("k")).intersect(li.where("l_discount > 0.09").select("l_suppkey"))


@query("o04_symmetric_difference", f"{W}, {_ALPHA}, {CUSTOMERS}, {PAIRS}, a AS (SELECT p.id, c.ancestor FROM pairs p JOIN clo c ON c.code = p.truth), b AS (SELECT p.id, c.ancestor FROM pairs p JOIN clo c ON c.code = p.pred) SELECT coalesce(a.id, b.id) AS id, round(sum(CASE WHEN a.id IS NULL OR b.id IS NULL THEN alpha ELSE 0 END), 6) AS weight FROM a FULL JOIN b ON a.id = b.id AND a.ancestor = b.ancestor JOIN alpha ON alpha.code = coalesce(a.ancestor, b.ancestor) GROUP BY 1")
def o04(spark, d):
    """Weight of the ancestors that truth and prediction do not share."""
    n, clo = nodes(spark, d), closure(spark, d)
    p, w = pairs(spark, d), T.path_weights(clo, n).withColumnRenamed("code", "ancestor")
    side = lambda c: p.select("id", F.col(c).alias("code")).join(clo, "code").select("id", "ancestor", F.lit(1).alias(c))
    both = side("truth").join(side("pred"), ["id", "ancestor"], "full").join(w, "ancestor")
    return both.groupBy("id").agg(F.round(F.sum(F.when(F.col("truth").isNull() | F.col("pred").isNull(), F.col("alpha")).otherwise(0.0)), 6).alias("weight"))
