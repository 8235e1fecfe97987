"""Queries of sampling (M), similarity (G) and splits (K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colsense.operators import sampling as M
from colsense.operators import similarity as G
from colsense.operators import splits as K

from . import query
from .inputs import CELLS, CUSTOMERS, NODES, PAIRS, cells, customers, nodes, pairs, read

PW = f"WITH {CUSTOMERS}, {PAIRS}"


def rnd(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Sampling.


@query("m01_sliding", "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey, c_nationkey FROM r WHERE (i - 15 % n + n) % n < 5")
def m01(spark, d):
    return M.sliding(read(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", 5, 3)


@query("m02_m04_random", "SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('0:' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 5")
def m02(spark, d):
    return M.random_k(read(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", 5)


@query("m03_stratified_rows", "WITH t AS (SELECT p_brand, p_partkey, p_name, ntile(3) OVER (PARTITION BY p_brand ORDER BY length(p_name), p_partkey) AS third FROM part), n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY p_brand, third ORDER BY p_partkey) - 1 AS o FROM t WINDOW w AS (PARTITION BY p_brand, third)), i AS (SELECT *, ((o - 2) % n + n) % n AS i FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY i, third) AS r FROM i) SELECT p_brand, p_partkey, p_name, third FROM r WHERE r <= 6")
def m03(spark, d):
    return M.stratified_rows(read(spark, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], "p_name", "p_partkey", 6, 1)


@query("m03_rarest_rows")
def m03b(spark, d):
    """Ten words with a digit or @ of each source's documents, by the rarity of the patterns that they fit."""
    from .inputs import token_cells

    words = token_cells(spark, d).select("column", F.col("row_ix").alias("doc_id"), "value").distinct()
    words = words.withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), "value"))
    return M.rarest_rows(words, ["column"], "value", "id", 10, 1).select("column", "doc_id", "value", "third", "place")


_STRATA = "strata AS (SELECT CASE WHEN conf > 0.3 THEN split_part(pred, '.', 1) || '.' || split_part(pred, '.', 2) ELSE 'UNRESOLVED' END AS code, count(*) AS size, avg(conf) AS mean_conf FROM pairs GROUP BY 1)"


def strata(spark, d):
    p = pairs(spark, d)
    code = F.when(F.col("conf") > 0.3, F.substring_index("pred", ".", 2)).otherwise("UNRESOLVED")
    return p.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("size"), F.avg("conf").alias("mean_conf"))


@query("m05_m06_strata", f"{PW}, {_STRATA} SELECT code, size, round(mean_conf, 6) AS mean_conf, size < 40 AS rare FROM strata")
def m06(spark, d):
    return rnd(strata(spark, d).withColumn("rare", F.col("size") < 40), "mean_conf")


@query("m07_plan", f"{PW}, {_STRATA}, s AS (SELECT code, size, code = 'UNRESOLVED' OR size < 40 AS rare FROM strata), t AS (SELECT *, sum(CASE WHEN NOT rare THEN size ELSE 0 END) OVER () AS rest, 500 - sum(CASE WHEN rare THEN size ELSE 0 END) OVER () AS lft FROM s) SELECT code, size, rare, CAST(least(size, CASE WHEN rare THEN size ELSE greatest(4, floor(greatest(lft, 0) * size / greatest(rest, 1))) END) AS BIGINT) AS take FROM t")
def m07(spark, d):
    s = strata(spark, d).select("code", "size", ((F.col("code") == "UNRESOLVED") | (F.col("size") < 40)).alias("rare"))
    return M.plan(s, 1_000_000, 0.5, 4).withColumn("take", F.col("take").cast("long"))


@query("m08_split", "SELECT source, least(greatest(1, round(n * 0.2)), n - 1)::BIGINT AS test, n - least(greatest(1, round(n * 0.2)), n - 1)::BIGINT AS train FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def m08(spark, d):
    """Sizes of the sides by class; which rows they are is decided by Spark's hash."""
    s = M.split(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")
    return s.groupBy("source").agg(F.count_if(F.expr("side = 'test'")).alias("test"), F.count_if(F.expr("side = 'train'")).alias("train"))


@query("m09_folds", "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 5 AS fold FROM customer")
def m09(spark, d):
    return M.folds(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 5).select("c_custkey", "fold")


@query("m10_top_classes", "WITH b AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5), r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part WHERE p_brand IN (SELECT p_brand FROM b)) SELECT p_brand, p_partkey FROM r WHERE r <= 4")
def m10(spark, d):
    return M.top_classes(read(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 5, 4)


@query("m11_diverse")
def m11(spark, d):
    """Vectors of each label accepted in order unless near one accepted before."""
    e = read(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return M.diverse(e, "label", "vec_id", "v", 0.5)


@query("m11_accepted")
def m11b(spark, d):
    """Vectors of each label accepted until the stop rules end the walk."""
    return M.accept(read(spark, d, "embeddings"), "label", "vec_id", "embedding", target=60, limit=0.2, coverage=False)


@query("m11_saturated")
def m11c(spark, d):
    """The same with the rule that ends it once the accepted vectors cover their neighbourhood."""
    return M.accept(read(spark, d, "embeddings"), "label", "vec_id", "embedding", target=60)


@query("m12_stability", "WITH c AS (SELECT user_id AS entity, event_type, count(*) AS c FROM events GROUP BY 1, 2) SELECT entity, CAST(sum(c) AS BIGINT) AS n, round(CASE WHEN sum(c) < 2 THEN 1 ELSE max(c) / sum(c) END, 6) AS stability FROM c GROUP BY 1")
def m12(spark, d):
    return rnd(M.stability(read(spark, d, "events").withColumnRenamed("user_id", "entity"), "entity", "event_type"), "stability")


@query("m14_distribution", "WITH p AS (SELECT o_custkey AS entity, o_orderpriority AS code, count(*) / sum(count(*)) OVER (PARTITION BY o_custkey) AS p FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(p, 12) DESC, code) AS r FROM p) SELECT entity, code, round(p, 6) AS p, r FROM r WHERE r <= 4")
def m14(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    o = o.select("entity", "code", (F.col("n") / F.sum("n").over(Window.partitionBy("entity"))).alias("p"))
    return rnd(M.distribution(o, "entity", "code", "p"), "p")


@query("m15_top_picks", "SELECT p_brand AS code, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM part), 6) AS pct FROM part GROUP BY 1 ORDER BY n DESC, code LIMIT 10")
def m15(spark, d):
    """The limit is the report's own."""
    p = read(spark, d, "part").groupBy(F.col("p_brand").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    p = p.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
    return p.orderBy(F.col("n").desc(), "code").limit(10)


@query("m16_shard", f"WITH {CELLS}, s AS (SELECT DISTINCT \"table\", \"column\", ord FROM cells), n AS (SELECT *, row_number() OVER (ORDER BY \"table\", ord) - 1 AS n FROM s) SELECT \"table\", \"column\", n FROM n WHERE n % 4 = 1")
def m16(spark, d):
    return M.shard(cells(spark, d).select("table", "column", "ord").distinct(), 1, 4).select("table", "column", "n")


@query("m17_top_up", "WITH h AS (SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 10 = 0 GROUP BY 1), q AS (SELECT p_brand, count(*) AS q FROM part WHERE p_partkey % 10 > 0 GROUP BY 1) SELECT p_brand, least(greatest(12 - n, 0), coalesce(q, 0)) AS drawn FROM h LEFT JOIN q USING (p_brand) WHERE n < 12 AND q > 0")
def m17(spark, d):
    """How many rows each class draws; which ones is decided by Spark's hash."""
    p = read(spark, d, "part").select("p_brand", "p_partkey")
    return M.top_up(p.where("p_partkey % 10 = 0"), p.where("p_partkey % 10 > 0"), "p_brand", "p_partkey", 12).groupBy("p_brand").agg(F.count(F.lit(1)).alias("drawn"))


# Similarity: embeddings are entities, their labels classes.


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("code"), F.col("embedding").cast("array<double>").alias("v"))


_E = "e AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS code, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_SUMS = "long AS (SELECT code, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), sums AS (SELECT code, i, sum(x) AS x, count(*) AS n FROM long GROUP BY 1, 2)"
_CENT = f"{_SUMS}, norms AS (SELECT code, sqrt(sum(x * x)) AS norm FROM sums GROUP BY 1), cent AS (SELECT code, list(x / norm ORDER BY i) AS v FROM sums JOIN norms USING (code) GROUP BY 1)"


@query("g01_cosine", f"WITH {_E}, {_CENT} SELECT e.id, c.code, round(list_dot_product(e.v, c.v), 6) AS s FROM e, cent c")
def g01(spark, d):
    """Every vector against the centroid of every class: classes are few, so the product is linear in the vectors."""
    v = vectors(spark, d)
    return rnd(G.to_categories(v, G.centroids(v)), "s")


@query("g02_late_interaction", f"WITH {_E}, {_CENT}, qt AS (SELECT id, k, v[8 * k + 1:8 * k + 8] AS t FROM e, range(8) r(k)), dt AS (SELECT code, v[8 * k + 1:8 * k + 8] AS t FROM cent, range(8) r(k)), m AS (SELECT id, code, k, max(list_dot_product(qt.t, dt.t)) AS m FROM qt, dt GROUP BY 1, 2, 3) SELECT id, code, round(avg(m), 6) AS s FROM m GROUP BY 1, 2")
def g02(spark, d):
    """Eight tokens of eight places for each vector."""
    v = vectors(spark, d)
    tokens = lambda df: df.withColumn("tokens", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", 8 * k + 1, F.lit(8))))
    return rnd(G.late_interaction(tokens(v), tokens(G.centroids(v))), "s")


@query("g03_g14_attribution", f"WITH {_E}, {_CENT}, s AS (SELECT e.id, e.code AS truth, c.code, list_dot_product(e.v, c.v) AS s FROM e, cent c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, code) AS r FROM s) SELECT truth, code AS pred, count(*) AS n FROM r WHERE r = 1 GROUP BY 1, 2")
def g03(spark, d):
    v = vectors(spark, d)
    top = G.best_k(G.to_categories(v, G.centroids(v)), 1).select("id", F.col("code").alias("pred"))
    return top.join(v.select("id", F.col("code").alias("truth")), "id").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("g04_propagate", f"WITH {_E}, lab AS (SELECT id, code, 0.5 + (id % 5) / 10.0 AS c, v FROM e WHERE id % 10 = 0), s AS (SELECT e.id, lab.id AS by_id, lab.code, c, list_dot_product(e.v, lab.v) AS s FROM e, lab WHERE e.id % 10 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, by_id) AS r FROM s) SELECT id, code, round(c * 0.7, 6) AS confidence FROM r WHERE r = 1 AND round(s, 9) >= 0.3")
def g04(spark, d):
    v = vectors(spark, d)
    lab = v.where("id % 10 = 0").withColumn("confidence", 0.5 + (F.col("id") % 5) / 10.0)
    return rnd(G.propagate(v.where("id % 10 > 0"), lab, 0.3), "confidence")


@query("g05_neighbours", f"WITH {_E}, q AS (SELECT * FROM e WHERE id % 20 = 0), s AS (SELECT q.id, e.id AS other, list_dot_product(q.v, e.v) AS s FROM q, e WHERE q.id <> e.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, other) AS r FROM s) SELECT id, other, r FROM r WHERE r <= 5")
def g05(spark, d):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    v = vectors(spark, d)
    return G.neighbours(v.where("id % 20 = 0"), v, 5)


@query("g06_centroids", f"WITH {_E}, {_CENT} SELECT code, round(v[1], 6) AS first, round(v[64], 6) AS last, (SELECT max(n) FROM sums s WHERE s.code = cent.code) AS n FROM cent")
def g06(spark, d):
    c = G.centroids(vectors(spark, d))
    return c.select("code", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"), "n")


@query("g07_cohesion", f"WITH {_E}, {_SUMS} SELECT code, max(n) AS n, round((sum(x * x) - max(n)) / (max(n) * (max(n) - 1)), 6) AS cohesion FROM sums GROUP BY 1")
def g07(spark, d):
    return rnd(G.cohesion(vectors(spark, d)), "cohesion")


@query("g08_nearest_centroids", f"WITH {_E}, {_CENT}, s AS (SELECT a.code, b.code AS other, list_dot_product(a.v, b.v) AS s FROM cent a, cent b WHERE a.code <> b.code), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(s, 9) DESC, other) AS r FROM s) SELECT code, other, round(s, 6) AS s, r FROM r WHERE r <= 5")
def g08(spark, d):
    return rnd(G.nearest_centroids(G.centroids(vectors(spark, d))), "s")


@query("g09_fidelity", f"WITH {_E}, {_CENT}, s AS (SELECT a.code, 1 - max(list_dot_product(a.v, b.v)) AS separability FROM cent a, cent b WHERE a.code <> b.code GROUP BY 1), f AS (SELECT e.code, avg(1 - list_dot_product(e.v, c.v)) AS fidelity FROM e JOIN cent c USING (code) GROUP BY 1) SELECT code, round(fidelity, 6) AS fidelity, round(separability, 6) AS separability, round(100.0 * (rank() OVER (ORDER BY round(fidelity, 9)) - 1) / count(*) OVER (), 6) AS percentile, CASE WHEN fidelity > 0.9 THEN 'rewrite' WHEN separability < 0.5 THEN 'separate' ELSE 'keep' END AS action FROM f JOIN s USING (code)")
def g09(spark, d):
    v = vectors(spark, d)
    c = G.centroids(v)
    sep = G.nearest_centroids(c, 1).select("code", (1 - F.col("s")).alias("separability"))
    fid = v.join(F.broadcast(c.select("code", F.col("v").alias("c"))), "code").groupBy("code").agg(F.avg(1 - G.dot(F.col("v"), F.col("c"))).alias("fidelity"))
    r = fid.join(sep, "code")
    w = Window.orderBy(F.round("fidelity", 9))
    r = r.withColumn("percentile", 100.0 * (F.rank().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy()))
    action = F.when(F.col("fidelity") > 0.9, "rewrite").when(F.col("separability") < 0.5, "separate").otherwise("keep")
    return rnd(r.withColumn("action", action), "fidelity", "separability", "percentile")


@query("g10_token_jaccard", "WITH t AS (SELECT p_brand AS code, list_distinct(flatten(list(string_split(p_name, ' ')))) AS a, list_distinct(flatten(list(string_split(p_name, ' ')) FILTER (WHERE p_partkey % 2 = 0))) AS b FROM part GROUP BY 1) SELECT code, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM t")
def g10(spark, d):
    """Words of all names of a brand against those of its even parts; words are a small vocabulary."""
    w = read(spark, d, "part").select(F.col("p_brand").alias("code"), "p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    sets = w.groupBy("code").agg(F.collect_set("w").alias("a"), F.collect_set(F.when(F.col("p_partkey") % 2 == 0, F.col("w"))).alias("b"))
    return sets.select("code", F.round(G.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("g11_divergence", "WITH p AS (SELECT o_orderpriority AS code, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), q AS (SELECT o_orderpriority AS code, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_totalprice > 250000 GROUP BY 1), j AS (SELECT coalesce(p.p, 0) AS a, coalesce(q.p, 0) AS b FROM p FULL JOIN q USING (code)) SELECT round(sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2, 9) AS divergence FROM j")
def g11(spark, d):
    def dist(df):
        c = df.groupBy(F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).alias("n"))
        return c.select("code", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))

    o = read(spark, d, "orders")
    return rnd(G.js_divergence(dist(o.where("o_orderstatus = 'F'")), dist(o.where("o_totalprice > 250000"))), "divergence", digits=9)


_UNIT = lambda c, a: f"CAST('0x' || substr(sha256({c}), {a}, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("g13_layout", f"SELECT vec_id AS id, 10 * cos({_UNIT('CAST(label AS VARCHAR)', 1)} * 6.283185307179586::DOUBLE) + {_UNIT('CAST(vec_id AS VARCHAR)', 1)} - 0.5 AS x, 10 * sin({_UNIT('CAST(label AS VARCHAR)', 1)} * 6.283185307179586::DOUBLE) + {_UNIT('CAST(vec_id AS VARCHAR)', 9)} - 0.5 AS y FROM embeddings")
def g13(spark, d):
    return G.layout(vectors(spark, d))


@query("g15_rank_distribution", f"WITH {_E}, {_CENT}, s AS (SELECT e.id, e.code AS truth, c.code, list_dot_product(e.v, c.v) AS s FROM e, cent c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, code) AS r FROM s) SELECT CASE WHEN r = 1 THEN '1' WHEN r <= 3 THEN '2-3' WHEN r <= 5 THEN '4-5' ELSE '6+' END AS bucket, count(*) AS n FROM r WHERE code = truth GROUP BY 1")
def g15(spark, d):
    v = vectors(spark, d)
    r = G.best_k(G.to_categories(v, G.centroids(v)), 25).join(v.select("id", F.col("code").alias("truth")), "id").where("code = truth")
    b = F.when(F.col("r") == 1, "1").when(F.col("r") <= 3, "2-3").when(F.col("r") <= 5, "4-5").otherwise("6+")
    return r.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("g16_attraction", f"WITH {NODES}, {CUSTOMERS}, {PAIRS}, top AS (SELECT code FROM nodes WHERE len(string_split(code, '.')) = 2) SELECT code, count(*) FILTER (WHERE pred LIKE code || '.%' AND truth LIKE code || '.%') AS correct, count(*) FILTER (WHERE pred LIKE code || '.%' AND NOT truth LIKE code || '.%') AS over_attracted, count(*) FILTER (WHERE truth LIKE code || '.%' AND NOT pred LIKE code || '.%') AS under_attracted FROM top JOIN pairs ON pred LIKE code || '.%' OR truth LIKE code || '.%' GROUP BY 1")
def g16(spark, d):
    """Codes at the second level; each row is joined to its own two nodes, not to all."""
    p = pairs(spark, d)
    sub = lambda c: F.when(F.size(F.split(c, r"\.")) > 2, F.substring_index(c, ".", 2))
    rows = p.select(sub("truth").alias("t"), sub("pred").alias("p")).select(F.explode(F.array_distinct(F.array("t", "p"))).alias("code"), "t", "p").where("code IS NOT NULL")
    own, got = F.col("t").eqNullSafe(F.col("code")), F.col("p").eqNullSafe(F.col("code"))
    return rows.groupBy("code").agg(F.count_if(own & got).alias("correct"), F.count_if(~own & got).alias("over_attracted"), F.count_if(own & ~got).alias("under_attracted"))


@query("g17_rescue", f"WITH {_E}, {_CENT}, s AS (SELECT e.id, e.code AS truth, c.code, list_dot_product(e.v, c.v) AS s FROM e, cent c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, code) AS r FROM s), t AS (SELECT truth, id, min(CASE WHEN code = truth THEN r END) AS pos FROM r GROUP BY 1, 2) SELECT truth, count(*) AS n, round(avg(CASE WHEN pos <= 1 THEN 1 ELSE 0 END), 6) AS at1, round(avg(CASE WHEN pos <= 3 THEN 1 ELSE 0 END), 6) AS at3, round(avg(CASE WHEN pos <= 5 THEN 1 ELSE 0 END), 6) AS at5 FROM t GROUP BY 1")
def g17(spark, d):
    v = vectors(spark, d)
    r = G.best_k(G.to_categories(v, G.centroids(v)), 25).join(v.select("id", F.col("code").alias("truth")), "id").where("code = truth")
    return r.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((F.col("r") <= k).cast("double")), 6).alias(f"at{k}") for k in (1, 3, 5)])


@query("g18_shapes", f"WITH {CELLS} SELECT \"table\", \"column\", round(sum(length(regexp_replace(value, '[^0-9]', '', 'g'))) / sum(length(value)), 6) AS digit, round(sum(length(regexp_replace(value, '[^A-Z]', '', 'g'))) / sum(length(value)), 6) AS upper, round(sum(length(regexp_replace(value, '[^a-z]', '', 'g'))) / sum(length(value)), 6) AS lower, round(sum(length(regexp_replace(value, '[^ ]', '', 'g'))) / sum(length(value)), 6) AS space, round(sum(length(regexp_replace(value, '[A-Za-z0-9 ]', '', 'g'))) / sum(length(value)), 6) AS symbol, round(sum(length(value)) / count(value), 6) AS length FROM cells GROUP BY 1, 2")
def g18(spark, d):
    return rnd(G.shape_signature(cells(spark, d), "table", "column"), "digit", "upper", "lower", "space", "symbol", "length")


# Splits: nations are collections, customers rows, segments labels.


@query("k02_coverage_gaps", "WITH s AS (SELECT c_mktsegment AS genus, CASE WHEN c_custkey % 2 = 0 OR c_mktsegment < 'C' THEN 'train' ELSE 'test' END AS side FROM customer) SELECT genus, CASE WHEN count(*) FILTER (WHERE side = 'test') = 0 THEN 'test' ELSE 'train' END AS missing FROM s GROUP BY 1 HAVING count(DISTINCT side) < 2")
def k02(spark, d):
    side = F.when((F.col("c_custkey") % 2 == 0) | (F.col("c_mktsegment") < "C"), "train").otherwise("test")
    return K.coverage_gaps(read(spark, d, "customer").select(F.col("c_mktsegment").alias("genus"), side.alias("side")), "genus", ["train", "test"])


@query("k03_even_odd", f"WITH {CELLS}, s AS (SELECT DISTINCT \"table\", \"column\" FROM cells), n AS (SELECT *, count(*) OVER (PARTITION BY \"table\") AS n, row_number() OVER (PARTITION BY \"table\" ORDER BY \"column\") AS r FROM s), o AS (SELECT \"table\", \"column\", r FROM n WHERE n > 1 UNION ALL SELECT \"table\", \"column\", row_number() OVER (ORDER BY \"table\") FROM n WHERE n = 1) SELECT \"table\", \"column\", CASE WHEN r % 2 = 1 THEN 'support' ELSE 'holdout' END AS side FROM o")
def k03(spark, d):
    return K.even_odd(cells(spark, d).select("table", "column").distinct())


@query("k04_whole_collections", "SELECT c_custkey, CASE WHEN c_nationkey IN (3, 7, 11) THEN 'holdout' ELSE 'support' END AS side FROM customer")
def k04(spark, d):
    n = read(spark, d, "nation").where("n_nationkey IN (3, 7, 11)").select(F.col("n_nationkey").alias("c_nationkey"))
    return K.whole_collections(read(spark, d, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey").select("c_custkey", "side")


_FLOOR = "sp AS (SELECT *, CASE WHEN n = 1 OR r <= least(3, n - 1) THEN 'support' ELSE 'holdout' END AS side FROM (SELECT c_custkey, c_nationkey || c_mktsegment AS label, count(*) OVER w AS n, row_number() OVER (PARTITION BY c_nationkey || c_mktsegment ORDER BY c_custkey) AS r FROM customer WINDOW w AS (PARTITION BY c_nationkey || c_mktsegment)))"


def floored(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.concat("c_nationkey", "c_mktsegment").alias("label"))
    return K.with_floor(c, "label", "c_custkey", 3)


@query("k05_floor_split", f"WITH {_FLOOR} SELECT c_custkey, label, side FROM sp")
def k05(spark, d):
    return floored(spark, d)


@query("k07_k08_deficits", f"WITH {_FLOOR}, c AS (SELECT label, count(*) FILTER (WHERE side = 'support') AS support, count(*) FILTER (WHERE side = 'holdout') AS holdout FROM sp GROUP BY 1), t AS (SELECT *, sum(support + holdout) OVER () AS al, sum(holdout) OVER () AS h FROM c) SELECT label, support, holdout, CAST(greatest(ceil((support + holdout) * h / al) - holdout, 0) AS BIGINT) AS deficit FROM t")
def k07(spark, d):
    return K.deficits(floored(spark, d), "label").select("label", "support", "holdout", F.col("deficit").cast("long").alias("deficit"))


@query("k01_balanced")
def k01(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("collection"), F.col("c_mktsegment").alias("genus"))
    return K.balanced(c.withColumn("collection", F.col("collection").cast("string")), "collection", "genus")


@query("k01_quota_split")
def k01b(spark, d):
    """Orders as collections, the brands of their parts as genera."""
    return K.balanced(sold(spark, d), "collection", "genus")


@query("k06_held_tables")
def k06(spark, d):
    """A customer's orders are a table, their priorities its labels."""
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("tbl"), F.col("o_orderpriority").alias("label"))
    return K.held_tables(o, "tbl", "label")


def sold(spark, d):
    """(collection, genus): orders and the brands of their parts, by order line."""
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("genus"))
    return read(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").cast("string").alias("collection")).join(part, "l_partkey").select("collection", "genus")


@query("k09_k10_cover")
def k09(spark, d):
    """Orders that cover the brands, five of them at least, within a budget of half of the order lines."""
    li = sold(spark, d)
    return K.cover(li, "collection", "genus", li.count() // 2, 5)


@query("k10_disjoint_cover")
def k10(spark, d):
    """The brands of the orders chosen before, covered again by other orders."""
    li = sold(spark, d)
    n = li.count()
    first = K.cover(li, "collection", "genus", n // 4).select("collection")
    required = [r[0] for r in li.join(first, "collection", "left_semi").select("genus").distinct().orderBy("genus").collect()]  # a taxonomy's
    return K.cover(li, "collection", "genus", n // 2, required=required, without=first)


@query("k12_exemplars", "WITH v AS (SELECT DISTINCT p_brand AS label, p_name AS value FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY value) AS r FROM v) SELECT label, string_agg(value, '|' ORDER BY value) AS vals FROM r WHERE r <= 6 GROUP BY 1")
def k12(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("label"), F.col("p_name").alias("value"))
    return K.exemplars(p, "label", 6).select("label", F.array_join("values", "|").alias("vals"))


@query("k13_footprint", f"WITH {NODES}, m AS (SELECT upper(left(label, 6)) AS given, min(code) AS code FROM nodes GROUP BY 1 HAVING count(*) = 1), c AS (SELECT c_custkey AS col, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey % 5 AS VARCHAR) ELSE upper(left(r_name, 6)) END AS given FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT col AS \"column\", coalesce(n.code, m.code) AS code, CASE WHEN n.code IS NOT NULL THEN 'code' ELSE 'mnemonic' END AS how FROM c LEFT JOIN nodes n ON n.code = c.given LEFT JOIN m USING (given) WHERE coalesce(n.code, m.code) IS NOT NULL")
def k13(spark, d):
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    given = F.when(F.col("c_custkey") % 2 == 0, (F.col("c_nationkey") % 5).cast("string")).otherwise(F.upper(F.substring("r_name", 1, 6)))
    return K.labelled_footprint(j.select(F.col("c_custkey").alias("column"), given.alias("given")), nodes(spark, d))


@query("k14_columns")
def k14b(spark, d):
    """Two columns of 20 values for every segment of a nation, near the balances of its customers, and for every region and nation by the words of their kind."""
    from colsense.operators import synthesis

    n = nodes(spark, d)
    kind = F.when(F.col("parent_code").isNull(), "region").when(~F.col("parent_code").contains("."), "nation")
    n = n.withColumn("aliases", F.array_compact(F.array(F.element_at("aliases", 1), kind)))
    c = customers(spark, d).select("entity", F.col("leaf").alias("code")).join(read(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").cast("string").alias("value")), "entity")
    return synthesis.columns(n.select("code", "label", "mnemonic", "aliases"), c.select("code", "value"), copies=2, rows=20)


@query("k14_k15_synthetic")
def k14(spark, d):
    """As many rows as there are parts, for templates taken from the part types."""
    p = read(spark, d, "part")
    t = p.groupBy(F.col("p_type").alias("code")).agg(F.when(F.max("p_size") % 2 == 0, F.round(F.avg("p_retailprice"), 2)).alias("base"), F.min("p_name").alias("prefix"))
    return K.synthetic(spark, t, p.count(), 7)


@query("k16_generator_coverage", "WITH n AS (SELECT DISTINCT p_brand AS code FROM part), g AS (SELECT p_brand AS code, count(DISTINCT CASE WHEN p_size > 25 THEN 'template' ELSE 'custom' END) AS kinds, min(CASE WHEN p_size > 25 THEN 'template' ELSE 'custom' END) AS k, max(p_size) / 100.0 AS dv FROM part WHERE p_partkey % 7 = 0 GROUP BY 1) SELECT n.code, CASE WHEN g.code IS NULL THEN 'missing' WHEN kinds = 1 AND k = 'template' THEN 'template_only' WHEN dv < 0.3 THEN 'low_diversity' ELSE 'covered' END AS gap FROM n LEFT JOIN g USING (code)")
def k16(spark, d):
    p = read(spark, d, "part")
    g = p.where("p_partkey % 7 = 0").select(F.col("p_brand").alias("code"), F.when(F.col("p_size") > 25, "template").otherwise("custom").alias("kind"), (F.col("p_size") / 100.0).alias("diversity"))
    return K.generator_coverage(p.select(F.col("p_brand").alias("code")).distinct(), g)


@query("k17_diversity", "WITH c AS (SELECT p_brand AS code, p_name AS v, count(*) AS c FROM part GROUP BY 1, 2) SELECT code, CAST(sum(c) AS BIGINT) AS n, round(count(*) / sum(c), 6) AS distinct_ratio, round(max(c) / sum(c), 6) AS top_share, round(sum(length(v) * c) / sum(c), 6) AS mean_length FROM c GROUP BY 1")
def k17(spark, d):
    return rnd(K.diversity(read(spark, d, "part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("value"))), "distinct_ratio", "top_share", "mean_length")


@query("k18_drop_singletons", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)")
def k18(spark, d):
    return K.drop_singletons(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey")


@query("k19_refinement_targets", f"{PW}, s AS (SELECT truth AS code, count(*) AS n, avg(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS accuracy FROM pairs GROUP BY 1), q AS (SELECT * FROM s WHERE NOT code LIKE '%.AUTOMOBILE' AND NOT code LIKE '0.%') SELECT code, n, round(accuracy, 6) AS accuracy FROM q WHERE n >= (SELECT CASE WHEN count(*) FILTER (WHERE n >= 5) >= 10 THEN 5 ELSE 2 END FROM q) ORDER BY round(accuracy, 9), n DESC, code LIMIT 10")
def k19(spark, d):
    """The worst ten; two kinds of classes are abandoned or cooling down."""
    p = pairs(spark, d)
    s = p.groupBy(F.col("truth").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))
    counters = customers(spark, d).select(F.col("leaf").alias("code")).distinct().select("code", F.endswith("code", F.lit(".AUTOMOBILE")).alias("abandoned"), F.when(F.startswith("code", F.lit("0.")), 2).otherwise(0).alias("cooldown"))
    return rnd(K.refinement_targets(s, counters), "accuracy")


@query("k20_payload_transform", "SELECT p_brand AS code, string_agg(DISTINCT lower(p_type), ',' ORDER BY lower(p_type)) AS hints, left(sha256(p_brand || ':' || string_agg(DISTINCT lower(p_type), ',' ORDER BY lower(p_type))), 16) AS manifest_id FROM part GROUP BY 1")
def k20(spark, d):
    """Aliases folded into the hints without repeats, with an id by hash; types are a fixed handful."""
    p = read(spark, d, "part").groupBy(F.col("p_brand").alias("code")).agg(F.collect_set(F.lower("p_type")).alias("hints"), F.collect_set(F.lower("p_type")).alias("aliases"))
    h = F.array_join(F.array_sort(F.array_union("hints", "aliases")), ",")
    return p.select("code", h.alias("hints"), F.left(F.sha2(F.concat_ws(":", "code", h), 256), F.lit(16)).alias("manifest_id"))
