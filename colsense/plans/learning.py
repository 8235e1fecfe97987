"""Queries of classifiers (L), the projection (G12) and calibration over classes (E21-E25)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF
from pyspark.sql import Window
from pyspark.sql import functions as F

from colsense.operators import evaluate as E
from colsense.operators import ml
from colsense.operators import similarity as G
from colsense.sources.sinks import write_down

from . import query
from .analytics import _CENT, _E, vectors
from .inputs import CLOSURE, CUSTOMERS, NODES, closure, customers, nodes, read


def rnd(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def words(spark, d):
    """Labelled rows: the brands' parts by the words of their names, and numbers; many parts may stand in one small file."""
    p = ml.spread(read(spark, d, "part"), "p_partkey")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"), F.split(F.lower("p_name"), " ").alias("tokens"), F.array(F.col("p_brand")).alias("brand"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


def texts(spark, d):
    """Documents by language; words of up to the first 2,000 tokens would be a prefix, so all words count."""
    return read(spark, d, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.split(F.lower("text"), r"\s+").alias("tokens"))


@query("l01_l05_lexical")
def l01(spark, d):
    """Fitted to the documents whose id mod 5 is not 0; all are predicted."""
    rows = texts(spark, d)
    model = ml.fit_to_votes(ml.lexical(), rows.withColumn("label", F.when(F.col("id") % 5 > 0, F.col("label"))))
    return ml.predictions(model, rows).select("id", "label", "pred", "p")


@query("l01_calibrated_svm")
def l01b(spark, d):
    """Languages of all documents by machines fitted to those whose id mod 5 is not 0, with calibrated probabilities."""
    rows = ml.spread(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"), "id")
    model = ml.calibrated_svm(rows.where("id % 5 > 0"), "id")
    return model.probabilities(rows).select("id", "label", "pred", F.array_max("p").alias("p"))


@query("l02_reduced")
def l02(spark, d):
    rows = texts(spark, d)
    model = ml.fit_to_votes(ml.lexical(reduce_to=20), rows.withColumn("label", F.when(F.col("id") % 5 > 0, F.col("label"))))
    return ml.predictions(model, rows).select("id", "label", "pred", "p")


@query("l03_forest")
def l03(spark, d):
    rows = words(spark, d)
    model = ml.fit_to_votes(ml.forest(["tokens", "brand"], ["size", "price"]), rows)
    return ml.predictions(model, rows).select("id", "label", "pred", "p")


@query("l04_class_weights", "SELECT p_type AS label, count(*) AS n, round((SELECT count(*) FROM part) / ((SELECT count(DISTINCT p_type) FROM part) * count(*)), 6) AS weight FROM part GROUP BY 1")
def l04(spark, d):
    w = ml.class_weights(words(spark, d), "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"))
    return rnd(w, "weight")


@query("l06_ensemble_variance")
def l06(spark, d):
    return ml.ensemble_variance(ml.forest(["brand"], ["size", "price"]), words(spark, d), "id")


@query("l07_l13_train_save_score")
def l07(spark, d):
    """Fit, save to the shared folder, load, score and evaluate."""
    from pyspark.ml import PipelineModel

    from colsense.sources.sinks import shared_folder

    rows = texts(spark, d)
    path = f"{shared_folder(spark)}/model"
    ml.fit_to_votes(ml.lexical(1 << 12), rows.withColumn("label", F.when(F.col("id") % 5 > 0, F.col("label")))).write().save(path)
    scored = ml.predictions(PipelineModel.load(path), rows).where("id % 5 = 0")
    return E.overall(scored.select(F.col("label").alias("truth"), "pred"))


@query("l08_l09_importance")
def l08(spark, d):
    rows = words(spark, d)
    model = ml.fit_to_votes(ml.forest(["tokens", "brand"], ["size", "price"]), rows)
    return ml.permutation_importance(model, rows, "id", ["brand", "size", "price"], 1)


@query("l08_sage")
def l08b(spark, d):
    """Shapley values of the parts' features for the loss of the forest, over all parts."""
    rows = words(spark, d)
    model = ml.fit_to_votes(ml.forest(["tokens", "brand"], ["size", "price"]), rows)
    return ml.sage(model, rows, "id", ["tokens", "brand", "size", "price"])


@query("l09_row_attribution")
def l09(spark, d):
    """The three features with most effect on each part's predicted type."""
    rows = words(spark, d)
    model = ml.fit_to_votes(ml.forest(["tokens", "brand"], ["size", "price"]), rows)
    return ml.row_attribution(model, rows, "id", ["brand", "size", "price", "tokens"], 2)


@query("l10_top_coefficients")
def l10(spark, d):
    return ml.top_coefficients(ml.fit_to_votes(ml.lexical(1 << 12), texts(spark, d)))


@query("l11_ablation")
def l11(spark, d):
    """(arm, n, accuracy) of texts as they are and with their common endings cut off."""
    hashing, *rest = sorted(ml.lexical(1 << 12).getStages(), key=lambda s: not isinstance(s, HashingTF))
    out = None
    for arm, cut in (("full", ""), ("no_endings", r"(s|en|er|ed)\b")):
        t = F.lower("text") if not cut else F.regexp_replace(F.lower("text"), cut, "")
        rows = read(spark, d, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.split(t, r"\s+").alias("tokens"))
        rows = write_down(hashing.transform(rows).drop("tokens"))  # the texts are split and hashed once for all passes
        model = ml.fit_to_votes(Pipeline(stages=rest), rows.withColumn("label", F.when(F.col("id") % 5 > 0, F.col("label"))))
        part = ml.predictions(model, rows).where("id % 5 = 0").agg(F.lit(arm).alias("arm"), F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))
        out = part if out is None else out.union(part)
    return out


@query("l12_linear_attribution", f"WITH {_E} SELECT id, round(list_sum(list_transform(v[1:32], lambda x, i: (x - 0.01) * i / 64)), 6) AS phi_left, round(list_sum(list_transform(v[33:64], lambda x, i: (x - 0.01) * (i + 32) / 64)), 6) AS phi_right FROM e")
def l12(spark, d):
    w = [(k + 1) / 64 for k in range(64)]
    out = ml.linear_attribution(vectors(spark, d), "v", w, [0.01] * 64, {"left": (0, 32), "right": (32, 64)})
    return rnd(out.select("id", "phi_left", "phi_right"), "phi_left", "phi_right")


@query("g12_projection")
def g12(spark, d):
    from .scoring import iterations

    rows = iterations(spark, d).withColumn("id", F.concat_ws(".", "entity", "iteration"))
    return ml.projection(rows, ["gap", "k", "bel"], "id")


# Calibration over the classes of the embeddings.

_LOGITS = f"WITH {_E}, {_CENT}, z AS (SELECT e.id AS row, c.code, list_dot_product(e.v, c.v) * 8 AS z, e.code = c.code AS hit FROM e, cent c)"


def logits(spark, d):
    v = vectors(spark, d)
    s = G.to_categories(v, G.centroids(v)).withColumnRenamed("code", "c")
    return s.join(v.select("id", "code"), "id").select(F.col("id").alias("row"), F.col("c").alias("code"), (F.col("s") * 8).alias("z"), (F.col("c") == F.col("code")).alias("hit"))


@query("e21_temperature", f"{_LOGITS}, g AS (SELECT unnest([0.5, 1.0, 2.0]) AS t), s AS (SELECT row, t, hit, z / t - max(z / t) OVER (PARTITION BY row, t) AS s FROM z, g), p AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY row, t) AS p FROM s) SELECT CAST(t AS DOUBLE) AS t, round(sum(CASE WHEN hit THEN -ln(p) END) / count(*) FILTER (WHERE hit), 6) AS nll, round(sum(pow(p - CASE WHEN hit THEN 1 ELSE 0 END, 2)) / count(*) FILTER (WHERE hit), 6) AS brier FROM p GROUP BY 1")
def e21(spark, d):
    return rnd(E.temperature(logits(spark, d), [0.5, 1.0, 2.0]), "nll", "brier")


_TREE = "zz AS (SELECT entity AS row, n.code, ((entity * 3 + length(n.code) * 5 + ascii(right(n.code, 1))) % 11) / 5.0::DOUBLE AS z FROM cust JOIN nodes n ON split_part(n.code, '.', 1) = cust.top AND (len(string_split(n.code, '.')) < 3 OR n.parent_code = cust.mid))"


def tree_logits(spark, d):
    n = nodes(spark, d).select("code", "parent_code", F.substring_index("code", ".", 1).alias("top"), F.size(F.split("code", r"\.")).alias("k"))
    j = customers(spark, d).select("entity", "top", "mid").join(F.broadcast(n), "top").where((F.col("k") < 3) | (F.col("parent_code") == F.col("mid")))
    z = ((F.col("entity") * 3 + F.length("code") * 5 + F.ascii(F.right("code", F.lit(1)))) % 11) / 5.0
    return j.select(F.col("entity").alias("row"), "code", z.alias("z"))


_PATH = f"WITH {NODES}, {CLOSURE}, {CUSTOMERS}, {_TREE}, sm AS (SELECT row, code, ln(exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY row, par)) AS lp FROM (SELECT zz.*, coalesce(parent_code, '') AS par, max(z) OVER (PARTITION BY row, coalesce(parent_code, '')) AS m FROM zz JOIN nodes USING (code))), jp AS (SELECT s.row, c.code, exp(sum(lp)) AS p FROM clo c JOIN sm s ON s.code = c.ancestor WHERE EXISTS (SELECT 1 FROM zz WHERE zz.row = s.row AND zz.code = c.code) GROUP BY 1, 2), pp AS (SELECT row, code, p / sum(p) OVER (PARTITION BY row) AS p FROM jp)"


def path_probs(spark, d):
    z = tree_logits(spark, d)
    joint = E.path_product(z, closure(spark, d), nodes(spark, d))
    own = joint.join(z.select("row", "code"), ["row", "code"], "left_semi")
    return own.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("row")))


@query("e23_path_product", f"{_PATH} SELECT row, code, round(p, 6) AS p FROM pp")
def e23(spark, d):
    return rnd(path_probs(spark, d), "p")


@query("e24_leakage", f"{_PATH}, b AS (SELECT row, arg_max(code, struct_pack(p := round(p, 9), r := -r)) AS code FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY code) AS r FROM pp) GROUP BY 1) SELECT b.row, round(1 - sum(pp.p), 6) AS leakage FROM b JOIN clo ON clo.code = b.code JOIN pp ON pp.row = b.row AND pp.code = clo.ancestor GROUP BY 1")
def e24(spark, d):
    p = path_probs(spark, d)
    order = Window.partitionBy("row").orderBy(F.round("p", 9).desc(), "code")
    best = p.withColumn("r", F.row_number().over(order)).where("r = 1").select("row", "code")
    on = best.join(closure(spark, d), "code").select("row", F.col("ancestor").alias("code")).join(p, ["row", "code"])
    return on.groupBy("row").agg(F.round(1 - F.sum("p"), 6).alias("leakage"))


@query("e25_depth_reweight", f"{_PATH}, w AS (SELECT row, code, p * pow(0.5, len(string_split(code, '.')) - 1) AS w FROM pp) SELECT row, code, round(w / sum(w) OVER (PARTITION BY row), 6) AS p FROM w")
def e25(spark, d):
    return rnd(E.depth_reweight(path_probs(spark, d), 0.5), "p")
