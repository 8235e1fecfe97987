"""Scores of predicted against true codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_class(pairs: DataFrame) -> DataFrame:
    """(code, support, predicted, tp, precision, recall, f1) over the union of true and predicted codes."""
    rows = pairs.where("truth IS NOT NULL AND pred IS NOT NULL").select(F.explode(F.array(F.struct(F.col("truth").alias("code"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("code"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), (F.col("truth") == F.col("pred")).alias("hit"))
    s = rows.groupBy("x.code").agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.when(F.col("hit"), F.col("x.t")).otherwise(0)).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return s.select("code", "support", "predicted", "tp", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def overall(pairs: DataFrame) -> DataFrame:
    """One row: n, accuracy (micro F1), macro F1 over the union of labels."""
    c = per_class(pairs).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"))
    return c.select("n", "accuracy", F.when(F.col("n") < 2, F.col("accuracy")).otherwise(F.col("macro_f1")).alias("macro_f1"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.where("truth IS NOT NULL AND pred IS NOT NULL").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def on_path(truth: Column, pred: Column) -> Column:
    """Equal, or one dotted code is an ancestor of the other."""
    up = lambda a, b: F.startswith(a, F.concat(b, F.lit(".")))
    return (truth == pred) | up(truth, pred) | up(pred, truth)


def failure_mode(truth: Column, pred: Column, known: Column) -> Column:
    """Null if right; missing, hallucinated (no such code), parent, child, sibling (same first parts) or wrong_subtree."""
    head = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    up = lambda a, b: F.startswith(a, F.concat(b, F.lit(".")))
    return F.when(truth == pred, F.lit(None)).when(pred.isNull(), "missing").when(~known, "hallucinated").when(up(truth, pred), "parent").when(up(pred, truth), "child").when(head(truth) == head(pred), "sibling").otherwise("wrong_subtree")


def ancestry_mode(truth: Column, pred: Column) -> Column:
    up = lambda a, b: F.startswith(a, F.concat(b, F.lit(".")))
    root = lambda c: F.substring_index(c, ".", 1)
    return F.when(pred.isNull(), "dropped").when(up(truth, pred), "ancestor").when(up(pred, truth), "descendant").when(root(truth) == root(pred), "sibling_subtree").otherwise("cross_subtree")


def score(pairs: DataFrame, *by: str) -> DataFrame:
    """Counts and percentages by group: strict, on the path, each failure mode; rows without a truth cannot be scored."""
    t, p = F.col("truth"), F.col("pred")
    mode = failure_mode(t, p, F.coalesce(F.col("known"), F.lit(False)))
    modes = [F.count_if(t.isNotNull() & (mode == m)).alias(m) for m in ("hallucinated", "parent", "child", "sibling", "wrong_subtree")]
    scored = F.count_if(t.isNotNull() & p.isNotNull())
    return pairs.groupBy(*by).agg(
        scored.alias("scored"),
        F.count_if(t.isNull()).alias("unscorable"),
        F.count_if(t.isNotNull() & p.isNull()).alias("missing_in_run"),
        F.round(100 * F.try_divide(F.count_if(t == p), scored), 4).alias("strict_pct"),
        F.round(100 * F.try_divide(F.count_if(on_path(t, p)), scored), 4).alias("on_path_pct"),
        *modes,
    )


def grouped_errors(errors: DataFrame, group: list[str], example: str, keep: int = 5) -> DataFrame:
    """Groups of errors with a count and the first examples by name; each task keeps its own first ones."""
    r = Window.partitionBy(*group, "salt").orderBy(example)
    few = errors.withColumn("salt", F.pmod(F.xxhash64(example), F.lit(32))).withColumn("r", F.row_number().over(r)).where(F.col("r") <= keep)
    ex = few.groupBy(*group).agg(F.slice(F.array_sort(F.collect_list(example)), 1, keep).alias("examples"))
    return errors.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(ex, group)


def trend(scores: DataFrame, order: str, value: str) -> DataFrame:
    """scores with ``delta`` to the row before; one row for each iteration."""
    return scores.withColumn("delta", F.col(value) - F.lag(value).over(Window.orderBy(order)))


def calibration_error(rows: DataFrame, bins: int = 15, *by: str) -> DataFrame:
    """Expected calibration error of (conf, hit): equal bins, the last one closed."""
    b = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))
    per = rows.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf"), F.avg(F.col("hit").cast("double")).alias("acc"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def temperature(logits: DataFrame, grid: list[float]) -> DataFrame:
    """(t, nll, brier) of (row, code, z, hit) at each temperature of a grid; the grid is a handful of literal rows."""
    g = F.explode(F.array(*map(F.lit, grid))).alias("t")
    rows = logits.select("*", g).withColumn("s", F.col("z") / F.col("t"))
    by = Window.partitionBy("row", "t")
    top = F.max("s").over(by)
    rows = rows.withColumn("e", F.exp(F.col("s") - top)).withColumn("p", F.col("e") / F.sum("e").over(by))
    return rows.groupBy("t").agg((F.sum(F.when(F.col("hit"), -F.log("p"))) / F.count_if("hit")).alias("nll"), (F.sum(F.pow(F.col("p") - F.col("hit").cast("double"), 2)) / F.count_if("hit")).alias("brier"))


def softmax(rows: DataFrame, key: str, score: str, out: str = "p") -> DataFrame:
    by = Window.partitionBy(key)
    e = F.exp(F.col(score) - F.max(score).over(by))
    return rows.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(by)).drop("_e")


def path_product(rows: DataFrame, clo: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row, code, p) of (row, code, z): softmax among siblings, product along the path, scaled to 1."""
    z = rows.join(nodes.select("code", F.coalesce("parent_code", F.lit("")).alias("parent")), "code")
    by = Window.partitionBy("row", "parent")
    e = F.exp(F.col("z") - F.max("z").over(by))
    step = z.withColumn("e", e).withColumn("lp", F.log(F.col("e") / F.sum("e").over(by))).select("row", F.col("code").alias("ancestor"), "lp")
    joint = clo.join(step, "ancestor").groupBy("row", "code").agg(F.exp(F.sum("lp")).alias("p"))
    return joint.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("row")))


def depth_reweight(probs: DataFrame, alpha: float) -> DataFrame:
    """(row, code, p): p x alpha^depth, scaled to 1."""
    w = F.col("p") * F.pow(F.lit(alpha), F.size(F.split("code", r"\.")) - 1)
    return probs.withColumn("w", w).select("row", "code", (F.col("w") / F.sum("w").over(Window.partitionBy("row"))).alias("p"))


def two_arms(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """(entity, outcome) of two runs (entity, pred) against (entity, truth)."""
    j = truth.join(a.select("entity", F.col("pred").alias("pa")), "entity", "left").join(b.select("entity", F.col("pred").alias("pb")), "entity", "left")
    ra, rb = F.coalesce(F.col("pa") == F.col("truth"), F.lit(False)), F.coalesce(F.col("pb") == F.col("truth"), F.lit(False))
    none = F.col("pa").isNull() & F.col("pb").isNull()
    one = F.col("pa").isNull() | F.col("pb").isNull()
    outcome = F.when(none, "uncovered").when(ra & rb, "both_right").when(ra, "a_only").when(rb, "b_only").when(one, "one_covered").otherwise("both_wrong")
    return j.select("entity", outcome.alias("outcome"))


def subset_change(before: DataFrame, after: DataFrame, truth: DataFrame) -> DataFrame:
    """(change, n) of ranked lists (entity, code, rank): the reference's rank improved, regressed or stayed."""
    at = lambda df, n: truth.join(df.withColumnRenamed("code", "truth"), ["entity", "truth"], "left").select("entity", F.col("rank").alias(n))
    j = at(before, "old").join(at(after, "new"), "entity")
    old, new = F.coalesce("old", F.lit(1 << 30)), F.coalesce("new", F.lit(1 << 30))
    return j.groupBy(F.when(new < old, "improved").when(new > old, "regressed").otherwise("unchanged").alias("change")).agg(F.count(F.lit(1)).alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
