"""Samples and top lists.

Draws are by hash, so they are the same on each run and need no state. Where only
the first k rows of a group are wanted, each task first keeps its own k, so a hot
group is never sorted in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.sources.sinks import write_down


def first_k(df: DataFrame, by: list[str], order: list[Column], k: int | Column, salt: Column, parts: int = 64) -> DataFrame:
    """The first k rows of each group in an order, with their rank ``r``."""
    kk = F.lit(k) if isinstance(k, int) else k
    one = Window.partitionBy(*by, "_salt").orderBy(*order)
    few = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(parts))).withColumn("_r", F.row_number().over(one)).where(F.col("_r") <= kk).drop("_salt", "_r")
    return few.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= kk)


def numbered(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with ``i``, the place in the group's order from 0 on, and ``n``, the group's size.

    Rows are sorted by ranges of group and order and numbered inside each; the ranges'
    counts give where each begins. So a group that holds a third of all rows is spread
    over many tasks. The rows are written down first, as ranges are drawn anew each time.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = write_down(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*[f"_k{k}" for k in range(len(by))])
    counts = ranged.groupBy(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(by)], F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(group.orderBy("_p")) - F.col("_c")).withColumn("n", F.sum("_c").over(group)).drop("_c")  # a row for each range of a group
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return ranged.withColumn("i", inside - 1).join(before, same).withColumn("i", F.col("i") + F.col("_before")).drop("_part", "_p", "_before", *[f"_k{k}" for k in range(len(by))])


def sliding(df: DataFrame, by: list[str], order: str, k: int, iteration: int) -> DataFrame:
    """k rows from place iteration x k on, round and round."""
    rows = numbered(df, by, [F.col(order)])
    return rows.where(F.pmod(F.col("i") - F.lit(iteration * k) % F.col("n"), F.col("n")) < k).drop("i", "n")


def random_k(df: DataFrame, by: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group, drawn by the MD5 of the seed and the key."""
    return first_k(df, by, [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)], k, F.col(key)).drop("r")


def stratified_rows(df: DataFrame, by: list[str], value: str, key: str, k: int, iteration: int = 0) -> DataFrame:
    """k rows of each group, a third of them from each third of the values' lengths; rotates by iteration."""
    rows = numbered(df, by, [F.length(value), F.col(key)])
    size, more = F.floor(F.col("n") / 3), F.col("n") % 3
    wide = more * (size + 1)
    third = F.when(F.col("i") < wide, F.floor(F.col("i") / (size + 1))).otherwise(more + F.floor((F.col("i") - wide) / F.greatest(size, F.lit(1))))
    rows = numbered(rows.withColumn("third", (third + 1).cast("int")).drop("i", "n"), [*by, "third"], [F.col(key)])
    rows = rows.withColumn("i", F.pmod(F.col("i") - F.lit(iteration * (k // 3)), F.col("n")))
    return first_k(rows, by, [F.col("i"), F.col("third")], k, F.col(key)).drop("n", "i", "r")


def rarity(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with ``rarity``: for each pattern that the value fits, 1 over the number of the group's values that fit it.

    Patterns are tried on distinct values with their counts; a value that fits none has 0.
    """
    from colsense.functions import patterns as P

    distinct = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    fits = F.array_compact(F.array(*[F.when(P.matches(F.col("_v"), p), F.lit(p)) for p in P.PATTERNS]))
    each = write_down(distinct.withColumn("_p", fits).where(F.size("_p") > 0).select(*by, "_v", "_c", F.explode("_p").alias("_p")))
    names = [f"_k{k}" for k in range(len(by))]
    group = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(by, names)], F.lit(True))
    counts = each.groupBy(*[F.col(c).alias(x) for c, x in zip(by, names)], F.col("_p").alias("_q")).agg(F.sum("_c").alias("_n"))  # a row for each group and pattern
    scored = each.join(counts, group & (F.col("_p") == F.col("_q"))).groupBy(*by, "_v").agg(F.round(F.sum(1 / F.col("_n")), 12).alias("rarity"))
    same = group & (F.col(value) == F.col("_v"))
    out = df.join(scored.withColumnsRenamed(dict(zip(by, names))), same, "left").drop("_v", *names)
    return out.withColumn("rarity", F.coalesce("rarity", F.lit(0.0)))


def rarest_rows(df: DataFrame, by: list[str], value: str, key: str, k: int, iteration: int = 0) -> DataFrame:
    """k rows of each group, from the thirds of its values by length, those with rare patterns first; rotates by iteration.

    A third gives k/3 rows (one more for the first k mod 3, and for the last third what the
    others' rounding leaves it), from place iteration x rows on, round and round; groups of
    fewer than three rows have fewer parts. Groups of up to k rows are taken whole. What
    thirds that are too small leave open is filled from the group's other rows in the
    order of the MD5 of iteration and key. Ties of length and of rarity go by the key.
    """
    n = F.col("n")
    sized = numbered(df, by, [F.length(value), F.col(key)])
    part = F.when(F.col("i") < F.floor(n / 3), 1).when(F.col("i") < F.floor(2 * n / 3), 2).otherwise(3)
    parts = F.when(n >= 3, 3).when(n == 2, 2).otherwise(1)
    rows = write_down(sized.withColumns({"third": part, "_size": n, "_parts": parts}).drop("i", "n"))
    scored = rarity(rows, by, value)
    placed = numbered(scored, [*by, "third"], [F.col("rarity").desc(), F.col(key)])
    # The place of a third among those that have rows.
    nth = F.when(F.col("_parts") == 3, F.col("third") - 1).when(F.col("_parts") == 2, F.col("third") - 2).otherwise(0)
    each = F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("_parts")))
    share = F.least(each + F.when(nth < k - each * F.col("_parts"), 1).otherwise(0), n)
    turn = F.pmod(F.col("i") - F.pmod(iteration * share, n), n)
    chosen = (F.col("_size") <= k) | (turn < share)
    fill = F.md5(F.concat_ws(":", F.lit(str(iteration)), F.col(key).cast("string")))
    order = [(~F.col("_chosen")).cast("int"), F.when(F.col("_chosen"), F.col("third")), F.when(F.col("_chosen"), F.col("_turn")), F.col("_fill"), F.col(key)]
    rows = placed.withColumns({"_chosen": chosen, "_turn": turn, "_fill": fill})
    return first_k(rows, by, order, k, F.col(key)).drop("_chosen", "_turn", "_fill", "_size", "_parts", "i", "n").withColumnRenamed("r", "place")


def plan(strata: DataFrame, total: int, fraction: float, least: int) -> DataFrame:
    """strata (code, size, rare) with ``take``: all of rare ones, a share of the rest, at least ``least``, never more than there are."""
    budget = min(500, int(total * fraction))
    rest = F.sum(F.when(~F.col("rare"), F.col("size")).otherwise(0)).over(Window.partitionBy())
    left = F.lit(budget) - F.sum(F.when(F.col("rare"), F.col("size")).otherwise(0)).over(Window.partitionBy())
    share = F.greatest(F.lit(least), F.floor(F.greatest(left, F.lit(0)) * F.col("size") / F.greatest(rest, F.lit(1))))
    return strata.withColumn("take", F.least(F.col("size"), F.when(F.col("rare"), F.col("size")).otherwise(share)))


def split(df: DataFrame, label: str, key: str, fraction: float = 0.2) -> DataFrame:
    """df with ``side``: test for about a fraction of each class, one at least; classes of one train."""
    rows = numbered(df, [label], [F.xxhash64(key), F.col(key)])
    test = F.when(F.col("n") < 2, F.lit(0)).otherwise(F.least(F.greatest(F.lit(1), F.round(F.col("n") * fraction)), F.col("n") - 1))
    return rows.withColumn("side", F.when(F.col("i") < test, "test").otherwise("train")).drop("n", "i")


def folds(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """df with ``fold`` 0..k-1 dealt in turn within each class; -1 (always trains) for classes of one."""
    rows = numbered(df, [label], [F.col(key)])
    return rows.withColumn("fold", F.when(F.col("n") < 2, F.lit(-1)).otherwise(F.col("i") % k).cast("int")).drop("n", "i")


def top_classes(df: DataFrame, label: str, key: str, classes: int, each: int) -> DataFrame:
    """``each`` rows of the most frequent classes."""
    best = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(classes).select(label)
    return first_k(df.join(F.broadcast(best), label, "left_semi"), [label], [F.col(key)], each, F.col(key)).drop("r")


def stability(df: DataFrame, entity: str, label: str) -> DataFrame:
    """(entity, n, stability): share of observations with the most frequent label; 1 below two."""
    c = df.groupBy(entity, label).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    return c.groupBy(entity).agg(n.alias("n"), F.when(n < 2, F.lit(1.0)).otherwise(F.max("c") / n).alias("stability"))


def distribution(df: DataFrame, entity: str, code: str, p: str, k: int = 4) -> DataFrame:
    """The most probable k codes of each entity with a positive probability; codes decide ties."""
    return first_k(df.where(F.col(p) > 0), [entity], [F.round(p, 12).desc(), F.col(code)], k, F.col(code), 1)


def shard(shapes: DataFrame, index: int, width: int) -> DataFrame:
    """Columns whose place in the order of tables and columns belongs to a shard."""
    rows = numbered(shapes, [], [F.col("table"), F.col("ord")])
    return rows.where(F.col("i") % width == index).drop("n").withColumnRenamed("i", "n")


def top_up(have: DataFrame, pool: DataFrame, label: str, key: str, floor: int) -> DataFrame:
    """Rows of the pool that bring each class of ``have`` up to a floor, by hash."""
    need = have.groupBy(label).agg((F.lit(floor) - F.count(F.lit(1))).alias("need")).where("need > 0")
    rows = pool.join(have.select(key), key, "left_anti").join(F.broadcast(need), label)
    return first_k(rows, [label], [F.xxhash64(key), F.col(key)], F.col("need"), F.col(key)).drop("r", "need")


def diverse(df: DataFrame, by: str, key: str, vector: str, limit: float = 0.995) -> DataFrame:
    """Rows of each group accepted in order of their key unless too similar to one accepted before.

    Rows too similar to one another are found block by block; among these few pairs, a
    row whose earlier partners are all rejected is accepted and rejects its later ones,
    in rounds, until every row is decided. That is the walk's result, whatever the
    group's size. The generator's own stop rules are not part of it.
    """
    from colsense.operators.similarity import block_products

    rows = write_down(df.select(F.col(by).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v")))
    ids = rows.withColumnRenamed("k", "id")
    pairs = block_products(ids, ids, None, limit, "g").select("g", F.col("id").alias("late"), F.col("other").alias("early"))
    open_ = write_down(pairs.distinct())
    gone = None
    while not open_.isEmpty():
        late = open_.select("g", F.col("late").alias("early")).distinct()
        sure = open_.join(late, ["g", "early"], "left_anti")  # pairs whose earlier row has no open partner before it
        out = write_down(sure.select("g", F.col("late").alias("k")).distinct())
        gone = out if gone is None else gone.union(out)
        left = open_.join(out.select("g", F.col("k").alias("late")), ["g", "late"], "left_anti").join(out.select("g", F.col("k").alias("early")), ["g", "early"], "left_anti")
        open_ = write_down(left.select("g", "late", "early"))
    kept = rows if gone is None else rows.join(gone, ["g", "k"], "left_anti")
    return kept.select(F.col("g").alias(by), F.col("k").alias(key))


def considered(target: int, window: int, most: float) -> int:
    """How many rows a walk with these stop rules looks at, at most.

    Of any ``window`` outcomes in a row, ``most`` of them at most are rejections (one more
    ends the walk), but for the first ones; so every window brings some acceptances,
    and ``target`` of them end the walk.
    """
    each = window - int(most * window + 1e-9)
    return 2 * window + window * -(-target // each)


def accept(df: DataFrame, by: str, key: str, vector: str, target: int, limit: float = 0.995, window: int = 20, most: float = 0.6, growth: float = 0.002, span: int = 10, diversity: bool = True, coverage: bool = True) -> DataFrame:
    """(by, key, place, accepted, outcome) of the rows that a walk through each group in order of its key looks at.

    A row is rejected if its cosine to an accepted one is over ``limit``. The walk ends when
    more than ``most`` of the last ``window`` outcomes are rejections (the row is rejected),
    when the largest distance of an accepted row from the running centroid has grown by
    less than ``growth`` over ``span`` acceptances, or with ``target`` accepted rows.
    outcome: accepted, rejected_diversity, stopped_diversity_exhausted,
    stopped_coverage_saturated, stopped_target_met.

    The rules bound the rows that are looked at (``considered``), so each group's first
    rows are found by task and then together, and only these go through the walk in order.
    Rows of equal keys are walked in order of a hash of their vectors; null vectors are left out.
    """
    import numpy as np
    import pandas as pd

    rows = df.where(F.col(vector).isNotNull()).select(F.col(by).alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    bound = considered(target, window, most) if diversity else target
    few = first_k(rows, ["g"], [F.col("k"), F.xxhash64("v")], bound, F.struct("k", "v"))
    kinds = dict(few.dtypes)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        taken: list[np.ndarray] = []
        outcomes: list[str] = []
        rejected: list[bool] = []
        radii: list[float] = []
        centre = None
        for v in pdf["v"]:
            e = np.asarray(v, float)
            e = e / (np.linalg.norm(e) + 1e-12)
            if diversity and taken and max(float(x @ e) for x in taken) > limit:
                rejected = [*rejected, True][-window:]
                if len(rejected) == window and sum(rejected) / window > most:
                    outcomes.append("stopped_diversity_exhausted")
                    break
                outcomes.append("rejected_diversity")
                continue
            rejected = [*rejected, False][-window:]
            taken.append(e)
            centre = e if centre is None else ((len(taken) - 1) * centre + e) / len(taken)
            if len(taken) > 1:
                centre = centre / (np.linalg.norm(centre) + 1e-12)
            radii = [*radii, max(1 - float(centre @ x) for x in taken)][-span:]
            if coverage and len(radii) == span and radii[-1] - radii[0] < growth:
                outcomes.append("stopped_coverage_saturated")
                break
            if len(taken) >= target:
                outcomes.append("stopped_target_met")
                break
            outcomes.append("accepted")
        seen = pdf.head(len(outcomes))
        ok = [o not in ("rejected_diversity", "stopped_diversity_exhausted") for o in outcomes]
        return pd.DataFrame({"g": seen["g"], "k": seen["k"], "place": range(len(outcomes)), "accepted": ok, "outcome": outcomes})

    out = few.groupBy("g").applyInPandas(walk, f"g {kinds['g']}, k {kinds['k']}, place int, accepted boolean, outcome string")
    return out.select(F.col("g").alias(by), F.col("k").alias(key), "place", "accepted", "outcome")
