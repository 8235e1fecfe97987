"""Sensitivity of evidence from similarities: invariants over grids of inputs, fused as one job.

A configuration is a profile of similarities (config, code, s, negative). ``variants``
makes every grid point of every configuration a row set of its own, so all of them go
through the rule of evidence together; ``report`` compares neighbours on the grids.
Grids have a fixed number of points, so the work is that of the configurations times it.

Roles of a configuration: its target is the best leaf, the sibling the next best leaf
below the same parent, the competitor the best leaf elsewhere, the parent the target's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.sources.sinks import write_down

from . import fusion

#: Step of a grid, its points, twins of the stability test, their distance, tolerance, and the levels that flag a cell.
STEP, POINTS, TWINS, EPSILON, TOLERANCE = 0.05, 21, 200, 0.01, 1e-9
CONFLICT, JUMP, SWITCH, UNSTABLE = 0.5, 0.15, 0.30, 0.05
#: Points of the two axes of each invariant (first and number).
GRIDS = {
    "mass_conservation": ((0, POINTS), (0, POINTS)),
    "monotonicity_positive": ((0, POINTS), (0, 1)),
    "anti_monotonicity_negative": ((0, POINTS), (0, 1)),
    "conflict_k_transit": ((0, POINTS), (0, POINTS)),
    "ranking_stability": ((0, TWINS + 1), (0, 1)),
    "aggregation_threshold_cliff": ((0, POINTS), (0, POINTS)),
    "aggregation_vs_leaf_competition": ((10, 11), (0, 11)),
    "internal_node_top1_switch": ((0, POINTS), (0, 1)),
    "aggregation_under_anti_example": ((0, POINTS), (0, 1)),
    "verifier_pass_rate_effect": ((0, POINTS), (0, 1)),
}


def profiles(sims: DataFrame, classes: DataFrame) -> DataFrame:
    """(config, code, s, negative): mean similarities of each class; classes: (entity, config)."""
    rows = sims.join(classes, "entity").groupBy("config", "code")
    return rows.agg(F.round(F.avg("s"), 9).alias("s"), F.round(F.avg("negative"), 9).alias("negative"))


def roles(profile: DataFrame, nodes: DataFrame) -> DataFrame:
    """(config, target, sibling, competitor, parent); null where there is none."""
    leaves = profile.join(F.broadcast(nodes.select("code", "parent_code")), "code").join(F.broadcast(nodes.select(F.col("parent_code").alias("code")).distinct()), "code", "left_anti")
    best = F.max_by("code", F.struct("s", "code"))
    top = leaves.groupBy("config").agg(best.alias("target"))
    rest = leaves.join(top, "config").where("code <> target").join(F.broadcast(nodes.select(F.col("code").alias("target"), F.col("parent_code").alias("parent"))), "target")
    near = F.col("parent_code").eqNullSafe(F.col("parent"))
    others = rest.groupBy("config").agg(F.max_by("code", F.when(near, F.struct("s", "code"))).alias("sibling"), F.max_by("code", F.when(~near, F.struct("s", "code"))).alias("competitor"))
    return top.join(F.broadcast(nodes.select(F.col("code").alias("target"), F.col("parent_code").alias("parent"))), "target", "left").join(others, "config", "left").select("config", "target", "sibling", "competitor", "parent")


def noise(config: Column, code: Column, twin: Column) -> Column:
    """A number in [-1, 1] for each twin and code, the same on each run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", config, code, twin.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967295.0 * 2 - 1


def variants(profile: DataFrame, who: DataFrame) -> DataFrame:
    """config, invariant, i, j, target, sibling, competitor, parent, code, s, negative of every grid point."""
    spark = profile.sparkSession
    grid = None
    for name, ((a, n), (b, m)) in GRIDS.items():
        part = spark.range(n * m).select(F.lit(name).alias("invariant"), (F.floor(F.col("id") / m) + a).cast("int").alias("i"), (F.col("id") % m + b).cast("int").alias("j"))
        grid = part if grid is None else grid.unionByName(part)
    rows = profile.join(who, "config").crossJoin(F.broadcast(grid))  # some 2,000 points for each configuration
    x, y, code = F.col("i") * F.lit(STEP), F.col("j") * F.lit(STEP), F.col("code")
    on = lambda role, *names: (code == F.col(role)) & F.col("invariant").isin(*names)
    twin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") + F.lit(EPSILON) * noise(F.col("config"), code, F.col("i"))))
    s = (
        F.when(on("target", "mass_conservation", "monotonicity_positive", "conflict_k_transit", "aggregation_vs_leaf_competition"), x)
        .when(on("target", "verifier_pass_rate_effect"), F.col("s") * x)
        .when(on("sibling", "aggregation_threshold_cliff"), x)
        .when(on("sibling", "aggregation_vs_leaf_competition"), y)
        .when(on("competitor", "aggregation_threshold_cliff"), y)
        .when(on("parent", "internal_node_top1_switch"), x)
        .when((F.col("invariant") == "ranking_stability") & (F.col("i") > 0), twin)
        .otherwise(F.col("s"))
    )
    negative = (
        F.when(on("parent", "mass_conservation"), y)
        .when(on("target", "anti_monotonicity_negative"), x)
        .when(on("target", "conflict_k_transit"), y)
        .when(on("parent", "aggregation_under_anti_example"), x)
        .otherwise(F.col("negative"))
    )
    return rows.select("config", "invariant", "i", "j", "target", "sibling", "competitor", "parent", "code", s.alias("s"), negative.alias("negative"))


def observed(points: DataFrame, clo: DataFrame) -> DataFrame:
    """A row for each grid point: sum of masses, those of target, parent and competitor, the best code, its lead, and the conflict."""
    name = F.concat_ws("|", "config", "invariant", "i", "j")
    points = points.withColumn("entity", name)
    masses = fusion.maxsim_masses(points.select("entity", "code", "s", "negative"), clo)
    about = points.groupBy("entity", "config", "invariant", "i", "j", "target", "competitor", "parent").agg(F.slice(F.sort_array(F.collect_list("s"), False), 1, 2).alias("two"))  # the codes of a taxonomy
    of = lambda focal: F.coalesce(F.max(F.when(F.col("focal") == focal, F.col("mass"))), F.lit(0.0))
    own = F.regexp_replace("focal", "[*]$", "")
    best = F.min_by(own, F.when(F.col("focal") != fusion.ALL, F.struct((-F.round("mass", 9)).alias("m"), own.alias("c"))))
    rows = masses.join(about, "entity").groupBy("config", "invariant", "i", "j", "two")
    return rows.agg(
        F.sum("mass").alias("total"), of(F.col("target")).alias("leaf"), of(F.concat("parent", F.lit("*"))).alias("tree"), of(F.col("competitor")).alias("rival"), best.alias("best"), F.max("conflict").alias("k")
    ).withColumn("lead", F.round(F.get("two", F.lit(0)) - F.coalesce(F.get("two", F.lit(1)), F.lit(0.0)), 9))


def report(seen: DataFrame) -> DataFrame:
    """(invariant, config, cells, violations, flagged, value) from the rows of ``observed``.

    violations: grid points against the invariant; flagged: points over a level that is
    reported (conflict, jump, a parent above its leaf); value: the largest of what the
    invariant looks at (deviation, belief, mass, conflict, share of other choices, jump,
    lead of the parent, jump at a switch, mass lost, step).
    """
    along = Window.partitionBy("config", "invariant", "j").orderBy("i")
    step = lambda c: F.col(c) - F.lag(c).over(along)
    base = F.first("best").over(along.rowsBetween(Window.unboundedPreceding, 0))
    kind = F.col("leaf") >= F.col("tree")
    rows = seen.withColumns({"d_leaf": step("leaf"), "d_tree": step("tree"), "d_rival": step("rival"), "turned": kind != F.lag(kind).over(along), "other": F.coalesce(F.col("best") != base, F.lit(False)), "first_tree": F.first("tree").over(along.rowsBetween(Window.unboundedPreceding, 0))})
    is_ = lambda *names: F.col("invariant").isin(*names)
    against = (
        F.when(is_("mass_conservation"), F.abs(F.col("total") - 1) >= TOLERANCE)
        .when(is_("monotonicity_positive", "verifier_pass_rate_effect"), F.col("d_leaf") < -TOLERANCE)
        .when(is_("anti_monotonicity_negative"), F.col("d_leaf") > TOLERANCE)
        .when(is_("aggregation_under_anti_example"), F.col("d_rival") < -TOLERANCE)
    )
    jump = F.greatest(F.abs("d_leaf"), F.abs("d_tree"))
    flagged = (
        F.when(is_("conflict_k_transit"), F.col("k") >= CONFLICT)
        .when(is_("aggregation_threshold_cliff"), F.col("d_tree") > JUMP)
        .when(is_("aggregation_vs_leaf_competition"), F.col("tree") > F.col("leaf"))
        .when(is_("internal_node_top1_switch"), F.col("turned") & (jump > SWITCH))
        .when(is_("ranking_stability"), F.col("other"))
    )
    value = (
        F.when(is_("mass_conservation"), F.abs(F.col("total") - 1))
        .when(is_("monotonicity_positive", "anti_monotonicity_negative"), F.col("leaf"))
        .when(is_("conflict_k_transit"), F.col("k"))
        .when(is_("ranking_stability"), F.when(F.col("i") == 0, F.col("lead")))
        .when(is_("aggregation_threshold_cliff"), F.col("d_tree"))
        .when(is_("aggregation_vs_leaf_competition"), F.col("tree") - F.col("leaf"))
        .when(is_("internal_node_top1_switch"), F.when(F.col("turned"), jump))
        .when(is_("aggregation_under_anti_example"), F.col("first_tree") - F.col("tree"))
        .when(is_("verifier_pass_rate_effect"), F.abs("d_leaf"))
    )
    out = rows.groupBy("invariant", "config").agg(F.count(F.lit(1)).alias("cells"), F.count_if(against).alias("violations"), F.count_if(flagged).alias("flagged"), F.max(value).alias("value"))
    twins = F.col("invariant") == "ranking_stability"
    rate = F.col("flagged") / TWINS
    # Twins are no violation where a lead of two steps or less allows another choice.
    broken = (F.col("value") > 2 * EPSILON) & (rate > UNSTABLE)
    return out.withColumn("violations", F.when(twins, broken.cast("long")).otherwise(F.col("violations"))).withColumn("cells", F.when(twins, F.lit(TWINS)).otherwise(F.col("cells"))).withColumn("value", F.when(twins, rate).otherwise(F.col("value")))


def study(sims: DataFrame, classes: DataFrame, nodes: DataFrame, clo: DataFrame) -> DataFrame:
    """``report`` of the mean profiles of all classes."""
    profile = write_down(profiles(sims, classes))
    points = write_down(variants(profile, write_down(roles(profile, nodes))))
    return report(write_down(observed(points, clo)))
