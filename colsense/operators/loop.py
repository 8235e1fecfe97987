"""Analytics of the iterations that settle beliefs."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreement(votes: DataFrame, need: int = 3) -> DataFrame:
    """(entity, n_agree, locked): channels whose first choice (or one of the first three of ``maxsim``) is the vote.

    votes: (entity, vote, channel, rank, code).
    """
    deep = F.when(F.col("channel") == "maxsim", F.lit(3)).otherwise(F.lit(1))
    ok = (F.col("rank") <= deep) & (F.col("code") == F.col("vote"))
    per = votes.groupBy("entity", "channel").agg(F.max(ok).alias("ok"))
    return per.groupBy("entity").agg(F.count_if("ok").alias("n_agree")).withColumn("locked", F.col("n_agree") >= need)


def disagreements(rows: DataFrame, mass: float = 0.45, k: float = 0.2) -> DataFrame:
    """(entity, priority, score): 0 where an independent choice of some mass differs from the vote, 1 where the prediction does under conflict."""
    zero = (F.col("independent") != F.col("vote")) & (F.col("independent_mass") >= mass)
    one = (F.col("pred") != F.col("vote")) & (F.col("k") > k)
    p = F.when(zero, 0).when(one, 1)
    return rows.withColumn("priority", p).where("priority IS NOT NULL").select("entity", "priority", F.when(F.col("priority") == 0, F.col("independent_mass")).otherwise(F.col("k")).alias("score"))


def uncertain(rows: DataFrame, gap: float = 0.18, bel: float = 0.45, margin: float = 0.05) -> DataFrame:
    hit = (F.col("gap") > gap) | (F.col("bel") < bel) | (F.col("margin") < margin)
    return rows.where(hit & ~F.col("locked"))


def metrics(rows: DataFrame) -> DataFrame:
    """Per iteration: coverage, mean and largest conflict, mean gap and belief, share of unclear rows."""
    lab = F.col("label").isNotNull()
    only = lambda c: F.when(lab, F.col(c))
    return rows.groupBy("iteration").agg(
        F.avg(lab.cast("double")).alias("coverage"), F.avg(only("k")).alias("mean_k"), F.max(only("k")).alias("max_k"), F.avg(only("gap")).alias("mean_gap"), F.avg(only("bel")).alias("mean_bel"),
        F.avg(F.when(lab, ((F.col("bel") < 0.3) | (F.col("gap") > 0.5)).cast("double"))).alias("frac_unclear"),
    )


def residual(gap: Column, unclear: Column, k: Column, indep: Column) -> Column:
    """Root mean square of four measures, each over its tolerance."""
    return F.sqrt((F.pow(gap / 0.18, 2) + F.pow(unclear / 0.25, 2) + F.pow(k / 0.2, 2) + F.pow(indep / 0.2, 2)) / 4)


def contraction(series: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """series (iteration, value) with the ratio to the iteration before (0 where that is 0) and the slope from the first."""
    w = Window.partitionBy(*(by or [])).orderBy("iteration")
    prior = F.lag(value).over(w)
    n = F.row_number().over(w) - 1
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("ratio", F.when(F.abs(prior) < 1e-12, F.lit(0.0)).otherwise(F.col(value) / prior)).withColumn("slope", F.when(n > 0, (F.col(value) - first) / n))


def plateau(series: DataFrame, value: str) -> DataFrame:
    """series with ``plateau``: the last two steps were not below -1e-6."""
    w = Window.orderBy("iteration")
    one = F.col(value) - F.lag(value, 1).over(w)
    two = F.lag(value, 1).over(w) - F.lag(value, 2).over(w)
    return series.withColumn("plateau", F.coalesce((one >= -1e-6) & (two >= -1e-6), F.lit(False)))


def trajectories(rows: DataFrame) -> DataFrame:
    """(entity, n, last_ratio): each entity's last gap ratio, else its last conflict ratio, else null."""
    w = Window.partitionBy("entity").orderBy("iteration")
    r = rows.withColumn("rg", F.try_divide("gap", F.lag("gap").over(w))).withColumn("rk", F.try_divide("k", F.lag("k").over(w)))
    return r.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.coalesce("rg", "rk"), "iteration").alias("last_ratio"))


class Stops(NamedTuple):
    """When the rounds end, and which entities are asked again.

    Fixed values: rounds at most and at least, mean gap that is small enough, and the
    bounds on gap, belief and conflict beyond which an answer is uncertain or disputed.
    Questions are bounded only where a ``budget`` is given: a fixed number of them would
    end the rounds of a larger table sooner.
    """

    most: int = 5
    least: int = 2
    budget: float = float("inf")
    mean_gap: float = 0.18
    gap: float = 0.18
    bel: float = 0.45
    k: float = 0.2


def candidates(beliefs: DataFrame, stops: Stops) -> DataFrame:
    """(entity) of answers that differ from the newest vote under conflict, or are uncertain."""
    disputed = (F.col("code") != F.col("vote")) & (F.col("k") > stops.k)
    return beliefs.where(F.coalesce(disputed, F.lit(False)) | (F.round("gap", 9) > stops.gap) | (F.round("bel", 9) < stops.bel)).select("entity")


def revisit(
    evidence: DataFrame, first: DataFrame, fuse: Callable[[DataFrame, DataFrame], DataFrame], ask: Callable[[DataFrame, int], DataFrame], stage: Callable[[DataFrame], DataFrame], stops: Stops = Stops()
) -> tuple[DataFrame, DataFrame, list[dict], str]:
    """Rounds that ask again about uncertain entities and fuse these anew: (beliefs, votes, log, outcome).

    evidence: (entity, source, focal, mass) that stays as it is; first: the votes (entity,
    code, confidence) of round 0. ``fuse(evidence, votes)`` gives (entity, code, bel, gap, k);
    ``ask(entities, round)`` gives new votes, for as many of the entities as it can.
    The state is two tables that ``stage`` writes down: votes (entity, code, confidence,
    round), the newest of which counts, and beliefs, with the vote and the round in which
    an entity was last fused. A round fuses its candidates alone; of a round only its
    means and counts come to the driver.

    Rounds end when nothing is uncertain, when a given ``budget`` has been asked, when
    the mean gap is small or has not fallen in two rounds (all but the budget after
    ``least`` rounds), or after ``most``: outcome no_revisit_candidates, budget_exhausted,
    gap_threshold_met, plateau or iterations_exhausted. An answer that no evidence backs
    any more leaves the beliefs.
    """

    def fused(of: DataFrame, votes: DataFrame, i: int) -> DataFrame:
        newest = votes.select("entity", F.col("code").alias("vote"))
        return fuse(of, votes).join(newest, "entity", "left").select("entity", "code", "bel", "gap", "k", "vote", F.lit(i).alias("round"))

    def told(beliefs: DataFrame, i: int, asked: int) -> dict:
        m = beliefs.agg(F.avg("gap").alias("gap"), F.avg("k").alias("k"), F.avg("bel").alias("bel")).first().asDict()
        return m | {"round": i, "asked": asked}

    votes = stage(first.select("entity", "code", "confidence", F.lit(0).alias("round")))
    beliefs = stage(fused(evidence, votes, 0))
    log = [told(beliefs, 0, 0)]
    for i in range(1, stops.most + 1):
        again = stage(candidates(beliefs, stops))
        n, free = again.count(), i > stops.least
        gaps = [x["gap"] or 0.0 for x in log]
        flat = len(gaps) > 2 and all(gaps[-j] - gaps[-j - 1] >= -1e-6 for j in (1, 2))
        if not n and free:
            return beliefs, votes, log, "no_revisit_candidates"
        if sum(x["asked"] for x in log) >= stops.budget:
            return beliefs, votes, log, "budget_exhausted"
        if gaps[-1] < stops.mean_gap and free:
            return beliefs, votes, log, "gap_threshold_met"
        if flat and free:
            return beliefs, votes, log, "plateau"
        if n:
            new = stage(ask(again, i).select("entity", "code", "confidence", F.lit(i).alias("round")))
            old = votes
            votes = stage(old.unionByName(new))
            newest = votes.groupBy("entity").agg(F.max_by(F.struct("code", "confidence"), "round").alias("x")).select("entity", "x.*")
            redone = fused(evidence.join(again, "entity", "left_semi"), newest.join(again, "entity", "left_semi"), i)
            beliefs = stage(beliefs.join(again, "entity", "left_anti").unionByName(redone))
        log.append(told(beliefs, i, n))
    return beliefs, votes, log, "iterations_exhausted"


def vote_sources(votes: DataFrame) -> DataFrame:
    """(entity, code, confidence, source): the newest vote; a direct one beats a propagated one of the same round."""
    rank = F.when(F.col("source") == "revisit", 2).when(F.col("source") == "direct", 1).otherwise(0)
    best = F.max_by(F.struct("code", "confidence", "source"), F.struct("iteration", rank))
    return votes.groupBy("entity").agg(best.alias("x")).select("entity", "x.*")
