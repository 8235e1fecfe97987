"""Rounds of new votes against a plain loop over entities."""

import random

import pytest
from pyspark.sql import functions as F

from colsense.operators import loop
from colsense.sources.sinks import write_down

SCHEMA = "entity long, code string, confidence double"


def belief(own, vote):
    """A stand-in for fusion: the own mass and the vote's confidence for a code; (code, bel, gap, k)."""
    code, mass = own
    if vote is None:
        return (code, round(mass, 9), round(1 - mass, 9), 0.0)
    other, confidence = vote
    if other == code:
        bel = 1 - (1 - mass) * (1 - confidence)
        return (code, round(bel, 9), round(1 - bel, 9), 0.0)
    k = mass * confidence
    best = (code, mass) if mass >= confidence else (other, confidence)
    return (best[0], round(best[1] * (1 - k), 9), round(1 - best[1], 9), round(k, 9))


def fuse(evidence, votes):
    j = evidence.join(votes.select("entity", F.col("code").alias("v"), "confidence"), "entity", "left").select("entity", F.col("focal").alias("c"), F.col("mass").alias("m"), "v", F.col("confidence").alias("p"))
    same, none = F.col("v") == F.col("c"), F.col("v").isNull()
    both = 1 - (1 - F.col("m")) * (1 - F.col("p"))
    k = F.when(none | same, F.lit(0.0)).otherwise(F.col("m") * F.col("p"))
    own = none | (F.col("m") >= F.col("p")) | same
    top = F.when(none, F.col("m")).when(same, both).otherwise(F.greatest("m", "p"))
    return j.select("entity", F.when(own, F.col("c")).otherwise(F.col("v")).alias("code"), F.round(top * F.when(none | same, F.lit(1.0)).otherwise(1 - k), 9).alias("bel"), F.round(1 - top, 9).alias("gap"), F.round(k, 9).alias("k"))


def plain(own, answers, stops):
    votes = {e: (c, p) for (e, i), (c, p) in answers.items() if i == 0}
    state = {e: (*belief(x, votes.get(e)), votes.get(e, (None,))[0], 0) for e, x in own.items()}
    mean = lambda: sum(s[2] for s in state.values()) / len(state)
    gaps, asked = [mean()], 0
    for i in range(1, stops.most + 1):
        again = [e for e, (c, bel, gap, k, v, _) in state.items() if v is not None and c != v and k > stops.k or gap > stops.gap or bel < stops.bel]
        free = i > stops.least
        if not again and free:
            return state, gaps, "no_revisit_candidates"
        if asked >= stops.budget:
            return state, gaps, "budget_exhausted"
        if gaps[-1] < stops.mean_gap and free:
            return state, gaps, "gap_threshold_met"
        if free and len(gaps) > 2 and gaps[-1] - gaps[-2] >= -1e-6 and gaps[-2] - gaps[-3] >= -1e-6:
            return state, gaps, "plateau"
        asked += len(again)
        for e in again:
            if (e, i) in answers:
                votes[e] = answers[e, i]
            state[e] = (*belief(own[e], votes.get(e)), votes.get(e, (None,))[0], i)
        gaps.append(mean())
    return state, gaps, "iterations_exhausted"


@pytest.mark.parametrize(
    ("stops", "better", "want"),
    [
        (loop.Stops(), 0.25, None),
        (loop.Stops(mean_gap=0.0, gap=0.6, bel=0.1), 0.5, "no_revisit_candidates"),
        (loop.Stops(budget=40, mean_gap=0.0), 0.0, "budget_exhausted"),
        (loop.Stops(mean_gap=0.45), 0.2, "gap_threshold_met"),
        (loop.Stops(mean_gap=0.0), None, "plateau"),
        (loop.Stops(most=2, mean_gap=0.0), 0.1, "iterations_exhausted"),
    ],
)
def test_rounds(spark, stops, better, want):
    """Each outcome; entities without votes or answers; who is not asked again keeps the round of before."""
    rng = random.Random(11)
    own = {e: (f"c{rng.randrange(3)}", rng.choice([0.2, 0.5, 0.9])) for e in range(40)}
    answers = {(e, 0): (f"c{rng.randrange(3)}", 0.3) for e in range(38)}
    if better is not None:
        answers |= {(e, i): (own[e][0] if rng.random() < 0.8 else "c0", min(0.99, 0.3 + better * i)) for e in range(40) for i in range(1, 6) if rng.random() < 0.9}
    evidence = spark.createDataFrame([(e, "own", c, m) for e, (c, m) in own.items()], "entity long, source string, focal string, mass double")
    table = spark.createDataFrame([(e, i, c, p) for (e, i), (c, p) in answers.items()], "entity long, i int, code string, confidence double")
    ask = lambda again, i: table.where(F.col("i") == i).join(again, "entity", "left_semi")
    beliefs, votes, log, outcome = loop.revisit(evidence, table.where("i = 0"), fuse, ask, write_down, stops)
    state, gaps, tag = plain(own, answers, stops)
    assert outcome == tag and (want is None or tag == want)
    assert {r["entity"]: (r["code"], r["bel"], r["gap"], r["k"], r["vote"], r["round"]) for r in beliefs.collect()} == state
    assert [x["gap"] for x in log] == pytest.approx(gaps)
    assert votes.select("entity", "round").distinct().count() == votes.count()


def test_without_entities(spark):
    evidence = spark.createDataFrame([], "entity long, source string, focal string, mass double")
    none = spark.createDataFrame([], SCHEMA)
    beliefs, _, log, outcome = loop.revisit(evidence, none, fuse, lambda again, i: none, write_down)
    assert beliefs.count() == 0 and outcome == "no_revisit_candidates" and len(log) == 3


def test_copies_end_as_one_does(spark):
    """The same entities 26,000 times over, a million questions and more: rounds, outcome and beliefs are those of one copy."""

    def run(n):
        ids = spark.range(10 * n).select(F.col("id").alias("entity"))
        evidence = ids.select("entity", F.lit("own").alias("source"), F.lit("c0").alias("focal"), (F.lit(0.2) + (F.col("entity") % 10) / 100).alias("mass"))
        ask = lambda again, i: again.select("entity", F.lit("c1").alias("code"), F.lit(0.3 + 0.05 * i).alias("confidence"))
        beliefs, _, log, outcome = loop.revisit(evidence, ask(ids, 0), fuse, ask, write_down)
        same = beliefs.groupBy((F.col("entity") % 10).alias("e"), "code", "bel", "gap", "k", "vote", "round").count().collect()
        return outcome, [(x["asked"] / n, round(x["gap"], 9)) for x in log], sorted((*r[:-1], r["count"] / n) for r in same)

    assert run(26_000) == run(1)
