"""Greedy splits and covers against plain walks, also with many collections."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colsense.operators import fusion, splits

GENERA = [f"g{k}" for k in range(9)]


def made(rng, n):
    return [(f"c{k:05d}", g) for k in range(n) for g in rng.sample(GENERA, rng.randrange(1, 4)) for _ in range(rng.randrange(1, 5))]


def summary(rows):
    out = defaultdict(lambda: [set(), 0])
    for c, g in rows:
        out[c][0].add(g)
        out[c][1] += 1
    return {c: (g, n) for c, (g, n) in out.items()}


@pytest.fixture(scope="module")
def few():
    return made(random.Random(3), 60)


def frame(spark, rows):
    return spark.createDataFrame(rows, "c string, g string")


def test_cover(spark, few):
    items, done, spent, want = summary(few), set(), 0, []
    while True:
        fits = [(len(g - done), len(g), -n, c) for c, (g, n) in items.items() if spent + n <= 40 and g - done]
        if not fits:
            break
        gain, _, n, c = max(fits)
        want.append((c, len(want), gain))
        done |= items[c][0]
        spent -= n
    got = splits.cover(frame(spark, few), "c", "g", 40)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    with pytest.raises(ValueError, match="genera are covered"):
        splits.cover(frame(spark, few), "c", "g", 3, least=8)


@pytest.mark.parametrize("ahead", [1, 3, 500])
def test_cover_looks_ahead(spark, monkeypatch, ahead):
    """However few collections a pass brings, the choice is that of the walk over all."""
    monkeypatch.setattr(splits, "AHEAD", ahead)
    rng = random.Random(8)
    rows = [(f"c{k:03d}", f"g{x}") for k in range(80) for x in rng.sample(range(40), rng.randrange(1, 7)) for _ in range(rng.randrange(1, 4))]
    items, done, spent, want = summary(rows), set(), 0, []
    while True:
        fits = [(len(g - done), len(g), -n, c) for c, (g, n) in items.items() if spent + n <= 110 and g - done]
        if not fits:
            break
        gain, _, n, c = max(fits)
        want.append((c, len(want), gain))
        done |= items[c][0]
        spent -= n
    assert len(want) > 8
    assert sorted(map(tuple, splits.cover(frame(spark, rows), "c", "g", 110).collect()), key=lambda r: r[1]) == want


def test_disjoint_cover(spark, few):
    rows = frame(spark, few)
    first = splits.cover(rows, "c", "g", 40)
    need = ["g1", "g4", "g7"]
    second = splits.cover(rows, "c", "g", 1000, required=need, without=first)
    chosen = {r["c"] for r in second.collect()}
    assert not chosen & {r["c"] for r in first.collect()}
    assert set(need) <= set().union(*(g for c, (g, _) in summary(few).items() if c in chosen))
    with pytest.raises(ValueError, match="without a collection"):
        splits.cover(rows, "c", "g", 1000, required=["nowhere"])


def test_held_tables(spark, few):
    items = summary(few)
    left = {g: sum(g in s for s, _ in items.values()) for g in GENERA}
    held, served = set(), set()
    for x in sorted(left, key=lambda k: (left[k], k)):
        if x in served:
            continue
        for _, c in sorted((n, c) for c, (_, n) in items.items()):
            if x in items[c][0] and c not in held and all(left[y] > 1 for y in items[c][0]):
                held.add(c)
                served |= items[c][0]
                for y in items[c][0]:
                    left[y] -= 1
                break
    got = {r["c"]: r["side"] for r in splits.held_tables(frame(spark, few), "c", "g").collect()}
    assert got == {c: "holdout" if c in held else "support" for c in items}


def plain_split(genera_of):
    """The walk over genera and collections one by one."""
    quota, priority = {"train": 0.8, "test": 0.1, "validate": 0.1}, {"train": 0, "test": 1, "validate": 2}
    members = defaultdict(list)
    for c in sorted(genera_of):
        for g in genera_of[c]:
            members[g].append(c)
    side = {}
    for g in sorted(members, key=lambda g: (len(members[g]), g)):
        have = {side[c] for c in members[g] if c in side}
        for s in [s for k, s in enumerate(quota, 1) if len(members[g]) >= k and s not in have]:
            free = [(min((len(members[x]) for x in genera_of[c] - {g}), default=0), c) for c in members[g] if c not in side]
            if not free:
                break
            side[min(free)[1]] = s
    counts = {s: sum(x == s for x in side.values()) for s in quota}
    for c in sorted(genera_of):
        if c not in side:
            s = max(quota, key=lambda s: (quota[s] * len(genera_of) - counts[s], -priority[s]))
            side[c] = s
            counts[s] += 1
    return side


@pytest.mark.parametrize(("n", "blank"), [(2, 0), (7, 1), (60, 3), (61, 0), (30_000, 100)])
def test_balanced_is_the_plain_walk(spark, n, blank):
    """Rare genera and collections without one; also with far more collections than a driver should see."""
    rng = random.Random(n)
    rows = [*made(rng, n), *[(f"c{k:05d}", "rare1") for k in rng.sample(range(n), min(n, 2))], *[(f"c{k:05d}", "rare2") for k in rng.sample(range(n), 1)], *[(f"b{k}", None) for k in range(blank)]]
    genera_of = defaultdict(set)
    for c, g in rows:
        genera_of[c] |= {g} - {None}
    got = splits.balanced(frame(spark, rows), "c", "g").collect()
    assert len(got) == len(genera_of)
    assert {r["c"]: r["side"] for r in got} == plain_split(genera_of)


def test_balanced_without_collections(spark):
    assert splits.balanced(frame(spark, []), "c", "g").count() == 0


def test_covers_of_many_collections(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("c"), F.col("id")).alias("c"), F.concat(F.lit("g"), F.col("id") % 7).alias("g"))
    assert splits.cover(rows, "c", "g", 1000).count() == 7
    held = splits.held_tables(rows, "c", "g")
    assert held.count() == 30_000 and held.where("side = 'holdout'").count() == 7


def test_sweep_falls_back_under_total_conflict(spark):
    nodes = spark.createDataFrame([("0", None), ("0.a", "0"), ("0.b", "0")], "code string, parent_code string")
    clo = spark.createDataFrame([("0", "0", 0), ("0.a", "0.a", 0), ("0.b", "0.b", 0), ("0.a", "0", 1), ("0.b", "0", 1)], "code string, ancestor string, distance int")
    fr = fusion.frame(nodes, clo)
    mem = fusion.members(nodes, clo, fr)
    masses = spark.createDataFrame([(1, "x", "0.a", 1.0), (1, "y", "0.b", 1.0), (2, "x", "0.b", 0.6), (2, "x", "Z", 0.4), (2, "y", "0.b", 0.9)], "entity long, source string, focal string, mass double")
    truth = spark.createDataFrame([(1, "0.b"), (2, "0.b")], "entity long, truth string")
    got = {r["grid"]: r for r in fusion.alpha_sweep(masses, truth, fusion.meet(fr, clo), fr, mem, ["x", "y"], [0.5, 1.0]).collect()}
    assert {g: (r["n"], r["correct"], r["fallbacks"]) for g, r in got.items()} == {0: (2, 1, 0), 1: (2, 1, 0), 2: (2, 2, 0), 3: (2, 2, 1)}
    assert got[3]["delta"] == 0.0 and got[0]["delta"] == -0.5
