"""Sampled Shapley values against exact ones over all sets of four features."""

import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from colsense.operators import ml

FEATURES = ["tokens", "brand", "size", "price"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for k in range(240):
        label = "ab"[k % 2] if k % 40 else None
        word = "left" if (label == "a") == (rng.random() < 0.9) else "right"
        out.append((k, label, [word, rng.choice(["x", "y"])], [rng.choice(["p", "q"])], float(k % 2) * (rng.random() < 0.7), rng.random()))
    return spark.createDataFrame(out, "id long, label string, tokens array<string>, brand array<string>, size double, price double").cache()


@pytest.fixture(scope="module")
def model(rows):
    return ml.fit_to_votes(ml.forest(["tokens", "brand"], ["size", "price"]), rows)


@pytest.fixture(scope="module")
def exact(rows, model):
    """Values over all orders; each set's loss by one plain substitution."""
    donor = ml.one_donor(rows.where("label IS NOT NULL"), "id", FEATURES).first()
    typed = {f.name: f.dataType for f in rows.schema}

    def loss(have):
        df = rows.where("label IS NOT NULL")
        for f in FEATURES:
            if f not in have:
                value = donor[f]
                df = df.withColumn(f, (F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)).cast(typed[f]))
        out = model.transform(df.withColumn("weight", F.lit(1.0))).select("y", "probability").collect()
        return -sum(math.log(max(r["probability"][int(r["y"])], 1e-12)) for r in out) / len(out)

    v = {frozenset(s): loss(s) for k in range(5) for s in {frozenset(p[:k]) for p in permutations(FEATURES)}}
    values = dict.fromkeys(FEATURES, 0.0)
    for p in permutations(FEATURES):
        for k, f in enumerate(p):
            values[f] += (v[frozenset(p[:k])] - v[frozenset(p[: k + 1])]) / 24
    return values, v[frozenset()] - v[frozenset(FEATURES)]


def test_values_are_near_the_exact_ones(rows, model, exact):
    values, total = exact
    got = {r["feature"]: r for r in ml.sage(model, rows, "id", FEATURES, permutations=256, ratio=0.0).collect()}
    assert {r["n"] for r in got.values()} == {256}
    assert sum(r["value"] for r in got.values()) == pytest.approx(total, abs=1e-9)
    for f, want in values.items():
        assert abs(got[f]["value"] - want) <= 4.5 * got[f]["std"] + 1e-9
    assert max(values, key=values.get) == "size" and got["size"]["value"] > 0.1 and got["tokens"]["value"] > 0.001


def test_it_stops_when_values_have_settled(rows, model):
    loose = ml.sage(model, rows, "id", FEATURES, ratio=1e9).collect()
    assert {r["n"] for r in loose} == {32}
    ended = ml.sage(model, rows, "id", ["tokens"], ratio=0.025).collect()
    assert (ended[0]["n"], ended[0]["std"]) == (32, 0.0)


def test_without_labels(rows, model):
    out = ml.sage(model, rows.where("label IS NULL"), "id", FEATURES, permutations=32).collect()
    assert all(r["value"] == 0 for r in out)


def test_the_donor_is_a_value_of_the_rows(rows):
    d = ml.one_donor(rows, "id", FEATURES).first()
    assert rows.where(F.col("price") == d["price"]).count() == 1
    assert ml.one_donor(rows.repartition(7), "id", FEATURES).first() == d
