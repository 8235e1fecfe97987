"""Attribution for each row: values add up to what all features together change; donors are other rows."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from colsense.operators import ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(k, (label := "ab"[k % 2]), [label + str(rng.randrange(3)), "x"], float(rng.randrange(9)), k % 2 + rng.random()) for k in range(240)]
    return spark.createDataFrame(data, "id long, label string, tokens array<string>, noise double, size double").cache()


def test_donors(rows):
    got = ml.donors(rows, "id", ["id", "size"], 3, group=20)
    pairs = {(r["id"], r["donor"]["id"]) for r in got.collect()}
    assert len(pairs) == 240 and len({d for _, d in pairs}) == 240 and all(a != b for a, b in pairs)


def test_values_add_up(rows):
    features = ["tokens", "noise", "size"]
    model = ml.fit_to_votes(ml.forest(["tokens"], ["noise", "size"]), rows)
    got = ml.row_attribution(model, rows, "id", features, rounds=1, keep=9)
    assert got.count() == 3 * 240 and got.where("rank > 3").count() == 0
    classes = ml.predictions(model, rows).select("id", F.col("prediction").cast("int").alias("c"))
    p = F.get(vector_to_array("probability"), F.col("c"))
    base = rows.join(classes, "id")
    own = model.transform(base.withColumn("weight", F.lit(1.0))).select("id", p.alias("own"))
    given = ml.donors(base, "id", features, 0)
    swapped = given.withColumns({f: F.col(f"donor.{f}") for f in features})
    other = model.transform(swapped.withColumn("weight", F.lit(1.0))).select("id", p.alias("other"))
    sums = got.groupBy("id").agg(F.sum("value").alias("s")).join(own, "id").join(other, "id")
    assert sums.where("abs(s - (own - other)) > 1e-9").count() == 0
    mean = {r["feature"]: r["v"] for r in got.groupBy("feature").agg(F.avg(F.abs("value")).alias("v")).collect()}
    assert mean["noise"] < min(mean["tokens"], mean["size"])
