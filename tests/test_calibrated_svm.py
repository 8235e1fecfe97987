"""The calibrated linear classifier: grams as a plain loop makes them, held-out accuracy and calibration."""

import random

import pytest
from pyspark.sql import functions as F

from colsense.operators import ml


def plain(words, low=3, high=6):
    out = []
    for w in dict.fromkeys(words):
        w = f" {w} "
        out += list(dict.fromkeys(g for n in range(low, high + 1) for g in ([w[i : i + n] for i in range(len(w) - n + 1)] or [w])))
    return out


def test_grams(spark):
    texts = ["Naïve cats, a cat!", "x", "", None, "one_two 3.5"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(ml.text_words(F.col("t")).alias("w")).select("w", ml.char_grams(F.col("w")).alias("c"), ml.word_grams(F.col("w")).alias("g")).collect()
    assert [r["w"] for r in rows] == [["naïve", "cats", "a", "cat"], ["x"], [], [], ["one_two", "3", "5"]]
    for r in rows:
        assert r["c"] == plain(r["w"])
        assert r["g"] == r["w"] + [f"{a} {b}" for a, b in zip(r["w"], r["w"][1:])]


@pytest.fixture(scope="module")
def scored(spark):
    """Texts of three classes whose words overlap so much that some cannot be told apart."""
    rng = random.Random(6)
    words = {c: [f"{c}{k}{c}" for k in range(12)] for c in "abc"}
    common = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(900):
        label = rng.choice("aab" "bc")
        n = rng.choice([0, 1, 1, 2, 3])
        own = [rng.choice(words[label if rng.random() < 0.8 else rng.choice("abc")]) for _ in range(n)]
        rows.append((k, label if k % 50 else None, " ".join(rng.sample(own + rng.sample(common, 8), len(own) + 8))))
    df = spark.createDataFrame(rows, "id long, label string, text string")
    model = ml.calibrated_svm(df.where("id % 3 > 0"), "id", features=3000)
    return model.probabilities(df.where("id % 3 = 0 AND label IS NOT NULL")).collect(), model


def test_held_out_accuracy_and_calibration(scored):
    rows, model = scored
    assert model.labels == ["a", "b", "c"]
    hit = [r["pred"] == r["label"] for r in rows]
    assert sum(hit) / len(hit) > 0.68
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and max(r["p"]) == r["p"]["abc".index(r["pred"])] for r in rows)
    bins = {}
    for r, h in zip(rows, hit):
        bins.setdefault(min(int(max(r["p"]) * 5), 4), []).append((max(r["p"]), h))
    error = sum(abs(sum(p for p, _ in b) - sum(h for _, h in b)) for b in bins.values()) / len(rows)
    assert error < 0.1
    sure = [h for r, h in zip(rows, hit) if max(r["p"]) > 0.8]
    assert len(sure) > 50 and sum(sure) / len(sure) > 0.8


def test_odd_texts(spark, scored):
    _, model = scored
    rows = model.probabilities(spark.createDataFrame([(1, None), (2, ""), (3, "zzz")], "id long, text string")).collect()
    assert all(r["pred"] in "abc" and abs(sum(r["p"]) - 1) < 1e-9 for r in rows)
    with pytest.raises(ValueError, match="two classes"):
        ml.calibrated_svm(spark.createDataFrame([(1, "a", "x y"), (2, "a", "x y")], "id long, label string, text string"), "id")
