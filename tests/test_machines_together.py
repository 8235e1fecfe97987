"""The machines of the calibrated classifier share their passes over the rows, and find what plain loops find."""

import random

from colsense.operators import ml

from test_calibrated_svm import plain


def test_few_jobs(spark):
    """A pass is a step of all machines: jobs don't grow with classes times folds."""
    rng = random.Random(2)
    rows = [(k, "abcd"[k % 4], " ".join(rng.choice(["abcd"[k % 4] * 5, *"wxyz"]) for _ in range(9))) for k in range(400)]
    sc = spark.sparkContext
    sc.setJobGroup("machines", "calibrated_svm")
    model = ml.calibrated_svm(spark.createDataFrame(rows, "id long, label string, text string"), "id", features=200)
    sc.setJobGroup("", "")
    assert model.labels == list("abcd")
    assert len(sc.statusTracker().getJobIdsForGroup("machines")) < 200


def test_finder():
    words = "the naïve cat the x a b".split()
    grams = sorted(set(plain(words)))[::2]
    pairs = ["a b", "cat", "the x", "no"]
    find = ml.finder({g: k for k, g in enumerate(grams)}, {g: k + len(grams) for k, g in enumerate(pairs)})
    want = [*range(len(grams)), len(grams), len(grams) + 1, len(grams) + 2]
    for _ in range(2):
        assert find(words).tolist() == want
        assert find([]).tolist() == []


def test_vocabulary(spark):
    texts = [["aa", "aa", "b"], ["aa", "b", "b", "c"], ["c", "c", "c", "d", "d"]]
    chars, words = ml.vocabulary(spark.createDataFrame([(k, w) for k, w in enumerate(texts)], "row long, words array<string>"), 3)
    assert words == ["c", "aa", "b"]  # 4 times, then 3 times each; d is in one row alone
    assert chars == [" aa", " aa ", " b "]
