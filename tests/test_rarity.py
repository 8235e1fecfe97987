"""Rows by rare patterns, third by third, against a plain walk."""

import hashlib
import random

import pytest

from colsense.functions import patterns as P
from colsense.operators import sampling

VALUES = ["555-12-3456", "2024-02-29", "10.0.0.255", "a@b.co", "https://x.y", "1.2.3", "plain", "12345", "USD", "4111111111111111"]


def fits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    return {r["v"]: [p for p in P.PATTERNS if r[p]] for r in df.select("v", *[P.matches(F.col("v"), p).alias(p) for p in P.PATTERNS]).collect()}


def plain(rows, k, iteration, fit):
    """rows: (key, value) of a group."""
    if len(rows) <= k:
        return {key for key, _ in rows}, None
    by_length = sorted(rows, key=lambda r: (len(r[1]), r[0]))
    n = len(rows)
    bins = [b for b in (by_length[: n // 3], by_length[n // 3 : 2 * n // 3], by_length[2 * n // 3 :]) if b]
    hits = {}
    for _, v in rows:
        for p in fit.get(v, []):
            hits[p] = hits.get(p, 0) + 1
    per = max(1, k // len(bins))
    over, chosen = k - per * len(bins), []
    for i, b in enumerate(bins):
        ranked = sorted(b, key=lambda r: (-round(sum(1 / hits[p] for p in fit.get(r[1], [])), 12), r[0]))
        share = min(per + (i < over), len(b))
        chosen += [ranked[(iteration * share + j) % len(b)][0] for j in range(share)]
    chosen = list(dict.fromkeys(chosen))
    rest = sorted((x for x, _ in rows if x not in chosen), key=lambda x: hashlib.md5(f"{iteration}:{x}".encode()).hexdigest())
    return set((chosen + rest)[:k]), chosen[:k]


@pytest.mark.parametrize(("k", "iteration"), [(6, 0), (6, 1), (7, 5), (1, 2), (2, 0), (10, 3)])
def test_rows(spark, k, iteration):
    rng = random.Random(7)
    rows = [(g, i, rng.choices(VALUES, weights=range(1, len(VALUES) + 1))[0] + ("" if rng.random() < 0.7 else "x" * rng.randrange(9))) for g, n in (("a", 80), ("b", 11), (None, 30), ("c", 4), ("d", 1), ("e", 2)) for i in range(n)]
    fit = fits(spark)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "g string, id long, v string")
    other = df.select("v").distinct().select("v", *[P.matches(F.col("v"), p).alias(p) for p in P.PATTERNS]).collect()
    fit |= {r["v"]: [p for p in P.PATTERNS if r[p]] for r in other}
    got = {}
    for r in sampling.rarest_rows(df, ["g"], "v", "id", k, iteration).collect():
        got.setdefault(r["g"], []).append((r["place"], r["id"]))
    for g in {r[0] for r in rows}:
        want, order = plain([(i, v) for x, i, v in rows if x == g], k, iteration, fit)
        assert {i for _, i in got[g]} == want, g
        if order:
            assert [i for _, i in sorted(got[g])][: len(order)] == order


def test_rotation_comes_round(spark):
    df = spark.createDataFrame([("g", i, "2024-02-29" if i % 7 == 0 else "w" * (i % 5)) for i in range(60)], "g string, id long, v string")
    seen = set()
    for it in range(10):
        seen |= {r["id"] for r in sampling.rarest_rows(df, ["g"], "v", "id", 6, it).collect()}
    assert seen == set(range(60))
