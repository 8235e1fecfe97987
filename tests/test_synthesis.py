"""Synthetic columns: draws from a plain copy of the rules, formats that their own patterns know, the same rows on each run."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from colsense.operators import synthesis as Y

SHAPES = {
    0: r"\d{3}-\d{2}-\d{4}", 2: r"4\d{15}", 3: r"GB\d{2}NWBK\d{14}", 4: r"\d+(000|500)\.00", 5: r"[A-Z]{2}\d{7}", 8: r"35\d{13}", 9: r"([0-9a-f]{2}:){5}[0-9a-f]{2}", 10: r"10(\.\d{1,3}){3}", 11: r"user\d+@example\.(com|org|net)", 12: r"\+1-555-\d{3}-\d{4}",
    14: r"202\d-\d{2}-\d{2}", 15: r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}", 17: r"\$\d+\.\d{2}", 18: "true|false", 28: r"\d\.\d+\.\d+", 29: "[0-9a-f]{40}", 30: r"CODE-\d{3}",
}


def draw(place, slot):
    return int(hashlib.md5(f"{place}:{slot}".encode()).hexdigest()[:15], 16)


def plain_varied(place, value):
    try:
        x = float(value.replace(",", ""))
    except ValueError:
        x = None
    if x is not None:
        moved = x * (1 + (draw(place, "jitter") % 2001 - 1000) / 10000)
        if not re.search("[.eE]", value):
            return str(int(moved))
        cents = int(round(abs(moved), 9) * 100 + 0.5)
        return f"{'-' if moved < 0 else ''}{cents // 100}.{cents % 100:02d}"
    if len(value) > 3 and draw(place, "edit") % 10 < 3:
        k = draw(place, "at") % len(value)
        c = value[k]
        c = Y.LETTERS[draw(place, "letter") % 52] if re.match("[A-Za-z]", c) else str(draw(place, "digit") % 10) if c.isascii() and c.isdigit() else c
        return value[:k] + c + value[k + 1 :]
    return value


def test_every_format(spark):
    df = spark.range(60).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("p"))
    rows = df.select(*[Y.formatted(F.col("p"), form).alias(f"c{k}") for k, (_, form) in enumerate(Y.FORMATS)]).collect()
    for k, (_, form) in enumerate(Y.FORMATS):
        got = [r[f"c{k}"] for r in rows]
        assert all(got) and len(set(got)) > 1, form
        assert not any("{" in x for x in got)
        if k in SHAPES:
            assert all(re.fullmatch(SHAPES[k], x) for x in got), (form, got[:3])
    ip = [r["c10"].split(".") for r in rows]
    assert all(0 <= int(x) <= 255 for p in ip for x in p)


@pytest.mark.parametrize(("text", "form"), [("Social Security number", 0), ("Card number", 2), ("E-Mail of the payer", 11), ("birth date", 14), ("nation", 21), ("Order status", 24), ("customer id", 30), ("colour", None), ("", None), (None, None)])
def test_the_first_words_that_fit_count(spark, text, form):
    assert spark.range(1).select(Y.suggested(F.lit(text).cast("string"))).first()[0] == form


def test_varied_values(spark):
    values = ["12", "1,250", "-3.5", "0.125", "1e3", "abc", "abcd", "Straße 7", "x-99 z", "éééé", "2024-02-29", "nope", "12345678"]
    rows = [(f"q{i}:{v}", v) for v in values for i in range(40)]
    got = spark.createDataFrame(rows, "p string, v string").select("p", "v", Y.varied(F.col("p"), F.col("v")).alias("x")).collect()
    assert [r["x"] for r in got] == [plain_varied(r["p"], r["v"]) for r in got]
    assert any(r["x"] != r["v"] for r in got if r["v"] == "abcd") and all(r["x"] == r["v"] for r in got if r["v"] == "abc")


def test_columns(spark):
    nodes = spark.createDataFrame([("1", "Home Address", "ADDR", ["postal address"]), ("2", "Colour", None, None), ("3", "Shade", "SH", []), ("4", "E-mail", "MAIL", ["mail"])], "code string, label string, mnemonic string, aliases array<string>")
    protos = spark.createDataFrame([("3", v) for v in ("red", "green", "blue", "green", None, "")] + [("2", "a"), ("2", "b")], "code string, value string")
    make = lambda n: Y.columns(nodes, n, copies=3, rows=30, seed=5, width=2)
    got = make(protos).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, make(protos.repartition(5)).collect()))
    cols = {(r["code"], r["table"], r["column"], r["kind"]) for r in got}
    assert {(c, k) for c, _, _, k in cols} == {("1", "inferred"), ("3", "template"), ("4", "inferred")}
    assert len(got) == 3 * 3 * 30 and {t for _, t, _, _ in cols} == {f"synth_{k:05d}" for k in range(5)}
    near = {"red", "green", "blue"}
    assert all(r["value"] in near or sum(a != b for a, b in zip(r["value"], max(near, key=lambda x: (len(x) == len(r["value"]), sum(a == b for a, b in zip(x, r["value"])))))) == 1 for r in got if r["code"] == "3")
    assert Y.columns(nodes.where("false"), protos, 2, 3).count() == 0


def test_names(spark):
    rows = spark.range(400).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("p")).select(Y.named(F.col("p"), F.lit("Home Address"), F.lit("ADDR"), F.array(F.lit("postal address")), 0.25).alias("x")).collect()
    telling = {"home_address", "homeAddress", "HOME_ADDRESS", "addr", "ADDR", "postal_address", "postalAddress", *[p + "home_address" for p in Y.PREFIXES]}
    found = [r["x"] for r in rows]
    dark = [x for x in found if x not in telling]
    assert set(found) - set(dark) == telling
    assert 60 < len(dark) < 140 and all(re.fullmatch(r"(col|attr|field|var|item|key|ref|val)_([a-z]{0,2}\d{1,3}|\d_\d)", x) for x in dark)
