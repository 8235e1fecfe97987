import pytest
from pyspark.sql import functions as F

from colsense.functions import patterns as P
from colsense.operators import profile


@pytest.mark.parametrize(
    ("pattern", "value", "fits"),
    [
        ("credit_card_pattern", "4111111111111111", True), ("credit_card_pattern", "5500000000000004", True), ("credit_card_pattern", "1234567890123", False), ("credit_card_pattern", "1111111111111", False),
        ("ipv4_pattern", "10.0.0.255", True), ("ipv4_pattern", "999.999.999.999", False), ("ipv4_pattern", "256.1.1.1", False),
        ("date_iso_pattern", "2024-02-29", True), ("date_iso_pattern", "1234-99-7890", False),
        ("iso_currency_pattern", "USD", True), ("iso_currency_pattern", "ABC", False), ("iata_pattern", "LAX", True), ("iata_pattern", "XYZ", False),
        ("vin_pattern", "1HGCM82633A004352", True), ("monetary_pattern", "€ 12.50", True), ("phone_pattern", "75000", False), ("phone_pattern", "555-123-4567", True),
        ("udid_pattern", "a" * 40, True), ("mrn_pattern", "mrn-12345", True),
    ],
)
def test_matches(spark, pattern, value, fits):
    assert spark.range(1).select(P.matches(F.lit(value), pattern)).first()[0] is fits


@pytest.mark.parametrize(("value", "number"), [("1,234.5", True), ("1d", False), ("1_000", True), ("", False), ("nan", True), ("-.5e3", True), ("1__0", False)])
def test_numbers(spark, value, number):
    assert spark.range(1).select(P.numeric(F.lit(value))).first()[0] is number


def test_firing_and_phones(spark):
    cells = spark.createDataFrame([("t", "c", 0, "s", k, v) for k, v in enumerate(["555-12-3456", "555-12-3457", "x"])], "`table` string, `column` string, ord int, column_type string, row_ix long, value string")
    assert [r["pattern"] for r in profile.fired(profile.pattern_counts(cells)).collect()] == ["ssn_pattern"]


@pytest.mark.parametrize(("at", "want"), [(5, "3,4,6,7"), (1, "0,2,3,4"), (9, "5,6,7,8"), (0, "1,2,3,4")])
def test_closest_siblings(spark, at, want):
    shapes = spark.createDataFrame([("t", str(k), k) for k in range(10)], "`table` string, `column` string, ord int")
    got = profile.closest_siblings(shapes).where(F.col("column") == str(at)).first()["siblings"]
    assert got == want


def test_empty_and_null_columns(spark):
    cells = spark.createDataFrame([("t", "c", 0, "s", 1, None)], "`table` string, `column` string, ord int, column_type string, row_ix long, value string")
    row = profile.profile(cells).first()
    assert (row["n_rows"], row["n_nulls"], row["null_ratio"], row["cardinality"], row["avg_value_length"]) == (1, 1, 1.0, 0, None)
    assert profile.fired(profile.pattern_counts(cells)).count() == 0
    assert profile.profile(cells.limit(0)).count() == 0
