"""Queries of column profiles (F), projections and predicates (P)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colsense.functions import patterns as P
from colsense.operators import profile
from colsense.sources import cells as C

from . import query
from .inputs import CELLS, TOKENS, cells, read, token_cells

KEY = '"table", "column"'


def _re(pattern: str) -> str:
    return pattern.replace("'", "''").replace("\\€", "€").replace("\\£", "£")


@query("f01_counts", f"WITH {CELLS} SELECT {KEY}, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_nulls, round(count(*) FILTER (WHERE value IS NULL) / count(*), 4) AS null_ratio FROM cells GROUP BY 1, 2")
def f01(spark, d):
    return profile.counts(cells(spark, d))


@query("f02_cardinality", f"WITH {CELLS} SELECT {KEY}, count(DISTINCT value) AS cardinality FROM cells GROUP BY 1, 2")
def f02(spark, d):
    return profile.cardinality(cells(spark, d))


_ENTROPY = f"lens AS (SELECT {KEY}, length(value) AS l, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY 1, 2, 3)"


@query("f03_length_entropy", f"WITH {CELLS}, {_ENTROPY} SELECT {KEY}, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS value_entropy FROM lens GROUP BY 1, 2")
def f03(spark, d):
    return profile.length_entropy(cells(spark, d))


@query(
    "f04_f05_lengths_and_numbers",
    f"WITH {TOKENS} SELECT {KEY}, round(sum(length(value)) / count(value), 2) AS avg_value_length, round(count(*) FILTER (WHERE regexp_full_match(replace(value, ',', ''), '{P.NUMBER[0:4] + P.NUMBER[5:-1]}')) / count(value), 4) AS numeric_ratio FROM cells GROUP BY 1, 2",
)
def f04_f05(spark, d):
    return profile.lengths_and_numbers(token_cells(spark, d))


_FIRST = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY row_ix, value) AS k FROM cells WHERE value IS NOT NULL)"


@query("f06_value_text", f"WITH {CELLS}, {_FIRST} SELECT {KEY}, string_agg(left(value, 80), ', ' ORDER BY row_ix, value) AS sample_values_text FROM ranked WHERE k <= 5 GROUP BY 1, 2")
def f06(spark, d):
    return C.first_values(cells(spark, d), 5).select("table", "column", profile.value_text(F.col("values")).alias("sample_values_text"))


def _valid(name: str) -> str:
    luhn = "(list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (CAST(v[-i] AS INT) * 2) // 10 + (CAST(v[-i] AS INT) * 2) % 10 ELSE CAST(v[-i] AS INT) END)) % 10 = 0)"
    date = "(coalesce(try_cast(substr(v, 6, 2) AS INT) BETWEEN 1 AND 12 AND try_cast(substr(v, 9, 2) AS INT) BETWEEN 1 AND 31, false))"
    many = lambda xs: "v IN (" + ", ".join(f"'{x}'" for x in xs) + ")"
    return {
        "credit_card_pattern": luhn, "iccid_pattern": luhn, "imei_pattern": luhn, "date_iso_pattern": date, "datetime_iso_pattern": date,
        "ipv4_pattern": "len(list_filter(string_split(v, '.'), lambda p: coalesce(try_cast(p AS INT), 999) > 255)) = 0",
        "iso_currency_pattern": many(P.CURRENCIES), "iata_pattern": many(P.AIRPORTS), "vin_pattern": "NOT regexp_matches(upper(v), '[IOQ]')",
    }.get(name, "true")


_HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT {KEY}, '{name}' AS pattern, n, count(*) AS hits FROM t WHERE CASE WHEN regexp_matches(v, '{_re(p)}') THEN {_valid(name)} ELSE false END GROUP BY 1, 2, 3, 4" for name, p in P.PATTERNS.items()
) + ")"
_TRIMMED = f"t AS (SELECT {KEY}, trim(value) AS v, count(*) OVER (PARTITION BY {KEY}) AS n FROM cells WHERE value IS NOT NULL)"
_FIRED = "strong AS (SELECT * FROM hits WHERE hits >= greatest(1, n // 3)), fired AS (SELECT \"table\", \"column\", pattern, hits / n AS fraction FROM strong s WHERE pattern <> 'phone_pattern' OR NOT EXISTS (SELECT 1 FROM strong x WHERE x.\"table\" = s.\"table\" AND x.\"column\" = s.\"column\" AND x.pattern IN (" + ", ".join(f"'{p}'" for p in P.PHONE_SUPPRESSORS) + ")))"


@query("f07_f13_pattern_counts", f"WITH {TOKENS}, {_TRIMMED}, {_HITS} SELECT {KEY}, n, pattern, hits FROM hits")
def f07(spark, d):
    return profile.pattern_counts(token_cells(spark, d))


@query("f08_f09_fired_patterns", f"WITH {CELLS}, {_TRIMMED}, {_HITS}, {_FIRED} SELECT {KEY}, pattern, round(fraction, 6) AS fraction FROM fired")
def f08(spark, d):
    return profile.fired(profile.pattern_counts(cells(spark, d))).withColumn("fraction", F.round("fraction", 6))


_ENUM_CELLS = "cells AS (SELECT 'orders' AS \"table\", 'letter' AS \"column\", o_orderkey AS row_ix, chr(CAST(65 + o_orderkey % 2 AS INT)) AS value FROM orders UNION ALL SELECT 'events', 'flag', event_id, CASE WHEN value > 20 THEN 'yes' ELSE 'no' END FROM events UNION ALL SELECT 'orders', 'priority', o_orderkey, split_part(o_orderpriority, '-', 2) FROM orders)"
_ENUMS = " UNION ALL ".join(f"SELECT {KEY}, '{e}' AS enum, count(*) AS d, count(*) FILTER (WHERE v IN ({', '.join(chr(39) + x + chr(39) for x in xs)})) AS o, sum(n) AS filled FROM vals GROUP BY 1, 2" for e, xs in P.ENUMS.items())


def _enum_cells(spark, d):
    o, e = read(spark, d, "orders"), read(spark, d, "events")
    one = lambda df, t, c, key, v: df.select(F.lit(t).alias("table"), F.lit(c).alias("column"), F.col(key).alias("row_ix"), v.alias("value"))
    letters = one(o, "orders", "letter", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B"))
    flags = one(e, "events", "flag", "event_id", F.when(F.col("value") > 20, "yes").otherwise("no"))
    return letters.union(flags).union(one(o, "orders", "priority", "o_orderkey", F.split("o_orderpriority", "-")[1]))


@query(
    "f14_enums",
    f"WITH {_ENUM_CELLS}, vals AS (SELECT {KEY}, upper(trim(value)) AS v, count(*) AS n FROM cells WHERE trim(value) <> '' GROUP BY 1, 2, 3), e AS ({_ENUMS}) SELECT {KEY}, enum, round(o / d, 6) AS fraction FROM e WHERE filled >= 3 AND o > 0 AND o / d >= 0.7",
)
def f14(spark, d):
    return profile.enums(_enum_cells(spark, d))


_SHAPES = "shapes AS (SELECT DISTINCT \"table\", CASE \"column\" WHEN 'c_name' THEN 'customer_name' WHEN 'c_mktsegment' THEN 'region_state' WHEN 'p_brand' THEN 'city_zip' WHEN 'p_type' THEN 'country_code' ELSE \"column\" END AS \"column\", ord FROM cells)"


def _shapes(spark, d):
    c = F.col("column")
    name = F.when(c == "c_name", "customer_name").when(c == "c_mktsegment", "region_state").when(c == "p_brand", "city_zip").when(c == "p_type", "country_code").otherwise(c)
    return cells(spark, d).select("table", name.alias("column"), "ord").distinct()


_DOMAINS = " UNION ALL ".join(f"SELECT {KEY}, '{x}' AS domain, {len(ws)} AS size, len(list_filter(words, lambda w: w IN ({', '.join(chr(39) + w + chr(39) for w in ws)}))) AS hits FROM w" for x, ws in P.DOMAINS.items())


@query(
    "f15_sibling_domains",
    f"WITH {CELLS}, {_SHAPES}, w AS (SELECT a.{KEY.split(',')[0]}, a.\"column\", list_distinct(string_split(string_agg(replace(lower(b.\"column\"), '_', ' '), ' '), ' ')) AS words FROM shapes a JOIN shapes b ON a.\"table\" = b.\"table\" AND a.\"column\" <> b.\"column\" GROUP BY 1, 2), x AS ({_DOMAINS}) SELECT {KEY}, domain, round(hits / size, 6) AS score FROM x WHERE hits >= 2",
)
def f15(spark, d):
    return profile.sibling_domains(_shapes(spark, d))


@query(
    "f16_closest_siblings",
    f"WITH {CELLS}, shapes AS (SELECT DISTINCT {KEY}, ord FROM cells), near AS (SELECT a.\"table\", a.\"column\", b.\"column\" AS other, b.ord AS oo, row_number() OVER (PARTITION BY a.\"table\", a.\"column\" ORDER BY abs(a.ord - b.ord), b.ord) AS k FROM shapes a JOIN shapes b ON a.\"table\" = b.\"table\" AND a.ord <> b.ord) SELECT {KEY}, string_agg(other, ',' ORDER BY oo) AS siblings FROM near WHERE k <= 1 GROUP BY 1, 2",
)
def f16(spark, d):
    return profile.closest_siblings(cells(spark, d).select("table", "column", "ord").distinct(), 1)


_DESC = f"""base AS (SELECT {KEY}, count(*) AS n, sum(length(value)) / count(*) AS len, round(count(*) FILTER (WHERE regexp_full_match(replace(value, ',', ''), '{P.NUMBER[0:4] + P.NUMBER[5:-1]}')) / count(*), 4) AS num, bool_or(contains(value, '.')) AS dot, count(DISTINCT value) AS dist FROM cells WHERE value IS NOT NULL GROUP BY 1, 2),
 has AS (SELECT {KEY}, list(pattern) AS p FROM fired GROUP BY 1, 2)
 SELECT {KEY}, CASE WHEN list_contains(p, 'datetime_iso_pattern') THEN 'column of datetime/timestamp values' WHEN list_contains(p, 'date_iso_pattern') THEN 'column of date values in YYYY-MM-DD format' WHEN list_contains(p, 'email_pattern') THEN 'column of email addresses' WHEN list_contains(p, 'url_pattern') THEN 'column of URLs or web links' WHEN list_contains(p, 'uuid_pattern') THEN 'column of UUID identifiers'
 WHEN num > 0.8 AND dot THEN 'column of decimal numeric measurements' WHEN num > 0.8 THEN 'column of integer values' WHEN len > 100 THEN 'column of long text content, descriptions or comments' WHEN len > 40 THEN 'column of text phrases or sentences' WHEN dist / n < 0.5 AND len < 20 THEN 'column of categorical labels or codes' WHEN len < 20 AND num < 0.2 THEN 'column of short text labels or names' ELSE 'column of text values' END AS description
 FROM base LEFT JOIN has USING ("table", "column")"""


@query("f17_descriptions", f"WITH {CELLS}, {_TRIMMED}, {_HITS}, {_FIRED}, {_DESC}")
def f17(spark, d):
    return profile.descriptions(cells(spark, d))


@query(
    "f17_sequential",
    "SELECT 'customer' AS \"table\", 'key' AS \"column\", count(*) >= 3 AND max(s) - min(s) < 0.01 AS sequential FROM (SELECT c_custkey - lag(c_custkey) OVER (ORDER BY c_custkey) AS s FROM customer) UNION ALL SELECT 'customer', 'balance', max(s) - min(s) < 0.01 AND bool_and(b = floor(b)) FROM (SELECT c_acctbal AS b, c_acctbal - lag(c_acctbal) OVER (ORDER BY c_custkey) AS s FROM customer)",
)
def f17_sequential(spark, d):
    c = read(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("row_ix"), F.inline(F.array(F.struct(F.lit("key").alias("column"), F.col("c_custkey").cast("string").alias("value")), F.struct(F.lit("balance").alias("column"), F.col("c_acctbal").cast("string").alias("value")))))
    return profile.sequential(rows.withColumn("table", F.lit("customer")))


@query("f19_f21_f22_features")
def f19(spark, d):
    """The full feature record with its texts; the parts have SQL of their own."""
    rows = profile.features(cells(spark, d))
    return rows.select("table", "column", "cardinality", "n_rows", "siblings", profile.embedding_text().alias("embedding_text"), profile.short_text().alias("short_text"), profile.typed_segments().alias("segments"))


@query("f20_f23_masked_text", f"WITH {CELLS}, {_FIRST}, t AS (SELECT {KEY}, string_agg(left(value, 80), ', ' ORDER BY row_ix, value) AS s FROM ranked WHERE k <= 5 GROUP BY 1, 2) SELECT {KEY}, replace(\"column\", '_', ' ') || ' | ' || s || ' | table=' || \"table\" AS text FROM t")
def f20(spark, d):
    """Only name, values and table are enabled."""
    mask = {f: f in ("column_name", "sample_values", "source_table") for f in profile.FEATURES}
    return profile.features(cells(spark, d)).select("table", "column", profile.embedding_text(mask).alias("text"))


@query(
    "f24_distinct_sample",
    f"WITH {CELLS}, firsts AS (SELECT {KEY}, value, min(row_ix) AS r FROM cells WHERE value IS NOT NULL AND row_ix < 100 GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY r, value) AS k FROM firsts) SELECT {KEY}, string_agg(value, '|' ORDER BY r, value) AS sample FROM k WHERE k <= 5 GROUP BY 1, 2",
)
def f24(spark, d):
    return C.first_values(cells(spark, d).where("row_ix < 100"), 5, distinct=True).select("table", "column", F.array_join("values", "|").alias("sample"))


@query(
    "p01_p02_eligible_columns",
    f"WITH {CELLS}, c AS (SELECT DISTINCT {KEY} FROM cells) SELECT {KEY} FROM c WHERE NOT (lower(\"table\") IN ('region', 'annotations') OR regexp_matches(lower(\"table\"), '^_*tmp_')) AND NOT regexp_matches(\"column\", '{P.ANSWER_COLUMN}')",
)
def p01(spark, d):
    """Vocabulary and temporary tables and answer columns are left out."""
    c = cells(spark, d).select("table", "column").distinct()
    t = F.lower("table")
    return c.where(~(t.isin("region", "annotations") | t.rlike("^_*tmp_")) & ~P.answer_column(F.col("column")))


@query("p03_p04_names", f"WITH {CELLS}, c AS (SELECT DISTINCT \"table\" || '.' || \"column\" AS q FROM cells) SELECT q AS qualified, regexp_replace(q, '^[^.]*\\.', '') AS bare, replace(replace(lower(trim(regexp_replace(q, '^.*\\.', ''))), '''', ''), ' ', '_') AS record_key FROM c")
def p03(spark, d):
    c = cells(spark, d).select(F.concat_ws(".", "table", "column").alias("qualified")).distinct()
    key = F.translate(F.lower(F.trim(F.regexp_replace("qualified", r"^.*\.", ""))), " '", "_")
    return c.select("qualified", F.regexp_replace("qualified", r"^[^.]*\.", "").alias("bare"), key.alias("record_key"))


@query("p06_types", "SELECT * FROM (VALUES ('bigint', 'integer', 2), ('double', 'decimal', 1), ('int', 'integer', 1), ('string', NULL, 2)) t(raw, canonical, n)")
def p06(spark, d):
    rows = C.table_shapes({"part": read(spark, d, "part")})
    extra = C.table_shapes({"events": read(spark, d, "events").select("event_id", "event_type")}).where("type <> 'string'")
    rows = rows.union(extra).where("`column` <> 'p_name'")
    return rows.groupBy(F.col("type").alias("raw"), P.canonical_type(F.col("type")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


_INFER = f"head AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY row_ix, value) AS k FROM cells)"


@query(
    "p07_inferred_types",
    f"WITH {TOKENS}, {_INFER}, s AS (SELECT \"column\", count(*) FILTER (WHERE regexp_full_match(trim(value), '[+-]?[0-9]+')) / count(*) AS i, count(*) FILTER (WHERE regexp_full_match(trim(value), '[+-]?[0-9]*\\.?[0-9]+')) / count(*) AS f FROM head WHERE k <= 20 GROUP BY 1) SELECT \"column\", CASE WHEN i > 0.8 THEN 'INTEGER' WHEN f > 0.8 THEN 'DECIMAL' ELSE 'VARCHAR' END AS inferred FROM s",
)
def p07(spark, d):
    """A type by the first 20 values of each column: more than 80 % must parse."""
    by = Window.partitionBy("column").orderBy("row_ix", "value")
    head = token_cells(spark, d).withColumn("k", F.row_number().over(by)).where("k <= 20")
    share = lambda p: F.count_if(F.trim("value").rlike(p)) / F.count(F.lit(1))
    s = head.groupBy("column").agg(share("^[+-]?[0-9]+$").alias("i"), share(r"^[+-]?[0-9]*\.?[0-9]+$").alias("f"))
    return s.select("column", F.when(F.col("i") > 0.8, "INTEGER").when(F.col("f") > 0.8, "DECIMAL").otherwise("VARCHAR").alias("inferred"))


@query("p08_generic_names", "SELECT count(*) FILTER (WHERE regexp_matches(n, '(?i)^(col\\d*|column\\d*|field\\d*|var\\d*|unnamed.*|\\d+|_|)$')) AS generic, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Col' || p_partkey WHEN p_partkey % 3 = 1 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS n FROM part)")
def p08(spark, d):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("Col"), F.col("p_partkey"))).when(k == 1, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return read(spark, d, "part").agg(F.count_if(P.generic_name(name)).alias("generic"), F.count(F.lit(1)).alias("n"))


@query("p09_placeholders", "WITH v AS (SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 OR c_nationkey % 2 = 0 THEN 'Some Title ' || c_custkey ELSE c_name END AS v FROM customer) SELECT c_nationkey, count(*) FILTER (WHERE regexp_matches(v, '^[A-Z][A-Za-z]*( [A-Z][A-Za-z]*)* \\d+$')) * 2 >= count(*) AS placeholder FROM v GROUP BY 1")
def p09(spark, d):
    c = read(spark, d, "customer")
    v = F.when((F.col("c_custkey") % 3 == 0) | (F.col("c_nationkey") % 2 == 0), F.concat(F.lit("Some Title "), F.col("c_custkey"))).otherwise(F.col("c_name"))
    return c.groupBy("c_nationkey").agg((F.count_if(v.rlike(r"^[A-Z][A-Za-z]*( [A-Z][A-Za-z]*)* \d+$")) * 2 >= F.count(F.lit(1))).alias("placeholder"))


@query("s04_s05_s14_samples", f"WITH {CELLS}, {_FIRST}, f AS (SELECT {KEY}, string_agg(value, '|' ORDER BY row_ix, value) AS v FROM ranked WHERE k <= 5 GROUP BY 1, 2), sib AS (SELECT \"table\", string_agg(c, ',' ORDER BY o) AS siblings FROM (SELECT \"table\", \"column\" AS c, min(ord) AS o FROM cells GROUP BY 1, 2) GROUP BY 1) SELECT c.\"table\", c.\"column\", count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_nulls, max(v) AS first_values, max(siblings) AS siblings FROM cells c LEFT JOIN f ON f.\"table\" = c.\"table\" AND f.\"column\" = c.\"column\" JOIN sib ON sib.\"table\" = c.\"table\" GROUP BY 1, 2")
def s04(spark, d):
    return C.samples(cells(spark, d)).select("table", "column", "n_rows", "n_nulls", F.array_join("values", "|").alias("first_values"), F.array_join("siblings", ",").alias("siblings"))


@query("s06_s22_inventory", "SELECT * FROM (VALUES ('customer', 5), ('nation', 3), ('region', 2)) t(\"table\", n_columns) JOIN (SELECT 'customer' AS \"table\", count(*) AS n_rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region) USING (\"table\")")
def s06(spark, d):
    tables = {t: read(spark, d, t) for t in ("customer", "nation", "region")}
    shape = C.table_shapes(tables).groupBy("table").agg(F.count(F.lit(1)).alias("n_columns"))
    rows = None
    for t, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table"), "n_rows")
        rows = part if rows is None else rows.union(part)
    return shape.join(rows, "table")
