"""Profiles of columns from long cells: counts, lengths, patterns, siblings, descriptions.

Every measure is an aggregate over (table, column) with partial sums in each task;
all of a column's measures come from one pass over its cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.functions import patterns as P
from colsense.sources.sinks import write_down

KEY = ["table", "column"]


def counts(cells: DataFrame) -> DataFrame:
    """Rows, nulls and null ratio (4 digits; null without rows)."""
    n, nulls = F.count(F.lit(1)), F.count_if(F.col("value").isNull())
    return cells.groupBy(*KEY).agg(n.alias("n_rows"), nulls.alias("n_nulls"), F.round(nulls / n, 4).alias("null_ratio"))


def cardinality(cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct non-null values, or the known count where a table (table, column, distinct_count) has one."""
    found = cells.groupBy(*KEY).agg(F.countDistinct("value").alias("cardinality"))
    if known is None:
        return found
    return found.join(known, KEY, "left").select(*KEY, F.coalesce("distinct_count", "cardinality").alias("cardinality"))


def length_entropy(cells: DataFrame) -> DataFrame:
    """Shannon entropy, in bits, of the lengths of the values."""
    by_length = cells.where("value IS NOT NULL").groupBy(*KEY, F.length("value").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    # -sum(p log p) = log(total) - sum(n log n) / total, so one aggregate is enough.
    return by_length.groupBy(*KEY).agg(F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 4).alias("value_entropy"))


def lengths_and_numbers(cells: DataFrame) -> DataFrame:
    """Mean length (2 digits) and share of values that are numbers (4 digits)."""
    v = F.col("value")
    return cells.where("value IS NOT NULL").groupBy(*KEY).agg(
        F.round(F.sum(F.length(v)) / F.count(v), 2).alias("avg_value_length"),
        F.round(F.count_if(P.numeric(v)) / F.count(v), 4).alias("numeric_ratio"),
    )


def values(cells: DataFrame) -> DataFrame:
    """(table, column, value, n): each distinct value once, so that what is costly is done once for each."""
    return cells.where("value IS NOT NULL").groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("n"))


def _hits() -> list[Column]:
    return [F.sum(F.when(P.matches(F.col("value"), name), F.col("n")).otherwise(0)).alias(name) for name in P.PATTERNS]


def pattern_counts(cells: DataFrame) -> DataFrame:
    """(table, column, n, pattern, hits): hits of each pattern that a value fits, tried on distinct values."""
    wide = values(cells).groupBy(*KEY).agg(F.sum("n").alias("n"), *_hits())
    return wide.unpivot([*KEY, "n"], list(P.PATTERNS), "pattern", "hits").where("hits > 0")


def fired(hits: DataFrame) -> DataFrame:
    """(table, column, pattern, fraction) of the patterns that a third of the values fit; phones give way to stricter patterns."""
    strong = hits.where(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("n") / 3)))
    strict = F.max(F.col("pattern").isin(*P.PHONE_SUPPRESSORS)).over(Window.partitionBy(*KEY))
    kept = strong.withColumn("strict", strict).where((F.col("pattern") != "phone_pattern") | ~F.col("strict"))
    return kept.select(*KEY, "pattern", (F.col("hits") / F.col("n")).alias("fraction"))


def enums(cells: DataFrame) -> DataFrame:
    """(table, column, enum, fraction): closed sets that hold at least 70 % of a column's distinct values."""
    v = F.upper(F.trim("value"))
    values = cells.where(F.trim("value") != "").groupBy(*KEY, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    inside = [F.count_if(F.col("v").isin(*members)).alias(name) for name, members in P.ENUMS.items()]
    wide = values.groupBy(*KEY).agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct"), *inside).where("filled >= 3")
    long = wide.unpivot([*KEY, "distinct"], list(P.ENUMS), "enum", "overlap")
    share = F.col("overlap") / F.col("distinct")
    return long.where((F.col("overlap") > 0) & (share >= 0.7)).select(*KEY, "enum", F.round(share, 6).alias("fraction"))


def sibling_domains(shapes: DataFrame) -> DataFrame:
    """(table, column, domain, score) from the words of the other columns' names; at least two must be the domain's."""
    words = F.array_distinct(F.flatten(F.transform("siblings", lambda s: F.split(F.lower(F.regexp_replace(s, "_", " ")), r"\s+"))))
    names = siblings(shapes).withColumn("words", words)
    tests = [F.struct(F.lit(d).alias("domain"), F.lit(len(k)).alias("size"), F.size(F.array_intersect("words", F.array(*map(F.lit, k)))).alias("hits")) for d, k in P.DOMAINS.items()]
    rows = names.select(*KEY, F.inline(F.array(*tests)))
    return rows.where("hits >= 2").select(*KEY, "domain", F.round(F.col("hits") / F.col("size"), 6).alias("score"))


def siblings(shapes: DataFrame) -> DataFrame:
    """(table, column, siblings): names of the other columns of the table, in order."""
    tables = shapes.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("ord", "column"))).alias("all"))
    return shapes.join(tables, "table").select(*KEY, F.transform(F.filter("all", lambda x: x["column"] != F.col("column")), lambda x: x["column"]).alias("siblings"))


def closest_siblings(shapes: DataFrame, k: int = 4) -> DataFrame:
    """(table, column, siblings): the k columns next to a column, left before right at the same distance, in column order."""
    other = shapes.select("table", F.col("column").alias("other"), F.col("ord").alias("other_ord"))
    pairs = shapes.join(other, "table").where(F.col("ord") != F.col("other_ord"))
    near = Window.partitionBy(*KEY).orderBy(F.abs(F.col("ord") - F.col("other_ord")), "other_ord")
    kept = pairs.withColumn("k", F.row_number().over(near)).where(F.col("k") <= k)
    return kept.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other_ord", "other"))), lambda x: x["other"]), ",").alias("siblings"))


def value_text(values: Column, keep: int = 5, width: int = 80) -> Column:
    """The first values, each cut to a width, joined by commas."""
    return F.array_join(F.transform(F.slice(values, 1, keep), lambda v: F.substring(v, 1, width)), ", ")


def sequential(cells: DataFrame) -> DataFrame:
    """(table, column, sequential): at least three values, all whole numbers, each as far from the one before.

    Only columns of whole numbers are put in order, by ranges: each range has its
    least and most step, first and last value, and the ranges of a column are joined
    at their borders, so a long column is not sorted in one place.
    """
    v = F.when(P.numeric(F.col("value")), F.regexp_replace(F.regexp_replace(F.trim("value"), ",", ""), "_", "").try_cast("double"))
    rows = cells.where("value IS NOT NULL").select(*KEY, "row_ix", v.alias("v"))
    broken = F.count_if(F.col("v").isNull() | (F.col("v") != F.floor("v")))
    columns = rows.groupBy(*KEY).agg(((F.count(F.lit(1)) >= 3) & (broken == 0)).alias("whole"))
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = rows.join(columns.where("whole").select(*KEY), KEY, "left_semi")
    ranged = few.repartitionByRange(n, *KEY, "row_ix").withColumn("part", F.spark_partition_id())
    ranged = ranged.withColumn("step", F.col("v") - F.lag("v").over(Window.partitionBy(*KEY, "part").orderBy("row_ix")))
    parts = ranged.groupBy(*KEY, "part").agg(F.min("step").alias("low"), F.max("step").alias("high"), F.min_by("v", "row_ix").alias("first"), F.max_by("v", "row_ix").alias("last"))
    border = F.col("first") - F.lag("last").over(Window.partitionBy(*KEY).orderBy("part"))  # a few rows for each column
    parts = parts.withColumn("border", border).groupBy(*KEY).agg((F.greatest(F.max("high"), F.max("border")) - F.least(F.min("low"), F.min("border"))).alias("spread"))
    return columns.join(parts, KEY, "left").select(*KEY, (F.col("whole") & F.coalesce(F.col("spread") < 0.01, F.lit(False))).alias("sequential"))


def descriptions(cells: DataFrame) -> DataFrame:
    """(table, column, description): what the values look like, by ordered rules.

    Built on the other measures: fired patterns, number share, steps, mean length, share
    of distinct values; all but the steps come from one pass over the distinct values.
    The texts are fixed values.
    """
    v, n = F.col("value"), F.col("n")
    total = F.sum(n)
    wide = values(cells).groupBy(*KEY).agg(
        total.alias("n"),
        (F.sum(F.length(v) * n) / total).alias("len"),
        F.round(F.sum(F.when(P.numeric(v), n).otherwise(0)) / total, 4).alias("num"),
        F.max(v.contains(".")).alias("dot"),
        F.count(F.lit(1)).alias("distinct"),
        *_hits(),
    )
    wide = write_down(wide)
    hits = wide.unpivot([*KEY, "n"], list(P.PATTERNS), "pattern", "hits").where("hits > 0")
    shown = fired(hits).groupBy(*KEY).agg(F.collect_set("pattern").alias("patterns"))
    rows = wide.select(*KEY, "n", "len", "num", "dot", "distinct").join(sequential(cells), KEY).join(shown, KEY, "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>")))
    has = lambda p: F.array_contains("patterns", p)
    number = F.col("num") > 0.8
    ratio = F.col("distinct") / F.col("n")
    text = (
        F.when(has("datetime_iso_pattern"), "column of datetime/timestamp values")
        .when(has("date_iso_pattern"), "column of date values in YYYY-MM-DD format")
        .when(has("email_pattern"), "column of email addresses")
        .when(has("url_pattern"), "column of URLs or web links")
        .when(has("uuid_pattern"), "column of UUID identifiers")
        .when(number & F.col("sequential"), "column of sequential integers, likely identifiers or index")
        .when(number & F.col("dot"), "column of decimal numeric measurements")
        .when(number, "column of integer values")
        .when(F.col("len") > 100, "column of long text content, descriptions or comments")
        .when(F.col("len") > 40, "column of text phrases or sentences")
        .when((ratio < 0.5) & (F.col("len") < 20), "column of categorical labels or codes")
        .when((F.col("len") < 20) & (F.col("num") < 0.2), "column of short text labels or names")
        .otherwise("column of text values")
    )
    return rows.select(*KEY, text.alias("description"))


def profile(cells: DataFrame) -> DataFrame:
    """All scalar measures of each column in one row; one aggregation for counts, lengths and numbers."""
    v = F.col("value")
    n, nulls = F.count(F.lit(1)), F.count_if(v.isNull())
    wide = cells.groupBy(*KEY).agg(
        F.first("ord").alias("ord"),
        F.first("column_type").alias("column_type"),
        n.alias("n_rows"),
        nulls.alias("n_nulls"),
        F.round(nulls / n, 4).alias("null_ratio"),
        F.round(F.try_divide(F.sum(F.length(v)), F.count(v)), 2).alias("avg_value_length"),
        F.round(F.try_divide(F.count_if(P.numeric(v)), F.count(v)), 4).alias("numeric_ratio"),
    )
    parts = [wide, cardinality(cells), length_entropy(cells)]
    return reduce(lambda a, b: a.join(b, KEY, "left"), parts)


#: Parts of the text that stands for a column, in order.
FEATURES = (
    "column_name", "column_type", "sample_values", "cardinality", "null_ratio", "value_entropy", "pattern_signals", "ontology_priors", "avg_value_length", "numeric_ratio", "sibling_context", "source_table", "value_description",
)


def features(cells: DataFrame) -> DataFrame:
    """The feature record of each column: measures, fired patterns (map), first values, near siblings, description."""
    from colsense.sources.cells import first_values

    pats = fired(pattern_counts(cells)).groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", "fraction")))).alias("pattern_signals"))
    shapes = cells.groupBy(*KEY).agg(F.first("ord").alias("ord"))
    out = profile(cells)
    for part in (pats, first_values(cells, 5).select(*KEY, value_text(F.col("values")).alias("sample_values_text")), closest_siblings(shapes), descriptions(cells).withColumnRenamed("description", "value_description")):
        out = out.join(part, KEY, "left")
    name = F.col("column")
    return out.withColumn("column_name_humanized", F.regexp_replace(name, "_", " ")).withColumn("is_generic_name", P.generic_name(name)).withColumn("canonical_type", P.canonical_type(F.col("column_type")))


def embedding_text(mask: dict[str, bool] | None = None) -> Column:
    """The text of a feature record; the mask leaves features out."""
    on = lambda f: F.lit(mask is None or mask.get(f, True))
    c = F.col
    generic = c("is_generic_name") & F.coalesce(c("value_description") != "", F.lit(False))
    sibs = F.array_join(F.slice(F.transform(F.split("siblings", ","), lambda s: F.regexp_replace(s, "_", " ")), 1, 4), ", ")
    parts = {
        "column_name": F.when(generic, c("value_description")).otherwise(c("column_name_humanized")),
        "column_type": c("canonical_type"),
        "sample_values": c("sample_values_text"),
        "cardinality": F.concat(F.lit("cardinality="), c("cardinality").cast("string")),
        "null_ratio": F.when(c("null_ratio") > 0, F.format_string("null_ratio=%.2f", c("null_ratio"))),
        "value_entropy": F.when(c("value_entropy") > 0, F.format_string("entropy=%.2f", c("value_entropy"))),
        "pattern_signals": F.when(F.size("pattern_signals") > 0, F.concat(F.lit("patterns: "), F.array_join(F.map_keys("pattern_signals"), ", "))),
        "avg_value_length": F.format_string("avg_len=%.1f", c("avg_value_length")),
        "numeric_ratio": F.when(c("numeric_ratio") > 0, F.format_string("numeric=%.2f", c("numeric_ratio"))),
        "sibling_context": F.when(sibs != "", F.concat(F.lit("siblings: "), sibs)),
        "source_table": F.concat(F.lit("table="), c("table")),
        "value_description": F.when(~generic, c("value_description")),
    }
    return F.concat_ws(" | ", *[F.when(on(f) & (p != ""), p) for f, p in parts.items()])


def short_text() -> Column:
    """Name, type (string types left out) and five values."""
    return F.concat_ws(" | ", F.col("column_name_humanized"), F.col("canonical_type"), F.col("sample_values_text"))


def typed_segments() -> Column:
    """Text and numeric parts of a feature record as one struct; a missing number is NaN."""
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    txt = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return F.struct(
        txt("column_name_humanized"), txt("canonical_type"), txt("sample_values_text"), F.coalesce(F.array_join(F.map_keys("pattern_signals"), ", "), F.lit("")).alias("pattern_names"), txt("siblings"), txt("table"), txt("value_description"),
        num("cardinality"), num("null_ratio"), num("value_entropy"), num("avg_value_length"), num("numeric_ratio"),
    )
