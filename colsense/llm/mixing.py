"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 64-bit hash. A source's documents are taken in order of that
hash until its budget is met, but nothing is sorted: words are summed by source
and hash bucket (the top 12 bits), the running sums show in which bucket the
budget ends, and only that bucket is divided again by the next 12 bits, until it
holds one hash. The decision is then a comparison of a hash with the source's
threshold. Thresholds are nested: what a smaller budget takes, a larger one takes
too. A target above the source's size takes whole copies of all documents first
and the threshold decides on the rest.

Targets are worked out on one row for each source, in one task: sources are a list
of thousands (collections, sites of a crawl plan), not of documents.

Defined results: a null or empty text has size 0 and is taken like the others
(0 words); a null source is a source of its own, last in order; rows with the
same id and text share a hash and are taken or left together. Whole documents
are taken, so a source's total is within half a document (or half of such a
group of repeated rows) of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, staged, words

#: Weights dealt in turn to the sources in code point order.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and the most copies of one document.
SHARE, MOST = 1.5, 2
BITS = 12


def sized(docs: DataFrame, text: str, source: str, *key: str) -> DataFrame:
    """source, size and hash of every row; ``key`` names the columns that are hashed beside the text."""
    return docs.select(*key, F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), row_hash(text, *key).alias("h"))


def row_hash(text: str, *key: str) -> Column:
    return F.xxhash64(*[F.col(k) for k in key], F.col(text))


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source.

    A source is capped when its cap is below its share of what is left. With the
    sources in order of cap per weight, that holds for a first part of them: the
    first source that isn't capped sets the level of all after it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    all_rows = Window.partitionBy()
    rising = Window.orderBy("per", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("per", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(all_rows) * share)
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("per") * F.col("w_left") >= F.col("left"), F.col("left") / F.col("w_left")))
        .withColumn("rank", F.row_number().over(rising))
        .withColumn("level", F.min(F.when(F.col("level").isNotNull(), F.struct("rank", "level"))).over(all_rows)["level"])
    )
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, copies, below: all documents ``copies`` times, those with h < below (all if null, none if ``copies`` is enough) once more.

    rows: (source, size, h). Each level sums the words of the boundary buckets alone.
    """
    goal = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = goal.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(None).cast("long")).withColumn("open", F.col("rest") > 0)
    for level in range((64 + BITS - 1) // BITS):
        shift = max(64 - BITS * (level + 1), 0)
        inside = rows.join(state.where("open").select(F.col("source").alias("_s"), "prefix"), F.col("source").eqNullSafe(F.col("_s")))
        if level:
            inside = inside.where(F.shiftright("h", 64 - BITS * level) == F.col("prefix"))
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("most"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        edge = (
            buckets.withColumn("upto", run)
            .join(state.where("open").select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s")))
            .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
            .select("_s", F.col("b").alias("_b"), (F.col("rest") - F.col("upto") + F.col("words")).alias("_rest"), "words", "least", "most")
        )
        single = F.col("least") == F.col("most")
        # One hash is left: it is taken if that comes nearer to the budget.
        cut = F.when(F.col("_rest") * 2 > F.col("words"), F.col("most") + 1).otherwise(F.col("least"))
        state = staged(
            state.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source",
                "source_size",
                "target",
                "copies",
                F.when(F.col("open"), F.coalesce("_rest", F.lit(0.0))).otherwise(F.col("rest")).alias("rest"),
                F.coalesce("_b", F.col("prefix")).alias("prefix"),
                F.when(F.col("open") & single, cut).otherwise(F.col("below")).alias("below"),
                (F.col("open") & F.col("_b").isNotNull() & ~F.coalesce(single, F.lit(True))).alias("open"),
            ).coalesce(1),
            f"level{level}",
        )
        if state.where("open").isEmpty():
            break
    return state.select("source", "source_size", "target", "copies", "below")


def times(copies: Column, below: Column, h: Column) -> Column:
    """How often a document is taken."""
    return copies + F.when(below.isNotNull() & (h < below), F.lit(1)).otherwise(F.lit(0))


def plan(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(rows, staged(targets(sizes).coalesce(1), "targets"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """key, size, source_size, target, copies and taken of every row of docs."""
    rows = staged(sized(docs, text, source, key), "sized")
    cut = plan(rows).withColumnRenamed("source", "_s")
    taken = times(F.col("copies"), F.col("below"), F.col("h"))
    return rows.join(cut, F.col("source").eqNullSafe(F.col("_s"))).select(key, "source", "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).alias("taken"))


def take(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    cut = plan(staged(sized(docs, text, source, key), "sized").select("source", "size", "h")).withColumnRenamed("source", "_s")
    rows = packed(docs, text, source, key).join(cut, F.col(f"_{source}").eqNullSafe(F.col("_s")))
    n = times(F.col("copies"), F.col("below"), row_hash(f"_{text}", f"_{key}"))
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(n > 0, n)))).select("_row.*")
