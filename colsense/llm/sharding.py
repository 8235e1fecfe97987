"""Sharding by a Feistel permutation over global row numbers (built-in DataFrame functions only).

1. Rows are numbered 0 .. n-1 in the order of the MD5 of id and text, so that the
   numbers follow from the rows alone, not from files, tasks or the cluster's size.
   Nothing is sorted as a whole: a row's cell is the first digits of its digest, the
   counts of the 65,536 cells give where each begins, and rows are sorted inside their cell. Rows with the same id and text
   share a digest and cannot be told apart by it; where more than ``hot_over`` do, they are
   written down with a random part of their own each and numbered by these parts
   behind all others, so no task holds them all.
2. A number x in [0, n) is permuted by a Feistel network over pairs (x div b, x mod b)
   with a x b >= n, a and b next to the root of n: each round adds a keyed hash of one
   half to the other, so it can be undone (``permuted(.., back=True)``). A value of n or
   more goes through the network again until it is below n (cycle walking). Less than
   b values are outside, so a walk seldom takes a second step; one of more than
   ``STEPS`` (possible from n = 1,600 on, with a chance below 1e-40) is an error.
3. With p the permuted number, the shard is p mod k and the slot p div k: shards have
   counts at most one apart and gapless slots (law ``rows``), and place and row number
   follow from one another by arithmetic, for a loader that starts in the middle.

``write`` moves each row once, to its cell, and writes it from there to its shard's
folder; a file's rows stand in the order of their slots, ``read`` gives shard and slot.

Defined results: a null text is an empty one; null ids are ids like others; rows
that repeat id and text are rows of their own, and which of them gets which place is
open; columns that are called shard or slot keep their names inside ``row``. An
empty table gives empty shards.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_over, let, packed, shared_dir, staged, table

SHARDS, ROUNDS, STEPS = 8, 6, 40
#: Hexadecimal digits of a cell: 65,536 cells.
DIGITS = 4
#: Parts into which the rows of hot digests are dealt.
PARTS = 1024


def halves(n: int) -> tuple[int, int]:
    """(a, b) with n <= a * b < n + b."""
    b = isqrt(max(n - 1, 0)) + 1
    return max(1, -(-n // b)), b


def _hash(seed: str, round_: Column, half: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), round_.cast("string"), half.cast("string"))), 1, 15), 16, 10).cast("long")


def _over(x: Column, d: int) -> Column:
    """x div d, for x below 2^53."""
    return ((x - F.pmod(x, F.lit(d))) / d).cast("long")


def network(x: Column, a: int, b: int, seed: str, back: bool = False) -> Column:
    """x in [0, a * b) through all rounds: even ones change x div b, odd ones x mod b."""
    sign = -1 if back else 1

    def one(s: Column, k: Column) -> Column:
        even = F.pmod(s["l"] + sign * F.pmod(_hash(seed, k, s["r"]), F.lit(a)), F.lit(a))
        odd = F.pmod(s["r"] + sign * F.pmod(_hash(seed, k, s["l"]), F.lit(b)), F.lit(b))
        return F.struct(F.when(k % 2 == 0, even).otherwise(s["l"]).alias("l"), F.when(k % 2 == 0, s["r"]).otherwise(odd).alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(_over(x, b).alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r")), one, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(x: Column, n: int, seed: str = "0", back: bool = False) -> Column:
    """The place of x in a permutation of [0, n), or with ``back`` the number at place x."""
    a, b = halves(n)
    step = lambda v: network(v, a, b, seed, back)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), step(x.cast("long")), lambda v, _: F.when(v < n, v).otherwise(step(v)))
    return let(walked, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a cycle is longer than the walk: take another seed")).cast("long")))


def digested(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row`` with all columns of docs, its ``digest`` and its ``cell``."""
    name = F.concat(F.coalesce(F.col(f"_{key}").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"_{text}"), F.lit("")))
    return packed(docs, key, text).select(F.col("_row").alias("row"), F.md5(name.cast("binary")).alias("digest")).withColumn("cell", F.substring("digest", 1, DIGITS))


def hot_digests(rows: DataFrame, cells: DataFrame, most: int) -> DataFrame | None:
    """The digests of more than ``most`` rows; only cells with as many can have them."""
    full = cells.where(F.col("c") > most).select("cell")
    if full.isEmpty():
        return None
    inside = rows.join(F.broadcast(full), "cell", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("c"))
    found = staged(inside.where(F.col("c") > most).select("digest"), "hot")
    return None if found.isEmpty() else found


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(row, number) of every row of docs, and how many there are."""
    rows = digested(docs, key, text)
    count = lambda df: staged(df.groupBy("cell").agg(F.count(F.lit(1)).alias("c")), "cells")
    cells = count(rows)
    n = cells.agg(F.sum("c")).first()[0] or 0
    hot = hot_digests(rows, cells, hot_over(n))
    if hot is not None:
        part = F.concat(F.lit("~"), "digest", F.lpad(F.floor(F.rand(1) * PARTS).cast("string"), 5, "0"))
        many = staged(rows.join(F.broadcast(hot), "digest", "left_semi").withColumn("cell", part), "many")
        rows = rows.join(F.broadcast(hot), "digest", "left_anti").select("row", "digest", "cell").unionByName(many.select("row", "digest", "cell"))
        cells = count(rows)
    begins = cells.select("cell", (F.sum("c").over(Window.orderBy("cell")) - F.col("c")).alias("begin"))  # a row for each cell
    place = F.row_number().over(Window.partitionBy("cell").orderBy("digest"))
    return rows.withColumn("place", place).join(F.broadcast(begins), "cell").select("row", (F.col("begin") + F.col("place") - 1).alias("number")), n


def assigned(docs: DataFrame, shards: int = SHARDS, seed: str = "0", key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, number, shard, slot of every row of docs."""
    rows, n = numbered(docs, key, text)
    return rows.withColumn("p", permuted(F.col("number"), n, seed)).select("row", "number", F.pmod("p", F.lit(shards)).cast("int").alias("shard"), _over(F.col("p"), shards).alias("slot"))


def write(docs: DataFrame, folder: str, shards: int = SHARDS, seed: str = "0", key: str = "doc_id", text: str = "text") -> None:
    """Writes the rows of docs to a folder for each shard, the rows of each file by slot."""
    assigned(docs, shards, seed, key, text).drop("number").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def read(spark, folder: str, like: DataFrame) -> DataFrame:
    """row, slot, shard as written; ``like`` has the columns of what was written."""
    return spark.read.schema(like.select(F.struct(*[F.col(f"`{c}`") for c in like.columns]).alias("row"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard")).schema).parquet(folder)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/shards"
    write(docs, folder)
    raw = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return read(spark, folder, docs).select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
