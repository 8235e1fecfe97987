"""Helpers that the training-data operators share.

Intermediate results that are read more than once are written as Parquet to the
folder named by ``spark.checkpoint.dir`` (shared by the driver and all executors),
so that a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression for Spark SQL.
SPACE_RUN = "[ \\t-\\r]+"
#: Ids are broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Least rows of a hot key, and most hot keys.
HOT, MOST_HOT = 5_000, 100_000


#: What operators remember in this Python worker, by operator: how to forget it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Registers how to forget what an operator keeps in a Python worker between tasks."""
    _REMEMBERED[operator] = forget


def at_work(operator: str) -> None:
    """Called by an operator's tasks: a worker keeps the memory of one operator at a time."""
    for other, forget in _REMEMBERED.items():
        if other != operator:
            forget()
    give_back()


def give_back() -> None:
    """Arrow keeps what it freed for later use, some 100 MB in each worker of an executor: gives it back."""
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset (tests, one machine) a temporary one is set."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all machines share")
        top = tempfile.mkdtemp(prefix="colsense-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/colsense-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "t") -> DataFrame:
    """df, written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_records_per_batch(df: DataFrame, rows: int) -> DataFrame:
    """Bounds the rows of an Arrow batch, for this session from now on, where it allows more: texts are long and the plan runs later."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bounds the rows of an Arrow batch, where it allows more, for what runs inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_ids(docs: DataFrame, ids: DataFrame, key: str, n: int, how: str) -> DataFrame:
    """docs joined on key to ids of n rows: broadcast up to BROADCAST_ROWS, otherwise left to the planner."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, key, how)


def hot_over(total: int) -> int:
    """Rows of one key from which on it counts as hot: at most MOST_HOT keys can have as many."""
    return max(HOT, total // MOST_HOT)


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """left joined with right, which has a row for each key at most; the rows of hot keys stay where they are and meet broadcast rows.

    hot: keys with more than hot_over(rows of left) rows in left, so MOST_HOT at most.
    """
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    return marked.where("_hot").drop("_hot").join(few, keys).unionByName(marked.where("_hot IS NULL").drop("_hot").join(right, keys))


def words(text: Column) -> Column:
    """The words ``[^\x20\x09-\x0D]+`` of a text; none for null."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is not inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """All columns of df in one struct ``_row``, beside the needed ones as ``_<name>``: no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{c}`").alias(f"_{c}") for c in needed])
