"""Tables as long cells: one row for each value of each column.

The unit of all profiling is (table, column); its values are rows, so that a
column of any length is spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def to_cells(df: DataFrame, table: str, row_id: str | Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """(table, column, ord, column_type, row_ix, value) of the chosen columns of df; values are strings.

    ``row_id`` orders the rows; without one, the order of the file gives a number.
    """
    types = dict(df.dtypes)
    chosen = columns if columns is not None else [c for c in df.columns if c != row_id]
    ix = F.col(row_id) if isinstance(row_id, str) else row_id if row_id is not None else F.monotonically_increasing_id()
    wide = df.select(ix.cast("long").alias("row_ix"), *[F.col(f"`{c}`").cast("string").alias(c) for c in chosen])
    long = wide.unpivot(["row_ix"], chosen, "column", "value")
    meta = F.create_map(*[x for k, c in enumerate(df.columns) if c in chosen for x in (F.lit(c), F.struct(F.lit(k).alias("ord"), F.lit(types[c]).alias("type")))])
    m = F.element_at(meta, F.col("column"))
    return long.select(F.lit(table).alias("table"), "column", m["ord"].alias("ord"), m["type"].alias("column_type"), "row_ix", "value")


def all_cells(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """String cells of several tables; tables: name -> (frame, row id column)."""
    return reduce(DataFrame.unionByName, [to_cells(df, name, key, string_columns(df)) for name, (df, key) in tables.items()])


def load_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def table_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, ord, column, type) from the schemas alone; no data is read."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, k, f.name, f.dataType.simpleString()) for t, df in tables.items() for k, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "`table` string, ord int, `column` string, type string")


def samples(cells: DataFrame, keep: int = 5, first_rows: int | None = None) -> DataFrame:
    """Per column: type, first values in row order, counts of rows and nulls, siblings (the column itself included)."""
    if first_rows is not None:
        cells = cells.where(F.dense_rank().over(Window.partitionBy("table", "column").orderBy("row_ix")) <= first_rows)
    firsts = first_values(cells, keep)
    counts = cells.groupBy("table", "column").agg(F.first("ord").alias("ord"), F.first("column_type").alias("column_type"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_nulls"))
    names = counts.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("ord", "column"))).alias("all")).select("table", F.transform("all", lambda x: x["column"]).alias("siblings"))
    return counts.join(firsts, ["table", "column"], "left").join(names, "table").select("table", "column", "ord", "column_type", "n_rows", "n_nulls", F.coalesce("values", F.array().cast("array<string>")).alias("values"), "siblings")


def first_values(cells: DataFrame, keep: int, distinct: bool = False) -> DataFrame:
    """(table, column, values): the first non-null values of each column in row order.

    Each task keeps its own first values and only those are merged, so a long column is never gathered.
    """
    rows = cells.where("value IS NOT NULL")
    if distinct:
        rows = rows.groupBy("table", "column", "value").agg(F.min("row_ix").alias("row_ix"))
    spread = F.pmod(F.xxhash64("row_ix"), F.lit(64))
    part = Window.partitionBy("table", "column", "salt").orderBy("row_ix", "value")
    few = rows.withColumn("salt", spread).withColumn("k", F.row_number().over(part)).where(F.col("k") <= keep)
    packed = few.groupBy("table", "column").agg(F.array_sort(F.collect_list(F.struct("row_ix", "value"))).alias("all"))
    return packed.select("table", "column", F.transform(F.slice("all", 1, keep), lambda x: x["value"]).alias("values"))
