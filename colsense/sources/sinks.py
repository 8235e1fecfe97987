"""Sinks, and written-down intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """A new folder below the one named in spark.checkpoint.dir; a temporary one where that is unset (one machine)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all machines share")
        top = tempfile.mkdtemp(prefix="colsense-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/colsense-{uuid.uuid4().hex}"


def write_down(df: DataFrame, **options: str | int) -> DataFrame:
    """df, written once to the shared folder and read back: cuts the lineage, survives lost executors; options: of the writer."""
    path = f"{shared_folder(df.sparkSession)}/t"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def display_text(label: str = "label", code: str = "code"):
    """``label - code``, or the one that is there."""
    both = F.concat_ws(" - ", F.col(label), F.col(code))
    return F.coalesce(F.when(both != "", both), F.lit("unclassified"))


def results(df: DataFrame, path: str) -> None:
    """Classified rows as one table; nested parts become JSON text only here."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("errorifexists").parquet(path)


def snapshot(df: DataFrame, path: str, by: str = "table") -> None:
    """Rows in one folder for each table, zstandard; and a manifest with counts."""
    df.repartition(by).write.partitionBy(by).option("compression", "zstd").parquet(f"{path}/tables")
    df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows")).coalesce(1).write.json(f"{path}/manifest")


def predictions(df: DataFrame, path: str) -> None:
    """(table_id, column_id, predicted_code); an empty set is refused."""
    out = df.select("table_id", "column_id", first_member(F.col("code")).alias("predicted_code"))
    if out.isEmpty():
        raise ValueError("there are no predictions to write")
    out.write.parquet(path)


def first_member(code):
    """A set ``a|b|c`` collapses to its first member."""
    return F.split(code, r"\|")[0]


def holdout_tables(cells: DataFrame, path: str, columns: list[str]) -> None:
    """Cells back to wide rows, CSV, one folder for each table."""
    wide = cells.groupBy("table", "row_ix").pivot("column", columns).agg(F.first("value"))
    wide.repartition("table").sortWithinPartitions("row_ix").write.partitionBy("table").option("header", True).csv(path)


def error_sheet(errors: DataFrame, path: str) -> None:
    """Counts of errors, most frequent first, tab-separated, one folder for each iteration."""
    errors.repartition("iteration").sortWithinPartitions(F.col("n").desc()).write.partitionBy("iteration").option("sep", "\t").option("header", True).csv(path)


def clean_export(df: DataFrame, answer_columns: list[str], path: str, prefix: str = "") -> None:
    """The rows without their answer columns and with the table's prefix off the names."""
    keep = [c for c in df.columns if c not in answer_columns]
    df.select(*[F.col(f"`{c}`").alias(c.removeprefix(prefix)) for c in keep]).write.parquet(path)


def trend(points: DataFrame, path: str) -> None:
    """The whole trend, rewritten: one JSON file in the order of the iterations."""
    points.coalesce(1).sortWithinPartitions("iteration").write.mode("overwrite").json(path)


def relational_sample(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table below path, with the table's name before columns that another table has too; (table, n_rows, columns, renamed) as the manifest, written as well."""
    seen: dict[str, int] = {}
    for t in tables.values():
        for c in t.columns:
            seen[c] = seen.get(c, 0) + 1
    out = None
    for name, t in tables.items():
        clash = [c for c in t.columns if seen[c] > 1]
        t.select(*[F.col(f"`{c}`").alias(f"{name}_{c}" if c in clash else c) for c in t.columns]).write.parquet(f"{path}/{name}")
        own = t.sparkSession.read.parquet(f"{path}/{name}")
        row = own.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.lit(",".join(own.columns)).alias("columns"), F.lit(len(clash)).alias("renamed"))
        out = row if out is None else out.union(row)
    out.coalesce(1).write.json(f"{path}/manifest")
    return tables[next(iter(tables))].sparkSession.read.schema(out.schema).json(f"{path}/manifest")
