"""Sources: folders of CSV, vocabularies, keys, references and catalogues as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_folder(spark: SparkSession, folder: str, sample: int = 50) -> DataFrame:
    """Long cells of all CSV files of a folder but ``annotations.csv``: the first 4 x sample rows of each; the empty string is null.

    The table is the file's name. All files, whatever their headers, are one scan of
    Spark's reader of multi-line records: quoted cells may hold line breaks, commas and
    doubled quotes, also in headers. A first scan of lines counts the commas of the
    widest header, so files of any width are read whole and texts with many commas make
    no columns. A file of such records is read by one task, in order, so
    the rows' numbers follow from their ids; a cell behind the header's last name is left
    out, a missing one is null, a name that is missing between others is ``_c<place>``.
    """
    path = f"{folder}/*.csv"
    width, longest = header_width(spark, path)
    names = [f"_c{k}" for k in range(width)]
    reader = spark.read.schema(", ".join(f"{c} string" for c in names)).options(multiLine=True, header=False, quote='"', escape='"', maxColumns=max(1 << 16, width + 1, 2 * longest), maxCharsPerColumn=-1)
    rows = reader.csv(path).select(F.array(*names).alias("v"), F.monotonically_increasing_id().alias("n"), F.input_file_name().alias("path"))
    rows = rows.withColumn("table", F.regexp_extract("path", r"([^/]+)\.csv$", 1)).where("`table` <> 'annotations'").drop("path")
    filled = F.array_max(F.transform("v", lambda x, k: F.when(x.isNotNull(), k + 1)))
    title = F.transform(F.slice("v", F.lit(1), F.coalesce(filled, F.lit(0))), lambda x, k: F.coalesce(x, F.concat(F.lit("_c"), k.cast("string"))))
    first = rows.groupBy("table").agg(F.min_by(title, "n").alias("header"), F.min("n").alias("h"))
    body = rows.join(F.broadcast(first), "table").withColumn("row_ix", (F.col("n") - F.col("h")).cast("int")).where((F.col("row_ix") > 0) & (F.col("row_ix") <= sample * 4))
    cells = body.select("table", "row_ix", F.posexplode(F.arrays_zip(F.col("header").alias("c"), F.slice("v", F.lit(1), F.size("header")).alias("v"))).alias("ord", "x"))
    return cells.select("table", F.col("x.c").alias("column"), "ord", F.lit(None).cast("string").alias("column_type"), "row_ix", F.when(F.col("x.v") != "", F.col("x.v")).alias("value"))


def header_width(spark: SparkSession, path: str) -> tuple[int, int]:
    """(cells of the widest header at most, cells of the longest line at most) of CSV files whose headers may hold quoted line breaks.

    A header ends with the first line up to which the quotes are even in number; that
    line is looked for among a file's first 100 lines, then ten times as many, and so on.
    """
    count = lambda c: F.length("value") - F.length(F.replace("value", F.lit(c)))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), count(",").alias("commas"), count('"').alias("quotes"))
    longest = F.max("commas").alias("longest")
    begun = lines.groupBy("file").agg(F.min(F.when(F.col("at") == 0, F.col("n"))).alias("n0"), F.count_if(F.col("at") == 0).alias("rows"), longest).persist()
    width, most, depth = 0, begun.agg(F.max("longest"), F.max("rows")).first(), 100
    files = begun.select("file", "n0", "rows")
    so_far = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        head = lines.where("at = 0").join(F.broadcast(files), "file").where(F.col("n") < F.col("n0") + depth)
        head = head.withColumns({"commas": F.sum("commas").over(so_far), "even": F.sum("quotes").over(so_far) % 2 == 0})
        ends = head.groupBy("file").agg(F.min(F.when(F.col("even"), F.col("commas"))).alias("w"), F.max("commas").alias("all"), F.max("rows").alias("rows"))
        found = ends.agg(F.max(F.coalesce("w", F.when(F.col("rows") <= depth, F.col("all")))), F.count_if(F.col("w").isNull() & (F.col("rows") > depth))).first()
        width = found[0] or 0
        if not found[1]:
            break
        depth *= 10
    begun.unpersist()
    return 1 + width, 1 + (most[0] or 0)


def discover(spark: SparkSession, database: str | None = None, limit: int | None = None) -> DataFrame:
    """(database, table) of one database or all of them."""
    names = [database] if database else [x.name for x in spark.catalog.listDatabases()]
    rows = [(n, t.name) for n in names for t in spark.catalog.listTables(n) if not t.isTemporary]
    return spark.createDataFrame(rows[:limit], "database string, `table` string")


def distinct_probe(df: DataFrame, rows: int | None = None) -> DataFrame:
    """(column, distinct_count) of every column in one pass, over the first rows if a number is given."""
    head = df.limit(rows) if rows else df
    wide = head.agg(*[F.countDistinct(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "distinct_count")


def records(df: DataFrame) -> DataFrame:
    """Columns renamed to record keys: last part after a dot, lower case, no quotes, underscores for blanks."""
    return df.toDF(*[c.rsplit(".", 1)[-1].lower().strip().replace("'", "").replace(" ", "_") for c in df.columns])


def repair_oversplit(df: DataFrame, column: str = "description", width: int = 10) -> DataFrame:
    """A quoted text that was split at its commas is put together again from the columns after it, which become blank."""
    after = df.columns[df.columns.index(column) + 1 :][:width]
    c, rest = F.col(column), F.array(*[F.coalesce(F.col(x), F.lit("")) for x in after])
    end = F.array_position(F.transform(rest, lambda x: F.endswith(x, F.lit('"'))), True)
    broken = F.startswith(c, F.lit('"')) & ~F.endswith(F.substring(c, 2, 100000), F.lit('"'))
    whole = F.concat_ws(", ", c, F.array_join(F.slice(rest, F.lit(1), end.cast("int")), ", "))
    strip = lambda x: F.regexp_replace(x, '^"|"$', "")
    stitched = broken & (end > 0)
    out = df.withColumn("_end", F.when(stitched, end).otherwise(F.lit(0))).withColumn("_text", F.when(stitched, strip(whole)).otherwise(strip(c)))
    out = out.withColumn(column, F.col("_text"))
    for k, x in enumerate(after, 1):
        out = out.withColumn(x, F.when(F.col("_end") >= k, F.lit("")).otherwise(F.col(x)))
    return out.drop("_end", "_text")


def ddl_types(spark: SparkSession, path: str) -> DataFrame:
    """(column, type) from the lines of CREATE TABLE statements."""
    line = F.trim("value")
    rows = spark.read.text(path).select(F.regexp_extract(line, r'^["`]?(\w+)["`]?\s+([A-Za-z]+(\(\d+(,\s*\d+)?\))?)', 1).alias("column"), F.regexp_extract(line, r'^["`]?(\w+)["`]?\s+([A-Za-z]+(\(\d+(,\s*\d+)?\))?)', 2).alias("type"))
    return rows.where("`column` <> '' AND upper(`column`) NOT IN ('CREATE', 'PRIMARY', 'FOREIGN', 'UNIQUE', 'CONSTRAINT', 'CHECK', 'KEY', 'INDEX')")


def paired_answers(shapes: DataFrame) -> DataFrame:
    """(table, column, code) where the column after it spells a code (attr_1_2_9 is 1.2.9); row_id gets the fallback null."""
    nxt = F.lead("column").over(Window.partitionBy("table").orderBy("ord"))
    code = F.regexp_extract(nxt, r"^[a-z]+_(\d+(_\d+)*)$", 1)
    rows = shapes.withColumn("code", F.when(code != "", F.regexp_replace(F.regexp_replace(code, "_", "."), r"\.0$", "")))
    return rows.where(F.col("code").isNotNull() & ~F.col("column").rlike(r"^[a-z]+_\d+(_\d+)*$")).select("table", "column", "code")


def answer_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The key as it is; blank or repeated identities end the job with an error."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.coalesce(F.trim(k) == "", F.lit(True))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    bad = F.when(blank, F.lit("blank identity")).when(n > 1, F.concat(F.lit("duplicate identity: "), F.concat_ws(".", *keys)))
    first = keys[0]
    return rows.withColumn("_bad", bad).withColumn(first, F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("string")).otherwise(F.col(first))).drop("_bad")


def reference_map(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, code) under bare, qualified and stripped names; later rows win, stripped names only where no other claims them.

    rows: (n, table, column, mnemonic, code) in file order; a missing code comes from the mnemonic.
    """
    r = rows.join(nodes.groupBy("mnemonic").agg(F.min("code").alias("by_name")), "mnemonic", "left").withColumn("code", F.coalesce("code", "by_name"))
    keys = F.array(F.struct(F.col("column").alias("key"), F.lit(0).alias("tier")), F.struct(F.concat_ws(".", "table", "column").alias("key"), F.lit(0).alias("tier")), F.struct(F.regexp_replace("column", "^[a-z]+_", "").alias("key"), F.lit(1).alias("tier")))
    long = r.select("n", "code", F.inline(keys))
    order = F.struct((-F.col("tier")).alias("t"), F.when(F.col("tier") == 0, F.col("n")).otherwise(-F.col("n")).alias("o"))
    return long.groupBy("key").agg(F.max_by("code", order).alias("code"))


def reference_json(rows: DataFrame) -> DataFrame:
    """(key, mnemonic, code) from JSON objects whose values are a mnemonic, null or {mnemonic, code}."""
    pairs = rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    obj = F.when(F.startswith("v", F.lit("{")), F.from_json("v", "mnemonic string, code string"))
    return pairs.select("key", F.coalesce(obj["mnemonic"], F.when(~F.startswith("v", F.lit("{")), F.col("v"))).alias("mnemonic"), obj["code"].alias("code"))


def manifest(rows: DataFrame, anchors: DataFrame, fallback: str) -> DataFrame:
    """(collection, table, column, anchor, mapped) from nested manifests; genera without an anchor get the fallback."""
    flat = rows.select(F.col("name").alias("collection"), "genus", F.explode("tables").alias("t")).select("collection", "genus", F.col("t.name").alias("table"), F.explode("t.columns").alias("column"))
    return flat.join(F.broadcast(anchors), "genus", "left").select("collection", "table", "column", F.coalesce("anchor", F.lit(fallback)).alias("anchor"), F.col("anchor").isNotNull().alias("mapped"))


def blind_release(rows: DataFrame, keep: int = 10, key: DataFrame | None = None) -> DataFrame:
    """(table_id, column_id, column_name, values, siblings[, code]) of a release; the key is joined only when given."""
    sibs = rows.groupBy("table_id").agg(F.array_sort(F.collect_list("column_name")).alias("siblings"))
    out = rows.join(sibs, "table_id").select("table_id", "column_id", "column_name", F.slice("sample_values", 1, keep).alias("values"), "siblings")
    return out if key is None else out.join(key.select("table_id", "column_id", F.col("reference_code").alias("code")), ["table_id", "column_id"], "left")


def value_free_tables(entities: DataFrame, prefix: str = "", surrogate: bool = True) -> DataFrame:
    """(table, columns) from catalogue entities (table, column, ord) without values; surrogate keys can be left out."""
    e = entities.where(F.startswith("table", F.lit(prefix)))
    if not surrogate:
        e = e.where(~F.col("column").rlike("(^|_)(id|key|sk)$"))
    return e.groupBy("table").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "column"))), lambda x: x["column"]).alias("columns"))


def labelled_corpus(rows: DataFrame) -> DataFrame:
    """Labelled columns (table, column, type, values, code) with a content hash."""
    h = F.sha1(F.concat_ws("\x1f", "table", "column", F.array_join("values", "\x1e"), "code"))
    return rows.withColumn("content_hash", h)


def payload_flat(payloads: DataFrame) -> DataFrame:
    """Nested enrichment payloads as flat text: lists joined by ``|``."""
    lists = [f.name for f in payloads.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return payloads.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if c in lists else F.col(c) for c in payloads.columns])


def strided(columns: DataFrame, stride: int, most: int = 14) -> DataFrame:
    """Every ``stride``-th self-labelled column by a stable order, at most ``most`` for each relation."""
    n = F.row_number().over(Window.partitionBy("relation").orderBy("column")) - 1
    return columns.withColumn("n", n).where((F.col("n") % stride == 0) & (F.col("n") / stride < most)).drop("n")


def vocabulary(spark: SparkSession, source: str, kind: str) -> DataFrame:
    """(code, parent_code, label, specifics) from a table, or a JSON, CSV or Parquet file; an empty one ends the job with an error.

    Two shapes of records: ``code`` and ``parent_code``, or a dotted ``id`` whose parent
    is what stands before its last dot. ``example_values`` are specifics.
    """
    rows = {
        "table": lambda: spark.table(source),
        "json": lambda: spark.read.option("multiLine", True).json(source),
        "csv": lambda: spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(source),
        "parquet": lambda: spark.read.parquet(source),
    }[kind]()
    rows = records(rows)
    if rows.isEmpty():
        raise ValueError(f"the vocabulary {source} is empty")
    have = set(rows.columns)
    code = F.col("code" if "code" in have else "id").cast("string")
    above = F.regexp_replace(code, r"\.?[^.]*$", "")
    parent = F.col("parent_code") if "parent_code" in have else F.when(above != "", above)
    text = next((F.col(c) for c in ("specifics", "example_values") if c in have), F.lit(None).cast("string"))
    label = next((F.col(c) for c in ("label", "ontology") if c in have), code)
    return rows.select(code.alias("code"), F.nullif(parent, F.lit("")).alias("parent_code"), label.alias("label"), text.alias("specifics"))


def release_stats(spark: SparkSession, path: str) -> DataFrame:
    """(n_tables, n_columns, ontology, generation, run) of a release's statistics with their nested generation manifest; missing parts are null."""
    schema = "n_tables long, n_columns long, generation_manifest struct<ontology_sha:string,vocab_generation:long,corpus_run_id:string>"
    g = F.col("generation_manifest")
    return spark.read.schema(schema).option("multiLine", True).json(path).select("n_tables", "n_columns", g["ontology_sha"].alias("ontology"), g["vocab_generation"].alias("generation"), g["corpus_run_id"].alias("run"))


def curated_reference(columns: DataFrame, typed: DataFrame, fallback: str) -> DataFrame:
    """(table, column, ord, code, derivation, confidence) of the natural columns of (table, column, ord).

    A column whose name spells a code is no natural column; it decides the code of the
    one before it. Otherwise the name's index (name, code) does, row identifiers have the
    fallback, and the rest is unresolved.
    """
    spelt = r"^[a-z]+_(\d+(_\d+)*)$"
    nxt = F.lead("column").over(Window.partitionBy("table").orderBy("ord"))
    said = F.regexp_replace(F.regexp_replace(F.regexp_extract(nxt, spelt, 1), "_", "."), r"\.0$", "")
    rows = columns.withColumn("said", F.nullif(said, F.lit(""))).where(~F.col("column").rlike(spelt))
    rows = rows.join(F.broadcast(typed.groupBy(F.lower("name").alias("name")).agg(F.min("code").alias("typed"))), F.lower("column") == F.col("name"), "left")
    is_row = F.lower("column").rlike("^(row_)?id$|_row_id$")
    how = F.when(F.col("said").isNotNull(), "reference_encoded").when(F.col("typed").isNotNull(), "typed_name").when(is_row, "fallback").otherwise("unresolved")
    sure = F.when(F.col("said").isNotNull(), "authoritative").when(F.col("typed").isNotNull(), "high").when(is_row, "medium").otherwise("none")
    return rows.select("table", "column", "ord", F.coalesce("said", "typed", F.when(is_row, F.lit(fallback))).alias("code"), how.alias("derivation"), sure.alias("confidence"))
