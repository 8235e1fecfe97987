"""Inputs that the registered queries derive from the given tables, in Spark and as SQL.

- cells: the string columns of eight tables in long form;
- nodes: a taxonomy of three levels (region, nation, market segment) with dotted codes;
- masses: three sources of evidence for each customer;
- pairs: the code of each customer beside a prediction that is right, too high, a sibling's or elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.operators import fusion, taxonomy
from colsense.sources.cells import to_cells
from colsense.sources.sinks import write_down

#: Key and string columns of the tables that are profiled.
COLUMNS = {
    "customer": ("c_custkey", ["c_name", "c_mktsegment"]),
    "orders": ("o_orderkey", ["o_orderstatus", "o_orderpriority"]),
    "part": ("p_partkey", ["p_name", "p_brand", "p_type"]),
    "supplier": ("s_suppkey", ["s_name"]),
    "nation": ("n_nationkey", ["n_name"]),
    "region": ("r_regionkey", ["r_name"]),
    "events": ("event_id", ["event_type", "props"]),
    "documents": ("doc_id", ["lang", "source"]),
    "pages": ("page_id", ["url"]),
}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [to_cells(read(spark, d, t).select(key, *cols), t, key, cols) for t, (key, cols) in COLUMNS.items()])


def token_cells(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents that have a digit or an @ in them, with the source as the column."""
    words = read(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "[ \n]")).alias("k", "value"))
    return words.where(F.col("value").rlike("[0-9@]")).select(F.lit("documents").alias("table"), F.col("source").alias("column"), F.lit(0).alias("ord"), F.lit("string").alias("column_type"), F.col("doc_id").alias("row_ix"), "value")


CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {k + 1} AS ord, {key} AS row_ix, {c} AS value FROM {t}" for t, (key, cols) in COLUMNS.items() for k, c in enumerate(cols)
) + ")"
TOKENS = "cells AS (SELECT 'documents' AS \"table\", source AS \"column\", doc_id AS row_ix, value FROM (SELECT doc_id, source, unnest(string_split_regex(text, '[ \\n]')) AS value FROM documents) WHERE regexp_matches(value, '[0-9@]'))"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    r, n, c = (read(spark, d, t) for t in ("region", "nation", "customer"))
    top = r.select(F.col("r_regionkey").cast("string").alias("code"), F.lit(None).cast("string").alias("parent_code"), F.col("r_name").alias("label"))
    nation = F.concat_ws(".", "n_regionkey", "n_nationkey")
    mid = n.select(nation.alias("code"), F.col("n_regionkey").cast("string").alias("parent_code"), F.col("n_name").alias("label"))
    low = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.concat_ws(".", nation, "c_mktsegment").alias("code"), nation.alias("parent_code"), F.col("c_mktsegment").alias("label")).distinct()
    return top.union(mid).union(low).withColumn("mnemonic", F.upper(F.substring("label", 1, 6))).withColumn("aliases", F.array(F.lower("label")))


NODES = """nodes AS (SELECT CAST(r_regionkey AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS parent_code, r_name AS label FROM region
 UNION ALL SELECT n_regionkey || '.' || n_nationkey, CAST(n_regionkey AS VARCHAR), n_name FROM nation
 UNION ALL SELECT DISTINCT n_regionkey || '.' || n_nationkey || '.' || c_mktsegment, n_regionkey || '.' || n_nationkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
CLOSURE = """clo AS (SELECT a.code, b.code AS ancestor, len(string_split(a.code, '.')) - len(string_split(b.code, '.')) AS distance FROM nodes a JOIN nodes b ON a.code = b.code OR a.code LIKE b.code || '.%')"""


def closure(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.closure_of_dots(nodes(spark, d))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """entity, region, nation and leaf codes of each customer."""
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    mid = F.concat_ws(".", "n_regionkey", "n_nationkey")
    return j.select(F.col("c_custkey").alias("entity"), F.col("n_regionkey").cast("string").alias("top"), mid.alias("mid"), F.concat_ws(".", mid, "c_mktsegment").alias("leaf"), F.concat(mid, F.lit(".BUILDING")).alias("sibling"), "c_nationkey", "c_mktsegment")


CUSTOMERS = """cust AS (SELECT c_custkey AS entity, CAST(n_regionkey AS VARCHAR) AS top, n_regionkey || '.' || n_nationkey AS mid, n_regionkey || '.' || n_nationkey || '.' || c_mktsegment AS leaf,
 n_regionkey || '.' || n_nationkey || '.BUILDING' AS sibling, c_nationkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def masses(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    own = (30 + F.col("entity") % 40) / 100.0
    rows = F.array(
        F.struct(F.lit("name").alias("source"), F.col("leaf").alias("focal"), own.alias("mass")),
        F.struct(F.lit("name").alias("source"), F.lit("Z").alias("focal"), (1 - own).alias("mass")),
        F.struct(F.lit("pattern").alias("source"), F.concat("mid", F.lit("*")).alias("focal"), F.lit(0.4).alias("mass")),
        F.struct(F.lit("pattern").alias("source"), F.when(F.col("leaf") == F.col("sibling"), F.col("mid")).otherwise(F.col("sibling")).alias("focal"), F.lit(0.2).alias("mass")),
        F.struct(F.lit("pattern").alias("source"), F.lit("Z").alias("focal"), F.lit(0.4).alias("mass")),
        F.struct(F.lit("vote").alias("source"), F.concat("top", F.lit("*")).alias("focal"), F.lit(0.3).alias("mass")),
        F.struct(F.lit("vote").alias("source"), F.col("leaf").alias("focal"), ((F.col("entity") % 10) * 0.05).alias("mass")),
        F.struct(F.lit("vote").alias("source"), F.lit("Z").alias("focal"), (0.7 - (F.col("entity") % 10) * 0.05).alias("mass")),
    )
    return c.select("entity", F.inline(rows)).where("mass > 0")


MASSES = """masses AS (SELECT * FROM (SELECT entity, 'name' AS source, leaf AS focal, (30 + entity % 40) / 100.0::DOUBLE AS mass FROM cust
 UNION ALL SELECT entity, 'name', 'Z', 1 - (30 + entity % 40) / 100.0::DOUBLE FROM cust
 UNION ALL SELECT entity, 'pattern', mid || '*', 0.4::DOUBLE FROM cust
 UNION ALL SELECT entity, 'pattern', CASE WHEN leaf = sibling THEN mid ELSE sibling END, 0.2::DOUBLE FROM cust
 UNION ALL SELECT entity, 'pattern', 'Z', 0.4::DOUBLE FROM cust
 UNION ALL SELECT entity, 'vote', top || '*', 0.3::DOUBLE FROM cust
 UNION ALL SELECT entity, 'vote', leaf, (entity % 10) * 0.05::DOUBLE FROM cust
 UNION ALL SELECT entity, 'vote', 'Z', 0.7::DOUBLE - (entity % 10) * 0.05::DOUBLE FROM cust) WHERE mass > 0)"""
FRAME = """fr AS (SELECT code AS focal, code, 'c' AS k FROM nodes UNION ALL SELECT n.code || '*', n.code, 's' FROM nodes n WHERE EXISTS (SELECT 1 FROM nodes m WHERE m.code LIKE n.code || '.%') UNION ALL SELECT 'Z', NULL, 'z'),
 mem AS (SELECT f.focal, n.code FROM fr f JOIN nodes n ON f.k = 'z' OR n.code = f.code OR (f.k = 's' AND n.code LIKE f.code || '.%')),
 sizes AS (SELECT focal, count(*) AS size FROM mem GROUP BY focal),
 meet AS (SELECT * FROM (SELECT a.focal AS f1, b.focal AS f2, CASE WHEN a.k = 'z' THEN b.focal WHEN b.k = 'z' THEN a.focal WHEN a.code = b.code THEN CASE WHEN a.k = 'c' THEN a.focal ELSE b.focal END
  WHEN a.code LIKE b.code || '.%' AND b.k = 's' THEN a.focal WHEN b.code LIKE a.code || '.%' AND a.k = 's' THEN b.focal END AS f12 FROM fr a, fr b) WHERE f12 IS NOT NULL)"""


def fused_sql(sources: list[str], rule: str = "dempster") -> str:
    """CTEs s0, s1, ... of the sources combined in order; the last one is named ``fused``."""
    out = [f"s0 AS (SELECT entity, focal, mass, 0.0::DOUBLE AS k FROM masses WHERE source = '{sources[0]}')"]
    for i, s in enumerate(sources[1:], 1):
        name = "fused" if i == len(sources) - 1 else f"s{i}"
        out.append(f"p{i} AS (SELECT a.entity, m.f12 AS focal, sum(a.mass * b.mass) AS m, max(a.k) AS k0 FROM s{i - 1} a JOIN masses b ON a.entity = b.entity AND b.source = '{s}' LEFT JOIN meet m ON m.f1 = a.focal AND m.f2 = b.focal GROUP BY 1, 2)")
        out.append(f"q{i} AS (SELECT *, coalesce(sum(m) FILTER (WHERE focal IS NULL) OVER (PARTITION BY entity), 0) AS kk FROM p{i})")
        if rule == "yager":
            out.append(f"{name} AS (SELECT entity, coalesce(focal, 'Z') AS focal, sum(m) AS mass, max(kk) + max(k0) AS k FROM q{i} GROUP BY 1, 2)")
        else:
            out.append(f"{name} AS (SELECT entity, focal, m / (1 - kk) AS mass, 1 - (1 - kk) * (1 - k0) AS k FROM q{i} WHERE focal IS NOT NULL AND m > 0)")
    return ", ".join(out)


SOURCES = ["name", "pattern", "vote"]


class Frame:
    """The tables that fusion needs, made once for a taxonomy."""

    def __init__(self, spark: SparkSession, d: str):
        self.nodes = write_down(nodes(spark, d))
        self.clo = write_down(taxonomy.closure_of_dots(self.nodes))
        self.frame = fusion.frame(self.nodes, self.clo)
        self.members = fusion.members(self.nodes, self.clo, self.frame)
        self.meet = write_down(fusion.meet(self.frame, self.clo))

    def subset(self) -> DataFrame:
        return write_down(fusion.subset(self.frame, self.members))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """id, truth, pred, conf: a sixth each of predictions one level up, a sibling's and another nation's."""
    c = customers(spark, d)
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("other"), F.concat_ws(".", "n_regionkey", "n_nationkey").alias("other_mid"))
    j = c.join(F.broadcast(n), (c.c_nationkey + 1) % 25 == n.other)
    k = F.col("entity") % 6
    pred = F.when(k == 3, F.col("mid")).when(k == 4, F.col("sibling")).when(k == 5, F.concat_ws(".", "other_mid", "c_mktsegment")).otherwise(F.col("leaf"))
    return j.select(F.col("entity").alias("id"), F.col("leaf").alias("truth"), pred.alias("pred"), ((F.col("entity") % 100) / 100.0).alias("conf"))


PAIRS = """pairs AS (SELECT entity AS id, leaf AS truth, CASE entity % 6 WHEN 3 THEN mid WHEN 4 THEN sibling WHEN 5 THEN n.n_regionkey || '.' || n.n_nationkey || '.' || c_mktsegment ELSE leaf END AS pred, (entity % 100) / 100.0::DOUBLE AS conf
 FROM cust JOIN nation n ON (c_nationkey + 1) % 25 = n.n_nationkey)"""
