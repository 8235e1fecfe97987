"""Line dedup: a suffix array over line ids by distributed prefix doubling.

A document is its sequence of lines that have a word; a line's id is a 64-bit hash
of its text. A line that occurs once in the corpus cannot be part of a repeated
run, so only the others go on; each ends the suffixes before it like the end of
the document does.

Suffixes are ranked by their first line, then by their first 2, 4, 8 ... lines: a
suffix's next rank is that of the pair of its own rank and the rank of the suffix
as many lines on. Equal pairs are summed up first (a line that a third of the
corpus has is one row for each task), the distinct pairs are sorted by range, and
the places in that order are the new ranks. Doubling goes on to the depth that the
shortest run of ``MIN_WORDS`` words needs at any place.

At that depth, suffixes with the same first m lines are neighbours in the array: an
interval whose longest common prefix has m lines or more. Its member that is first
by doc_id and line stays; the others are later copies of it. m is taken both ways:
the least lines that make up MIN_WORDS words from a line on, and those that make
them up backward from a line, as a run's last lines may be repeated from a place
that is not the first of the interval before.

A later copy that doesn't go on from the line before it is the start of a maximal
repeated run: its longest common prefix with the first copy gives the run's length.
That comparison is line by line on 128-bit ids, so no line goes because two short
hashes are equal. Every line of every run of MIN_WORDS words or more that occurs
earlier lies in one of these runs, and the lines of the runs are deleted.

Defined results: null, empty and blank texts have no lines; blank lines are
neither counted nor deleted; a null doc_id comes last in the order of copies; rows
that repeat a doc_id with the same text are one document and get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, hot_over, join_spread, staged, table, with_records_per_batch

#: Shortest run of lines, in words, that counts as repeated.
MIN_WORDS = 50
NO_RANK = -(1 << 63)


#: Later copies of one document beyond which a join spreads them over several tasks.
HOT = 20_000


def row_key(key: str, text: str) -> Column:
    """128 bits that name a document by id and text."""
    return F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))))


def worded(text: str | None) -> list[tuple[int, bytes, int]]:
    """(line number, line, words) of the lines that have a word."""
    found = [(k, line, len(line.split())) for k, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n"))]
    return [x for x in found if x[2]]


def lines(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """row, doc_id, j (place among the worded lines), id of the line and id2 (64 more bits of it), m (lines from here on that make min_words words, or 0), b (the same backward, or 0; also 0 where the window is that of its first line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                row, doc, place, ids, more, need, back = [], [], [], [], [], [], []
                for r, d, t in zip(*[c.to_pylist() for c in batch.columns]):
                    own = worded(t)
                    n = len(own)
                    if not n:
                        continue
                    total = np.cumsum([w for _, _, w in own])
                    end = np.searchsorted(total, np.concatenate(([0], total[:-1])) + min_words) + 1
                    m = np.where(end <= n, end - np.arange(n), 0)
                    first = np.searchsorted(np.concatenate(([0], total[:-1])), total - min_words, "right") - 1
                    b = np.where(first >= 0, np.arange(n) - first + 1, 0)
                    b[b == m[np.maximum(first, 0)]] = 0
                    row += [r] * n
                    doc += [d] * n
                    place += range(n)
                    both = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for _, x, _ in own]), np.int64)
                    ids += both[::2].tolist()
                    more += both[1::2].tolist()
                    need += m.tolist()
                    back += b.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in ((row, pa.binary()), (doc, pa.int64()), (place, pa.int32()), (ids, pa.int64()), (more, pa.int64()), (need, pa.int32()), (back, pa.int32()))], names=["row", "doc_id", "j", "id", "id2", "m", "b"]
                )

    rows = docs.select(row_key(key, text).alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_records_per_batch(rows, 2000).mapInArrow(run, "row binary, doc_id long, j int, id long, id2 long, m int, b int")


def met(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``join_spread``, or the join alone where no key is hot: four broadcasts less for the driver."""
    return left.join(right, keys) if hot.isEmpty() else join_spread(left, right, keys, hot)


def later_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """row, j, m, first_row, first_doc, first_j: the m worded lines from place j are a later copy of those from first_j on; maximal runs."""
    all_lines = staged(lines(docs, key, text, min_words), "lines")
    often = staged(all_lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    over = F.col("n") > hot_over(often.agg(F.sum("n")).first()[0] or 0)
    active = met(all_lines, often.select("id"), ["id"], often.where(over).select("id")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row").dropDuplicates(["row", "j"])
    by_row = Window.partitionBy("row").orderBy("j")
    active = active.withColumn("run", F.col("j") - F.row_number().over(by_row))
    stretch = Window.partitionBy("row", "run")
    active = active.withColumn("m", F.when(F.max("j").over(stretch) >= F.col("j") + F.col("m") - 1, F.col("m")).otherwise(F.lit(0)))
    active = active.withColumn("b", F.when(F.min("j").over(stretch) <= F.col("j") - F.col("b") + 1, F.col("b")).otherwise(F.lit(0)))
    active = staged(active.select("row", "doc_id", "j", "run", "m", "b", "id", "id2"), "active")
    ranked = active.select("row", "doc_id", "j", "run", "m", "b", F.col("id").alias("r"))
    deepest = ranked.agg(F.max(F.greatest("m", "b"))).first()[0] or 0
    found, k = [], 0
    while (1 << k) <= deepest:
        half = 1 << k
        # Two stretches of 2^k lines cover the first m lines: their ranks together name the interval.
        here = ranked.where((F.col("m") >= half) & (F.col("m") < 2 * half)).select("row", "doc_id", "j", "m", "r")
        backward = ranked.where((F.col("b") >= half) & (F.col("b") < 2 * half)).select("row", "doc_id", (F.col("j") - F.col("b") + 1).alias("j"), F.col("b").alias("m"))
        here = here.union(backward.join(ranked.select("row", "j", "r"), ["row", "j"]).select("row", "doc_id", "j", "m", "r"))
        here = here.withColumn("j2", F.col("j") + F.col("m") - half)
        exact = here.where(F.col("m") == half).select("row", "doc_id", "j", "m", "r", F.col("r").alias("r2"))
        if k:
            second = ranked.select("row", F.col("j").alias("j2"), F.col("r").alias("r2"))
            exact = exact.union(here.where(F.col("m") > half).join(second, ["row", "j2"]).select("row", "doc_id", "j", "m", "r", "r2"))
        found.append(staged(exact, f"windows{k}"))  # read three times below
        k += 1
        if (1 << k) > deepest:
            break
        nxt = F.lead("r", half).over(Window.partitionBy("row", "run").orderBy("j"))
        pairs = staged(ranked.withColumn("r2", F.coalesce(nxt, F.lit(NO_RANK))), f"pairs{k}")
        order = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).orderBy("r", "r2").select("r", "r2", "n", F.monotonically_increasing_id().alias("place"))
        order = staged(order, f"order{k}")
        ranked = staged(met(pairs, order.drop("n"), ["r", "r2"], order.where(over).select("r", "r2")).select("row", "doc_id", "j", "run", "m", "b", F.col("place").alias("r")), f"rank{k}")
    if not found:
        return ranked.select("row", "j", "m", F.col("row").alias("first_row"), F.col("doc_id").alias("first_doc"), F.col("j").alias("first_j")).where("m > 0")
    windows = found[0]
    for part in found[1:]:
        windows = windows.union(part)
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "j")
    interval = ["m", "r", "r2"]
    firsts = staged(windows.groupBy(*interval).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    copies = met(windows, firsts.drop("n"), interval, firsts.where(over).select(*interval)).where(~((F.col("row") == F.col("first.row")) & (F.col("j") == F.col("first.j"))))
    return prolonged(copies.select("row", "j", F.col("first.row").alias("first_row"), F.col("first.doc_id").alias("first_doc"), F.col("first.j").alias("first_j")), active)


def prolonged(copies: DataFrame, active: DataFrame) -> DataFrame:
    """The starts of runs among (row, j, first_row, first_doc, first_j), with m, their longest common prefix with the first copy."""
    on = Window.partitionBy("row", "first_row", F.col("j") - F.col("first_j")).orderBy("j")
    starts = copies.distinct().withColumn("before", F.lag("j").over(on)).where("before IS NULL OR before < j - 1").drop("before")
    starts = staged(starts, "starts")
    line = F.struct("j", "id", "id2")
    own = active.groupBy("row").agg(F.array_sort(F.collect_list(line)).alias("mine"))  # a document's repeated lines
    pairs = starts.join(own, "row")
    # A first copy of very many others is repeated for some of them each.
    hot = starts.groupBy("first_row").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")).where("parts > 1")
    theirs = own.select(F.col("row").alias("first_row"), F.col("mine").alias("theirs")).join(starts.select("first_row").distinct(), "first_row", "left_semi")
    theirs = theirs.join(hot, "first_row", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    pairs = pairs.join(hot, "first_row", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    def following(lines: str, j: str) -> Column:
        """The lines from j on that stand one after the other."""
        return F.filter(F.filter(lines, lambda x: x["j"] >= F.col(j)), lambda x, k: x["j"] == F.col(j) + k)

    same = F.zip_with(following("mine", "j"), following("theirs", "first_j"), lambda a, b: F.coalesce((a["id"] == b["id"]) & (a["id2"] == b["id2"]), F.lit(False)))
    other = F.array_position(same, False)
    met = pairs.join(theirs, ["first_row", "part"]).withColumn("m", F.when(other > 0, other - 1).otherwise(F.size(same)).cast("int"))
    return met.where("m > 0").select("row", "j", "m", "first_row", "first_doc", "first_j")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """key, n_lines, n_deleted, runs (of line numbers) and clean_text of every row of docs."""
    gone = staged(later_copies(docs, key, text, min_words).select("row", "j", "m"), "later")
    n = gone.count()
    spans = gone.groupBy("row").agg(F.collect_list(F.struct("j", "m")).alias("spans"))
    rows = docs.select(row_key(key, text).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    joined = rows.join(F.broadcast(spans) if n <= BROADCAST_ROWS else spans, "row", "left").select("id", "text", "spans")
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                out = [cut(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
                cols = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), span, pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], names=["id", "n_lines", "n_deleted", "runs", "clean_text"])

    out = with_records_per_batch(joined, 2000).mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, n_lines long, n_deleted long, runs array<struct<begin:bigint,end:bigint>>, clean_text string")
    return out.withColumnRenamed("id", key)


def cut(text: str | None, spans: list[dict] | None):
    """Worded lines, deleted ones, maximal deleted runs as [begin, end) of line numbers, and the rest of the text."""
    if not spans:
        return sum(1 for _ in worded(text)), 0, [], text
    own = worded(text)
    merged: list[list[int]] = []
    for a, b in sorted((s["j"], s["j"] + s["m"]) for s in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    gone = {own[j][0] for a, b in merged for j in range(a, b)}
    rest = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
    return len(own), len(gone), [{"begin": own[a][0], "end": own[b - 1][0] + 1} for a, b in merged], rest


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.size("runs").cast("long").alias("n_runs"), F.length("clean_text").cast("long").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))
