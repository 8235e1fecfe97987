"""Benchmark decontamination with one Aho-Corasick automaton.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: letters,
digits and everything beyond ASCII. Every 10 consecutive words of an item are a
window; an item of fewer words, but not none, is one window. All windows of all
items go into one automaton over normalised text (words with single spaces), and
each document is normalised and scanned once. Hits are reported as word numbers
and, on request, as character offsets in the original text.

The distinct windows, with their items, are made by Spark. The automaton is built
once in each Python worker from the broadcast windows. Its size is proven first:
beyond ``BLOCK_CHARS`` characters of windows and item ids, the windows are dealt by
hash into blocks of at most that size (a window with more ids than that is a block
of its own); each document is scanned once for each block, one block after the other, and the
hits of the blocks are united row by row, without a shuffle.

Defined results: null and empty texts have no words and no hits; null item texts
and items without words have no windows; an item without an id marks its words, but
there is nothing to report it by; items with the same text are all reported; items
that repeat an id are one item; repeated rows get the same result each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at_work, remembers, staged, table, with_records_per_batch

WINDOW = 10
#: Bound on the characters of windows in one automaton (about 40 bytes of memory each).
BLOCK_CHARS = 4_000_000
#: A word before lower-casing.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(words: list[bytes]) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))}


def item_windows(benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """window, items (without null ids), size: the distinct windows of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, text in zip(*[c.to_pylist() for c in batch.columns]):
                found = [] if text is None else sorted(windows(normalise(text)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([ids] * len(found), pa.string())], names=["window", "item"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    found = with_records_per_batch(rows, 2000).mapInArrow(run, "window binary, item string").groupBy("window").agg(F.collect_set("item").alias("items"))
    size = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x))
    return found.select("window", "items", size.cast("long").alias("size"))


def window_blocks(benchmark: DataFrame, item: str, item_text: str) -> Iterator[tuple[tuple[bytes, tuple[str, ...]], ...]]:
    """Blocks of (window, item ids) of at most BLOCK_CHARS bytes, or of one window."""
    found = staged(item_windows(benchmark, item, item_text), "windows")
    total = found.agg(F.sum("size")).first()[0] or 0
    n = 1 if total <= BLOCK_CHARS else -(-2 * total // BLOCK_CHARS)
    while True:
        dealt = found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(n)))
        over = dealt.groupBy("block").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")).where((F.col("s") > BLOCK_CHARS) & (F.col("c") > 1))
        if over.isEmpty():
            break
        n *= 2
    for k in range(n):
        block = tuple((bytes(r["window"]), tuple(r["items"])) for r in dealt.where(F.col("block") == k).collect())
        if block:
            yield block


class Automaton:
    """The automaton of one block, and the items of each window."""

    def __init__(self, block: tuple[tuple[bytes, tuple[str, ...]], ...]):
        self.items = [ids for _, ids in block]
        self.trie = ahocorasick.Automaton()
        for k, (w, _) in enumerate(block):
            self.trie.add_word(f" {w.decode('utf-8', 'surrogatepass')} ", (k, w.count(b" ") + 1))
        if block:
            self.trie.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; merged hit spans in word numbers [from, to); items with an occurring window."""
        words = normalise(text) if text else []
        if not words or not self.items:
            return len(words), [], set()
        line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        hits = list(self.trie.iter(line))
        if not hits:
            return len(words), [], set()
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        last = np.searchsorted(blanks, [end for end, _ in hits])  # the word before blank number k has number k - 1
        merged: list[tuple[int, int]] = []
        for a, b in sorted({(int(b) - n, int(b)) for b, (_, (_, n)) in zip(last, hits)}):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return len(words), merged, {x for k in {k for _, (k, _) in hits} for x in self.items[k]}


#: The automata that this Python worker has built, by the name of their block.
_BUILT: dict[str, Automaton] = {}
remembers("decontaminate", _BUILT.clear)


def _automaton(name: str, block) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(block)
    return _BUILT[name]


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of spans in word numbers."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("word_spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, text: str, block) -> DataFrame:
    """docs with the columns of FOUND for one block of windows; one scan, no shuffle."""
    sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("decontaminate")
        automaton = _automaton(name, sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column(at).to_pylist()
                found = [automaton.scan(t) for t in texts]
                cols = [
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([sum(b - a for a, b in s) for _, s, _ in found], pa.int64()),
                    pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())),
                    pa.array([[{"begin": a, "end": b} for a, b in offsets(t, s)] for t, (_, s, _) in zip(texts, found)], _SPAN),
                    pa.array([[{"begin": a, "end": b} for a, b in s] for _, s, _ in found], _SPAN),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *FOUND.names])

    return with_records_per_batch(docs, 2000).mapInArrow(run, T.StructType([*docs.schema.fields, *FOUND.fields]))


def _united(a, b):
    """FOUND columns of two blocks as one."""
    def spans(x, y):
        def step(acc, s):
            joined = F.when(
                (F.size(acc) > 0) & (s["begin"] <= F.get(acc, F.size(acc) - 1)["end"]),
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["begin"].alias("begin"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end")))),
            )
            return joined.otherwise(F.concat(acc, F.array(s)))

        return F.aggregate(F.array_sort(F.concat(x, y)), F.array().cast("array<struct<begin:bigint,end:bigint>>"), step)

    return spans(a, b)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, items, spans (characters) and word_spans; its columns with these names give way to the results."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in FOUND.names]
    return scanned(row, window_blocks(benchmark, item, item_text)).select(*own, *FOUND.names)


def scanned(row: DataFrame, blocks: Iterator) -> DataFrame:
    """(_row, _text) with the columns of FOUND."""
    out = None
    for block in blocks:
        if out is None:
            out = _pass(row, "_text", block)
            continue
        # Written down, so that one automaton at a time is in memory.
        prior = staged(out.select("_row", "_text", F.struct(*FOUND.names).alias("_prior")), "hits")
        both = _pass(prior, "_text", block)
        words = _united(F.col("_prior.word_spans"), F.col("word_spans"))
        out = both.select(
            "_row",
            "_text",
            "n_words",
            F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"]).alias("n_hit"),
            F.array_sort(F.array_union("_prior.items", "items")).alias("items"),
            _united(F.col("_prior.spans"), F.col("spans")).alias("spans"),
            words.alias("word_spans"),
        )
    return out if out is not None else _pass(row, "_text", ())


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs without a word of an occurring window."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    return scanned(row, window_blocks(benchmark, "item_id", "text")).where(F.col("n_hit") == 0).select("_row.*")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
