"""Ranked lexical search for many queries at once, with their common parts evaluated once.

1. One pass over the texts counts, in each document, all terms and the query terms
   with their frequencies; it is written down. Document frequencies, the number of
   documents and their total length are sums over it.
2. The items of a block are turned into a sharing graph (``Graph``). Terms that stand
   in the same items are one leaf: a maximal set that these items share. Then the two
   nodes that most items have together become a new node, again and again while two
   items gain by it; an item is the sum of the nodes that are left to it.
3. A task takes some documents at a time. Each leaf's accumulator, a partial score for
   each of these documents, is made once from its terms; a shared node's is the sum
   of its two parts, made once and used by all items and nodes above it; an item's
   scores are the sum of its nodes. A task keeps the best k documents of each item,
   and of these the best k of all tasks remain, first within salts, then of all.

Scores are whole numbers (``weight``, ``lengths``, ``impacts``), so that the order of
sums plays no part and any graph gives the same ranking.

Bounds: a block of items has about ``BLOCK`` distinct terms (or one longer item); more
items are more blocks, each with its own pass, so a task and the driver hold the
vocabulary and the graph of one block. ``CELLS`` bounds the accumulators. How far
parts are shared is limited by ``WIDE``; the rest of an item is summed by itself.

Defined results: a null, empty or blank text has no terms and is never found; items
without terms have no rows; items that repeat an id are searched as one item with the
terms of all; rows that repeat a document's id are documents of their own; of equal
scores the smaller doc_id comes first, null last; an item with a null id is an item.
Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged, table

#: Documents that an item gets.
BEST = 50
#: Distinct terms of a block of items, and numbers in a task's accumulators.
BLOCK, CELLS = 200_000, 4_000_000
#: Nodes of an item, the most widely shared ones, among which pairs are looked for.
WIDE = 48
#: Bytes of text whose terms are cut at once.
CHUNK = 1 << 22
SALTS = 32
#: Characters of terms, as they are and lower-cased; all other ASCII characters part terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text's UTF-8 bytes, a piece of the text at a time."""
    raw = raw.translate(_TERM)
    at = 0
    while len(raw) - at > CHUNK:
        cut = raw.rfind(b" ", at, at + CHUNK)
        cut = cut if cut > at else raw.find(b" ", at + CHUNK)
        if cut < 0:
            break
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split()


def counted(raw: bytes) -> tuple[int, Counter]:
    n, counts = 0, Counter()
    for part in terms_of(raw):
        n += len(part)
        counts.update(part)
    return n, counts


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """item, terms (distinct) of every item that has terms."""

    def run(batches):
        for batch in batches:
            found = [list(counted(x)[1]) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"item {kind}, terms array<binary>")
    return rows.select("item", F.explode("terms").alias("t")).groupBy("item").agg(F.collect_set("t").alias("terms"))


class Graph(NamedTuple):
    """Nodes 0 .. leaves-1 are sums of terms, each later one of two earlier nodes."""

    leaf_of: np.ndarray
    leaves: int
    pairs: list[tuple[int, int]]
    items: list[list[int]]


def shared(items: list[list[int]], n_terms: int, wide: int = WIDE) -> Graph:
    """The sharing graph of items given as lists of term numbers."""
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for i, terms in enumerate(items):
        for t in terms:
            holders[t].append(i)
    leaf: dict[tuple[int, ...], int] = {}
    leaf_of = np.array([leaf.setdefault(tuple(x), len(leaf)) for x in holders], np.int64)
    members = [list(x) for x in leaf]
    nodes: list[set[int]] = [set() for _ in items]
    for node, own in enumerate(members):
        for i in own:
            nodes[i].add(node)
    pairs: list[tuple[int, int]] = []
    share = [len(x) for x in members]
    open_ = [sorted((x for x in own if share[x] > 1), key=lambda x: (-share[x], x))[:wide] for own in nodes]
    counts: Counter = Counter()
    among: dict[tuple[int, int], set[int]] = {}
    for i, own in enumerate(open_):
        for k, u in enumerate(sorted(own)):
            for v in sorted(own)[k + 1 :]:
                counts[u, v] += 1
                among.setdefault((u, v), set()).add(i)
    now = [set(x) for x in open_]
    by_count: dict[int, set[tuple[int, int]]] = {}
    for pair, c in counts.items():
        by_count.setdefault(c, set()).add(pair)

    def moved(pair: tuple[int, int], i: int, step: int) -> None:
        c = counts[pair]
        if c:
            by_count[c].discard(pair)
        counts[pair] = c + step
        if step > 0:
            among.setdefault(pair, set()).add(i)
        else:
            among[pair].discard(i)
        if counts[pair]:
            by_count.setdefault(counts[pair], set()).add(pair)

    best = max(by_count, default=0)
    while best >= 2:
        if not by_count.get(best):
            best -= 1
            continue
        u, v = pair = min(by_count[best])
        new = len(members) + len(pairs)
        pairs.append(pair)
        for i in sorted(among[pair]):
            for x in now[i]:
                for old in (u, v):
                    if x != old and not (old == v and x == u):
                        moved((min(x, old), max(x, old)), i, -1)
            now[i] -= {u, v}
            nodes[i] -= {u, v}
            for x in now[i]:
                moved((x, new), i, 1)
            now[i].add(new)
            nodes[i].add(new)
    return Graph(leaf_of, len(members), pairs, [sorted(x) for x in nodes])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents of n terms."""
    if len(n) and int(n.max()) * 50 * n_docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * n_docs // total for x in n], np.int64)
    return 50 + 50 * n * n_docs // total


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def postings(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """doc, n, t (query terms), tf of every document with terms."""
    kind = docs.schema[key].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get = known.value.get
        for batch in batches:
            keep, ns, ts, tfs = [], [], [], []
            for k, raw in enumerate(batch.column("text").cast(pa.binary())):
                n, counts = counted(raw.as_py())
                if n:
                    hits = [(t, c) for x, c in counts.items() if (t := get(x)) is not None]
                    keep.append(k)
                    ns.append(n)
                    ts.append([x[0] for x in hits])
                    tfs.append([x[1] for x in hits])
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(keep, pa.int64())), pa.array(ns, pa.int64()), pa.array(ts, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc", "n", "t", "tf"])

    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("text <> ''")
    return rows.mapInArrow(run, f"doc {kind}, n long, t array<int>, tf array<long>")


class Best:
    """The best k documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score has to reach it

    def add(self, scores: np.ndarray, docs: list) -> None:
        """scores: items x docs."""
        rows, cols = np.nonzero(scores >= self.least[:, None])
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for r, c in zip(np.split(rows, cuts), np.split(cols, cuts)):
            if not len(r):
                continue
            i = int(r[0])
            own = scores[i, c]
            if len(c) > self.k:  # ties with the last of the best k stay
                c = c[own >= np.partition(own, len(own) - self.k)[len(own) - self.k]]
            self.found[i] += [(-int(scores[i, x]), docs[x] is None, docs[x] if docs[x] is not None else 0) for x in c]
            self.found[i].sort()
            del self.found[i][self.k :]
            if len(self.found[i]) == self.k:
                self.least[i] = -self.found[i][-1][0]


def scored(rows: DataFrame, graph: Graph, weights: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """i, doc, score: the best k documents of each item in each task."""
    spark = rows.sparkSession
    plan = spark.sparkContext.broadcast((graph, weights))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches):
        graph, weights = plan.value
        n_nodes = graph.leaves + len(graph.pairs)
        wide = max(1, CELLS // (n_nodes + len(graph.items)))
        best = Best(len(graph.items), k)
        for batch in batches:
            for at in range(0, batch.num_rows, wide):
                part = batch.slice(at, wide)
                t, tf = part.column("t"), part.column("tf")
                sizes = np.diff(t.offsets.to_numpy())
                d = np.repeat(np.arange(len(sizes)), sizes)
                t, tf = t.flatten().to_numpy(), tf.flatten().to_numpy()
                m = lengths(part.column("n").to_numpy(), n_docs, total)
                acc = np.zeros((n_nodes, len(sizes)), np.int64)
                np.add.at(acc, (graph.leaf_of[t], d), impacts(weights[t], tf, m[d]))
                for new, (u, v) in enumerate(graph.pairs, graph.leaves):
                    np.add(acc[u], acc[v], out=acc[new])
                scores = np.stack([acc[nodes].sum(0) if len(nodes) > 1 else acc[nodes[0]] for nodes in graph.items])
                best.add(scores, part.column("doc").to_pylist())
        out = [(i, None if x[1] else x[2], -x[0]) for i, own in enumerate(best.found) for x in own]
        schema = pa.schema([("i", pa.int32()), ("doc", pa.string() if kind == "string" else pa.int64()), ("score", pa.int64())])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, f"i int, doc {'string' if kind == 'string' else 'long'}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank, doc, score: the best k documents of every item, ids under the names of their columns."""
    asked = staged(item_terms(items, item_key, item_text), "items")
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-n_terms // BLOCK))
    found = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        some = _search_block(docs, block, k, key, text)
        found = some if found is None else found.unionByName(some)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).orderBy(*order))).where(F.col("_r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("doc").cast(docs.schema[key].dataType).alias(key), "score")


def _search_block(docs: DataFrame, block: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """item, doc, score: of a block of items, the best k documents of each task."""
    spark = docs.sparkSession
    asked = sorted(((r["item"], sorted(bytes(x) for x in r["terms"])) for r in block.collect()), key=lambda x: (x[0] is None, x[0]))
    numbers: dict[bytes, int] = {}
    own = [[numbers.setdefault(x, len(numbers)) for x in terms] for _, terms in asked]
    with small_batches(spark, 1000):
        rows = staged(postings(docs, numbers, key, text), "postings")
    n_docs, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    for r in rows.select(F.explode("t").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    found = scored(rows, shared(own, len(numbers)), weights, n_docs, max(total, 1), k)
    kind = block.schema["item"].dataType.simpleString()
    names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(asked)], f"i int, item {kind}")
    return staged(found.join(F.broadcast(names), "i").select("item", "doc", "score"), "found")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
