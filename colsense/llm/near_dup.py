"""MinHash near-duplicates, verified by odd sketches and then on full sets.

A document is the set of its distinct shingles (64-bit hashes of white-space words
after lower-casing A-Z; with fewer words than a shingle has, of the whole sequence).
Documents whose sets reach a Jaccard similarity are linked. Both are parameters:
the query takes 3 words and 0.85, the pipeline's stage 5 words and 0.80.

1. One pass over the texts makes, for each document, 256 MinHash samples. Bands
   (``method``) are as long as a pair at the threshold shares one of them but for a
   chance of ``MISS``: 32 of 6 samples at 0.85, 40 of 5 at 0.80. All 256 are folded
   into an odd sketch: each sample flips one bit of 1024, so the bits in which two
   sketches differ come only from samples that differ, and the share of differing
   bits estimates high similarities precisely. The bound on these bits follows from
   the threshold and ``MISS`` too.
2. Documents with equal sets become one class, whose smallest doc_id stands for
   it. Only representatives go on, so a text copied a million times counts once.
3. Representatives meet by (band, key). Buckets are counted with partial sums;
   those with one member are dropped. Inside a bucket, sketches are compared with
   XOR and population counts on whole arrays. A bucket over ``BLOCK`` members, or of
   more than ``BLOCK_SHINGLES`` shingles, is dealt into blocks; each two blocks meet
   in a group of their own, where pairs inside a block are left to that block, so no
   task holds a whole large bucket. A pair counts in the first band that it shares.
   What leaves this step is not pairs but the members that have a partner.
4. Their full sets meet in the same buckets. A search from member to member checks
   exact set sizes, never compares two members that are already connected, and
   returns one confirmed link for each member it reaches: less rows than members.
5. Connected components of these links by alternating large-star and small-star
   rounds, each a few aggregations, written to the shared folder in each round.

Defined results: a null, empty or blank text has an empty set and is linked with
nothing; rows that repeat a doc_id are one document; a null doc_id never names a
component, and a row with one is kept only if no row with an id has its set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_work, join_ids, staged, table, with_records_per_batch

#: Words of a shingle and least similarity in percent of op10_near_dup; other callers name theirs.
SHINGLE, PERCENT = 3, 85
SAMPLES, BITS = 256, 1024
#: Most members of a block of a bucket, and most shingles of them all (8 bytes each): two blocks meet in one task.
BLOCK, BLOCK_SHINGLES = 4096, 8_000_000
#: Largest chance that a pair at the threshold shares no band, and that its sketches differ in too many bits.
MISS = 5e-7
#: Bytes of text that are hashed at once.
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MUL = (_RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


class Method(NamedTuple):
    """Shingle length, least similarity in percent, and what follows from them."""

    shingle: int
    percent: int
    bands: int
    rows: int
    #: Pairs whose sketches differ in more bits are not checked.
    most_bits: int


@lru_cache
def method(shingle: int, percent: int) -> Method:
    """The longest bands and the least bound on bits that miss a pair at the threshold with a chance of MISS at most."""
    p = percent / 100
    if shingle < 1 or not 50 <= percent <= 100:
        raise ValueError(f"shingles of {shingle} words at {percent} %: 1 word or more and 50 to 100 % are supported")
    for rows in range(8, 0, -1):
        most = SAMPLES // rows // 8 * 8
        bands = 8 if p == 1 else -(-math.ceil(math.log(MISS) / math.log1p(-(p**rows))) // 8) * 8
        if bands <= most:
            break
    return Method(shingle, percent, bands, rows, most_bits(p))


def most_bits(p: float) -> int:
    """The bits in which sketches of a pair of similarity p differ at most, but for a chance of MISS."""
    k = np.arange(BITS + 1)
    now = np.zeros(BITS + 1)  # chances of k odd bits after two flips for each differing sample
    now[0] = 1
    total = p**SAMPLES * now
    for differing in range(1, SAMPLES + 1):
        for _ in range(2):
            new = np.zeros(BITS + 1)
            new[1:] = (now * (1 - k / BITS))[:-1]
            new[:-1] += (now * k / BITS)[1:]
            now = new
        total += math.comb(SAMPLES, differing) * (1 - p) ** differing * p ** (SAMPLES - differing) * now
    beyond = total[::-1].cumsum()[::-1]  # from k bits on
    return int(np.argmax(beyond <= MISS)) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (three xor-shifts, two multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = _powers(1 << 12)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every white-space word of a byte array."""
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sizes = ends - starts
    longest = int(sizes.max())
    power = _POW if longest <= len(_POW) else _powers(longest)
    inside = np.flatnonzero(~blank)
    first = np.repeat(starts, sizes)
    value = _LOWER[raw[inside]] * power[inside - first]
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return mix64(np.add.reduceat(value, at) + sizes.astype(np.uint64)), starts


def shingles(h: np.ndarray, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    n = len(h)
    if n == 0:
        return h
    if n < words:
        x = np.array([n], np.uint64)
        for v in h:
            x = mix64(x * np.uint64(31) ^ v)
        return x
    a = np.zeros(n - words + 1, np.uint64)
    for k in range(words - 1, -1, -1):
        a = mix64(h[k : n - words + 1 + k] * np.uint64(2 * k + 3) + a)
    return np.unique(a)


def sets_of(texts: pa.Array, words: int = SHINGLE) -> Iterator[np.ndarray]:
    """The shingle set of every text. Texts are joined by a blank and hashed about CHUNK bytes at a time."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, "right")) - 1)
        # A blank after each text keeps its last word apart from the next text's first.
        lens = np.diff(offsets[k : end + 1])
        begin = np.concatenate(([0], np.cumsum(lens + 1)))
        buf = np.full(begin[-1], 32, np.uint8)
        for j, b in enumerate(begin[:-1]):
            buf[b : b + lens[j]] = raw[offsets[k + j] : offsets[k + j + 1]]
        h, starts = word_hashes(buf)
        cut = np.searchsorted(starts, begin)
        for j in range(end - k):
            yield shingles(h[cut[j] : cut[j + 1]], words)
        k = end


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set."""
    low = None
    for k in range(0, len(s), 256):
        part = s[k : k + 256, None] * _MUL[None, :]
        part += _ADD
        m = part.min(axis=0)
        low = m if low is None else np.minimum(low, m)
    return mix64(low)


def band_keys(m: np.ndarray, how: Method) -> np.ndarray:
    x = np.arange(1, how.bands + 1, dtype=np.uint64)
    for r in m[: how.bands * how.rows].reshape(how.bands, how.rows).T:
        x = mix64(x * np.uint64(31) + r)
    return x


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (place, sample) pairs, as 16 words of 64 bits."""
    bit = mix64(m + np.arange(SAMPLES, dtype=np.uint64) * _BASE) & np.uint64(BITS - 1)
    odd = np.bincount(bit.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def signatures(docs: DataFrame, key: str, text: str, how: Method) -> DataFrame:
    """key, n (set size), hi, lo (names of the set), bands and sketch of every row."""

    def run(batches):
        at_work("near_dup")
        for batch in batches:
            out = []
            for s in sets_of(batch.column(1).fill_null(""), how.shingle):
                if not len(s):
                    out.append((0, 0, 0, None, None))
                    continue
                m = samples(s)
                name = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                out.append((len(s), int(s.sum().view(np.int64)), int(name.sum().view(np.int64)), band_keys(m, how).view(np.int64), odd_sketch(m).tobytes()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())],
                names=["id", "n", "hi", "lo", "bands", "sketch"],
            )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return with_records_per_batch(rows, 2000).mapInArrow(run, "id long, n long, hi long, lo long, bands array<long>, sketch binary")


def _by_group(batches, width: int) -> Iterator[pa.Table]:
    """Batches sorted by their first ``width`` columns, as tables that hold whole groups."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        keys = [held.column(c) for c in range(width)]
        last = [k[-1].as_py() for k in keys]
        same = np.ones(held.num_rows, bool)
        for k, v in zip(keys, last):
            same &= k.to_numpy() == v
        at = int(np.argmax(same))  # groups are contiguous: the last one starts here
        if at:
            yield held.slice(0, at).combine_chunks()
            held = held.slice(at)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _starts(t: pa.Table, width: int) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in range(width):
        k = t.column(c).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _fixed(column: pa.ChunkedArray, words: int, kind) -> np.ndarray:
    """A column of binaries of equal length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, words)


def _active(batches, how: Method):
    """bucket, block pair, id of the members with a partner whose sketch is near and whose first common band this is."""
    at_work("near_dup")
    for t in _by_group(batches, 3):
        n = t.num_rows
        begin = _starts(t, 3)
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
        band = t.column("band").to_numpy()
        mine, twice = t.column("mine").to_numpy(), t.column("b1").to_numpy() != t.column("b2").to_numpy()
        sketch = _fixed(t.column("sketch"), BITS // 64, np.uint64)
        bands = _fixed(t.column("bands"), how.bands, np.uint32)
        hit = np.zeros(n, bool)
        left = np.arange(n)
        for d in range(1, n):
            left = left[left + d < n]
            left = left[group[left] == group[left + d]]
            if not len(left):
                break
            for k in range(0, len(left), 20_000):
                a = left[k : k + 20_000]
                a = a[~twice[a] | (mine[a] != mine[a + d])]
                near = np.bitwise_count(sketch[a] ^ sketch[a + d]).sum(axis=1, dtype=np.int32) <= how.most_bits
                a = a[near]
                first = np.argmax(bands[a] == bands[a + d], axis=1)
                a = a[first == band[a]]
                hit[a] = hit[a + d] = True
        yield from t.select(["bucket", "b1", "b2", "id", "mine"]).filter(pa.array(hit)).to_batches()


def _links(batches, how: Method):
    """One confirmed link for each member that a search from member to member reaches."""
    at_work("near_dup")
    for t in _by_group(batches, 3):
        begin = np.append(_starts(t, 3), t.num_rows)
        ids = t.column("id").to_numpy()
        mine, b1, b2 = (t.column(c).to_numpy() for c in ("mine", "b1", "b2"))
        sets, sketches = t.column("members").to_pylist(), _fixed(t.column("sketch"), BITS // 64, np.uint64)
        out = []
        for a, b in zip(begin[:-1], begin[1:]):
            own = [np.frombuffer(x, np.uint64) for x in sets[a:b]]
            sk = sketches[a:b]
            free = np.ones(b - a, bool)
            for root in range(b - a):
                if not free[root]:
                    continue
                free[root] = False
                queue = [root]
                while queue:
                    x = queue.pop()
                    rest = np.flatnonzero(free)
                    if b1[a] != b2[a]:  # pairs inside a block are that block's own
                        rest = rest[mine[a + rest] != mine[a + x]]
                    near = rest[np.bitwise_count(sk[rest] ^ sk[x]).sum(axis=1, dtype=np.int32) <= how.most_bits]
                    for y in near:
                        if linked(own[x], own[y], how.percent):
                            free[y] = False
                            queue.append(int(y))
                            out.append((int(ids[a + x]), int(ids[a + y])))
        u, v = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def links(docs: DataFrame, reps: DataFrame, key: str, text: str, how: Method) -> DataFrame:
    """u, v: confirmed links that connect the representatives of one component."""
    spark = docs.sparkSession
    rows = reps.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    full = full.select("bucket", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # Bands differ in their keys' seeds, so a bucket belongs to one band.
    met = staged(rows.join(full, "bucket").select("bucket", "band", "blocks", "id"), "met")
    blocks = F.col("blocks")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(mine, o).alias("b1"), F.greatest(mine, o).alias("b2"))))
    dealt = met.select("bucket", "band", "id", mine.alias("mine"), pairs.alias("p")).select("bucket", "p.b1", "p.b2", "band", "id", "mine")
    small = reps.join(met.select("id").distinct(), "id", "left_semi").select("id", "sketch", F.col("bands").alias("all"))
    short = F.transform("all", lambda x: F.lpad(F.hex(x), 16, "0").substr(9, 8))
    sent = dealt.join(small.select("id", "sketch", F.unhex(F.array_join(short, "")).alias("bands")), "id").select("bucket", "b1", "b2", "band", "id", "mine", "sketch", "bands")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = sent.repartition(n, "bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2", "id")
    active = staged(near.mapInArrow(partial(_active, how=how), "bucket long, b1 int, b2 int, id long, mine int"), "active")

    ids = staged(active.select("id").distinct(), "ids")
    texts = join_ids(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), ids, "id", ids.count(), "left_semi")
    full_sets = with_records_per_batch(texts, 2000).mapInArrow(partial(_members, how=how), "id long, n long, hi long, lo long, members binary")
    chosen = reps.select("id", "n", "hi", "lo", "sketch")
    # Rows that repeat a doc_id with another text are told apart by the set's name.
    sets = full_sets.join(chosen, ["id", "n", "hi", "lo"])
    meet = active.join(sets, "id").select("bucket", "b1", "b2", "id", "mine", "members", "sketch")
    return meet.repartition(n, "bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2", "id").mapInArrow(partial(_links, how=how), "u long, v long")


def _members(batches, how: Method):
    at_work("near_dup")
    for batch in batches:
        out = []
        for s in sets_of(batch.column(1).fill_null(""), how.shingle):
            name = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            out.append((len(s), int(s.sum().view(np.int64)) if len(s) else 0, int(name.sum().view(np.int64)) if len(s) else 0, s.tobytes()))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["id", "n", "hi", "lo", "members"])


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in edges (u, v)."""
    pairs = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # Large star: every larger neighbour is tied to the smallest one.
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every smaller neighbour and the node itself are tied to the smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = staged(small, "edges")
        # Done when all are stars: no centre is itself tied to another one.
        if new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            return new.select(F.col("u").alias("id"), F.col("v").alias("component")).union(new.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        pairs = new


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, sketches: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs, with shingles of that many words and links from that similarity on.

    Without ``sketches`` every pair that shares a band is compared on its full sets.
    """
    how = method(shingle, percent)
    if not sketches:
        how = how._replace(most_bits=BITS)
    sigs = staged(signatures(docs, key, text, how), "signatures")
    name = ["n", "hi", "lo"]
    reps = staged(sigs.where("n > 0 AND id IS NOT NULL").groupBy(*name).agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands"), F.min_by("sketch", "id").alias("sketch")), "reps")
    comps = components(links(docs, reps, key, text, how))
    # Where a doc_id comes with several texts, its classes are one document.
    classes = reps.select(*name, F.col("id").alias("rep")).join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*name, F.coalesce("component", "rep").alias("component"))
    out = sigs.select("id", *name).join(classes, name, "left")
    comp = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        comp.alias("component_id"),
        F.coalesce(F.col("id") == comp, F.col("id").isNull() & comp.isNull()).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose document is kept; rows without an id are all kept, as nothing names them."""
    gone = staged(near_duplicates(docs, key, text, shingle, percent).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key)).distinct(), "gone")
    return join_ids(docs, gone, key, gone.count(), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
