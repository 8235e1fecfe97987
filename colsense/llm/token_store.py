"""Token ids in a content-addressed store.

One pass over the texts encodes them and cuts each id stream where a rolling hash
over the last 16 ids says so; a cut depends on the ids near it alone, so copies
and texts with common parts give common chunks. A chunk is named by the BLAKE2b
digest of its bytes. The store, all Parquet below one folder:

- ``chunks``: digest, ids (little-endian, 2 bytes each below 65,536, else 4;
  zstandard), n, width: each distinct chunk once;
- ``recipes``: root, digests, lengths: each distinct document content once, named
  by the Merkle root of its chunks' digests;
- ``documents``: doc_id, root, start, n_tokens in ascending doc_id order, files in
  that order too; ``start`` counts the ids of all documents before it;
- ``manifest``: a Merkle tree over the chunk digests by their leading bits, with
  at most some hundreds of entries in a node.

Reading back recomputes every digest, every Merkle root and the manifest from the
stored bytes. A document's CRC-32 is put together from those of its chunks (CRCs
are linear), so no payload is shuffled to the documents that use it and a chunk
that a million copies share is read once; ``read_ids`` gives the ids themselves.

Defined results: null texts are encoded as empty ones; control strings of the
vocabulary inside a text are ordinary text, or with ``specials`` (as in the query) the
control ids that the library makes of them; null doc_ids come first in the order;
repeated rows are documents of their own. An empty table gives empty files.
"""

from __future__ import annotations

import gc
import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import at_work, give_back, hot_over, join_spread, remembers, shared_dir, staged, table, with_records_per_batch

VOCABULARY, END = "byte_bpe_50k.json", 2
#: Sizes of chunks in ids: least, most, and the bits of the rolling hash that are 0 at a cut.
LEAST, MOST, CUT_BITS = 128, 8192, 10
#: Parts of text whose ids each of the two generations of a Python worker's memory holds.
REMEMBERED = 300_000
#: Bytes of text that are encoded at once.
AT_ONCE = 4 << 20
#: Stands before a part of a text that has no blank before it.
MARK = "\x01"
#: How byte-level vocabularies write the bytes from 128 on (fixed values): Latin-1's printable characters as they are, the others from U+0122 on.
BYTES = {**{b: 162 + b for b in range(128, 161)}, 173: 323}

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


class Encoder:
    """Ids of whole texts.

    The vocabulary's pattern never joins what stands before a blank between two
    other characters with what follows it, nor a letter with a full stop or comma
    that ends a word, nor a line break between two other characters with either of
    them. So a text's ids are those of such parts, one after the other. Texts are
    split there, and each distinct part of some MB of text is looked up once. Parts
    are remembered in two generations: when the new one is full it becomes the old
    one, and a part that is met again moves on to the new one, so frequent words
    stay and rare ones go.

    A part's name is the word itself if it stands behind a blank, which belongs to
    it, else ``MARK`` and its text: "." and ",", a line break with the word behind
    it, a text's first word.
    """

    def __init__(self, path: str, specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = not specials
        self.controls = [x.content for x in self.model.get_added_tokens_decoder().values()] if specials else []
        self.code = "H" if self.model.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.line_break = self.plain("\n")

    def plain(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def letters(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words of letters: the pattern keeps each in one piece, so they go to the model as they are."""
        tokenize = self.model.model.tokenize
        as_bytes = [w if w.isascii() else w.encode().decode("latin-1").translate(BYTES) for w in words]
        return [array(self.code, [t.id for t in tokenize(lead + w)]).tobytes() for w in as_bytes]

    def learn(self, names: list[str]) -> None:
        """Remembers the ids of parts."""
        behind, broken, first, other = [], [], [], []
        for x in names:
            if x[0] != MARK:
                (behind if latin(x) else other).append(x)
            elif x[1] == "\n":
                (broken if latin(x[2:]) else other).append(x)
            else:
                (first if latin(x[1:]) else other).append(x)
        self.new.update(zip(behind, self.letters(behind, "Ġ")))
        self.new.update(zip(broken, [self.line_break + x for x in self.letters([x[2:] for x in broken], "")]))
        self.new.update(zip(first, self.letters([x[1:] for x in first], "")))
        for k in range(0, len(other), 1000):
            some = other[k : k + 1000]
            coded = self.model.encode_batch_fast([x[1:] if x[0] == MARK else " " + x for x in some], add_special_tokens=False)
            self.new.update(zip(some, [array(self.code, x.ids).tobytes() for x in coded]))

    def parts(self, names: list[str]) -> list[bytes | None]:
        """Ids of distinct parts; None for those that cannot stand alone."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found: list[bytes | None] = list(map(new.get, names))
        fresh = []
        for k in [k for k, x in enumerate(found) if x is None]:
            name = names[k]
            known = old.get(name)
            if known is not None:
                new[name] = found[k] = known
            elif name.isalpha() or whole(name[2:] if name[:2] == MARK + "\n" else name[1:] if name[:1] == MARK else name):
                fresh.append(k)
        self.learn([names[k] for k in fresh])
        for k in fresh:
            found[k] = new[names[k]]
        return found

    def encode(self, texts: pa.Array, tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with a tail behind it, one after the other, and where each text's begin (and the last ends)."""
        cut = pc.replace_substring_regex(texts, r"(\pL)([.,])([ \n]|$)", rf"\1 {MARK}\2\3")
        split = pc.split_pattern(pc.replace_substring(cut, "\n", f" {MARK}\n"), " ")
        begin, values = split.offsets.to_numpy(), split.flatten()
        coded = values.dictionary_encode()
        starts = values.take(pa.array(begin[:-1])).dictionary_encode()
        ids_of = [*self.parts(_strings(coded.dictionary)), *self.parts([MARK + x for x in _strings(starts.dictionary)]), tail]
        # The number of each part; a text's first one has no blank before it.
        number = coded.indices.to_numpy().copy()  # 32 bits, like all places below: a slice has few MB
        number[begin[:-1]] = starts.indices.to_numpy() + len(coded.dictionary)
        number = np.insert(number, begin[1:], len(ids_of) - 1)
        bounds = begin + np.arange(len(begin))
        alone = np.array([x is not None for x in ids_of])
        width = self.kind.itemsize
        size = np.array([len(x or b"") // width for x in ids_of], np.int32)
        flat = np.frombuffer(b"".join([x or b"" for x in ids_of]), self.kind)
        taken = size[number]
        ends = np.zeros(len(number) + 1, np.int32)
        np.cumsum(taken, out=ends[1:])
        place = np.repeat((np.cumsum(size, dtype=np.int32) - size)[number] - ends[:-1], taken)
        place += np.arange(len(place), dtype=np.int32)
        ids, at = flat[place], ends[bounds]
        # Texts with blanks beside white space or at an end, with the mark, or with strings that become control ids, are encoded as they are.
        odd = np.diff(np.concatenate(([0], np.cumsum(~alone[number])))[bounds]) > 0
        for x in (MARK, *self.controls):
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not odd.any():
            return ids, at
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.frombuffer(self.plain(texts[k].as_py()) + tail, self.kind)
        return np.concatenate(out), np.concatenate(([0], np.cumsum([len(x) for x in out])))


def _strings(pieces: pa.Array) -> list[str]:
    """Strings without a blank, by way of one string: quicker than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py().split(" ") if len(pieces) else []


def latin(word: str) -> bool:
    """Whether a word is of letters that every version of Unicode since 7 has: Latin, Greek, Cyrillic."""
    return word.isalpha() and (word.isascii() or max(word) < "԰")


def whole(piece: str) -> bool:
    """Whether a piece neither is empty nor begins or ends with white space."""
    return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
remembers("token_store", _ENCODERS.clear)


def encoder(path: str, specials: bool) -> Encoder:
    if (path, specials) not in _ENCODERS:
        _ENCODERS[path, specials] = Encoder(path, specials)
    return _ENCODERS[path, specials]


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Places in an id stream after which its last 16 ids ask for a cut.

    Several documents may stand in one stream: a mark that depends on the document
    before is among the first 15 places, where no chunk ends.
    """
    found = []
    for k in range(0, len(ids), 1 << 16):
        begin = max(0, k - 15)
        rolled = _GEAR[ids[begin : k + (1 << 16)] & 0xFFFF]
        for step in (1, 2, 4, 8):  # sums over the last 2, 4, 8 and 16 ids
            rolled[step:] += rolled[:-step] << np.uint64(step)
        found.append(np.flatnonzero(mixed(rolled[k - begin :]) >> np.uint64(64 - CUT_BITS) == 0) + k + 1)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cuts(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids with marks at these places."""
    if n <= LEAST:
        return [n]
    out, last = [], 0
    for c in [*marks, n]:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST or c == n and c > last:
            out.append(c)
            last = c
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node goes up as it is; leaves and nodes are hashed apart."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[k : k + 2]), digest_size=16).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


#: Columns of a chunk.
CHUNK = [("digest", pa.binary()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary())]


def _encoded(docs: DataFrame, key: str, text: str, path: str, end: int, specials: bool) -> DataFrame:
    """A row for each document (root, digests, lengths) with the chunks that its task had not met before."""
    schema = "doc_id long, root binary, n_tokens long, digests array<binary>, lengths array<int>, new array<struct<digest:binary,n:int,width:int,ids:binary>>"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_records_per_batch(rows, 2000).mapInArrow(partial(_chunked, path=path, end=end, specials=specials), schema)


def _chunked(batches: Iterator[pa.RecordBatch], path: str, end: int, specials: bool) -> Iterator[pa.RecordBatch]:
    at_work("token_store")
    model, pack = encoder(path, specials), zstandard.ZstdCompressor(level=1)
    width = model.kind.itemsize
    tail = np.array([end], model.kind).tobytes()
    met: set[bytes] = set()
    for whole_batch in batches:
        for batch in _slices(whole_batch, 1):
            gc.disable()  # some 100,000 short-lived objects and no cycles
            ids, begin = model.encode(batch.column(1), tail)
            gc.enable()
            give_back()
            marks = cut_marks(ids)
            span = np.searchsorted(marks, begin, "right").tolist()
            roots, sizes, names, lengths, new, offsets = [], [], [], [], [], [0]
            for j in range(len(begin) - 1):
                data = ids[begin[j] : begin[j + 1]].tobytes()
                n, last, own, lens = len(data) // width, 0, [], []
                for c in cuts(n, (marks[span[j] : span[j + 1]] - begin[j]).tolist()):
                    part = data[last * width : c * width]
                    own.append(name := digest(part))
                    lens.append(c - last)
                    if name not in met:
                        met.add(name)
                        new.append((name, c - last, width, pack.compress(part)))
                    last = c
                roots.append(merkle_root(own))
                sizes.append(n)
                names.append(own)
                lengths.append(lens)
                offsets.append(len(new))
            if len(met) > 500_000:
                met.clear()
            fresh = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*new) if new else [[]] * 4, CHUNK)], names=[x for x, _ in CHUNK])
            cols = [pa.array(roots, pa.binary()), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fresh)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "root", "n_tokens", "digests", "lengths", "new"])


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about AT_ONCE bytes of text, one row at least."""
    total = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + AT_ONCE, "right")))
        yield batch.slice(k, end - k)
        k = end


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, specials: bool = False) -> None:
    """Writes the store of all rows of docs below folder."""
    spark = docs.sparkSession
    coded = staged(_encoded(docs, key, text, path or public_tokenizers.path(VOCABULARY), end, specials), "encoded")
    new = coded.select(F.inline("new"))
    new.dropDuplicates(["digest"]).write.parquet(f"{folder}/chunks")
    coded.select("root", "digests", "lengths").dropDuplicates(["root"]).write.parquet(f"{folder}/recipes")

    # Files in ascending doc_id order, then running sums from the totals of each file's part.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.select("doc_id", "root", "n_tokens").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered = staged(ordered.withColumn("part", F.spark_partition_id()), "ordered")
    totals = ordered.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = totals.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.join(before, "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    (
        placed.select("doc_id", "root", "start", "n_tokens")
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "start")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "start")
        .write.parquet(f"{folder}/documents")
    )
    manifest(spark.read.parquet(f"{folder}/chunks")).write.parquet(f"{folder}/manifest")


def manifest(chunks: DataFrame) -> DataFrame:
    """level, node, n, hash: the Merkle tree over the digests by their leading bits; the root is the highest level's one node."""
    rows = chunks.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    bits = max(0, (rows // 256).bit_length())
    lead = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    level = staged(
        chunks.select(F.shiftright(lead, 56 - bits).alias("node"), F.hex("digest").alias("h"))
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("hash")),
        "leaves",
    )
    out, k = level.select(F.lit(0).alias("level"), "node", "n", "hash"), 0
    while bits > 0:
        bits, k = max(0, bits - 8), k + 1
        up = level.select(F.shiftright("node", 8).alias("node"), "n", F.struct("node", "hash").alias("x"))
        level = up.groupBy("node").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("x")).alias("x")).select("node", "n", F.sha2(F.array_join(F.transform("x", lambda v: v["hash"]), ""), 256).alias("hash"))
        out = out.union(level.select(F.lit(k).alias("level"), "node", "n", "hash"))
    return out


# CRC-32 arithmetic: polynomials over GF(2) modulo CRC's own, highest power in the lowest bit.
_POLY = np.uint32(0xEDB88320)


def times_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of two arrays of polynomials."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(len(a), np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRCs carried past ``zeros`` bytes that follow."""
    power, out, left = np.array([0x00800000], np.uint32), crc.astype(np.uint32), zeros.astype(np.int64)  # x^8: one byte
    while left.any():
        odd = (left & 1).astype(bool)
        if odd.any():
            out[odd] = times_mod(np.repeat(power, int(odd.sum())), out[odd])
        power = times_mod(power, power)
        left = left >> 1
    return out


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest and CRC-32 (of 4-byte ids) of every chunk whose bytes give its digest and length."""
    at_work("token_store, reading")  # the ids of words are no longer needed
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for name, n, width, ids in zip(*[c.to_pylist() for c in batch.columns]):
            data = unpack.decompress(ids)
            if digest(data) != name or len(data) != n * width:
                raise ValueError(f"chunk {name.hex()} is damaged")
            rows.append((name, n, zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())))
        a, b, c = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int32()), pa.array(c, pa.int64())], names=["digest", "n", "crc"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, after = batch.column("crc").to_numpy().astype(np.uint32), batch.column("after").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("n"), pa.array(shifted(crc, after * 4).astype(np.int64))], names=["root", "n", "crc"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes whose digests give their root, with the number of ids after each chunk."""
    for batch in batches:
        rows = []
        for root, names, lengths in zip(*[c.to_pylist() for c in batch.columns]):
            if merkle_root(names) != root:
                raise ValueError(f"recipe {root.hex()} is damaged")
            after = sum(lengths)
            for name, n in zip(names, lengths):
                after -= n
                rows.append((root, name, n, after))
        cols = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["root", "digest", "length", "after"])


def verified(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    A damaged chunk, recipe or manifest, or a chunk that is missing, ends the job with an error.
    """
    chunks = spark.read.parquet(f"{folder}/chunks")
    differ = manifest(chunks).exceptAll(spark.read.parquet(f"{folder}/manifest"))
    if not differ.isEmpty():
        raise ValueError("the manifest does not fit the chunks")
    crcs = chunks.select("digest", "n", "width", "ids").mapInArrow(_checked, "digest binary, n int, crc long")
    parts = spark.read.parquet(f"{folder}/recipes").select("root", "digests", "lengths").mapInArrow(_rooted, "root binary, digest binary, length long, after long")
    joined = parts.join(crcs, "digest", "left").select("root", F.coalesce(F.col("n").cast("long"), F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("n"), "crc", "after")
    whole = joined.mapInArrow(_carried, "root binary, n long, crc long").groupBy("root").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("ids_crc32"))
    docs = spark.read.parquet(f"{folder}/documents")
    # A content that very many documents have is broadcast to them.
    hot = docs.groupBy("root").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_over(docs.count())).select("root")
    return join_spread(docs, whole, ["root"], staged(hot, "hot")).select(
        "doc_id", "start", F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's length is wrong")).cast("long")).alias("n_tokens"), "ids_crc32"
    )


def read_ids(spark, folder: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id, start, ids (array<int>) of the documents whose doc_id is in doc_ids."""
    docs = spark.read.parquet(f"{folder}/documents").join(doc_ids.distinct(), "doc_id", "left_semi")
    parts = docs.join(spark.read.parquet(f"{folder}/recipes"), "root").select("doc_id", "start", F.posexplode("digests").alias("k", "digest"))
    found = parts.join(spark.read.parquet(f"{folder}/chunks"), "digest").select("doc_id", "start", "k", "width", "ids")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [np.frombuffer(unpack.decompress(x), f"<u{w}").astype(np.int32) for x, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "k", "ids"])

    back = found.mapInArrow(run, "doc_id long, start long, k int, ids array<int>")
    return back.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x")).select("doc_id", "start", F.flatten(F.transform("x", lambda v: v["ids"])).alias("ids"))


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", specials: bool = False) -> DataFrame:
    """Writes docs to a new store in the shared folder and reads it back."""
    folder = f"{shared_dir(docs.sparkSession)}/store"
    write(docs, folder, key, text, specials=specials)
    return verified(docs.sparkSession, folder)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), specials=True)
