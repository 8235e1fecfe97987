"""Conversation structure repair by a run-length dynamic programme.

A conversation's rows, in order of turn (nulls first; ties by role, then by the MD5
of the text), are edited at least cost into roles that read ``(s?(ua)+)?``: an
optional system row, then user and assistant in turn, or nothing. Keep costs 0,
Rerole to user or assistant 2, Delete 3 and Insert of an empty user or assistant row
2; a row that stays although it is truncated adds 1, blank and duplicate rows have to
go. Among the cheapest the ASCII-least audit (initials of the edits) is taken.

1. Rows are numbered inside their conversation by ranges (``sampling.numbered``) and
   become symbols: role initial and fault. A duplicate is a row behind the first one
   with its role and text.
2. ``SEGMENT`` symbols in a row are a segment, so a long conversation is many tasks'
   work. In a segment equal consecutive symbols are a run. Four states (nothing yet,
   after system, after user, after assistant) and a symbol give a 4 x 4 matrix in the
   min-plus semiring: inserts, then the row's edit. A run of r symbols is the r-th
   power, put together from cached binary powers; the product of the runs is the
   segment's matrix.
3. From the last segment of a conversation back, each gets the costs that are left
   behind it for each state (a matrix-vector product for 4,096 rows).
4. Segments are unrolled on their own for each state in which they can begin: of the
   letters that keep the total at the optimum the least is taken. A run's letters are
   put together from blocks of 2^k symbols, remembered by symbol, k, state and the
   costs that are left. The states in which segments do begin then follow in order.

``repair`` writes repaired rows and audits. Only the digest of a whole conversation is
sequential by its nature: its rows pass through one task in sorted order, in batches,
and none of them is held.

Defined results: null roles and texts are one space (so the text is blank and the
role is neither s, u nor a); other roles are known by their first character alone; a
null conv_id is a conversation; repeated rows are duplicates; other columns are
ignored; a conversation without rows has an empty audit. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.operators.sampling import numbered

from .common import SPACES, hot_over, shared_dir, small_batches, staged, table

SEGMENT = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 60
#: States: nothing yet, after system, after user, after assistant; which state and role an inserted or reroled row leads to.
STATES = range(4)
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: Costs to an accepting state by inserts alone.
ENDS = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, state, cost) of the edits of a row, by letter. code: role initial (o for others), then 0, 1 (truncated) or 2 (has to go)."""
    role, fault = code
    found = [("D", state, DELETE)]
    if fault != "2":
        more = TRUNCATED * (fault == "1")
        kept = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(role)
        if kept is not None:
            found.append(("K", kept, KEEP + more))
        found.append(("R", NEXT[state], REROLE + more))
    return found


@lru_cache
def power(code: str, level: int) -> Matrix:
    """The min-plus matrix of 2^level rows with this symbol."""
    if level:
        half = power(code, level - 1)
        return times(half, half)
    rows = []
    for begin in STATES:
        row, state, cost = [FAR] * 4, begin, 0
        for _ in range(3):  # more than two inserts only lead round
            for _, to, c in edits(code, state):
                row[to] = min(row[to], cost + c)
            state, cost = NEXT[state], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(a[p][k] + b[k][q] for k in STATES), FAR) for q in STATES) for p in STATES)


def before(m: Matrix, rest: Vector) -> Vector:
    """The costs that are left before what m stands for."""
    return tuple(min(min(m[p][q] + rest[q] for q in STATES), FAR) for p in STATES)


def runs(codes: str) -> list[tuple[str, list[int]]]:
    """Symbols of the runs and the binary powers that make up their lengths, largest first."""
    symbols = (codes[k : k + 2] for k in range(0, len(codes), 2))
    found = []
    for code, own in groupby(symbols):
        n = sum(1 for _ in own)
        found.append((code, [k for k in reversed(range(n.bit_length())) if n >> k & 1]))
    return found


def matrix(codes: str) -> Matrix:
    """Of a whole segment."""
    total = tuple(tuple(0 if p == q else FAR for q in STATES) for p in STATES)
    for code, levels in runs(codes):
        for level in levels:
            total = times(total, power(code, level))
    return total


@lru_cache(maxsize=4096)
def unrolled(code: str, level: int, state: int, rest: Vector) -> tuple[str, int]:
    """The least cheapest letters for 2^level rows from a state, and the state after them; rest: costs that are left behind, 0 the least."""
    if level:
        first, middle = unrolled(code, level - 1, state, levelled(before(power(code, level - 1), rest)))
        second, end = unrolled(code, level - 1, middle, rest)
        return first + second, end
    left, letters = before(power(code, 0), rest), ""
    while True:
        options = {letter: to for letter, to, cost in edits(code, state) if cost + rest[to] == left[state]}
        if "D" not in options and INSERT + left[NEXT[state]] == left[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        least = min(options)
        return letters + least, options[least]


def levelled(v: Vector) -> Vector:
    least = min(v)
    return tuple(x - least for x in v)


def unroll(codes: str, state: int, rest: Vector) -> tuple[str, int]:
    """The letters of a segment from a state on, and the state behind it."""
    blocks = [(code, level) for code, levels in runs(codes) for level in levels]
    lefts = [rest]
    for code, level in reversed(blocks):
        lefts.append(before(power(code, level), lefts[-1]))
    letters = []
    for (code, level), left in zip(blocks, reversed(lefts[:-1])):
        own, state = unrolled(code, level, state, levelled(left))
        letters.append(own)
    return "".join(letters), state


def closing(state: int) -> str:
    """The inserts behind the last row."""
    return {1: "II", 2: "I"}.get(state, "")


def pieces(codes: str, state: int, letters: str) -> list[list[str]]:
    """For each row what it becomes, in order: +role (inserted), = (kept), a role, - (deleted); inserts at the end belong to the last row."""
    found: list[list[str]] = [[]]
    k = 0
    for letter in letters:
        if k == len(codes) // 2 and letter == "I":
            state = NEXT[state]
            found[k - 1].append("+" + ROLES[state])
            continue
        if letter == "D":
            found[k].append("-")
        elif letter == "K":
            state = next(to for x, to, _ in edits(codes[2 * k : 2 * k + 2], state) if x == "K")
            found[k].append("=")
        else:
            state = NEXT[state]
            found[k].append(("+" if letter == "I" else "") + ROLES[state])
        if letter != "I":
            k += 1
            found.append([])
    return found[:-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one row in 20 dropped, emptied, without ends of sentences, repeated, or said by the user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("d") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("d")).drop("d")


def _group(conv_id: Column) -> Column:
    """A conversation's name, never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def placed(conversations: DataFrame) -> DataFrame:
    """g, turn, role, text, i (place), h (role and text) of every row."""
    rows = conversations.select(_group(F.col("conv_id")).alias("g"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("md5", F.md5(F.col("text").cast("binary"))).withColumn("part", F.floor(F.rand(1) * 1024))  # like rows go to several ranges
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("md5"), F.col("part")]
    rows = numbered(rows, ["g"], order).withColumn("h", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256))
    return staged(rows.select("g", "turn", "role", "text", "i", "h"), "rows")


def marked(rows: DataFrame) -> DataFrame:
    """g, turn, i, seg, initial and fault of every row."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    kind = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    again = staged(rows.groupBy("g", "h").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "again")
    most = hot_over(rows.count())
    few, rest = again.where(F.col("c") > most), again.where(F.col("c") <= most)
    hot = rows.select("g", "turn", "i", "h", initial.alias("initial"), kind.alias("kind")).join(F.broadcast(few.drop("c")), ["g", "h"], "left")
    both = hot.where("first IS NOT NULL").unionByName(hot.where("first IS NULL").drop("first").join(rest.drop("c"), ["g", "h"], "left").select(*hot.columns))
    fault = F.when(F.col("kind") == "blank", "blank").when(F.col("i") > F.col("first"), "duplicate").otherwise(F.col("kind"))
    return staged(both.select("g", "turn", "i", F.floor(F.col("i") / SEGMENT).cast("int").alias("seg"), "initial", fault.alias("fault")), "marked")


def segments(marks: DataFrame) -> DataFrame:
    """g, seg, codes, m (matrix, row by row) of every segment."""
    code = F.concat("initial", F.when(F.col("fault").isin("blank", "duplicate"), "2").when(F.col("fault") == "truncated", "1").otherwise("0"))
    own = marks.groupBy("g", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", code.alias("code")))), lambda x: x["code"]), "").alias("codes"))

    def run(batches):
        for batch in batches:
            found = [[x for row in matrix(codes) for x in row] for codes in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "m"])

    return own.mapInArrow(run, "g string, seg int, codes string, m array<long>")


def _in_order(df: DataFrame, field: str, f, name: str) -> DataFrame:
    """g, seg, ``name``: f of a conversation's values of a field in order of segments, one number or list for each; a small row for each segment."""
    told = df.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("seg", field))).alias("x")).select("g", F.transform("x", lambda x: x[field]).alias("x"))

    def run(batches):
        for batch in batches:
            found = [f(x) for x in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(found, pa.list_(pa.list_(pa.int64())))], names=["g", "y"])

    return told.mapInArrow(run, "g string, y array<array<long>>").select("g", F.posexplode("y").alias("seg", name))


def _rests(matrices: list[list[int]]) -> list[list[int]]:
    """For each segment the costs left behind it, those left before it, and whether it is the last."""
    found, rest, last = [], tuple(ENDS), 1
    for m in reversed(matrices):
        now = before(tuple(tuple(m[4 * p : 4 * p + 4]) for p in STATES), rest)
        found.append([*rest, now[0], last])
        rest, last = now, 0
    return found[::-1]


def _begins(ends: list[list[int]]) -> list[list[int]]:
    """The state in which each segment begins."""
    found, state = [], 0
    for own in ends:
        found.append([state])
        state = own[state]
    return found


def audited(marks: DataFrame) -> DataFrame:
    """g, seg, cost (what is left from the segment on), letters, pieces of every segment."""
    segs = staged(segments(marks), "segments")
    segs = segs.select("g", "seg", "codes").join(_in_order(segs, "m", _rests, "rest"), ["g", "seg"])

    def walk(batches):
        for batch in batches:
            found = [[unroll(codes, p, tuple(rest[:4])) for p in STATES] for codes, rest in zip(batch.column("codes").to_pylist(), batch.column("rest").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[x[1] for x in y] for y in found], pa.list_(pa.int64())), pa.array([[x[0] for x in y] for y in found], pa.list_(pa.string()))], names=[*batch.schema.names, "ends", "letters"])

    walked = staged(segs.mapInArrow(walk, "g string, seg int, codes string, rest array<long>, ends array<long>, letters array<string>"), "walked")

    def tell(batches):
        for batch in batches:
            letters, became = [], []
            for x in batch.to_pylist():
                state = x["begin"][0]
                letters.append(x["letters"][state] + (closing(x["ends"][state]) if x["rest"][5] else ""))
                became.append(pieces(x["codes"], state, letters[-1]))
            cost = pa.array([x[4] for x in batch.column("rest").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("seg"), cost, pa.array(letters, pa.string()), pa.array(became, pa.list_(pa.list_(pa.string())))], names=["g", "seg", "cost", "letters", "pieces"])

    begun = walked.join(_in_order(walked, "ends", _begins, "begin"), ["g", "seg"])
    return staged(begun.mapInArrow(tell, "g string, seg int, cost long, letters string, pieces array<array<string>>"), "audited")


def repaired(rows: DataFrame, told: DataFrame) -> DataFrame:
    """g, i, sub, edit, role, text: the rows after repair, in order of i and sub."""
    e = F.col("e")
    both = rows.withColumn("seg", F.floor(F.col("i") / SEGMENT).cast("int")).join(told.select("g", "seg", "pieces"), ["g", "seg"]).select("g", "i", "role", "text", F.posexplode(F.get("pieces", (F.col("i") % SEGMENT).cast("int"))).alias("sub", "e")).where(e != "-")
    new = e.startswith("+")
    role = F.when(new, F.substring("e", 2, 20)).when(e == "=", F.col("role")).otherwise(e)
    edit = F.when(new, "I").when(e == "=", "K").otherwise("R")
    return both.select("g", "i", "sub", edit.alias("edit"), role.alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"))


def digests(lines: DataFrame) -> DataFrame:
    """g, sha256 of a conversation's ``role:text`` lines; a conversation passes through one task in order, batch by batch."""

    def run(batches):
        name, digest = None, None
        for batch in batches:
            done = []
            for g, line in zip(batch.column("g").to_pylist(), batch.column("line").to_pylist()):
                if g != name:
                    if digest:
                        done.append((name, digest.hexdigest()))
                    name, digest = g, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["g", "sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=["g", "sha256"])

    ordered = lines.select("g", "i", "sub", F.concat_ws(":", "role", "text").alias("line")).repartition("g").sortWithinPartitions("g", "i", "sub")
    with small_batches(lines.sparkSession, 1000):
        return staged(ordered.select("g", "line").mapInArrow(run, "g string, sha256 string"), "digests")


def measures(marks: DataFrame) -> DataFrame:
    """g, gaps, blank, duplicate, truncated, illegal of every conversation with rows."""
    count = lambda x: F.count(F.when(F.col("fault") == x, 1)).alias(x)
    one = marks.groupBy("g").agg((F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))).cast("long").alias("gaps"))
    two = marks.groupBy("g").agg(*[count(x) for x in ("blank", "duplicate", "truncated")])
    beside = marks.select("g", "seg", "i", "initial")
    segs = beside.groupBy("g", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "initial"))), lambda x: x["initial"]), "").alias("s"))
    heads = segs.where("seg > 0").select("g", (F.col("seg") - 1).alias("seg"), F.left("s", F.lit(1)).alias("next"))
    pairs = segs.join(heads, ["g", "seg"], "left").withColumn("s", F.concat("s", F.coalesce("next", F.lit(""))))
    legal = F.regexp_count("s", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    three = pairs.groupBy("g").agg(F.sum(F.length("s") - 1 - legal).cast("long").alias("illegal"))
    return one.join(two, "g").join(three, "g")


def repair(conversations: DataFrame, folder: str) -> None:
    """Writes rows (repaired, with their edits), audits and measures of conversations (conv_id, turn, role, text) below folder."""
    rows = placed(conversations)
    marks = marked(rows)
    told = audited(marks)
    repaired(rows, told).write.parquet(f"{folder}/rows")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "letters"))), lambda x: x["letters"]), "")
    told.groupBy("g").agg(F.min_by("cost", "seg").alias("cost"), letters.alias("audit")).write.parquet(f"{folder}/audits")
    measures(marks).write.parquet(f"{folder}/measures")


def report(conversations: DataFrame, folder: str) -> DataFrame:
    """A row for each conv_id of conversations from what ``repair`` has written for them or some of their rows."""
    read = conversations.sparkSession.read
    digest = digests(read.parquet(f"{folder}/rows"))
    ids = conversations.select(_group(F.col("conv_id")).alias("g"), "conv_id").distinct()
    all_ = ids.join(read.parquet(f"{folder}/measures"), "g", "left").join(read.parquet(f"{folder}/audits"), "g", "left").join(digest, "g", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    folder = f"{shared_dir(spark)}/repair"
    repair(damaged(rows), folder)
    return report(rows, folder)
