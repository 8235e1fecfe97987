"""Sharding, conversation repair and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsense.llm import common, search, sharding
from colsense.llm import conversation_repair as repair


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 101, 1000, 1601])
def test_permutation_is_one_and_can_be_undone(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, "s").alias("p")).select("id", "p", sharding.permuted(F.col("p"), n, "s", back=True).alias("q")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["q"] == r["id"] for r in rows)
    if n > 500:
        assert [r["p"] for r in rows] != sorted(r["p"] for r in rows)
        assert abs(np.corrcoef([r["id"] for r in rows], [r["p"] for r in rows])[0, 1]) < 0.15


def test_halves():
    for n in [*range(1, 3000), 10**11, 10**15 + 7]:
        a, b = sharding.halves(n)
        assert n <= a * b < n + b


def plain_shards(corpus, k):
    digest = lambda d, t: hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()
    n = len(corpus)
    a, b = sharding.halves(n)

    def once(x):
        left, right = divmod(x, b)
        for r in range(sharding.ROUNDS):
            h = lambda half: int(hashlib.md5(f"0:{r}:{half}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
            left, right = ((left + h(right)) % a, right) if r % 2 == 0 else (left, (right + h(left)) % b)
        return left * b + right

    out = []
    for number, (d, t) in enumerate(sorted(((r[0], r[1]) for r in corpus), key=lambda r: digest(*r))):
        x = once(number)
        while x >= n:
            x = once(x)
        out.append((d, t or "", x % k, x // k))
    return Counter(out)


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, docs, none, corpus, monkeypatch, tmp_path, hot):
    """Read back from the files: each row once, at its place, with all its columns; also where repeated rows are hot."""
    many = docs
    rows = list(corpus)
    if hot:
        monkeypatch.setattr(sharding, "hot_over", lambda n: 1)
        rows += [corpus[5]] * 200
        many = docs.unionByName(docs.where("doc_id = 5").limit(1).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("x"))
    sharding.write(many, str(tmp_path / "s"), 3)
    back = sharding.read(spark, str(tmp_path / "s"), many).collect()
    assert Counter((r["row"]["doc_id"], r["row"]["n_words"], r["row"]["text"]) for r in back) == Counter((r[0], r[5], r[1]) for r in rows)
    slots = {k: sorted(r["slot"] for r in back if r["shard"] == k) for k in range(3)}
    assert all(x == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    got = Counter((r["row"]["doc_id"], r["row"]["text"] or "", r["shard"], r["slot"]) for r in back)
    if hot:  # repeated rows come behind all others: a place is one row's
        assert {r["slot"] * 3 + r["shard"] for r in back} == set(range(len(rows)))
    else:
        assert got == plain_shards(rows, 3)
    files = {}
    for r in sharding.read(spark, str(tmp_path / "s"), many).select("shard", "slot", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("o")).orderBy("o").collect():
        files.setdefault(r["f"], []).append(r["slot"])
    assert all(x == sorted(x) for x in files.values())
    sharding.write(none, str(tmp_path / "n"), 3)
    assert sharding.assigned(none).count() == 0


def test_shards_do_not_depend_on_the_input_layout(docs):
    told = lambda df: Counter(map(tuple, sharding.assigned(df).select("row.doc_id", "row.text", "shard", "slot").collect()))
    assert told(docs) == told(docs.repartition(7, "text"))


def plain_faults(rows):
    seen, found = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def plain_repair(rows):
    """(cost, audit, lines) by a search over all sequences of edits, rows and states remembered."""
    faults = plain_faults(rows)
    accepts, nxt = {"", "a"}, {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def go(k, state, inserts):
        found = []
        if k == len(rows):
            if state in accepts:
                found.append((0, "", ()))
        else:
            role, text = rows[k]
            late = faults[k] == "truncated"
            found.append(add(3, "D", (), go(k + 1, state, 0)))
            if faults[k] not in ("blank", "duplicate"):
                first = role[:1]
                if first == "s" and state == "" or first in ("u", "a") and nxt[state] == first:
                    found.append(add(late, "K", (f"{role}:{text}",), go(k + 1, first, 0)))
                found.append(add(2 + late, "R", (f"{name[nxt[state]]}:{text}",), go(k + 1, nxt[state], 0)))
        if inserts < 3:
            found.append(add(2, "I", (f"{name[nxt[state]]}:",), go(k, nxt[state], inserts + 1)))
        return min((x for x in found if x), default=None)

    def add(cost, letter, line, rest):
        return rest and (rest[0] + cost, letter + rest[1], line + rest[2])

    return go(0, "", 0)


def plain_report(rows):
    """rows: (turn, role, text) of a conversation after damage, in order."""
    pairs = [(r or " ", t if t is not None else " ") for _, r, t in rows]
    pairs = [(" " if r is None else r, t) for (_, r, _), (_, t) in zip(rows, pairs)]
    faults = plain_faults(pairs)
    cost, audit, lines = plain_repair(tuple(pairs))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(rng, n, longest):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "s"])
            text = rng.choice([f"text {rng.randrange(6)}.", "yes!", "no", "cut off,", "", " \n", None, "é?", "a\x1f"])
            rows.append((c if c else None, rng.choice([t, t, t, None, t + 3]), role, text))
    return rows


def in_order(rows):
    space = lambda x: " " if x is None else x
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, space(r[1]), hashlib.md5(space(r[2]).encode()).hexdigest()))


@pytest.mark.parametrize("segment", [3, 4096])
def test_repair(spark, monkeypatch, tmp_path, segment):
    """Null ids, turns, roles and texts, blanks, ties and repeats; short segments show that they are put together rightly."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "hot_over", lambda n: 3)
    rows = conversations(random.Random(segment), 120, 24)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, g int").repartition(3)
    repair.repair(df.select("conv_id", "turn", "role", "text"), str(tmp_path / "r"))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(df, str(tmp_path / "r")).collect()}
    own = {}
    for c, *r in rows:
        own.setdefault(c, []).append(tuple(r))
    assert got.keys() == own.keys()
    for c, x in own.items():
        assert got[c] == plain_report(in_order(x)), (c, x)


def test_damage_and_empty_tables(spark, tmp_path):
    rows = conversations(random.Random(9), 60, 8)
    rows = [(c, t, r, x) for (c, t), (r, x) in {(c, t): (r, x) for c, t, r, x in rows}.items()]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            want += [(c, t, "user" if d == 4 else r, "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x)] * (2 if d == 3 else 1)
    assert Counter(map(tuple, repair.damaged(df).collect())) == Counter(want)
    lost = df.where("false")
    repair.repair(lost, str(tmp_path / "e"))
    got = repair.report(df, str(tmp_path / "e")).collect()
    assert {tuple(r)[1:] for r in got} == {(0,) * 6 + ("", hashlib.sha256(b"").hexdigest())} and len(got) == len({r[0] for r in rows})
    assert repair.report(lost, str(tmp_path / "e")).count() == 0


def test_long_runs():
    """A million equal rows take a few powers and remembered blocks; letters are those of a plain walk."""
    for code in ("u0", "a1", "s0", "o0", "u2", "s1"):
        for n in (1, 2, 7, 33):
            codes = code * n
            letters, end = repair.unroll(codes, 0, repair.ENDS)
            rows = tuple(({"u": "user", "a": "assistant", "s": "system", "o": "tool"}[code[0]], f"{k}" + ("." if code[1] == "0" else "") if code[1] != "2" else " ") for k in range(n))
            assert letters + repair.closing(end) == plain_repair(rows)[1]
    letters, end = repair.unroll("u0" * 1_000_000, 0, repair.ENDS)
    assert len(letters) >= 1_000_000 and repair.unrolled.cache_info().currsize < 5_000
    assert repair.before(repair.matrix("u0" * 1_000_000), repair.ENDS)[0] == 1_000_000  # every second one is reroled


def plain_terms(t):
    return [x for x in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]


def plain_search(docs, items, k):
    held = [(d, Counter(w), len(w)) for d, w in ((d, plain_terms(t)) for d, t in docs) if w]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(x for _, c, _ in held for x in c)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(plain_terms(t))
    out = Counter()
    for i, terms in own.items():
        found = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 20 * m)) for x in terms if x in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        for r, (s, null, d) in enumerate(sorted(found)[:k], 1):
            out[i, r, None if null else d, -s] += 1
    return out


@pytest.mark.parametrize(("block", "cells"), [(search.BLOCK, search.CELLS), (40, 300)])
def test_search(spark, docs, none, corpus, monkeypatch, block, cells):
    """Nulls, ties, repeated rows and items, long texts; several blocks and small accumulators give the same."""
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "CHUNK", 64)
    rng = random.Random(4)
    asked = [(k, " ".join(rng.sample((corpus[k][1] or "x").split(), min(12, len((corpus[k][1] or "x").split()))) + ["ALPHA1", "beta2", "nowhere"])) for k in range(12)]
    asked += [(3, "gamma3 Delta4"), (None, "one two"), (20, None), (21, "?!"), (22, "é ü one")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    for k in (4, 50):
        got = Counter(map(tuple, search.search(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()))
        assert got == plain_search([(r[0], r[1]) for r in corpus], asked, k)
    assert search.search(none, items).count() == 0 and search.search(docs, items.where("false")).count() == 0


def test_graph_shares_parts():
    rng = random.Random(1)
    common_ = list(range(20))
    items = [sorted({*rng.sample(common_, 12), *rng.sample(range(20, 400), 10)}) for _ in range(60)]
    g = search.shared(items, 400)
    held = [set(np.flatnonzero(g.leaf_of == k).tolist()) for k in range(g.leaves)]
    for u, v in g.pairs:
        assert not held[u] & held[v]
        held.append(held[u] | held[v])
    assert all(sorted(x for n in own for x in held[n]) == terms for own, terms in zip(g.items, items))
    assert len(g.pairs) + sum(len(x) - 1 for x in g.items) < 0.75 * sum(len(x) - 1 for x in items)


def test_batch_size_is_put_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with common.small_batches(spark, 7):
        assert spark.conf.get(name) == "7"
    assert spark.conf.get(name) == before
