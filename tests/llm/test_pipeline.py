"""The pipeline against a plain version of all five stages, on the smallest data."""

import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_text_operators import WORD, low, measures, plain_estimate
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def votes(t):
    t = t or ""
    ws = re.findall(WORD, t)
    n_words, chars, symbols, dup, repeats = measures(t)
    n = max(n_words, 1)
    lines = len([x for x in t.split("\n") if re.search(WORD, x)])
    capitals = sum(unicodedata.category(c) == "Lu" for c in t)
    ends = len(re.findall(r"[.!?](?=[ \t-\r]|$)", t)) / n
    length, distinct = chars / n, len(set(ws)) / n
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    return (
        vote(symbols / n > 0.1, symbols / n < 0.02),
        vote(dup * 10 > lines, dup == 0),
        vote(repeats / n > 0.05, repeats / n < 0.01),
        vote(length < 4 or length > 7, 4.4 <= length <= 6.5),
        vote(capitals * 10 > chars, capitals * 25 < chars),
        vote(ends < 0.03 or ends > 0.3, 0.05 <= ends <= 0.2),
        vote(n >= 50 and distinct < 0.45, distinct > 0.6),
    ), n_words < 10 or 100 * repeats > 20 * n_words


def good(docs):
    seen = {d: votes(r["text"]) for d, r in docs.items()}
    posterior = plain_estimate(Counter(v for v, failed in seen.values() if not failed))
    return {d: r for d, r in docs.items() if not seen[d][1] and posterior(seen[d][0]) >= 0.5}


def one_of_each(docs):
    sets = {}
    for d, r in docs.items():
        w = re.findall(WORD, low(r["text"]))
        sets[d] = {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    comp = {d: d for d in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {d: new if c == old else c for d, c in comp.items()}
    return {d: r for d, r in docs.items() if comp[d] == d}


def clean(docs, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for t in items:
        w = re.findall(word, low(t))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(t):
        w = re.findall(word, low(t))
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    return {d: r for d, r in docs.items() if not hit(r["text"])}


def mixed(docs):
    size = {d: len(re.findall(WORD, r["text"] or "")) for d, r in docs.items()}
    by = defaultdict(list)
    for d, r in docs.items():
        by[r["source"]].append(d)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in over}
        open_ -= over
    times = Counter()
    for s in names:
        copies = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - copies * total[s]
        for d in by[s]:
            times[d] = copies
        for d in sorted(by[s], key=lambda d: docs[d]["h"]):
            if rest * 2 > size[d]:
                times[d] += 1
            rest -= size[d]
            if rest <= 0:
                break
    return times


def test_pipeline_is_that_of_a_plain_version(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("h", F.xxhash64("doc_id", "text"))
    docs = {r["doc_id"]: r.asDict() for r in table.collect()}
    assert len(docs) == table.count()
    kept = clean(one_of_each(good(docs)), [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    times = mixed(kept)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    want, start = [], 0
    for d in sorted(kept):
        ids = [*model.encode(kept[d]["text"] or "", add_special_tokens=False).ids, 2]
        for _ in range(times[d]):
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and 50 < len(kept) < len(docs)
