"""Secret scan with a random forest against false positives (built-in DataFrame and ML functions only).

Candidates, none of which is rejected before the forest sees it:

- the value behind a credential's name and ``=`` or ``:``, in quotes or up to white
  space, of any characters and any length;
- a private key in its armour;
- a run of at least 12 letters, digits and ``_ + / -`` with a digit in it, with what
  follows after full stops (tokens of several parts) and ``=`` behind it;
- the places of labelled findings, wherever they are.

A forest, trained from labelled findings, tells secrets from the rest by:

- length;
- character transitions: how often a character of one class follows one of another;
- dictionary coverage: the share of the candidate's letters in runs of 3 or more
  that are words of the corpus (counted over all documents, ``COMMON`` times at least);
- the path: the words of the document's source;
- the neighbouring words: two before and one after.

Labelled findings come as a table (``labelled``); where there is none, those whose
format settles the matter stand in (``by_format``): keys with a provider's prefix or
in armour and long lower-case hexadecimal strings right after a credential's name are
secrets, plain numbers, repetitions and UUIDs are not. What such a stand-in can teach
is no more than to carry on from these formats to strings like them; precision and
recall by kind, also of kinds that were not taught, are tested on judged findings.
The forest is trained on at most ``LABELLED`` findings, chosen by hash.

Defined results: null and empty texts have no candidates; null paths have no
words; rows with a null doc_id, and judged findings in them, are treated like others
(as one document); repeated rows give their findings again; without labelled findings of both
kinds every candidate has the score of the only kind (1 without any). Offsets
count characters of the original text.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, staged, table

#: Names that announce a credential.
NAMES = "api_key|apikey|auth|bearer|credential|key|passwd|password|pwd|secret|token"
HEAD = rf"(?<![A-Za-z0-9])(?i:{NAMES})[\"']?[ \t]{{0,2}}[:=][ \t]{{0,2}}"
KEY = rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{{0,20}}PRIVATE KEY-----"
CANDIDATE = (
    rf"{HEAD}(?:\"[^\"\n]++\"|'[^'\n]++'|[^\s\"',;]++)|{KEY}"
    r"|(?<![\p{L}0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+(?:\.[A-Za-z0-9_+/-]++)*+={0,2}(?![\p{L}])"
)
#: Characters of context on each side.
CONTEXT = 48
GROUP = 256
COMMON = 5
LABELLED = 20_000
TREES, DEPTH = 40, 7
NEIGHBOURS, PATHS = 64, 16
_CLASSES = "aA0-"


def _begins(lengths: Column) -> Column:
    """For each place the sum of all lengths before it: of the groups before, and inside the group, so that long arrays cost little more than short ones."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / GROUP).cast("int")), lambda g: total(F.slice(lengths, g * GROUP + 1, F.lit(GROUP))))
    return let(groups, lambda t: let(F.transform(t, lambda x, g: total(F.slice(t, F.lit(1), g))), lambda before: F.transform(lengths, lambda x, i: F.get(before, F.floor(i / GROUP).cast("int")) + total(F.slice(lengths, i - i % GROUP + 1, i % GROUP)))))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, start, secret, left, right of every candidate; docs: (doc_id, text, path)."""

    def of(pieces: Column, found: Column) -> Column:
        def one(m: Column, i: Column, before: Column) -> Column:
            head = let(F.regexp_extract(m, HEAD + "[\"']?", 0), lambda h: F.when(F.startswith(m, h), h).otherwise(F.lit("")))

            def parts(h: Column) -> Column:
                quoted = F.when(h.rlike("[\"']$") & (h != ""), F.lit(1)).otherwise(F.lit(0))
                value = F.substring(m, F.length(h) + 1, F.length(m) - F.length(h) - quoted)
                left = F.right(F.concat(F.get(pieces, i), h), F.lit(CONTEXT))
                right = F.left(F.concat(F.right(m, quoted), F.get(pieces, i + 1)), F.lit(CONTEXT))
                return F.struct((before + F.length(h)).cast("long").alias("start"), value.alias("secret"), left.alias("left"), right.alias("right"))

            return let(head, parts)

        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        return let(lengths, lambda n: let(_begins(n), lambda begins: F.transform(found, lambda m, i: one(m, i, F.get(begins, i) + F.length(F.get(pieces, i))))))

    pattern = F.lit(CANDIDATE)
    hits = let(F.split("text", CANDIDATE, -1), lambda p: let(F.regexp_extract_all("text", pattern, F.lit(0)), lambda m: of(p, m)))
    found = docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", "path", F.explode(hits).alias("c")).select("doc_id", "path", "c.*")
    return found.where("secret <> ''")


def judged_places(docs: DataFrame, labelled: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates at the places of labelled findings that aren't candidates yet: of ``length`` characters, or up to white space."""
    places = labelled.select("doc_id", "start", (F.col("length") if "length" in labelled.columns else F.lit(None)).cast("int").alias("length")).distinct()
    rest = F.substring("text", (F.col("start") + 1).cast("int"), F.coalesce("length", F.length("text")))
    value = F.when(F.col("length").isNull(), F.regexp_extract(rest, r"^\S+", 0)).otherwise(rest)
    own = docs.join(places.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d").withColumn("secret", value).where("secret <> ''")
    known = found.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"))
    own = own.join(known, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("start") == F.col("_s")), "left_anti")
    left = F.substring("text", F.greatest(F.col("start") - CONTEXT + 1, F.lit(1)).cast("int"), F.least(F.col("start"), F.lit(CONTEXT)).cast("int"))
    right = F.substring("text", (F.col("start") + F.length("secret") + 1).cast("int"), F.lit(CONTEXT))
    return own.select("doc_id", "path", F.col("start").cast("long").alias("start"), "secret", left.alias("left"), right.alias("right"))


def _named() -> Column:
    return F.col("left").rlike(rf"(?i)({NAMES})[\"']?\s{{0,2}}[:=]?\s{{0,2}}[\"']?$")


def by_format(found: DataFrame) -> DataFrame:
    """``label`` where a candidate's format settles it, else null."""
    s = F.col("secret")
    secret = s.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$") | s.rlike("^(ghp|gho|ghs|sk|xox[bap]|glpat)[_-][A-Za-z0-9_-]{16,}$") | (_named() & s.rlike("^[0-9a-f]{32,64}$")) | s.rlike(f"^{KEY}$")
    harmless = s.rlike("^[0-9-]+$") | s.rlike(r"^(.)\1*$") | s.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return found.withColumn("label", F.when(secret, F.lit(1.0)).when(harmless, F.lit(0.0)))


def dictionary(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The letter runs of candidates that are words of the corpus."""
    parts = staged(found.select(F.explode(F.regexp_extract_all(F.lower("secret"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).distinct(), "parts")
    n = parts.count()
    words = docs.select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    met = words.join(F.broadcast(parts), "word", "left_semi") if n <= BROADCAST_ROWS else words.join(parts, "word", "left_semi")
    return met.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).select("word")


def covered(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with ``coverage``, by distinct candidate text."""
    parts = found.select("secret").distinct().select("secret", F.explode(F.regexp_extract_all(F.lower("secret"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    hit = parts.join(known, "word", "left_semi").groupBy("secret").agg(F.sum(F.length("word")).alias("letters"))
    return found.join(hit, "secret", "left").withColumn("coverage", F.coalesce(F.col("letters"), F.lit(0)) / F.length("secret")).drop("letters")


def features(found: DataFrame) -> DataFrame:
    """found with the vector ``features``."""
    s = F.col("secret")
    n = F.length(s).cast("double")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    follows = {f"t_{i}{j}": F.regexp_count("kind", F.lit(f"(?={a}{b})")) / F.col("length") for i, a in enumerate(_CLASSES) for j, b in enumerate(_CLASSES)}
    before, after = F.split(F.trim(F.lower("left")), "[^\\p{L}0-9_]+"), F.split(F.trim(F.lower("right")), "[^\\p{L}0-9_]+")
    near = let(F.filter(before, lambda x: x != ""), lambda w: F.transform(F.when(F.size(w) > 2, F.slice(w, -2, 2)).otherwise(w), lambda x: F.concat(F.lit("<"), x)))
    near = F.concat(near, F.transform(F.slice(F.filter(after, lambda x: x != ""), 1, 1), lambda x: F.concat(F.lit(">"), x)))
    rows = found.withColumn("length", n).withColumn("kind", kind).withColumns(follows)
    rows = rows.withColumn("near", near).withColumn("at", F.split(F.lower(F.coalesce("path", F.lit(""))), "[^a-z]+"))
    rows = HashingTF(inputCol="near", outputCol="near_v", numFeatures=NEIGHBOURS, binary=True).transform(rows)
    rows = HashingTF(inputCol="at", outputCol="at_v", numFeatures=PATHS, binary=True).transform(rows)
    inputs = ["length", *follows, "coverage", "near_v", "at_v"]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, secret, score, is_secret of every candidate.

    docs: (doc_id, text, path); labelled: (doc_id, start, label) and, if it is known, length: findings that people have judged.
    """
    found = staged(candidates(docs.select("doc_id", "text", "path")), "candidates")
    if labelled is not None:
        found = found.union(staged(judged_places(docs.select("doc_id", "text", "path"), labelled, found), "judged"))
    found = covered(found, staged(dictionary(docs, found), "dictionary"))
    if labelled is None:
        found = by_format(found)
    else:
        told = labelled.groupBy(F.col("doc_id").alias("_d"), F.col("start").alias("_s")).agg(F.max(F.col("label").cast("double")).alias("label"))
        found = found.join(told, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("start") == F.col("_s")), "left").drop("_d", "_s")
    rows = staged(features(found).select("doc_id", "start", "secret", "label", "features"), "features")
    # The first of each repeated finding; the order by hash makes the sample the same on each run.
    once = rows.where("label IS NOT NULL").groupBy("secret", "label").agg(F.min_by("features", F.struct("doc_id", "start")).alias("features"))
    sample = staged(once.orderBy(F.xxhash64("secret"), "secret", "label").limit(LABELLED).select("label", "features"), "sample")
    labels = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(labels) < 2:
        score = F.lit(labels[0] if labels else 1.0)
        return rows.select("doc_id", "start", "secret", score.alias("score"), (score >= threshold).alias("is_secret"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=1, featureSubsetStrategy="sqrt").fit(sample)
    p = vector_to_array("probability")[1]
    return model.transform(rows).select("doc_id", "start", "secret", p.alias("score"), (p >= threshold).alias("is_secret"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("path")))
