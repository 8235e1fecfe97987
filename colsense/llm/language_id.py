"""Language identification in two steps: family, then one-versus-one inside it.

A text is described by hashed byte trigrams of its lower-cased letters (``DIMS``
relative frequencies, unit length). Linear support vector machines, one for each
two families, choose the family by votes; inside it, one for each two languages
choose the language, so that closely related languages are only compared with one
another.

The machines are trained on a bounded sample: for each language at most
``PER_LANGUAGE`` texts, chosen by a hash of the doc_id among the labelled rows
outside the held-out part (crc32 of the doc_id as text mod 5 = 0). Only text and
lang of these rows are learnt from; prediction sees the text alone, in whole.

A machine is fitted to three quarters of its texts; on the last quarter its margins
are calibrated to probabilities, which make up the score.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
rows with a null lang, text or doc_id are not learnt from, and one without a doc_id
counts as not held out; with no labelled row at all every text
is ``und``; with one language every text with a letter gets it. Repeated rows get
the same result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table, with_records_per_batch

#: Most training texts of one language.
PER_LANGUAGE = 600
DIMS = 1 << 12
#: Families of languages by two-letter code; others are families of their own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "indic": ["as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "si", "ur"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "ug", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "dravidian": ["kn", "ml", "ta", "te"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    """The family of a tag by its language part (``pt-BR`` is pt); tags of other codes are families of their own."""
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)


def features(text: str) -> np.ndarray:
    """Hashed trigrams of a text: all that is neither a letter nor beyond ASCII counts as one blank."""
    code = _CODE[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    code = code[(code != 0) | np.append(True, code[:-1] != 0)]
    if len(code) < 3:
        return np.zeros(DIMS, np.float32)
    gram = (code[:-2] * np.uint32(155) + code[1:-1]) * np.uint32(155) + code[2:]
    slot = (gram * np.uint32(2654435761)) >> np.uint32(20)
    count = np.bincount(slot, minlength=DIMS).astype(np.float32)
    return count / np.sqrt((count * count).sum())


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns of docs (the last one is ``text``) with x, the features, in place of the text."""
    fields = [f for f in docs.select(*keep).schema.fields if f.name != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "x array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                x = [features(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(x, pa.list_(pa.float32()))], names=[*[f.name for f in fields], "x"])

    return with_records_per_batch(docs.select(*keep), 2000).mapInArrow(run, schema)


@dataclass(frozen=True)
class Tree:
    """Families with their languages; for each two families and each two languages of a family the weights, the intercept, and the slope and offset of the calibration."""

    members: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray]

    def choose(self, names: list[str], x: np.ndarray) -> tuple[str, float]:
        """The name with most votes, then with most confidence, and its mean confidence."""
        if len(names) == 1:
            return names[0], 1.0
        votes, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            w = self.machines[a, b]
            margin = float(x @ w[:-3] + w[-3])
            p = 1 / (1 + np.exp(-float(np.clip(w[-2] * margin + w[-1], -30, 30))))
            votes[a if p >= 0.5 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
        best = max(names, key=lambda n: (votes[n], sure[n], n))
        return best, sure[best] / (len(names) - 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.members or text is None or not has_letter(text):
            return "und", 0.0
        x = features(text)
        fam, p = self.choose(sorted(self.members), x)
        lang, q = self.choose(self.members[fam], x)
        return lang, p * q


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)


def train(docs: DataFrame) -> Tree:
    """The machines from rows (doc_id, text, lang)."""
    rows = training_rows(docs)
    # The share of each language's rows that gives about PER_LANGUAGE, then exactly that many at most.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Tree({}, {})
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (place < int(min(1_000_000, 2_000_000 * PER_LANGUAGE / n))))
    few = rows.where(wanted).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("rank") <= PER_LANGUAGE)
    few = few.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)))
    sample = staged(described(few, "lang", "part", "text"), "sample").withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    members: dict[str, list[str]] = {}
    for lang in sorted(counts):
        members.setdefault(family(lang), []).append(lang)
    machines = {}
    groups = {fam: list(langs) for fam, langs in members.items()}
    pairs = [(a, b, groups[a], groups[b]) for a, b in combinations(sorted(groups), 2)]
    pairs += [(a, b, [a], [b]) for langs in members.values() for a, b in combinations(langs, 2)]
    sample = sample.coalesce(2).persist()
    for a, b, left, right in pairs:
        part = sample.where(F.col("lang").isin(left + right)).withColumn("label", F.col("lang").isin(left).cast("double"))
        # The calibration sees texts that its machine was not fitted to; a machine without both kinds there keeps its margins.
        model = LinearSVC(maxIter=30, regParam=1e-4, standardization=False, rawPredictionCol="raw").fit(part.where("part > 0"))
        margins = model.transform(part.where("part = 0")).select("label", array_to_vector(F.array(vector_to_array("raw")[1])).alias("m"))
        slope, offset = 4.0, 0.0
        if margins.select("label").distinct().count() == 2:
            scale = LogisticRegression(featuresCol="m", labelCol="label", regParam=0.001).fit(margins)
            slope, offset = max(float(scale.coefficients[0]), 0.1), float(scale.intercept)
        machines[a, b] = np.concatenate((model.coefficients.toArray(), [model.intercept, slope, offset]))
    sample.unpersist()
    return Tree(members, machines)


def predict(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of every row; the text alone is read."""
    sent = docs.sparkSession.sparkContext.broadcast(tree)  # families, languages and DIMS weights for each two: no rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([float(p) for _, p in found], pa.float64())], names=["id", "lang_pred", "score"])

    rows = with_records_per_batch(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), 2000)
    return rows.mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return predict(docs, train(docs)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
