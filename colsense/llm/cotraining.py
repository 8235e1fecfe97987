"""Quality classifier by co-training of two views.

One classifier sees the text: its distinct words and marks. The other sees the page's
metadata: source, language, length, and how the page is laid out (lines, length of
lines and of words, URLs, shares of digits and of the characters of markup), each
as tokens for steps of the measure. Both start from labelled documents.

In each round every unlabelled document of the corpus is scored by both. Each view's
scores are calibrated on labelled documents kept apart, and its surest documents of
either class, a share of the corpus that grows from round to round, become
pseudo-labels for the other view. Pseudo-labels never weigh more than the labels of
people do. At the end, both views are calibrated together on the documents kept
apart, and the combined probability scores every document, over its whole text.

A document is good if its label has quality 1 and is not toxic; of several labels
for one doc_id the worst counts. Only the labels of people are bounded: ``LABELLED``
of them, by hash of the doc_id, are learnt from.

Defined results: null and empty texts have no words; null metadata is a value of
its own; without labels of both kinds every document gets the share of good
labels (1 without any). Repeated rows get the same result each; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged, table

LABELLED = 10_000
#: Share of the unlabelled documents that a view hands over after each round but the last.
SHARES = (0.1, 0.3)
#: Least calibrated probability of a pseudo-label.
SURE = 0.95
TEXT_DIMS, META_DIMS = 1 << 16, 1 << 10
#: Documents with at least this probability of being good are kept.
KEEP = 0.5
#: Steps of the histogram of scores.
STEPS = 1000


def text_tokens(text: Column) -> Column:
    """Distinct lower-case words, and runs of other characters, of a text, and a token for their share of all of them."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"), F.lit(0))

    def with_share(all_: Column) -> Column:
        share = lambda own: F.floor(F.size(own) * 20 / F.greatest(F.size(all_), F.lit(1)))
        return let(F.array_distinct(all_), lambda own: F.concat(own, F.array(F.concat(F.lit("\x01distinct="), share(own).cast("string")), F.concat(F.lit("\x01words="), F.floor(F.log2(F.size(all_) + 1.0)).cast("string")))))

    return let(found, with_share)


def meta_tokens(text: Column, source: Column, lang: Column, size: Column) -> Column:
    """Tokens of the metadata and the layout; of the text only counts of characters are used."""
    whole = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(whole), F.lit(1)).cast("double")
    lines = n - F.length(F.translate(whole, "\n", "")) + 1
    words = n - F.length(F.translate(whole, " \n", "")) + 1
    share = lambda characters: (n - F.length(F.translate(whole, characters, ""))) / n
    urls = (n - F.length(F.replace(whole, F.lit("://"), F.lit("")))) / 3

    def token(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("\x01")))

    return F.array(
        token("source", source),
        token("lang", lang),
        token("chars", F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")))),
        token("lines", F.floor(F.log2(lines))),
        token("line", F.floor(F.log2(n / lines))),
        token("word", F.floor(F.least(n / words, F.lit(20.0)))),
        token("urls", F.least(F.floor(urls), F.lit(3))),
        token("digits", F.floor(share("0123456789") * 20)),
        token("markup", F.floor(F.least(share("#*$%&|<>") * 50, F.lit(20.0)))),
    )


def views(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with the feature vectors ``a`` (text) and ``b`` (metadata)."""
    rows = docs.select(*keep, text_tokens(F.col("text")).alias("ta"), meta_tokens(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars")).alias("tb"))
    rows = HashingTF(inputCol="ta", outputCol="a", numFeatures=TEXT_DIMS, binary=True).transform(rows)
    return HashingTF(inputCol="tb", outputCol="b", numFeatures=META_DIMS, binary=True).transform(rows).select(*keep, "a", "b")


@dataclass(frozen=True)
class View:
    """A view's model, its calibration, and the bounds beyond which a document is a pseudo-label for the other view."""

    name: str
    model: LogisticRegressionModel
    slope: float
    offset: float
    low: float = -1.0
    high: float = 2.0

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with m<name> (margin) and p<name> (calibrated probability)."""
        m = vector_to_array(f"r{self.name}")[1]
        out = self.model.transform(rows).withColumn(f"m{self.name}", m).drop(f"r{self.name}", f"y{self.name}", f"q{self.name}")
        return out.withColumn(f"p{self.name}", 1 / (1 + F.exp(-(self.slope * F.col(f"m{self.name}") + self.offset))))

    def said(self) -> Column:
        p = F.col(f"p{self.name}")
        return F.when(p >= self.high, F.lit(1.0)).when(p <= self.low, F.lit(0.0))


@dataclass(frozen=True)
class Trained:
    """Both views, their joint calibration, the held-out accuracies (text, metadata) of each round, and the documents handed over after it (from the text view, from the metadata view)."""

    text: View
    meta: View
    joint: LogisticRegressionModel
    accuracy: tuple[tuple[float, float], ...]
    handed: tuple[tuple[int, int], ...]


def _fit(rows: DataFrame, name: str, other: View | None, people: int, pseudo: int) -> View:
    """The view fitted to the labels of people and the pseudo-labels of the other view."""
    known = rows if other is None else other.scored(rows)
    said = F.lit(None).cast("double") if other is None else other.said()
    known = known.select(name, "held", "label", F.coalesce("label", said).alias("y"), F.when(F.col("label").isNotNull(), F.lit(1.0)).otherwise(F.lit(min(1.0, people / max(pseudo, 1)))).alias("w"))
    fit = LogisticRegression(featuresCol=name, labelCol="y", weightCol="w", maxIter=20, regParam=0.002, standardization=False, probabilityCol=f"q{name}", rawPredictionCol=f"r{name}", predictionCol=f"y{name}")
    model = fit.fit(known.where("y IS NOT NULL AND NOT held"))
    margins = model.transform(rows.where("held")).select("label", array_to_vector(F.array(vector_to_array(f"r{name}")[1])).alias("m"))
    scale = LogisticRegression(featuresCol="m", labelCol="label", regParam=0.001).fit(margins)
    return View(name, model, float(scale.coefficients[0]), float(scale.intercept))


def _hands(view: View, rows: DataFrame, share: float, good: float) -> tuple[View, int]:
    """The view with bounds that leave its surest documents of either class, ``share`` of the unlabelled ones in all, and their number."""
    p = F.floor(F.least(F.col(f"p{view.name}"), F.lit(1 - 1e-9)) * STEPS).cast("int")
    counts = {r["k"]: r["n"] for r in view.scored(rows.where("label IS NULL")).groupBy(p.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())

    def bound(steps, wanted: float) -> tuple[int | None, int]:
        got, last = 0, None
        for k in steps:
            if got >= wanted:
                break
            got, last = got + counts.get(k, 0), k
        return last, got

    if view.slope <= 0:  # a view that tells nothing has nothing to hand over
        return view, 0
    high, n_good = bound(range(STEPS - 1, int(SURE * STEPS) - 1, -1), share * total * good)
    low, n_bad = bound(range(int((1 - SURE) * STEPS)), share * total * (1 - good))
    bounds = ((low + 1) / STEPS if low is not None else -1.0, high / STEPS if high is not None else 2.0)
    return View(view.name, view.model, view.slope, view.offset, *bounds), n_good + n_bad


def train_views(rows: DataFrame, labels: DataFrame):
    """Co-training on the views of all documents (doc_id, a, b); the share of good labels where there is nothing to learn."""
    good = (F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(good.cast("double")).alias("label"))
    few = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "labels")
    held = F.col("label").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0)
    state = rows.join(F.broadcast(few), "doc_id", "left").withColumn("held", held)  # LABELLED rows at most
    human = staged(state.where("label IS NOT NULL"), "human")
    seen = {(r["held"], r["label"]): r["n"] for r in human.groupBy("held", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 4:
        share = few.agg(F.avg("label")).first()[0]
        return 1.0 if share is None else share
    people = seen[False, 0.0] + seen[False, 1.0]
    prior = seen[False, 1.0] / people
    a, b = _fit(human, "a", None, people, 0), _fit(human, "b", None, people, 0)
    accuracy, handed = [_accuracies(human, a, b)], []
    for share in SHARES:
        (a, n_a), (b, n_b) = _hands(a, state, share, prior), _hands(b, state, share, prior)
        handed.append((n_a, n_b))
        a, b = _fit(state, "a", b, people, n_b), _fit(state, "b", a, people, n_a)
        accuracy.append(_accuracies(human, a, b))
    joint = LogisticRegression(featuresCol="m", labelCol="label", regParam=0.01, probabilityCol="q", rawPredictionCol="r", predictionCol="y").fit(_margins(human.where("held"), a, b))
    return Trained(a, b, joint, tuple(accuracy), tuple(handed))


def _accuracies(human: DataFrame, a: View, b: View) -> tuple[float, float]:
    right = lambda p: F.avg(((F.col(p) >= 0.5) == (F.col("label") == 1)).cast("double"))
    return tuple(b.scored(a.scored(human.where("held"))).agg(right("pa"), right("pb")).first())


def _margins(rows: DataFrame, a: View, b: View) -> DataFrame:
    return VectorAssembler(inputCols=["ma", "mb"], outputCol="m").transform(b.scored(a.scored(rows)))


def score_views(rows: DataFrame, model) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept of every row of the views."""
    if isinstance(model, float):
        p = F.lit(model)
        return rows.select("doc_id", p.alias("text_score"), p.alias("meta_score"), p.alias("score"), (p >= KEEP).alias("kept"))
    p = vector_to_array("q")[1]
    return model.joint.transform(_margins(rows, model.text, model.meta)).select("doc_id", F.col("pa").alias("text_score"), F.col("pb").alias("meta_score"), p.alias("score"), (p >= KEEP).alias("kept"))


def train(docs: DataFrame, labels: DataFrame):
    """The models from documents (doc_id, text, source, lang, n_chars) and labels (doc_id, quality, toxic)."""
    return train_views(staged(views(docs, "doc_id"), "views"), labels)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept of every row of docs."""
    return score_views(views(docs, "doc_id"), model)


def query(spark, sf_dir: str) -> DataFrame:
    rows = staged(views(table(spark, sf_dir, "documents"), "doc_id"), "views")
    return score_views(rows, train_views(rows, table(spark, sf_dir, "labels")))
