"""Classifiers on MLlib."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, PCA, HashingTF, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def text_words(text: Column) -> Column:
    """The lower-case words (runs of letters, digits and _) of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def char_grams(words: Column, low: int = 3, high: int = 6) -> Column:
    """Character n-grams of words with a blank on either side; a word shorter than n is one gram."""

    def of(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        gram = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
        return F.array_distinct(F.flatten(F.array(*[gram(n) for n in range(low, high + 1)])))

    return F.flatten(F.transform(F.array_distinct(words), of))


def word_grams(words: Column) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.concat(words, pairs)


class Grams(NamedTuple):
    """The counted grams with their places, and the inverse document frequency by place."""

    chars: dict[str, int]
    words: dict[str, int]
    idf: np.ndarray


class CalibratedSvm(NamedTuple):
    """One-versus-rest linear machines over counted grams (weights by place and class, the last row is the intercepts), with a sigmoid for each class."""

    grams: Grams
    machines: np.ndarray
    labels: list[str]
    sigmoids: list[tuple[float, float]]

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """rows (text, ...) with ``p``, an array by class that sums to 1, and ``pred``."""
        out = with_margins(self.machines, self.grams, rows)
        p = F.array(*[1 / (1 + F.exp(-(F.lit(a) * F.col("_m")[k] + F.lit(b)))) for k, (a, b) in enumerate(self.sigmoids)])
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        out = out.withColumn("_p", p).select(*[F.col(f"`{c}`") for c in rows.columns], F.transform("_p", lambda v: F.when(total(F.col("_p")) > 0, v / total(F.col("_p"))).otherwise(F.lit(1.0 / len(self.sigmoids)))).alias("p"))
        best = F.array_position("p", F.array_max("p")).cast("int") - 1
        return out.withColumn("pred", F.get(F.array(*map(F.lit, self.labels)), best))


def vocabulary(texts: DataFrame, features: int) -> tuple[list[str], list[str]]:
    """Of (row, words): the most frequent grams of characters and of words that two rows have; of equally frequent ones the first in order.

    A gram of characters counts once for each different word of a text, so its count is
    summed over the different words of all texts and not over the texts.
    """
    often = lambda df: [r["gram"] for r in df.where("low < high").orderBy(F.desc("n"), "gram").limit(features).select("gram").collect()]
    seen = lambda df, by: df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"), F.max("row").alias("high"))
    own = seen(texts.select("row", F.explode(F.array_distinct("words")).alias("word")), "word")
    chars = own.select(F.explode(char_grams(F.array("word"))).alias("gram"), "n", "low", "high").groupBy("gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return often(chars), often(seen(texts.select("row", F.explode(word_grams(F.col("words"))).alias("gram")), "gram"))


#: Words of which a worker remembers the places of their grams.
KNOWN_WORDS = 300_000


def finder(chars: dict[str, int], pairs: dict[str, int], low: int = 3, high: int = 6):
    """A function from words to the ascending places of their counted grams."""
    known: dict[str, bytes] = {}
    there = np.zeros(len(chars) + len(pairs), bool)

    def of(word: str) -> bytes:
        own = known.get(word)
        if own is None:
            w = f" {word} "
            places = map(chars.get, [w[i : i + n] for n in range(low, high + 1) for i in range(max(len(w) - n + 1, 1))])
            own = np.array([k for k in places if k is not None], np.int32).tobytes()
            if len(known) < KNOWN_WORDS:  # the frequent ones come early
                known[word] = own
        return own

    def find(words: list[str]) -> np.ndarray:
        both = map(pairs.get, [*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]])
        there[np.array([k for k in both if k is not None], np.int32)] = True
        there[np.frombuffer(b"".join(map(of, set(words))), np.int32)] = True
        found = np.flatnonzero(there)
        there[found] = False
        return found

    return find


#: Rows of a batch that goes to a worker: texts are long.
BATCH_ROWS = 1024
#: A writer and a reader of files hold a group of rows at once: few MB instead of 128.
SMALL_GROUPS = {"parquet.block.size": 8 << 20}


def short_batches(df: DataFrame) -> DataFrame:
    """Bounds the rows of an Arrow batch, for this session from now on, where it allows more: the plan runs later."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def with_margins(machines: np.ndarray, grams: Grams, rows: DataFrame) -> DataFrame:
    """rows (text, ...) with ``_m``, the distance from each machine's plane."""
    sent = rows.sparkSession.sparkContext.broadcast((grams, machines))  # the model: bounded by its vocabulary
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (chars, pairs, idf), w = sent.value
        scaled, squares, find = idf[:, None] * w[:-1], idf**2, finder(chars, pairs)
        for batch in batches:
            out = []
            for words in batch.column(len(names)):
                found = find(words.as_py())
                norm = np.sqrt(squares[found].sum())
                out.append(scaled[found].sum(axis=0) / (norm if norm > 0 else 1.0) + w[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.list_(pa.float64()))], names=[*names, "_m"])

    schema = StructType([*rows.schema.fields, StructField("_m", ArrayType(DoubleType()))])
    return short_batches(rows.withColumn("_words", text_words(F.col("text")))).mapInArrow(run, schema)


#: Rows of a block of the fit, labels whose machines are fitted together, and steps that a fit remembers.
BLOCK_ROWS, LABELS_AT_ONCE, REMEMBERED = 128, 4, 5


def gram_rows(texts: DataFrame, chars: dict[str, int], pairs: dict[str, int]) -> DataFrame:
    """(y, weight, fold, found) of the rows (y, weight, fold, words); found: the places of a row's grams, as bytes.

    Each row is small by itself: a writer and a reader of files hold a hundred rows and more at once.
    """
    sent = texts.sparkSession.sparkContext.broadcast((chars, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(*sent.value)
        for batch in batches:
            found = pa.array([find(words.as_py()).astype(np.int32).tobytes() for words in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["y", "weight", "fold", "found"])

    return short_batches(texts.select("y", "weight", "fold", "words")).mapInArrow(run, "y int, weight double, fold int, found binary")


def each_block(batches: Iterator[pa.RecordBatch], n: int):
    """y, weight, fold, used and the matrix of rows and used grams, of BLOCK_ROWS rows of gram_rows at a time; n: grams that there are.

    A matrix lasts until the next one: they share their cells.
    """
    there, column, cells = np.zeros(n, bool), np.empty(n, np.int64), np.zeros(BLOCK_ROWS * n, np.float32)
    for whole in batches:
        for k in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(k, BLOCK_ROWS)
            y, weight, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            found = batch.column(3).to_pylist()
            places = np.frombuffer(b"".join(found), np.int32)
            there[places] = True
            used = np.flatnonzero(there)
            there[used] = False
            column[used] = np.arange(len(used))
            ones = np.repeat(np.arange(len(found)) * len(used), [len(f) // 4 for f in found]) + column[places]
            cells[ones] = 1
            yield y, weight, fold, used, cells[: len(found) * len(used)].reshape(len(found), -1)
            cells[ones] = 0


#: Numbers of a sum that a row has.
PIECE = 1 << 16


def summed(rows: DataFrame, n: int, shape: tuple[int, int], add) -> np.ndarray:
    """What add(total, *block) puts into a matrix of that shape, over all blocks of gram_rows.

    Each task has one matrix, and gives it on in pieces; a piece is summed in the order of
    the tasks, and each comes to the driver once.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    kind = "task int, at long, part binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for block in each_block(batches, n):
            add(total, *block)
        flat, task = total.reshape(-1), TaskContext.get().partitionId()
        for at in range(0, len(flat), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([at]), pa.array([flat[at : at + PIECE].tobytes()], pa.binary())], names=["task", "at", "part"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                parts.setdefault(r["at"], []).append((r["task"], r["part"]))
        for at, own in parts.items():
            whole = sum(np.frombuffer(part) for _, part in sorted(own))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([at]), pa.array([whole.tobytes()], pa.binary())], names=["task", "at", "part"])

    pieces = short_batches(rows.coalesce(tasks)).mapInArrow(run, kind).repartition(tasks, "at").mapInArrow(together, kind)
    out = np.zeros(shape[0] * shape[1])
    for r in pieces.collect():
        out[r["at"] : r["at"] + PIECE] = np.frombuffer(r["part"])
    return out.reshape(shape)


def planes(idf: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What scores needs of the weights of the machines with intercepts last: by gram what it adds to each margin and to the square of a row's length; the intercepts."""
    return np.column_stack((idf[:, None] * w[:-1], idf**2)).astype(np.float32), w[-1]


def scores(sent, used, x) -> tuple[np.ndarray, np.ndarray]:
    """Margins of the rows of a block by machine, and the lengths of the rows; sent: planes."""
    s = x @ sent[0][used]
    norm = np.sqrt(s[:, -1:].astype(np.float64))
    norm[norm == 0] = 1
    return s[:, :-1] / norm + sent[1], norm


def fit_machines(rows: DataFrame, idf: np.ndarray, sides: list[tuple[int, int]], totals: np.ndarray, reg: float, iterations: int, tol: float = 1e-3) -> np.ndarray:
    """Weights of the machines, intercepts last: a machine (class, fold) tells the class from the rest on all folds but that one.

    Squared hinge loss, weighted, and ``reg`` / 2 times the squared length, by L-BFGS with
    halved steps. All machines look at a block together, so a pass over the rows is a
    step of each of them; one that has settled waits for the others.
    """
    sc, n, k = rows.sparkSession.sparkContext, len(idf), len(sides)
    cls, held = np.array(sides).T

    def value(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = sc.broadcast(planes(idf, w.T))

        def add(total, y, weight, fold, used, x):
            z, norm = scores(sent.value, used, x)
            sign = np.where(y[:, None] == cls, 1.0, -1.0)
            slack = np.maximum(0, 1 - sign * z)
            use = weight[:, None] * (fold[:, None] != held)
            d = -2 * use * sign * slack
            total[used] += ((d / norm).astype(np.float32).T @ x).T
            total[-2] += d.sum(axis=0)
            total[-1] += (use * slack**2).sum(axis=0)

        total = (summed(rows, n, (n + 2, k), add) / totals).T
        total[:, :n] *= idf
        sent.destroy()
        plain = w * (np.arange(n + 1) < n)
        return total[:, -1] + reg / 2 * (plain**2).sum(axis=1), total[:, :-1] + reg * plain

    def direction(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        q, kept = -g, []
        for s, d in reversed(steps):
            kept.append((s @ q) / (s @ d))
            q = q - kept[-1] * d
        s, d = steps[-1]
        q = q * ((s @ d) / (d @ d))
        for (s, d), a in zip(steps, reversed(kept)):
            q = q + (a - (d @ q) / (s @ d)) * s
        return q

    w = np.zeros((k, n + 1))
    f, g = value(w)
    way = -g / np.maximum(np.sqrt((g**2).sum(axis=1)), 1e-12)[:, None]
    step, taken, open_, past = np.ones(k), np.zeros(k, int), np.abs(g).max(axis=1) > 1e-9, [[] for _ in sides]
    while open_.any():
        there = w + np.where(open_, step, 0)[:, None] * way
        f2, g2 = value(there)
        for m in np.flatnonzero(open_):
            if f2[m] > f[m] + 1e-4 * step[m] * (g[m] @ way[m]):
                step[m] /= 2
                open_[m] = step[m] > 1e-6
                continue
            s, d = there[m] - w[m], g2[m] - g[m]
            if s @ d > 1e-12:
                past[m] = [*past[m], (s, d)][-REMEMBERED:]
            taken[m] += 1
            open_[m] = taken[m] < iterations and f[m] - f2[m] > tol * abs(f2[m])
            w[m], f[m], g[m], step[m] = there[m], f2[m], g2[m], 1.0
            way[m] = direction(g[m], past[m]) if past[m] else -g[m]
    return w.T.copy()


def held_out_margins(rows: DataFrame, idf: np.ndarray, w: dict[int, np.ndarray]) -> DataFrame:
    """(y, m) of the rows of each fold by the machines of w that did not see it; -1 in w: of all rows."""
    sent, n = rows.sparkSession.sparkContext.broadcast({f: planes(idf, m) for f, m in w.items()}), len(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = sent.value
        for y, _, fold, used, x in each_block(batches, n):
            for f, m in machines.items():
                z, _ = scores(m, used, x)
                of = np.flatnonzero((fold == f) | (f < 0))
                yield pa.RecordBatch.from_arrays([pa.array(y[of]), pa.array(list(z[of]), pa.list_(pa.float64()))], names=["y", "m"])

    return short_batches(rows).mapInArrow(run, "y int, m array<double>")


def calibrated_svm(rows: DataFrame, key: str, folds: int = 3, features: int = 50_000, reg: float = 1e-4, iterations: int = 15) -> CalibratedSvm:
    """Fitted to the labelled rows of (key, label, text).

    Grams are characters 3 to 6 inside words, and words 1 to 2; each kind has its own
    counted vocabulary of the ``features`` most frequent grams that two texts have; a gram
    counts once in a text, times its inverse document frequency; rows have unit length.
    Classes weigh the same. Machines fitted to all folds but one give margins for that
    one; on these margins, which no machine was fitted to, a sigmoid is fitted for each
    class. Fewer than two labelled classes are an error. Null texts are empty.

    Grams are looked up once; the fit reads their places. The machines of all folds and
    of LABELS_AT_ONCE labels share each pass, so passes don't grow with folds.
    """
    from colsense.sources.sinks import write_down

    lab = rows.where("label IS NOT NULL").select(key, "label", "text")
    fold = F.pmod(F.xxhash64(F.lit(7), key), F.lit(folds)).cast("int")
    texts = write_down(class_weights(lab, "label").select(F.monotonically_increasing_id().alias("row"), "label", "weight", fold.alias("fold"), text_words(F.col("text")).alias("words")), **SMALL_GROUPS)
    found = texts.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).collect()
    labels = sorted({r["label"] for r in found})
    if len(labels) < 2:
        raise ValueError(f"two classes are needed, {labels} are there")
    chars, pairs = vocabulary(texts, features)
    chars, pairs = {g: k for k, g in enumerate(chars)}, {g: k + len(chars) for k, g in enumerate(pairs)}
    y = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int") - 1
    found_rows = write_down(gram_rows(texts.withColumn("y", y), chars, pairs), **SMALL_GROUPS)

    def count(total, y, weight, fold, used, x):
        total[used, 0] += x.sum(axis=0)

    idf = np.log((sum(r["n"] for r in found) + 1) / (summed(found_rows, len(chars) + len(pairs), (len(chars) + len(pairs), 1), count)[:, 0] + 1))
    weighs = lambda f: sum(r["weight"] for r in found if r["fold"] != f)
    # A class that stands in one fold alone: its margins come from the other folds.
    used = [f for f in sorted({r["fold"] for r in found}) if len({r["label"] for r in found if r["fold"] != f}) == len(labels)]
    machines: dict[int, list[np.ndarray]] = {f: [] for f in (*used, -1)}
    for k in range(0, len(labels), LABELS_AT_ONCE):
        sides = [(c, f) for f in machines for c in range(k, min(k + LABELS_AT_ONCE, len(labels)))]
        w = fit_machines(found_rows, idf, sides, np.array([weighs(f) for _, f in sides]), reg, iterations)
        for f in machines:
            machines[f].append(w[:, [i for i, s in enumerate(sides) if s[1] == f]])
    whole = {f: np.hstack(w) for f, w in machines.items()}
    final = whole.pop(-1)
    margins = write_down(held_out_margins(found_rows, idf, whole or {-1: final}))
    sigmoids = []
    for k in range(len(labels)):
        one = margins.select(array_to_vector(F.array(F.col("m")[k])).alias("m"), (F.col("y") == k).cast("double").alias("is"))
        model = LogisticRegression(featuresCol="m", labelCol="is", maxIter=50).fit(one)
        sigmoids.append((float(model.coefficients[0]), float(model.intercept)))
    return CalibratedSvm(Grams(chars, pairs, idf), final, labels, sigmoids)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with ``weight``: n / (classes x rows of the class)."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    k = c.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    w = c.crossJoin(F.broadcast(k)).select(label, (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))
    return rows.join(F.broadcast(w), label)


def lexical(dims: int = 1 << 14, reduce_to: int | None = None) -> Pipeline:
    """TF-IDF of ``tokens`` into a linear classifier that gives probabilities; optionally on principal components."""
    stages = [StringIndexer(inputCol="label", outputCol="y", handleInvalid="skip"), HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dims if not reduce_to else 512), IDF(inputCol="tf", outputCol="x0" if reduce_to else "x")]
    if reduce_to:
        stages.append(PCA(k=reduce_to, inputCol="x0", outputCol="x"))
    return Pipeline(stages=[*stages, LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=20, regParam=0.01)])


def forest(texts: list[str], numbers: list[str], seed: int = 42) -> Pipeline:
    """A forest on hashed token columns and numbers; each split looks at a third of the features, as few of the hashed ones tell anything."""
    tf = [HashingTF(inputCol=t, outputCol=f"{t}_v", numFeatures=128) for t in texts]
    return Pipeline(stages=[StringIndexer(inputCol="label", outputCol="y", handleInvalid="skip"), *tf, VectorAssembler(inputCols=[*[f"{t}_v" for t in texts], *numbers], outputCol="x", handleInvalid="keep"), RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=20, maxDepth=6, featureSubsetStrategy="onethird", seed=seed)])


#: Rows of one task of a fit: a forest keeps a row as about a kilobyte of bins.
ROWS_OF_A_TASK = 100_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a hash of their key over as many tasks as they need, however few files or row groups they stand in."""
    n = rows.count()
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_OF_A_TASK)), key)


def fit_to_votes(pipeline: Pipeline, rows: DataFrame, least_rows: int = 10, least_classes: int = 2) -> PipelineModel | None:
    """Fits to labelled rows, or gives None with too few of them."""
    lab = rows.where("label IS NOT NULL")
    n = lab.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).first()
    if n["n"] < least_rows or n["k"] < least_classes:
        return None
    return pipeline.fit(class_weights(lab, "label"))


def predictions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with ``pred`` and ``p``, the probability of the predicted class."""
    labels = F.array(*map(F.lit, model.stages[0].labels))
    out = model.transform(rows.withColumn("weight", F.lit(1.0)) if "weight" not in rows.columns else rows)
    return out.withColumn("pred", F.get(labels, F.col("prediction").cast("int"))).withColumn("p", F.array_max(vector_to_array("probability")))


def probabilities(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """(key, code, p) of every class."""
    labels = F.array(*map(F.lit, model.stages[0].labels))
    out = model.transform(rows)
    return out.select(key, F.posexplode(vector_to_array("probability")).alias("i", "p")).select(key, F.get(labels, F.col("i")).alias("code"), "p")


def ensemble_variance(pipeline: Pipeline, rows: DataFrame, key: str, members: int = 3) -> DataFrame:
    """(key, code, p, variance) over models fitted to bootstrap draws."""
    out = None
    for k in range(members):
        draw = class_weights(rows.where("label IS NOT NULL").sample(True, 1.0, k), "label")
        part = probabilities(pipeline.fit(draw), rows, key)
        out = part if out is None else out.union(part)
    return out.groupBy(key, "code").agg(F.avg("p").alias("p"), F.var_pop("p").alias("variance"))


def donors(rows: DataFrame, key: str, columns: list[str], seed: int, group: int = 1000) -> DataFrame:
    """rows with ``donor``, the columns of another row: the next one by hash in one of many groups of about ``group`` rows."""
    n = rows.count()
    within = Window.partitionBy("_g").orderBy(F.xxhash64(F.lit(seed), key), F.col(key))
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(*columns)
    return rows.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(max(1, n // group)))).withColumn("donor", F.coalesce(F.lead(own).over(within), F.first(own).over(whole))).drop("_g")


def permutation_importance(model: PipelineModel, rows: DataFrame, key: str, features: list[str], rounds: int = 2) -> DataFrame:
    """(feature, drop): mean loss of accuracy when a feature comes from another row."""
    right = lambda df: predictions(model, df).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc")).first()["acc"]
    base, out = right(rows), []
    for f in features:
        hits = [right(donors(rows, key, [f], r).withColumn(f, F.col(f"donor.{f}")).drop("donor")) for r in range(rounds)]
        out.append((f, base - sum(hits) / rounds))
    return rows.sparkSession.createDataFrame(out, "feature string, drop double")


def one_donor(rows: DataFrame, key: str, features: list[str], seed: int = 42) -> DataFrame:
    """One row with a value of each feature, each from the row that a hash puts first: an aggregate, no order of all rows."""
    return rows.agg(*[F.min_by(f, F.struct(F.xxhash64(F.lit(seed), F.lit(f), F.col(key)), F.col(key))).alias(f) for f in features])


def coalition_losses(model: PipelineModel, rows: DataFrame, donor: DataFrame, features: list[str], masks: list[int]) -> dict[int, float]:
    """Mean cross entropy of all labelled rows for each set of features (bits of a mask) that keep their own values; the others have the donor's.

    All sets are scored in one job: rows times sets, reduced to a number for each set.
    """
    spark = rows.sparkSession
    given = donor.select(*[F.col(f).alias(f"_d_{f}") for f in features])
    sets = spark.createDataFrame([(m,) for m in masks], "_mask long")
    mixed = rows.where("label IS NOT NULL").crossJoin(F.broadcast(given)).crossJoin(F.broadcast(sets))  # one row, and some hundred
    mixed = mixed.withColumns({f: F.when(F.bitwise_not(F.col("_mask")).bitwiseAND(1 << k) == 0, F.col(f)).otherwise(F.col(f"_d_{f}")) for k, f in enumerate(features)})
    p = F.get(vector_to_array("probability"), F.col("y").cast("int"))
    scored = model.transform(mixed.withColumn("weight", F.lit(1.0)))
    found = scored.groupBy("_mask").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss")).collect()
    return {r["_mask"]: r["loss"] for r in found}


def sage(model: PipelineModel, rows: DataFrame, key: str, features: list[str], permutations: int = 512, chunk: int = 16, least: int = 32, ratio: float = 0.025, seed: int = 42) -> DataFrame:
    """(feature, value, std, n): Shapley values of the features for the model's loss, by sampled orders, until they settle.

    In an order the features take their own values one after the other in place of the
    donor's; a feature is credited with the fall of the mean loss at its turn. Orders are
    drawn in rounds of ``chunk``; what the rounds keep is a sum and a sum of squares for
    each feature, and the loss of each set met so far, so a set is scored once. From
    ``least`` orders on the rounds end when no feature's standard error is more than
    ``ratio`` of its mean. Rows without a label are left out; without rows all is 0.
    """
    rng = np.random.default_rng(seed)
    f = len(features)
    donor = one_donor(rows.where("label IS NOT NULL"), key, features, seed).persist()
    losses: dict[int, float] = {}
    total, squares, n = np.zeros(f), np.zeros(f), 0
    while n < permutations:
        orders = [rng.permutation(f) for _ in range(min(chunk, permutations - n))]
        chains = [np.concatenate(([0], np.cumsum(1 << o.astype(np.int64)))) for o in orders]
        fresh = sorted({int(m) for c in chains for m in c} - losses.keys())
        if fresh:
            found = coalition_losses(model, rows, donor, features, fresh)
            losses |= {m: found.get(m, 0.0) for m in fresh}
        for order, chain in zip(orders, chains):
            fall = -np.diff([losses[int(m)] for m in chain])
            total[order] += fall
            squares[order] += fall**2
        n += len(orders)
        mean = total / n
        error = np.sqrt(np.maximum(squares / n - mean**2, 0) / n)
        if n >= least and (error / (np.abs(mean) + 1e-9)).max() < ratio:
            break
    donor.unpersist()
    return rows.sparkSession.createDataFrame([(x, float(v), float(e), n) for x, v, e in zip(features, mean, error)], "feature string, value double, std double, n long")


def row_attribution(model: PipelineModel, rows: DataFrame, key: str, features: list[str], rounds: int = 2, keep: int = 3) -> DataFrame:
    """(key, feature, value, rank): the features with most effect on each row's predicted class.

    In each round the features take their own values one after the other, in an order
    that rotates, in place of another row's; a feature's value is the mean change of the
    class's probability at its turn.
    """
    classes = predictions(model, rows).select(key, F.col("prediction").cast("int").alias("_class"))
    base = rows.join(classes, key)
    rng, parts = np.random.default_rng(rounds), None
    for r in range(rounds):
        order = [features[k] for k in rng.permutation(len(features))]
        given = donors(base, key, features, r)
        # One row for each step: the first ``step`` features of the order are the row's own.
        steps = given.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(order)))))
        for k, f in enumerate(order):
            steps = steps.withColumn(f, F.when(F.col("step") > k, F.col(f)).otherwise(F.col(f"donor.{f}")))
        p = F.get(vector_to_array("probability"), F.col("_class"))
        scored = model.transform(steps.withColumn("weight", F.lit(1.0))).select(key, "step", p.alias("p"))
        change = F.col("p") - F.lag("p").over(Window.partitionBy(key).orderBy("step"))
        part = scored.withColumn("value", change).where("step > 0").select(key, F.get(F.array(*map(F.lit, order)), F.col("step") - 1).alias("feature"), "value")
        parts = part if parts is None else parts.union(part)
    mean = parts.groupBy(key, "feature").agg(F.avg("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.round("value", 12)).desc(), "feature"))
    return mean.withColumn("rank", rank).where(F.col("rank") <= keep)


def top_coefficients(model: PipelineModel, k: int = 20) -> DataFrame:
    """(code, feature, weight, r): the strongest hashed features of each class; the model is bounded."""
    from pyspark.sql import SparkSession

    m = model.stages[-1].coefficientMatrix.toArray()
    labels = model.stages[0].labels if m.shape[0] > 1 else model.stages[0].labels[1:]
    rows = []
    for label, w in zip(labels, m):
        for r, i in enumerate(sorted(range(len(w)), key=lambda i: (-abs(w[i]), i))[:k]):
            rows.append((label, int(i), float(w[i]), r + 1))
    return SparkSession.getActiveSession().createDataFrame(rows, "code string, feature int, weight double, r int")


def linear_attribution(rows: DataFrame, vector: str, weights: list[float], means: list[float], groups: dict[str, tuple[int, int]]) -> DataFrame:
    """rows with phi_<group>: weight x (value - mean), summed over each group's slice [from, to)."""
    w, m = F.array(*map(F.lit, weights)), F.array(*map(F.lit, means))
    phi = F.zip_with(F.zip_with(F.col(vector), m, lambda x, y: x - y), w, lambda x, y: x * y)
    out = rows.withColumn("_phi", phi)
    for g, (a, b) in groups.items():
        out = out.withColumn(f"phi_{g}", F.aggregate(F.slice("_phi", a + 1, b - a), F.lit(0.0), lambda s, x: s + x))
    return out.drop("_phi")


def projection(rows: DataFrame, numbers: list[str], key: str) -> DataFrame:
    """(key, x, y): two principal components; the sign makes the largest loading of each positive."""
    x = VectorAssembler(inputCols=numbers, outputCol="f").transform(rows)
    model = PCA(k=2, inputCol="f", outputCol="pc").fit(x)
    load = model.pc.toArray()
    signs = [1.0 if load[abs(load[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    a = vector_to_array("pc")
    return model.transform(x).select(key, (a[0] * signs[0]).alias("x"), (a[1] * signs[1]).alias("y"))
