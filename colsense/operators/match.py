"""Joins that attach codes, references and tables to one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a name match is worth, by kind.
EXACT, CODE, ALIAS, OVERLAP = 0.70, 0.50, 0.50, 0.30


def words_of(name: Column) -> Column:
    """Lower-case words of snake_case and CamelCase names."""
    spaced = F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(F.lower(spaced), "[^a-z0-9]+", " "))


def acronym(label: Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(label), " "), lambda w: F.substring(w, 1, 1)), "")


def name_match(columns: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entity, code, mass): the best match of each column's name; the smaller code wins ties.

    Each different name is matched once. Labels, mnemonics, aliases and acronyms are keys
    of one equi-join. Only the rule that all words of a longer label occur in the name
    isn't: it joins on the label's first word and then compares sets.
    """
    called = columns.select("entity", words_of(F.col("name")).alias("name"))
    c = called.select("name").distinct()
    key = lambda v, m, rank: F.struct(words_of(v).alias("key"), F.lit(m).alias("mass"), F.lit(rank).alias("rank"))
    keys = nodes.select("code", F.explode(F.concat(F.array(key(F.col("label"), EXACT, 0), key(F.col("mnemonic"), CODE, 1), key(acronym(F.col("label")), CODE, 3)), F.transform("aliases", lambda a: key(a, ALIAS, 2)))).alias("k")).select("code", "k.*")
    keys = keys.where(F.length("key") > 1).groupBy("key", "code").agg(F.max(F.struct("mass", (-F.col("rank")).alias("r"))).alias("x")).select("key", "code", "x.mass")
    equal = c.join(keys, c.name == keys.key).select("name", "code", "mass")
    long = nodes.select("code", F.split(words_of(F.col("label")), " ").alias("label_words")).where(F.size("label_words") >= 2)
    parts = c.select("name", F.split("name", " ").alias("words")).withColumn("word", F.explode("words"))
    inside = parts.join(long.withColumn("word", F.col("label_words")[0]), "word").where(F.size(F.array_except("label_words", "words")) == 0).select("name", "code", F.lit(OVERLAP).alias("mass"))
    best = Window.partitionBy("name").orderBy(F.col("mass").desc(), "code")
    found = equal.union(inside).withColumn("r", F.row_number().over(best)).where("r = 1").select("name", "code", "mass")
    by = Window.partitionBy("entity").orderBy(F.col("mass").desc(), "code")  # an entity may have several names
    return called.join(found, "name").withColumn("r", F.row_number().over(by)).where("r = 1").select("entity", "code", "mass")


def token_attach(names: DataFrame, tokens: DataFrame, least: int = 3) -> DataFrame:
    """(name, code): names that equal, contain or lie in a token of ``least`` letters; the first code wins.

    The vocabulary of tokens is bounded (a taxonomy); containment is a theta join against it.
    """
    n = names.select("name", words_of(F.col("name")).alias("norm")).distinct()
    t = tokens.select("code", words_of(F.col("token")).alias("token"))
    fits = (F.col("norm") == F.col("token")) | ((F.length("token") >= least) & (F.contains(F.col("norm"), F.col("token")) | F.contains(F.col("token"), F.col("norm"))))
    return n.join(F.broadcast(t), fits).groupBy("name").agg(F.min("code").alias("code"))


def apply_reference(columns: DataFrame, reference: DataFrame) -> DataFrame:
    """(table, column, code): by the bare name, then the qualified one, then the name without its prefix; reference: (key, code)."""
    c = columns.select("table", "column", F.concat_ws(".", "table", "column").alias("q"), F.regexp_replace("column", "^[a-z]+_", "").alias("s"))
    for k, by in enumerate(("column", "q", "s")):
        c = c.join(reference.select(F.col("key").alias(by), F.col("code").alias(f"c{k}")), by, "left")
    return c.select("table", "column", F.coalesce("c0", "c1", "c2").alias("code"))


def key_check(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """One row: how many keys only one side has, and the first of each."""
    a, b = left.select(*keys, F.lit(1).alias("a")).distinct(), right.select(*keys, F.lit(1).alias("b")).distinct()
    both = a.join(b, list(keys), "full").withColumn("key", F.concat_ws(".", *keys))
    return both.agg(F.count_if(F.expr("b IS NULL")).alias("only_left"), F.count_if(F.expr("a IS NULL")).alias("only_right"), F.min(F.when(F.col("b").isNull(), F.col("key"))).alias("first_left"), F.min(F.when(F.col("a").isNull(), F.col("key"))).alias("first_right"))


def foreign_keys(shapes: DataFrame) -> DataFrame:
    """(table, column, target, target_key): columns like x_id point to a table x, xs or xes with a key id or x_id."""
    c = shapes.where(F.endswith("column", F.lit("_id"))).select("table", "column", F.regexp_replace("column", "_id$", "").alias("stem"))
    names = c.select("table", "column", "stem", F.posexplode(F.array("stem", F.concat("stem", F.lit("s")), F.concat("stem", F.lit("es")))).alias("p", "target")).where(F.col("target") != F.col("table"))
    keys = shapes.select(F.col("table").alias("target"), F.col("column").alias("target_key"))
    hit = names.join(keys, "target").where((F.col("target_key") == "id") | (F.col("target_key") == F.concat("stem", F.lit("_id"))))
    best = hit.groupBy("table", "column").agg(F.min(F.struct("p", F.when(F.col("target_key") == "id", 0).otherwise(1).alias("q"), "target", "target_key")).alias("x"))
    return c.join(best, ["table", "column"], "left").select("table", "column", F.col("x.target").alias("target"), F.col("x.target_key").alias("target_key"))


def integrity(edges: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(edge, checked, orphans, ok) of each (name, child, column, parent, key): non-null values without a parent row.

    Distinct child values are counted first, so the join moves each value once however often it occurs.
    """
    rows = []
    for name, child, col, parent, key in edges:
        values = child.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        there = parent.select(F.col(key).alias("v"), F.lit(True).alias("found")).distinct()
        rows.append(values.join(there, "v", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0)).alias("orphans")).select(F.lit(name).alias("edge"), "checked", "orphans"))
    return reduce(DataFrame.union, rows).withColumn("ok", F.col("orphans") == 0)


def merge_shards(*shards: DataFrame, key: str) -> DataFrame:
    """All shards; fails when a key is null or is in two of them."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    bad = F.col(key).isNull() | (n > 1)
    return both.withColumn(key, F.when(bad, F.raise_error(F.concat(F.lit("key missing or in two shards: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(both.schema[key].dataType)).otherwise(F.col(key)))


def resolve_code(text: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(raw, code, how): by path, code, mnemonic, unique prefix of a code, or none."""
    raw = text.select("raw").distinct()
    a = raw.join(paths.select(F.col("path").alias("raw"), F.col("code").alias("by_path")), "raw", "left")
    a = a.join(nodes.select(F.col("code").alias("raw"), F.col("code").alias("by_code")), "raw", "left")
    mnemonic = nodes.groupBy(F.col("mnemonic").alias("raw")).agg(F.min("code").alias("by_mnemonic"))
    a = a.join(mnemonic, "raw", "left")
    prefix = nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda k: F.substr("code", F.lit(1), k))).alias("raw"), "code").groupBy("raw").agg(F.min("code").alias("one"), F.count(F.lit(1)).alias("n"))
    a = a.join(prefix.where("n = 1").select("raw", F.col("one").alias("by_prefix")), "raw", "left")
    how = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_code").isNotNull(), "code").when(F.col("by_mnemonic").isNotNull(), "mnemonic").when(F.col("by_prefix").isNotNull(), "prefix").otherwise("none")
    return a.select("raw", F.coalesce("by_path", "by_code", "by_mnemonic", "by_prefix").alias("code"), how.alias("how"))


def alignment(reference: DataFrame, nodes: DataFrame, share: float = 0.2, least: int = 10) -> DataFrame:
    """One row: aligned, ad_hoc or systemic, by the reference's mnemonics that the vocabulary misses."""
    lost = reference.join(nodes.select("mnemonic").distinct(), "mnemonic", "left_anti")
    n = reference.agg(F.countDistinct("mnemonic").alias("n_mnemonics"))
    m = lost.agg(F.countDistinct("mnemonic").alias("n_missing"), F.count(F.lit(1)).alias("n_columns"))
    row = n.crossJoin(m)
    bad = (F.col("n_missing") >= share * F.col("n_mnemonics")) & (F.col("n_columns") >= least)
    return row.select(F.when(F.col("n_missing") == 0, "aligned").when(bad, "systemic").otherwise("ad_hoc").alias("alignment"), "n_mnemonics", "n_missing", "n_columns")


def sample_overlap(samples: DataFrame, columns: DataFrame) -> DataFrame:
    """(row_id, column, hits, status): rows of samples matched to the columns that hold most of them.

    samples: (row_id, value); columns: (column, value), joined on the value.
    """
    hits = samples.distinct().join(columns.distinct(), "value").groupBy("row_id", "column").agg(F.count(F.lit(1)).alias("hits"))
    by = Window.partitionBy("row_id")
    r = hits.withColumn("r", F.row_number().over(by.orderBy(F.col("hits").desc(), "column"))).withColumn("n", F.count(F.lit(1)).over(by)).where("r = 1")
    ids = samples.groupBy("row_id").agg(F.countDistinct("value").alias("total"))
    status = F.when(F.col("total") < 2, "insufficient").when(F.col("hits").isNull(), "no_match").when(F.col("n") == 1, "unique").otherwise("best_overlap")
    return ids.join(r, "row_id", "left").select("row_id", "column", F.coalesce("hits", F.lit(0)).alias("hits"), status.alias("status"))


def vote_agreement(votes: Column) -> Column:
    """no_signals, all_agree, partial_agree or disagree_all of an array of codes."""
    said = F.filter(votes, lambda v: v.isNotNull() & (v != ""))
    kinds = F.size(F.array_distinct(said))
    return F.when(F.size(said) == 0, "no_signals").when(kinds == 1, "all_agree").when(kinds < F.size(said), "partial_agree").otherwise("disagree_all")


def conflicts(assigned: DataFrame, predicted: DataFrame) -> DataFrame:
    """(entity, code, pred) where the prediction differs from the assigned code or is missing."""
    return assigned.join(predicted, "entity", "left").where(~F.col("code").eqNullSafe(F.col("pred"))).select("entity", "code", "pred")


def apply_corrections(reference: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corrected reference (entity, code), and the change log (entity, old, new)."""
    both = reference.join(accepted.withColumnRenamed("code", "new"), "entity", "left")
    out = both.select("entity", F.coalesce("new", "code").alias("code"))
    log = both.where(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("code"))).select("entity", F.col("code").alias("old"), "new")
    return out, log


def weighted_reference(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(entity, label, weight): missing weights are 1, weights of 0 and classes of one are dropped."""
    w = rows.join(weights, "entity", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).where("weight > 0")
    return w.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label"))).where("n >= 2").drop("n")


def tiered(matched: DataFrame) -> DataFrame:
    """(entity, code, tier) of rows (entity, old, tag, passed, in_vocabulary, always_passed): a passed tag, a kept tag that always passed, else the old one."""
    one = F.col("passed") & F.col("in_vocabulary")
    two = F.col("always_passed")
    return matched.select("entity", F.when(one, F.col("tag")).otherwise(F.col("old")).alias("code"), F.when(one, 1).when(two, 2).otherwise(3).alias("tier"))


def decision_check(decisions: DataFrame, columns: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entity, problem) of decisions (entity, code, confidence, reasoning) against the columns they should cover."""
    both = decisions.withColumn("d", F.lit(True)).join(columns.select("entity", F.lit(True).alias("c")), "entity", "full").join(nodes.select("code", F.lit(True).alias("known")), "code", "left")
    problem = (
        F.when(F.col("c").isNull(), "unknown_column")
        .when(F.col("d").isNull(), "missing")
        .when(F.col("code").isNotNull() & F.col("known").isNull(), "unknown_code")
        .when(~F.col("confidence").isin("high", "medium", "low"), "bad_confidence")
        .when(F.coalesce(F.trim("reasoning"), F.lit("")) == "", "no_reasoning")
    )
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("entity", "problem")


def scope_delta(source: DataFrame, done: DataFrame) -> DataFrame:
    """One row: tables and columns of the source that are not classified yet."""
    rest = source.join(done, ["table", "column"], "left_anti")
    tables = source.select("table").distinct().join(done.select("table").distinct(), "table", "left_anti")
    return rest.agg(F.count(F.lit(1)).alias("new_columns")).crossJoin(tables.agg(F.count(F.lit(1)).alias("new_tables")))


def pattern_targets(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pattern, target, code, how) of (pattern, target): the code itself, else the node with its last part as mnemonic, else as an alias; ``how`` is missed without any.

    Among several nodes the first code wins.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    by_name = nodes.where("mnemonic IS NOT NULL").groupBy(F.upper("mnemonic").alias("leaf")).agg(F.min("code").alias("c1"))
    by_alias = nodes.select("code", F.explode("aliases").alias("a")).groupBy(plain(F.col("a")).alias("alias")).agg(F.min("code").alias("c2")).where("alias <> ''")
    last = F.element_at(F.split("target", r"\."), -1)
    rows = targets.withColumns({"leaf": F.upper(last), "alias": plain(last)})
    rows = rows.join(nodes.select(F.col("code").alias("target"), F.col("code").alias("c0")), "target", "left").join(by_name, "leaf", "left").join(by_alias, "alias", "left")
    how = F.when(F.col("c0").isNotNull(), "code").when(F.col("c1").isNotNull(), "mnemonic").when(F.col("c2").isNotNull(), "alias").otherwise("missed")
    return rows.select("pattern", "target", F.coalesce("c0", "c1", "c2").alias("code"), how.alias("how"))


def pattern_priors(fired: DataFrame, targets: DataFrame, nodes: DataFrame, clo: DataFrame) -> DataFrame:
    """(entity, pattern, code, label, aliases, path) of fired patterns (entity, pattern) whose target (pattern, code) is a node: what the taxonomy says of it, with the labels from the root on."""
    steps = clo.select("code", F.col("ancestor").alias("at"), "distance").join(nodes.select(F.col("code").alias("at"), F.col("label").alias("step")), "at")
    paths = steps.groupBy("code").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("distance", "step")))), lambda x: x["step"]), " > ").alias("path"))
    said = targets.join(nodes.select("code", "label", F.array_join("aliases", ", ").alias("aliases")), "code").join(paths, "code")
    return fired.select("entity", "pattern").join(said, "pattern").select("entity", "pattern", "code", "label", "aliases", "path")
