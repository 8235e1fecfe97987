"""Splits into train and test, supports and deficits.

Greedy choices take one step for each genus (or label) at most, and a step is one
aggregation over a row for each collection: what the driver sees is the chosen
collection. Collections are without bound; genera are a taxonomy's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.operators.sampling import first_k, numbered
from colsense.sources.sinks import write_down


def even_odd(shapes: DataFrame) -> DataFrame:
    """shapes with ``side``: columns of a table alternate; single-column tables alternate among themselves."""
    n = F.count(F.lit(1)).over(Window.partitionBy("table"))
    r = F.row_number().over(Window.partitionBy("table").orderBy("column"))
    rows = shapes.withColumn("n", n).withColumn("r", r)
    single = numbered(rows.where("n = 1").drop("r", "n"), [], [F.col("table")]).withColumn("r", (F.col("i") + 1).cast("int")).select(rows.columns)
    return rows.where("n > 1").unionByName(single).withColumn("side", F.when(F.col("r") % 2 == 1, "support").otherwise("holdout")).drop("n", "r")


def with_floor(rows: DataFrame, label: str, key: str, floor: int) -> DataFrame:
    """rows with ``side``: the first min(floor, n - 1) of each class support, single ones and those without a class too."""
    n = F.col("n")
    support = F.col(label).isNull() | (n == 1) | (F.col("i") < F.least(F.lit(floor), n - 1))
    return numbered(rows, [label], [F.col(key)]).withColumn("side", F.when(support, "support").otherwise("holdout")).drop("i", "n")


def whole_collections(rows: DataFrame, held: DataFrame, name: str) -> DataFrame:
    """rows with ``side``; collections to hold out that don't exist end the job with an error."""
    lost = held.join(rows.select(name).distinct(), name, "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"unknown collections: {[r[0] for r in lost.orderBy(name).limit(5).collect()]}")
    return rows.join(F.broadcast(held.withColumn("h", F.lit(True))), name, "left").withColumn("side", F.when(F.col("h"), "holdout").otherwise("support")).drop("h")


def coverage_gaps(rows: DataFrame, genus: str, sides: list[str]) -> DataFrame:
    """(genus, missing): genera without a required side."""
    seen = rows.groupBy(genus).agg(F.collect_set("side").alias("s"))
    return seen.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, sides)), "s"))).where(F.size("missing") > 0).select(genus, F.array_join("missing", ",").alias("missing"))


def deficits(rows: DataFrame, label: str) -> DataFrame:
    """(label, support, holdout, deficit): what a class lacks on the holdout side to have its share of all rows."""
    c = rows.groupBy(label).agg(F.count_if(F.expr("side = 'support'")).alias("support"), F.count_if(F.expr("side = 'holdout'")).alias("holdout"))
    w = Window.partitionBy()
    all_, held = F.sum(F.col("support") + F.col("holdout")).over(w), F.sum("holdout").over(w)
    want = F.ceil((F.col("support") + F.col("holdout")) * held / all_)
    return c.withColumn("deficit", F.greatest(want - F.col("holdout"), F.lit(0)))


def exemplars(cells: DataFrame, label: str, keep: int) -> DataFrame:
    """(label, values): the first distinct values of each class by code point."""
    v = cells.select(label, "value").where("value IS NOT NULL").distinct()
    few = first_k(v, [label], [F.col("value")], keep, F.col("value"))
    return few.groupBy(label).agg(F.array_sort(F.collect_list("value")).alias("values"))


def drop_singletons(rows: DataFrame, label: str) -> DataFrame:
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(label))).where("_n >= 2").drop("_n")


def labelled_footprint(columns: DataFrame, nodes: DataFrame) -> DataFrame:
    """(column, code, how): by code, else by a mnemonic that one node alone has; others are dropped."""
    one = nodes.groupBy("mnemonic").agg(F.min("code").alias("by_name"), F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("mnemonic").alias("given"), "by_name")
    j = columns.join(nodes.select(F.col("code").alias("given"), F.col("code").alias("by_code")), "given", "left").join(one, "given", "left")
    return j.select("column", F.coalesce("by_code", "by_name").alias("code"), F.when(F.col("by_code").isNotNull(), "code").otherwise("mnemonic").alias("how")).where("code IS NOT NULL")


def _summary(rows: DataFrame, collection: str, genus: str) -> DataFrame:
    """(name, genera, n): one row for each collection."""
    return write_down(rows.groupBy(F.col(collection).cast("string").alias("name")).agg(F.array_sort(F.collect_set(genus)).alias("genera"), F.count(F.lit(1)).alias("n")))


def _words(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


#: Sides in order of priority with their shares of the collections, and the members a genus needs to reserve one on each.
SIDES, NEEDS = (("train", 0.8), ("test", 0.1), ("validate", 0.1)), {"train": 1, "test": 2, "validate": 3}


def reservations(items: DataFrame, sides: list[str]) -> dict[str, str]:
    """name -> side of the collections that genera reserve, the rarest first, one on each side that lacks it.

    A genus takes the free collection whose other genera are rarest (none at all comes
    first), then the first name. That order doesn't change on the way, and no more than
    sides x genera collections are ever taken: so each genus needs only as many of its
    first collections, which one job finds; the walk over genera is done on these.
    """
    counts = items.select(F.explode("genera").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    members = {r["g"]: r["c"] for r in counts.collect()}  # one row for each genus
    if not members:
        return {}
    most = len(sides) * len(members) + len(sides)
    known = F.map_from_arrays(F.array(*map(F.lit, members)), F.array(*map(F.lit, members.values())))
    each = items.select("name", "genera", F.explode("genera").alias("g"))
    others = F.array_min(F.transform(F.filter("genera", lambda x: x != F.col("g")), lambda x: F.element_at(known, x)))
    first = first_k(each.withColumn("cost", F.coalesce(others, F.lit(0))), ["g"], [F.col("cost"), F.col("name")], most, F.col("name"))
    choices: dict[str, list] = {}
    for r in sorted(first.select("g", "r", "name", "genera").collect()):
        choices.setdefault(r["g"], []).append((r["name"], r["genera"]))
    taken: dict[str, str] = {}
    have = {(g, s): 0 for g in members for s in sides}
    for g in sorted(members, key=lambda g: (members[g], g)):
        # What a genus lacks is settled before its turn.
        for side in [s for s in sides if members[g] >= NEEDS.get(s, 1) and not have[g, s]]:
            free = next((x for x in choices[g] if x[0] not in taken), None)
            if free is None:
                break
            taken[free[0]] = side
            for x in free[1]:
                have[x, side] += 1
    return taken


def balanced(rows: DataFrame, collection: str, genus: str, shares=SIDES) -> DataFrame:
    """(collection, side): whole collections; the rarest genera reserve a collection for each side first, then each next one by name goes to the side that lacks most of its share.

    What a side lacks falls by one with each collection it gets. So the sides in order of
    what they still lack are the greedy choices in order: the i-th free collection takes
    the i-th of them, by one numbering of each. Collections without a genus take part.
    """
    spark = rows.sparkSession
    items = _summary(rows, collection, genus)
    total = items.count()
    sides = [s for s, _ in shares]
    side = reservations(items, sides)
    reserved = spark.createDataFrame(sorted(side.items()), "name string, side string")
    rest = numbered(items.join(F.broadcast(reserved), "name", "left_anti").select("name"), [], [F.col("name")]).select("name", "i")
    left = total - len(side)
    lacks = None
    for k, (s, p) in enumerate(shares):
        got = sum(x == s for x in side.values())
        part = spark.range(left).select((F.lit(p * total) - (F.lit(got) + F.col("id")).cast("double")).alias("lack"), F.lit(k).alias("k"), F.lit(s).alias("side"))
        lacks = part if lacks is None else lacks.unionByName(part)
    turns = numbered(lacks, [], [F.col("lack").desc(), F.col("k")]).where(F.col("i") < left).select("i", "side") if left else None
    dealt = rest.join(turns, "i").select("name", "side") if left else reserved.where("false")
    return reserved.unionByName(dealt).withColumnRenamed("name", collection)


#: Collections of a pass of ``cover`` that come to the driver.
AHEAD = 500


def cover(rows: DataFrame, collection: str, genus: str, budget: int, least: int = 0, required: list[str] | None = None, without: DataFrame | None = None) -> DataFrame:
    """(collection, step, gained): the collection with most new genera next, then the one with more genera, then the smaller one, while it fits in a budget of rows.

    With ``required``, only these genera count, collections in ``without`` (collection)
    are left out, and genera that stay uncovered end the job with an error; so do less
    than ``least`` covered genera.

    What a collection would gain only falls as others are taken. So a pass brings the
    first ``AHEAD`` collections of the order and the one after them: while the best of
    the former, gains counted anew, stands before that one, it is the best of all.
    """
    items = _summary(rows, collection, genus)
    if without is not None:
        items = items.join(without.select(F.col(collection).cast("string").alias("name")).distinct(), "name", "left_anti")
    done: set[str] = set()
    spent, out = 0, []
    useful = lambda genera: set(genera) - done if required is None else set(genera) & set(required) - done
    place = lambda x: (len(useful(x[1])), len(x[1]), -x[2], x[0])

    def open_() -> bool:
        return required is None or bool(set(required) - done)

    while open_():
        wanted = "genera" if required is None else F.array_intersect("genera", _words(required))
        gain = F.size(F.array_except(wanted, _words(sorted(done))))
        fits = items.where(F.col("n") + spent <= budget).withColumn("gain", gain).where("gain > 0")
        first = fits.orderBy(F.col("gain").desc(), F.size("genera").desc(), "n", F.col("name").desc()).limit(AHEAD + 1)
        pool = [(r["name"], r["genera"], r["n"]) for r in first.select("name", "genera", "n").collect()]
        if not pool:
            break
        bound = place(pool.pop()) if len(pool) > AHEAD else (0, 0, 0, "")
        while open_():
            best = max((x for x in pool if x[2] + spent <= budget), key=place, default=None)
            if best is None or not useful(best[1]) or place(best) < bound:
                break
            out.append((best[0], len(out), len(useful(best[1]))))
            done |= set(best[1])
            spent += best[2]
            pool.remove(best)
        if not bound[0]:
            break
    lost = sorted(set(required or []) - done)
    if lost or len(done) < least:
        raise ValueError(f"{len(done)} genera are covered, {least} wanted; required ones without a collection: {lost[:5]}")
    return rows.sparkSession.createDataFrame(out, f"`{collection}` string, step int, gained int")


def held_tables(rows: DataFrame, table: str, label: str) -> DataFrame:
    """(table, side): one table held out for each label, the smallest one that leaves each of its labels another table; rarest labels first."""
    items = _summary(rows, table, label)
    left = {r["g"]: r["c"] for r in items.select(F.explode("genera").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row for each label
    held: list[str] = []
    served: set[str] = set()
    for x in sorted(left, key=lambda k: (left[k], k)):
        if x in served:
            continue
        last = [y for y, n in left.items() if n <= 1]
        free = items.where(F.array_contains("genera", x) & ~F.arrays_overlap("genera", _words(last)) & ~F.array_contains(_words(held), F.col("name")))
        best = free.agg(F.min_by(F.struct("name", "genera"), F.struct("n", "name")).alias("x")).first()["x"]
        if best:
            held.append(best["name"])
            served |= set(best["genera"])
            for y in best["genera"]:
                left[y] -= 1
    return items.select(F.col("name").alias(table), F.when(F.array_contains(_words(held), F.col("name")), "holdout").otherwise("support").alias("side"))


def generator_coverage(nodes: DataFrame, generators: DataFrame) -> DataFrame:
    """(code, gap): missing, inferred_only, template_only, low_diversity or covered."""
    g = generators.groupBy("code").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.max("diversity").alias("diversity"))
    j = nodes.select("code").join(g, "code", "left")
    only = lambda k: (F.size("kinds") == 1) & (F.col("kinds")[0] == k)
    return j.select("code", F.when(F.col("kinds").isNull(), "missing").when(only("inferred"), "inferred_only").when(only("template"), "template_only").when(F.col("diversity") < 0.3, "low_diversity").otherwise("covered").alias("gap"))


def diversity(draws: DataFrame) -> DataFrame:
    """(code, n, distinct_ratio, top_share, mean_length) of generated values."""
    c = draws.groupBy("code", "value").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    return c.groupBy("code").agg(n.alias("n"), (F.count(F.lit(1)) / n).alias("distinct_ratio"), (F.max("c") / n).alias("top_share"), (F.sum(F.length("value") * F.col("c")) / n).alias("mean_length"))


def refinement_targets(scores: DataFrame, counters: DataFrame, least: int = 5, most: int = 10) -> DataFrame:
    """The worst classes that are neither abandoned nor cooling down: lowest accuracy, then most rows."""
    j = scores.join(counters, "code", "left").where("coalesce(abandoned, false) = false AND coalesce(cooldown, 0) = 0")
    enough = j.where(F.col("n") >= least)
    pool = enough if enough.limit(10).count() == 10 else j.where("n >= 2")
    return pool.orderBy(F.round("accuracy", 9), F.col("n").desc(), "code").limit(most).select("code", "n", "accuracy")


def synthetic(spark, templates: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """(row_ix, code, value): values of each template's code with a jitter, the same for the same seed."""
    ids = spark.range(rows).withColumnRenamed("id", "row_ix")
    j = ids.crossJoin(F.broadcast(templates))
    h = F.xxhash64(F.lit(seed), "row_ix", "code")
    number = F.round(F.col("base") * (1 + (F.pmod(h, F.lit(2001)) - 1000) / 10000.0), 2)
    return j.select("row_ix", "code", F.when(F.col("base").isNotNull(), number.cast("string")).otherwise(F.concat("prefix", F.lit("-"), F.lpad(F.pmod(h, F.lit(100000)).cast("string"), 5, "0"))).alias("value"))
