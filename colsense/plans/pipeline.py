"""The composed classification: evidence of several sources to one row for each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.operators import fusion as D
from colsense.operators import match, profile
from colsense.sources.sinks import write_down

from .inputs import Frame


def classify(masses: DataFrame, frame: Frame, sources: list[str], rule: str = "dempster") -> DataFrame:
    """entity, code, label, bel, pl, gap, k: the headline of each entity and how far it is believed."""
    fused = write_down(D.combine_all(masses, frame.meet, sources, rule))
    head = write_down(D.headline(fused, frame.members, frame.frame).select("entity", "code"))
    iv = D.intervals_of(head.withColumnRenamed("code", "focal"), fused, frame.subset(), frame.meet).withColumnRenamed("focal", "code")
    k = fused.groupBy("entity").agg(F.max("k").alias("k"))
    return head.join(iv, ["entity", "code"], "left").join(frame.nodes.select("code", "label"), "code", "left").join(k, "entity").select("entity", "code", "label", "bel", "pl", "gap", "k")


def result_rows(entities: DataFrame, masses: DataFrame, frame: Frame, sources: list[str], independent: list[str], votes: DataFrame, reference: DataFrame) -> DataFrame:
    """One row for each entity: answer, interval, conflict, evidence, path and cautious answers, vote, independent answer, reference.

    entities: (entity, ...), whose other columns stay; votes: (entity, llm_code,
    llm_confidence); reference: (entity, reference_code). An entity without evidence has
    the empty result: no code, belief 0, plausibility and uncertainty 1, no conflict.
    Lists are texts, their parts in order: ``evidence_sources`` the three strongest
    elements of each source, ``belief_path`` from the answer up, ``cross_subtree_belief``
    all elements that are believed, the deepest last.
    """
    fused = write_down(D.combine_all(masses, frame.meet, sources))
    sub, nine = frame.subset(), lambda df, *cs: write_down(df.withColumns({c: F.round(c, 9) for c in cs}))
    head = write_down(D.headline(fused, frame.members, frame.frame))
    iv = nine(D.belief(fused, sub), "bel")
    on_path = nine(D.intervals_of(D.path_elements(head, frame.clo), fused, sub, frame.meet), "bel", "pl")
    name = F.regexp_replace("focal", r"\*$", "")
    own = on_path.select("entity", name.alias("code"), F.endswith("focal", F.lit("*")).alias("wide"), "bel", "pl").groupBy("entity", "code").agg(F.max_by(F.struct("bel", "pl"), "wide").alias("x"))
    names = frame.nodes.select("code", "label", "mnemonic")
    inner = frame.nodes.select(F.col("parent_code").alias("code")).distinct().withColumn("top_kind", F.lit("internal"))
    k = fused.groupBy("entity").agg(F.max("k").alias("k"))
    answer = head.join(own, ["entity", "code"], "left").join(names, "code", "left").join(inner, "code", "left").join(k, "entity")
    answer = write_down(answer.select("entity", "code", "label", "mnemonic", "mass", F.coalesce("x.bel", F.lit(0.0)).alias("bel"), F.coalesce("x.pl", F.lit(0.0)).alias("pl"), "k", F.coalesce("top_kind", F.lit("leaf")).alias("top_kind")))

    text = lambda order, part, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, part.alias("_t")))), lambda x: x["_t"]), sep)
    per_source = D.top_masses(masses).withColumn("t", F.concat("focal", F.lit(" "), D.hundredths(F.col("mass")))).groupBy("entity", "source").agg(text(["rank"], F.col("t"), ", ").alias("t"))
    summary = per_source.groupBy("entity").agg(text(["source"], F.concat("source", F.lit(": "), "t"), "; ").alias("evidence_sources"))
    path = D.belief_path(on_path, head, frame.clo).groupBy("entity").agg(text(["distance"], F.concat("ancestor", F.lit(" "), D.hundredths(F.col("bel"))), " < ").alias("belief_path"))
    cross = D.believed(iv, 0.5).groupBy("entity").agg(text(["depth", "focal"], F.concat("focal", F.lit(" "), D.hundredths(F.col("bel"))), ", ").alias("cross_subtree_belief"))
    careful = D.cautious(iv, 0.7).select("entity", F.col("code").alias("cautious_code"))
    better = D.promoted(iv, head, 0.5).select("entity", F.when(F.col("promoted"), F.col("code")).alias("cautious_promoted_code"))
    alone = write_down(D.combine_all(masses, frame.meet, independent))
    alone = D.committed(alone).join(alone.groupBy("entity").agg(F.max("k").alias("k")), "entity").select("entity", F.col("code").alias("independent_top1_code"), F.round("mass", 4).alias("independent_top1_mass"), F.round("k", 4).alias("independent_top1_conflict"))
    rows = entities
    for part in (answer, D.margin(iv, head, frame.meet), D.evidence(masses, sources, answer, iv, frame.nodes), summary, path, cross, careful, better, alone, votes, reference):
        rows = rows.join(part, "entity", "left")
    rows = rows.join(names.select(F.col("code").alias("reference_code"), F.col("label").alias("reference_label")), "reference_code", "left")
    gap = F.coalesce(F.col("pl") - F.col("bel"), F.lit(1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        *entities.columns, F.col("code").alias("predicted_code"), F.coalesce("label", F.lit("")).alias("predicted_label"), F.coalesce("mnemonic", F.lit("")).alias("predicted_annotation"), F.round(zero("mass"), 4).alias("confidence"),
        F.round(zero("bel"), 4).alias("belief"), F.round(F.coalesce("pl", F.lit(1.0)), 4).alias("plausibility"), F.round(gap, 4).alias("uncertainty"), F.round(zero("k"), 4).alias("conflict"),
        F.coalesce(D.needs_clarification(F.round("bel", 6), F.round(F.col("pl") - F.col("bel"), 6)), F.lit(False)).alias("needs_clarification"), "top_kind", F.round("margin", 4).alias("top1_margin"),
        F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("evidence_sources", F.lit("")).alias("evidence_sources"), "belief_path", "cautious_code", "cross_subtree_belief", "cautious_promoted_code",
        "reference_code", F.coalesce("reference_label", F.lit("")).alias("reference_label"), F.when(F.col("code").isNotNull(), F.col("reference_code") == F.col("code")).alias("matches_reference"), "llm_code", F.round(zero("llm_confidence"), 4).alias("llm_confidence"),
        "independent_top1_code", "independent_top1_mass", "independent_top1_conflict",
    )


def column_evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Frame]:
    """(entity, table_name, column_name, column_type) of the string columns, the masses of their names and value patterns, and the frame.

    The vocabulary is a small tree of kinds of columns; names are matched against it
    and fired patterns speak for its codes.
    """
    rows = [
        ("1", None, "identifier", "ID", ["identifier"]),
        ("1.1", "1", "person name", "NAME", ["name", "customer name"]),
        ("1.2", "1", "url", "URL", ["link"]),
        ("2", None, "descriptor", "DESC", ["descriptor"]),
        ("2.1", "2", "category", "CAT", ["segment", "status", "priority", "type", "brand"]),
        ("2.2", "2", "language", "LANG", ["lang"]),
        ("2.3", "2", "origin", "ORIG", ["source"]),
    ]
    nodes = spark.createDataFrame(rows, "code string, parent_code string, label string, mnemonic string, aliases array<string>")
    frame = Frame.__new__(Frame)
    frame.nodes = nodes
    from colsense.operators import taxonomy as T

    frame.clo = T.closure_of_dots(nodes)
    frame.frame = D.frame(nodes, frame.clo)
    frame.members = D.members(nodes, frame.clo, frame.frame)
    frame.meet = D.meet(frame.frame, frame.clo)

    from .inputs import cells

    long = cells(spark, d)
    entity = F.concat_ws(".", "table", "column").alias("entity")
    columns = long.select(entity, F.regexp_replace("column", "^[a-z]_", "").alias("name")).distinct()
    by_name = D.name_masses(match.name_match(columns, nodes)).withColumn("source", F.lit("name"))
    fired = profile.fired(profile.pattern_counts(long)).select(entity, "pattern", "fraction")
    targets = spark.createDataFrame([("url_pattern", "1.2")], "pattern string, code string")
    by_pattern = D.pattern_masses(fired, targets).withColumn("source", F.lit("pattern"))
    about = long.select(entity, F.col("table").alias("table_name"), F.col("column").alias("column_name"), "column_type").distinct()
    return about, write_down(by_name.unionByName(by_pattern)), frame


def column_meanings(spark: SparkSession, d: str) -> DataFrame:
    """entity, code, label, bel, pl, gap, k: what the string columns mean."""
    _, masses, frame = column_evidence(spark, d)
    return classify(masses, frame, ["name", "pattern"])


def column_results(spark: SparkSession, d: str) -> DataFrame:
    """The whole result row of every string column; those without evidence have the empty one."""
    about, masses, frame = column_evidence(spark, d)
    none = spark.createDataFrame([], "entity string, llm_code string, llm_confidence double"), spark.createDataFrame([], "entity string, reference_code string")
    return result_rows(about, masses, frame, ["name", "pattern"], ["name", "pattern"], *none)


