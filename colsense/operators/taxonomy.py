"""Hierarchies of codes as tables.

A taxonomy is (code, parent_code, label, mnemonic, ...). Everything hierarchical is
read off its closure (code, ancestor, distance), the pairs of each node with itself
and all nodes above it. It is built by doubling distances, each round one join, and
written down; dotted codes need no rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.sources.sinks import write_down


def dot_prefixes(code: Column) -> Column:
    """All dot prefixes of a code, the code itself last."""
    parts = F.split(code, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def build(records: DataFrame) -> DataFrame:
    """Nodes from records (code or id, parent_code, label, abbrev, description, common_names).

    A missing parent is the code's dot prefix.
    """
    have = set(records.columns)
    col = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None).cast("string"))
    code = F.trim(col("code", "id"))
    prefix = F.when(F.instr(code, ".") > 0, F.regexp_replace(code, r"\.[^.]*$", ""))
    label, described = col("label", "ontology"), col("description", "definition")
    return records.select(
        code.alias("code"),
        F.coalesce(F.when(F.trim(col("parent_code")) != "", F.trim(col("parent_code"))), prefix).alias("parent_code"),
        label.alias("label"),
        col("abbrev", "annotation").alias("mnemonic"),
        described.alias("description"),
        F.filter(F.transform(F.split(F.coalesce(col("common_names"), F.lit("")), r"[|,]"), lambda x: F.trim(x)), lambda x: x != "").alias("aliases"),
    ).where(code != "")


def closure(nodes: DataFrame) -> DataFrame:
    """(code, ancestor, distance), the node itself at distance 0, however deep the hierarchy is.

    Distances double in each round: what is exactly ``step`` away is joined to what that
    node reaches. So a chain of n nodes takes log n rounds, each written down. A node is
    no ancestor of itself, so cycles end; of several ways the shortest counts.
    """
    edges = nodes.select("code", F.col("parent_code").alias("ancestor")).where("parent_code <> code").join(nodes.select(F.col("code").alias("ancestor")), "ancestor", "left_semi").distinct()
    start = nodes.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("distance")).distinct()
    pairs = write_down(start.unionByName(edges.withColumn("distance", F.lit(1))))
    step = 1
    while not pairs.where(F.col("distance") == step).isEmpty():
        far = pairs.where(F.col("distance") == step).select("code", F.col("ancestor").alias("via"))
        on = pairs.where("distance > 0").select(F.col("code").alias("via"), "ancestor", (F.col("distance") + step).alias("distance"))
        further = far.join(on, "via").where("ancestor <> code").select("code", "ancestor", "distance")
        pairs = write_down(pairs.unionByName(further).groupBy("code", "ancestor").agg(F.min("distance").alias("distance")))
        step *= 2
    return pairs


def closure_of_dots(nodes: DataFrame) -> DataFrame:
    """The closure of dotted codes, without joins of levels: each prefix that is a node is an ancestor."""
    up = nodes.select("code", F.explode(dot_prefixes(F.col("code"))).alias("ancestor"))
    depth = lambda c: F.size(F.split(c, r"\."))
    return up.join(nodes.select(F.col("code").alias("ancestor")), "ancestor", "left_semi").select("code", "ancestor", (depth("code") - depth("ancestor")).alias("distance"))


def paths(clo: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, path): mnemonics from the root, by dots; a node without one shows its code in brackets."""
    name = F.coalesce("mnemonic", F.concat(F.lit("("), F.col("ancestor"), F.lit(")")))
    rows = clo.join(nodes.select(F.col("code").alias("ancestor"), "mnemonic"), "ancestor", "left")
    return rows.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), name.alias("name")))), lambda x: x["name"]), ".").alias("path"))


def nearest_present(nodes: DataFrame) -> DataFrame:
    """(code, parent): the nearest dot prefix that is a node, for nodes whose parent is not there; null at the root."""
    up = nodes.select("code", F.explode(dot_prefixes(F.col("code"))).alias("prefix")).where("prefix <> code")
    there = up.join(nodes.select(F.col("code").alias("prefix")), "prefix", "left_semi")
    best = there.groupBy("code").agg(F.max_by("prefix", F.length("prefix")).alias("parent"))
    return nodes.select("code").join(best, "code", "left")


def descendants(clo: DataFrame) -> DataFrame:
    """(ancestor, code) of all nodes strictly below."""
    return clo.where("distance > 0").select("ancestor", "code")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.select("code").join(nodes.select(F.col("parent_code").alias("code")), "code", "left_anti")


def children(nodes: DataFrame) -> DataFrame:
    """(code, children) by code."""
    return nodes.where("parent_code IS NOT NULL").groupBy(F.col("parent_code").alias("code")).agg(F.array_sort(F.collect_set("code")).alias("children"))


def ghosts(nodes: DataFrame) -> DataFrame:
    """Dot prefixes that are no nodes."""
    return nodes.select(F.explode(dot_prefixes(F.col("code"))).alias("code")).distinct().join(nodes.select("code"), "code", "left_anti")


def compose(base: DataFrame, domain: DataFrame) -> DataFrame:
    """The base and the codes that only the domain has."""
    return base.unionByName(domain.join(base.select("code"), "code", "left_anti"), allowMissingColumns=True)


def normal_label(label: Column) -> Column:
    """Lower case, all runs of other characters than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))


def findings(nodes: DataFrame) -> DataFrame:
    """(finding, subject): duplicate codes, labels that collide once normalised, aliases that are another node's label, missing parents."""
    dup = nodes.groupBy("code").count().where("count > 1").select(F.lit("duplicate_code").alias("finding"), F.col("code").alias("subject"))
    names = nodes.where("label IS NOT NULL").select("code", normal_label(F.col("label")).alias("norm"))
    same = names.groupBy("norm").agg(F.countDistinct("code").alias("n")).where("n > 1").select(F.lit("label_collision").alias("finding"), F.col("norm").alias("subject"))
    alias = nodes.select(F.col("code").alias("by"), F.explode("aliases").alias("alias")).select("by", normal_label(F.col("alias")).alias("norm"))
    shadow = alias.join(names, "norm").where("by <> code").select(F.lit("alias_shadowed").alias("finding"), F.concat("by", F.lit(":"), "norm").alias("subject")).distinct()
    lost = nodes.where("parent_code IS NOT NULL").join(nodes.select(F.col("code").alias("parent_code")), "parent_code", "left_anti").select(F.lit("missing_parent").alias("finding"), F.col("code").alias("subject"))
    return dup.union(same).union(shadow).union(lost)


def genera(nodes: DataFrame) -> DataFrame:
    """Nodes with a parent and with children."""
    inner = nodes.where("parent_code IS NOT NULL").select("code")
    return inner.join(nodes.select(F.col("parent_code").alias("code")), "code", "left_semi").distinct()


def genus_of(clo: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, genus): nearest node at or above with a parent and children, else nearest with children."""
    has_child = nodes.select(F.col("parent_code").alias("ancestor")).where("ancestor IS NOT NULL").distinct().withColumn("branch", F.lit(True))
    has_parent = nodes.select(F.col("code").alias("ancestor"), F.col("parent_code").isNotNull().alias("inner"))
    rows = clo.join(has_child, "ancestor", "left").join(has_parent, "ancestor", "left")
    rank = F.when(F.col("branch") & F.col("inner"), 0).when(F.col("branch"), 1)
    return rows.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("code").agg(F.min_by("ancestor", F.struct("rank", "distance")).alias("genus"))


def neighbourhood(nodes: DataFrame, clo: DataFrame, seeds: DataFrame, order: int) -> DataFrame:
    """(code): nodes within ``order`` parent or child steps of the seeds, and all nodes above them."""
    edge = nodes.where("parent_code IS NOT NULL").select("code", F.col("parent_code").alias("to"))
    edge = edge.union(edge.select(F.col("to").alias("code"), F.col("code").alias("to")))
    near = seeds.select("code")
    for _ in range(order):
        near = near.union(near.join(edge, "code").select(F.col("to").alias("code"))).distinct()
    return near.join(clo, "code").select(F.col("ancestor").alias("code")).distinct()


def lift(labels: DataFrame, clo: DataFrame, frame: DataFrame) -> DataFrame:
    """(code, lifted): the code itself if it is in the frame, else its nearest ancestor that is."""
    inside = clo.join(frame.select(F.col("code").alias("ancestor")), "ancestor", "left_semi")
    best = inside.groupBy("code").agg(F.min_by("ancestor", "distance").alias("lifted"))
    return labels.select("code").distinct().join(best, "code", "left")


def closed_frame(labels: DataFrame, clo: DataFrame) -> DataFrame:
    """All codes in use and all above them."""
    return clo.join(labels.select("code").distinct(), "code", "left_semi").select(F.col("ancestor").alias("code")).distinct()


def near(clo: DataFrame, nodes: DataFrame, up: int = 1, down: int = 1) -> DataFrame:
    """(code, neighbour): itself, ``up`` ancestors with their children, ``down`` levels below."""
    above = clo.where(F.col("distance").between(0, up))
    kids = above.where("distance > 0").join(nodes.select(F.col("parent_code").alias("ancestor"), F.col("code").alias("neighbour")), "ancestor").select("code", "neighbour")
    below = clo.where(F.col("distance").between(1, down)).select(F.col("ancestor").alias("code"), F.col("code").alias("neighbour"))
    return above.select("code", F.col("ancestor").alias("neighbour")).union(kids).union(below).distinct()


def name_index(nodes: DataFrame) -> DataFrame:
    """(norm, code): names of nodes; a label beats a mnemonic, that an alias, then the deeper code wins."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    rows = nodes.select("code", F.lit(0).alias("tier"), norm("label").alias("norm"))
    rows = rows.union(nodes.select("code", F.lit(1), norm("mnemonic"))).union(nodes.select("code", F.explode("aliases").alias("a")).select("code", F.lit(2), norm(F.col("a"))))
    depth = F.size(F.split("code", r"\."))
    order = Window.partitionBy("norm").orderBy("tier", depth.desc(), "code")
    return rows.where("norm IS NOT NULL AND norm <> ''").withColumn("k", F.row_number().over(order)).where("k = 1").select("norm", "code")


def derive_reference(columns: DataFrame, index: DataFrame, fallback: str) -> DataFrame:
    """(column, code): decoded from names like attr_1_2_3, the fallback for row_id, else by the name index."""
    c = F.col("column")
    coded = F.regexp_replace(F.regexp_extract(c, r"^(?:attr|code|col|data|field|item|key|ref|val|var)_(\d+(_\d+)*)$", 1), "_", ".")
    norm = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    rows = columns.withColumn("norm", norm).join(index.withColumnRenamed("code", "by_name"), "norm", "left")
    return rows.select("column", F.when(coded != "", coded).when(c == "row_id", F.lit(fallback)).otherwise(F.col("by_name")).alias("code"))


def type_export(nodes: DataFrame, root: str = "classification") -> DataFrame:
    """(type_name, super_types, attributes) of each node, for a governance catalogue."""
    name = lambda c: F.concat(F.lit("T_"), F.regexp_replace(c, "[^A-Za-z0-9]", "_"))
    return nodes.select(name(F.col("code")).alias("type_name"), F.array(F.coalesce(name(F.col("parent_code")), F.lit(root))).alias("super_types"), F.struct("label", "mnemonic").alias("attributes"))


def path_weights(clo: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, alpha): 1/D(node) - 1/D(parent), 1/D at a root; D is the depth of the subtree in nodes."""
    deep = clo.groupBy(F.col("ancestor").alias("code")).agg((F.max("distance") + 1).alias("d"))
    rows = nodes.select("code", "parent_code").join(deep, "code")
    up = deep.select(F.col("code").alias("parent_code"), F.col("d").alias("dp"))
    return rows.join(up, "parent_code", "left").select("code", (1 / F.col("d") - F.coalesce(1 / F.col("dp"), F.lit(0.0))).alias("alpha"))


def tree_distance(clo: DataFrame, weights: DataFrame, codes: DataFrame) -> DataFrame:
    """(a, b, distance): root of the weights on the paths of a and b that they do not share."""
    up = clo.join(codes.select("code"), "code", "left_semi").join(weights.select(F.col("code").alias("ancestor"), "alpha"), "ancestor")
    total = up.groupBy("code").agg(F.sum("alpha").alias("total"))
    left, right = up.select(F.col("code").alias("a"), "ancestor", "alpha"), up.select(F.col("code").alias("b"), "ancestor")
    common = left.join(right, "ancestor").groupBy("a", "b").agg(F.sum("alpha").alias("both"))
    ta, tb = total.select(F.col("code").alias("a"), F.col("total").alias("ta")), total.select(F.col("code").alias("b"), F.col("total").alias("tb"))
    pairs = ta.crossJoin(F.broadcast(tb)).join(common, ["a", "b"], "left")
    return pairs.select("a", "b", F.sqrt(F.greatest(F.col("ta") + F.col("tb") - 2 * F.coalesce("both", F.lit(0.0)), F.lit(0.0))).alias("distance"))


def placement(pairs: DataFrame, clo: DataFrame, genus: DataFrame) -> DataFrame:
    """pairs (id, truth, pred) with ``placement``: exact, ancestor, descendant, same_genus or miss."""
    above = clo.where("distance > 0").select(F.col("code").alias("truth"), F.col("ancestor").alias("pred"), F.lit(True).alias("is_above"))
    below = clo.where("distance > 0").select(F.col("code").alias("pred"), F.col("ancestor").alias("truth"), F.lit(True).alias("is_below"))
    gt, gp = genus.select(F.col("code").alias("truth"), F.col("genus").alias("gt")), genus.select(F.col("code").alias("pred"), F.col("genus").alias("gp"))
    rows = pairs.join(above, ["truth", "pred"], "left").join(below, ["truth", "pred"], "left").join(gt, "truth", "left").join(gp, "pred", "left")
    kind = F.when(F.col("truth") == F.col("pred"), "exact").when(F.col("is_above"), "ancestor").when(F.col("is_below"), "descendant").when(F.col("gt") == F.col("gp"), "same_genus").otherwise("miss")
    return rows.select("id", "truth", "pred", kind.alias("placement"))


def correction_shape(current: Column, proposed: Column) -> Column:
    """How a proposal relates to the current dotted code."""
    parent = lambda c: F.regexp_replace(c, r"\.?[^.]*$", "")
    root = lambda c: F.substring_index(c, ".", 1)
    return (
        F.when(current.isNull() | (current == ""), "no_current")
        .when(current == proposed, "confirm")
        .when(F.startswith(proposed, F.concat(current, F.lit("."))), "tightening")
        .when(F.startswith(current, F.concat(proposed, F.lit("."))), "loosening")
        .when((parent(current) == parent(proposed)) & (parent(current) != ""), "sibling")
        .when(root(current) == root(proposed), "subtree")
        .otherwise("other_tree")
    )


def path_walk(wanted: DataFrame, nodes: DataFrame, steps: int = 8) -> DataFrame:
    """(path, code, bad_index, bad_segment): mnemonic paths walked from the roots; the first segment that fits no child."""
    edge = nodes.select(F.coalesce("parent_code", F.lit("")).alias("at"), F.col("mnemonic").alias("segment"), F.col("code").alias("next"))
    rows = wanted.select("path", F.split("path", r"\.").alias("parts"), F.lit("").alias("at"), F.lit(None).cast("int").alias("bad"))
    for k in range(steps):
        rows = rows.withColumn("segment", F.when(F.col("bad").isNull(), F.get("parts", F.lit(k)))).join(F.broadcast(edge), ["at", "segment"], "left")
        stuck = F.col("segment").isNotNull() & F.col("next").isNull()
        rows = rows.select("path", "parts", F.coalesce("next", "at").alias("at"), F.when(stuck, F.lit(k)).otherwise(F.col("bad")).alias("bad"))
    return rows.select("path", F.col("at").alias("code"), F.col("bad").alias("bad_index"), F.get("parts", F.col("bad")).alias("bad_segment"))


def signature(nodes: DataFrame) -> DataFrame:
    """One row: sha256 of the sorted codes as a JSON list. Codes of a taxonomy are a bounded set."""
    return nodes.agg(F.sha2(F.to_json(F.array_sort(F.collect_set("code"))), 256).alias("signature"), F.countDistinct("code").alias("n_codes"))


def content_keys(nodes: DataFrame) -> DataFrame:
    """(code, content_key): a UUID-shaped digest of the fields that matter."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("code", "label", "mnemonic", "parent_code")]), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return nodes.select("code", F.concat_ws("-", *parts).alias("content_key"))


def compatibility(have: DataFrame, want: DataFrame) -> DataFrame:
    """One row: ok, superset, partial or disjoint, with the missing and the extra codes."""
    both = have.select("code", F.lit(1).alias("h")).distinct().join(want.select("code", F.lit(1).alias("w")).distinct(), "code", "full")
    row = both.agg(F.count_if(F.expr("h IS NULL")).alias("n_missing"), F.count_if(F.expr("w IS NULL")).alias("n_extra"), F.count_if(F.expr("h = 1 AND w = 1")).alias("n_common"))
    kind = F.when((F.col("n_missing") == 0) & (F.col("n_extra") == 0), "ok").when(F.col("n_missing") == 0, "superset").when(F.col("n_common") > 0, "partial").otherwise("disjoint")
    return row.select(kind.alias("compatibility"), "n_missing", "n_extra", "n_common")


def depth_histogram(clo: DataFrame) -> DataFrame:
    """(depth, n) of all nodes; roots have depth 0."""
    return clo.groupBy("code").agg(F.max("distance").alias("depth")).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def focus(rows: DataFrame, near_pairs: DataFrame, *columns: str) -> DataFrame:
    """(id, code): the neighbourhoods of several codes of each row, united."""
    out = None
    for c in columns:
        part = rows.select("id", F.col(c).alias("code")).join(near_pairs, "code").select("id", F.col("neighbour").alias("code"))
        out = part if out is None else out.union(part)
    return out.distinct()


def descend(options: DataFrame, floor: float = 0.2, steps: int = 8) -> DataFrame:
    """(entity, code, weight) by genus-first descent over (entity, parent, option, prob).

    Each opening genus at or above the floor goes down to its most probable option
    until that option is the node itself or a leaf; the heaviest opening wins.
    """
    most = F.max("prob").over(Window.partitionBy("entity"))
    opening = options.where("parent IS NULL").withColumn("most", most).where((F.col("prob") >= floor) | (F.col("prob") == F.col("most")))
    rows = opening.select("entity", F.col("option").alias("at"), F.col("prob").alias("weight"), F.col("option").alias("genus"))
    best = options.where("parent IS NOT NULL").groupBy("entity", F.col("parent").alias("at")).agg(F.max_by("option", F.struct("prob", "option")).alias("to"))
    for _ in range(steps):
        rows = rows.join(best, ["entity", "at"], "left").select("entity", F.coalesce("to", "at").alias("at"), "weight", "genus")
    return rows.groupBy("entity").agg(F.max_by(F.struct("at", "weight"), F.struct("weight", "genus")).alias("x")).select("entity", F.col("x.at").alias("code"), F.col("x.weight").alias("weight"))


def term_support(nodes: DataFrame, anchors: DataFrame, entities: DataFrame, columns: DataFrame) -> DataFrame:
    """(code, support): 1 for each anchor, 3 for each entity and 1 for each column whose name is the code's label."""
    norm = normal_label(F.col("label"))
    names = nodes.select("code", norm.alias("norm"))
    by = lambda df, w: df.select(normal_label(F.col("name")).alias("norm")).join(names, "norm").select("code", F.lit(w).alias("w"))
    rows = anchors.select("code", F.lit(1).alias("w")).join(nodes.select("code"), "code", "left_semi").union(by(entities, 3)).union(by(columns, 1))
    return nodes.select("code").join(rows.groupBy("code").agg(F.sum("w").alias("support")), "code", "left").select("code", F.coalesce("support", F.lit(0)).alias("support"))
