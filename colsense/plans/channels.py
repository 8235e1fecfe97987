"""Queries of evidence from vectors and names (D14, D18, D35), of pattern targets and priors (F18, J13), and of sources and sinks that are written and read back (S03, S07-S09, S12, S20, S23, S27, K11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsense.operators import fusion as D
from colsense.operators import match
from colsense.operators import sensitivity as V
from colsense.operators import similarity as G
from colsense.operators import splits as K
from colsense.operators import taxonomy as T
from colsense.sources import readers as R
from colsense.sources import sinks

from . import query
from .analytics import _E, vectors
from .inputs import CLOSURE, CUSTOMERS, NODES, PAIRS, closure, customers, nodes, pairs, read


def rnd(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# The labels of the embeddings as a taxonomy of two roots with five leaves each. Its similarities are those of late
# interaction, of every vector with the centroids of all leaves and roots; a similarity below 0 speaks against a code.


def _leaf(label):
    k = label.cast("int")
    return F.concat_ws(".", F.floor(k / 5).cast("string"), label)


def label_taxonomy(spark, d):
    leaves = vectors(spark, d).select(_leaf(F.col("code")).alias("code")).distinct()
    n = leaves.select("code", F.substring_index("code", ".", 1).alias("parent_code"))
    n = sinks.write_down(n.union(n.select(F.col("parent_code").alias("code"), F.lit(None).cast("string")).distinct()))
    return n, sinks.write_down(T.closure_of_dots(n))


def late_sims(spark, d):
    v = vectors(spark, d).withColumn("code", _leaf(F.col("code")))
    cents = G.centroids(v).select("code", "v").union(G.centroids(v.withColumn("code", F.substring_index("code", ".", 1))).select("code", "v"))
    tokens = lambda df: df.withColumn("tokens", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", 8 * k + 1, F.lit(8))))
    s = G.late_interaction(tokens(v), tokens(cents))
    return sinks.write_down(s.select(F.col("id").alias("entity"), "code", "s", F.greatest(-F.col("s"), F.lit(0.0)).alias("negative")))


_LEAVES = "l AS (SELECT id, (CAST(code AS INT) // 5) || '.' || code AS leaf, v FROM e), both_ AS (SELECT id, leaf AS code, v FROM l UNION ALL SELECT id, split_part(leaf, '.', 1), v FROM l)"
_RAW = (
    f"WITH {_E}, {_LEAVES}, long AS (SELECT code, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM both_), sums AS (SELECT code, i, sum(x) AS x FROM long GROUP BY 1, 2), norms AS (SELECT code, sqrt(sum(x * x)) AS norm FROM sums GROUP BY 1), cent AS (SELECT code, list(x / norm ORDER BY i) AS v FROM sums JOIN norms USING (code) GROUP BY 1), "
    "qt AS (SELECT id, k, v[8 * k + 1:8 * k + 8] AS t FROM e, range(8) r(k)), dt AS (SELECT code, v[8 * k + 1:8 * k + 8] AS t FROM cent, range(8) r(k)), mm AS (SELECT id, code, k, max(list_dot_product(qt.t, dt.t)) AS m FROM qt, dt GROUP BY 1, 2, 3), raw AS (SELECT id AS entity, code, avg(m) AS s0 FROM mm GROUP BY 1, 2)"
)
_LATE = (
    f"{_RAW}, sims AS (SELECT entity, code, length(code) = 1 AS inner_, greatest(s0, 0) AS s, greatest(-s0, 0) AS negative FROM raw)"
)
_REL = lambda a, b: f"least(greatest(0.6 / (1 + exp(-({a} - 0.40) / 0.10)) + 0.4 * coalesce(tanh(({a} - {b}) / 0.05), 1), 0.1), 0.8)"
_CHAIN = (
    "ranked AS (SELECT *, CASE WHEN inner_ THEN code || '*' ELSE code END AS focal, row_number() OVER (PARTITION BY entity ORDER BY round(s, 12) DESC, code DESC) AS r, exp(s - max(s) OVER (PARTITION BY entity)) AS ex FROM sims), "
    f"two AS (SELECT entity, max(s) AS s1, max(CASE WHEN r = 2 THEN s END) AS s2 FROM ranked GROUP BY 1), rel AS (SELECT entity, {_REL('s1', 's2')} AS alpha, CASE WHEN s2 IS NULL THEN 1 ELSE tanh((s1 - s2) / 0.05) END AS w FROM two), "
    "sp AS (SELECT ranked.*, alpha, w, ex / sum(ex) OVER (PARTITION BY ranked.entity) AS p, CASE WHEN NOT inner_ THEN ex / sum(CASE WHEN NOT inner_ THEN ex END) OVER (PARTITION BY ranked.entity) END AS pl FROM ranked JOIN rel USING (entity)), "
    "held AS (SELECT entity, split_part(code, '.', 1) AS ancestor, sum(pl) AS held FROM sp WHERE NOT inner_ GROUP BY 1, 2), tops AS (SELECT * FROM sp WHERE r = 1), "
    "arnd AS (SELECT t.entity, ancestor, held FROM tops t JOIN held h ON h.entity = t.entity AND h.ancestor = split_part(t.code, '.', 1) WHERE NOT t.inner_ AND round(held, 12) >= 0.5), "
    "parts AS (SELECT sp.entity, focal, (alpha * (1 - w) - alpha * (1 - w) * coalesce(held, 0)) * p + CASE WHEN r = 1 THEN alpha * w ELSE 0 END AS m FROM sp LEFT JOIN arnd USING (entity) "
    "UNION ALL SELECT t.entity, ancestor || '*', alpha * (1 - w) * held FROM tops t JOIN arnd USING (entity) UNION ALL SELECT entity, 'Z', 1 - alpha FROM tops), "
    "ms AS (SELECT entity, focal, sum(m) AS mass FROM parts GROUP BY 1, 2 HAVING sum(m) > 1e-15)"
)
_MAXSIM = f"{_LATE}, {_CHAIN}"
_AGAINST = (
    "ng AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY negative DESC, code) AS n, exp(negative - max(negative) OVER (PARTITION BY entity)) AS en FROM ranked WHERE negative > 0), n2 AS (SELECT entity, max(negative) AS a, max(CASE WHEN n = 2 THEN negative END) AS b FROM ng GROUP BY 1), "
    f"q AS (SELECT entity, focal, {_REL('a', 'b')} * en / sum(en) OVER (PARTITION BY entity) AS q FROM ng JOIN n2 USING (entity)), cf AS (SELECT entity, sum(q * mass) AS conflict FROM q JOIN ms USING (entity, focal) GROUP BY 1)"
)


@query("d14_maxsim_masses", f"{_MAXSIM}, {_AGAINST} SELECT ms.entity, ms.focal, round(mass, 6) AS mass, round(CASE WHEN t.inner_ THEN NULL ELSE coalesce(held, 0) END, 6) AS concentration, round(coalesce(conflict, 0), 6) AS conflict FROM ms JOIN tops t USING (entity) LEFT JOIN arnd USING (entity) LEFT JOIN cf USING (entity)")
def d14(spark, d):
    return rnd(D.maxsim_masses(late_sims(spark, d), label_taxonomy(spark, d)[1]), "mass", "concentration", "conflict")


# Invariants (D38): the mean profile of every class, each grid point an entity of its own in the chain above.
_X, _Y = f"i * {V.STEP}::DOUBLE", f"j * {V.STEP}::DOUBLE"
_IN = lambda *names: "invariant IN (" + ", ".join(f"'{n}'" for n in names) + ")"
_GRID = " UNION ALL ".join(f"SELECT '{n}' AS invariant, i, j FROM range({a}, {a + k}) x(i), range({b}, {b + m}) y(j)" for n, ((a, k), (b, m)) in V.GRIDS.items())
_TWIN = f"greatest(0, least(1, s + {V.EPSILON}::DOUBLE * (CAST('0x' || substr(md5(config || ':' || code || ':' || i), 1, 8) AS BIGINT)::DOUBLE / 4294967295.0 * 2 - 1)))"
_POINTS = f"""{_RAW}, prof AS MATERIALIZED (SELECT leaf AS config, code, round(avg(greatest(s0, 0)), 9) AS s, round(avg(greatest(-s0, 0)), 9) AS negative FROM raw JOIN l ON l.id = raw.entity GROUP BY 1, 2),
 tg AS (SELECT config, arg_max(code, struct_pack(s := s, c := code)) AS target FROM prof WHERE length(code) > 1 GROUP BY 1),
 who AS (SELECT config, target, target[1] AS parent, (SELECT arg_max(code, struct_pack(s := s, c := code)) FROM prof p WHERE p.config = tg.config AND length(code) > 1 AND code <> target AND code[1] = target[1]) AS sibling, (SELECT arg_max(code, struct_pack(s := s, c := code)) FROM prof p WHERE p.config = tg.config AND length(code) > 1 AND code[1] <> target[1]) AS competitor FROM tg),
 pt AS MATERIALIZED (SELECT config || '|' || invariant || '|' || i || '|' || j AS entity, config, invariant, i, j, target, sibling, competitor, parent, code,
  CAST(CASE WHEN code = target AND {_IN('mass_conservation', 'monotonicity_positive', 'conflict_k_transit', 'aggregation_vs_leaf_competition')} THEN {_X} WHEN code = target AND {_IN('verifier_pass_rate_effect')} THEN s * {_X} WHEN code = sibling AND {_IN('aggregation_threshold_cliff')} THEN {_X}
   WHEN code = sibling AND {_IN('aggregation_vs_leaf_competition')} THEN {_Y} WHEN code = competitor AND {_IN('aggregation_threshold_cliff')} THEN {_Y} WHEN code = parent AND {_IN('internal_node_top1_switch')} THEN {_X} WHEN {_IN('ranking_stability')} AND i > 0 THEN {_TWIN} ELSE s END AS DOUBLE) AS s,
  CAST(CASE WHEN code = parent AND {_IN('mass_conservation')} THEN {_Y} WHEN code = target AND {_IN('anti_monotonicity_negative')} THEN {_X} WHEN code = target AND {_IN('conflict_k_transit')} THEN {_Y} WHEN code = parent AND {_IN('aggregation_under_anti_example')} THEN {_X} ELSE negative END AS DOUBLE) AS negative
  FROM prof JOIN who USING (config), ({_GRID}) g), sims AS (SELECT entity, code, length(code) = 1 AS inner_, greatest(s, 0) AS s, negative FROM pt)"""
_SEEN = f"""about AS (SELECT entity, any_value(config) AS config, any_value(invariant) AS invariant, any_value(i) AS i, any_value(j) AS j, any_value(target) AS target, any_value(competitor) AS competitor, any_value(parent) AS parent, list_reverse_sort(list(s)) AS two FROM pt GROUP BY 1),
 seen AS (SELECT entity, a.config, a.invariant, a.i, a.j, round(two[1] - coalesce(two[2], 0), 9) AS lead, sum(mass) AS total, coalesce(max(mass) FILTER (WHERE focal = target), 0) AS leaf, coalesce(max(mass) FILTER (WHERE focal = parent || '*'), 0) AS tree, coalesce(max(mass) FILTER (WHERE focal = competitor), 0) AS rival,
  arg_min(regexp_replace(focal, '[*]$', ''), struct_pack(m := -round(mass, 9), c := regexp_replace(focal, '[*]$', ''))) FILTER (WHERE focal <> 'Z') AS best, max(coalesce(conflict, 0)) AS k FROM ms JOIN about a USING (entity) LEFT JOIN cf USING (entity) GROUP BY ALL),
 steps AS (SELECT *, leaf - lag(leaf) OVER w AS d_leaf, tree - lag(tree) OVER w AS d_tree, rival - lag(rival) OVER w AS d_rival, (leaf >= tree) <> lag(leaf >= tree) OVER w AS turned, coalesce(best <> first(best) OVER w, false) AS other, first(tree) OVER w AS first_tree FROM seen WINDOW w AS (PARTITION BY config, invariant, j ORDER BY i))"""
_FOUND = f"""SELECT invariant, config, count(*) AS cells, count(*) FILTER (WHERE CASE invariant WHEN 'mass_conservation' THEN abs(total - 1) >= {V.TOLERANCE} WHEN 'monotonicity_positive' THEN d_leaf < -{V.TOLERANCE} WHEN 'verifier_pass_rate_effect' THEN d_leaf < -{V.TOLERANCE} WHEN 'anti_monotonicity_negative' THEN d_leaf > {V.TOLERANCE} WHEN 'aggregation_under_anti_example' THEN d_rival < -{V.TOLERANCE} END) AS violations,
 count(*) FILTER (WHERE CASE invariant WHEN 'conflict_k_transit' THEN k >= {V.CONFLICT} WHEN 'aggregation_threshold_cliff' THEN d_tree > {V.JUMP} WHEN 'aggregation_vs_leaf_competition' THEN tree > leaf WHEN 'internal_node_top1_switch' THEN turned AND greatest(abs(d_leaf), abs(d_tree)) > {V.SWITCH} WHEN 'ranking_stability' THEN other END) AS flagged,
 max(CASE invariant WHEN 'mass_conservation' THEN abs(total - 1) WHEN 'monotonicity_positive' THEN leaf WHEN 'anti_monotonicity_negative' THEN leaf WHEN 'conflict_k_transit' THEN k WHEN 'ranking_stability' THEN CASE WHEN i = 0 THEN lead END WHEN 'aggregation_threshold_cliff' THEN d_tree WHEN 'aggregation_vs_leaf_competition' THEN tree - leaf WHEN 'internal_node_top1_switch' THEN CASE WHEN turned THEN greatest(abs(d_leaf), abs(d_tree)) END WHEN 'aggregation_under_anti_example' THEN first_tree - tree WHEN 'verifier_pass_rate_effect' THEN abs(d_leaf) END) AS value FROM steps GROUP BY 1, 2"""


@query("d38_invariants", f"{_POINTS}, {_CHAIN}, {_AGAINST}, {_SEEN}, r AS ({_FOUND}) SELECT invariant, config, CASE WHEN invariant = 'ranking_stability' THEN {V.TWINS} ELSE cells END AS cells, CASE WHEN invariant = 'ranking_stability' THEN CASE WHEN value > 2 * {V.EPSILON} AND flagged / {V.TWINS} > {V.UNSTABLE} THEN 1 ELSE 0 END ELSE violations END AS violations, flagged, round(CASE WHEN invariant = 'ranking_stability' THEN flagged / {V.TWINS} ELSE value END, 6) AS value FROM r")
def d38(spark, d):
    """Ten invariants of evidence from similarities, on grids around the mean profile of each class of the embeddings."""
    n, clo = label_taxonomy(spark, d)
    classes = vectors(spark, d).select(F.col("id").alias("entity"), _leaf(F.col("code")).alias("config"))
    return rnd(V.study(late_sims(spark, d), classes, n, clo), "value")


_UNION = (
    f"{_MAXSIM}, cs AS (SELECT e.id AS entity, c.code, list_dot_product(e.v, c.v) AS s FROM e, cent c), rk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(s, 9) DESC, code) AS r FROM cs), nd AS (SELECT DISTINCT leaf AS code FROM l UNION SELECT DISTINCT split_part(leaf, '.', 1) FROM l), "
    "mem AS (SELECT code AS focal, code FROM nd UNION ALL SELECT a.code || '*', b.code FROM nd a JOIN nd b ON b.code = a.code OR b.code LIKE a.code || '.%' WHERE length(a.code) = 1 UNION ALL SELECT 'Z', code FROM nd), sz AS (SELECT focal, count(*) AS size FROM mem GROUP BY 1), "
    "u AS (SELECT ms.entity, ms.focal, mass, size, mem.code, k, coalesce(r <= k, false) AS near FROM ms JOIN sz USING (focal) JOIN mem USING (focal) LEFT JOIN rk ON rk.entity = ms.entity AND rk.code = mem.code, (SELECT unnest([3, 5, 7, 10]) AS k)), "
    "un AS (SELECT *, count(*) FILTER (WHERE near) OVER (PARTITION BY entity, focal, k) AS sn FROM u), sm AS (SELECT entity, k, a AS alpha, code, sum(mass * ((1 - a) / size + CASE WHEN near THEN a / sn ELSE 0 END)) AS p FROM un, (SELECT unnest([0.35, 0.45, 0.55, 0.65]) AS a) GROUP BY 1, 2, 3, 4), "
    "pk AS (SELECT entity, k, alpha, arg_min(code, struct_pack(p := -round(p, 9), c := code)) AS code FROM sm GROUP BY 1, 2, 3)"
)


@query("d35_union_sweep", f"{_UNION} SELECT k, CAST(alpha AS DOUBLE) AS alpha, count(*) AS n, count(*) FILTER (WHERE pk.code = leaf) AS correct, 0 AS fallbacks, round(count(*) FILTER (WHERE pk.code = leaf) / count(*), 6) AS accuracy FROM pk JOIN l ON l.id = pk.entity GROUP BY 1, 2")
def d35(spark, d):
    """Masses of late interaction, and the union of the first codes by plain cosine."""
    n, clo = label_taxonomy(spark, d)
    fr = D.frame(n, clo)
    v = vectors(spark, d).withColumn("code", _leaf(F.col("code")))
    cents = G.centroids(v).select("code", "v").union(G.centroids(v.withColumn("code", F.substring_index("code", ".", 1))).select("code", "v"))
    ranked = G.best_k(G.to_categories(v, cents), 10).select(F.col("id").alias("entity"), "code", "r")
    base = sinks.write_down(D.maxsim_masses(late_sims(spark, d), clo).select("entity", "focal", "mass"))
    return D.union_sweep(base, sinks.write_down(ranked), v.select(F.col("id").alias("entity"), F.col("code").alias("truth")), D.members(n, clo, fr), fr, [3, 5, 7, 10], [0.35, 0.45, 0.55, 0.65])


_NAMED = "nm AS (SELECT entity, n.code, 0.70 AS mass FROM cust JOIN nation ON c_nationkey = n_nationkey JOIN nodes n ON n.label = n_name)"


@query("d18_name_masses", f"WITH {NODES}, {CUSTOMERS}, {_NAMED}, o AS (SELECT entity, min(code) AS code, max(mass) AS mass FROM nm GROUP BY 1) SELECT entity, code AS focal, round(mass, 6) AS mass FROM o UNION ALL SELECT entity, 'Z', round(1 - mass, 6) FROM o")
def d18(spark, d):
    """Columns that are called like their customers' nations, matched to the taxonomy by name."""
    c = customers(spark, d).join(F.broadcast(read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))), "c_nationkey")
    names = c.select(F.col("name").alias("entity"), "name").distinct()
    by_name = match.name_match(names, nodes(spark, d)).select(F.col("entity").alias("name"), "code", "mass")
    return rnd(D.name_masses(c.select("entity", "name").join(F.broadcast(by_name), "name").select("entity", "code", "mass")), "mass")


_TARGETS = "tg AS (SELECT 'p' || n_nationkey AS pattern, CASE n_nationkey % 4 WHEN 0 THEN n_regionkey || '.' || n_nationkey WHEN 1 THEN 'ICE.X.' || upper(left(n_name, 6)) WHEN 2 THEN 'ICE.Y.' || lower(n_name) ELSE 'ICE.NOWHERE' END AS target FROM nation)"
_PLAIN = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"
_RESOLVED = (
    f"nm1 AS (SELECT upper(left(label, 6)) AS leaf, min(code) AS c1 FROM nodes GROUP BY 1), nm2 AS (SELECT {_PLAIN('label')} AS alias, min(code) AS c2 FROM nodes GROUP BY 1), rs AS (SELECT pattern, target, coalesce(n.code, c1, c2) AS code, CASE WHEN n.code IS NOT NULL THEN 'code' WHEN c1 IS NOT NULL THEN 'mnemonic' WHEN c2 IS NOT NULL THEN 'alias' ELSE 'missed' END AS how "
    f"FROM tg LEFT JOIN nodes n ON n.code = target LEFT JOIN nm1 ON nm1.leaf = upper(string_split(target, '.')[-1]) LEFT JOIN nm2 ON nm2.alias = {_PLAIN(chr(115) + 'tring_split(target, ' + chr(39) + '.' + chr(39) + ')[-1]')})"
)


def targets(spark, d):
    n = read(spark, d, "nation")
    k = F.col("n_nationkey") % 4
    target = F.when(k == 0, F.concat_ws(".", "n_regionkey", "n_nationkey")).when(k == 1, F.concat(F.lit("ICE.X."), F.upper(F.substring("n_name", 1, 6)))).when(k == 2, F.concat(F.lit("ICE.Y."), F.lower("n_name"))).otherwise("ICE.NOWHERE")
    return n.select(F.concat(F.lit("p"), "n_nationkey").alias("pattern"), target.alias("target"))


@query("j13_pattern_targets", f"WITH {NODES}, {_TARGETS}, {_RESOLVED} SELECT * FROM rs")
def j13(spark, d):
    """A pattern for each nation, whose target is a code, a mnemonic, an alias or nothing of the taxonomy."""
    return match.pattern_targets(targets(spark, d), nodes(spark, d))


@query("f18_pattern_priors", f"WITH {NODES}, {CLOSURE}, {CUSTOMERS}, {_TARGETS}, {_RESOLVED}, pt AS (SELECT c.code, string_agg(n.label, ' > ' ORDER BY distance DESC, n.label DESC) AS path FROM clo c JOIN nodes n ON n.code = c.ancestor GROUP BY 1) SELECT entity, pattern, rs.code, n.label, lower(n.label) AS aliases, path FROM cust JOIN rs ON pattern = 'p' || c_nationkey JOIN nodes n ON n.code = rs.code JOIN pt ON pt.code = rs.code")
def f18(spark, d):
    """The pattern of its nation fires for each customer."""
    n = nodes(spark, d)
    fired = customers(spark, d).select("entity", F.concat(F.lit("p"), "c_nationkey").alias("pattern"))
    return match.pattern_priors(fired, match.pattern_targets(targets(spark, d), n).where("how <> 'missed'").select("pattern", "code"), n, closure(spark, d))


# Sources and sinks.


@query("s07_s09_vocabularies", f"WITH {NODES}, k AS (SELECT unnest(['csv', 'json', 'legacy', 'parquet', 'table']) AS kind) SELECT kind, code, parent_code, label, CASE WHEN kind = 'legacy' THEN NULL ELSE lower(label) END AS specifics FROM nodes, k")
def s07(spark, d):
    """The taxonomy goes out as a table, JSON (both shapes), CSV and Parquet, and comes back the same."""
    folder = sinks.shared_folder(spark)
    n = sinks.write_down(nodes(spark, d).select("code", "parent_code", "label", F.lower("label").alias("example_values")))
    n.write.parquet(f"{folder}/parquet")
    n.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/csv")
    n.write.json(f"{folder}/json")
    n.select(F.col("code").alias("id"), F.col("label").alias("Ontology")).write.json(f"{folder}/legacy")
    n.createOrReplaceTempView("colsense_vocabulary")
    out = None
    for kind, how in (("parquet", "parquet"), ("csv", "csv"), ("table", "table")):
        part = R.vocabulary(spark, "colsense_vocabulary" if how == "table" else f"{folder}/{kind}", how).select(F.lit(kind).alias("kind"), "*")
        out = part if out is None else out.union(part)
    for kind in ("json", "legacy"):
        # One object to a line: each is its own document.
        rows = R.records(spark.read.json(f"{folder}/{kind}"))
        one = f"{folder}/{kind}_array"
        rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).coalesce(1).write.text(one)
        out = out.union(R.vocabulary(spark, one, "json").select(F.lit(kind).alias("kind"), "*"))
    return out


@query("s12_release_stats", "SELECT 2 AS n_tables, (SELECT count(*) FROM part) + (SELECT count(*) FROM customer) AS n_columns, left(sha256(CAST((SELECT count(*) FROM part) AS VARCHAR)), 12) AS ontology, (SELECT count(*) FROM nation) AS generation, CAST(NULL AS VARCHAR) AS run")
def s12(spark, d):
    """Statistics of two tables, with a nested manifest, written and read back."""
    path = sinks.shared_folder(spark)
    p, c, n = (read(spark, d, t).agg(F.count(F.lit(1)).alias(t)) for t in ("part", "customer", "nation"))
    manifest = F.struct(F.left(F.sha2(F.col("part").cast("string"), 256), F.lit(12)).alias("ontology_sha"), F.col("nation").alias("vocab_generation"))
    stats = p.crossJoin(c).crossJoin(n).select(F.lit(2).alias("n_tables"), (F.col("part") + F.col("customer")).alias("n_columns"), manifest.alias("generation_manifest"))  # one row each
    stats.coalesce(1).write.json(path)
    return R.release_stats(spark, path)


_COLS = "cols AS (SELECT 't' || p_size AS t, CASE p_partkey % 4 WHEN 0 THEN 'row_id' WHEN 1 THEN lower(p_brand) WHEN 2 THEN 'x' || p_partkey ELSE 'attr_' || p_size || '_' || (p_partkey % 10) END AS c, p_partkey AS ord FROM part)"


@query("s20_curated_reference", f"WITH {_COLS}, nx AS (SELECT *, lead(c) OVER (PARTITION BY t ORDER BY ord) AS nx FROM cols), sd AS (SELECT *, CASE WHEN regexp_matches(nx, '^[a-z]+_[0-9]+(_[0-9]+)*$') THEN regexp_replace(replace(regexp_extract(nx, '^[a-z]+_([0-9]+(_[0-9]+)*)$', 1), '_', '.'), '[.]0$', '') END AS said FROM nx WHERE NOT regexp_matches(c, '^[a-z]+_[0-9]+(_[0-9]+)*$')), ty AS (SELECT lower(p_brand) AS name, min(p_type) AS typed FROM part WHERE p_size > 25 GROUP BY 1) SELECT t AS \"table\", c AS \"column\", ord, coalesce(said, typed, CASE WHEN c = 'row_id' THEN '0.0' END) AS code, CASE WHEN said IS NOT NULL THEN 'reference_encoded' WHEN typed IS NOT NULL THEN 'typed_name' WHEN c = 'row_id' THEN 'fallback' ELSE 'unresolved' END AS derivation FROM sd LEFT JOIN ty ON ty.name = c")
def s20(spark, d):
    """Columns made of the parts: some are called like a brand, some spell a code for the one before them."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "row_id").when(k % 4 == 1, F.lower("p_brand")).when(k % 4 == 2, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit("attr_"), "p_size", F.lit("_"), k % 10))
    p = read(spark, d, "part")
    cols = p.select(F.concat(F.lit("t"), "p_size").alias("table"), name.alias("column"), k.alias("ord"))
    typed = p.where("p_size > 25").select(F.col("p_brand").alias("name"), F.col("p_type").alias("code"))
    return R.curated_reference(cols, typed, "0.0").select("table", "column", "ord", "code", "derivation")


@query("s23_results_sink", f"WITH {NODES}, {CUSTOMERS}, {PAIRS} SELECT id, n.label || ' - ' || pred AS \"text\", '[\"' || replace(pred, '.', '\",\"') || '\"]' AS path FROM pairs JOIN nodes n ON n.code = pred")
def s23(spark, d):
    """Classified rows with the display text and the path as JSON, read back."""
    path = f"{sinks.shared_folder(spark)}/results"
    rows = pairs(spark, d).join(F.broadcast(nodes(spark, d).select(F.col("code").alias("pred"), "label")), "pred")
    sinks.results(rows.select("id", sinks.display_text("label", "pred").alias("text"), F.split("pred", r"\.").alias("path")), path)
    return spark.read.parquet(path)


@query("s27_trend_and_errors", f"WITH {CUSTOMERS}, {PAIRS}, er AS (SELECT id % 3 AS iteration, truth, pred, count(*) AS n FROM pairs WHERE truth <> pred GROUP BY 1, 2, 3) SELECT 'errors' AS sheet, iteration, truth || ' ' || pred AS what, n FROM er UNION ALL SELECT 'trend', iteration, 'errors', CAST(sum(n) AS BIGINT) FROM er GROUP BY 2")
def s27(spark, d):
    """Errors by iteration as tab-separated sheets, their sums as the trend; both read back."""
    folder = sinks.shared_folder(spark)
    wrong = pairs(spark, d).where("truth <> pred").groupBy((F.col("id") % 3).alias("iteration"), "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    sinks.error_sheet(wrong, f"{folder}/errors")
    sheet = spark.read.option("sep", "\t").option("header", True).csv(f"{folder}/errors").select(F.lit("errors").alias("sheet"), F.col("iteration").cast("long").alias("iteration"), F.concat_ws(" ", "truth", "pred").alias("what"), F.col("n").cast("long").alias("n"))
    sinks.trend(sheet.groupBy("iteration").agg(F.sum("n").alias("n")), f"{folder}/trend")
    points = spark.read.schema("iteration long, n long").json(f"{folder}/trend")
    return sheet.union(points.select(F.lit("trend"), "iteration", F.lit("errors"), "n"))


@query("k11_relational_sample")
def k11(spark, d):
    """Orders that cover all brands, with their lines, customers and parts: each table's size, and what refers to nothing."""
    o, li, c, p = (read(spark, d, t) for t in ("orders", "lineitem", "customer", "part"))
    sold = li.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey", "p_brand"), "p_partkey").select(F.col("l_orderkey").cast("string").alias("collection"), F.col("p_brand").alias("genus"))
    chosen = K.cover(sold, "collection", "genus", li.count() // 2).select(F.col("collection").cast("long").alias("key"))
    own_o = o.join(F.broadcast(chosen), o.o_orderkey == F.col("key"), "left_semi")  # one row for each brand at most
    own_l = li.join(F.broadcast(chosen), li.l_orderkey == F.col("key"), "left_semi")
    own_c, own_p = c.join(own_o, c.c_custkey == own_o.o_custkey, "left_semi"), p.join(own_l, p.p_partkey == own_l.l_partkey, "left_semi")
    path = sinks.shared_folder(spark)
    made = sinks.relational_sample({"orders": own_o, "lineitem": own_l, "customer": own_c, "part": own_p}, path)
    back = {t: spark.read.parquet(f"{path}/{t}") for t in ("orders", "lineitem", "customer", "part")}
    lost = lambda child, key, parent, to: back[child].select(F.col(key).alias("k")).join(back[parent].select(F.col(to).alias("k")), "k", "left_anti").agg(F.lit(child).alias("table"), F.count(F.lit(1)).alias("orphans"))
    orphans = lost("lineitem", "l_orderkey", "orders", "o_orderkey").union(lost("orders", "o_custkey", "customer", "c_custkey")).union(lost("part", "p_partkey", "lineitem", "l_partkey"))
    return made.join(orphans, "table", "left").select("table", "n_rows", "renamed", F.coalesce("orphans", F.lit(0)).alias("orphans"))
