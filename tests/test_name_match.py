"""Names are matched once each, however many entities have them."""

from colsense.operators import match


def test_a_name_is_matched_once(spark):
    nodes = spark.createDataFrame([("1", "red", "RED", ["crimson"]), ("2", "red", "R2", ["x"]), ("3", "deep red sea", "DRS", ["y"])], "code string, label string, mnemonic string, aliases array<string>")
    names = spark.createDataFrame([(k, ["RED", "Crimson", "the_deep_red_sea_x", "none", None][k % 5]) for k in range(50)] + [(1, "red")], "entity long, name string")
    out = match.name_match(names, nodes)
    want = {k: [("1", 0.7), ("1", 0.5), ("3", 0.3)][k % 5] for k in range(50) if k % 5 < 3} | {1: ("1", 0.7)}
    assert sorted((r["entity"], r["code"], r["mass"]) for r in out.collect()) == sorted((k, *v) for k, v in want.items())
    assert "windowspecdefinition(name#" in out._jdf.queryExecution().optimizedPlan().toString()
