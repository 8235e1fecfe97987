"""CSV folders and deep hierarchies."""

import csv

from colsense.operators import taxonomy as T
from colsense.sources import readers as R


def test_csv_cells_of_any_shape(spark, tmp_path):
    """100 columns, line breaks, commas and quotes in cells, files of several widths, missing and surplus cells, blank names."""
    wide = [[f"h{k}" if k != 7 else "a, b" for k in range(100)], [f"x{k}\ny,\"{k}\"" for k in range(100)], ["", *[str(k) for k in range(1, 100)]]]
    for name, rows in {
        "wide": wide,
        "slim": [["id", "note"], ["1", "two\nlines, and \"quotes\""], ["2"], ["3", "x", "surplus"], *[[str(k), "n"] for k in range(4, 60)]],
        "gap": [["a", "", "c"], ["1", "2", "3"]],
        "empty": [["only", "names"]],
        "annotations": [["a"], ["left out"]],
    }.items():
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows(rows)
    got = {(r["table"], r["row_ix"], r["ord"]): (r["column"], r["value"]) for r in R.csv_folder(spark, str(tmp_path), sample=5).collect()}
    want = {("wide", i, k): (wide[0][k], x or None) for i, r in enumerate(wide[1:], 1) for k, x in enumerate(r)}
    want |= {("slim", 1, 0): ("id", "1"), ("slim", 1, 1): ("note", 'two\nlines, and "quotes"'), ("slim", 2, 0): ("id", "2"), ("slim", 2, 1): ("note", None), ("slim", 3, 0): ("id", "3"), ("slim", 3, 1): ("note", "x")}
    want |= {("slim", k, j): (("id", str(k)), ("note", "n"))[j] for k in range(4, 21) for j in (0, 1)}
    want |= {("gap", 1, 0): ("a", "1"), ("gap", 1, 1): ("_c1", "2"), ("gap", 1, 2): ("c", "3")}
    assert got == want


def test_csv_width_is_the_headers(spark, tmp_path):
    """A text of 30,000 commas makes no columns; a header over several lines, with few commas in each, keeps all of its names."""
    long = ",".join("x" * 30_001)
    for name, rows in {"text": [["id", "note"], ["1", long], ["2", "short"]], "head": [["a", "two\nlines", *[f"c{k}\n" for k in range(150)], "z"], [str(k) for k in range(153)]]}.items():
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows(rows)
    assert R.header_width(spark, f"{tmp_path}/*.csv") == (153, 30_002)
    got = {(r["table"], r["row_ix"], r["ord"]): (r["column"], r["value"]) for r in R.csv_folder(spark, str(tmp_path)).collect()}
    want = {("text", 1, 0): ("id", "1"), ("text", 1, 1): ("note", long), ("text", 2, 0): ("id", "2"), ("text", 2, 1): ("note", "short")}
    want |= {("head", 1, k): (n, str(k)) for k, n in enumerate(["a", "two\nlines", *[f"c{k}\n" for k in range(150)], "z"])}
    assert got == want


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else None) for k in range(100)], "code string, parent_code string")
    got = {(r["code"], r["ancestor"]): r["distance"] for r in T.closure(chain).collect()}
    assert got == {(f"n{a}", f"n{b}"): a - b for a in range(100) for b in range(a + 1)}


def test_closure_with_cycles_and_several_parents(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("d", "c"), ("e", "e"), ("f", "nowhere"), ("g", None)]
    parents = {}
    for x, p in rows:
        parents.setdefault(x, set()).add(p)
    want = {}
    for x in parents:
        seen, level, dist = {x}, {x}, 0
        while level:
            want |= {(x, y): dist for y in level}
            level = {p for y in level for p in parents[y] if p in parents} - seen
            seen |= level
            dist += 1
    nodes = spark.createDataFrame(rows, "code string, parent_code string")
    got = {(r["code"], r["ancestor"]): r["distance"] for r in T.closure(nodes).collect()}
    assert got == want
    assert T.closure(nodes.where("false")).count() == 0
