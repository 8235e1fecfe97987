"""The calibrated classifier writes small rows down, and puts them together block by block."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from colsense.operators import ml
from colsense.sources import sinks


def test_written_rows_are_small(spark, monkeypatch):
    """A writer of files holds a hundred rows before it looks at their size: a row must not be a block of texts."""
    rng, longest, plain = random.Random(4), [], sinks.write_down

    def watched(df, **options):
        out = plain(df, **options)
        longest.extend(out.agg(F.max(F.length(c))).first()[0] for c, kind in out.dtypes if kind == "binary")
        return out

    monkeypatch.setattr(sinks, "write_down", watched)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    rows = [(k, "xy"[k % 2], " ".join(rng.sample(pool, 40))) for k in range(600)]
    ml.calibrated_svm(spark.createDataFrame(rows, "id long, label string, text string").coalesce(1), "id", features=20_000, iterations=2)
    assert longest and max(longest) < 10_000


def test_blocks(monkeypatch):
    """Cells are shared by the blocks, and clear again for the next one."""
    monkeypatch.setattr(ml, "BLOCK_ROWS", 2)
    found = [[0, 3, 6], [3], [], [1, 6], [5]]
    cells = [np.array(f, np.int32).tobytes() for f in found]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int32()), pa.array([1.0] * 5), pa.array([0] * 5, pa.int32()), pa.array(cells, pa.binary())], names=["y", "weight", "fold", "found"])
    got = [[used[row > 0].tolist() for row in x] for _, _, _, used, x in ml.each_block([batch, batch.slice(2)], 7)]
    assert [row for block in got for row in block] == found + found[2:]
    assert [len(block) for block in got] == [2, 2, 1, 2, 1]


def test_summed(spark, monkeypatch):
    """Pieces of all tasks come together: how often each gram is used, over two columns."""
    monkeypatch.setattr(ml, "PIECE", 3)
    rng = random.Random(5)
    found = [sorted(rng.sample(range(9), rng.randrange(5))) for _ in range(50)]
    cells = [(k % 2, 1.0, 0, bytearray(np.array(f, np.int32).tobytes())) for k, f in enumerate(found)]
    rows = spark.createDataFrame(cells, "y int, weight double, fold int, found binary").repartition(5)

    def count(total, y, weight, fold, used, x):
        total[used] += x.T @ np.column_stack((y, np.ones(len(y))))

    want = [[sum(k % 2 for k, f in enumerate(found) if g in f), sum(g in f for f in found)] for g in range(9)]
    assert ml.summed(rows, 9, (9, 2), count).tolist() == want
