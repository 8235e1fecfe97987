"""The arms of the ablation split and hash their texts once."""

from colsense.plans import learning


def test_texts_are_hashed_once(spark, monkeypatch):
    written, write_down = [], learning.write_down
    monkeypatch.setattr(learning, "write_down", lambda df: (written.append(df.columns), write_down(df))[1])
    assert [r["arm"] for r in learning.l11(spark, "/root/testdata/sf0.001").collect()] == ["full", "no_endings"]
    assert written == [["id", "label", "tf"]] * 2
