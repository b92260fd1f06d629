import pytest

pytest.importorskip("quadweave.llm")
from quadweave.llm import lines


def test_few_texts_move_that_are_not_wanted(spark):
    """Every wanted row stays, one with a null id too; of the others hardly any."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(5000)] + [(None, "none")], "_key long, _text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 5000, 50)] + [(None,)], "_id long")
    got = lines._among(rows, "_key", ids)
    assert got.columns == rows.columns
    found = [r["_key"] for r in got.collect()]
    assert {*range(0, 5000, 50), None} <= set(found) and len(set(found)) == len(found) < 110
