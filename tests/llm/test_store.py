"""Steps that the operators for training data share."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from idlespan.llm import store


@pytest.mark.parametrize("slots", [store.SLOTS, 7])
@pytest.mark.parametrize("nulls", [False, True])
def test_without_ids(spark, frame, monkeypatch, slots, nulls):
    """Right whether an id's slot is its own or shared; null ids go only when asked for."""
    monkeypatch.setattr(store, "SLOTS", slots)
    docs = frame([*[(i, f"t{i}") for i in range(-300, 300)], (None, "n"), (5, "again")], "doc_id long, gone string")
    gone = frame([*[(i,) for i in range(-300, 300, 9)], (None,), (5,), (999,)], "id long")
    out = store.without_ids(docs, "doc_id", gone, nulls)
    want = [(i, f"t{i}") for i in range(-300, 300) if (i + 300) % 9 and i != 5] + ([] if nulls else [(None, "n")])
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in frame(want, "doc_id long, gone string").collect())
    assert store.without_ids(docs, "doc_id", gone.limit(0), nulls).count() == 602


def test_rows_that_stay_are_not_shuffled(spark, frame):
    """Of the rows only those that may go are dealt out by id."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = store.without_ids(docs, "doc_id", spark.range(0, 4000, 100).toDF("id"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "rightHint=(strategy=broadcast)" in plan
    assert rows_of(out, "doc_id") == [(i,) for i in range(4000) if i % 100]
