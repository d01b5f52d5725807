"""Row-keeping stages return rows as they came, whatever their columns are called."""

import pytest

from idlespan.llm import exact_dedup, kneser_ney, raking, simhash

NAMES = ["gone", "_gone", "row_id", "_row_id", "row_digest", "_row_digest", "keep_id", "_keep_id", "keep_digest", "copies", "_copies", "node",
         "label", "id", "digest", "norm", "n", "probability", "selected", "accepted", "tokens", "topic", "chunk", "bits"]
TEXTS = ["the same words stand here and here", "The same words stand here and here", None, "", "something else is written in this one",
         "one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten eleven twelve"]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", *[f"{n}-{i}" for n in NAMES]) for i, t in enumerate(TEXTS * 3)]
    rows += [rows[0], (None, "no id", "en", None, *NAMES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)).cache()


STAGES = {
    "quality": lambda spark, docs: kneser_ney.keep_accepted(docs, spark.createDataFrame([(0, 1, 0), (4, 1, 0)], LABELS)),
    "exact_dedup": lambda spark, docs: exact_dedup.keep_one(docs, salts=2),
    "near_dedup": lambda spark, docs: simhash.keep_one_near(docs),
    "mixing": lambda spark, docs: raking.sample(docs, keep=0.5)}


@pytest.mark.parametrize("name", STAGES)
def test_rows_come_back_as_they_were(spark, docs, name):
    kept = STAGES[name](spark, docs)
    assert kept.columns == docs.columns
    left, all_rows = [tuple(r) for r in kept.collect()], {tuple(r) for r in docs.collect()}
    assert set(left) <= all_rows and 0 < len(left) <= docs.count()
