"""The pipeline on the smallest driver tables, stage by stage against brute force, and every registered query of the package."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from idlespan.llm import queries as Q
from tests.llm.test_simhash import groups, shingles

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def test_stages_keep_rows_as_they_came(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        left = {tuple(r) for r in after.collect()}
        assert left <= {tuple(r) for r in before.collect()} and len(left) == after.count() > 0


def test_quality_goes_by_the_threshold(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("toxic = 0")
    share = {q: (after.join(labels.filter(f"quality = {q}"), "doc_id").count(), before.join(labels.filter(f"quality = {q}"), "doc_id").count()) for q in (0, 1)}
    assert share[1][0] >= 0.97 * share[1][1]


def test_exact_copies_are_gone(stages):
    before, after = ([(r.doc_id, r.text.translate({c: c + 32 for c in range(65, 91)})) for r in df.collect()] for df in stages["exact_dedup"])
    largest = {}
    for d, t in before:
        largest[t] = max(d, largest.get(t, -1))
    assert sorted(after) == sorted((d, t) for t, d in largest.items())


def test_near_copies_are_gone(stages):
    before, after = (df.collect() for df in stages["near_dedup"])
    sets = [set(shingles(r.text, 5)) for r in before]
    roots = groups(len(before), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    least = {}
    for r, g in zip(before, roots):
        least[g] = min(r.doc_id, least.get(g, 10**9))
    assert sorted(r.doc_id for r in after) == sorted(least.values())


def test_packing_has_every_document(stages):
    before, after = stages["packing"]
    assert after.select("doc_id").distinct().count() == before.count()
    assert after.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0


def test_eleven_queries_are_registered():
    names = [*Q.QUERIES, "pipeline"]
    assert set(names) <= set(entry.queries())
    assert {n.split("_")[0] for n in Q.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", ["op1_ipf_mixing", "op5_maxscore_top_k", "op10_exact_dedup"])
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF_DIR)
    result = con.execute(Q.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, result.fetchall()))
