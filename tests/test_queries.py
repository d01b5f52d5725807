"""Every registered query runs on the smallest driver tables; those with a SQL twin must equal it."""

import decimal
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.fixture(scope="module")
def results(spark, request):
    """Selected queries, a few at a time: planning is single-threaded and the tables are tiny."""
    chosen = {item.callspec.params["name"] for item in request.session.items
              if item.module is request.module and hasattr(item, "callspec")}

    def run(name):
        df = QUERIES[name](spark, SF_DIR)
        return df.columns, df.collect()
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in sorted(chosen)}


def plain(value):
    return float(value) if isinstance(value, decimal.Decimal) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(results, duck, name):
    ours, rows = results[name].result()
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(ours) == sorted(columns)
    assert table(ours, rows) == table(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(results, name):
    assert len(results[name].result()[1]) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 15
    assert set(ORACLES) <= set(QUERIES)
