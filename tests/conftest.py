import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from idlespan import scale  # noqa: E402
from idlespan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("idlespan-tests", "8", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.codegen.wholeStage", "false")       # tiny inputs: compiling costs more than running
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture
def small_chunks(monkeypatch):
    """Trailing windows cut every 64 rows, as they would be every 100 000 on a heavy path."""
    monkeypatch.setattr(scale.trailing, "__defaults__", (None, 64))


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make


def rows_of(df, *columns):
    """Rows as sorted tuples."""
    return sorted(tuple(r) for r in df.select(*columns).collect())
