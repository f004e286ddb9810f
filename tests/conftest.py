import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from starmill.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    return local_session(8, memory="4g", **{"spark.checkpoint.dir": folder})


@pytest.fixture
def lake(spark, tmp_path):
    from starmill.sources.lake import Lake

    return Lake(spark, str(tmp_path / "lake"))


def rows(df, *columns):
    """Rows as plain tuples, in a stable order."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
