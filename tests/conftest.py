import pytest

from catalog.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, 4, **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over literal inputs: one(column, schema, rows) -> values."""

    def run(column, schema, values):
        frame = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
        return [r[0] for r in frame.select(column).collect()]

    return run
