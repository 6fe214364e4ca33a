import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paneldrift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def spread(spark):
    """Keep every shuffle partition, so that small tables really span several of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture
def panel(spark):
    """Build a panel of one scenario from (plot, species, year, value) rows."""

    def build(rows, scenario="s"):
        data = [(p, scenario, s, y, None if v is None else float(v)) for p, s, y, v in rows]
        return spark.createDataFrame(data, "plot string, scenario string, species string, year int, value double")

    return build


def as_dicts(df, *keys):
    """Rows as dictionaries, by key column(s)."""
    found = {}
    for row in df.collect():
        d = row.asDict()
        found[tuple(d[k] for k in keys) if len(keys) > 1 else d[keys[0]]] = d
    return found
