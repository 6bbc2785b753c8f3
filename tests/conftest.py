from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stagetrail.session import local_session  # noqa: E402

TABLES = ("orders", "lineitem", "events")
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="*", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the supplied tables of one scale."""
    import duckdb

    def connect(sf_dir: str):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return con

    return connect
