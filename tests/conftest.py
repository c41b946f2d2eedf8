import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = os.environ.get("LODEWEAVE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from lodeweave.session import local_session

    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f if f.is_file() else f'{f}/*.parquet'}')")
    return con
