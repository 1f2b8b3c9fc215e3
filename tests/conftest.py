import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillgraph.sources.session import local_session

    session = local_session(cores=4, shuffle=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def compare(spark):
    """Check a query against its SQL in DuckDB: same columns, same rows, in any order."""
    import duckdb

    db = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")

    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat()
        if type(v).__name__ == "Decimal":
            return round(float(v), 6)
        return v

    def check(query, sql):
        frame = query(spark, DATA)
        got = db.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(frame.columns)
        want = [tuple(plain(v) for v in r) for r in got.fetchall()]
        have = [tuple(plain(r[n]) for n in names) for r in frame.collect()]
        order = lambda r: [(v is None, str(type(v)), str(v)) for v in r]
        assert sorted(have, key=order) == sorted(want, key=order)

    return check
