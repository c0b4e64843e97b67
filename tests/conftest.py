import os
import shutil
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexigraph.session import session

    shared = tmp_path_factory.mktemp("shared")
    os.environ.setdefault("PYTHONHASHSEED", "0")
    s = session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(shared / "warehouse")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(shared, ignore_errors=True)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with the small tables as views."""
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    """Rows of any source as sorted tuples, floats rounded."""
    fix = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=repr)


def same_as_sql(df, con, sql):
    names = sorted(df.columns)
    assert sorted(d[0] for d in con.execute(sql).description) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    assert plain(df.select(*(f"`{n}`" for n in names)).collect()) == plain(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall())
