"""Every registered query of the log engine against its SQL, at the smallest scale."""

import duckdb
import pytest

from flowlake.plans.all_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    r = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    rows = r.fetchall()
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in rows)


def test_entry_without_training_data_operators(spark):
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline': raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'day_report' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); print('fine')" % root
    )
    assert "fine" in subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=100).stdout
