import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quirework.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    if name in ORACLE:
        cur = tables.execute(ORACLE[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == names
        want = sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall()), key=str)
        assert got == want


def test_entry_without_the_corpus_operators(tmp_path):
    """__spark_entry__.py alone, with the rest of the library, still has its queries."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (tmp_path / "quirework").mkdir()
    for p in (ROOT / "quirework").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quirework" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
