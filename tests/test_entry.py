"""The registry: queries against their SQL, and life without the corpus package."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from stratafold import queries as engine

SMALL = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


def compare(spark, name: str, call, sql: str) -> None:
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{file}')")
    got, want = call(spark, SMALL).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(frame):
        cell = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else v
        plain = frame.astype(object).where(frame.notna(), None)
        return sorted((tuple(cell(v) for v in r) for r in plain[sorted(frame.columns)].itertuples(index=False)), key=repr)

    mine, theirs = rows(got), rows(want)
    assert len(mine) == len(theirs)
    for x, y in zip(mine, theirs, strict=True):
        assert x == pytest.approx(y, abs=2e-5, nan_ok=True) if all(isinstance(v, int | float) for v in (*x, *y)) else all(a == b or abs(float(a) - float(b)) < 2e-5 for a, b in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_matches_its_sql(spark, name):
    compare(spark, name, engine.QUERIES[name], engine.SQL[name])


def test_every_engine_query_has_sql():
    assert set(engine.QUERIES) == set(engine.SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_package(tmp_path):
    """A copy of the repository without the folders that may be deleted still imports."""
    copy = tmp_path / "copy"
    copy.mkdir()
    for path in REPO.iterdir():
        if path.name in ("stratafold", "corpus_pipeline.py") or path.name.startswith("."):
            continue
        (copy / path.name).symlink_to(path)
    (copy / "stratafold").mkdir()
    for path in (REPO / "stratafold").iterdir():
        if path.name != "llm":
            (copy / "stratafold" / path.name).symlink_to(path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') or n == 'pipeline']; assert len(q) > 50; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
