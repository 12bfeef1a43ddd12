from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 65


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_entry(spark):
    import __spark_entry__ as e

    got = e.entry(spark).collect()
    assert len(got) == 1 and got[0]["n_intervals"] > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["citations_by_venue", "screen_report", "relational_journals", "holdout_split", "identifier_components"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    df = e.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(e.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({e.oracle_sql()[name]})").fetchall()))


def test_the_rest_stands_alone(tmp_path):
    """Without the llm folders and the corpus pipeline, everything else imports, and no module of it names them."""
    import shutil

    shutil.copytree(ROOT / "folioscope", tmp_path / "folioscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import pkgutil, importlib, folioscope, __spark_entry__ as e\nfor m in pkgutil.walk_packages(folioscope.__path__, 'folioscope.'): importlib.import_module(m.name)\nassert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    for p in (tmp_path / "folioscope").rglob("*.py"):
        assert "folioscope.llm" not in p.read_text()
