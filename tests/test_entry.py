import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm(tmp_path):
    for path in (REPO / "tilewright").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", path.read_text(), re.M), path
    shutil.copytree(REPO / "tilewright", tmp_path / "tilewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert "p1_found" in said and "p8_ids" not in said


@pytest.mark.skipif(not SMALL.exists(), reason="no test data")
def test_flagship_and_some_against_sql(spark):
    import duckdb

    assert entry.entry(spark).count() > 0
    db = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    for name in ("p2_found", "p5_found", "p7_found", "way_quadtree", "filter_tags", "overlay_apply"):
        rows = entry.queries()[name](spark, str(SMALL))
        columns = sorted(rows.columns)
        got = sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect())
        want = sorted(map(repr, db.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()))
        assert got == want, name
