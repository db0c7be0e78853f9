"""Every registered query against its SQL on the smallest tables."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NESTED = ("array", "map", "struct", "binary")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert not [f for f, kind in df.dtypes if kind.startswith(NESTED)]
    if name not in SQL:
        assert got
        return
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["plot_id", "species_ids"]


def test_library_has_no_gathering_shortcuts():
    """No local checkpoints, cross joins or forced broadcasts of a table with unknown size."""
    library = Path(entry.__file__).parent / "tileflow"
    for path in library.rglob("*.py"):
        text = path.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|cross_join|\.rdd\b", text), path


@pytest.mark.parametrize("without", [["tileflow/llm", "tests/llm"], ["tileflow/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_optional_part(tmp_path, without):
    """The other queries are there when the optional part is not, or cannot be imported."""
    home = Path(entry.__file__).parent
    skipped = shutil.ignore_patterns(".git", "__pycache__", *[Path(w).name for w in without])
    shutil.copytree(home, tmp_path / "copy", ignore=skipped)
    code = "import __spark_entry__ as e; print(*e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    assert set(out.stdout.split()) == {n for n in QUERIES if not re.match(r"op\d+_|pipeline$", n)}
