"""Every registered query against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest
from oracle import compare, connect

from tallyloom.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert compare(spark, con, sf, QUERIES[name], ORACLE.get(name)) is None


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["source", "shard", "n_rows", "tokens"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_language_model_operators(tmp_path):
    """A copy of the repository without ``tallyloom/llm`` registers everything else."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "tests")
    shutil.copytree(here, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, check=True)
    names = done.stdout.split()
    assert len(names) > 150 and not [n for n in names if n.startswith("op") and n[2:3].isdigit() or n == "pipeline"]
