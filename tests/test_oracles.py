"""Every query that has SQL gives the SQL's rows; the entry module stands alone."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quern.plans import catalogue
from tests import oracle

needs_data = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")
REPO = Path(__file__).resolve().parent.parent


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert oracle.same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, oracle.FOLDER).count() > 0


def test_every_oracle_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_module_without_the_training_data_operators(tmp_path):
    shutil.copytree(REPO / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_training_data_operators():
    for p in (REPO / "quern").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "quern.llm" not in p.read_text(), p
