"""Every registered query against its SQL, on whole test tables."""

from __future__ import annotations

import importlib.util
import re
import subprocess
import sys
from pathlib import Path

import pytest

from compare import connect, spark_rows, sql_rows

ROOT = "/root/testdata/sf0.001"

_spec = importlib.util.spec_from_file_location(
    "spark_entry", Path(__file__).parent.parent / "__spark_entry__.py"
)
entry_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry_module)


@pytest.fixture(scope="module")
def connection():
    return connect(ROOT)


def is_own(name: str) -> bool:
    """Queries over the catalog; the others have their tests beside them."""
    return name != "pipeline" and not re.match(r"op\d+_", name)


def test_every_query_has_sql():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert {n for n in entry_module.queries() if is_own(n)} == {n for n in entry_module.oracle_sql() if is_own(n)}


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    names, rows = spark_rows(entry_module.queries()[name](spark, ROOT))
    sql_names, expected = sql_rows(connection, entry_module.oracle_sql()[name])
    assert names == sql_names
    assert rows == expected


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows


def test_queries_without_the_training_data_operators():
    """A library they need is missing: the others are there all the same."""
    code = (
        "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; "
        "print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n[:2] == 'op' and n[2].isdigit()])"
    )
    found = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True)
    own = sum(map(is_own, entry_module.queries()))
    assert found.stdout.split("\n")[0] == f"{own} {own} []"
