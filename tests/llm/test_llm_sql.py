"""The training-data queries against their SQL, on whole test tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.append(str(Path(__file__).parents[1]))

from compare import connect, spark_rows, sql_rows  # noqa: E402

from shelfmark.llm.queries import oracles, registry  # noqa: E402


@pytest.mark.parametrize("root", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_sql(spark, name, root):
    names, rows = spark_rows(registry()[name](spark, root))
    sql_names, expected = sql_rows(connect(root), oracles()[name])
    assert names == sql_names
    assert rows == expected
