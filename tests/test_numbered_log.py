from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.collections import log_entries
from shelfmark.sources.folders import listed
from shelfmark.sources.readers import cuts_query, range_predicates
from shelfmark.streaming import numbered
from shelfmark.streaming.numbered import numbered_log, numbered_log_stream, write_batch


def asked(spark, n, name="q"):
    return spark.createDataFrame([(f"{name}{k}", k % 3 or None) for k in range(n)], "query string, user_id long").repartition(3)


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "query_text").collect())


def test_batches_follow_each_other(spark, tmp_path):
    path = f"{tmp_path}/the log"
    assert numbered_log(spark, path).count() == 0
    for number, n in enumerate([5, 0, 7]):
        write_batch(log_entries(asked(spark, n, f"b{number}-")), number, path, first_id=100)
    found = rows(numbered_log(spark, path))
    assert [r[0] for r in found] == list(range(100, 112))
    assert {r[1].split("-")[0] for r in found[:5]} == {"b0"} and {r[1].split("-")[0] for r in found[5:]} == {"b2"}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    write_batch(log_entries(asked(spark, 4, "a")), 0, path)
    write_batch(log_entries(asked(spark, 6, "b")), 1, path)
    before = rows(numbered_log(spark, path))
    # The same batch again, as after a lost driver; even if its rows came in another order.
    write_batch(log_entries(asked(spark, 6, "b").orderBy(F.desc("query"))), 1, path)
    assert rows(numbered_log(spark, path)) == before
    write_batch(log_entries(asked(spark, 2, "c")), 2, path)
    assert [r[0] for r in rows(numbered_log(spark, path))] == list(range(1, 13))


def test_a_batch_that_failed_leaves_no_gap(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    write_batch(log_entries(asked(spark, 3)), 0, path)
    inner = numbered.put_in_place

    def stop(spark, prepared, target):
        if "/rows/batch=" in target:
            raise RuntimeError("lost")
        inner(spark, prepared, target)

    monkeypatch.setattr(numbered, "put_in_place", stop)
    with pytest.raises(RuntimeError):
        write_batch(log_entries(asked(spark, 3)), 1, path)
    monkeypatch.undo()
    assert numbered_log(spark, path).count() == 3
    write_batch(log_entries(asked(spark, 3)), 1, path)
    assert [r[0] for r in rows(numbered_log(spark, path))] == list(range(1, 7))


def test_stream(spark, tmp_path):
    source = str(tmp_path / "requests")
    for n in (4, 3):
        asked(spark, n).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # started again, there is nothing new
        stream = spark.readStream.schema("query string, user_id bigint").option("maxFilesPerTrigger", 1).parquet(source)
        numbered_log_stream(stream, str(tmp_path / "log"), str(tmp_path / "state"), first_id=11).awaitTermination(90)
        assert [r[0] for r in rows(numbered_log(spark, str(tmp_path / "log")))] == list(range(11, 18))
    assert len(listed(spark, f"{tmp_path}/log/rows")) == 2


@pytest.mark.parametrize("values", [list(range(100)), [k**3 for k in range(100)], [5] * 60 + [10**9], [1], [None, 3, None]])
def test_database_parts_are_even(values):
    base = sqlite3.connect(":memory:")
    base.execute("CREATE TABLE t (k INTEGER)")
    base.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    cuts = sorted(r[0] for r in base.execute(cuts_query("t", "k", 4)))
    assert len(cuts) <= 4
    parts = [base.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in range_predicates("k", cuts[:-1])]
    assert sum(parts) == len(values)
    if len(set(values)) == 100:
        assert parts == [25] * 4
