"""Saves and deletes on stored tables that leave most files alone.

A save rewrites only the files whose key ranges hold a saved key. A delete, with
its cascades, writes one bitmap per file that loses rows and no data at all;
references that become null are rows deleted in one file and added in another.
Both return a new state of the store; it is put in place in one step.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions.sizing import is_small, sent_if_small, settled
from shelfmark.functions.times import moment
from shelfmark.operators.changes import latest, upsert
from shelfmark.operators.numbering import assign_ids
from shelfmark.operators.quality import blocked_deletes
from shelfmark.schemas import ForeignKey
from shelfmark.sources.folders import kept
from shelfmark.sources.store import Version, within


def save_rows(
    version: Version, table: str, changes: DataFrame, order: Sequence[str] = ("saved_at",), now: datetime | None = None
) -> Version:
    """:func:`~shelfmark.operators.changes.upsert` on a stored table with one row per key.

    Each file that may hold a saved key is written anew with its own rows and
    the saved ones of its range; no other file is read or written. Saved rows
    without a key get fresh ones, above every key a file has had, and begin
    where the last range ends. Where there are too many saved keys to send to
    the list of files, the whole table is written anew.
    """
    head = version.heads[table]
    key, columns = head.key, head.schema.fieldNames()
    saved = settled(latest(changes, key, order).select(*columns))
    given, fresh = saved.where(F.col(key).isNotNull()), saved.where(F.col(key).isNull())
    used = version.files(table).select(F.col("high").cast(head.key_type).alias(key))
    saved = settled(given.unionByName(assign_ids(fresh, used.unionByName(given.select(key)), key).select(*columns)))
    keys = saved.select(key)
    if not is_small(keys):
        whole = upsert(version.read(table), saved.withColumn("_order", F.lit(0)), key, ["_order"], now)
        return version.with_files(table, version.store.write(table, whole.select(*columns), head))
    ranges = version.ranges(table)
    # Both sides are small: the saved keys were counted, and there is one range per file.
    placed = saved.join(F.broadcast(ranges), within(F.col(key)), "left").drop("_from", "_to").withColumnRenamed("file", "_file")
    placed = settled(placed)
    files = version.files(table)
    named = F.broadcast(placed.select(F.col("_file").alias("file")).distinct())
    touched = settled(version.touched(table, keys).unionByName(files.join(named, "file", "left_semi")).distinct())
    held = version.rows(table, touched, marked=True)
    gone = F.broadcast(keys)
    others = held.join(gone, key, "left_anti").select(*columns, "_file")
    if "created_at" in columns:
        before = held.select(key, F.col("created_at").alias("_before")).join(gone, key, "left_semi")
        created = F.coalesce(F.col("created_at"), F.col("_before"), moment(now))
        placed = placed.join(before, key, "left").withColumn("created_at", created)
    if "updated_at" in columns:
        placed = placed.withColumn("updated_at", moment(now))
    rows = others.unionByName(placed.select(*columns, "_file")).withColumn("_part", F.xxhash64("_file"))
    written = version.store.write(table, rows, head, labels="_part")
    return version.with_files(table, files.join(touched.select("file"), "file", "left_anti").unionByName(written))


def delete_rows(
    version: Version, table: str, keys: DataFrame, foreign_keys: Sequence[ForeignKey] = schemas.APPLICATION_KEYS
) -> Version:
    """:func:`~shelfmark.operators.changes.delete` on a stored table and those that refer to it.

    A table whose key is the reference reads only the files that may hold a
    deleted key. All tables change in the same state, so a cascade is seen as a
    whole or not at all.
    """
    gone = keys.select("id").distinct()
    if any(fk.parent == table and fk.on_delete == "restrict" for fk in foreign_keys):
        refused = blocked_deletes(version.catalog(), table, gone, foreign_keys).select("id")
        gone = gone.join(refused, "id", "left_anti")
    return _remove(version, table, settled(gone), foreign_keys)


def _hit(version: Version, table: str, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``column`` is in ``keys`` (named like it), with their places."""
    files = version.touched(table, keys) if version.heads[table].key == column else version.files(table)
    return kept(version.rows(table, files, marked=True).join(sent_if_small(keys), column, "left_semi"), table)


def _remove(version: Version, table: str, gone: DataFrame, foreign_keys: Sequence[ForeignKey]) -> Version:
    state = version.without(table, _hit(version, table, "id", gone))
    for fk in foreign_keys:
        if fk.parent != table:
            continue
        hit = _hit(state, fk.child, fk.column, gone.select(F.col("id").alias(fk.column)))
        if hit.isEmpty():
            continue
        if fk.on_delete == "set_null":
            cleared = hit.drop("_file", "_row").withColumn(fk.column, F.lit(None).cast(hit.schema[fk.column].dataType))
            state = state.without(fk.child, hit).with_rows(fk.child, cleared)
        elif fk.on_delete == "cascade":
            if "id" in state.heads[fk.child].schema.fieldNames():
                state = _remove(state, fk.child, settled(hit.select("id").distinct()), foreign_keys)
            else:
                state = state.without(fk.child, hit)
    return state
