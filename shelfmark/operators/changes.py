"""Changes to whole tables: save, delete with its consequences, defaults."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.catalog import Catalog
from shelfmark.functions.sizing import sent_if_small, settled
from shelfmark.functions.times import expiry, moment
from shelfmark.operators.numbering import assign_ids
from shelfmark.operators.quality import blocked_deletes
from shelfmark.schemas import ForeignKey


def latest(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row per ``key`` by ``order``; equal order is settled by the row itself.

    Rows without a key are changes of their own and all stay. The window keeps
    one row per key in each task before it shuffles, so a key saved over and
    over costs one row per task.
    """
    ranked = [*order, *(c for c in changes.columns if c not in (key, *order))]
    last = W.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in ranked))
    keyed = changes.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(last))
    kept = keyed.where("_rank = 1").select(*changes.columns)
    return kept.unionByName(changes.where(F.col(key).isNull()))


def with_defaults(df: DataFrame, now: datetime | None = None) -> DataFrame:
    """Missing creation and update times become the current moment."""
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), moment(now))
            for name in ("created_at", "updated_at")
            if name in df.columns
        }
    )


def upsert(
    base: DataFrame,
    changes: DataFrame,
    key: str = "id",
    order: Sequence[str] = ("saved_at",),
    now: datetime | None = None,
) -> DataFrame:
    """``base`` after saving ``changes``: new keys are inserted, known ones replaced.

    ``changes`` has the columns of ``base`` and those of ``order``; its last row
    per key wins. Rows without a key are all new and get fresh ones, above those
    in use or given. Every saved row is stamped with ``updated_at = now``; one
    without ``created_at`` keeps the old one, or gets ``now`` if it is new.
    The saved rows are computed once. Rows not saved pass through one anti-join,
    which shuffles ``base`` only if the saved keys are too many to send to it.
    """
    saved = settled(latest(changes, key, order).select(*base.columns))
    given = saved.where(F.col(key).isNotNull())
    fresh = saved.where(F.col(key).isNull())
    in_use = base.select(key).unionByName(given.select(key))
    saved = given.unionByName(assign_ids(fresh, in_use, key).select(*base.columns))
    keys = sent_if_small(saved.select(key))
    untouched = base.join(keys, key, "left_anti").select(*base.columns)
    if "created_at" in base.columns:
        before = base.select(key, F.col("created_at").alias("_before")).join(keys, key, "left_semi")
        created = F.coalesce(F.col("created_at"), F.col("_before"), moment(now))
        saved = saved.join(before, key, "left").withColumn("created_at", created)
    if "updated_at" in base.columns:
        saved = saved.withColumn("updated_at", moment(now))
    return untouched.unionByName(saved.select(*base.columns))


def delete(
    catalog: Catalog,
    table: str,
    keys: DataFrame,
    foreign_keys: Sequence[ForeignKey] = schemas.APPLICATION_KEYS,
) -> Catalog:
    """The catalog after deleting the rows of ``table`` whose ``id`` is in ``keys``.

    Rows that a restricting reference still uses are not deleted; see
    :func:`~shelfmark.operators.quality.blocked_deletes` for which and why.
    Cascades are followed to the end, and references that allow it become null.
    Each consequence is one anti-join (or left join) against the deleted keys,
    which are computed once per table. A reference from a table the catalog
    lacks is an error: give the rules that hold for the tables there are.
    """
    gone = keys.select("id").distinct()
    if any(fk.parent == table and fk.on_delete == "restrict" for fk in foreign_keys):
        refused = blocked_deletes(catalog, table, gone, foreign_keys).select("id")
        gone = gone.join(refused, "id", "left_anti")
    return _remove(catalog, table, settled(gone), foreign_keys)


def _remove(catalog: Catalog, table: str, gone: DataFrame, foreign_keys: Sequence[ForeignKey]) -> Catalog:
    gone = sent_if_small(gone)
    rows = catalog.table(table)
    result = catalog.replace(**{table: rows.join(gone, "id", "left_anti").select(*rows.columns)})
    for fk in foreign_keys:
        if fk.parent != table:
            continue
        child = result.table(fk.child)
        hit = gone.select(F.col("id").alias(fk.column))
        if fk.on_delete == "set_null":
            marked = child.join(hit.withColumn("_gone", F.lit(True)), fk.column, "left")
            kept = F.when(F.col("_gone").isNull(), F.col(fk.column))
            cleared = marked.withColumn(fk.column, kept).select(*child.columns)
            result = result.replace(**{fk.child: cleared})
        elif fk.on_delete == "cascade":
            if "id" in child.columns:
                lost = child.join(hit, fk.column, "left_semi").select("id").distinct()
                result = _remove(result, fk.child, settled(lost), foreign_keys)
            else:
                kept = child.join(hit, fk.column, "left_anti").select(*child.columns)
                result = result.replace(**{fk.child: kept})
    return result


def with_expiry(df: DataFrame) -> DataFrame:
    """New collections with ``expires_at`` one day after creation, whatever was given.

    Works the same on a stream.
    """
    return df.withColumn("expires_at", expiry(F.col("created_at")))
