"""Reports on rows that break a declared rule.

Every report counts per key before anything is shuffled or joined, so a key held
by a third of all rows is one partial count per task. Each is
``(rule, table_name, key, n_rows)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.catalog import Catalog
from shelfmark.functions.sizing import sent_if_small, settled
from shelfmark.functions.tables import stacked
from shelfmark.schemas import ForeignKey, Rules
from shelfmark.sources.folders import kept


def _key(columns: Sequence[str]) -> Column:
    """One column's value as text, or several as a JSON list, so that no two keys look alike."""
    if len(columns) == 1:
        return F.coalesce(F.col(columns[0]).cast("string"), F.lit("?"))
    return F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))


def _unique_rule(columns: Sequence[str]) -> str:
    return f"unique {','.join(columns)}"


def _report(rule: str, table: str, rows: DataFrame, key: Column) -> DataFrame:
    return rows.select(
        F.lit(rule).alias("rule"),
        F.lit(table).alias("table_name"),
        key.alias("key"),
        F.col("n_rows").cast("bigint").alias("n_rows"),
    )


def duplicates(df: DataFrame, columns: Sequence[str], table: str = "") -> DataFrame:
    """Values of ``columns`` held by more than one row; null is never a duplicate."""
    present = df.dropna(subset=list(columns))
    held = present.groupBy(*columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    return _report(_unique_rule(columns), table, held, _key(columns))


def without_duplicates(df: DataFrame, columns: Sequence[str], keep: str = "id") -> DataFrame:
    """One row per value of ``columns``: the one with the smallest ``keep``.

    Rows in which one of ``columns`` is null are all kept.
    """
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    rest = [c for c in df.columns if c not in (*columns, keep)]
    order = [F.asc(c) for c in ([keep] if keep in df.columns else []) + rest] or [F.asc(columns[0])]
    # The window keeps one row per value in each task before it shuffles.
    first = W.partitionBy(*columns).orderBy(*order)
    firsts = df.where(whole).withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    return firsts.select(*df.columns).unionByName(df.where(~whole))


def row_faults(
    df: DataFrame,
    required: Sequence[str] = (),
    limits: Mapping[str, int] | None = None,
    table: str = "",
    key: Sequence[str] = ("id",),
) -> DataFrame:
    """Rows without a required value or with a text over its limit.

    The rules are named ``required <column>`` and ``length <column>``; all of
    them are tested in one pass over ``df``.
    """
    tests = [F.when(F.col(c).isNull(), F.lit(f"required {c}")) for c in required]
    tests += [F.when(F.length(c) > n, F.lit(f"length {c}")) for c, n in (limits or {}).items()]
    # explode_outer, so that the tests are not run twice to see if any failed.
    found = df.select(F.explode_outer(F.array_compact(F.array(*tests))).alias("rule"), _key(key).alias("key"))
    return found.where(F.col("rule").isNotNull()).select(
        "rule", F.lit(table).alias("table_name"), "key", F.lit(1).cast("bigint").alias("n_rows")
    )


def missing(
    df: DataFrame, columns: Sequence[str], table: str = "", key: Sequence[str] = ("id",)
) -> DataFrame:
    """Rows without a required value."""
    return row_faults(df, required=columns, table=table, key=key)


def too_long(
    df: DataFrame, limits: Mapping[str, int], table: str = "", key: Sequence[str] = ("id",)
) -> DataFrame:
    """Rows with a text over its limit."""
    return row_faults(df, limits=limits, table=table, key=key)


def orphans(child: DataFrame, column: str, parent: DataFrame, table: str = "") -> DataFrame:
    """Values of ``child.column`` no ``parent.id`` has, and how many rows hold each."""
    used = (
        child.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("id"))
        .agg(F.count("*").alias("n_rows"))
    )
    lost = used.join(parent.select("id"), "id", "left_anti")
    return _report(f"reference {column}", table, lost, _key(["id"]))


def orphan_rows(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """The rows of ``child`` whose non-null ``column`` no ``parent.id`` has."""
    parents = parent.select(F.col("id").alias(column))
    return child.where(F.col(column).isNotNull()).join(parents, column, "left_anti").select(*child.columns)


def _row_key(df: DataFrame, columns: Sequence[str]) -> Column:
    return _key(("id",) if "id" in df.columns else columns)


def _whole(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def _often(entries: DataFrame, unique: Sequence[int]) -> DataFrame:
    """Entries with ``n_rows``; of the rules in ``unique`` those that came more than once."""
    counted = entries.groupBy("rule", "parent", "id", "key").agg(F.count("*").alias("n_rows"))
    return counted.where(~F.col("rule").isin(*unique) | (F.col("n_rows") > 1))


def violations(catalog: Catalog, rules: Rules = schemas.CATALOG_RULES) -> DataFrame:
    """All reports over all tables the catalog has, each table read once.

    Every row names the rules it breaks, a hash of 64 bits of each value that must
    be unique and the rows it refers to; all of that is counted per value in each
    task. The counts of references meet the ids of their parents in one anti-join.
    Values are looked at themselves only in the tables where a hash came twice, and
    of them only those with such a hash: two values of one hash are told apart there.
    """
    names: list[tuple[str, str]] = []  # rule and table by number
    unique: dict[int, tuple[str, Sequence[str]]] = {}
    held = [fk for fk in rules.foreign_keys if fk.child in catalog and fk.parent in catalog]
    parents = list(dict.fromkeys(fk.parent for fk in held))
    nothing = F.lit(None).cast("bigint")

    def entry(table: str, rule: str, applies: Column, key: Column, parent: Column, id_: Column) -> Column:
        names.append((rule, table))
        number = F.lit(len(names) - 1)
        return F.when(
            applies, F.struct(number.alias("rule"), parent.alias("parent"), id_.alias("id"), key.alias("key"))
        )

    def entries(table: str) -> DataFrame:
        df = catalog.table(table)
        own = ["id"] if "id" in df.columns else []
        keys = [columns for columns in ([own] if own else []) + [rules.unique.get(table, ())] if columns]
        row = _row_key(df, rules.unique.get(table) or df.columns)
        none = F.lit(None).cast("int")
        found = []
        for column in (*own, *rules.required.get(table, ())):
            found.append(entry(table, f"required {column}", F.col(column).isNull(), row, none, nothing))
        for column, most in rules.limits.get(table, {}).items():
            found.append(entry(table, f"length {column}", F.length(column) > most, row, none, nothing))
        for columns in keys:
            unique[len(names)] = (table, columns)
            found.append(entry(table, _unique_rule(columns), _whole(columns), F.lit(None).cast("string"), none, F.xxhash64(*columns)))
        for fk in held:
            if fk.child == table:
                value = F.col(fk.column).cast("bigint")
                parent = F.lit(parents.index(fk.parent))
                key = F.lit(None).cast("string")
                found.append(entry(table, f"reference {fk.column}", value.isNotNull(), key, parent, value))
        # inline_outer, so that the tests are not run twice to see if any failed.
        return df.select(F.inline_outer(F.array_compact(F.array(*found)))).where("rule IS NOT NULL")

    ruled = [t for t in catalog if t in rules.required or t in rules.unique or "id" in catalog.table(t).columns]
    counted = kept(_often(stacked([entries(t) for t in ruled]), list(unique)), "counted")
    repeated = counted.where(F.col("rule").isin(*unique))
    counted = counted.where(~F.col("rule").isin(*unique))
    if parents:
        known = stacked(
            [
                catalog.table(parent).select(F.lit(number).alias("parent"), F.col("id").cast("bigint").alias("id"))
                for number, parent in enumerate(parents)
            ]
        )
        counted = counted.join(known, ["parent", "id"], "left_anti")

    def named(place: int) -> Column:
        return F.get(F.array(*(F.lit(name[place]) for name in names)), F.col("rule"))

    reports = [
        counted.select(
            named(0).alias("rule"),
            named(1).alias("table_name"),
            F.coalesce("key", F.col("id").cast("string")).alias("key"),
            "n_rows",
        )
    ]
    # One row per rule.
    for number in sorted(row["rule"] for row in repeated.select("rule").distinct().collect()):
        table, columns = unique[number]
        hashes = sent_if_small(repeated.where(F.col("rule") == number).select(F.col("id").alias("_hash")))
        suspect = catalog.table(table).where(_whole(columns)).select(F.xxhash64(*columns).alias("_hash"), _key(columns).alias("key"))
        held_by = suspect.join(hashes, "_hash", "left_semi").groupBy("key").agg(F.count("*").alias("n_rows"))
        reports.append(_report(_unique_rule(columns), table, held_by.where("n_rows > 1"), F.col("key")))
    return stacked(reports)


def blocked_deletes(
    catalog: Catalog,
    table: str,
    keys: DataFrame,
    foreign_keys: Sequence[ForeignKey] = schemas.STRICT_KEYS,
) -> DataFrame:
    """Requested deletes that a restricting reference refuses.

    ``keys`` has the ``id`` of each row of ``table`` to delete. Returns
    ``(id, referrer, n_rows)``: which column refers to it, in how many rows.
    """
    wanted = sent_if_small(settled(keys.select("id").distinct()))
    reports = []
    for fk in foreign_keys:
        if fk.parent == table and fk.on_delete == "restrict":
            # Only rows that refer to a wanted id are counted; a missing table is an error.
            used = catalog.table(fk.child).select(F.col(fk.column).alias("id")).join(wanted, "id", "left_semi")
            counted = used.groupBy("id").agg(F.count("*").alias("n_rows"))
            reports.append(counted.select("id", F.lit(fk.name).alias("referrer"), "n_rows"))
    if not reports:
        nothing = wanted.where(F.lit(False))
        return nothing.select(
            "id", F.lit("").alias("referrer"), F.lit(0).cast("bigint").alias("n_rows")
        )
    return stacked(reports)
