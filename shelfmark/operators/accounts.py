"""Users and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.ordering import order_columns

# What may be shown of an account. Anything else, the password
# hash above all, never leaves the scan.
USER_COLUMNS = ("id", "username", "role_id", "date_joined")
GROUP_COLUMNS = ("id", "name")


def users(catalog: Catalog, ordering: str | None = "-date_joined") -> DataFrame:
    """Users, newest first; ``ordering=None`` leaves out the sort."""
    shown = catalog.users.select(*(c for c in USER_COLUMNS if c in catalog.users.columns))
    return shown if ordering is None else shown.orderBy(*order_columns(ordering, shown.columns))


def _with_lists(rows: DataFrame, catalog: Catalog, owner: str, lists: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with sorted id lists, ``[]`` for none; links the catalog lacks give no column."""
    for name, (table, member) in lists.items():
        if table not in catalog:
            continue
        listed = (
            catalog.table(table)
            .groupBy(F.col(owner).alias("id"))
            .agg(F.sort_array(F.collect_set(member)).alias(name))
        )
        rows = rows.join(listed, "id", "left").withColumn(
            name, F.coalesce(name, F.array().cast("array<bigint>"))
        )
    return rows


def users_with_groups(catalog: Catalog) -> DataFrame:
    """Every user with the ids of their groups and permissions."""
    lists = {"groups": ("user_groups", "group_id"), "permissions": ("user_permissions", "permission_id")}
    return _with_lists(users(catalog, ordering=None), catalog, "user_id", lists)


def groups_with_permissions(catalog: Catalog) -> DataFrame:
    """Every group with the ids of its permissions."""
    lists = {"permissions": ("group_permissions", "permission_id")}
    return _with_lists(groups(catalog, ordering=None), catalog, "group_id", lists)


def user_by_id(catalog: Catalog, user_id: int) -> DataFrame:
    return users(catalog, ordering=None).where(F.col("id") == user_id)


def groups(catalog: Catalog, ordering: str | None = "name") -> DataFrame:
    """Groups by name; ``ordering=None`` leaves out the sort."""
    shown = catalog.groups.select(*GROUP_COLUMNS)
    return shown if ordering is None else shown.orderBy(*order_columns(ordering, shown.columns))


def group_by_id(catalog: Catalog, group_id: int) -> DataFrame:
    return groups(catalog, ordering=None).where(F.col("id") == group_id)
