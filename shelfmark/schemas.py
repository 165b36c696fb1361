"""Table schemas and the rules declared on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

_LONG, _INT, _TEXT, _TIME = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


LOOKUP = _table(id=_LONG, name=_TEXT)

DATASET = _table(
    id=_LONG,
    title=_TEXT,
    description=_TEXT,
    external_path=_TEXT,
    local_path=_TEXT,
    record_count=_INT,
    size=_INT,
    anatomical_area_id=_LONG,
    created_at=_TIME,
    updated_at=_TIME,
)

SCHEMAS: dict[str, T.StructType] = {
    "anatomical_area": LOOKUP,
    "modality": LOOKUP,
    "ml_task": LOOKUP,
    "tag": LOOKUP,
    "dataset": DATASET,
    "dataset_modality": _table(dataset_id=_LONG, modality_id=_LONG),
    "dataset_ml_task": _table(dataset_id=_LONG, ml_task_id=_LONG),
    "dataset_tag": _table(dataset_id=_LONG, tag_id=_LONG),
    "roles": LOOKUP,
    "users": _table(id=_LONG, username=_TEXT, role_id=_LONG, date_joined=_TIME),
    "groups": LOOKUP,
    "user_groups": _table(user_id=_LONG, group_id=_LONG),
    "user_permissions": _table(user_id=_LONG, permission_id=_LONG),
    "group_permissions": _table(group_id=_LONG, permission_id=_LONG),
    "user_search_queries": _table(
        id=_LONG, user_id=_LONG, query_text=_TEXT, filters=_TEXT, performed_at=_TIME
    ),
    "user_dataset_collections": _table(
        id=_LONG,
        user_id=_LONG,
        storage_path_hdfs=_TEXT,
        archive_size_mb=_LONG,
        created_at=_TIME,
        expires_at=_TIME,
    ),
    "collection_datasets": _table(
        collection_id=_LONG, dataset_id=_LONG, relevance_score=T.DecimalType(5, 4), query_id=_LONG
    ),
}


@dataclass(frozen=True)
class ManyToMany:
    """A many-to-many relation of ``dataset``: its bridge, far table and key column."""

    bridge: str
    target: str
    key: str


RELATIONS = {
    "modalities": ManyToMany("dataset_modality", "modality", "modality_id"),
    "ml_tasks": ManyToMany("dataset_ml_task", "ml_task", "ml_task_id"),
    "tags": ManyToMany("dataset_tag", "tag", "tag_id"),
}

# Maximum text lengths.
TEXT_LIMITS: dict[str, dict[str, int]] = {
    "anatomical_area": {"name": 100},
    "modality": {"name": 50},
    "ml_task": {"name": 50},
    "tag": {"name": 50},
    "dataset": {"title": 500, "external_path": 1000, "local_path": 500},
    "roles": {"name": 20},
    "users": {"username": 50},
    "user_dataset_collections": {"storage_path_hdfs": 500},
}

# Columns that must not be null.
REQUIRED: dict[str, tuple[str, ...]] = {
    "anatomical_area": ("name",),
    "modality": ("name",),
    "ml_task": ("name",),
    "tag": ("name",),
    "dataset": ("title", "created_at", "updated_at"),
    "dataset_modality": ("dataset_id", "modality_id"),
    "dataset_ml_task": ("dataset_id", "ml_task_id"),
    "dataset_tag": ("dataset_id", "tag_id"),
    "roles": ("name",),
    "users": ("username", "role_id"),
    "groups": ("name",),
    "user_groups": ("user_id", "group_id"),
    "user_permissions": ("user_id", "permission_id"),
    "group_permissions": ("group_id", "permission_id"),
    "user_search_queries": ("query_text",),
    "user_dataset_collections": ("user_id", "storage_path_hdfs"),
    "collection_datasets": ("collection_id", "dataset_id", "query_id"),
}

# Columns whose values, taken together, must not repeat.
UNIQUE: dict[str, tuple[str, ...]] = {
    "anatomical_area": ("name",),
    "modality": ("name",),
    "ml_task": ("name",),
    "tag": ("name",),
    "dataset_modality": ("dataset_id", "modality_id"),
    "dataset_ml_task": ("dataset_id", "ml_task_id"),
    "dataset_tag": ("dataset_id", "tag_id"),
    "roles": ("name",),
    "users": ("username",),
    "groups": ("name",),
    "user_groups": ("user_id", "group_id"),
    "user_permissions": ("user_id", "permission_id"),
    "group_permissions": ("group_id", "permission_id"),
    "collection_datasets": ("collection_id", "dataset_id"),
}


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.id``; ``on_delete`` says what a delete does."""

    child: str
    column: str
    parent: str
    on_delete: str  # "cascade", "set_null" or "restrict"

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}"


# Two rule sets are declared for the catalog tables. The application rules let a
# lookup row take its links with it; the strict ones refuse while it is used.
_SHARED_KEYS = (
    ForeignKey("dataset_modality", "dataset_id", "dataset", "cascade"),
    ForeignKey("dataset_ml_task", "dataset_id", "dataset", "cascade"),
    ForeignKey("dataset_tag", "dataset_id", "dataset", "cascade"),
    ForeignKey("users", "role_id", "roles", "restrict"),
    ForeignKey("user_groups", "user_id", "users", "cascade"),
    ForeignKey("user_groups", "group_id", "groups", "cascade"),
    ForeignKey("user_permissions", "user_id", "users", "cascade"),
    ForeignKey("group_permissions", "group_id", "groups", "cascade"),
    ForeignKey("user_dataset_collections", "user_id", "users", "cascade"),
    ForeignKey("user_search_queries", "user_id", "users", "restrict"),
    ForeignKey("collection_datasets", "collection_id", "user_dataset_collections", "cascade"),
    ForeignKey("collection_datasets", "dataset_id", "dataset", "restrict"),
    ForeignKey("collection_datasets", "query_id", "user_search_queries", "cascade"),
)

APPLICATION_KEYS = (
    ForeignKey("dataset", "anatomical_area_id", "anatomical_area", "set_null"),
    ForeignKey("dataset_modality", "modality_id", "modality", "cascade"),
    ForeignKey("dataset_ml_task", "ml_task_id", "ml_task", "cascade"),
    ForeignKey("dataset_tag", "tag_id", "tag", "cascade"),
) + _SHARED_KEYS

STRICT_KEYS = (
    ForeignKey("dataset", "anatomical_area_id", "anatomical_area", "restrict"),
    ForeignKey("dataset_modality", "modality_id", "modality", "restrict"),
    ForeignKey("dataset_ml_task", "ml_task_id", "ml_task", "restrict"),
    ForeignKey("dataset_tag", "tag_id", "tag", "restrict"),
) + _SHARED_KEYS

# The application rules for the catalog tables alone: a database without collections.
LINK_KEYS = tuple(
    fk for fk in APPLICATION_KEYS if fk.child in ("dataset", *(relation.bridge for relation in RELATIONS.values()))
)


@dataclass(frozen=True)
class Rules:
    """What the rows of a catalog must keep. Tables with an ``id`` hold each id once and never null."""

    required: Mapping[str, Sequence[str]]
    unique: Mapping[str, Sequence[str]]
    limits: Mapping[str, Mapping[str, int]]
    foreign_keys: Sequence[ForeignKey]

    def without(self, *columns: str) -> "Rules":
        """The same rules but for what is required of ``table.column`` names."""
        required = {
            table: tuple(c for c in names if f"{table}.{c}" not in columns) for table, names in self.required.items()
        }
        keys = tuple(fk for fk in self.foreign_keys if fk.name not in columns)
        return Rules(required, self.unique, self.limits, keys)


CATALOG_RULES = Rules(REQUIRED, UNIQUE, TEXT_LIMITS, APPLICATION_KEYS)
# The application's layout has no roles; the script's lets the times of a dataset be null.
APPLICATION_RULES = CATALOG_RULES.without("users.role_id")
SCRIPT_RULES = Rules(REQUIRED, UNIQUE, TEXT_LIMITS, STRICT_KEYS).without("dataset.created_at", "dataset.updated_at")
