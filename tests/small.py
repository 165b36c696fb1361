"""A hand-written catalog with the awkward rows."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from shelfmark.catalog import Catalog
from shelfmark.schemas import SCHEMAS

T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 1, 2, 3, 4, 5, 600), datetime(2024, 2, 1)

ROWS = {
    "anatomical_area": [(1, "Head"), (2, "Chest")],
    "modality": [(1, "CT"), (2, "MRI"), (3, " MRI"), (4, "X-ray")],
    "ml_task": [(1, "segmentation"), (2, "detection")],
    "tag": [(1, "public"), (2, "large"), (3, "unused")],
    # id, title, description, external_path, local_path, record_count, size, area, created, updated
    "dataset": [
        (1, "Brain ring", None, "http://a", None, 10, 5, 1, T1, T1),
        (2, "Lung", "a RING of 50% of cases", None, "/b", 0, 50, 2, T2, T2),
        (3, "Plain", None, None, None, None, None, None, T2, T2),
        (4, "String a_b", "other", None, None, 30, 0, 1, T3, T3),
        (5, "ringring", "ring", None, None, 20, 7, 2, None, None),
    ],
    "dataset_modality": [(1, 1), (1, 2), (2, 2), (4, 1), (4, 2), (4, 3)],
    "dataset_ml_task": [(1, 1), (1, 2), (2, 1), (4, 2)],
    "dataset_tag": [(1, 1), (2, 1), (2, 2), (4, 1)],
    "roles": [(1, "reader"), (2, "admin")],
    "users": [(1, "ann", 1, T1), (2, "bo", 1, T3), (3, "cy", 2, None)],
    "groups": [(1, "staff"), (2, "guests")],
    "user_groups": [(1, 2), (1, 1), (2, 2)],
    "user_permissions": [],
    "group_permissions": [],
    "user_search_queries": [
        (1, 1, "ring", '{"size_max": 40}', T1),
        (2, None, "lung", None, T2),
        (3, 2, "a_b", '{"ordering": ["title"]}', T3),
    ],
    "user_dataset_collections": [(1, 1, "/c/1", None, T1, None), (2, 2, "/c/2", None, T3, None)],
    "collection_datasets": [
        (1, 1, Decimal("0.5"), 1),
        (1, 2, Decimal("1"), 1),
        (2, 3, None, 3),
    ],
}


def small_catalog(spark, **changed) -> Catalog:
    rows = {**ROWS, **changed}
    return Catalog(**{name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in rows})


def ids(df, column="id"):
    return sorted(row[column] for row in df.select(column).collect())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
