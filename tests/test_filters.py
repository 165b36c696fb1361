from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from small import ids, small_catalog

from shelfmark.functions.text import grams, parse_int, split_list, strip, words
from shelfmark.operators.filters import Condition, apply_conditions, parse_parameters, text_match


@pytest.fixture(scope="module")
def catalog(spark):
    return small_catalog(spark)


def matching(catalog, query):
    return ids(catalog.dataset.where(text_match(query)))


def test_text_match(catalog):
    assert matching(catalog, "ring") == [1, 2, 4, 5]  # case, null description, both fields
    assert matching(catalog, "50%") == [2]
    assert matching(catalog, "a_b") == [4]
    assert matching(catalog, "%") == [2]
    assert matching(catalog, "ab") == []


def filtered(catalog, copies=False, **params):
    return ids(apply_conditions(catalog.dataset, catalog, parse_parameters(params).conditions, copies))


@pytest.mark.parametrize(
    "params, expected",
    [
        ({"anatomical_area_name": "Head"}, [1, 4]),
        ({"anatomical_area_name": "head"}, []),
        ({"anatomical_area_id": 2}, [2, 5]),
        ({"anatomical_area_list": "Head,Chest"}, [1, 2, 4, 5]),
        ({"anatomical_area_id_list": "1"}, [1, 4]),
        ({"record_count_min": 0}, [1, 2, 4, 5]),  # zero is a bound, null fails it
        ({"record_count_min": 10, "record_count_max": 20}, [1, 5]),
        ({"size_max": 0}, [4]),
        ({"size_min": 6, "size_max": 50}, [2, 5]),
        ({"modalities_list": "CT,,CT"}, [1, 4]),
        ({"modalities_list": "X, MRI"}, [4]),  # " MRI" keeps its blank
        ({"modalities_list": "MRI", "tags_list": "large"}, [2]),
        ({"modalities_id_list": "1,3"}, [1, 4]),
        ({"modalities_id": 2}, [1, 2, 4]),
        ({"tags_name": "public"}, [1, 2, 4]),
        ({"tags_list": "unused"}, []),
        ({"title": "Lung"}, [2]),
        ({"title_ex": "Lung", "size_min": None, "tags_list": ""}, [1, 2, 3, 4, 5]),
    ],
)
def test_conditions(catalog, params, expected):
    assert filtered(catalog, **params) == expected


def test_copies(catalog):
    params = {"modalities_list": "CT,MRI", "ml_tasks_list": "segmentation,detection"}
    assert filtered(catalog, copies=True, **params) == [1, 1, 1, 1, 2, 4, 4]
    assert filtered(catalog, **params) == [1, 2, 4]


def test_only_the_last_suffix_counts():
    parsed = parse_parameters({"max_list_id_list": "1,2", "id_min_max": 3}).conditions
    assert parsed == [
        Condition("max_list", "in", ["1", "2"], "id"),
        Condition("id_min", "le", 3),
    ]


@pytest.mark.parametrize("params", [{"colour": "red"}, {"colour_list": "red"}, {"size_id": 1}])
def test_unknown_field(catalog, params):
    with pytest.raises(ValueError):
        filtered(catalog, **params)


def test_as_written_parameters():
    params = {"record_count_min": 0, "size_min": 3, "tags_list": "a", "ml_tasks_list": "b", "size_max": 9}
    intended = parse_parameters(params).conditions
    written = parse_parameters(params, "as_written").conditions
    assert [c.field for c in intended] == ["record_count", "size", "tags", "ml_tasks", "size"]
    assert [c.field for c in written] == ["size", "tags", "ml_tasks"]
    with pytest.raises(ValueError):
        parse_parameters({}, "other")


def test_text_functions(spark):
    row = (
        spark.createDataFrame(
            [("a,,b, c", "\u3000 x\t", "Où, là-bas 2x!", "ab😀\nd")],
            "l string, s string, w string, g string",
        )
        .select(
            split_list(F.col("l")).alias("list"),
            strip(F.col("s")).alias("strip"),
            words(F.col("w")).alias("words"),
            grams(F.col("g"), 4).alias("grams"),
        )
        .first()
    )
    assert row["list"] == ["a", "", "b", " c"]
    assert row["strip"] == "x"
    assert row["words"] == ["où", "là", "bas", "2x"]
    assert row["grams"] == ["ab😀\n", "b😀\nd"]


def test_parse_int(spark):
    given = ["12", " -3 ", "+4", "5.0", "5.", "5.5", "x", "", None, "9999999999", "1e3", "99999999999999999999"]
    df = spark.createDataFrame([(text,) for text in given], "t string").select(parse_int(F.col("t")).alias("n"))
    assert [row["n"] for row in df.collect()] == [
        12, -3, 4, 5, 5, None, None, None, None, 9999999999, None, None,
    ]
