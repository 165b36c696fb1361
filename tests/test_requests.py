"""One search and a table of searches read and refuse requests alike."""

from __future__ import annotations

import itertools

import pytest
from small import small_catalog

from shelfmark.operators.batch import batch_counts
from shelfmark.operators.requests import InvalidRequest, checked_request, read_filters, valid_requests
from shelfmark.operators.search import find, search_count

QUERIES = [None, "", "r", " r ", "ring", " ring\t", "q" * 100, "q" * 101, " " + "q" * 100, "a\x00b", "RING", "a_"]
AREAS = [None, "", " ", "H", " Head\n", "He\x00ad"]
NUMBERS = [None, "", " 7 ", "7.0", "7.", "7.5", "+3", "-2", "many", "9" * 30, "٣"]
KINDS = "request_id bigint, query string, anatomical_area_name string, record_count_min string"


def raw_requests():
    rows = [*itertools.product(QUERIES, AREAS, [None]), *itertools.product(["ring"], AREAS, NUMBERS)]
    return [(k, *row) for k, row in enumerate(rows)]


def by_hand(query, area, least):
    return checked_request(query, {"anatomical_area_name": area, "record_count_min": least})


def test_both_routes_read_alike(spark):
    requests = raw_requests()
    read = valid_requests(spark.createDataFrame(requests, KINDS)).collect()
    got = {r["request_id"]: (r["query"], r["anatomical_area_name"], r["record_count_min"]) for r in read}
    expected = {}
    for number, *raw in requests:
        try:
            query, params = by_hand(*raw)
            expected[number] = (query, params["anatomical_area_name"], params["record_count_min"])
        except InvalidRequest:
            pass
    assert got == expected and 0 < len(got) < len(requests)


def test_both_routes_find_alike(spark):
    catalog = small_catalog(spark)
    requests = [r for r in raw_requests() if r[0] % 5 == 0]
    counts = {r["request_id"]: r["count"] for r in batch_counts(catalog, spark.createDataFrame(requests, KINDS)).collect()}
    for number, query, area, least in requests:
        params = {"anatomical_area_name": area, "record_count_min": least}
        if number in counts:
            assert search_count(catalog, query, params).first()["count"] == counts[number]
        else:
            with pytest.raises(InvalidRequest):
                find(catalog, query, params)


def test_saved_lists_and_orders(spark):
    saved = [
        (1, '{"modalities_list": ["CT", "MRI"], "ordering": "size"}'),
        (2, '{"modalities_list": "CT,MRI", "ordering": ["size", "desc"]}'),
        (3, '{"modalities_list": [], "size_max": 4}'),
        (4, None),
        (5, "no json"),
    ]
    log = spark.createDataFrame(saved, "id int, filters string")
    got = {r["id"]: (r["modalities_list"], r["ordering"], r["size_max"]) for r in read_filters(log).collect()}
    assert got == {
        1: ("CT,MRI", ["size"], None),
        2: ("CT,MRI", ["size", "desc"], None),
        3: ("", None, "4"),
        4: (None, None, None),
        5: (None, None, None),
    }
