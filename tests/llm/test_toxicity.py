from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import toxicity as op

ROOT = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    return documents, labels


def test_held_out_accuracy(spark, tables):
    documents, labels = tables
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0
    model = op.trained(documents, labels.where(~held))
    rows = op.scored(documents, model).withColumnRenamed("toxic", "found").join(labels.where(held), "doc_id").select("toxic", "found", "severity").collect()
    found = [(r["toxic"], r["found"]) for r in rows]
    clean = [f for t, f in found if not t]
    toxic = [f for t, f in found if t]
    assert sum(clean) <= 0.005 * len(clean)
    # Some toxic labels stand at texts without any sign of it.
    assert sum(toxic) >= 0.9 * len(toxic)
    assert np.mean([r["severity"] for r in rows if r["toxic"]]) > 5 * np.mean([r["severity"] for r in rows if not r["toxic"]])


def test_likelihood_slope_and_shared_weights():
    random = np.random.default_rng(3)
    features = random.random((3000, 4)) < 0.4
    truth, limits = np.array([2.0, -1.0, 0.0, 1.0]), np.array([0.5, 2.0, 3.5])
    noise = random.logistic(size=3000)
    grades = (features @ truth + noise)[:, None] > limits
    grades = grades.sum(axis=1)
    rows, columns = np.nonzero(features)
    weights, found = op.fitted(rows, columns, grades, 4)
    assert np.abs(weights - truth).max() < 0.3
    assert np.abs(found - limits).max() < 0.3 and (np.diff(found) > 0).all()


def small(spark):
    bad = [(k, f"some words here {k} vile more {k * k}", "x") for k in range(40)]
    worse = [(k + 100, f"vile {k} vile vile vile words", "x") for k in range(40)]
    good = [(k + 200, f"some words here {k} fine more {k * k}", "x") for k in range(120)]
    more = [(None, "vile vile", "x"), (300, None, "x"), (301, "", "x"), (302, "words " * 30000 + "VILE", "x"), (302, "words " * 30000 + "VILE", "x")]
    documents = spark.createDataFrame([*bad, *worse, *good, *more], "doc_id long, text string, toxic string")
    labels = [(k, int(k < 200)) for k, *_ in [*bad, *worse, *good]] + [(300, 0), (301, None), (None, 1), (5, 0)]
    return documents, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_odd_rows(spark):
    documents, labels = small(spark)
    model = op.trained(documents, labels)
    assert len(model.thresholds) == 2
    rows = op.scored(documents, model).collect()
    assert len(rows) == documents.count()
    toxic = {r["doc_id"] for r in rows if r["toxic"]}
    assert {None, 302, *range(40), *range(100, 140)} == toxic
    assert all(0 <= r["severity"] <= 2 and r["grade"] == int(r["severity"] + 0.5) for r in rows)
    kept = op.without_toxic(documents, model)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {300, 301, *range(200, 320)}
    graded = labels.withColumn("toxic", F.when(F.col("doc_id").between(100, 199), 2).otherwise(F.col("toxic")))
    assert len(op.trained(documents, graded).thresholds) == 2


def test_empty_tables(spark):
    documents, labels = small(spark)
    for docs, known in ((documents, labels.limit(0)), (documents.limit(0), labels)):
        model = op.trained(docs, known)
        assert not any(r["toxic"] for r in op.scored(documents, model).collect())
    assert op.scored(documents.limit(0), op.trained(documents, labels)).count() == 0


def test_sample_is_bounded(spark):
    documents, labels = small(spark)
    assert op.sample_features(documents, labels, 50).count() < 100
