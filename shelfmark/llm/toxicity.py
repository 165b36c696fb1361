"""Toxicity as ordered severity grades: cumulative-link regression on sparse text features.

Features are words and word beginnings, each at up to four levels: present, and
making up a half, one or two percent of the words (and there twice at least).
The model has one weight per feature, shared by all thresholds: the chance of a
grade above k is the logistic of the sum of the weights of a text's features
minus threshold k. The output is the expected severity, the sum of these
chances over the thresholds.

It is trained on a bounded sample of labelled rows, at most about
``SAMPLE_ROWS`` chosen by a hash of their id; features and thresholds come from
these rows alone. Where labels only say toxic or not, toxic rows are graded 1 or
2 by how many of their features are marked, that is much more frequent among
toxic rows. Near copies in the sample count once, by the smallest hash of their
shingles, and a feature is used only if its share among toxic rows differs
beyond chance for the number of features tried, so that single texts' own words
don't become signs of toxicity.

Scoring reads every text where it lies, whole; nothing is shuffled.

Defined cases: a null text has no features; an unlabelled or empty training table
gives a model that finds nothing toxic; null labels are left out; ids labelled
more than once take the highest label; repeated rows get equal results.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.sizing import sent_if_small
from shelfmark.llm.common import ALNUM_TABLE, bounded_batches, texts, written
from shelfmark.llm.simhash import shingle_hashes

SAMPLE_ROWS = 10_000
FEATURES = 4096
SUPPORT = 4
CHANCE = 0.01
SHORTEST, LONGEST = 3, 8
SHARES = (200, 100, 50)
MARKED = 4.0
GRADES = 2
REJECT = 0.25
STEPS = 250
RIDGE = 2e-4
HASHES = 1 << 20
MOST = np.iinfo(np.uint64).max


def features_of(text: bytes, starts: set[str] | None = None) -> set[str]:
    """Features as level, kind (= a word, ^ a beginning) and letters; with ``starts``, of such words only."""
    words = text.translate(ALNUM_TABLE).decode("utf-8", "replace").split()
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        if starts is not None and word[:SHORTEST] not in starts:
            continue
        counts["=" + word] += n
        for size in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
            counts["^" + word[:size]] += n
    found = set()
    for name, n in counts.items():
        found.add("0" + name)
        if n > 1:
            found.update(f"{k}{name}" for k, share in enumerate(SHARES, 1) if n * share >= len(words))
    return found


@dataclass
class Model:
    """Weights by feature and the thresholds in order; no thresholds: nothing is toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.starts = {name[2 : 2 + SHORTEST] for name in self.weights}

    def severity(self, text: bytes) -> float:
        if not len(self.thresholds):
            return 0.0
        known = sorted(self.weights.keys() & features_of(text, self.starts))
        total = sum(self.weights[name] for name in known)
        return round(float(np.sum(1 / (1 + np.exp(self.thresholds - total)))), 6)


def fitted(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood, with a small ridge; features are 0 or 1."""
    n, most = len(grades), int(grades.max(initial=0))
    weights = np.zeros(n_features)
    start = np.array([np.log((np.sum(grades <= k) + 1) / (np.sum(grades > k) + 1)) for k in range(most)])
    gaps = np.append(start[:1], np.log(np.maximum(np.diff(start), 0.1)))
    state = np.concatenate((weights, gaps))
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        weights, gaps = state[:n_features], state[n_features:]
        limits = gaps[0] + np.concatenate(([0], np.cumsum(np.exp(gaps[1:]))))
        score = np.bincount(rows, weights[columns], n)
        bounds = np.concatenate(([-np.inf], limits, [np.inf]))
        above = 1 / (1 + np.exp(np.clip(score - bounds[grades + 1], -500, 500)))
        below = 1 / (1 + np.exp(np.clip(score - bounds[grades], -500, 500)))
        chance = np.maximum(above - below, 1e-12)
        by_score = 1 - above - below
        by_limit = np.bincount(grades + 1, -above * (1 - above) / chance, most + 2)
        by_limit += np.bincount(grades, below * (1 - below) / chance, most + 2)
        by_limit = by_limit[1:-1]
        later = np.cumsum(by_limit[::-1])[::-1]
        by_gap = np.append(later[:1], later[1:] * np.exp(gaps[1:]))
        slope = np.concatenate((np.bincount(columns, by_score[rows], n_features), by_gap)) / n
        slope[:n_features] += RIDGE * weights
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        state = state - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    weights, gaps = state[:n_features], state[n_features:]
    return weights, gaps[0] + np.concatenate(([0], np.cumsum(np.exp(gaps[1:]))))


def sample_features(documents: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """copy_key, label and features of the sampled rows, one row per copy_key."""
    bounded_batches(documents.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    total = known.count()
    share = min(HASHES, HASHES * sample_rows // max(total, 1))
    some = written(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < share), "labels")
    source = documents.select("doc_id", "text").join(sent_if_small(some), "doc_id").select("label", "text")

    def features(batches):
        for batch in batches:
            values = texts(batch.column(1))
            keys = [int(shingle_hashes(text).min(initial=MOST) >> np.uint64(1)) for text in values]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    batch.column(0).cast(pa.int64()),
                    pa.array([sorted(features_of(text)) for text in values], pa.list_(pa.string())),
                ],
                names=["copy_key", "label", "features"],
            )

    found = source.mapInArrow(features, "copy_key long, label long, features array<string>")
    return found.groupBy("copy_key").agg(F.max(F.struct("label", "features")).alias("one")).select("copy_key", "one.*")


def chosen_features(sample: DataFrame) -> DataFrame:
    """name, toxic, clean (rows that hold it) and odds of the features that tell most, at most ``FEATURES``."""
    totals = sample.agg(
        F.sum((F.col("label") > 0).cast("long")).alias("all_toxic"), F.sum((F.col("label") <= 0).cast("long")).alias("all_clean")
    )
    counted = (
        sample.select("label", F.explode("features").alias("name"))
        .groupBy("name")
        .agg(
            F.sum((F.col("label") > 0).cast("long")).alias("toxic"),
            F.sum((F.col("label") <= 0).cast("long")).alias("clean"),
        )
        .where(F.col("toxic") + F.col("clean") >= SUPPORT)
        .join(F.broadcast(totals))  # a single row
    )
    odds = (F.col("toxic") + 0.5) / (F.col("all_toxic") + 1) / ((F.col("clean") + 0.5) / (F.col("all_clean") + 1))
    held = F.col("toxic") + F.col("clean")
    share = F.col("all_toxic") / (F.col("all_toxic") + F.col("all_clean"))

    def gain(part: Column, expected: Column) -> Column:
        return F.when(part > 0, part * F.log(part / expected)).otherwise(0.0)

    # Log likelihood ratio of the feature's own share of toxic rows against that of all rows.
    telling = gain(F.col("toxic"), held * share) + gain(F.col("clean"), held * (1 - share))
    counted = counted.select("name", "toxic", "clean", odds.alias("odds"), telling.alias("telling"))
    tried = counted.agg(F.log(F.count("*") / CHANCE).alias("least"))
    return (
        counted.join(F.broadcast(tried))  # a single row
        .where("telling >= least")
        .drop("least")
        .orderBy(F.desc("telling"), "name")
        .limit(FEATURES)
    )


def trained(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows; ``labels.toxic`` is 0 or 1, or an ordered grade from 0."""
    sample = written(sample_features(documents, labels, sample_rows), "sample")
    chosen = chosen_features(sample).collect()
    place = {row["name"]: k for k, row in enumerate(chosen)}

    def placed(batches):
        for batch in batches:
            found = [[place[name] for name in names if name in place] for names in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], names=["copy_key", "label", "columns"]
            )

    rows = sample.mapInArrow(placed, "copy_key long, label long, columns array<int>").collect()
    rows.sort(key=lambda row: row["copy_key"])
    grades = np.array([max(row["label"], 0) for row in rows], np.int64)
    if not place or not grades.any() or grades.all():
        return Model()
    if grades.max() == 1:
        marked = {k for k, row in enumerate(chosen) if row["odds"] >= MARKED}
        n_marked = np.array([sum(k in marked for k in row["columns"]) for row in rows])
        toxic = n_marked[(grades == 1) & (n_marked > 0)]
        grades[(grades == 1) & (n_marked > (np.median(toxic) if len(toxic) else 0))] = GRADES
    sizes = np.array([len(row["columns"]) for row in rows])
    columns = np.array([k for row in rows for k in row["columns"]], np.int64)
    weights, limits = fitted(np.repeat(np.arange(len(rows)), sizes), columns, grades, len(place))
    return Model({name: float(weights[k]) for name, k in place.items()}, limits)


def scored(documents: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """doc_id, severity (expected grade), grade (the nearest) and toxic (severity at least ``reject``)."""
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select("doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("severity", T.DoubleType()),
            T.StructField("grade", T.LongType()),
            T.StructField("toxic", T.BooleanType()),
        ]
    )

    def score(batches):
        for batch in batches:
            values = [sent.value.severity(text) for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(values, pa.float64()),
                    pa.array([int(v + 0.5) for v in values], pa.int64()),
                    pa.array([v >= reject for v in values], pa.bool_()),
                ],
                names=schema.names,
            )

    return source.mapInArrow(score, schema)


def without_toxic(documents: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """``documents`` without those of severity ``reject`` or more; all columns kept."""
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    text = documents.columns.index("text")

    def keep(batches):
        for batch in batches:
            good = [sent.value.severity(value) < reject for value in texts(batch.column(text))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(documents, trained(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
