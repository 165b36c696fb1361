"""Quality rules whose cutoffs adapt to each language and source.

Every document's measures go into quantile sketches: counts of whole-number
buckets that are exact up to 1023 and have 512 steps per power of two beyond, so
any quantile is right within 1/512. Sketches merge by adding counts: those of a
source merge into its language's and those into the one of all. Each cutoff
comes from the source's sketch, or, if that holds too few values, from that of
its language, or of all.

A cutoff is the median plus or minus a multiple of the spread, which is the
smaller of the distances from the median to the two quartiles. Junk stretches
one side of a distribution, so up to a quarter of a source can be junk of one
kind without loosening its own cutoffs. Most documents repeat no line; that
measure's quantiles are those of the documents that do.

* mark_rate: ASCII punctuation and symbols in a thousand characters of words
* dup_line_rate: repeated lines in a thousand
* word_length: hundredths of characters in a word, with a lower cutoff as well,
  never under a quarter of the median

Defined cases: a null text has no words and fails; null lang or source count as
the empty string; repeated rows count each time and get equal results; an empty
table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.sizing import is_small
from shelfmark.functions.skew import spread_join
from shelfmark.llm.common import blank_words, bounded_batches, texts, written

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
SPAN = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

STEPS_BITS = 10
EXACT = 1 << STEPS_BITS


@dataclass(frozen=True)
class Measure:
    """How cutoffs follow from a sketch of ``few`` values or more; a smaller spread than ``least`` counts as that."""

    part: str
    whole: str
    scale: int
    few: int
    spreads: int
    least: int
    lower: bool = False
    present: bool = False  # only values above 0 are sketched
    otherwise: int | None = None  # the cutoff when no document has such a value


RULES = {
    "mark_rate": Measure("n_marks", "word_chars", 1000, 200, 10, 1),
    "dup_line_rate": Measure("n_dup_lines", "n_lines", 1000, 20, 5, 20, present=True, otherwise=300),
    "word_length": Measure("word_chars", "n_words", 100, 200, 10, 2, lower=True),
}
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
FOLLOWING = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words inside spans of 8 words that occur twice or more, the first included."""
    if len(words) <= SPAN:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(word) + 1 for word in words), initial=0))
    spans = [joined[a : b - 1] for a, b in zip(starts, starts[SPAN:], strict=False)]
    seen = Counter(spans)
    if len(seen) == len(spans):
        return 0
    covered, until = 0, 0
    for at, span in enumerate(spans):
        if seen[span] > 1:
            covered += at + SPAN - max(at, until)
            until = at + SPAN
    return covered


def measures(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_marks."""
    words = blank_words(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(b"".join(words).translate(None, FOLLOWING)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, MARKS)),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of every row."""
    bounded_batches(documents.sparkSession)
    group = [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("lang", "source")]
    source = documents.select("doc_id", *group, "text")
    schema = T.StructType(source.schema.fields[:3] + [T.StructField(name, T.LongType()) for name in MEASURES])

    def measure(batches):
        for batch in batches:
            found = list(zip(*map(measures, texts(batch.column(3))), strict=True)) or [()] * len(MEASURES)
            columns = [pa.array(values, pa.int64()) for values in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=schema.names)

    return source.mapInArrow(measure, schema)


def rate(rule: Measure) -> Column:
    return F.expr(f"{rule.scale} * {rule.part} div greatest({rule.whole}, 1)")


def bucket(value: Column) -> Column:
    """The smallest value of the sketch bucket of a whole number."""
    drop = F.length(F.bin(value)) - STEPS_BITS
    return F.when(value < EXACT, value).otherwise(
        F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)
    )


def sketches(stats: DataFrame, rules: Mapping[str, Measure] = RULES) -> DataFrame:
    """level, lang, source, measure, bucket, n: a sketch per source (0), language (1) and of all (2)."""
    values = F.array(
        *(F.struct(F.lit(name).alias("measure"), bucket(rate(rule)).alias("bucket")) for name, rule in rules.items())
    )
    present = [name for name, rule in rules.items() if rule.present]
    own = written(
        stats.where("n_words > 0")
        .select("lang", "source", F.explode(values).alias("value"))
        .select("lang", "source", "value.*")
        .where((F.col("bucket") > 0) | ~F.col("measure").isin(present))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count("*").alias("n")),
        "sketches",
    )
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), F.lit("").alias("s")),
        F.struct(F.lit(2).alias("level"), F.lit("").alias("l"), F.lit("").alias("s")),
    )
    return (
        own.select(F.explode(levels).alias("at"), "measure", "bucket", "n")
        .groupBy("at.level", F.col("at.l").alias("lang"), F.col("at.s").alias("source"), "measure", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def quantiles(sketch: DataFrame) -> DataFrame:
    """level, lang, source, measure, total and the three quartiles of each sketch."""
    group = Window.partitionBy("level", "lang", "source", "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn(
        "total", F.sum("n").over(group)
    )
    return ranked.groupBy("level", "lang", "source", "measure", "total").agg(
        *(F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))).alias(f"q{q}") for q in (25, 50, 75))
    )


def cutoffs(stats: DataFrame, rules: Mapping[str, Measure] = RULES) -> DataFrame:
    """lang, source and the cutoffs of every source, each from the nearest sketch with enough values."""
    found = written(quantiles(sketches(stats, rules)), "quantiles")
    low, middle, high = F.col("q25"), F.col("q50"), F.col("q75")
    limits = []
    for name, rule in rules.items():
        far = rule.spreads * F.greatest(F.lit(rule.least), F.least(middle - low, high - middle))
        ends = {f"n_{name}": F.col("total"), f"most_{name}": middle + far}
        if rule.lower:
            ends[f"least_{name}"] = F.greatest(middle - far, F.expr("q50 div 4"))
        limits += [F.max(F.when(F.col("measure") == name, end)).alias(end_name) for end_name, end in ends.items()]
    by = found.groupBy("level", "lang", "source").agg(*limits)
    value = F.struct(*by.columns[3:])
    source = by.where("level = 0").select("lang", "source", value.alias("own"))
    # There are as many languages as the data names, so the join is left to the planner.
    language = by.where("level = 1").select("lang", value.alias("of_lang"))
    every = by.where("level = 2").select(F.lit(True).alias("one"), value.alias("of_all"))
    chosen = []
    for name, rule in rules.items():
        for end in ("most", "least")[: 1 + rule.lower]:
            nearest = F.when(F.col(f"own.n_{name}") >= rule.few, F.col(f"own.{end}_{name}"))
            nearest = nearest.when(F.col(f"of_lang.n_{name}") >= rule.few, F.col(f"of_lang.{end}_{name}"))
            chosen.append(F.coalesce(nearest.otherwise(F.col(f"of_all.{end}_{name}")), F.lit(rule.otherwise)).alias(f"{end}_{name}"))
    return (
        source.join(language, "lang", "left")
        .withColumn("one", F.lit(True))
        .join(F.broadcast(every), "one", "left")  # a single row
        .select("lang", "source", *chosen)
    )


def judged(documents: DataFrame, few: int | None = None) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row; ``few`` replaces that of all rules."""
    rules = RULES if few is None else {name: replace(rule, few=few) for name, rule in RULES.items()}
    stats = written(measured(documents), "measures")
    limits = written(cutoffs(stats, rules), "cutoffs")
    # A source may hold a third of all rows: either nothing moves, or it is cut into slots.
    if is_small(limits):
        joined = stats.join(F.broadcast(limits), ["lang", "source"], "left")
    else:
        joined = spread_join(stats, limits, ["lang", "source"], ["doc_id", *MEASURES], "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    outside = F.lit(False)
    for name, rule in rules.items():
        outside = outside | (rate(rule) > F.col(f"most_{name}"))
        if rule.lower:
            outside = outside | (rate(rule) < F.col(f"least_{name}"))
    return joined.select(
        "doc_id",
        "lang",
        "source",
        *MEASURES,
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(outside, F.lit(False))).alias("kept"),
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
