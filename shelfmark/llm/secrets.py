"""Secret scans with an incremental ledger of text blobs.

Every version of every text is addressed by its SHA-256. The ledger holds one
row per scanned (blob, rule version) pair with the spans found, so a scan reads
only pairs it lacks, each blob once however many rows share it, and findings
are joined back to all rows by their blob. A rule set whose version is new is
scanned over all blobs, the others are not scanned again.

Only built-in functions are used. Texts that hold no anchor of any rule are
settled where they lie: their pairs enter the ledger with no spans and their
text is not moved.

Defined cases: a null text is the empty blob; repeated rows and copies share one
pair and each row gets the findings; a null id keeps its row; an empty table
gives none. Positions are code points from 0, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import unused, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose ``group`` has ``least`` characters or more count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds of the result contract, in order. Short matches
# are found and dropped, as what they consume is not searched again.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
MORE = (
    Rule("private-key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("git-token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat-token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps-key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay-key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url-login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^/\s:@]{1,80}:[^/\s:@]{1,80}@"),
)
# The scans of a ledger, by rule version; a changed rule needs a new version.
RULE_SETS = {"base-1": BASE, "more-1": MORE}
KINDS = tuple(rule.kind for rule in (*BASE, *MORE))
# No rule matches a text without one of these.
ANCHOR = r"(?i:passw|secret|token|api_?key)|[0-9a-f]{32}|xox[abprs]-|[rs]k_live_"
ANCHOR_STRINGS = ("AKIA", "PRIVATE KEY-----", ".eyJ", "AIza")
ANCHOR_TOKENS = r"gh[pousr]_|://[^/\s:@]+:"

SPAN = "struct<start:int,kind:int,end:int>"


def anchored(text: Column) -> Column:
    """Whether any rule could match."""
    strings = F.lit(False)
    for string in ANCHOR_STRINGS:
        strings = strings | F.contains(text, F.lit(string))
    rare = (F.contains(text, F.lit("://")) | F.contains(text, F.lit("gh"))) & text.rlike(ANCHOR_TOKENS)
    return strings | text.rlike(ANCHOR) | rare


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule, leftmost and non-overlapping: lengths between and in matches, added up."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    kind = KINDS.index(rule.kind)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["before"])
        end = start + F.length(F.coalesce(part["match"], F.lit("")))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        counts = F.length(part["value"]) >= rule.least
        found = F.when(counts, F.array_append(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    empty = F.array().cast(f"array<{SPAN}>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    found = F.aggregate(zipped, first, step, lambda state: state["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(empty)


def addressed(versions: DataFrame) -> DataFrame:
    """``versions`` with blob, the address of its text, and the text where a rule could match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return versions.select(F.sha2(text, 256).alias("blob"), F.when(anchored(text), text).alias("text"))


def unseen_pairs(versions: DataFrame, ledger: DataFrame | None, rule_versions: Sequence[str]) -> DataFrame:
    """blob, rule_version and text of the pairs the ledger lacks, one row each."""
    pairs = (
        addressed(versions)
        .groupBy("blob")
        .agg(F.max("text").alias("text"))
        .withColumn("rule_version", F.explode(F.array(*map(F.lit, rule_versions))))
    )
    return pairs if ledger is None else pairs.join(ledger, ["blob", "rule_version"], "left_anti")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rule_sets: dict = RULE_SETS) -> DataFrame:
    """What to add to the ledger for ``versions``: blob, rule_version, spans.

    ``versions`` needs a text column; ``ledger`` has the rows earlier scans added.
    """
    spans = F.array().cast(f"array<{SPAN}>")
    for version, rules in rule_sets.items():
        found = F.flatten(F.array(*(rule_spans(F.col("text"), rule) for rule in rules)))
        spans = F.when(F.col("text").isNotNull() & (F.col("rule_version") == version), found).otherwise(spans)
    return unseen_pairs(versions, ledger, list(rule_sets)).select("blob", "rule_version", spans.alias("spans"))


def findings(ledger: DataFrame, rule_sets: dict = RULE_SETS) -> DataFrame:
    """blob and its spans under the given rule versions, for blobs that have some."""
    return (
        ledger.where(F.col("rule_version").isin(*rule_sets) & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )


def with_spans(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and spans (an array, empty without a finding) of every row."""
    address = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return (
        documents.select("doc_id", address.alias("blob"))
        .join(found, "blob", "left")
        .select("doc_id", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``."""

    def step(state: Column, span: Column) -> Column:
        between = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        later = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(later, F.array_append(state["parts"], F.concat(between, F.lit(mark))))
            .otherwise(state["parts"])
            .alias("parts"),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return F.aggregate(spans, first, step, finish)


def without_secrets(documents: DataFrame) -> DataFrame:
    """``documents`` with every secret replaced in text, n_chars set anew where it exists; all columns kept.

    Only rows with an anchor take part in the join; the others stay where they are.
    """
    suspect = anchored(F.coalesce(F.col("text"), F.lit("")))
    some = documents.where(suspect)
    blob, spans, new = (unused(documents, name) for name in ("_blob", "_spans", "_new"))
    found = findings(written(scan(some), "ledger")).withColumnsRenamed({"blob": blob, "spans": spans})
    joined = some.join(found, F.sha2("text", 256) == F.col(blob), "left")
    hit = F.col(spans).isNotNull()
    clean = joined.withColumn(new, F.when(hit, redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    columns = {name: F.col(name) for name in documents.columns} | {"text": F.col(new).alias("text")}
    if "n_chars" in columns:
        kind = documents.schema["n_chars"].dataType
        n_chars = F.when(hit, F.length(new).cast(kind)).otherwise(F.col("n_chars"))
        columns["n_chars"] = n_chars.alias("n_chars")
    return clean.select(*columns.values()).unionByName(documents.where(~suspect))


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = written(scan(documents), "ledger")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    return with_spans(documents, written(findings(ledger), "findings")).select(
        "doc_id",
        *(count(rule.kind).alias(f"n_{rule.kind}") for rule in BASE),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
