"""License scans: ordered signature rules over the words of a text.

Texts that hold no hint of a license are settled by a few cheap tests. In the
others, every rule whose keyword occurs is run over the words, joined by single
blanks; a detection is an interval of words. Rules are ordered: of intervals
that contain each other, the larger one stays, and of equal ones that of the
rule of higher priority, which is the earlier one. The kept detections give
the labels and the score, the best of theirs.

Only built-in functions are used, row by row, so nothing is shuffled.

Defined cases: a null text is empty and has no license; repeated rows get equal
results; an empty table gives none.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower

# The base phrases of the result contract and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licenses by label: keyword, then name as it appears in words. Versions follow
# from the second table; specific names stand before general ones.
NAMES = {
    "agpl": ("affero general public", r"(?:gnu )?affero general public licen[cs]e"),
    "lgpl": ("lesser general public", r"(?:gnu )?lesser general public licen[cs]e"),
    "lgpl-library": ("library general public", r"(?:gnu )?library general public licen[cs]e"),
    "gfdl": ("free documentation", r"(?:gnu )?free documentation licen[cs]e"),
    "gpl": ("gnu", r"gnu (?:general public licen[cs]e|gpl)"),
    "apache": ("apache", r"apache (?:software )?licen[cs]e"),
    "mit": ("mit", r"(?:mit|mit x11) licen[cs]e"),
    "mit-0": ("no attribution", r"mit no attribution licen[cs]e"),
    "isc": ("isc", r"isc licen[cs]e"),
    "bsd-2-clause": ("bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd) licen[cs]e"),
    "bsd-3-clause": ("bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e"),
    "bsd-4-clause": ("bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd) licen[cs]e"),
    "bsd-0-clause": ("bsd", r"(?:zero clause bsd|bsd zero clause) licen[cs]e"),
    "bsd": ("bsd", r"bsd(?: style)? licen[cs]e"),
    "mpl": ("mozilla public", r"mozilla public licen[cs]e"),
    "epl": ("eclipse public", r"eclipse public licen[cs]e"),
    "edl": ("eclipse distribution", r"eclipse distribution licen[cs]e"),
    "cddl": ("development and distribution", r"common development and distribution licen[cs]e"),
    "cpl": ("common public", r"common public licen[cs]e"),
    "cpal": ("public attribution", r"common public attribution licen[cs]e"),
    "eupl": ("european union public", r"european union public licen[cs]e"),
    "ms-pl": ("microsoft public", r"microsoft public licen[cs]e"),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    "artistic": ("artistic", r"(?:perl )?artistic licen[cs]e"),
    "zlib": ("zlib", r"zlib(?: libpng)? licen[cs]e"),
    "boost": ("boost", r"boost software licen[cs]e"),
    "unlicense": ("unlicense", r"(?:the )?unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl"),
    "ofl": ("open font", r"(?:sil )?open font licen[cs]e"),
    "odbl": ("database", r"open (?:data commons open )?database licen[cs]e"),
    "odc-by": ("data commons attribution", r"open data commons attribution licen[cs]e"),
    "pddl": ("domain dedication", r"public domain dedication and licen[cs]e"),
    "psf": ("python software", r"python software foundation licen[cs]e"),
    "php": ("php", r"php licen[cs]e"),
    "openssl": ("openssl", r"openssl licen[cs]e"),
    "postgresql": ("postgresql", r"postgresql licen[cs]e"),
    "ncsa": ("illinois", r"university of illinois ncsa open source licen[cs]e"),
    "osl": ("open software", r"open software licen[cs]e"),
    "afl": ("academic free", r"academic free licen[cs]e"),
    "ecl": ("educational community", r"educational community licen[cs]e"),
    "busl": ("business source", r"business source licen[cs]e"),
    "sspl": ("server side public", r"server side public licen[cs]e"),
    "elastic": ("elastic", r"elastic licen[cs]e"),
    "cecill": ("cecill", r"cecill(?: [bc])?(?: free software)? licen[cs]e"),
    "qpl": ("q public", r"q public licen[cs]e"),
    "upl": ("universal permissive", r"universal permissive licen[cs]e"),
    "lppl": ("latex project", r"latex project public licen[cs]e"),
    "cc0": ("cc0", r"cc0"),
    "cc-by-nc-sa": ("cc by nc sa", r"cc by nc sa"),
    "cc-by-nc-nd": ("cc by nc nd", r"cc by nc nd"),
    "cc-by-nc": ("cc by nc", r"cc by nc"),
    "cc-by-nd": ("cc by nd", r"cc by nd"),
    "cc-by-sa": ("cc by sa", r"cc by sa"),
    "cc-by": ("cc by", r"cc by"),
}
SPELLED = {
    "cc0": r"creative commons zero",
    "cc-by-nc-sa": r"creative commons (?:by nc sa|attribution non ?commercial share ?alike)",
    "cc-by-nc-nd": r"creative commons (?:by nc nd|attribution non ?commercial no ?derivatives)",
    "cc-by-nc": r"creative commons (?:by nc|attribution non ?commercial)",
    "cc-by-nd": r"creative commons (?:by nd|attribution no ?derivatives)",
    "cc-by-sa": r"creative commons (?:by sa|attribution share ?alike)",
    "cc-by": r"creative commons (?:by|attribution)",
}
# Names without the keyword of their label above, each with its own.
OTHER_NAMES = {
    "mit": ("expat", r"expat licen[cs]e"),
    "bsd-2-clause": ("freebsd", r"freebsd licen[cs]e"),
    "bsd-0-clause": ("0bsd", r"0bsd licen[cs]e"),
}
VERSIONS = {
    "agpl": ("3", "1"),
    "lgpl": ("3", "2 1"),
    "lgpl-library": ("2",),
    "gfdl": ("1 3", "1 2", "1 1"),
    "gpl": ("3", "2", "1"),
    "apache": ("2 0", "1 1", "1 0"),
    "mpl": ("2 0", "1 1", "1 0"),
    "epl": ("2 0", "1 0"),
    "cddl": ("1 1", "1 0"),
    "cpl": ("1 0",),
    "eupl": ("1 2", "1 1", "1 0"),
    "artistic": ("2 0", "1 0"),
    "boost": ("1 0",),
    "ofl": ("1 1", "1 0"),
    "odbl": ("1 0",),
    "php": ("3 01", "3 0"),
    "osl": ("3 0", "2 1", "2 0", "1 0"),
    "afl": ("3 0", "2 1", "2 0", "1 2"),
    "ecl": ("2 0", "1 0"),
    "busl": ("1 1",),
    "elastic": ("2 0",),
    "cc0": ("1 0",),
    **{
        label: ("4 0", "3 0", "2 5", "2 0", "1 0")
        for label in ("cc-by-nc-sa", "cc-by-nc-nd", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by")
    },
}
# Sentences of license texts themselves: label, keyword, words, score.
TEXTS = (
    ("mit", "person obtaining", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("isc", "without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 1.0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 0.9),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products", 0.9),
    ("gpl", "you can redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1.0),
    ("lgpl", "lesser", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", 1.0),
    ("apache", "compliance", r"you may not use this file except in compliance with the licen[cs]e", 0.9),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e", 1.0),
    ("zlib", "without any express", r"this software is provided as is without any express or implied warranty in no event", 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("boost", "organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy", 1.0),
    ("wtfpl", "you want to public", r"do what the fuck you want to public licen[cs]e", 1.0),
    ("proprietary", "is proprietary", r"all rights reserved this software is proprietary", 0.6),
    ("public-domain", "public domain", r"(?:dedicated|released) (?:in)?to the public domain", 0.8),
)
GRANT = r"(?:licen[cs]ed|released|distributed|published|made available|available|provided|shared) under (?:the )?(?:terms of (?:the )?)?"
# Words of a text whose letters are not yet lower-cased.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# No rule matches a text without one of these.
HINT = (
    r"(?i:licen[cs]e|cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by|cc0|commons|gpl|wtfpl|permission|redistribution"
    r"|endorse|software|public[\x00-\x2F\x3A-\x60\x7B-\x7F]+domain)"
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    score: float


def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: sentences, grants, tags, names; versions before none."""
    named: list[tuple[str, str, str, float]] = []
    spelled = [(label, ("creative commons", name)) for label, name in SPELLED.items()]
    for label, (keyword, name) in [*NAMES.items(), *OTHER_NAMES.items(), *spelled]:
        for version in VERSIONS.get(label, ()):
            numbers = rf"{name}(?: version)? (?:v ?)?{version}(?: 0)?"
            tail = "-".join((label, version.replace(" ", ".")))
            named.append((tail, keyword, f"{numbers} or (?:any )?later(?: version)?", 0.1))
            named.append((tail, keyword, numbers, 0.1))
        named.append((label, keyword, name, 0.0))
    tags = dict.fromkeys((label, label.replace("-", " ").replace(".", " ")) for label, *_ in named)
    return tuple(
        dict.fromkeys(
            [Rule(label, keyword, words, score) for label, keyword, words, score in TEXTS]
            + [Rule(label, keyword, GRANT + words, round(0.9 + more, 1)) for label, keyword, words, more in named]
            + [Rule(label, "spdx", f"spdx license identifier {tag}", 1.0) for label, tag in tags]
            + [Rule(label, keyword, words, round(0.7 + more, 1)) for label, keyword, words, more in named]
        )
    )


def normal_words(text: Column) -> Column:
    """The words, each between single blanks, the first and last blank included."""
    blanks = F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(blanks), F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def detections(words: Column, ordered: tuple[Rule, ...]) -> Column:
    """All detections: start and end word (exclusive), rule number, sorted by start and then size."""
    listed = [
        {"rule": number, "keyword": f" {rule.keyword} ", "pattern": _whole(rule.pattern)}
        for number, rule in enumerate(ordered)
    ]
    # A constant of the plan; JSON only carries it there in one piece.
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<rule:int,keyword:string,pattern:string>>")

    def places(rule: Column) -> Column:
        parts = F.arrays_zip(
            F.split(words, rule["pattern"], -1).alias("before"),
            F.regexp_extract_all(words, rule["pattern"], F.lit(0)).alias("match"),
        )

        def step(state: Column, part: Column) -> Column:
            start = state["at"] + _blanks(part["before"])
            end = start + _blanks(part["match"])
            # Sorting by the negated end puts the larger interval first.
            found = F.struct((start - 1).alias("start"), (-end).alias("minus_end"), rule["rule"].alias("rule"))
            return F.struct(
                F.coalesce(end, start).alias("at"),
                F.when(part["match"].isNotNull(), F.array_append(state["found"], found))
                .otherwise(state["found"])
                .alias("found"),
            )

        empty = F.array().cast("array<struct<start:int,minus_end:int,rule:int>>")
        first = F.struct(F.lit(0).alias("at"), empty.alias("found"))
        return F.aggregate(parts, first, step, lambda state: state["found"])

    gated = F.filter(table, lambda rule: F.contains(words, rule["keyword"]))
    return F.array_sort(F.flatten(F.transform(gated, places)))


def kept(found: Column) -> Column:
    """``found`` without intervals that lie in another one: in sorted order, one that ends before or with an earlier."""

    def step(state: Column, one: Column) -> Column:
        outside = one["minus_end"] < state["minus_end"]
        return F.struct(
            F.least(state["minus_end"], one["minus_end"]).alias("minus_end"),
            F.when(outside, F.array_append(state["kept"], one)).otherwise(state["kept"]).alias("kept"),
        )

    empty = F.array().cast("array<struct<start:int,minus_end:int,rule:int>>")
    first = F.struct(F.lit(1).alias("minus_end"), empty.alias("kept"))
    return F.aggregate(found, first, step, lambda state: state["kept"])


def scanned(documents: DataFrame, ordered: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, n_words, words (null without a hint) and found: start, minus_end, rule of the kept detections."""
    ordered = ordered or rules()
    text = F.coalesce(F.col("text"), F.lit(""))
    n_words = F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words")
    hinted = documents.select("doc_id", n_words, F.when(text.rlike(HINT), text).alias("text"))
    worded = hinted.select(
        "doc_id", "n_words", F.when(F.col("text").isNotNull(), normal_words(F.col("text"))).alias("words")
    )
    words = F.col("words")
    found = F.when(words.isNotNull(), kept(detections(words, ordered)))
    return worded.select("doc_id", "n_words", "words", found.alias("found"))


def op2_license_scans(spark, sf_dir: str) -> DataFrame:
    ordered = rules()
    scan = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"), ordered)
    words = F.col("words")
    pieces = {phrase: F.split(words, _whole(phrase), -1) for phrase in BASE}
    count = {
        phrase: F.when(words.isNotNull(), F.size(pieces[phrase]) - 1).otherwise(0) for phrase in BASE
    }
    first, last = [], []
    for phrase, parts in pieces.items():
        held = count[phrase] > 0
        first.append(F.when(held, _blanks(F.element_at(parts, 1)) - 1))
        size = len(phrase.split())
        last.append(F.when(held, _blanks(words) - _blanks(F.element_at(parts, -1)) - size))
    base = F.filter(
        F.array(*(F.when(count[phrase] > 0, F.lit(label)) for phrase, label in BASE.items())), F.isnotnull
    )
    labels = F.from_json(F.lit(json.dumps([rule.label for rule in ordered])), "array<string>")
    scores = F.from_json(F.lit(json.dumps([rule.score for rule in ordered])), "array<double>")
    own = F.transform("found", lambda d: F.get(labels, d["rule"]))
    best = F.array_max(F.transform("found", lambda d: F.get(scores, d["rule"])))
    none = F.array().cast("array<string>")
    return scan.select(
        "doc_id",
        "n_words",
        reduce(Column.__add__, count.values()).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce(own, none))), ",").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
