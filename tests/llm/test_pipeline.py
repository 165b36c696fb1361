from __future__ import annotations

import importlib.util
from pathlib import Path

from test_bpe import row_by_library, rows
from test_decontaminate import brute as contaminated
from test_near_copies import brute_groups
from test_secrets import op as secrets
from test_secrets import spans_of

from shelfmark.llm.simhash import near_duplicates
from shelfmark.llm.toxicity import scored, trained

ROOT = "/root/testdata/sf0.01"
_spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).parents[2] / "corpus_pipeline.py")
pipeline = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(pipeline)


def redacted(text):
    out, at = [], 0
    for a, _, b in spans_of(text, (*secrets.BASE, *secrets.MORE)):
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    return "".join(out) + text[at:]


def test_stages():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "bpe_encoding"]


def test_run_equals_brute_force(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").select("item_id", "text").collect()]
    model = trained(documents, spark.read.parquet(f"{ROOT}/labels.parquet"))
    toxic = {r["doc_id"] for r in scored(documents, model).where("toxic").collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    kept = {d: t for d, t in texts.items() if d not in toxic}
    ids = sorted(kept)
    groups, pairs = brute_groups([kept[d] for d in ids])
    firsts = {d for k, d in enumerate(ids) if groups[k] == k}
    kept = {d: t for d, t in kept.items() if d in firsts}
    hit = {row[0] for row in contaminated(list(kept.items()), items) if row[5]}
    assert toxic and pairs and len(firsts) < len(texts) - len(toxic) and hit
    expected = sorted((row_by_library(d, redacted(t)) for d, t in kept.items() if d not in hit), key=repr)
    assert rows(pipeline.run(spark, ROOT)) == expected


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(100)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, ROOT).columns == docs.columns
        assert stage(spark, docs.limit(0), ROOT).count() == 0


def test_stages_over_odd_rows(spark, tmp_path):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = [
        (1, f"some words and {key} here", None, "s", 30, "x", 1, True),
        (1, f"some words and {key} here", None, "s", 30, "x", 1, True),
        (2, "one two three four five six seven", "en", None, None, None, 2, None),
        (3, "one two three four five six seven", "en", "s", 33, "y", 3, False),
        (None, None, None, None, None, None, None, None),
        (None, "no id " * 3, "en", "s", 1, "z", 4, True),
        (4, "", "en", "s", 0, "z", 5, True),
        (5, "long " * 40000 + "passage of the benchmark", "en", "s", 1, "z", 6, True),
    ]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _lost string, _place int, _spans boolean"
    docs = spark.createDataFrame(rows, kinds)
    spark.createDataFrame([(1, "passage of the benchmark"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "bpe_encoding":
            assert docs.columns == [part.split()[0] for part in kinds.split(", ")]
            docs = spark.createDataFrame(docs.collect(), kinds)
            if name == "toxicity":
                assert docs.count() == len(rows)
            if name == "near_dedup":
                # Null and blank texts share fingerprint zero; rows without an id always stay.
                assert sorted((r["doc_id"] for r in docs.collect()), key=repr) == [1, 2, 4, 5, None, None]
            if name == "decontamination":
                assert sorted((r["doc_id"] for r in docs.collect()), key=repr) == [1, 2, 4, None, None]
            if name == "secret_scan":
                (row,) = docs.where("doc_id = 1").collect()
                assert (row["text"], row["n_chars"], row["_lost"]) == ("some words and [SECRET] here", 28, "x")
    assert docs.count() == 5


def test_near_dedup_follows_simhash_links(spark):
    """Texts whose fingerprints are near stay together though their five-word sets are not alike."""
    tails = [" ".join(f"{name}{n}" for n in range(8)) for name in "ab"]
    rows = [
        (3, "long " * 400 + tails[0]),
        (1, "long " * 400 + tails[1]),
        (2, tails[0]),
        (None, "long " * 400 + tails[1]),
        (4, None),
        (5, " "),
        (1, "another text under a used number"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fingerprints = {r["doc_id"]: r["fp"] for r in near_duplicates(docs.where("doc_id in (2, 3)")).collect()}
    assert len(set(fingerprints.values())) == 2
    groups, _ = brute_groups([text for _, text in rows[:2]])
    assert groups == [0, 1]  # not near by five-word similarity
    stay = sorted((tuple(r) for r in pipeline.near_dedup(spark, docs, ROOT).collect()), key=repr)
    assert stay == sorted((rows[i] for i in (1, 2, 3, 4, 6)), key=repr)
