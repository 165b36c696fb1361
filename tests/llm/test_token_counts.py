from __future__ import annotations

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import token_counts as op

ROOT = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(op.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTER = op.Counter(PATH, kept=50)


def expected(doc, text):
    n = len(LIBRARY.encode(text or ""))
    return doc, len((text or "").encode()), n, n > 4096


def rows(df):
    return sorted((tuple(row) for row in df.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr)


def test_query_equals_library(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    assert rows(op.op10_token_counts(spark, ROOT)) == sorted((expected(*r) for r in documents), key=repr)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("   theaionr▁<s>\n\t 漢é")), max_size=40), max_size=4))
def test_counts_equal_library(texts):
    assert COUNTER.counts(texts) == [len(LIBRARY.encode(text)) for text in texts]


@given(st.text("theronsaid  ", max_size=60))
def test_heap_equals_rounds(text):
    symbols = COUNTER.merges.symbols(text)
    assert op.long_count(list(symbols), COUNTER.merges) == op.merged_counts([symbols], COUNTER.merges).tolist()[0]


def test_odd_rows(spark):
    texts = [(1, "a b"), (1, "a b"), (None, "x" * 5000), (2, None), (3, ""), (4, "   "), (5, "the " * 30000), (6, "<s></s><0x0A>\0"), (7, "ab" * 40000)]
    odd = spark.createDataFrame([(*r, 1) for r in texts], "doc_id long, text string, n_tokens int")
    assert rows(op.token_counts(odd, PATH)) == sorted((expected(*r) for r in texts), key=repr)
    assert op.token_counts(odd.limit(0), PATH).count() == 0
