from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import bpe as op

ROOT = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(op.MODEL)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
WORDS = op.Words(PATH)


def by_library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def row_by_library(doc, text):
    ids, decoded = by_library(text)
    packed = np.array(ids, "<u4").tobytes()
    return doc, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def rows(df):
    return sorted((tuple(row[n] for n in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for row in df.collect()), key=repr)


def test_query_equals_library(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    assert rows(op.op6_bpe_round_trip(spark, ROOT)) == sorted((row_by_library(*r) for r in documents), key=repr)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA'sStTrRvVeEmMlLdD  \t\n\x1c\x85\xa0é́İΣ9²½_-!")), max_size=30))
def test_words_equal_library(text):
    assert [k for word in WORDS.split(text) for k in WORDS.ids(word)] == by_library(text)[0]


@given(st.lists(st.integers(0, (1 << 21) - 1), max_size=50))
def test_places_round_trip(numbers):
    packed, sizes = op.packed_places(np.array(numbers, np.int32))
    found, ends = op.unpacked_places(packed)
    assert found.tolist() == numbers
    assert (ends + 1).tolist() == np.cumsum(sizes).tolist()


TEXTS = [
    (1, "It's <|startoftext|>HELLO<|endoftext|>  World's 123 ½ Ünï"),
    (1, "It's <|startoftext|>HELLO<|endoftext|>  World's 123 ½ Ünï"),
    (None, "ΣΑΣ ΟΔΟΣ İstanbul 漢字 é"),
    (2, None),
    (3, ""),
    (4, " \n\t"),
    (5, "wordy " * 20000 + "x" * 3000),
]


@pytest.mark.parametrize("head_words", [1, 3, 1 << 18])
def test_odd_rows_with_any_table_of_frequent_words(spark, head_words):
    odd = spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id long, text string, version string")
    assert rows(op.digests(odd, PATH, head_words)) == sorted((row_by_library(*r) for r in TEXTS), key=repr)
    both = op.round_trip(odd, PATH, head_words).collect()
    expected = sorted((d, *by_library(t)) for d, t in TEXTS if d)
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in both if r["doc_id"]) == expected
    ids = op.encoded(odd, PATH, head_words)
    assert sorted((r["doc_id"], r["text"]) for r in op.decoded(ids, PATH).collect() if r["doc_id"]) == [(d, t) for d, _, t in expected]


def test_empty_table(spark):
    assert op.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
