import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import tokens as K


@pytest.fixture(scope="module")
def counter():
    return K.Counter.of(K.VOCABULARY)


ALPHABET = " \n\t\r'stmdrevlLA12²éЖ中　 \x85\x1c‍\U0001f600.,-_﻿"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), max_size=8))
def test_equals_the_library(texts):
    c = K.Counter.of(K.VOCABULARY)
    assert c.count(texts).tolist() == [len(c.encoding.encode_ordinary(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    c = K.Counter.of(K.VOCABULARY)
    assert c.count([text]).tolist() == [len(c.encoding.encode_ordinary(text))]


def test_edges(counter, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 100)
    texts = [None, "", "x", " " * 1000, "word " * 500, "a" * 30_000, "don't we'll I'M", None]
    want = [len(counter.encoding.encode_ordinary(t or "")) for t in texts]
    assert counter.count(texts).tolist() == want
    assert counter.count([]).tolist() == []


def test_cache_collisions(counter):
    rng = np.random.default_rng(0)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(30_000)]
    want = [len(counter.encoding.encode_ordinary(t)) for t in texts]
    assert counter.count(texts).tolist() == want
    assert counter.count(texts[::-1]).tolist() == want[::-1]


def test_table(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9)], "doc_id bigint, text string, tokens int")
    assert sorted(map(tuple, K.with_tokens(df, {"doc_id": F.col("doc_id")}, "text").collect())) == [(1, 2), (2, None), (3, 0)]
    assert K.with_tokens(df.filter("doc_id > 9"), {"doc_id": F.col("doc_id")}, "text").count() == 0
