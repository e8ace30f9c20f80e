"""Texts and items of as many words as make a shingle's length less two."""

import numpy as np

from textloom.llm import decontam, neardup
from textloom.llm.sketch import rolling


def test_rolling_of_fewer_values_than_k():
    for n in range(5):
        assert len(rolling(np.arange(n, dtype=np.uint64), 5)) == 0
    assert len(rolling(np.arange(5, dtype=np.uint64), 5)) == 1


def test_three_words(spark):
    docs = spark.createDataFrame([(1, "One two, three")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, "one two three"), (8, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    more = spark.createDataFrame([(2, "say one two three"), (3, "one three two"), (1, "One two, three")], "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in decontam.contaminated_documents(docs, items).collect()] == [(1, 3, 3, ["7"], 1, True)]
    got = sorted(tuple(r) for r in decontam.contaminated_documents(more, items).collect())
    assert got == [(1, 3, 3, ["7"], 1, True), (2, 4, 3, ["7"], 1, True), (3, 3, 0, [], 0, False)]
    assert [tuple(r) for r in neardup.near_duplicates(docs).collect()] == [(1, 1, 1, True)]
