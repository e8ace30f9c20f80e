"""Line dedup as op9_line_dedup and the pipeline call it."""

import inspect
import random

import corpus_pipeline
from textloom.llm import linededup
from textloom.llm.sketch import band_keys, fast_similarity_sketch


def _left(spark, texts):
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    return {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}


def test_short_lines_are_compared_for_equality(spark):
    got = _left(spark, ["Yes.\n\n yes.\nno", "\nYES.\t\nNo\n\nYes!", "é", "É\né"])
    assert got == {0: "Yes.\n\nno", 1: "\n\nYes!", 2: "é", 3: "É"}


def test_one_replaced_character_links_lines_of_seventy(spark):
    line = "seventy characters with one replaced in the middle are 7-shingle kin.."
    assert len(line) == 70
    other = line[:35] + "#" + line[36:]
    assert _left(spark, [line, other, line[:50], line[:25] + "#" + line[26:50]]) == {0: line, 2: line[:50], 3: line[:25] + "#" + line[26:50]}


def test_pairs_at_the_threshold_share_a_band():
    chosen = {n: p.default for n, p in inspect.signature(linededup.dedup_lines).parameters.items()}
    r, k, bands, rows = random.Random(5), chosen["k"], chosen["bands"], chosen["rows"]
    one = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(69)) for _ in range(4000)]
    two = [x[:34] + "#" + x[35:] for x in one]
    keys = [band_keys(fast_similarity_sketch(*linededup._shingles([x.encode() for x in lines], k), len(lines), bands * rows), rows) for lines in (one, two)]
    sets = [[{x[i : i + k] for i in range(len(x) - k + 1)} for x in lines] for lines in (one, two)]
    assert all(len(x & y) == 56 and len(x | y) == 70 for x, y in zip(*sets, strict=True))
    assert int((keys[0] != keys[1]).all(axis=1).sum()) == 0
