"""Targets and rates of mixes with several constraints and many sources."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing


def _targets(sizes, share=1.5, weights=(3, 1, 2), most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full = {s: weights[i % 3] for i, s in enumerate(order)}, set()
    while True:
        left, w = share * sum(sizes.values()) - sum(most * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        out = {s: most * sizes[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets_of_many_sources(spark):
    r = random.Random(5)
    for n in (1, 2, 7, 150):
        sizes = {(f"s{i}" if i else None): int(10 ** r.uniform(0, 5)) for i in range(n)}
        sizes["ä"], sizes["Z"] = 0, 3
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x.source: x.target for x in mixing.token_targets(df).collect()}
        want = _targets(sizes)
        assert set(got) == set(want)
        for s, t in want.items():
            assert got[s] == pytest.approx(t, rel=1e-9, abs=1e-9)
    assert mixing.token_targets(df.limit(0)).count() == 0


@pytest.mark.parametrize("joint", [True, False])
def test_two_constraints_at_once(spark, monkeypatch, joint):
    """Both columns' totals come out, rates are products of a factor of either value, and what has no target gets nothing."""
    if not joint:
        monkeypatch.setattr(mixing, "JOINT", 0)
    r = random.Random(3)
    cells = [(s, x, float(r.randint(50, 5000))) for s in ("a", "b", "c", None, "none") for x in ("en", "de", "fr")]
    df = spark.createDataFrame(cells, "source string, lang string, tokens double")
    by = lambda i: {k: sum(c[2] for c in cells if c[i] == k and c[0] != "none") for k in {c[i] for c in cells} - {"none"}}
    sources = {k: v * f for (k, v), f in zip(sorted(by(0).items(), key=str), (0.5, 1.7, 1.0, 0.8), strict=True)}
    langs = {k: v * f for (k, v), f in zip(sorted(by(1).items()), (1.5, 0.4, 1.0), strict=True)}
    scale = sum(sources.values()) / sum(langs.values())
    langs = {k: v * scale for k, v in langs.items()}
    targets = {"source": spark.createDataFrame(list(sources.items()), "source string, target double"), "lang": spark.createDataFrame(list(langs.items()), "lang string, target double")}
    got = mixing.balance_rates(df, targets, tolerance=1e-8, max_rounds=100).collect()
    rate = {(g.source, g.lang): g.rate for g in got}
    assert len(got) == len(cells) and all(rate["none", x] == 0 for x in ("en", "de", "fr"))
    for i, want in ((0, sources), (1, langs)):
        for k, t in want.items():
            assert sum(c[2] * rate[c[0], c[1]] for c in cells if c[i] == k) == pytest.approx(t, rel=1e-6)
    for s in ("b", "c", None):  # the tilt has no term of both values
        assert rate["a", "en"] * rate[s, "de"] == pytest.approx(rate["a", "de"] * rate[s, "en"], rel=1e-5)


def test_a_mix_of_repeated_and_clashing_rows(spark):
    rows = [(1, "a b c", "s", 7, "x")] * 3 + [(2, None, None, 7, "x"), (3, "", "t", 7, "x"), (None, "d e", "t", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, part string")
    got = mixing.mix_sources(df).collect()
    assert sorted((str(g.doc_id), g.size, g.source_size) for g in got) == [("1", 3, 9)] * 3 + [("2", 0, 0), ("3", 0, 2), ("None", 2, 2)]
    assert all(0 <= g.taken <= 2 * g.size for g in got) and sum(g.taken for g in got if g.doc_id == 1) in (12, 15)
    assert mixing.mix_sources(df.where(F.lit(False))).count() == 0
