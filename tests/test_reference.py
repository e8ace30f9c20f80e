"""Every query with SQL gives what DuckDB gives on the smallest data; properties that hold for any text."""

import os
import random
import unicodedata
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom import queries as q
from textloom.functions import bidi
from textloom.functions import identity as ident
from textloom.functions import linebreak
from textloom.functions import properties as props
from textloom.functions import session
from textloom.functions import text as tx

DATA = "/root/testdata/sf0.001"
LARGE = {"codepoint_valid_plane", "codepoint_hangul", "codepoint_cjk", "codepoint_encode"}  # the driver compares these


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(q.ORACLES) - LARGE))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in "nation customer documents pages conversations".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    r = c.execute(q.ORACLES[name])
    cols = [x[0] for x in r.description]
    df = q.QUERIES[name](spark, DATA)
    assert sorted(cols) == sorted(df.columns)
    assert Counter(map(tuple, df.select(cols).collect())) == Counter(r.fetchall())


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_segments_join_to_the_text(t):
    for kind in ("grapheme", "word", "sentence"):
        assert "".join(tx.segments_str(t, kind)) == t


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_folds_are_stable(t):
    once = tx.nfkc_casefold_str(t)
    assert tx.nfkc_casefold_str(once) == once
    if tx.quick_check_str(t, "NFC") == "YES":
        assert unicodedata.normalize("NFC", t) == t
    assert ident.caseless_key_str(t, "canonical") == ident.caseless_key_str(unicodedata.normalize("NFD", t), "canonical")


@settings(max_examples=200, deadline=None)
@given(st.binary())
def test_decoding_never_fails(b):
    for e in ("UTF-8", "UTF-16LE", "UTF-32BE"):
        tx.decode_bytes(b, e).encode("utf-8", "replace")


def test_linker_of_unicode_18():
    assert len(tx.segments_str("्̀क", "grapheme")) == 1
    assert len(tx.segments_str("A\r\nB", "grapheme")) == 3


def test_bidi_levels_are_those_of_icu(spark):
    """ICU skips the rules for texts of one direction, so only mixed ones are compared."""
    _, brackets = bidi.pairs()
    rnd, some = random.Random(7), 0
    alphabet = "ab\u05d0\u05d1\u063912\u0663+,.$%() []<\t\u0300\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u200f \xad"
    for _ in range(600):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 14)))
        for direction, level in (("LTR", 0), ("RTL", 1), ("AUTO", 126)):
            icu = spark._jvm.com.ibm.icu.text.Bidi()
            icu.setPara(t, level, None)
            if icu.getDirection() == 2:
                base, levels, _ = bidi.resolve_levels(t, direction, brackets)
                assert base == icu.getParaLevel()
                assert all(a in (-1, b) for a, b in zip(levels, icu.getLevels(), strict=True)), ascii(t)
                some += 1
    assert some > 500


def test_line_breaks_are_those_of_icu(spark):
    """Without word-initial hyphens before letters, where the installed ICU has an older rule than the properties."""
    jvm, rnd = spark._jvm, random.Random(3)
    icu = jvm.com.ibm.icu.text.BreakIterator.getLineInstance(jvm.java.util.Locale.ROOT)
    alphabet = [*"ab1 2,.()[]!?/%$«»\"“”‘’\n\r é　中文「」。ァ…​⁠ ́‍—가각①⌚￼", "\U0001F1E6", "\U0001F466", "\U0001F3FD", "\u1b05", "\u1b44", "\ua98f", "\ua9c0", "\u25cc"]
    for _ in range(2000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9)))
        icu.setText(t)
        want = []
        while (b := icu.next()) != -1:
            want.append(len(t.encode("utf-16-le")[: 2 * b].decode("utf-16-le")))
        assert [x["at"] for x in linebreak.line_breaks_str(t)] == want, ascii(t)


def test_session(spark):
    assert session.get_locale(spark) == "en"
    session.set_locale(spark, "tr")
    with pytest.raises(ValueError):
        session.set_locale(spark, "a-DE")
    assert session.get_locale(spark) == "tr"
    session.reset_locale(spark)
    assert session.get_locale(spark) == "en"
    assert session.version_number() == 0x10 and session.version() == "0.1.0"


def test_property_ranges_cover_the_code_space(spark):
    assert props.property_name("lb") == "Line_Break" and props.property_name("no such thing") == "Unknown"
    for prop in ("Block", "Script", "East_Asian_Width", "Line_Break", "Canonical_Combining_Class"):
        rs = props.enumerated_ranges(prop)
        assert rs[0][0] == 0 and rs[-1][1] == 0x10FFFF and all(a[1] + 1 == b[0] for a, b in zip(rs, rs[1:], strict=False))
