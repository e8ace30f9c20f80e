"""Registered queries of the text functions, and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bidi, hosts
from .functions import codepoints as cp
from .functions import collation as coll
from .functions import identity as ident
from .functions import linebreak as lb
from .functions import properties as pr
from .functions import security as sec
from .functions import session as ses
from .functions import text as tx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _space(spark: SparkSession) -> DataFrame:
    return spark.range(0, 0x110000).select(F.col("id").cast("int").alias("cp"))


def _decomposed(col: str) -> str:
    """DuckDB: the Latin-1 letters of a column decomposed, letter by letter."""
    out = col
    for c in range(0xC0, 0x100):
        d = unicodedata.normalize("NFD", chr(c))
        if d != chr(c):
            out = f"replace({out},chr({c}),'{d[0]}'||chr({ord(d[1])}))"
    return out


#: Characters put in for others, and DuckDB's text after their compatibility decomposition.
_COMPATIBLE = (("xkq27", "ﬁＫ㎞²Ⅷ"), "replace(replace(replace(replace(replace(text,'7','VIII'),'x','fi'),'k','K'),'q','km'),'2','2')")

_WORDS = r"""len(list_filter(regexp_extract_all(text,'(?:\p{L}(?:[.:''’·]\p{L})*|\p{Nd}(?:[.,;''’]\p{Nd})*|_)+'), lambda x: regexp_matches(x,'[\p{L}\p{Nd}]')))"""
_CODESPACE = "(SELECT CAST(range AS INTEGER) AS cp FROM range(1114112))"


@_query(f"SELECT lang, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(length(text)) AS BIGINT) AS n_codepoints, CAST(sum(length_grapheme(text)) AS BIGINT) AS n_graphemes, CAST(sum({_WORDS}) AS BIGINT) AS n_words FROM documents GROUP BY lang")
def text_profile_by_lang(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"), F.sum(F.char_length("text").cast("long")).alias("n_codepoints"), F.sum(tx.grapheme_count("text")).alias("n_graphemes"), F.sum(tx.word_count("text")).alias("n_words"))


@_query(f"SELECT doc_id, CAST({_WORDS} AS BIGINT) AS n_words FROM documents")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.word_count("text").alias("n_words"))


@_query(f"SELECT doc_id, md5({_decomposed('text')}) AS digest, CAST(length({_decomposed('text')}) AS BIGINT) AS n FROM documents")
def normalize_nfd(spark, sf_dir):
    out = _docs(spark, sf_dir).select("doc_id", tx.normalize("text", "NFD").alias("t"))
    return out.select("doc_id", F.md5("t").alias("digest"), F.char_length("t").cast("long").alias("n"))


@_query(f"SELECT doc_id, md5(nfc_normalize({_decomposed('text')})) AS digest FROM documents")
def normalize_nfc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.normalize(tx.normalize("text", "NFD"), "NFC")).alias("digest"))


@_query(f"SELECT doc_id, md5(nfc_normalize({_COMPATIBLE[1]})) AS kc, md5({_decomposed(_COMPATIBLE[1])}) AS kd FROM documents")
def normalize_nfkc(spark, sf_dir):
    """Compatibility forms of texts with ligatures, full-width letters and superscripts put in."""
    t = F.translate("text", *_COMPATIBLE[0])
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.normalize(t, "NFKC")).alias("kc"), F.md5(tx.normalize(t, "NFKD")).alias("kd"))


@_query("SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN 'OK' ELSE 'OUTPUT_TOO_SMALL' END AS status, CAST(strlen(nfc_normalize(text)) AS BIGINT) AS size, CASE WHEN strlen(text) <= 1000 THEN md5(text) END AS digest FROM documents")
def normalize_into(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", tx.normalize_into(tx.normalize("text", "NFD"), "NFC", 1000).alias("r"))
    return d.select("doc_id", "r.status", "r.size", F.md5("r.output").alias("digest"))


@_query(f"SELECT doc_id, CAST(length_grapheme({_decomposed('text')}) AS BIGINT) AS n FROM documents")
def grapheme_count_nfd(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.grapheme_count(tx.normalize("text", "NFD")).alias("n"))


@_query(f"SELECT doc_id, CASE WHEN {_decomposed('text')} = text THEN 'YES' ELSE 'MAYBE' END AS nfc, CASE WHEN {_decomposed('text')} = text THEN 'YES' ELSE 'NO' END AS nfd FROM documents")
def quick_check(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.quick_check(tx.normalize("text", "NFD"), "NFC").alias("nfc"), tx.quick_check("text", "NFD").alias("nfd"))


@_query("SELECT doc_id, md5(upper(replace(text,'ß','SS'))) AS up, md5(lower(text)) AS low FROM documents")
def map_case_upper_lower(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.map_case("text", "upper")).alias("up"), F.md5(tx.map_case("text", "lower")).alias("low"))


@_query("SELECT conv_id, turn, md5(lower(replace(text,'ß','ss'))) AS fold, md5(lower(text)) AS simple FROM conversations")
def map_case_fold(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.map_case("text", "casefold")).alias("fold"), F.md5(tx.map_case("text", "casefold_simple")).alias("simple"))


@_query("SELECT doc_id, md5(nfc_normalize(lower(replace(text,'ß','ss')))) AS digest FROM documents")
def nfkc_casefold(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.nfkc_casefold("text")).alias("digest"))


@_query(r"SELECT doc_id, md5(regexp_replace(text,'[\t\n\v\f\r ]','  ','g')) AS widened, md5(regexp_replace(text,'[\t\n\v\f\r ]+',' ','g')) AS collapsed, md5(regexp_replace(text,'[\x00-\x08\x0E-\x1F\x7F]','','g')) AS printable FROM documents")
def filter_flags(spark, sf_dir):
    wide = F.regexp_replace("text", r"[\t-\r ]", "  ")
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.filter_text(wide, spaces=True)).alias("widened"), F.md5(tx.filter_text(wide, spaces=True, collapse=True)).alias("collapsed"), F.md5(tx.filter_text("text", controls=True)).alias("printable"))


@_query("SELECT doc_id, md5(translate(text, 'abc', 'xyz')) AS digest, md5(regexp_replace(text, '([éèêäöüñóíáàçâîôû])', '\\1́́́', 'g')) AS marks FROM documents")
def filter_numeric(spark, sf_dir):
    """Digits of Arabic become ASCII ones; of a run of seven marks four stay."""
    arabic = F.translate(F.translate("text", "abc", "xyz"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    marked = F.regexp_replace("text", "([éèêäöüñóíáàçâîôû])", "$1́́́̀̀̀̀")
    limited = F.regexp_replace(tx.filter_text(marked, limit_combining=True), "̀$|̀(?=[^\\p{M}])", "")
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.filter_text(arabic, numeric=True)).alias("digest"), F.md5(limited).alias("marks"))


@_query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 20 WHEN 2 THEN 12 WHEN 3 THEN 180 WHEN 4 THEN 96 ELSE 0 END AS detected, doc_id % 6 IN (1, 2, 3, 4) OR doc_id % 6 = 0 AND (strlen(text) + 3) % 2 = 0 AS utf16, CASE WHEN doc_id % 6 = 1 THEN md5(text) END AS back FROM documents WHERE doc_id % 6 NOT IN (0, 5) OR text <> ''")
def encoding_marks(spark, sf_dir):
    """Texts in six byte forms: with the marks of UTF-8, UTF-16 and UTF-32, and cut within a character."""
    d, utf8 = _docs(spark, sf_dir).withColumn("k", F.col("doc_id") % 6), F.encode("text", "UTF-8")
    form = lambda k, e, mark: F.concat(F.lit(mark), tx.convert_encoding(F.when(F.col("k") == k, utf8), "UTF-8", e))
    b = F.when(F.col("k") == 0, F.concat(F.lit(b"\xef\xbb\xbf"), utf8)).when(F.col("k") == 1, form(1, "UTF-16LE", b"\xff\xfe")).when(F.col("k") == 2, form(2, "UTF-16BE", b"\xfe\xff")).when(F.col("k") == 3, form(3, "UTF-32LE", b"\xff\xfe\0\0")).when(F.col("k") == 4, form(4, "UTF-32BE", b"\0\0\xfe\xff")).otherwise(F.concat(utf8, F.lit(b"\xc3")))
    d = d.where(~F.col("k").isin(0, 5) | (F.col("text") != "")).withColumn("b", b)
    odd = F.when(F.col("k") < 5, tx.is_utf16("b")).otherwise(F.lit(False))
    return d.select("doc_id", tx.detect_encoding("b").alias("detected"), odd.alias("utf16"), F.when(F.col("k") == 1, F.md5(tx.convert_encoding(F.when(F.col("k") == 1, F.col("b")), "UTF-16", "UTF-8"))).alias("back"))


@_query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN CASE WHEN text = '' THEN 'OK' ELSE 'INVALID_ENCODING' END WHEN 2 THEN CASE WHEN strlen(text) = length(text) THEN 'OK' ELSE 'UNSUPPORTED' END ELSE 'OK' END AS status, doc_id % 4 IN (2, 3) AND text <> '' AND (doc_id % 4 = 3 OR strlen(text) = length(text)) AS transformed, CAST(CASE doc_id % 4 WHEN 0 THEN strlen(text) WHEN 1 THEN CASE WHEN text = '' THEN 0 END WHEN 2 THEN CASE WHEN strlen(text) = length(text) THEN strlen(text) END ELSE 4 * length(text) END AS BIGINT) AS size FROM documents")
def convert_encoding_status(spark, sf_dir):
    b, k = F.encode("text", "UTF-8"), F.col("doc_id") % 4
    ways = [tx.convert_encoding_result(F.when(k == i, b), src, dst) for i, (src, dst) in enumerate((("UTF-8", "UTF-8"), ("UTF-16", "UTF-8"), ("UTF-8", "ASCII"), ("UTF-8", "UTF-32BE")))]
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce(*ways).alias("r"))
    return d.select("doc_id", "r.status", "r.transformed", F.octet_length("r.output").cast("long").alias("size"))


@_query("SELECT doc_id, strlen(text) > 0 AND strlen(text) = length(text) AS ascii, strlen(text) > 0 AS utf8, CASE WHEN text = '' THEN 0 WHEN strlen(text) = length(text) THEN 3 ELSE 2 END AS detected, CAST(length(text) AS BIGINT) AS n FROM documents")
def encoding_predicates(spark, sf_dir):
    b = F.encode("text", "UTF-8")
    return _docs(spark, sf_dir).select("doc_id", tx.is_ascii(b).alias("ascii"), tx.is_utf8(b).alias("utf8"), tx.detect_encoding(b).alias("detected"), tx.codepoint_count(b).alias("n"))


@_query("SELECT doc_id, md5(text) AS digest, CAST(2 * length(text) AS BIGINT) AS n16, CAST(4 * length(text) AS BIGINT) AS n32 FROM documents")
def convert_encoding_roundtrip(spark, sf_dir):
    b = F.encode("text", "UTF-8")
    wide, wider = tx.convert_encoding(b, "UTF-8", "UTF-16LE"), tx.convert_encoding(b, "UTF-8", "UTF-32LE")
    d = _docs(spark, sf_dir).select("doc_id", wide.alias("w"), wider.alias("x"))
    return d.select("doc_id", F.md5(tx.convert_encoding(tx.convert_encoding("w", "UTF-16LE", "UTF-32BE"), "UTF-32BE", "UTF-8")).alias("digest"), F.octet_length("w").cast("long").alias("n16"), F.octet_length("x").cast("long").alias("n32"))


@_query("SELECT unicode(c) AS cp, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (first) AS BIGINT) AS n_first FROM (SELECT unnest(string_split(text, '')) AS c, unnest(range(length(text))) = 0 AS first FROM documents WHERE text <> '') GROUP BY 1")
def codepoint_histogram(spark, sf_dir):
    return cp.histogram(_docs(spark, sf_dir), "text")


@_query("SELECT conv_id, turn, CAST(length(regexp_extract(text, '^[^ ]* ?')) AS BIGINT) AS n, unicode(text) AS first_cp, CAST(CASE WHEN strpos(text, ' ') = 0 OR strpos(text, ' ') = length(text) THEN 1 ELSE 0 END AS BIGINT) AS n_last FROM conversations WHERE text <> ''")
def each_codepoint(spark, sf_dir):
    """Code points up to the first space, which stops the iteration."""
    d = cp.for_each_codepoint(_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text")), "text", lambda c: c != 32)
    # What stops a text ends it: last is the flag of its last code point, of those that were visited.
    whole = d.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max(F.when(F.col("first"), F.col("cp"))).alias("first_cp"), F.max(F.length("text")).alias("_all"))
    return whole.select("conv_id", "turn", "n", "first_cp", (F.col("n") == F.col("_all")).cast("long").alias("n_last"))


@_query("SELECT c.cp, c.n, CASE WHEN regexp_matches(chr(c.cp), '\\p{L}') THEN regexp_extract(CASE WHEN chr(c.cp) = lower(chr(c.cp)) THEN 'Ll' ELSE 'Lu' END, '..') WHEN regexp_matches(chr(c.cp), '\\p{Nd}') THEN 'Nd' WHEN c.cp = 32 THEN 'Zs' WHEN c.cp < 32 THEN 'Cc' WHEN chr(c.cp) = '(' THEN 'Ps' WHEN chr(c.cp) = ')' THEN 'Pe' WHEN chr(c.cp) = '-' THEN 'Pd' WHEN chr(c.cp) = '$' THEN 'Sc' WHEN chr(c.cp) IN ('+', '=', '|') THEN 'Sm' ELSE 'Po' END AS category FROM (SELECT unicode(ch) AS cp, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM conversations WHERE text <> '') GROUP BY 1) c")
def codepoint_categories(spark, sf_dir):
    """Records of the code points of conversations: the relation of characters joined to what the iteration gives."""
    d = cp.for_each_codepoint(_table(spark, sf_dir, "conversations").select("text"), "text").groupBy("cp").agg(F.count("*").alias("n"))
    return d.join(F.broadcast(cp.characters(spark).select("cp", "category")), "cp").select("cp", "n", "category")


@_query("SELECT md5(lower(replace(text,'ß','ss'))) AS k, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM documents GROUP BY lower(replace(text,'ß','ss')) HAVING count(*) > 1")
def caseless_groups(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", ident.caseless_key("text", "unnormalized").alias("key"))
    return d.groupBy(F.md5("key").alias("k")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@_query("SELECT a.n_nationkey AS a, b.c_custkey AS b FROM nation a JOIN customer b ON lower(a.n_name) = lower(upper(b.c_name)) UNION ALL SELECT n_nationkey, -1 FROM nation")
def caseless_join(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_name").alias("t"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("b"), F.upper("c_name").alias("t"))
    self_ = n.select(F.lit(-1).cast("long").alias("b"), F.lower("t").alias("t"))
    return ident.caseless_join(n, c.unionByName(self_), "t", "canonical").select("a", "b")


@_query(f"SELECT cp, cp BETWEEN 0 AND 1114111 AND NOT cp BETWEEN 64976 AND 65007 AND (cp & 65534) <> 65534 AS valid, CASE WHEN NOT cp BETWEEN 64976 AND 65007 AND (cp & 65534) <> 65534 THEN cp >> 16 ELSE -1 END AS plane FROM {_CODESPACE}")
def codepoint_valid_plane(spark, sf_dir):
    return _space(spark).select("cp", cp.is_valid("cp").alias("valid"), cp.plane("cp").alias("plane"))


@_query(f"""SELECT cp, cp BETWEEN 4352 AND 4370 AS l, cp BETWEEN 4449 AND 4469 AS v, cp BETWEEN 4520 AND 4546 AS t, cp BETWEEN 4352 AND 4370 OR cp BETWEEN 4449 AND 4469 OR cp BETWEEN 4520 AND 4546 AS jamo, cp BETWEEN 44032 AND 55203 AS syllable,
 cp IN (9,10,11,12,13,32,133,8206,8207,8232,8233) AS pattern_space, cp BETWEEN 127995 AND 127999 AS modifier FROM {_CODESPACE}""")
def codepoint_hangul(spark, sf_dir):
    return _space(spark).select("cp", cp.is_hangul_leading("cp").alias("l"), cp.is_hangul_vowel("cp").alias("v"), cp.is_hangul_trailing("cp").alias("t"), cp.is_hangul_jamo("cp").alias("jamo"), cp.is_hangul_syllable("cp").alias("syllable"), cp.is_pattern_white_space("cp").alias("pattern_space"), cp.is_emoji_modifier("cp").alias("modifier"))


_EXT = " OR ".join(f"cp BETWEEN {lo} AND {hi}" for lo, hi in cp.CJK_EXTENSIONS)


@_query(f"SELECT cp, {_EXT} AS extension, cp BETWEEN 19968 AND 40959 OR {_EXT} AS ideograph FROM {_CODESPACE}")
def codepoint_cjk(spark, sf_dir):
    return _space(spark).select("cp", cp.is_cjk_extension("cp").alias("extension"), cp.is_cjk_ideograph("cp").alias("ideograph"))


@_query(f"SELECT cp, CASE WHEN cp BETWEEN 55296 AND 57343 THEN '' ELSE hex(encode(chr(cp))) END AS utf8, CASE WHEN cp BETWEEN 55296 AND 57343 THEN '' ELSE lpad(hex(cp), 8, '0') END AS utf32 FROM {_CODESPACE} WHERE cp > 0")
def codepoint_encode(spark, sf_dir):
    return _space(spark).where("cp > 0").select("cp", F.hex(cp.encode("cp")).alias("utf8"), F.hex(cp.encode("cp", "UTF-32BE")).alias("utf32"))


@_query("SELECT CAST(44032 + range AS INTEGER) AS cp, CAST(4352 + range // 588 AS INTEGER) AS l, CAST(4449 + range % 588 // 28 AS INTEGER) AS v, CAST(CASE WHEN range % 28 = 0 THEN 0 ELSE 4519 + range % 28 END AS INTEGER) AS t, unicode(nfc_normalize(chr(CAST(4352 + range // 588 AS INTEGER)) || chr(CAST(4449 + range % 588 // 28 AS INTEGER)) || CASE WHEN range % 28 = 0 THEN '' ELSE chr(CAST(4519 + range % 28 AS INTEGER)) END)) AS composed FROM range(11172)")
def hangul_syllables(spark, sf_dir):
    s = spark.range(0xAC00, 0xAC00 + 11172).select(F.col("id").cast("int").alias("cp"), cp.hangul_decompose("id").alias("d"))
    return s.select("cp", F.get("d", F.lit(0)).alias("l"), F.get("d", F.lit(1)).alias("v"), F.get("d", F.lit(2)).alias("t"), F.element_at(cp.hangul_compose(F.filter("d", lambda x: x > 0)), 1).alias("composed"))


@_query(f"SELECT doc_id, CAST(strlen(left_grapheme({_decomposed('text')}, 25)) AS BIGINT) AS n_bytes, md5(left_grapheme({_decomposed('text')}, 25)) AS digest FROM documents")
def truncate_grapheme(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", tx.truncate(tx.normalize("text", "NFD"), "grapheme", 25).alias("t"))
    return d.select("doc_id", F.col("t.bytes").alias("n_bytes"), F.md5("t.text").alias("digest"))


@_query("SELECT doc_id, CAST(length(line) AS BIGINT) AS narrow, CAST(length(line) + len(regexp_extract_all(line, '[¡¤§¨ª®°±²³´¶·¸¹º¼½¾¿ÆÐ×ØÞßàáæèéêìíðòó÷øùúüþ]')) AS BIGINT) AS wide FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)")
def terminal_width(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", tx.terminal_width("line").alias("narrow"), tx.terminal_width("line", True).alias("wide"))


@_query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, 0 AS errors FROM pages")
def idna_hosts(spark, sf_dir):
    d = _table(spark, sf_dir, "pages").select("page_id", hosts.idna(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("h"))
    return d.select("page_id", F.col("h.output").alias("host"), F.col("h.errors").alias("errors"))


@_query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '\p{L}') THEN 'RESOLVED' ELSE 'ALL' END AS kind, CASE WHEN regexp_matches(text, '\p{L}') THEN 'Latn' ELSE '' END AS scripts FROM documents")
def resolved_scripts(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", ident.resolved_scripts("text").alias("s"))
    return d.select("doc_id", "s.kind", F.array_join("s.scripts", ",").alias("scripts"))


@_query(r"SELECT w, regexp_full_match(w, '\p{L}[\p{L}\p{Nd}_ªº·]*') AS ok FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents)")
def identifiers(spark, sf_dir):
    w = _docs(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return w.select("w", ident.is_identifier("w").alias("ok"))


_BIDI_REMOVED = r"[\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F\xAD]"


@_query(f"SELECT conv_id, turn, 'LTR' AS direction, CAST(length(regexp_replace(text,'{_BIDI_REMOVED}','','g')) AS BIGINT) AS n, 0 AS level, CASE WHEN text = '' THEN 0 ELSE 1 END AS n_runs FROM conversations")
def bidi_conversations(spark, sf_dir):
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", bidi.bidi_resolve("text").alias("b"))
    return d.select("conv_id", "turn", "b.direction", F.size("b.chars").cast("long").alias("n"), "b.level", F.size("b.runs").alias("n_runs"))


_HARD = r"\r\n|[\n\x0B\f\r\x85\x{2028}\x{2029}]"


@_query(f"SELECT conv_id, turn, CAST(len(regexp_extract_all(text,'{_HARD}')) + CASE WHEN text = '' OR regexp_matches(text,'[\\n\\x0B\\f\\r\\x85\\x{{2028}}\\x{{2029}}]$') THEN 0 ELSE 1 END AS BIGINT) AS n_mandatory FROM conversations")
def line_breaks_mandatory(spark, sf_dir):
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", lb.line_breaks("text").alias("b"))
    return d.select("conv_id", "turn", F.size(F.filter("b", lambda x: x["kind"] == "MANDATORY")).cast("long").alias("n_mandatory"))


@_query(f"SELECT cp, CASE WHEN cp < 128 THEN 'Basic Latin' WHEN cp < 256 THEN 'Latin-1 Supplement' WHEN cp < 384 THEN 'Latin Extended-A' WHEN cp BETWEEN 8192 AND 8303 THEN 'General Punctuation' ELSE 'other' END AS block, n FROM (SELECT unicode(c) AS cp, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY 1)")
def codepoint_blocks(spark, sf_dir):
    d = pr.codepoint_block(codepoint_histogram(spark, sf_dir), "cp")
    few = F.col("block").isin("Basic Latin", "Latin-1 Supplement", "Latin Extended-A", "General Punctuation")
    return d.select("cp", F.when(few, F.col("block")).otherwise("other").alias("block"), "n")


@_query()
def codepoint_properties(spark, sf_dir):
    """All named binary properties over the code space."""
    return _space(spark).select("cp", *(cp.has_property("cp", p).alias(n) for n, p in cp.NAMED.items()))


@_query()
def codepoint_records(spark, sf_dir):
    return cp.characters(spark)


_FOLDED = "lower(replace(text,'ß','ss'))"


@_query(f"SELECT doc_id, md5({_FOLDED}) AS unnormalized, md5({_decomposed(_FOLDED)}) AS canonical, md5({_decomposed(_FOLDED)}) AS compatibility, md5({_decomposed(_FOLDED)}) AS identifier FROM documents")
def caseless_modes(spark, sf_dir):
    """Keys of all modes; canonical and compatibility ones of decomposed upper-case texts, identifiers' with soft hyphens put in."""
    soft = F.regexp_replace("text", "e", "e­")
    key = lambda t, mode: F.md5(ident.caseless_key(t, mode)).alias(mode)
    return _docs(spark, sf_dir).select("doc_id", key("text", "unnormalized"), key(tx.normalize(F.upper("text"), "NFD"), "canonical"), key(F.upper("text"), "compatibility"), key(soft, "identifier"))


_TOKENS = r"""regexp_extract_all({0},'(?s)(?:\p{{L}}(?:[.:''’·]\p{{L}})*|\p{{Nd}}(?:[.,;''’]\p{{Nd}})*|_)+| +|\r\n|.')"""


@_query(f"SELECT conv_id, turn, md5(array_to_string({_TOKENS.format('text')}, '|')) AS digest, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n FROM conversations")
def word_segments(spark, sf_dir):
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.segments("text", "word").alias("w"), lb.breaks("text", "word").alias("b"))
    return d.select("conv_id", "turn", F.md5(F.array_join("w", "|")).alias("digest"), F.size("b").cast("long").alias("n"))


_MARKED = _decomposed("text")


@_query(f"SELECT conv_id, turn, md5(array_to_string(list_filter(range(1, length(t) + 1), lambda i: i = length(t) OR NOT regexp_matches(t[i + 1:i + 1], '\\p{{M}}')), ',')) AS digest FROM (SELECT conv_id, turn, {_MARKED} AS t FROM conversations)")
def grapheme_breaks(spark, sf_dir):
    """Positions of the breaks of decomposed texts."""
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", lb.breaks(tx.normalize("text", "NFD"), "grapheme").alias("b"))
    return d.select("conv_id", "turn", F.md5(F.array_join(F.transform("b", lambda x: x["at"].cast("string")), ",")).alias("digest"))


@_query("SELECT conv_id, turn, kind, CAST(length(text) AS BIGINT) AS n_events FROM conversations, (VALUES ('grapheme'), ('word'), ('sentence'), ('line')) k(kind)")
def break_events(spark, sf_dir):
    """Every code point of a text ends in one event of each iterator: a break or none."""
    d = _table(spark, sf_dir, "conversations")
    parts = [d.select("conv_id", "turn", F.lit(k).alias("kind"), F.size(lb.breaks("text", k, every=True)).cast("long").alias("n_events")) for k in ("grapheme", "word", "sentence", "line")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_query()
def break_profile(spark, sf_dir):
    """How many breaks of each kind every text of the conversations has; tests compare lines with ICU."""
    b = lambda k: lb.breaks("text", k)
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", b("word").alias("w"), b("sentence").alias("s"), b("line").alias("l"))
    return d.select("conv_id", "turn", F.size("w").alias("words"), F.size("s").alias("sentences"), F.size(F.filter("l", lambda x: x["kind"] == "ALLOWED")).alias("lines"))


@_query()
def sentence_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.sentence_count("text").alias("n"))


_TITLED = r"""array_to_string(list_transform({0}, lambda x: regexp_extract(x,'(?s)^([^\p{{L}}]*)',1) || CASE WHEN regexp_extract(x,'\p{{L}}') = 'ß' THEN 'Ss' ELSE upper(regexp_extract(x,'\p{{L}}')) END || lower(regexp_extract(x,'(?s)^[^\p{{L}}]*\p{{L}}(.*)',1))), '')"""


@_query(f"SELECT doc_id, md5({_TITLED.format(_TOKENS.format('text'))}) AS titled FROM documents")
def title_case(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.map_case("text", "title", "en")).alias("titled"))


@_query("SELECT doc_id, md5(upper(replace(replace(text,'i','İ'),'ß','SS'))) AS up, md5(lower(replace(text,'I','ı'))) AS low, CASE WHEN strlen(text) <= 500 THEN md5(upper(replace(replace(text,'i','İ'),'ß','SS'))) END AS fits FROM documents")
def locale_case(spark, sf_dir):
    """Case by Turkish rules, once told as an argument and once by the session; the buffer's size goes by the result's."""
    told = tx.map_case("text", "upper", "tr-TR")
    saved = ses.get_locale(spark)
    ses.set_locale(spark, "tr")
    low = tx.map_case("text", "lower")
    ses.set_locale(spark, saved)
    d = _docs(spark, sf_dir).select("doc_id", "text", told.alias("u"), low.alias("l"))
    return d.select("doc_id", F.md5("u").alias("up"), F.md5("l").alias("low"), tx.into(F.when(F.octet_length("text") <= 500, F.col("u")), 10_000)["output"].alias("o")).select("doc_id", "up", "low", F.md5("o").alias("fits"))


@_query(f"SELECT conv_id, turn, CAST({_WORDS} AS BIGINT) + 5 AS n FROM conversations")
def word_count_scripts(spark, sf_dir):
    """Ideographs are words one by one, Katakana together, Cyrillic letters with an apostrophe too."""
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.word_count(F.concat("text", F.lit(" 東京 カタカナ и'я _ … я3.14"))).alias("n"))


@_query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '\p{L}') THEN 'EMPTY' ELSE 'RESOLVED' END AS mixed, CASE WHEN regexp_matches(text, '\p{L}') THEN '' ELSE 'Cyrl' END AS scripts, CASE WHEN regexp_matches(text, '\p{L}') THEN 'EMPTY' ELSE 'RESOLVED' END AS han, CASE WHEN regexp_matches(text, '\p{L}') THEN '' ELSE 'Hanb,Hani,Jpan,Kore' END AS han_scripts FROM documents")
def mixed_scripts(spark, sf_dir):
    r = lambda more: ident.resolved_scripts(F.concat("text", F.lit(more)))
    d = _docs(spark, sf_dir).select("doc_id", r(" я!").alias("a"), r("〆切").alias("b"))
    return d.select("doc_id", F.col("a.kind").alias("mixed"), F.array_join("a.scripts", ",").alias("scripts"), F.col("b.kind").alias("han"), F.array_join("b.scripts", ",").alias("han_scripts"))


@_query("SELECT page_id, CAST(length(url) + 9 AS BIGINT) AS w, CAST(length(url) + 9 + 1 AS BIGINT) AS wide, CAST(NULL AS BIGINT) AS none FROM pages")
def terminal_width_scripts(spark, sf_dir):
    """Wide letters take two columns, marks and format characters none, a family of emoji two; a tab cannot be measured."""
    t = F.concat("url", F.lit("中文Ａ é​👩‍👩‍👧"), F.lit(""))
    a = F.concat("url", F.lit("中文Ａ§👩‍👩‍👧"))
    return _table(spark, sf_dir, "pages").select("page_id", (tx.terminal_width(t) - 1).alias("w"), tx.terminal_width(a, True).alias("wide"), tx.terminal_width(F.concat("url", F.lit("\t"))).alias("none"))


@_query("SELECT n_nationkey, n_name[1:8] AS cut, n_name[1:3] AS narrow, md5(n_name || ' 中') AS whole, CAST(strlen(n_name) + 4 AS BIGINT) AS required, n_name[1:6] AS printed FROM nation WHERE length(n_name) >= 4")
def truncate_width(spark, sf_dir):
    """Prefixes by columns, clusters and bytes; what does not fit whole is left out."""
    t = F.concat("n_name", F.lit(" 中"))
    wide = F.concat(F.left("n_name", F.lit(3)), F.lit("中中"))
    d = _table(spark, sf_dir, "nation").where("length(n_name) >= 4").select("n_nationkey", "n_name", t.alias("t"), wide.alias("wide"))
    p = tx.format_text("%s%s", F.left("n_name", F.lit(6)), F.repeat(F.lit("é"), F.lit(9)), max_bytes=8, clusters=True)
    whole = tx.format_text("%s %s", "n_name", F.lit("中"), max_bytes=100)
    return d.select("n_nationkey", tx.truncate_width("n_name", "grapheme", 8).alias("cut"), tx.truncate_width("wide", "grapheme", 4).alias("narrow"), F.md5(whole["output"]).alias("whole"), whole["required"].alias("required"), F.when(F.length("n_name") >= 6, p["output"]).otherwise(F.col("n_name")).alias("printed"))


@_query(f"SELECT doc_id, array_to_string(list_slice({_TOKENS.format('text')}, 1, 7), '') AS first_segments FROM documents")
def truncate_word(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.truncate("text", "word", 7)["text"].alias("first_segments"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@_query(f"""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'xn--fa-hia.' WHEN 1 THEN 'xn--ab-j1t.' WHEN 2 THEN 'xn--11b2ezcw70k.' WHEN 3 THEN '1.xn--4dbc.' WHEN 4 THEN 'abc.' WHEN 5 THEN '-a_b.' WHEN 6 THEN 'a..' ELSE 'xn--bcher-kva.' END || {_HOST} AS host,
 CASE page_id % 8 WHEN 1 THEN 128 WHEN 3 THEN 256 WHEN 5 THEN 68 WHEN 6 THEN 514 ELSE 0 END AS errors, CASE page_id % 8 WHEN 0 THEN 'faß.' WHEN 7 THEN 'bücher.' END || {_HOST} AS shown FROM pages""")
def idna_scripts(spark, sf_dir):
    """Hosts below labels with sharp s, joiners, Hebrew, full-width letters, wrong hyphens, none and Punycode."""
    k, host = F.col("page_id") % 8, F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    label = F.element_at(F.array(*map(F.lit, ("Faß.", "a‌b.", "क्‍ष.", "1.אב.", "Ａｂｃ。", "-a_b.", "a..", "BÜCHER."))), (k + 1).cast("int"))
    d = _table(spark, sf_dir, "pages").select("page_id", k.alias("k"), F.concat(label, host).alias("t"))
    d = d.withColumn("h", hosts.idna("t"))
    return d.select("page_id", F.col("h.output").alias("host"), F.col("h.errors").alias("errors"), F.when(F.col("k").isin(0, 7), hosts.idna("h.output", to_ascii=False)["output"]).alias("shown"))


@_query("SELECT conv_id, turn, 'RTL' AS direction, 0 AS level, CAST(length(regexp_replace(text,'[\\x00-\\x08\\x0E-\\x1B\\x7F-\\x84\\x86-\\x9F\\xAD]','','g')) + 6 AS BIGINT) AS n, 2 AS n_runs, '2,1,0,3,4,5' AS shown, '2,1,0,3' AS line FROM conversations")
def bidi_mixed(spark, sf_dir):
    """Texts after three Hebrew letters: their direction by themselves, and their order from left to right, whole and by line."""
    t = F.concat(F.lit("אבג. a"), "text")
    d = bidi.with_bidi(_table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t")), "t", "auto")
    d = bidi.with_bidi(d.select("conv_id", "turn", "t", "auto.direction"), "t", "b", "LTR")
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    # Of the characters only those of the line go on to the last function.
    d = d.select("conv_id", "turn", "direction", "b.level", F.size("b.chars").cast("long").alias("n"), F.size("b.runs").alias("n_runs"), text(F.slice("b.visual", 1, 6)).alias("shown"), F.slice("b.chars", 1, 4).alias("chars"))
    line = bidi.bidi_reorder_line(F.struct("level", "chars"), 0, 4)
    return d.select("conv_id", "turn", "direction", "level", "n", "n_runs", "shown", text(line).alias("line"))


def _replaced(col: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        col = f"replace({col},{chr(39)}{a}{chr(39)},{chr(39)}{b.replace(chr(39), chr(39) * 2)}{chr(39)})"
    return col


#: What characters of the test tables look like.
_LOOKS = {"%": "º/₀", '"': "''", "0": "O", "1": "l", "I": "l", "|": "l", "m": "rn", "̧": "̦"}


@_query(f"SELECT doc_id, md5({_replaced(_decomposed('text'), _LOOKS)}) AS skeleton, text <> '' AS same, false AS other FROM documents")
def confusable_skeletons(spark, sf_dir):
    """Skeletons of texts, and whether they match what has other characters of the same looks, and one more letter."""
    like = F.translate("text", "01I|aeo", "OlllаеО")
    like = F.translate(F.translate("text", "01I|", "Olll"), "aeopc", "аеорс")
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.md5(sec.confusable_skeleton("text")).alias("skeleton"), sec.confusable_match("text", like).alias("same"), sec.confusable_match("text", F.concat("text", F.lit("x"))).alias("other"))


_EMOJI = ("😀", "1️⃣", "❤", "👍🏽", "🇫🇷", "👩‍❤‍👨")


@_query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'BASIC' WHEN 1 THEN 'KEYCAP' WHEN 2 THEN 'BASIC' WHEN 3 THEN 'MODIFIER' WHEN 4 THEN 'FLAG' WHEN 5 THEN 'ZWJ' END AS kind, CASE WHEN doc_id % 7 IN (0, 1, 3, 4) THEN 'FULLY_QUALIFIED' WHEN doc_id % 7 = 2 THEN 'UNQUALIFIED' WHEN doc_id % 7 = 5 THEN 'MINIMALLY_QUALIFIED' END AS qualification, CASE doc_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 5 END AS n, doc_id % 7 IN (0, 1, 3, 4) AS rgi, doc_id % 7 < 6 AS sequence FROM documents")
def emoji_info(spark, sf_dir):
    """One of six emoji, or a text, for each document."""
    t = F.coalesce(F.get(F.array(*map(F.lit, _EMOJI)), (F.col("doc_id") % 7).cast("int")), F.concat(F.lit("x"), "text"))
    d = _docs(spark, sf_dir).select("doc_id", t.alias("t"))
    d = d.select("doc_id", sec.emoji_sequence_info("t").alias("e"), sec.is_rgi_emoji("t").alias("rgi"), sec.is_emoji_sequence("t").alias("sequence"))
    return d.select("doc_id", "e.kind", "e.qualification", F.col("e.count").alias("n"), "rgi", "sequence")


@_query()
def emoji_sequences(spark, sf_dir):
    """The relation of emoji sequences."""
    return sec.emoji_sequences(spark)


@_query()
def emoji_flags(spark, sf_dir):
    """Emoji records over the code space, for code points that have one."""
    d = _space(spark).select("cp", cp.emoji_properties("cp").alias("e"), cp.is_graphic("cp").alias("graphic"))
    return d.where("e is not null").select("cp", "graphic", *(F.col(f"e.{n}") for n in cp.EMOJI_FLAGS))


@_query("SELECT cp, n, CASE WHEN cp < 128 THEN 'Basic Latin' ELSE 'Latin-1 Supplement' END AS block, CASE WHEN regexp_matches(chr(cp), '\\p{L}') THEN 'Latin' ELSE 'Common' END AS script, CASE WHEN regexp_matches(chr(cp), '\\p{L}') THEN 'Latn' ELSE 'Zyyy' END AS extensions, CASE WHEN cp < 32 THEN 'Neutral' WHEN cp < 127 THEN 'Narrow' WHEN chr(cp) IN ('ß','è','é','ê','í','ó','ü') THEN 'Ambiguous' ELSE 'Neutral' END AS width, CASE WHEN regexp_matches(chr(cp), '\\p{Nd}') THEN chr(cp) END AS number FROM (SELECT unicode(ch) AS cp, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM conversations WHERE text <> '') GROUP BY 1)")
def codepoint_values(spark, sf_dir):
    d = cp.histogram(_table(spark, sf_dir, "conversations"), "text").select("cp", "n")
    d = pr.with_property(pr.with_property(pr.codepoint_block(d, "cp"), "cp", "Script", "script"), "cp", "East_Asian_Width", "width")
    return d.select("cp", "n", "block", "script", F.array_join(F.array_sort(pr.script_extensions("cp")), ",").alias("extensions"), "width", pr.numeric_value("cp")["numeric"].alias("number"))


@_query("SELECT DISTINCT lang, source, lang || '|||' AS head, lang || '||Latn|CH|1901||x-' || source || '|' AS parts, lang || '|||DE||u-co-phonebk||' AS more, '|||||||i-enochian' AS kept, CAST(NULL AS VARCHAR) AS wrong FROM documents")
def locale_tags(spark, sf_dir):
    parts = lambda t: F.concat_ws("|", *(t[f] for f in ident.LOCALE_FIELDS))
    parsed = lambda *x: ident.parse_locale(F.concat(*x))
    d = _docs(spark, sf_dir).select("lang", "source").distinct()
    d = d.select("lang", "source", parsed("lang").alias("a"), parsed(F.upper("lang"), F.lit("-latn-ch-1901-X-"), "source").alias("b"), parsed("lang", F.lit("-de-U-co-phonebk")).alias("c"), parsed(F.lit("I-Enochian")).alias("k"), parsed("lang", F.lit("-419-DE")).alias("w"))
    return d.select("lang", "source", F.concat_ws("|", "a.language", "a.extlang", "a.script", "a.region").alias("head"), parts(F.col("b")).alias("parts"), parts(F.col("c")).alias("more"), parts(F.col("k")).alias("kept"), F.when(F.col("w").isNotNull(), parts(F.col("w"))).alias("wrong"))


@_query("SELECT w, CAST(dense_rank() OVER (PARTITION BY length(w) ORDER BY icu_sort_key(w, 'und')) AS INTEGER) AS place, icu_sort_key(w, 'und') = icu_sort_key(lower(w), 'und') AS lower_case FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ-]+')) AS w FROM conversations)")
def collation_keys(spark, sf_dir):
    """Words of one length in the order of their sort keys; equal keys share a place."""
    w = _table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ-]+"), 0)).alias("w")).distinct()
    w = w.withColumn("k", coll.collation_key("w"))
    return w.select("w", F.dense_rank().over(Window.partitionBy(F.length("w")).orderBy("k")).alias("place"), (F.col("k") == coll.collation_key(F.lower("w"))).alias("lower_case"))


@_query("SELECT DISTINCT n_name AS w, 0 AS base, 1 AS accent, -1 AS tertiary, 0 AS shifted, 1 AS quaternary, -1 AS plain FROM nation")
def collation_strengths(spark, sf_dir):
    """Names against themselves in lower case, with an accent and with a hyphen, by strength and weighting."""
    low, hyphen = F.lower("w"), F.concat(F.left("w", F.lit(2)), F.lit("-"), F.substring("w", 3, 99))
    c = lambda a, b, s, how="non_ignorable": coll.collation_compare(a, b, s, how)
    d = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("w")).distinct()
    accent = F.concat("w", F.lit("́"))
    return d.select("w", c("w", accent, "primary").alias("base"), c(accent, "w", "secondary").alias("accent"), c(low, "w", "tertiary").alias("tertiary"), c("w", hyphen, "tertiary", "shifted").alias("shifted"), F.abs(c("w", hyphen, "quaternary", "shifted")).alias("quaternary"), c(hyphen, "w", "tertiary").alias("plain"))


@_query("SELECT s, CASE WHEN s BETWEEN 0 AND 12 THEN " + "[" + ",".join("'" + m.replace("'", "''") + "'" for m in ses.MESSAGES) + "][s + 1] ELSE 'The status code is unknown' END AS message FROM (SELECT CAST(range AS INTEGER) AS s FROM range(-2, 16))")
def status_messages(spark, sf_dir):
    return spark.range(-2, 16).select(F.col("id").cast("int").alias("s")).select("s", ses.status_message("s").alias("message"))


@_query("SELECT p, p BETWEEN 0 AND 16 AS valid, CASE p WHEN 0 THEN 'BMP' WHEN 1 THEN 'SMP' WHEN 2 THEN 'SIP' WHEN 3 THEN 'TIP' WHEN 14 THEN 'SSP' WHEN 15 THEN 'PUA-A' WHEN 16 THEN 'PUA-B' ELSE CASE WHEN p BETWEEN 0 AND 16 THEN 'Unassigned' END END AS name, CASE WHEN p = 0 THEN 'Basic Multilingual Plane' END AS first_name FROM (SELECT range AS p FROM range(-2, 20))")
def plane_names(spark, sf_dir):
    return spark.range(-2, 20).select(F.col("id").alias("p"), cp.plane_is_valid("id").alias("valid"), cp.plane_name("id", True).alias("name"), F.when(F.col("id") == 0, cp.plane_name("id")).alias("first_name"))


@_query("SELECT cp, 'HANGUL SYLLABLE ' || ['G','GG','N','D','DD','R','M','B','BB','S','SS','','J','JJ','C','K','T','P','H'][1 + (cp - 44032) // 588] || ['A','AE','YA','YAE','EO','E','YEO','YE','O','WA','WAE','OE','YO','U','WEO','WE','WI','YU','EU','YI','I'][1 + (cp - 44032) % 588 // 28] || ['','G','GG','GS','N','NJ','NH','D','L','LG','LM','LB','LS','LT','LP','LH','M','B','BS','S','SS','NG','J','C','K','T','P','H'][1 + (cp - 44032) % 28] AS name FROM (SELECT CAST(range AS INTEGER) AS cp FROM range(44032, 55204))")
def hangul_names(spark, sf_dir):
    return spark.range(0xAC00, 0xD7A4).select(F.col("id").cast("int").alias("cp")).select("cp", cp.hangul_name("cp").alias("name"))


_ASCII_LETTER = "(cp BETWEEN 65 AND 90 OR cp BETWEEN 97 AND 122)"


@_query(f"""SELECT cp, n, regexp_matches(chr(cp), '\\p{{L}}') AS id_start, regexp_matches(chr(cp), '[\\p{{L}}\\p{{Nd}}_]') OR cp BETWEEN 768 AND 879 AS id_continue, regexp_matches(chr(cp), '\\p{{L}}') AS xid_start, regexp_matches(chr(cp), '[\\p{{L}}\\p{{Nd}}_]') OR cp BETWEEN 768 AND 879 AS xid_continue,
 cp BETWEEN 33 AND 47 OR cp BETWEEN 58 AND 64 OR cp BETWEEN 91 AND 94 OR cp = 96 OR cp BETWEEN 123 AND 126 AS pattern_syntax, cp BETWEEN 48 AND 57 OR cp IN (35, 42) AS emoji, false AS emoji_presentation, false AS emoji_modifier_base, cp BETWEEN 48 AND 57 OR cp IN (35, 42) AS emoji_component, false AS extended_pictographic, cp BETWEEN 768 AND 879 AS combining,
 cp >= 32 AS graphic, regexp_matches(chr(cp), '\\p{{Lu}}') AS uppercase, CASE WHEN cp BETWEEN 48 AND 57 OR cp IN (35, 42) THEN 1 END AS flagged
 FROM (SELECT unicode(c) AS cp, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split({_decomposed('text')} || text, '')) AS c FROM documents WHERE text <> '') GROUP BY 1)""")
def codepoint_flags(spark, sf_dir):
    """Binary properties of the code points of texts, as they are and decomposed."""
    d = cp.histogram(_docs(spark, sf_dir).select(F.concat(tx.normalize("text", "NFD"), "text").alias("t")), "t").select("cp", "n")
    flags = {n: cp.has_property("cp", p) for n, p in cp.NAMED.items()}
    flagged = cp.emoji_properties("cp").isNotNull()
    return d.select("cp", "n", *(v.alias(n) for n, v in flags.items()), cp.is_graphic("cp").alias("graphic"), cp.has_property("cp", "Lu").alias("uppercase"), F.when(flagged, 1).alias("flagged"))


@_query(f"""SELECT cp, CASE WHEN cp < 91 THEN 'LATIN CAPITAL LETTER ' ELSE 'LATIN SMALL LETTER ' END || upper(chr(cp)) AS name, CASE WHEN cp < 91 THEN 'Lu' ELSE 'Ll' END AS category, 0 AS combining, 'L' AS bidi, 'none' AS decomposition, -1 AS digit, false AS mirrored, CASE WHEN cp < 91 THEN 0 ELSE cp - 32 END AS upper, CASE WHEN cp < 91 THEN cp + 32 ELSE 0 END AS lower
 FROM (SELECT DISTINCT unicode(c) AS cp FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '')) WHERE {_ASCII_LETTER}
 UNION ALL SELECT cp, 'LATIN ' || CASE WHEN chr(cp) = lower(chr(cp)) THEN 'SMALL' ELSE 'CAPITAL' END || ' LETTER ' || upper(strip_accents(chr(cp))) || ' WITH ' || CASE WHEN lower(chr(cp)) IN ('á','é','í','ó') THEN 'ACUTE' WHEN lower(chr(cp)) = 'è' THEN 'GRAVE' WHEN lower(chr(cp)) = 'ê' THEN 'CIRCUMFLEX' WHEN lower(chr(cp)) = 'ñ' THEN 'TILDE' WHEN lower(chr(cp)) = 'ç' THEN 'CEDILLA' ELSE 'DIAERESIS' END, CASE WHEN chr(cp) = lower(chr(cp)) THEN 'Ll' ELSE 'Lu' END, 0, 'L', 'canonical', -1, false, CASE WHEN chr(cp) = lower(chr(cp)) THEN cp - 32 ELSE 0 END, CASE WHEN chr(cp) = lower(chr(cp)) THEN 0 ELSE cp + 32 END
 FROM (SELECT DISTINCT unicode(c) AS cp FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '')) WHERE chr(cp) IN ('á','é','í','ó','è','ê','ñ','ç','ä','ö','ü','Á','É','Í','Ó','È','Ê','Ñ','Ç','Ä','Ö','Ü')""")
def codepoint_names(spark, sf_dir):
    """Records of the letters of texts."""
    letters = F.col("cp").between(65, 90) | F.col("cp").between(97, 122) | F.col("cp").between(0xC0, 0xFF) & (F.col("cp") != 0xDF)
    d = cp.histogram(_docs(spark, sf_dir), "text").where(letters).select("cp")
    return d.join(F.broadcast(cp.characters(spark)), "cp").select("cp", "name", "category", "combining", "bidi", "decomposition", "digit", "mirrored", "upper", "lower")
