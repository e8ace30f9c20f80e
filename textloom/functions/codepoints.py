"""Code points as integers: arithmetic predicates and lookups in ranges of the Unicode character data.

Predicates are Catalyst expressions. Properties come from the `regex` package's character data, enumerated once per
process into ranges; a property test over a column is a regular expression of these ranges, so it stays in the JVM, and property_ranges() gives the same ranges as a small dimension table for joins.
"""

from __future__ import annotations

import functools
import operator
import unicodedata

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX = 0x10FFFF


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid(cp) -> Column:
    """At most 10FFFF and no noncharacter; surrogates count as valid."""
    c = _col(cp)
    return c.between(0, MAX) & ~c.between(0xFDD0, 0xFDEF) & (c.bitwiseAND(0xFFFE) != 0xFFFE)


def plane(cp) -> Column:
    """Number of the plane, -1 for an invalid code point."""
    c = _col(cp)
    return F.when(is_valid(c), F.shiftright(c.cast("int"), 16)).otherwise(-1)


def plane_is_valid(p) -> Column:
    return _col(p).between(0, 16)


#: Planes with a name.
_PLANES = {0: ("Basic Multilingual Plane", "BMP"), 1: ("Supplementary Multilingual Plane", "SMP"), 2: ("Supplementary Ideographic Plane", "SIP"), 3: ("Tertiary Ideographic Plane", "TIP"), 14: ("Supplementary Special-purpose Plane", "SSP"), 15: ("Supplementary Private Use Area-A", "PUA-A"), 16: ("Supplementary Private Use Area-B", "PUA-B")}


def plane_name(p, abbreviation: bool = False) -> Column:
    """Name of a plane, `Unassigned` for planes without one, null for an invalid plane."""
    c, out = _col(p), None
    for k, names in _PLANES.items():
        out = (F if out is None else out).when(c == k, names[abbreviation])
    return F.when(plane_is_valid(c), out.otherwise("Unassigned"))


def is_hangul_leading(cp) -> Column:
    return _col(cp).between(0x1100, 0x1112)


def is_hangul_vowel(cp) -> Column:
    return _col(cp).between(0x1161, 0x1175)


def is_hangul_trailing(cp) -> Column:
    return _col(cp).between(0x11A8, 0x11C2)


def is_hangul_jamo(cp) -> Column:
    return is_hangul_leading(cp) | is_hangul_vowel(cp) | is_hangul_trailing(cp)


def is_hangul_syllable(cp) -> Column:
    return _col(cp).between(0xAC00, 0xD7A3)


#: Ranges of the CJK unified ideographs' extensions A to J.
CJK_EXTENSIONS = ((0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F), (0x31350, 0x323AF), (0x2EBF0, 0x2EE5F), (0x323B0, 0x3347F))


def is_cjk_extension(cp) -> Column:
    c = _col(cp)
    return functools.reduce(lambda a, b: a | b, (c.between(lo, hi) for lo, hi in CJK_EXTENSIONS))


def is_cjk_ideograph(cp) -> Column:
    return _col(cp).between(0x4E00, 0x9FFF) | is_cjk_extension(cp)


def is_pattern_white_space(cp) -> Column:
    return _col(cp).isin(9, 10, 11, 12, 13, 32, 133, 8206, 8207, 8232, 8233)


def is_emoji_modifier(cp) -> Column:
    return _col(cp).between(0x1F3FB, 0x1F3FF)


#: Jamo parts of syllable names.
_L = "G GG N D DD R M B BB S SS  J JJ C K T P H".split(" ")
_V = "A AE YA YAE EO E YEO YE O WA WAE OE YO U WEO WE WI YU EU YI I".split(" ")
_T = " G GG GS N NJ NH D L LG LM LB LS LT LP LH M B BS S SS NG J C K T P H".split(" ")


def hangul_name(cp) -> Column:
    """Name of a precomposed syllable, else null."""
    s = _col(cp).cast("int") - 0xAC00
    part = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    return F.when(is_hangul_syllable(cp), F.concat(F.lit("HANGUL SYLLABLE "), part(_L, F.floor(s / 588)), part(_V, F.floor((s % 588) / 28)), part(_T, s % 28)))


def hangul_decompose(cp) -> Column:
    """[L, V, T] of a syllable, T 0 where there is none; null for others."""
    s = _col(cp).cast("int") - 0xAC00
    return F.when(is_hangul_syllable(cp), F.array((F.lit(0x1100) + F.floor(s / 588)).cast("int"), (F.lit(0x1161) + F.floor((s % 588) / 28)).cast("int"), F.when(s % 28 == 0, 0).otherwise(s % 28 + 0x11A7)))


def hangul_compose(cps) -> Column:
    """Code points with adjacent L V and LV T joined, by a left fold."""

    def step(acc: Column, x: Column) -> Column:
        last = F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(-1))
        front = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array().cast("array<int>"))
        lv = is_hangul_leading(last) & is_hangul_vowel(x)
        lvt = is_hangul_syllable(last) & ((last - 0xAC00) % 28 == 0) & is_hangul_trailing(x)
        joined = F.when(lv, F.lit(0xAC00) + (last - 0x1100) * 588 + (x - 0x1161) * 28).otherwise(last + x - 0x11A7)
        return F.when(lv | lvt, F.array_append(front, joined)).otherwise(F.array_append(acc, x))

    return F.aggregate(_col(cps).cast("array<int>"), F.array().cast("array<int>"), step)


def character(cp) -> Column:
    """The code point as text. Decoding alone would take U+FEFF for a byte order mark."""
    c = _col(cp).cast("int")
    return F.when(c == 0xFEFF, F.lit("\ufeff")).otherwise(F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))


def encode(cp, charset: str = "UTF-8") -> Column:
    """The code point's bytes; empty for surrogates, values past 10FFFF, and what the charset cannot hold."""
    c = _col(cp).cast("int")
    ok = c.between(0, MAX) & ~c.between(0xD800, 0xDFFF)
    text = character(c)
    cs = charset.upper()
    if cs in ("ASCII", "US-ASCII"):
        return F.when(ok & (c < 128), F.encode(text, "US-ASCII")).otherwise(F.lit(b""))
    if cs in ("UTF-32LE", "UTF-32BE", "UTF-32"):
        h = F.lpad(F.hex(c), 8, "0")
        if cs == "UTF-32LE":
            h = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
        return F.when(ok, F.unhex(h)).otherwise(F.lit(b""))
    return F.when(ok, F.encode(text, cs)).otherwise(F.lit(b""))


#: General categories in the order of their numbers; 0 is unset.
CATEGORIES = ("", "Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Cs", "Co", "Cn")


def category_is_graphic(gc) -> Column:
    return ~_col(gc).isin("Cc", "Cf", "Cs", "Co", "Cn", "")


def category_is_combining(gc) -> Column:
    return _col(gc).isin("Mn", "Mc", "Me")


@functools.lru_cache(maxsize=512)
def ranges(prop: str) -> tuple[tuple[int, int], ...]:
    r"""Ranges of code points that match \p{prop}; surrogates are looked up like the others."""
    text = "".join(map(chr, range(MAX + 1)))
    return tuple((m.start(), m.end() - 1) for m in regex.finditer(rf"\p{{{prop}}}+", text))


def has_property(cp, prop: str) -> Column:
    r"""Whether \p{prop} holds, by a regular expression of explicit ranges."""
    rs, c = ranges(prop), _col(cp).cast("int")
    if not rs:
        return F.lit(False)
    # A class of Java's regular expressions, made of explicit ranges: one compiled pattern per task.
    body = "".join(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in rs if not 0xD800 <= lo <= hi <= 0xDFFF)
    text = character(c)
    return F.coalesce(c.between(0, MAX) & ~c.between(0xD800, 0xDFFF) & text.rlike(f"^[{body}]$"), F.lit(False))


#: Binary properties that have a predicate of their own.
NAMED = {"id_start": "ID_Start", "id_continue": "ID_Continue", "xid_start": "XID_Start", "xid_continue": "XID_Continue", "pattern_syntax": "Pattern_Syntax", "emoji": "Emoji", "emoji_presentation": "Emoji_Presentation", "emoji_modifier_base": "Emoji_Modifier_Base", "emoji_component": "Emoji_Component", "extended_pictographic": "Extended_Pictographic", "combining": "M"}


def is_graphic(cp) -> Column:
    """An assigned character that is neither control, format, surrogate nor private use."""
    c = _col(cp).cast("int")
    return F.coalesce(c.between(0, MAX) & ~c.between(0xD800, 0xDFFF), F.lit(False)) & ~has_property(cp, "C")


#: The flags of a code point's emoji record.
EMOJI_FLAGS = {"emoji": "Emoji", "presentation": "Emoji_Presentation", "modifier": "Emoji_Modifier", "modifier_base": "Emoji_Modifier_Base", "component": "Emoji_Component", "extended_pictographic": "Extended_Pictographic"}


def emoji_properties(cp) -> Column:
    """struct of EMOJI_FLAGS, null for a code point without any of them."""
    flags = {n: has_property(cp, p) for n, p in EMOJI_FLAGS.items()}
    return F.when(functools.reduce(operator.or_, flags.values()), F.struct(*(v.alias(n) for n, v in flags.items())))


def for_each_codepoint(df: DataFrame, text: str, go_on=None, records: bool = False) -> DataFrame:
    """A row for each code point of df's texts: df's columns, pos from 0, cp, first and last; null and empty texts have none.

    go_on: a function of the code point's column; a text stops after the first code point for which it is not true.
    records: join the record of each, and leave out code points that have none.
    """
    cps = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))
    if go_on is not None:
        stop = lambda x: F.array_position(F.transform(x, lambda c: F.coalesce(go_on(c), F.lit(False))), False)
        cps = F.transform(F.array(cps), lambda x: F.when(stop(x) > 0, F.slice(x, 1, stop(x).cast("int"))).otherwise(x))[0]
    out = df.drop("pos", "cp", "first", "last").withColumn("_cps", cps).select("*", F.size("_cps").alias("_n"), F.posexplode("_cps").alias("pos", "cp"))
    out = out.withColumns({"first": F.col("pos") == 0, "last": F.col("pos") == F.col("_n") - 1}).drop("_cps", "_n")
    # As many records as there are characters, whatever the texts.
    return out.join(F.broadcast(characters(df.sparkSession)), "cp") if records else out


def histogram(df: DataFrame, text: str) -> DataFrame:
    """(cp int, n, n_first): how often each code point is in df's texts, and how often a text begins with it.

    Workers count the code points of a batch with one pass over an array, so what is shuffled is a row for each code
    point and batch. Null and empty texts count nothing.
    """

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            n, first = (np.bincount(x, minlength=MAX + 1) for x in (cps, np.array([ord(t[0]) for t in texts], np.uint32)))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(first[at])], names=["cp", "n", "n_first"])

    counted = df.select(F.col(text).cast("string")).mapInArrow(count, "cp int, n bigint, n_first bigint")
    return counted.groupBy("cp").agg(F.sum("n").alias("n"), F.sum("n_first").alias("n_first"))


def property_ranges(spark: SparkSession, props: list[str]) -> DataFrame:
    """(prop, lo, hi): a dimension table, for a join with cp between lo and hi."""
    return spark.createDataFrame([(p, lo, hi) for p in props for lo, hi in ranges(p)], "prop string, lo int, hi int")


@functools.lru_cache(maxsize=1)
def category_ranges() -> tuple[tuple[int, int, str], ...]:
    out: list[list] = []
    for gc in CATEGORIES[1:]:
        out += [[lo, hi, gc] for lo, hi in ranges(f"gc={gc}")]
    return tuple(map(tuple, sorted(out)))


def character_record(cp: int) -> dict | None:
    """The record of one code point, None if it has none (unassigned, private use)."""
    c = chr(cp)
    gc = unicodedata.category(c)
    if gc in ("Cn", "Co"):
        return None
    kind = unicodedata.decomposition(c)
    upper, lower = (x if len(x) == 1 else c for x in (c.upper(), c.lower()))
    return {"cp": cp, "name": unicodedata.name(c, ""), "category": gc, "combining": unicodedata.combining(c), "bidi": unicodedata.bidirectional(c), "decomposition": kind.split(" ")[0] if kind.startswith("<") else ("canonical" if kind else "none"), "decimal": unicodedata.decimal(c, -1), "digit": unicodedata.digit(c, -1), "mirrored": bool(unicodedata.mirrored(c)), "upper": ord(upper) if upper != c else 0, "lower": ord(lower) if lower != c else 0, "east_asian_width": unicodedata.east_asian_width(c)}


RECORD = "cp int, name string, category string, combining int, bidi string, decomposition string, decimal int, digit int, mirrored boolean, upper int, lower int, east_asian_width string"


def characters(spark: SparkSession) -> DataFrame:
    """The relation of character records, made in parallel over the code space."""

    def records(batches):
        import pyarrow as pa

        for b in batches:
            rows = [r for i in b.column(0).to_pylist() if (r := character_record(i))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    import pyarrow as pa

    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in RECORD.split(", ")])
    return spark.range(0, MAX + 1).select(F.col("id").cast("int").alias("cp")).mapInArrow(records, RECORD)
