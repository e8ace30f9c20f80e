"""Enumerated properties of code points as range tables; the ranges come from ICU, read once on the driver."""

from __future__ import annotations

import functools
import unicodedata
from fractions import Fraction

import pyarrow as pa
import regex
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .codepoints import MAX, _col

_SHORT, _LONG, _PAGE = 0, 1, 8


def _icu():
    return SparkSession.active()._jvm.com.ibm.icu.lang.UCharacter


def property_name(prop: str) -> str:
    """Long name of a property given by any alias, `Unknown` without one."""
    try:
        return _icu().getPropertyName(_icu().getPropertyEnum(prop), _LONG) or "Unknown"
    except IllegalArgumentException:  # a name that ICU does not know
        return "Unknown"


@functools.lru_cache(maxsize=64)
def enumerated_ranges(prop: str) -> tuple[tuple[int, int, int, str], ...]:
    """(lo, hi, value, long name of the value) of an enumerated property, ordered; every code point is in one range."""
    icu, jvm, out = _icu(), SparkSession.active()._jvm, []
    which = icu.getPropertyEnum(prop)
    for v in range(icu.getIntPropertyMinValue(which), icu.getIntPropertyMaxValue(which) + 1):
        held = jvm.com.ibm.icu.text.UnicodeSet().applyIntPropertyValue(which, v)
        if n := held.getRangeCount():
            try:
                name = icu.getPropertyValueName(which, v, _LONG)
            except IllegalArgumentException:  # combining classes without a name
                name = None
            out += [(held.getRangeStart(i), held.getRangeEnd(i), v, name or str(v)) for i in range(n)]
    return tuple(sorted(out))


def _with_ranges(df: DataFrame, cp: str, ranges: list[tuple[int, int, str]], to: str) -> DataFrame:
    """df with `to`, the name of the range that holds column cp, else null.

    The ranges, cut at pages of 256 code points, are broadcast: at most one row for each page and range, whatever df
    holds. The join is by page, so it is a hash join.
    """
    rows = [(p, max(lo, p << _PAGE), min(hi, (p << _PAGE) + 255), name) for lo, hi, name in ranges for p in range(lo >> _PAGE, (hi >> _PAGE) + 1)]
    pages = df.sparkSession.createDataFrame(rows, f"_page int, _lo int, _hi int, `{to}` string")
    page = F.shiftright(F.col(cp).cast("int"), _PAGE)
    found = df.drop(to).join(F.broadcast(pages), (page == F.col("_page")) & F.col(cp).between(F.col("_lo"), F.col("_hi")), "left")
    return found.drop("_page", "_lo", "_hi")


def with_property(df: DataFrame, cp: str, prop: str, to: str) -> DataFrame:
    """df with column `to` (string): the value of an enumerated property at df's column cp; null outside the code space."""
    return _with_ranges(df, cp, [(lo, hi, name) for lo, hi, _, name in enumerated_ranges(prop)], to)


def _block_title(name: str) -> str:
    """Name of a block from its alias, where spaces and hyphens are underscores and all words begin with capitals."""
    name = regex.sub(r"(?<!Extension)_(?=[A-Z]$)|(?<=Latin)_(?=1)|(?<=Phags)_(?=Pa)", "-", name).replace("_", " ")
    return regex.sub(r" (And|For|Of) ", lambda m: m[0].lower(), name)


def _block_ranges() -> list[tuple[int, str, int, int]]:
    return [(v, _block_title(name), lo, hi) for lo, hi, v, name in enumerated_ranges("Block") if v]


def blocks(spark: SparkSession) -> DataFrame:
    """(id, name, start, end) of the blocks."""
    return spark.createDataFrame(_block_ranges(), "id int, name string, start int, end int")


def codepoint_block(df: DataFrame, cp: str, to: str = "block") -> DataFrame:
    """df with the name of the block of column cp, null where there is none."""
    return _with_ranges(df, cp, [(lo, hi, name) for _, name, lo, hi in _block_ranges()], to)


@functools.lru_cache(maxsize=1)
def scripts() -> tuple[str, ...]:
    """Short names of all scripts with characters, without the common, inherited and unknown ones."""
    icu = _icu()
    which = icu.getPropertyEnum("Script")
    found = {icu.getPropertyValueName(which, v, _SHORT) for _, _, v, _ in enumerated_ranges("Script")}
    return tuple(sorted(found - {"Zyyy", "Zinh", "Zzzz"}))


def script_extensions(cp) -> Column:
    """array<string>: the scripts that use a code point, by short names, else its own one (Zzzz if unset); null outside."""
    known = (*scripts(), "Zyyy", "Zinh")

    @F.arrow_udf("array<string>")
    def apply(cps: pa.Array) -> pa.Array:
        of = functools.lru_cache(50_000)(lambda c: [s for s in known if regex.match(rf"\p{{scx={s}}}", c)] or ["Zzzz"])
        return pa.array([None if x is None or not 0 <= x <= MAX else of(chr(x)) for x in cps.to_pylist()], pa.list_(pa.string()))

    return apply(_col(cp).cast("long"))


def numeric_value(cp) -> Column:
    """struct<decimal, digit, numeric>: -1 for no decimal or digit value, numeric as text such as 1/2; null without any."""
    kind = pa.struct([("decimal", pa.int32()), ("digit", pa.int32()), ("numeric", pa.string())])

    @F.arrow_udf("struct<decimal:int,digit:int,numeric:string>")
    def apply(cps: pa.Array) -> pa.Array:
        def value(x: int | None) -> dict | None:
            if x is None or not 0 <= x <= MAX or (n := unicodedata.numeric(chr(x), None)) is None:
                return None
            # Denominators go up to 320.
            return {"decimal": unicodedata.decimal(chr(x), -1), "digit": unicodedata.digit(chr(x), -1), "numeric": str(Fraction(n).limit_denominator(400))}

        return pa.array([value(x) for x in cps.to_pylist()], kind)

    return apply(_col(cp).cast("long"))
