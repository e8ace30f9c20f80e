"""Session settings, messages and versions."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import _col

#: Messages by status.
MESSAGES = (
    "The operation completed successfully",
    "One or more arguments are invalid or inconsistent with the requested operation",
    "The encoding is invalid or missing required byte-order information",
    "The codepoint is not a valid Unicode scalar value",
    "The normalization form is invalid",
    "The requested operation, conversion, or value is not supported",
    "Memory allocation failed",
    "The required size exceeds the supported range",
    "The input contains a malformed code-unit sequence",
    "The output buffer is too small for the complete result",
    "The callback requested that iteration stop",
    "No Unicode data was found for the requested value",
    "The requested feature was disabled when the library was built",
)
UNKNOWN = "The status code is unknown"

VERSION = (0, 1, 0)
_LOCALE = "textloom.locale"


def status_message(status) -> Column:
    """Message of a status number; null is unknown, too."""
    texts = F.array(*map(F.lit, MESSAGES))
    return F.coalesce(F.get(texts, _col(status).cast("int")), F.lit(UNKNOWN))


def set_locale(spark: SparkSession, locale: str) -> None:
    """Locale of this session's case mapping; ValueError, and no change, if it is no language tag."""
    from .identity import parse_locale_str

    if parse_locale_str(locale) is None:
        raise ValueError(MESSAGES[1])
    spark.conf.set(_LOCALE, locale)


def get_locale(spark: SparkSession) -> str:
    return spark.conf.get(_LOCALE, "en")


def reset_locale(spark: SparkSession) -> None:
    spark.conf.unset(_LOCALE)


def version() -> str:
    return ".".join(map(str, VERSION))


def version_number() -> int:
    """Four bits for each part of the version."""
    major, minor, patch = VERSION
    return major << 8 | minor << 4 | patch


def unicode_version() -> dict[str, str]:
    """Sources of character data, and the version of each."""
    icu = SparkSession.active()._jvm.com.ibm.icu.lang.UCharacter.getUnicodeVersion()
    return {"python": unicodedata.unidata_version, "regex": regex.__version__, "icu": f"{icu.getMajor()}.{icu.getMinor()}.{icu.getMilli()}"}
