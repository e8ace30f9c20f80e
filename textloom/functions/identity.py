"""Keys and tests of identity: caseless keys, collations, scripts, identifiers, language tags."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import properties
from .codepoints import ranges
from .text import Memo, _col, _mapped, nfkc_casefold_str


def caseless_key_str(t: str, mode: str) -> str:
    nfd = lambda x: unicodedata.normalize("NFD", x)
    if t.isascii():
        return t.lower()
    if mode == "unnormalized":
        return t.casefold()
    if mode == "canonical":
        return nfd(nfd(t).casefold())
    if mode == "compatibility":
        kd = lambda x: unicodedata.normalize("NFKD", x)
        return kd(kd(kd(nfd(t).casefold())).casefold())
    if mode == "identifier":
        return nfd(nfkc_casefold_str(nfd(t)))
    raise ValueError(f"unknown mode {mode}")


def caseless_key(text, mode: str = "canonical") -> Column:
    """A key that is equal for two texts just if they match without case: unnormalized, canonical, compatibility, identifier."""
    return _mapped(lambda t: caseless_key_str(t, mode), pa.string(), "string")(_col(text))


def caseless_match(a, b, mode: str = "canonical") -> Column:
    return caseless_key(a, mode) == caseless_key(b, mode)


def caseless_join(left: DataFrame, right: DataFrame, on: str, mode: str = "canonical", how: str = "inner") -> DataFrame:
    """Rows whose `on` texts match without case: an equi-join on the key, each side's key made once."""
    r = right.withColumn("_key", caseless_key(on, mode)).withColumnRenamed(on, f"{on}_right")
    return left.withColumn("_key", caseless_key(on, mode)).join(r, "_key", how).drop("_key")


#: Strength -> Spark collation: base letters; accents too; case too.
COLLATIONS = {"primary": "UNICODE_CI_AI", "secondary": "UNICODE_CI", "tertiary": "UNICODE"}


def collated(text, strength: str = "tertiary") -> Column:
    """The text under a root collation; order, group or compare by it."""
    return F.collate(_col(text), COLLATIONS[strength])


#: What a script implies in resolution.
_AUGMENTED = {"Hani": ("Hanb", "Jpan", "Kore"), "Hira": ("Jpan",), "Kana": ("Jpan",), "Hang": ("Kore",), "Bopo": ("Hanb",)}


def _augmented(c: str, scripts: tuple[str, ...]) -> frozenset[str] | None:
    """Scripts of a character with what they imply; None for Common and Inherited: any."""
    if regex.match(r"[\p{scx=Zyyy}\p{scx=Zinh}]", c):
        return None
    own = {s for s in scripts if regex.match(rf"\p{{scx={s}}}", c)} or {"Zzzz"}
    return frozenset(own.union(*(_AUGMENTED.get(s, ()) for s in own)))


def resolve_scripts_str(t: str, known: Memo) -> dict:
    """known: the Memo of _augmented over all scripts."""
    out: frozenset[str] | None = None
    for c in set(t):
        if (s := known[c]) is not None:
            out = s if out is None else out & s
    return {"kind": "ALL" if out is None else "RESOLVED" if out else "EMPTY", "scripts": sorted(out or ())}


def resolved_scripts(text) -> Column:
    """struct<kind, scripts>: the scripts that all characters share; EMPTY means mixed, ALL means common characters only."""
    kind = pa.struct([("kind", pa.string()), ("scripts", pa.list_(pa.string()))])
    names = properties.scripts()
    known = Memo(lambda c: _augmented(c, names))
    return _mapped(lambda t: resolve_scripts_str(t, known), kind, "struct<kind:string,scripts:array<string>>")(_col(text))


def is_identifier(text, xid: bool = False) -> Column:
    """First character of (X)ID_Start, the others of (X)ID_Continue; no normalisation; false for empty texts."""

    def body(prop: str) -> str:
        return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges(prop))

    x = "X" if xid else ""
    return _col(text).rlike(f"^[{body(x + 'ID_Start')}][{body(x + 'ID_Continue')}]*\\z")


#: Tags kept whole for compatibility.
GRANDFATHERED = "en-GB-oed i-ami i-bnn i-default i-enochian i-hak i-klingon i-lux i-mingo i-navajo i-pwn i-tao i-tay i-tsu sgn-BE-FR sgn-BE-NL sgn-CH-DE art-lojban cel-gaulish no-bok no-nyn zh-guoyu zh-hakka zh-min zh-min-nan zh-xiang".split()
LOCALE_FIELDS = ("language", "extlang", "script", "region", "variant", "extensions", "private_use", "grandfathered")
_TAG = regex.compile(
    r"(?i)(?P<language>[a-z]{2,3}(?=(?P<ext>(?:-[a-z]{3}(?![a-z0-9])){0,3}))(?P=ext)|[a-z]{4}|[a-z]{5,8})"
    r"(?:-(?P<script>[a-z]{4}))?(?:-(?P<region>[a-z]{2}|[0-9]{3}))?(?P<variant>(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*)"
    r"(?P<extensions>(?:-[a-wy-z0-9](?:-[a-z0-9]{2,8})+)*)(?:-(?P<private>x(?:-[a-z0-9]{1,8})+))?"
)


def parse_locale_str(tag: str) -> dict | None:
    """Subtags of a BCP 47 tag, each in its customary case, a tag kept whole in lower case; None if it is not well-formed."""
    none = dict.fromkeys(LOCALE_FIELDS, "")
    whole = {g.lower(): g for g in GRANDFATHERED}.get(tag.lower())
    if whole:
        return none | {"grandfathered": whole.lower()}
    if regex.fullmatch(r"(?i)x(?:-[a-z0-9]{1,8})+", tag):
        return none | {"private_use": tag.lower()}
    m = _TAG.fullmatch(tag)
    if not m:
        return None
    variants = [v.lower() for v in m["variant"].split("-")[1:]]
    singles = [x.lower() for x in regex.findall(r"(?<=-)[a-wy-zA-WY-Z0-9](?=-)", m["extensions"] + "-")]
    if len(set(variants)) < len(variants) or len(set(singles)) < len(singles):
        return None
    language, _, ext = m["language"].partition("-")
    return none | {"language": language.lower(), "extlang": ext.lower(), "script": (m["script"] or "").title(), "region": (m["region"] or "").upper(), "variant": "-".join(variants), "extensions": m["extensions"][1:].lower(), "private_use": (m["private"] or "").lower()}


def parse_locale(tag) -> Column:
    kind = pa.struct([(f, pa.string()) for f in LOCALE_FIELDS])
    return _mapped(parse_locale_str, kind, "struct<" + ",".join(f"{f}:string" for f in LOCALE_FIELDS) + ">")(_col(tag))
