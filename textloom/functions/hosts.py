"""Host names by UTS #46, non-transitional: mapping, Punycode, validity of labels, joiners, bidirectional rule, lengths."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import Column

from .text import Memo, _col, _mapped, into

#: Error bits.
IDNA_ERRORS = {"PUNYCODE": 0x1, "EMPTY_LABEL": 0x2, "HYPHEN": 0x4, "NOT_NFC": 0x8, "LEADING_MARK": 0x10, "DISALLOWED": 0x20, "STD3": 0x40, "CONTEXTJ": 0x80, "BIDI": 0x100, "LABEL_LENGTH": 0x200, "DOMAIN_LENGTH": 0x400}
_NOT_STD3 = regex.compile(r"[\x00-\x2C\x2E\x2F\x3A-\x60\x7B-\x7F]")
_JOINER = regex.compile("[‌‍]")


def _mapping(c: str) -> tuple[str, str]:
    """(status V, D, M, I or X, replacement) of a character in the mapping table of the installed idna package."""
    from idna import uts46data as table

    i = bisect_right(table.uts46_starts, ord(c)) - 1
    status = chr(table.uts46_statuses[i])
    return status, (table.uts46_replacements[i] or "") if status == "M" else "" if status == "I" else c


_MAPPING = Memo(_mapping)


def _decoded(label: str) -> tuple[str, bool]:
    """A label without its Punycode, and whether that was in order; what cannot be decoded stays."""
    if not label.startswith("xn--"):
        return label, True
    try:
        plain = label[4:].encode("ascii").decode("punycode")
    except UnicodeError:
        return label, False
    if any("\ud800" <= c <= "\udfff" for c in plain):
        return label, False
    if not plain:
        return "" if len(label) == 4 else label, False
    return plain, not plain.isascii()


def _joiners_fit(label: str) -> bool:
    """ContextJ: a joiner follows a virama; a non-joiner may stand between letters that join, too."""
    for m in _JOINER.finditer(label):
        i = m.start()
        if i and unicodedata.combining(label[i - 1]) == 9:
            continue
        if label[i] == "‍" or not (regex.search(r"[\p{jt=L}\p{jt=D}]\p{jt=T}*$", label[:i]) and regex.match(r"\p{jt=T}*[\p{jt=R}\p{jt=D}]", label[i + 1 :])):
            return False
    return True


def _bidi_fits(label: str) -> bool:
    """The rule of RFC 5893 for labels of a host that holds right-to-left characters."""
    kinds = [unicodedata.bidirectional(c) or "L" for c in label]
    both = {"EN", "ES", "CS", "ET", "ON", "BN", "NSM"}
    solid = next((k for k in reversed(kinds) if k != "NSM"), kinds[0])
    if kinds[0] in ("R", "AL"):
        return both.union(("R", "AL", "AN")).issuperset(kinds) and not {"EN", "AN"}.issubset(kinds) and solid in ("R", "AL", "EN", "AN")
    return kinds[0] == "L" and both.union("L").issuperset(kinds) and solid in ("L", "EN")


def idna_str(t: str, to_ascii: bool) -> dict:
    e, errors = IDNA_ERRORS, 0
    host = t.lower() if t.isascii() else unicodedata.normalize("NFC", "".join(_MAPPING[c][1] for c in t))
    labels = []
    for label in host.split("."):
        plain, fine = _decoded(label)
        errors |= 0 if fine else e["PUNYCODE"]
        labels.append(plain)
    # Decoding may bring further dots, which part labels like any others.
    labels = ".".join(labels).split(".")
    bidi = not all(x.isascii() for x in labels) and any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for x in labels for c in x)
    for i, label in enumerate(labels):
        if not label:
            errors |= 0 if i and i == len(labels) - 1 else e["EMPTY_LABEL"]
            continue
        errors |= e["HYPHEN"] * (label[0] == "-" or label[-1] == "-" or label[2:4] == "--")
        errors |= e["STD3"] * bool(_NOT_STD3.search(label))
        if label.isascii():
            errors |= e["DISALLOWED"] * any(c.isupper() for c in label)
        else:
            errors |= e["NOT_NFC"] * (not unicodedata.is_normalized("NFC", label))
            errors |= e["LEADING_MARK"] * (unicodedata.category(label[0])[0] == "M")
            errors |= e["DISALLOWED"] * any(_MAPPING[c][0] not in "VD" for c in label)
            errors |= e["CONTEXTJ"] * (not _joiners_fit(label))
        errors |= e["BIDI"] * (bidi and not _bidi_fits(label))
    if to_ascii:
        labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels]
        errors |= e["LABEL_LENGTH"] * any(not 0 < len(x) <= 63 for x in labels)
        errors |= e["DOMAIN_LENGTH"] * (not 0 < len(".".join(labels)) <= 253)
    return {"output": ".".join(labels), "errors": errors}


def idna(host, to_ascii: bool = True) -> Column:
    """struct<output, errors>: a host mapped, checked and, to_ascii, encoded; the best effort where there are errors.

    errors are bits of IDNA_ERRORS; lengths are checked to_ascii only, where the root's empty label counts as too short.
    Null stays null.
    """
    kind = pa.struct([("output", pa.string()), ("errors", pa.int32())])
    return _mapped(lambda t: idna_str(t, to_ascii), kind, "struct<output:string,errors:int>")(_col(host))


def idna_to_ascii(host) -> Column:
    return idna(host, True)


def idna_to_unicode(host) -> Column:
    return idna(host, False)


def idna_into(host, max_bytes, to_ascii: bool = True) -> Column:
    """struct<output, size, status> of a converted host; its errors are those of idna()."""
    return into(idna(host, to_ascii)["output"], max_bytes)
