"""Line break opportunities (UAX #14), as an Arrow function."""

from __future__ import annotations

import itertools

import pyarrow as pa
import regex
from pyspark.sql import Column

from .text import Memo, _col, _mapped, segments_iter

_CLASSES = "AI AK AL AP AS B2 BA BB BK CB CJ CL CM CP CR EB EM EX GL H2 H3 HH HL HY ID IN IS JL JT JV LF NL NS NU OP PO PR QU RI SA SG SP SY VF VI WJ XX ZW ZWJ"


_CLASSIFIER = "|".join(rf"(?P<{x}>\p{{Line_Break={x}}})" for x in _CLASSES.split())


def _facts(c: str) -> tuple[str, bool, bool, bool, bool]:
    """(class after LB1, East Asian, initial quote, final quote, reserved pictograph)."""
    kind = (m := regex.match(_CLASSIFIER, c)) and m.lastgroup or "XX"
    if kind == "SA":
        kind = "CM" if regex.match(r"[\p{Mn}\p{Mc}]", c) else "AL"
    kind = {"AI": "AL", "SG": "AL", "XX": "AL", "CJ": "NS"}.get(kind, kind)
    wide = bool(regex.match(r"[\p{ea=F}\p{ea=W}\p{ea=H}]", c))
    return kind, wide, bool(regex.match(r"\p{Pi}", c)), bool(regex.match(r"\p{Pf}", c)), bool(regex.match(r"[\p{ExtPict}&&\p{Cn}]", c, regex.V1))


_FACTS = Memo(_facts)


_HARD, _ALPHA, _CLOSE = {"BK", "CR", "LF", "NL"}, {"AL", "HL"}, {"CL", "CP"}
_JAMO, _IDEO = {"JL", "JV", "JT", "H2", "H3"}, {"ID", "EB", "EM"}
_NUMERIC_AFTER = {("PO", "NU"), ("PR", "NU"), ("HY", "NU"), ("IS", "NU")}
_HANGUL = {*(("JL", b) for b in ("JL", "JV", "H2", "H3")), *((a, b) for a in ("JV", "H2") for b in ("JV", "JT")), ("JT", "JT"), ("H3", "JT")}


class _Unit:
    """A base character with the marks that LB9 keeps with it."""

    __slots__ = ("kind", "wide", "initial", "final", "reserved", "char", "start", "joins")

    def __init__(self, c: str, start: int):
        self.kind, self.wide, self.initial, self.final, self.reserved = _FACTS[c]
        self.char, self.start, self.joins = c, start, self.kind == "ZWJ"
        if self.kind in ("CM", "ZWJ"):  # LB10
            self.kind = "AL"

    @property
    def base(self) -> bool:
        """An aksara, or the dotted circle that stands for one."""
        return self.kind in ("AK", "AS") or self.char == "◌"


def _units(t: str) -> list[_Unit]:
    out: list[_Unit] = []
    for i, c in enumerate(t):
        kind = _FACTS[c][0]
        if kind in ("CM", "ZWJ") and out and out[-1].kind not in (*_HARD, "SP", "ZW"):
            out[-1].joins = kind == "ZWJ"
        else:
            out.append(_Unit(c, i))
    return out


def _may_break(u: list[_Unit], i: int) -> bool | None:
    """Whether a line may end before unit i; None if it must."""
    a, b = u[i - 1], u[i]
    x, y = a.kind, b.kind
    after = u[i + 1] if i + 1 < len(u) else None
    before = u[i - 2] if i > 1 else None
    if x in _HARD:  # LB4, LB5
        return False if (x, y) == ("CR", "LF") else None
    if y in _HARD or y in ("SP", "ZW"):  # LB6, LB7
        return False
    j = i - 1
    while j >= 0 and u[j].kind == "SP":
        j -= 1
    s = u[j] if j >= 0 else None  # last unit before spaces
    z = s.kind if s else "sot"
    if z == "ZW":  # LB8
        return True
    if a.joins or y == "WJ" or x == "WJ" or x == "GL":  # LB8a, LB11, LB12
        return False
    if y == "GL" and x not in ("SP", "BA", "HY", "HH"):  # LB12a
        return False
    if y in ("CL", "CP", "EX", "SY") or z == "OP":  # LB13, LB14
        return False
    if z == "QU" and s.initial and (j == 0 or u[j - 1].kind in {*_HARD, "OP", "QU", "GL", "SP", "ZW"}):  # LB15a
        return False
    if y == "QU" and b.final and (after is None or after.kind in {*_HARD, *_CLOSE, "SP", "GL", "WJ", "QU", "EX", "IS", "SY", "ZW"}):  # LB15b
        return False
    if x == "SP" and y == "IS" and after and after.kind == "NU":  # LB15c
        return True
    if y == "IS":  # LB15d
        return False
    if z in _CLOSE and y == "NS" or z == y == "B2":  # LB16, LB17
        return False
    if x == "SP":  # LB18
        return True
    if y == "QU" and (not b.initial or not a.wide or after is None or not after.wide):  # LB19, LB19a
        return False
    if x == "QU" and (not a.final or not b.wide or before is None or not before.wide):
        return False
    if "CB" in (x, y):  # LB20
        return True
    if x in ("HY", "HH") and y in _ALPHA and (before is None or before.kind in {*_HARD, "SP", "ZW", "CB", "GL"}):  # LB20a
        return False
    if y in ("BA", "HH", "HY", "NS") or x == "BB":  # LB21
        return False
    if before and before.kind == "HL" and (x in ("HY", "HH") or x == "BA" and not a.wide) and y != "HL":  # LB21a
        return False
    if (x, y) == ("SY", "HL") or y == "IN":  # LB21b, LB22
        return False
    if x in _ALPHA and y == "NU" or x == "NU" and y in _ALPHA:  # LB23
        return False
    if x == "PR" and y in _IDEO or x in _IDEO and y == "PO":  # LB23a
        return False
    if x in ("PR", "PO") and y in _ALPHA or x in _ALPHA and y in ("PR", "PO"):  # LB24
        return False
    k = i - 1  # LB25
    if y in ("PO", "PR") and u[k].kind in _CLOSE:
        k -= 1
    while k >= 0 and u[k].kind in ("SY", "IS"):
        k -= 1
    if k >= 0 and u[k].kind == "NU" and (y in ("PO", "PR") or y == "NU" and x not in _CLOSE):
        return False
    if (x, y) in _NUMERIC_AFTER:
        return False
    if x in ("PO", "PR") and y == "OP" and after:
        third = u[i + 2].kind if i + 2 < len(u) else ""
        if after.kind == "NU" or after.kind == "IS" and third == "NU":
            return False
    if (x, y) in _HANGUL or x in _JAMO and y == "PO" or x == "PR" and y in _JAMO:  # LB26, LB27
        return False
    if x in _ALPHA and y in _ALPHA and not (a.base and b.base):  # LB28
        return False
    if x == "AP" and b.base or a.base and y in ("VF", "VI"):  # LB28a
        return False
    if x == "VI" and before and before.base and (y == "AK" or b.char == "◌"):
        return False
    if a.base and b.base and after and after.kind == "VF":
        return False
    if x in _ALPHA and y in _ALPHA:
        return False
    if x == "IS" and y in _ALPHA:  # LB29
        return False
    if x in {*_ALPHA, "NU"} and y == "OP" and not b.wide or x == "CP" and not a.wide and y in {*_ALPHA, "NU"}:  # LB30
        return False
    if x == y == "RI":  # LB30a
        k = i - 1
        while k >= 0 and u[k].kind == "RI":
            k -= 1
        return (i - 1 - k) % 2 == 0
    return not (y == "EM" and (x == "EB" or a.reserved))  # LB30b, LB31


def line_breaks_str(t: str) -> list[dict]:
    u, out = _units(t), []
    for i in range(1, len(u)):
        may = _may_break(u, i)
        if may is not False:
            out.append({"at": u[i].start, "kind": "MANDATORY" if may is None else "ALLOWED"})
    return [*out, {"at": len(t), "kind": "MANDATORY"}] if t else []


def line_breaks(text) -> Column:
    """array<struct<at, kind>>: code points before each break, ALLOWED or MANDATORY; the end of a text is MANDATORY.

    Empty texts have none; null stays null.
    """
    kind = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string())]))
    return _mapped(line_breaks_str, kind, "array<struct<at:int,kind:string>>")(_col(text))


def breaks_str(t: str, kind: str, every: bool = False) -> list[dict]:
    if kind == "line":
        found = {x["at"]: x["kind"] for x in line_breaks_str(t)}
    else:
        found = dict.fromkeys(itertools.accumulate(map(len, segments_iter(t, kind))), "ALLOWED")
    return [{"at": i, "kind": found.get(i, "NO_BREAK")} for i in (range(1, len(t) + 1) if every else found)]


def breaks(text, kind: str, every: bool = False) -> Column:
    """array<struct<at, kind>>: code points in front of each break of kind grapheme, word, sentence or line.

    Breaks are ALLOWED, those of lines also MANDATORY; with every, what is between two code points of one segment is
    there as NO_BREAK. Empty texts have none, null stays null.
    """
    out = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string())]))
    return _mapped(lambda t: breaks_str(t, kind, every), out, "array<struct<at:int,kind:string>>")(_col(text))
