"""Bidirectional text (UAX #9): levels, visual order and runs of a text, as Arrow functions."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .text import _col, _streamed, parts

MAX_DEPTH, MAX_BRACKETS = 125, 63
_ISOLATES, _EMBEDDINGS = {"LRI", "RLI", "FSI"}, {"LRE": 0, "RLE": 1, "LRO": 0, "RLO": 1}
_NEUTRAL = {"B", "S", "WS", "ON", "PDI", *_ISOLATES}
_REMOVED = {"BN", "PDF", *_EMBEDDINGS}
#: Lines that a worker turns into Python objects at once.
ROWS = 200


@functools.lru_cache(maxsize=1)
def pairs() -> tuple[dict[str, str], dict[str, tuple[str, bool]]]:
    """(mirror of each mirrored character, bracket -> (identity of its pair, whether it opens)), from ICU on the driver."""
    icu = SparkSession.active()._jvm.com.ibm.icu.lang.UCharacter
    mirrors, brackets = {}, {}
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.mirrored(c):
            mirrors[c] = chr(icu.getMirror(cp))
            if unicodedata.category(c) in ("Ps", "Pe") and (other := icu.getBidiPairedBracket(cp)) != cp:
                opens = unicodedata.category(c) == "Ps"
                brackets[c] = (unicodedata.normalize("NFD", c if opens else chr(other)), opens)
    return mirrors, brackets


def _matching(classes: list[str]) -> dict[int, int]:
    """Isolate initiators and the PDI of each, both ways; a paragraph separator closes all."""
    out, waiting = {}, []
    for i, c in enumerate(classes):
        if c in _ISOLATES:
            waiting.append(i)
        elif c == "B":
            waiting.clear()
        elif c == "PDI" and waiting:
            j = waiting.pop()
            out[i], out[j] = j, i
    return out


def _first_strong(classes: list[str], i: int, end: int, match: dict[int, int]) -> int:
    while i < end and classes[i] != "B":
        if classes[i] in ("L", "R", "AL"):
            return int(classes[i] != "L")
        i = match.get(i, end) if classes[i] in _ISOLATES else i + 1
    return 0


def _explicit(classes: list[str], base: int, match: dict[int, int]) -> tuple[list[int], list[str]]:
    """Levels by X1 to X8 (-1 where X9 removes) and classes after overrides."""
    levels, kinds = [], list(classes)
    stack, lost_isolates, lost_embeddings, isolates = [(base, "", False)], 0, 0, 0
    for i, c in enumerate(classes):
        level, override, _ = stack[-1]
        if c in _EMBEDDINGS:
            new = level + 1 + ((level + 1) % 2 != _EMBEDDINGS[c])
            if new <= MAX_DEPTH and not lost_isolates and not lost_embeddings:
                stack.append((new, {"LRO": "L", "RLO": "R"}.get(c, ""), False))
            elif not lost_isolates:
                lost_embeddings += 1
        elif c == "PDF":
            if lost_isolates:
                pass
            elif lost_embeddings:
                lost_embeddings -= 1
            elif not stack[-1][2] and len(stack) > 1:
                stack.pop()
        elif c == "PDI":
            if lost_isolates:
                lost_isolates -= 1
            elif isolates:
                lost_embeddings = 0
                while not stack.pop()[2]:
                    pass
                isolates -= 1
            level, override, _ = stack[-1]
        elif c == "B":
            stack, lost_isolates, lost_embeddings, isolates = [(base, "", False)], 0, 0, 0
            level, override = base, ""
        levels.append(-1 if c in _REMOVED else level)
        if override and c not in _REMOVED:
            kinds[i] = override
        if c in _ISOLATES:
            odd = c == "RLI" or c == "FSI" and _first_strong(classes, i + 1, match.get(i, len(classes)), match)
            new = level + 1 + ((level + 1) % 2 != int(odd))
            if new <= MAX_DEPTH and not lost_isolates and not lost_embeddings:
                isolates += 1
                stack.append((new, "", True))
            else:
                lost_isolates += 1
    return levels, kinds


def _sequences(classes: list[str], levels: list[int], match: dict[int, int]) -> list[list[int]]:
    """Isolating run sequences (BD13): positions of each."""
    runs: list[list[int]] = []
    for i in (i for i, x in enumerate(levels) if x >= 0):
        if runs and levels[runs[-1][-1]] == levels[i] and classes[runs[-1][-1]] != "B":
            runs[-1].append(i)
        else:
            runs.append([i])
    heads, out = {r[0]: r for r in runs}, []
    for r in runs:
        if classes[r[0]] == "PDI" and r[0] in match:
            continue
        whole = list(r)
        while classes[whole[-1]] in _ISOLATES and match.get(whole[-1]) in heads:
            whole += heads[match[whole[-1]]]
        out.append(whole)
    return out


def _weak(kinds: list[str], sos: str) -> None:
    """W1 to W7, in place."""
    n, before = len(kinds), sos
    for i, k in enumerate(kinds):
        if k == "NSM":
            kinds[i] = "ON" if before in _ISOLATES or before == "PDI" else before
        before = kinds[i]
    strong = sos
    for i, k in enumerate(kinds):
        if k in ("L", "R", "AL"):
            strong = k
        elif k == "EN" and strong == "AL":
            kinds[i] = "AN"
    kinds[:] = ["R" if k == "AL" else k for k in kinds]
    for i in range(1, n - 1):
        a, b = kinds[i - 1], kinds[i + 1]
        if a == b and (kinds[i] == "ES" and a == "EN" or kinds[i] == "CS" and a in ("EN", "AN")):
            kinds[i] = a
    i = 0
    while i < n:
        if kinds[i] == "ET":
            j = i
            while j < n and kinds[j] == "ET":
                j += 1
            if i and kinds[i - 1] == "EN" or j < n and kinds[j] == "EN":
                kinds[i:j] = ["EN"] * (j - i)
            i = j
        else:
            i += 1
    strong = sos
    for i, k in enumerate(kinds):
        if k in ("ES", "ET", "CS"):
            kinds[i] = "ON"
        elif k in ("L", "R"):
            strong = k
        elif k == "EN" and strong == "L":
            kinds[i] = "L"


def _as_strong(k: str) -> str:
    return "R" if k in ("R", "EN", "AN") else "L" if k == "L" else ""


def _bracket_pairs(chars: list[str], kinds: list[str], brackets: dict[str, tuple[str, bool]]) -> list[tuple[int, int]]:
    found, waiting = [], []
    for i, c in enumerate(chars):
        if kinds[i] != "ON" or c not in brackets:
            continue
        pair, opens = brackets[c]
        if opens:
            if len(waiting) == MAX_BRACKETS:
                return []
            waiting.append((pair, i))
        else:
            for at in range(len(waiting) - 1, -1, -1):
                if waiting[at][0] == pair:
                    found.append((waiting[at][1], i))
                    del waiting[at:]
                    break
    return sorted(found)


def _neutral(chars: list[str], originals: list[str], kinds: list[str], sos: str, eos: str, own: str, brackets: dict) -> None:
    """N0 to N2, in place."""
    for a, b in _bracket_pairs(chars, kinds, brackets):
        inside = {_as_strong(k) for k in kinds[a + 1 : b]} - {""}
        if not inside:
            continue
        to = own
        if own not in inside:
            to = next((s for s in map(_as_strong, reversed(kinds[:a])) if s), sos)
        for at in (a, b):
            kinds[at] = to
            while at + 1 < len(kinds) and originals[at + 1] == "NSM":
                at += 1
                kinds[at] = to
    i, n = 0, len(kinds)
    while i < n:
        if kinds[i] in _NEUTRAL:
            j = i
            while j < n and kinds[j] in _NEUTRAL:
                j += 1
            left, right = _as_strong(kinds[i - 1]) if i else sos, _as_strong(kinds[j]) if j < n else eos
            kinds[i:j] = [left if left == right else own] * (j - i)
            i = j
        else:
            i += 1


def resolve_levels(t: str, direction: str, brackets: dict) -> tuple[int, list[int], list[str]]:
    """(paragraph level, level of each character or -1 where X9 removes it, class of each); direction LTR, RTL or AUTO."""
    classes = [unicodedata.bidirectional(c) or "L" for c in t]
    match = _matching(classes)
    base = {"LTR": 0, "RTL": 1}.get(direction, -1)
    base = _first_strong(classes, 0, len(t), match) if base < 0 else base
    if base == 0 and not any(c in ("R", "AL", "AN") or c in _EMBEDDINGS or c in _ISOLATES for c in classes):
        return 0, [-1 if c in _REMOVED else 0 for c in classes], classes
    levels, kinds = _explicit(classes, base, match)
    seen = [i for i, x in enumerate(levels) if x >= 0]
    place, explicit = {i: p for p, i in enumerate(seen)}, list(levels)
    for seq in _sequences(classes, levels, match):
        level = explicit[seq[0]]
        p, last = place[seq[0]], place[seq[-1]]
        before = explicit[seen[p - 1]] if p else base
        open_end = classes[seq[-1]] in _ISOLATES and seq[-1] not in match
        after = base if open_end or last + 1 == len(seen) else explicit[seen[last + 1]]
        sos, eos, own = ("RL"[max(x, level) % 2 == 0] for x in (before, after, 0))
        own = "LR"[level % 2]
        part = [kinds[i] for i in seq]
        _weak(part, sos)
        _neutral([t[i] for i in seq], [classes[i] for i in seq], part, sos, eos, own, brackets)
        for i, k in zip(seq, part, strict=True):
            levels[i] = level + (k != "L" if level % 2 == 0 else k != "R") + (level % 2 == 0 and k in ("AN", "EN"))
    trailing = True  # L1, from the end
    for i in reversed(seen):
        c = classes[i]
        trailing = c in ("S", "B") or trailing and (c in ("WS", "PDI") or c in _ISOLATES)
        if trailing:
            levels[i] = base
    return base, levels, classes


def visual_order(levels: list[int]) -> list[int]:
    """Positions in visual order (L2)."""
    order = list(range(len(levels)))
    odd = [x for x in levels if x % 2]
    for level in range(max(levels, default=0), min(odd, default=1) - 1, -1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and levels[order[j]] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return order


def runs_of(levels: list[int], order: list[int]) -> list[dict]:
    """Runs of one level in visual order: first logical position, length, level."""
    out: list[dict] = []
    for p in order:
        if out and out[-1]["level"] == levels[p]:
            out[-1]["start"], out[-1]["length"] = min(out[-1]["start"], p), out[-1]["length"] + 1
        else:
            out.append({"start": p, "length": 1, "level": levels[p]})
    return out


_RESOLVED = "struct<level:int,direction:string,chars:array<struct<cp:int,byte_offset:int,level:int,class:string,mirror:int>>,visual:array<int>,runs:array<struct<start:int,length:int,level:int>>>"


def _resolver(direction: str):
    """A list of texts -> the array of their _RESOLVED structs, built column by column."""
    mirrors, brackets = pairs()
    char = pa.struct([("cp", pa.int32()), ("byte_offset", pa.int32()), ("level", pa.int32()), ("class", pa.string()), ("mirror", pa.int32())])
    run = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("level", pa.int32())])
    kind = pa.struct([("level", pa.int32()), ("direction", pa.string()), ("chars", pa.list_(char)), ("visual", pa.list_(pa.int32())), ("runs", pa.list_(run))])
    ints = lambda x: pa.array(x, pa.int32())

    def resolve(texts: list[str | None]) -> pa.Array:
        bases, ends, run_ends = [], [0], [0]
        cps, offsets, shown, classes_, mirror, visual, runs = ([] for _ in range(7))
        for t in texts:
            base = None
            if t is not None:
                base, levels, classes = resolve_levels(t, direction, brackets)
                at, first = 0, len(cps)
                for c, level, k in zip(t, levels, classes, strict=True):
                    if level >= 0:
                        cps.append(ord(c))
                        offsets.append(at)
                        shown.append(level)
                        classes_.append(k)
                        mirror.append(ord(mirrors.get(c, c) if level % 2 else c))
                    at += len(c.encode())
                kept = shown[first:]
                order = visual_order(kept)
                visual += order
                runs += runs_of(kept, order)
            bases.append(base)
            ends.append(len(cps))
            run_ends.append(len(runs))
        chars = pa.StructArray.from_arrays([ints(cps), ints(offsets), ints(shown), pa.array(classes_, pa.string()), ints(mirror)], fields=list(char))
        lists = [pa.ListArray.from_arrays(ints(e), x) for e, x in ((ends, chars), (ends, ints(visual)), (run_ends, pa.array(runs, run)))]
        directions = pa.array([None if b is None else "RTL" if b else "LTR" for b in bases], pa.string())
        return pa.StructArray.from_arrays([ints(bases), directions, *lists], fields=list(kind), mask=pa.array([b is None for b in bases], pa.bool_()))

    return resolve


def bidi_resolve(text, direction: str = "AUTO") -> Column:
    """struct<level, direction, chars, visual, runs> of a text as one paragraph; null stays null.

    chars: (cp, byte_offset, level, class, mirror) without the characters that X9 removes; mirror is the character to
    show, as code point. visual: places in chars from left to right. runs: stretches of one level in visual order.
    Spark holds the rows of a batch beside the next function of a worker, and a struct has some 70 bytes a character:
    with_bidi() gives a column that can be cut down before that.
    """
    return _streamed(_resolver(direction), _RESOLVED)(_col(text))


def with_bidi(df: DataFrame, text: str, name: str, direction: str = "AUTO") -> DataFrame:
    """df with a column `name` as bidi_resolve() has it, of the column `text`. Rows leave as they come, in parts."""
    resolve, at = _resolver(direction), df.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for part in parts(batch.column(at)):
                own = batch.slice(first, len(part))
                first += len(part)
                yield pa.RecordBatch.from_arrays([*own.columns, resolve(part.to_pylist())], names=[*batch.schema.names, name])

    return df.mapInArrow(apply, StructType([*df.schema.fields, StructField(name, StructType.fromDDL(f"x {_RESOLVED}")[0].dataType)]))


def line_order(levels: list[int], classes: list[str], base: int, start: int, end: int) -> list[int]:
    """Positions of the line [start, end) of a paragraph from left to right, after L1 on that line and L2."""
    own, at = list(levels[start:end]), end - start
    while at and classes[start + at - 1] in ("WS", "S", "B", *_ISOLATES, "PDI"):
        at -= 1
        own[at] = base
    for i, c in enumerate(classes[start:end]):
        if c in ("S", "B"):  # and the white space in front of separators
            j = i
            while j >= 0 and (j == i or classes[start + j] in ("WS", *_ISOLATES, "PDI")):
                own[j] = base
                j -= 1
    return [start + p for p in visual_order(own)]


def bidi_reorder_line(resolved, start=0, end=None) -> Column:
    """array<int>: places in chars of a bidi_resolve() column from left to right, for the line [start, end) of it.

    start and end are numbers or columns, cut to the paragraph; without end the line goes to its end. White space at the
    line's end takes the paragraph's level (L1). Null stays null.
    """
    r = _col(resolved)
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    size = F.size(r["chars"])
    first = F.least(F.greatest(column(start).cast("int"), F.lit(0)), size)
    last = F.greatest(F.least(F.coalesce(column(end).cast("int"), size), size), first)
    line = F.slice(r["chars"], first + 1, last - first)  # only the line goes to a worker

    @F.arrow_udf("array<int>")
    def apply(base: pa.Array, levels: pa.Array, classes: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(base), ROWS):
            rows = zip(*(x.slice(i, ROWS).to_pylist() for x in (base, levels, classes, starts)), strict=True)
            out.append(pa.array([None if v is None else [s + p for p in line_order(v, c, b, 0, len(v))] for b, v, c, s in rows], pa.list_(pa.int32())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return apply(r["level"], F.transform(line, lambda x: x["level"]), F.transform(line, lambda x: x["class"]), first)
