"""Text to text, text to number: normalisation, case, filters, segmentation, width, encodings."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .codepoints import ranges


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Memo(dict):
    """Values of a function by its argument, emptied when they are many; travels to workers without its values."""

    def __init__(self, fn, limit: int = 50_000):
        self.fn, self.limit = fn, limit

    def __missing__(self, x):
        if len(self) >= self.limit:
            self.clear()
        v = self[x] = self.fn(x)
        return v

    def __reduce__(self):
        return Memo, (self.fn, self.limit)


def _mapped(fn, kind: pa.DataType, ddl: str):
    """An Arrow function of one text column; nulls stay null."""

    @F.arrow_udf(ddl)
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fn(t) for t in texts.to_pylist()], kind)

    return apply


#: Bytes of texts whose results _streamed() holds at once.
PART = 1 << 18


def parts(values: pa.Array, limit: int = PART) -> Iterator[pa.Array]:
    """An array of texts or bytes in slices of about `limit` bytes each; a longer value begins one."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1).tolist(), len(values)]
    return (values.slice(a, b - a) for a, b in itertools.pairwise(cuts))


def _streamed(build, ddl: str):
    """An Arrow function of one column of texts or bytes, for results much larger than these: they leave in parts.

    build: a list of values, some None -> the array of their results. No worker holds the results of a whole batch.
    """

    @F.arrow_udf(ddl)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            for part in parts(values):
                yield build(part.to_pylist())

    return apply


def normalize(text, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD. ASCII texts pass as they are."""
    form = form.upper()
    return _mapped(lambda t: t if t.isascii() else unicodedata.normalize(form, t), pa.string(), "string")(_col(text))


def nfkc_casefold_str(t: str) -> str:
    if t.isascii():
        return t.lower()
    ignorable = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
    for _ in range(8):
        new = ignorable.sub("", unicodedata.normalize("NFKC", t).casefold())
        if new == t:
            break
        t = new
    return unicodedata.normalize("NFC", t)


def nfkc_casefold(text) -> Column:
    """NFKC, full case folding and removal of default ignorable code points until nothing changes, then NFC."""
    return _mapped(nfkc_casefold_str, pa.string(), "string")(_col(text))


_MARK_RUNS = regex.compile(r"\P{ccc=0}{2,}")


def quick_check_str(t: str, form: str) -> str:
    """YES, NO or MAYBE, from each code point's own answer and the order of combining classes."""
    if t.isascii():
        return "YES"
    if regex.search(rf"\p{{{form}_QC=No}}", t):
        return "NO"
    for run in _MARK_RUNS.findall(t):
        classes = [unicodedata.combining(c) for c in run]
        if any(a > b > 0 for a, b in itertools.pairwise(classes)):
            return "NO"
    return "MAYBE" if form in ("NFC", "NFKC") and regex.search(rf"\p{{{form}_QC=Maybe}}", t) else "YES"


def quick_check(text, form: str) -> Column:
    return _mapped(lambda t: quick_check_str(t, form.upper()), pa.string(), "string")(_col(text))


_WORD_START = regex.compile(r"(?w)\b")


def _i_dots(t: str, lower: bool) -> str:
    """Turkish and Azeri: dotted and dotless i."""
    return t.replace("İ", "i").replace("İ", "i").replace("I", "ı").lower() if lower else t.replace("i", "İ").upper()


def _lithuanian_lower(t: str) -> str:
    t = t.replace("Ì", "i̇̀").replace("Í", "i̇́").replace("Ĩ", "i̇̃")
    above = r"(?=[^\p{ccc=0}\p{ccc=230}]*\p{ccc=230})"
    return regex.sub(rf"([IJĮ]){above}", lambda m: m[1].lower() + "̇", t).lower()


def _lithuanian_upper(t: str) -> str:
    return regex.sub(r"(\p{Soft_Dotted}[^\p{ccc=0}\p{ccc=230}]*)̇", r"\1", t).upper()


def map_case_str(t: str, op: str, locale: str = "en") -> str:
    tr, lt = locale in ("tr", "az"), locale == "lt"
    if op == "upper":
        return _i_dots(t, False) if tr else _lithuanian_upper(t) if lt else t.upper()
    if op == "lower":
        return _i_dots(t, True) if tr else _lithuanian_lower(t) if lt else t.lower()
    if op == "casefold":
        return t.casefold()
    if op == "casefold_simple":
        return "".join(f if len(f := c.casefold()) == 1 else (s if len(s := c.lower()) == 1 else c) for c in t)
    if op != "title":
        raise ValueError(f"unknown case mapping {op}")
    out = []
    for word in segments_str(t, "word"):
        m = regex.search(r"\p{Cased}", word)
        if m:
            i = m.start()
            first = "İ" if tr and word[i] == "i" else word[i].title()
            rest = map_case_str(word[i:], "lower", locale)
            head = map_case_str(word[i], "lower", locale)
            out.append(word[:i] + first + (rest[len(head) :] if rest.startswith(head) else map_case_str(word[i + 1 :], "lower", locale)))
        else:
            out.append(word)
    return "".join(out)


def map_case(text, op: str, locale: str | None = None) -> Column:
    """upper, lower, title, casefold or casefold_simple, by the language of a locale tag; None is the session's locale.

    Turkish, Azeri and Lithuanian have rules of their own. Without them, upper and lower stay in the JVM.
    """
    if locale is None:
        from .session import get_locale

        active = SparkSession.getActiveSession()
        locale = get_locale(active) if active else "en"
    language = locale.split("-")[0].lower()
    if language not in ("tr", "az", "lt") and op in ("upper", "lower"):
        return F.upper(_col(text)) if op == "upper" else F.lower(_col(text))
    return _mapped(lambda t: map_case_str(t, op, language), pa.string(), "string")(_col(text))


_SPACES = r"[\t-\r\p{Z}]"


def filter_text(text, normalize_: bool = False, controls: bool = False, spaces: bool = False, collapse: bool = False, numeric: bool = False, limit_combining: bool = False) -> Column:
    """Character filters in a fixed order: NFC, drop controls, unify spaces, collapse spaces, ASCII digits, at most 4 marks in a run."""
    t = normalize(text, "NFC") if normalize_ else _col(text)
    if controls:
        t = F.regexp_replace(t, r"[\x00-\x08\x0E-\x1F\x7F-\x{9F}]", "")
    if spaces:
        t = F.regexp_replace(t, _SPACES, " ")
    if collapse:
        t = F.regexp_replace(t, _SPACES + "+", " ")
    if numeric:
        digits = "".join(chr(c) for lo, hi in ranges("Nd") for c in range(lo, hi + 1) if c > 127)
        t = F.translate(t, digits, "".join(str(unicodedata.digit(c, 0)) for c in digits))
    if limit_combining:
        t = F.regexp_replace(t, r"(\p{M}{4})\p{M}+", "$1")
    return t


_LINKER = "्্્୍్്"


def segments_iter(t: str, kind: str) -> Iterator[str]:
    """The text's grapheme clusters, words or sentences, found as they are asked for where that is possible."""
    if kind == "grapheme" and (t.isascii() or not any(c in t for c in _LINKER)):
        return (m.group() for m in regex.finditer(r"\X", t))
    if kind == "word":
        cuts = itertools.chain((0,), (m.start() for m in _WORD_START.finditer(t) if 0 < m.start() < len(t)), (len(t),))
        return (t[a:b] for a, b in itertools.pairwise(cuts) if a < b)
    return iter(segments_str(t, kind))


def segments_str(t: str, kind: str) -> list[str]:
    """The text's grapheme clusters, words or sentences; joined they are the text."""
    if kind == "grapheme":
        return regex.findall(r"\X", t) if t.isascii() or not any(c in t for c in _LINKER) else _linked(regex.findall(r"\X", t))
    return list(segments_iter(t, kind)) if kind == "word" else sentences_str(t)


def _linked(clusters: list[str]) -> list[str]:
    """GB9c of Unicode 18: a linker, with extenders after it, keeps the consonant that follows."""
    out: list[str] = []
    for c in clusters:
        if out and any(x in _LINKER for x in out[-1]) and regex.match(r"\p{InCB=Consonant}", c) and regex.search(rf"[{_LINKER}][\p{{InCB=Extend}}{_LINKER}]*$", out[-1]):
            out[-1] += c
        else:
            out.append(c)
    return out


_SENTENCE_CLASS = regex.compile("|".join(f"(?P<{n}>\\p{{SB={n}}})" for n in ("CR", "LF", "Sep", "Format", "Extend", "Sp", "Lower", "Upper", "OLetter", "Numeric", "ATerm", "STerm", "Close", "SContinue")))


def sentences_str(t: str) -> list[str]:
    """Sentences by the rules SB1 to SB998 of UAX #29."""
    kinds = [(m.lastgroup if (m := _SENTENCE_CLASS.match(c)) else "Other") for c in t]
    solid = [(i, k) for i, k in enumerate(kinds) if k not in ("Extend", "Format") or i and kinds[i - 1] in ("CR", "LF", "Sep")]
    cuts, n = [], len(solid)
    # State since the last terminator: None, or (kind, phase) with phase 0 after it, 1 in closes, 2 in spaces.
    state, before = None, None
    for j in range(n):
        i, k = solid[j]
        if j:
            prev = solid[j - 1][1]
            if prev == "CR" and k == "LF":
                pass
            elif prev in ("CR", "LF", "Sep"):
                cuts.append(i)
                state = None
            elif state:
                kind, phase = state
                keep = False
                if kind == "ATerm" and phase == 0 and k == "Numeric" or kind == "ATerm" and phase == 0 and before in ("Upper", "Lower") and k == "Upper":
                    keep = True
                elif kind == "ATerm":
                    m = j
                    while m < n and solid[m][1] not in ("OLetter", "Upper", "Lower", "Sep", "CR", "LF", "STerm", "ATerm"):
                        m += 1
                    keep = m < n and solid[m][1] == "Lower"
                if not keep and k in ("SContinue", "STerm", "ATerm"):
                    keep = True
                if not keep and phase < 2 and k in ("Close", "Sp", "Sep", "CR", "LF") or not keep and k in ("Sp", "Sep", "CR", "LF"):
                    keep = True
                if not keep:
                    cuts.append(i)
                    state = None
        if k in ("ATerm", "STerm"):
            before = solid[j - 1][1] if j else None
            state = (k, 0)
        elif state and k == "Close" and state[1] < 2:
            state = (state[0], 1)
        elif state and k == "Sp":
            state = (state[0], 2)
        elif state and k not in ("Sep", "CR", "LF"):
            state = None
    marks = [0, *cuts, len(t)] if t else []
    return [t[a:b] for a, b in zip(marks, marks[1:], strict=False)]


def segments(text, kind: str) -> Column:
    """array<string> of grapheme clusters, words or sentences."""
    return _mapped(lambda t: segments_str(t, kind), pa.list_(pa.string()), "array<string>")(_col(text))


def grapheme_count(text) -> Column:
    """Clusters of the text; counted by code points where each is a cluster (no carriage return, nothing past U+02FF)."""
    t = _col(text)
    return _mapped(lambda s: len(s) if "\r" not in s and (s.isascii() or max(s) < "̀" and "\xad" not in s) else len(segments_str(s, "grapheme")), pa.int64(), "bigint")(t)


def word_count_str(t: str) -> int:
    return sum(1 for w in segments_str(t, "word") if regex.search(r"[\p{Alphabetic}\p{WB=Numeric}]", w))


#: Characters on which latin_word_count agrees with word_count: Latin letters, digits, common punctuation.
_LATIN = r"[\x00-\x7F\x{A0}-\x{AC}\x{AE}-\x{24F}\x{2013}\x{2014}\x{2019}\x{201C}\x{201D}\x{2026}\x{20AC}]"


def word_count(text) -> Column:
    """Word segments of UAX #29 that hold a letter or digit. Texts of Latin letters are counted within the JVM."""
    t = _col(text)
    other = ~t.rlike(f"^{_LATIN}*\\z")
    counted = _mapped(word_count_str, pa.int64(), "bigint")(F.when(other, t))
    return F.when(other, counted).otherwise(latin_word_count(t))


def latin_word_count(text) -> Column:
    """word_count for texts of Latin letters, digits and common punctuation, within the JVM; null stays null."""
    t = _col(text)
    # Runs with a letter or digit, less the marks that join two of them; no group repeats, so long words need no stack.
    runs = F.regexp_count(t, F.lit(r"_*+[\p{L}\p{Nd}][\p{L}\p{Nd}_]*+"))
    joints = F.regexp_count(t, F.lit(r"(?<=\p{L})[.:'’·](?=\p{L})|(?<=\p{Nd})[.,;'’](?=\p{Nd})"))
    return (runs - joints).cast("long")


def sentence_count(text) -> Column:
    return _mapped(lambda t: len(sentences_str(t)), pa.int64(), "bigint")(_col(text))


def truncate(text, kind: str, n: int) -> Column:
    """struct<text, bytes>: the first n clusters or word segments."""
    kinds = pa.struct([("text", pa.string()), ("bytes", pa.int64())])
    cut = lambda t: {"text": (s := "".join(itertools.islice(segments_iter(t, kind), n))), "bytes": len(s.encode())}
    return _mapped(cut, kinds, "struct<text:string,bytes:bigint>")(_col(text))


def cluster_width(c: str, ambiguous: int) -> int | None:
    """Columns of one cluster; None if it holds a control or line separator."""
    if any(unicodedata.category(x) in ("Cc", "Zl", "Zp") for x in c):
        return None
    if len(c) > 1 and regex.search(r"\p{Extended_Pictographic}|\p{Regional_Indicator}|️", c):
        return 2
    return sum(0 if unicodedata.category(x) in ("Mn", "Me", "Cf") else 2 if (w := unicodedata.east_asian_width(x)) in "FW" else ambiguous if w == "A" else 1 for x in c)


def width_str(t: str, ambiguous: int = 1) -> int | None:
    if t.isascii() and t.isprintable():
        return len(t)
    total = 0
    for c in segments_str(unicodedata.normalize("NFC", t), "grapheme"):
        if (w := cluster_width(c, ambiguous)) is None:
            return None
        total += w
    return total


def terminal_width(text, east_asian: bool = False) -> Column:
    """Terminal columns, null if the text has a control or line separator. Ambiguous width is 2 if east_asian, else 1.

    Texts of Latin letters, each a cluster of its own, are measured within the JVM.
    """
    t = _col(text)
    plain = t.rlike(r"^[\x20-\x7E\x{A0}-\x{AC}\x{AE}-\x{24F}]*\z")
    narrow = F.char_length(t).cast("long")
    if east_asian:
        wide = "".join(chr(c) for c in range(0xA0, 0x250) if c != 0xAD and unicodedata.east_asian_width(chr(c)) == "A")
        narrow = narrow + F.char_length(t) - F.char_length(F.translate(t, wide, ""))
    measured = _mapped(lambda s: width_str(s, 2 if east_asian else 1), pa.int64(), "bigint")(F.when(~plain, t))
    return F.when(plain, narrow).otherwise(measured)


def truncate_width(text, kind: str, columns: int, east_asian: bool = False) -> Column:
    """The longest prefix of whole clusters or word segments of at most `columns`, up to the first unmeasurable one."""

    def cut(t: str) -> str:
        out, used = [], 0
        for s in segments_iter(t, kind):
            w = width_str(s, 2 if east_asian else 1)
            if w is None or used + w > columns:
                break
            out.append(s)
            used += w
        return "".join(out)

    return _mapped(cut, pa.string(), "string")(_col(text))


def _prefix(t: str, max_bytes: int, clusters: bool) -> str:
    room = max(0, max_bytes - 1)
    if not clusters:
        return t.encode()[:room].decode("utf-8", "ignore")
    out, used = [], 0
    for s in segments_iter(t, "grapheme"):
        used += len(s.encode())
        if used > room:
            break
        out.append(s)
    return "".join(out)


def format_prefix(text, max_bytes: int, clusters: bool = False) -> Column:
    """The longest prefix within max_bytes - 1 bytes of UTF-8 that ends at a code point or cluster boundary."""
    return _mapped(lambda t: _prefix(t, max_bytes, clusters), pa.string(), "string")(_col(text))


def format_text(fmt: str, *cols, max_bytes: int, clusters: bool = False) -> Column:
    """struct<output, required>: cols printed by a printf format, cut as by format_prefix, and the bytes of the whole."""
    whole = F.format_string(fmt, *map(_col, cols))
    fits = F.octet_length(whole) < max_bytes
    cut = F.when(fits, whole).otherwise(format_prefix(F.when(~fits, whole), max_bytes, clusters))
    return F.struct(cut.alias("output"), F.octet_length(whole).cast("long").alias("required"))


def into(output, max_bytes) -> Column:
    """struct<output, size, status> of a text or binary column put into a buffer of max_bytes; None measures only.

    status is OK, or OUTPUT_TOO_SMALL with a null output; a null input gives a null. size is what the whole takes.
    """
    o = _col(output)
    size = F.octet_length(o).cast("long")
    fits = F.lit(True) if max_bytes is None else size <= (max_bytes if isinstance(max_bytes, Column) else F.lit(max_bytes))
    kept = F.when(F.lit(max_bytes is not None) & fits, o)
    return F.when(o.isNotNull(), F.struct(kept.alias("output"), size.alias("size"), F.when(fits, "OK").otherwise("OUTPUT_TOO_SMALL").alias("status")))


def normalize_into(text, form: str, max_bytes) -> Column:
    return into(normalize(text, form), max_bytes)


def nfkc_casefold_into(text, max_bytes) -> Column:
    return into(nfkc_casefold(text), max_bytes)


def map_case_into(text, op: str, max_bytes, locale: str | None = None) -> Column:
    return into(map_case(text, op, locale), max_bytes)


def filter_into(text, max_bytes, **flags: bool) -> Column:
    return into(filter_text(text, **flags), max_bytes)


# Bytes


def is_ascii(data) -> Column:
    """Every byte below 0x80; false for empty and null."""
    b = _col(data).cast("binary")
    return F.coalesce((F.octet_length(b) > 0) & ~F.hex(b).rlike("^(?:..)*[89A-F]"), F.lit(False))


def is_utf8(data) -> Column:
    """Well-formed UTF-8; false for empty and null."""
    b = _col(data).cast("binary")
    return F.coalesce((F.octet_length(b) > 0) & F.is_valid_utf8(b.cast("string")), F.lit(False))


def is_utf16(data) -> Column:
    """An even number of bytes that decode in either byte order without a lone surrogate; false for empty and null."""
    h = F.hex(_col(data).cast("binary"))
    unit = "(?:(?!D[89A-F])....|D[89AB]..D[C-F]..)*+"  # possessive: others take stack for each unit
    swapped = "(?:(?!..D[89A-F])....|..D[89AB]..D[C-F])*+"
    return F.coalesce((F.length(h) > 0) & (F.length(h) % 4 == 0) & (h.rlike(f"^{unit}$") | h.rlike(f"^{swapped}$")), F.lit(False))


#: Encodings as bits; 0 is unknown.
ENCODINGS = {"ASCII": 1, "UTF_8": 2, "UTF_16": 4, "UTF_16BE": 8, "UTF_16LE": 16, "UTF_32": 32, "UTF_32BE": 64, "UTF_32LE": 128}


def detect_encoding(data) -> Column:
    """Bits of ENCODINGS: by byte order mark, else UTF-8 (and ASCII), else 0."""
    e, b = ENCODINGS, _col(data).cast("binary")
    h = F.hex(F.substring(b, 1, 4))
    out = F.when(h.startswith("EFBBBF"), e["UTF_8"]).when(h == "FFFE0000", e["UTF_32"] | e["UTF_32LE"] | e["UTF_16"] | e["UTF_16LE"]).when(h == "0000FEFF", e["UTF_32"] | e["UTF_32BE"])
    out = out.when(h.startswith("FFFE"), e["UTF_16"] | e["UTF_16LE"]).when(h.startswith("FEFF"), e["UTF_16"] | e["UTF_16BE"])
    return out.when(is_ascii(b), e["UTF_8"] | e["ASCII"]).when(is_utf8(b), e["UTF_8"]).otherwise(0)


_CODECS = {"ASCII": "utf-8", "UTF-8": "utf-8", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "UTF-32LE": "utf-32-le", "UTF-32BE": "utf-32-be"}
_MARKS = {"UTF-16": ((b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")), "UTF-32": ((b"\xff\xfe\0\0", "UTF-32LE"), (b"\0\0\xfe\xff", "UTF-32BE"))}


def _ordered(data: bytes, encoding: str) -> tuple[bytes, str] | None:
    """Data of UTF-16 or UTF-32 without its byte order mark, and the encoding that tells; None without a mark."""
    if encoding not in _MARKS:
        return data, encoding
    return next(((data[len(mark) :], which) for mark, which in _MARKS[encoding] if data.startswith(mark)), None)


def decode_bytes(data: bytes, encoding: str) -> str:
    """One U+FFFD for each run of ill-formed bytes."""
    text = data.decode(_CODECS[encoding], "surrogateescape" if encoding in ("ASCII", "UTF-8") else "replace")
    return regex.sub(r"[\uDC80-\uDCFF]+", "�", text)


def convert_str(b: bytes, src: str, dst: str) -> dict:
    if src == dst or not b:
        return {"output": b, "transformed": False, "status": "OK"}
    known = _ordered(b, src)
    if known is None or dst not in _CODECS:
        return {"output": None, "transformed": False, "status": "INVALID_ENCODING"}
    t = decode_bytes(*known)
    if dst == "ASCII" and not t.isascii():
        return {"output": None, "transformed": False, "status": "UNSUPPORTED"}
    return {"output": t.encode(_CODECS[dst], "replace"), "transformed": True, "status": "OK"}


def convert_encoding_result(data, source: str, target: str) -> Column:
    """struct<output, transformed, status>: bytes re-encoded.

    The same encoding, and empty bytes, are passed on unchecked. UTF-16 and UTF-32 as a source need a byte order mark,
    which is not text; as a target they are invalid. A target that cannot hold the text is UNSUPPORTED.
    """
    src, dst = source.upper(), target.upper()
    kind = pa.struct([("output", pa.binary()), ("transformed", pa.bool_()), ("status", pa.string())])
    build = lambda part: pa.array([None if b is None else convert_str(b, src, dst) for b in part], kind)
    return _streamed(build, "struct<output:binary,transformed:boolean,status:string>")(_col(data).cast("binary"))


def convert_encoding(data, source: str, target: str) -> Column:
    """Bytes re-encoded, null where convert_encoding_result() says why not."""
    src, dst = source.upper(), target.upper()
    build = lambda part: pa.array([None if b is None else convert_str(b, src, dst)["output"] for b in part], pa.binary())
    return _streamed(build, "binary")(_col(data).cast("binary"))


def convert_encoding_into(data, source: str, target: str, max_bytes) -> Column:
    return into(convert_encoding(data, source, target), max_bytes)


def codepoint_count(data, encoding: str = "UTF-8") -> Column:
    """Code points of bytes, a run of ill-formed ones being one."""
    return _mapped(lambda b: len(decode_bytes(b, encoding.upper())), pa.int64(), "bigint")(_col(data).cast("binary"))
