"""Confusable skeletons (UTS #39) and emoji sequences; their tables come from ICU, read once on the driver."""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bidi import pairs, resolve_levels, visual_order
from .text import _col, _mapped, into


@functools.lru_cache(maxsize=1)
def prototypes() -> dict[str, str]:
    """Character -> what it looks like, for the characters that look like another."""
    icu = SparkSession.active()._jvm.com.ibm.icu.text.SpoofChecker
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co", "Cc") and unicodedata.normalize("NFD", c) == c]
    # One call maps all characters, a line each.
    shown = icu.Builder().build().getSkeleton("\n".join(chars)).split("\n")
    return {c: s for c, s in zip(chars, shown, strict=True) if s and s != c}


def skeleton_str(t: str, table: dict[str, str], mirrors: dict, brackets: dict) -> str:
    if not t.isascii():
        _, levels, classes = resolve_levels(t, "LTR", brackets)
        if any(levels):
            kept = [i for i, x in enumerate(levels) if x >= 0]
            starts = [p for p, i in enumerate(kept) if not p or classes[i] != "NSM"]  # marks stay after their base
            groups = [kept[a:b] for a, b in zip(starts, [*starts[1:], len(kept)], strict=True)]
            order = visual_order([levels[g[0]] for g in groups])
            t = "".join(mirrors.get(t[i], t[i]) if levels[i] % 2 else t[i] for g in order for i in groups[g])
    t = regex.sub(r"\p{Default_Ignorable_Code_Point}", "", unicodedata.normalize("NFD", t))
    return unicodedata.normalize("NFD", "".join(table.get(c, c) for c in t))


def confusable_skeleton(text) -> Column:
    """What a text looks like from left to right; equal for texts that can be confused."""
    table, (mirrors, brackets) = prototypes(), pairs()
    return _mapped(lambda t: skeleton_str(t, table, mirrors, brackets), pa.string(), "string")(_col(text))


def confusable_skeleton_into(text, max_bytes) -> Column:
    return into(confusable_skeleton(text), max_bytes)


def confusable_match(a, b) -> Column:
    """Whether two texts have the same skeleton; two empty skeletons do not match."""
    x, y = confusable_skeleton(a), confusable_skeleton(b)
    return (x == y) & (F.octet_length(x) > 0)


#: Kinds of emoji sequences and the Unicode properties that hold them.
EMOJI_KINDS = {"BASIC": "Basic_Emoji", "KEYCAP": "Emoji_Keycap_Sequence", "MODIFIER": "RGI_Emoji_Modifier_Sequence", "FLAG": "RGI_Emoji_Flag_Sequence", "TAG": "RGI_Emoji_Tag_Sequence", "ZWJ": "RGI_Emoji_ZWJ_Sequence"}
_VS16 = "️"


def _variants(s: str) -> dict[str, str]:
    """s and what it becomes without some of its presentation selectors, with the qualification of each."""
    out, parts = {}, s.split(_VS16)
    for mask in range(1 << (len(parts) - 1)):
        v = "".join(p + (_VS16 if mask >> i & 1 else "") for i, p in enumerate(parts[:-1])) + parts[-1]
        whole = mask == (1 << (len(parts) - 1)) - 1
        first = regex.match(r"\p{Emoji_Presentation}|.️|\p{Emoji_Modifier_Base}\p{Emoji_Modifier}", v, regex.DOTALL)
        out[v] = "FULLY_QUALIFIED" if whole else "MINIMALLY_QUALIFIED" if first else "UNQUALIFIED"
    return out


@functools.lru_cache(maxsize=1)
def emoji_table() -> dict[str, tuple[str, str, int]]:
    """Sequence -> (kind, qualification, code points)."""
    jvm, out = SparkSession.active()._jvm, {}
    for kind, prop in EMOJI_KINDS.items():
        for s in jvm.java.lang.String.join("\n", jvm.com.ibm.icu.text.UnicodeSet(f"[:{prop}:]")).split("\n"):
            for v, q in _variants(s).items():
                part = len(v) == 1 and regex.match(r"\p{Emoji_Modifier}|[\U0001F9B0-\U0001F9B3]", v)
                out.setdefault(v, (kind, "COMPONENT" if part else q, len(v)))
    return out


def emoji_sequences(spark: SparkSession) -> DataFrame:
    """(sequence, kind, qualification, count): a few thousand rows whatever the data; broadcast it into joins."""
    return spark.createDataFrame([(k, *v) for k, v in emoji_table().items()], "sequence string, kind string, qualification string, count int")


def emoji_sequence_info(text) -> Column:
    """struct<kind, qualification, count> of a text that is one emoji sequence as a whole, else null."""
    table = emoji_table()
    kind = pa.struct([("kind", pa.string()), ("qualification", pa.string()), ("count", pa.int32())])

    def info(t: str) -> dict | None:
        found = table.get(t)
        return found and dict(zip(("kind", "qualification", "count"), found, strict=True))

    return _mapped(info, kind, "struct<kind:string,qualification:string,count:int>")(_col(text))


def is_emoji_sequence(text) -> Column:
    return emoji_sequence_info(text).isNotNull()


def is_rgi_emoji(text) -> Column:
    """Emoji sequences recommended for interchange, fully qualified, and components."""
    return F.coalesce(emoji_sequence_info(text)["qualification"].isin("FULLY_QUALIFIED", "COMPONENT"), F.lit(False))
