"""Fuzzy line deduplication: character-shingle signatures, banding, exact Jaccard, distributed union-find.

One pass cuts texts into lines, names each by 128 bits and signs it, once for a line that repeats within a task; band
keys and names travel in packed blobs, of which only what two different lines share, and the names that occur again,
come back (see banding). A second pass fetches the lines that share a key. Candidates are verified on their full shingle
sets, and union-find joins the links; lines equal after normalisation are one node. A third pass places the lines of
components and those that occur again, and one line of each stays: the first by document id, then by place. No line is
left out: one of fewer than k characters is a shingle of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .banding import PACKED_TYPE, bucket_bits, members_of, pack, pairs_of, repeated_of, shared_bands, size_in_bytes
from .common import bitmap, discard, distinct, in_bitmap, join_hot, materialize, mix, slices, small, trimmed
from .linking import link_members, set_bits
from .sketch import band_keys, fast_similarity_sketch

_BASE = 0x9E3779B97F4A7C15
#: Characters that are hashed at once.
_PART = 1 << 18

_ODD = (b"  ", b"\t", b"\r", b"\x0b", b"\x0c")


def _normal_lines(text: bytes) -> list[bytes]:
    """Lines with A-Z lower-cased, white space collapsed and trimmed."""
    lines = text.lower().split(b"\n")
    return [b" ".join(x.split()) for x in lines] if any(o in text for o in _ODD) else [x.strip(b" ") for x in lines]


def _polynomial(cps: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive values, of their own type, by doubling: log2(k) steps."""
    n = len(cps) - k + 1
    kind = cps.dtype.type
    if n <= 0:
        return np.zeros(0, kind)
    out, have, block, width = None, 0, cps * kind(0x85EBCA6B) ^ (cps >> kind(3)), 1  # block: hashes of `width` consecutive values
    power = lambda m: kind(pow(_BASE, m, 1 << 8 * cps.itemsize))
    while True:
        if k & width:
            part = block[have : have + n]
            out = part.copy() if out is None else out * power(width) + part
            have += width
        if have == k:
            return out
        block = block[:-width] * power(width) + block[width:]
        width *= 2


def _codes(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def _shingles(lines: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the k-character shingles of lines, and the line of each; a shorter line is one shingle."""
    cps = _codes(b"\n".join(lines))
    cuts = np.flatnonzero(cps == 10)
    starts = np.concatenate(([0], cuts + 1)).astype(np.int64)
    lengths = np.concatenate((cuts, [len(cps)])) - starts
    h = np.concatenate([_polynomial(cps[i : i + _PART + k - 1], k) for i in range(0, max(1, len(cps) - k + 1), _PART)])
    counts = np.maximum(lengths - k + 1, 0)
    owner = np.repeat(np.arange(len(lines), dtype=np.int64), counts)
    inside = np.ones(len(h), bool)
    for j in range(k):  # a shingle that holds a line feed is no line's
        at = cuts - j
        inside[at[(at >= 0) & (at < len(h))]] = False
    out = h[inside]
    short = np.flatnonzero(counts == 0)
    if len(short):
        own = np.array([xxhash.xxh32_intdigest(lines[i], seed=k) for i in short], np.uint32)
        out, owner = np.concatenate((out, own)), np.concatenate((owner, short))
    return out, owner


#: Bytes of lines that are worked on at once: their arrays then fit into a processor's cache.
SLICE = 200_000
#: Names that a signer remembers, so that it signs a repeated line once.
SEEN = 500_000


def _lines(texts: list[bytes | None], limit: int = SLICE):
    """(row, line number, normalised line) of the lines that are not blank, by slices of the batch."""
    texts = [t or b"" for t in texts]
    for i, j in slices([len(t) for t in texts], limit):
        rows, nos, lines = [], [], []
        for r in range(i, j):
            own = _normal_lines(texts[r])
            if all(own):
                rows += [r] * len(own)
                nos += range(len(own))
                lines += own
            else:
                for no, s in enumerate(own):
                    if s:
                        rows.append(r)
                        nos.append(no)
                        lines.append(s)
        if lines:
            yield rows, nos, lines


def _names(lines: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """128-bit names, and their first halves as signed longs."""
    names = [xxhash.xxh3_128_digest(x) for x in lines]
    return names, np.frombuffer(b"".join(names), ">i8")[::2].astype(np.int64)


def _namer(words: np.ndarray | None):
    """(id, th, text) -> (id, th, no, sid) of the lines whose name's bit is set, of all with words None."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for rows, nos, lines in _lines(batch.column(2).cast(pa.binary()).to_pylist(), 1_000_000):
                names, prio = _names(lines)
                if words is not None:
                    own = np.flatnonzero(in_bitmap(words, prio.view(np.uint64))).tolist()
                    rows, nos, names = ([x[i] for i in own] for x in (rows, nos, names))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(nos, pa.int32()), pa.array(names, pa.binary())], names=["id", "th", "no", "sid"])

    return name


def _signer(k: int, bands: int, rows: int, bits: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        seen: set[int] = set()
        for batch in small(batches):
            for _, _, lines in _lines(batch.column(0).cast(pa.binary()).to_pylist()):
                _, prio = _names(lines)
                fresh = [i for i, p in enumerate(prio.tolist()) if not (p in seen or seen.add(p))]
                keys = np.zeros((0, bands), np.int64)
                if fresh:
                    some = [lines[i] for i in fresh]
                    keys = band_keys(fast_similarity_sketch(*_shingles(some, k), len(some), bands * rows), rows)
                yield prio[fresh], keys, prio
                if len(seen) > SEEN:
                    seen.clear()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(signed(batches), bits)

    return sign


def _fetcher(words: np.ndarray | None):
    """Texts, and with words None the numbers of lines -> (sid, prio, line) of lines: those whose name's bit is set, or those numbers'."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in small(batches):
            wanted = None if words is not None else [set(x) for x in batch.column(1).to_pylist()]
            for rows, nos, lines in _lines(batch.column(0).cast(pa.binary()).to_pylist(), 1_000_000):
                if wanted is not None:
                    lines = [s for r, no, s in zip(rows, nos, lines, strict=True) if no in wanted[r]]
                names, prio = _names(lines)
                at = range(len(lines)) if wanted is not None else np.flatnonzero(in_bitmap(words, prio.view(np.uint64))).tolist()
                if own := [i for i in at if not (names[i] in seen or seen.add(names[i]))]:
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in own], pa.binary()), pa.array(prio[own]), pa.array([lines[i] for i in own], pa.binary())], names=["sid", "prio", "line"])
            if len(seen) > SEEN:
                seen.clear()

    return fetch


def _line_sets(lines: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the k-character shingles of lines, sorted and distinct line by line, and how many each has."""
    cps = _codes(b"\n".join(lines))
    cuts = np.flatnonzero(cps == 10)
    starts = np.concatenate(([0], cuts + 1))
    counts = np.concatenate((cuts, [len(cps)])) - starts - (k - 1)
    h = np.concatenate([_polynomial(cps[i : i + _PART + k - 1].astype(np.uint64), k) >> np.uint64(16) for i in range(0, max(1, len(cps) - k + 1), _PART)])
    sets, n = [], np.zeros(len(lines), np.int64)
    short = counts <= 0
    # A line's number above the hash: one sort for all lines of a part of 65,536.
    for i in range(0, len(lines), 1 << 16):
        who = np.flatnonzero(~short[i : i + (1 << 16)]) + i
        own = np.repeat(who - i, counts[who]).astype(np.uint64)
        at = np.repeat(starts[who] - np.cumsum(counts[who]) + counts[who], counts[who]) + np.arange(len(own))
        lone = np.flatnonzero(short[i : i + (1 << 16)])
        small_ = np.array([xxhash.xxh3_64_intdigest(lines[i + j], seed=k) >> 16 for j in lone], np.uint64)
        both = distinct(np.concatenate(((own << np.uint64(48)) | h[at], (lone.astype(np.uint64) << np.uint64(48)) | small_)))
        n[i : i + (1 << 16)] = np.bincount((both >> np.uint64(48)).astype(np.int64), minlength=min(1 << 16, len(lines) - i))
        sets.append(both & np.uint64((1 << 48) - 1))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), n


def _measurer(k: int):
    """(sid, line, bands) -> (sid, bands, n, bits) with the size and bits of the line's shingle set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lines = batch.column(1).to_pylist()
            for i, j in slices([len(x) for x in lines], SLICE):
                items, n = _line_sets(lines[i:j], k)
                bits = [set_bits(mix(x)) for x in np.split(items, np.cumsum(n)[:-1])]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(bits, pa.list_(pa.int64()))], names=["sid", "bands", "n", "bits"])

    return measure


def _common(left: list[bytes], right: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of lines, fewer than 65,536: the sizes of both sets and of what they share."""
    lines = {x: i for i, x in enumerate(dict.fromkeys((*left, *right)))}
    items, n = _line_sets(list(lines), k)
    start = np.cumsum(n) - n
    a, b = (np.array([lines[x] for x in side]) for side in (left, right))

    def tagged(who: np.ndarray) -> np.ndarray:
        """The pair's number above the hash, for each item of one line of each pair."""
        c = n[who]
        at = np.repeat(start[who] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
        return (np.repeat(np.arange(len(who), dtype=np.uint64), c) << np.uint64(48)) | items[at]

    both = np.sort(np.concatenate((tagged(a), tagged(b))))
    twice = both[1:][both[1:] == both[:-1]] >> np.uint64(48)
    return n[a], n[b], np.bincount(twice.astype(np.int64), minlength=len(a))


def _checker(k: int, num: int, den: int):
    """(a, b, line of a, line of b) -> the pairs whose Jaccard similarity is enough; shingles are compared by 48-bit hashes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 8192) for i in range(0, batch.num_rows, 8192)):
                left, right = (part.column(i).to_pylist() for i in (2, 3))
                keep = np.zeros(len(left), bool)
                for i, j in slices([len(x) + len(y) for x, y in zip(left, right, strict=True)], SLICE // 4):
                    n, m, common = _common(left[i:j], right[i:j], k)
                    keep[i:j] = den * common >= num * (n + m - common)
                yield part.select([0, 1]).filter(pa.array(keep))

    return check


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that share the name in the first column, all of them in one partition, the first that comes."""
    seen: set[bytes] = set()
    for batch in batches:
        yield batch.filter(pa.array([not (x in seen or seen.add(x)) for x in batch.column(0).to_pylist()], pa.bool_()))


def _bits(prios: DataFrame, most: int) -> np.ndarray | None:
    """A bitmap of a table of distinct prios with 32 times as many bits or more; None if it has more than `most` rows."""
    n = prios.count()
    return bitmap(prios, "prio", max(16, (32 * n).bit_length())) if n <= most else None


def _fetched(src: DataFrame, kind_of_id: str, wanted: DataFrame, bitmap_most: int) -> DataFrame:
    """(sid, prio, line) of the lines whose prio is wanted, once each.

    Of up to bitmap_most wanted lines, every worker gets a bitmap of 32 times as many bits or more and looks through all
    texts; more are looked up where they stand. What comes is hashed against the wanted ones, not sorted: lines are long.
    """
    kind, bits = "sid binary, prio bigint, line binary", _bits(wanted, bitmap_most)
    if bits is not None:
        found = src.select("text").mapInArrow(trimmed(_fetcher(bits)), kind)
    else:
        prio = F.conv(F.hex(F.substring("sid", 1, 8)), 16, -10).cast("long")
        lines = src.mapInArrow(trimmed(_namer(None)), f"id {kind_of_id}, th bigint, no int, sid binary").withColumn("prio", prio)
        places = lines.join(wanted, "prio").dropDuplicates(["sid"]).groupBy(F.col("id").alias("_i"), F.col("th").alias("_t")).agg(F.collect_set("no").alias("nos"))
        there = src.join(places, src["id"].eqNullSafe(places["_i"]) & src["th"].eqNullSafe(places["_t"])).select("text", "nos")
        found = there.mapInArrow(trimmed(_fetcher(None)), kind)
    # Equal names have equal prio, so they meet in the partition that the join deals them to.
    dealt = found.repartition(int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")), "prio")
    return dealt.join(wanted.hint("shuffle_hash"), "prio", "left_semi").select("sid", "prio", "line").mapInArrow(trimmed(_first_of_each), kind)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 7, num: int = 80, den: int = 100, bands: int = 24, rows: int = 4, bitmap_most: int = 1 << 19, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text_col rewritten, and n_lines and n_dropped (long, named by counts) added, a row for each row.

    Lines are parts between line feeds, compared after lower-casing A-Z and collapsing ASCII white space, by the
    Jaccard similarity of their k-character shingles (linked if den * intersection >= num * union); a line of fewer
    characters is one shingle, and equals only itself. Of each component the line of the smallest id (null last), then
    of the first place, stays; the others are cut out with their line feed. Blank lines always stay. Rows equal in id
    and text are one document: each gets the same text. Null texts stay null, with 0 lines; a text whose lines all go
    is empty. Bytes that are not UTF-8 are compared as U+FFFD, and become that in a text that loses lines. Other columns
    pass through; columns named as counts are replaced. An empty table gives no rows. A pair at similarity 0.8 is missed
    with probability 3e-6, at 0.9 with 1e-11 (24 bands of 4 bins).
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.drop(*counts)
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    # About 24 keys for a line of 300 characters, and twice as many characters as bytes of a file.
    signed = src.select("text").mapInArrow(trimmed(_signer(k, bands, rows, bucket_bits(spark, bands * size_in_bytes(src) // 150))), PACKED_TYPE)
    shared = materialize(shared_bands(signed), "shared")
    pairs_ = pairs = materialize(pairs_of(shared), "pairs")
    members = materialize(members_of(shared), "members")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("prio")).unionByName(members.select(F.col("order").alias("prio"))).distinct()
    wanted = materialize(wanted, "wanted")
    fetched = _fetched(src, kind, wanted, bitmap_most)
    # Longs as nodes from here on: they aggregate by hash, names would by sorting.
    nodes = materialize(fetched.select("sid", "prio", "line").select(F.col("sid").alias("name"), "prio", "line", F.monotonically_increasing_id().alias("sid")), "nodes")
    node = lambda c: nodes.select(F.col("prio").alias(c), F.col("sid").alias(f"n{c}"))
    pairs = pairs.join(node("a"), "a").join(node("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    sets = nodes.join(members.withColumnRenamed("order", "prio"), "prio").select("sid", "line", "bands")
    sets = sets.mapInArrow(trimmed(_measurer(k)), "sid bigint, bands array<bigint>, n bigint, bits array<bigint>")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = nodes.select(F.col("sid").alias("a"), F.col("line").alias("x")), nodes.select(F.col("sid").alias("b"), F.col("line").alias("y"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(trimmed(_checker(k, num, den)), "a bigint, b bigint")

    labels = link_members(pairs, sets, verified, num, den)
    # A component goes by the name of its least node.
    name = lambda c, to: nodes.select(F.col("sid").alias(c), F.col("name").alias(to))
    named = materialize(labels.join(name("node", "sid"), "node").join(name("label", "group"), "label").select("sid", "group"), "named")

    # Only lines of a component or with equal ones matter from here on.
    prio = F.conv(F.hex(F.substring("sid", 1, 8)), 16, -10).cast("long")
    matter = materialize(named.select(prio.alias("prio")).unionByName(repeated_of(shared).withColumnRenamed("order", "prio")).distinct(), "matter")
    lines = src.mapInArrow(trimmed(_namer(_bits(matter, 2 * bitmap_most))), f"id {kind}, th bigint, no int, sid binary")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th", "no")
    some = materialize(lines.join(named, "sid", "left").select("id", "th", "no", F.coalesce("group", "sid").alias("label")), "some")
    discard(shared, pairs_, members, wanted, nodes, named, matter)
    firsts = materialize(some.groupBy("label").agg(F.min(place).alias("stays"), F.count("*").alias("n")), "firsts")
    gone = join_hot(some, firsts.drop("n"), "label", firsts.select("label", "n")).where(~place.eqNullSafe(F.col("stays"))).select("id", "th", "no")
    gone = materialize(gone.groupBy("id", "th").agg(F.collect_set("no").alias("gone")), "gone")
    discard(some, firsts)

    key = [F.col(id_col).alias("_linededup_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_linededup_th")]
    marked = docs.select("*", *key)
    g = gone.select(F.col("id").alias("_linededup_gid"), F.col("th").alias("_linededup_gth"), F.col("gone").alias("_linededup_gone"))
    # Each document has one row in g at most, so its side is small in every partition: hashed, the texts stay unsorted.
    joined = marked.join(g.hint("shuffle_hash"), marked["_linededup_id"].eqNullSafe(g["_linededup_gid"]) & (marked["_linededup_th"] == g["_linededup_gth"]), "left").drop("_linededup_gid", "_linededup_gth", "_linededup_id", "_linededup_th")
    text, no = F.col(text_col).cast("string"), F.coalesce(F.col("_linededup_gone"), F.array().cast("array<int>"))
    parts = F.split(text, "\n", -1)
    lines_left = F.array_join(F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains(no, i), x)), lambda x: x.isNotNull()), "\n")
    out = joined.withColumns({text_col: F.when(F.size(no) == 0, text).otherwise(lines_left), counts[0]: F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"), counts[1]: F.size(no).cast("long")})
    return out.drop("_linededup_gone")
