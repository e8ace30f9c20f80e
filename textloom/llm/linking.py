"""From shared bands to components of verified links, without all pairs of a large bucket."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize
from .components import connected_components

#: Longs of the bits of a set of up to ROOM items; a larger set has a power of two times as many.
BITS, ROOM = 24, 1500
#: Hubs drawn from each bucket that is open after the first round.
HUBS = 2


def set_bits(items: np.ndarray) -> np.ndarray:
    """Bits of a set of uint64 hashes, 64 * BITS for every ROOM items or fewer: bit i is on if an item falls on i.

    A hash falls on its value modulo the number of bits, so the halves of a large set's bits, united, are those of half
    the length.
    """
    size = 64 * BITS << max(0, -(-len(items) // ROOM) - 1).bit_length()
    on = np.zeros(size, bool)
    on[((items >> np.uint64(20)) % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").view(np.int64)


def _folded(bits: F.Column, to: F.Column) -> F.Column:
    """The bits of a large set at the length `to`, at most a few halvings shorter."""
    places = F.sequence(F.lit(0), to - 1)
    times = F.sequence(F.lit(0), (F.size(bits) / to).cast("int") - 1)
    return F.when(F.size(bits) == to, bits).otherwise(F.transform(places, lambda i: F.aggregate(times, F.lit(0).cast("long"), lambda x, j: x.bitwiseOR(F.get(bits, (i + j * to).cast("int"))))))


def _only(x: str, y: str) -> F.Column:
    """Bits of x that are off in y, at the shorter one's length. Lambdas: a sum spelled out is too long a method to compile."""
    count = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda s, v: s + v)
    to = F.least(F.size(x), F.size(y))
    return F.when(F.size(x) == F.size(y), count(F.col(x), F.col(y))).otherwise(count(_folded(F.col(x), to), _folded(F.col(y), to)))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) with further links (a, b) between any nodes: only the graph of labels is searched."""
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    found = connected_components(between)
    to = found.select(F.col("node").alias("label"), F.col("label").alias("new"))
    counts = materialize(labels.groupBy("label").agg(F.count("*").alias("n")), "counts")
    moved = join_hot(labels, to, "label", counts, "left").select("node", F.coalesce("new", "label").alias("label"))
    return materialize(moved.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")


def link_members(pairs: DataFrame, sets: DataFrame, verified: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(node, label) for each sid linked with another one; label is the smallest sid of its component.

    sids are longs. pairs (a, b): those to compare first. sets (sid, bands, n, bits): the sets in large buckets, without
    their hubs, with the size and set_bits of each; pairs hold each of them with the hub. verified: of pairs (a, b) of
    sids, those with den * intersection >= num * union.

    After the first comparison, in buckets whose members still span several components, each is compared with a few
    drawn members. What is left after that are cross-component pairs of members that were neither: those between a
    bucket's largest component and the others and among the others, and of them only what a bound admits. An item whose
    bit is off in the other set is not shared, so of n items at most n less the bits that only this set has are. Bits
    grow with their set, so the bound does not fade for long ones. It is never below the true intersection, so no link
    within a bucket is lost: a pair with a hub or a drawn member is settled in the round of that member, a pair inside a
    component needs none.
    """
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "pairs")
    sets = materialize(sets, "sets")
    labels = materialize(connected_components(verified(pairs)), "labels")
    discard(pairs)

    def enough(common: F.Column) -> F.Column:
        """Whether this many common items could make a link: den * common >= num * (n + n2 - common)."""
        return common * (den + num) >= (F.col("n") + F.col("n2")) * num

    # Cheap conditions first; what either set has that is not shared must leave enough.
    # A pair that meets in several buckets is made in one of them.
    once = F.array_min(F.array_intersect("bands", "bands2")) == F.col("band")
    admitted = (F.col("label") != F.col("label2")) & enough(F.least("n", "n2")) & once & enough(F.col("n") - _only("bits", "bits2")) & enough(F.col("n2") - _only("bits2", "bits"))
    second = lambda df: df.select("band", *(F.col(c).alias(f"{c}2") for c in ("sid", "label", "bands", "n", "bits")))

    def open_buckets(sets: DataFrame) -> DataFrame:
        """(band, sid, label, major, bands, n, bits) of the buckets that still span several components; major is the largest."""
        placed = sets.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        each = placed.select("sid", "label", F.explode("bands").alias("band"))
        parts = each.groupBy("band", "label").agg(F.count("*").alias("c"))
        mixed = parts.groupBy("band").agg(F.count("*").alias("k"), F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("top")).where("k > 1")
        mixed = materialize(mixed.select("band", F.col("size").alias("n"), F.col("top.label").alias("major")), "mixed")
        if mixed.isEmpty():
            return mixed
        there = materialize(join_hot(each, mixed.select("band", "major"), "band", mixed.select("band", "n")), "there")
        own = there.groupBy("sid").agg(F.collect_set("band").alias("bands"))
        return materialize(there.join(own.join(placed.select("sid", "n", "bits"), "sid"), "sid"), "open")

    # A few drawn members of each open bucket are hubs of a second round: it links most of what can be linked.
    first = open_buckets(sets)
    if first.isEmpty():
        return labels
    draw = [F.xxhash64("sid", F.lit(i)) for i in range(HUBS)]
    counts = materialize(first.groupBy("band").agg(F.count("*").alias("n"), *(F.min(d).alias(f"d{i}") for i, d in enumerate(draw))), "counts")
    is_drawn = reduce(or_, (d == F.col(f"d{i}") for i, d in enumerate(draw)))
    drawn = materialize(join_hot(first, counts.drop("n"), "band", counts.select("band", "n")).where(is_drawn).select(*first.columns), "drawn")
    hubs = drawn.drop("bands").join(drawn.groupBy("sid").agg(F.collect_set("band").alias("bands")), "sid")
    pairs = first.join(second(hubs), "band").where(admitted)
    pairs = materialize(pairs.select(F.greatest("sid", "sid2").alias("a"), F.least("sid", "sid2").alias("b")).distinct(), "pairs")
    labels = _merged(labels, verified(pairs))

    # All that is left. Of two members of different components one at least is not of the largest.
    left = first.select("band", "sid").join(drawn.select("band", "sid"), ["band", "sid"], "left_anti")
    known = open_buckets(left.groupBy("sid").agg(F.collect_set("band").alias("bands")).join(sets.select("sid", "n", "bits"), "sid"))
    if not known.isEmpty():
        ordered = (F.col("label2") == F.col("major")) | (F.col("sid") < F.col("sid2"))
        cross = known.where("label <> major").join(second(known), "band").where(ordered & admitted)
        cross = materialize(cross.select(F.greatest("sid", "sid2").alias("a"), F.least("sid", "sid2").alias("b")).distinct(), "cross")
        labels = _merged(labels, verified(cross))
        discard(cross)
    discard(sets, first, drawn, pairs, known)
    return labels
