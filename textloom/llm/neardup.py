"""Near-duplicate documents: fast similarity sketches, banding, verification on full shingle sets, components.

1. One pass turns each text into its set of word-shingle hashes, the set's 128-bit name, and band keys of its fast
   similarity sketch. Texts with equal sets are one class; only classes are compared.
2. Band keys travel in packed blobs, of which only what two classes share comes back (see banding). A key of few
   classes gives their pairs; the members of one of many are compared with its hub, its most copied class, which is
   linear in the bucket. A pair inside one component needs no further look.
3. Buckets that still span several components give their cross-component pairs, bounded first by bits of each set, as
   many as its size asks for. The bound is never below the true intersection, so no link is lost, and it stops all
   pairs of a large group of loose copies from being emitted.
4. Pairs are verified on full sets; large-star/small-star joins the links.

Nothing is capped. With 32 bands of 4 bins a pair at similarity 0.85 is missed with probability 6e-11, at 0.8 with
5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .banding import PACKED_TYPE, bucket_bits, members_of, packer, pairs_of, shared_bands
from .common import HashCache, discard, join_hot, materialize, slices, small, trimmed
from .linking import link_members, set_bits
from .sketch import band_keys, sketch_sets, word_shingle_sets


def _signer(k: int, bins: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in small(batches):
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            for i, j in slices([len(t) for t in texts]):
                sets = word_shingle_sets(texts[i:j], k, cache)
                names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                keys = band_keys(sketch_sets(sets, bins), rows)
                bands = pa.ListArray.from_arrays(pa.array(range(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), bands], names=["id", "sid", "n", "bands"])

    return sign


def _setter(k: int):
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in small(batches):
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for i, j in slices([len(t) for t in texts]):
                sets = [s for s in word_shingle_sets(texts[i:j], k, cache) if len(s)]
                names, bits = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [set_bits(s) for s in sets]
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([s.view("int64") for s in sets], lists), pa.array(bits, lists)], names=["sid", "items", "bits"])

    return sets_of


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have den * intersection >= num * union."""
    a, b = sets.select(F.col("sid").alias("a"), F.col("items").alias("ia")), sets.select(F.col("sid").alias("b"), F.col("items").alias("ib"))
    joined = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("ia", "ib")).cast("long"))
    return joined.where(F.col("common") * den >= (F.size("ia") + F.size("ib") - F.col("common")) * num).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 85, den: int = 100, bins: int = 128, rows: int = 4) -> DataFrame:
    """(id, n_shingles long, component_id, kept boolean), a row for each row of docs.

    Documents with den * intersection >= num * union of their k-word shingle sets are linked; component_id is the
    smallest id reachable. Null and wordless texts have n_shingles 0 and are linked with nothing. Repeated rows each
    return a row. A null id never becomes a component_id while the component has another id, and such a row is kept
    only if it has no linked row with an id. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    signed = materialize(src.mapInArrow(trimmed(_signer(k, bins, rows)), f"id {kind}, sid binary, n bigint, bands array<bigint>"), "signed")
    # Of sets that share a band key, the one with the most copies comes first: the hub of its bucket.
    high = F.conv(F.hex(F.substring("sid", 1, 6)), 16, 10).cast("long")
    order = F.shiftleft(F.lit(16383) - F.least(F.col("copies"), F.lit(16383)), 48) + high
    classes = signed.where("sid is not null").groupBy("sid").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("sid", "rep", "copies", "bands", order.alias("order")), "classes")

    shared = materialize(shared_bands(classes.select("order", "bands").mapInArrow(trimmed(packer(bucket_bits(spark, bins // rows * classes.count()))), PACKED_TYPE)), "shared")
    pairs, members = materialize(pairs_of(shared), "pairs"), materialize(members_of(shared), "members")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("order")).unionByName(members.select("order")).distinct()
    wanted = materialize(classes.select("order", "sid", "rep").join(wanted, "order"), "wanted")
    reps = wanted.select(F.col("rep").alias("_rep")).distinct()
    texts = src.join(reps, src["id"].eqNullSafe(reps["_rep"]), "left_semi").select("text")
    sets = texts.mapInArrow(trimmed(_setter(k)), "sid binary, items array<bigint>, bits array<bigint>").dropDuplicates(["sid"]).join(wanted.select("sid", "order"), "sid")
    # Longs as nodes from here on: they aggregate by hash, names would by sorting.
    sets = materialize(sets.select(F.col("sid").alias("name"), "order", "items", "bits", F.monotonically_increasing_id().alias("sid")), "sets")
    names = materialize(sets.select("name", "order", "sid"), "names")
    node = lambda c: names.select(F.col("order").alias(c), F.col("sid").alias(f"n{c}"))
    found = pairs.join(node("a"), "a").join(node("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    large = members.join(sets.select("order", "sid", F.size("items").cast("long").alias("n"), "bits"), "order").select("sid", "bands", "n", "bits")
    linked = link_members(found, large, lambda pairs: _verified(pairs, sets, num, den), num, den)
    labels = materialize(linked.join(names, linked["node"] == names["sid"]).select("name", "label"), "labels")
    discard(shared, pairs, members, wanted, sets, names)

    # A component's id is the least of its classes' ids; classes without links are on their own.
    grouped = classes.select(F.col("sid").alias("name"), "rep").join(labels, "name")
    least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    tied = grouped.join(least, "label").select(F.col("name").alias("sid"), "component_id")
    named = classes.select("sid", "rep").join(tied, "sid", "left").select("sid", F.when(F.col("component_id").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    # A class of many copies is one key of many rows; wordless texts have none and would all be dealt to one task.
    some = join_hot(signed.where("sid is not null").select("id", "sid", "n"), named, "sid", classes.select("sid", F.col("copies").alias("n")))
    none = signed.where("sid is null").select("id", "n", F.col("id").alias("component_id"))
    out = some.select("id", "n", "component_id").unionByName(none)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
