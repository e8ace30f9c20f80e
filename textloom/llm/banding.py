"""Which sets share a band key, found without a row for every key.

Of all band keys few are shared. So keys travel to their bucket (a range of keys) in packed blobs of numpy arrays, and
only what two different sets share leaves as rows. A key of few sets gives its pairs at once, a linear number; a key
of many sets gives its members, for link_members() to compare through hubs.

No key is gathered in one place: a key that more than HOT sets of one blob's making share is sent as members, dealt
evenly, and the same happens to any key that outgrows a bucket's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, join_hot, materialize, mix, trimmed

#: Entries (key and order of a set) that a packer holds before it sends them, and a bucket before it thins them out.
PACKED, HELD = 1 << 20, 1 << 22
#: Sets of one packing that share a key beyond which the key is dealt out as members.
HOT = 64
#: A key of at most this many sets gives all their pairs.
FEW = 8
#: Entries of one bucket, about, and members in a blob.
BUCKET, SPREAD = 1 << 18, 1 << 12
#: Kinds of blobs; a bucket's hot keys come first.
_HOT_KEYS, _ENTRIES, _MEMBERS, _SEEN = 0, 1, 2, 3

PACKED_TYPE = "bucket int, kind int, blob binary"


def bucket_bits(spark: SparkSession, entries: int) -> int:
    """log2 of the number of buckets for about so many entries: from 16 to 1,024 to a shuffle partition, of BUCKET entries."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(30, min(max(16 * parts, entries // BUCKET), 1024 * parts).bit_length())


def size_in_bytes(df: DataFrame) -> int:
    """Spark's own estimate; for tables read from files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal values."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def _blob(keys: np.ndarray, orders: np.ndarray) -> bytes:
    return keys.tobytes() + orders.tobytes()


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, np.uint64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _packed(held: list[tuple[np.ndarray, np.ndarray]], seen: list[np.ndarray], bits: int) -> pa.RecordBatch:
    keys, orders = (np.concatenate([h[i] for h in held] or [np.zeros(0, np.uint64)]) for i in (0, 1))
    at = np.argsort(keys)
    keys, orders = keys[at], orders[at]
    first, n = _runs(keys)
    hot = n > HOT
    rows: list[tuple[int, int, bytes]] = []
    if hot.any():
        hot_keys = keys[first[hot]]
        for b, part in zip(*_split(hot_keys, bits), strict=True):
            rows.append((b, _HOT_KEYS, hot_keys[part].tobytes()))
        out = np.repeat(hot, n)
        k, o = keys[out], orders[out]
        for i in range(0, len(k), SPREAD):  # to any bucket
            rows.append((int(mix(o[i : i + 1])[0] >> np.uint64(64 - bits)), _MEMBERS, _blob(k[i : i + SPREAD], o[i : i + SPREAD])))
        keys, orders = keys[~out], orders[~out]
    for b, part in zip(*_split(keys, bits), strict=True):
        rows.append((b, _ENTRIES, _blob(keys[part], orders[part])))
    if seen:
        names = np.sort(np.concatenate(seen))
        for b, part in zip(*_split(names, bits), strict=True):
            rows.append((b, _SEEN, names[part].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])


def _split(keys: np.ndarray, bits: int) -> tuple[list[int], list[slice]]:
    """The buckets of sorted keys, and where each lies."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first, n = _runs(bucket)
    return bucket[first].tolist(), [slice(a, a + c) for a, c in zip(first.tolist(), n.tolist(), strict=True)]


def pack(signed: Iterator[tuple[np.ndarray, ...]], bits: int) -> Iterator[pa.RecordBatch]:
    """(orders of m sets, their m x bands keys), both of 64 bits, as PACKED_TYPE.

    A third array, where there is one, tells the orders of sets as they occur, so that repeated_of() finds which do so
    more than once.
    """
    held, seen, size = [], [], 0
    for orders, keys, *occurring in signed:
        if keys.size:
            held.append((keys.reshape(-1).view(np.uint64), np.repeat(orders.view(np.uint64), keys.shape[1])))
        seen += [x.view(np.uint64) for x in occurring if len(x)]
        size += keys.size + sum(map(len, occurring))
        if size >= PACKED:
            yield _packed(held, seen, bits)
            held, seen, size = [], [], 0
    if size:
        yield _packed(held, seen, bits)


def _rows(a: np.ndarray, b: np.ndarray | None, band: np.ndarray | None) -> pa.RecordBatch:
    column = lambda x: pa.array(x.view(np.int64)) if x is not None else pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([column(np.ascontiguousarray(a)), column(b), column(band)], names=["a", "b", "band"])


class _Bucket:
    """What one bucket holds so far."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.hot = 0, np.zeros(0, np.uint64)
        self.seen: list[np.ndarray] = []

    def occur(self, orders: np.ndarray) -> None:
        """Orders as they occur, kept no more than twice each."""
        self.seen.append(orders)
        if sum(map(len, self.seen)) > HELD:
            both = np.sort(np.concatenate(self.seen))
            third = np.zeros(len(both), bool)
            third[2:] = both[2:] == both[:-2]
            self.seen = [both[~third]]

    def add(self, keys: np.ndarray, orders: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, orders))
        self.size += len(keys)
        if self.size > HELD:
            yield from self._give(HOT, False)

    def _distinct(self) -> tuple[np.ndarray, np.ndarray]:
        keys, orders = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        at = np.lexsort((orders, keys))
        keys, orders = keys[at], orders[at]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (orders[1:] != orders[:-1])
        return keys[new], orders[new]

    def _give(self, most: int, last: bool) -> Iterator[pa.RecordBatch]:
        """Give away the members of keys of over `most` sets; unless this is the last time, more of them may come."""
        keys, orders = self._distinct()
        first, n = _runs(keys)
        late = np.isin(keys, self.hot)
        if last:
            out = np.repeat(n > most, n) & ~late
            if out.any():
                yield _rows(orders[out], np.repeat(orders[first], n)[out], keys[out])
        else:
            self.hot = np.union1d(self.hot, keys[first[n > most]])
            late = np.isin(keys, self.hot)
            out = np.zeros(len(keys), bool)
        if late.any():
            yield _rows(orders[late], None, keys[late])
        stay = ~(out | late)
        self.held, self.size = [(keys[stay], orders[stay])], int(stay.sum())

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.seen:
            both = np.sort(np.concatenate(self.seen))
            again = distinct(both[1:][both[1:] == both[:-1]])
            if len(again):
                yield _rows(again, None, None)
        if not self.size:
            return
        if not len(self.hot):  # most keys are of one set: they go before the slow sort
            keys, orders = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
            at = np.argsort(keys)
            keys, orders = keys[at], orders[at]
            same = keys[1:] == keys[:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            self.held = [(keys[shared], orders[shared])]
        yield from self._give(FEW, True)
        keys, orders = self.held[0]
        first, n = _runs(keys)
        run = np.repeat(np.arange(len(first)), n)
        a, b = [], []
        for step in range(1, FEW):
            at = np.flatnonzero(run[step:] == run[:-step]) if len(run) > step else np.zeros(0, np.int64)
            a.append(orders[at])
            b.append(orders[at + step])
        if sum(map(len, a)):
            yield _rows(np.concatenate(a), np.concatenate(b), None)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held = None, _Bucket()
    for batch in batches:
        for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != at:
                yield from held.close()
                at, held = bucket, _Bucket()
            if kind == _HOT_KEYS:
                held.hot = np.union1d(held.hot, np.frombuffer(blob, np.uint64))
            elif kind == _MEMBERS:
                keys, orders = _opened(blob)
                yield _rows(orders, None, keys)
            elif kind == _SEEN:
                held.occur(np.frombuffer(blob, np.uint64))
            else:
                yield from held.add(*_opened(blob))
    yield from held.close()


def shared_bands(packed: DataFrame) -> DataFrame:
    """PACKED_TYPE rows of pack() -> (a, b, band), all long.

    A row with b and without band is a pair of orders of two sets that share a band key of few sets. Rows with a band say
    that the set of order a has the key `band` of many, whose least order is b, or null where no single task saw them
    all. Rows with neither tell that the set of order a occurs more than once. Rows repeat. Sets of equal order count as
    one.
    """
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(trimmed(_reduce), "a bigint, b bigint, band bigint")


def packer(bits: int):
    """(order long, bands array<long>) -> PACKED_TYPE."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            orders = batch.column(0).to_numpy(zero_copy_only=False)
            yield orders, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(orders), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(signed(batches), bits)

    return run


def pairs_of(shared: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a > b, to compare first: of keys of few sets all, of the others each set with the hub."""
    pairs = shared.where("b is not null and a <> b").select("a", "b")
    hot = shared.where("b is null and band is not null").select("a", "band").distinct()
    hubs = materialize(hot.groupBy("band").agg(F.min("a").alias("b"), F.count("*").alias("n")), "hubs")
    if not hubs.isEmpty():
        pairs = pairs.unionByName(join_hot(hot, hubs.select("band", "b"), "band", hubs.select("band", "n")).where("a <> b").select("a", "b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def members_of(shared: DataFrame) -> DataFrame:
    """(order, bands): each set with its keys of many sets, but for those whose hub it is."""
    return shared.where("band is not null and (b is null or a <> b)").groupBy(F.col("a").alias("order")).agg(F.collect_set("band").alias("bands"))


def repeated_of(shared: DataFrame) -> DataFrame:
    """(order): the sets that occur more than once, of those whose occurrence pack() was told."""
    return shared.where("band is null and b is null").select(F.col("a").alias("order"))
