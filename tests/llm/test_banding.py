"""Shared bands and linking: hot keys, buckets that outgrow memory, large groups of loose copies, very long texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import banding, linededup, neardup
from textloom.llm.common import in_bitmap
from textloom.llm.linking import set_bits


def _shared(sets, bits=4, tasks=3):
    """pack() in `tasks` tasks and one reducer over all buckets; sets: order -> keys."""
    blobs = []
    for t in range(tasks):
        some = [(o, k) for o, k in sets if o % tasks == t]
        signed = ((np.array([o], np.int64), np.array([k], np.int64)) for o, k in some)
        for batch in banding.pack(signed, bits):
            blobs += zip(*(c.to_pylist() for c in batch.columns), strict=True)
    blobs.sort(key=lambda x: x[:2])
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([b[i]], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"]) for b in blobs]
    rows = [r for out in banding._reduce(iter(batches)) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    pairs = {tuple(sorted(r[:2])) for r in rows if r[2] is None}
    members, hubs = defaultdict(set), {}
    for a, b, band in rows:
        if band is not None:
            members[band].add(a)
            assert hubs.setdefault(band, b) == b
    assert all(b is None or b == min(members[band]) for band, b in hubs.items())
    return pairs, members


@pytest.mark.parametrize(("hot", "packed", "held"), [(64, 1 << 20, 1 << 22), (5, 200, 1 << 22), (5, 200, 50), (64, 100, 30)])
def test_every_shared_key_is_found(monkeypatch, hot, packed, held):
    monkeypatch.setattr(banding, "HOT", hot)
    monkeypatch.setattr(banding, "PACKED", packed)
    monkeypatch.setattr(banding, "HELD", held)
    r = random.Random(4)
    special = [r.getrandbits(63) - (1 << 62) for _ in range(40)]
    sets = []
    for order in range(1, 700):
        keys = [r.getrandbits(64) - (1 << 63) for _ in range(4)]
        if order % 3 == 0:
            keys[0] = special[0]  # a third of all sets
        if order % 5 < 2:
            keys[1] = special[r.randrange(1, 40)]
        sets.append((order, keys))
    sets += sets[:50]  # signed twice
    want = defaultdict(set)
    for order, keys in sets:
        for k in keys:
            want[k].add(order)
    pairs, members = _shared(sets)
    for k, orders in want.items():
        if k in members:
            assert members[k] == orders
        elif len(orders) > 1:
            assert len(orders) <= max(banding.FEW, hot)
            assert {(a, b) for a in orders for b in orders if a < b} <= pairs
    assert set(members) <= set(want) and len(members[special[0]]) == 233
    together = {(a, b) for orders in want.values() if len(orders) < 300 for a in orders for b in orders if a < b}
    assert pairs <= together


def test_bits_bound_the_intersection():
    rng = np.random.default_rng(3)
    for n, m, common in ((10, 10, 5), (1500, 1600, 1200), (5000, 9000, 4000), (20000, 20500, 100), (0, 5, 0)):
        both = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64)
        a, b = both[:n], both[n - common :]
        x, y = set_bits(a).view(np.uint64), set_bits(b).view(np.uint64)
        fold = min(len(x), len(y))
        x, y = (np.bitwise_or.reduce(z.reshape(-1, fold), axis=0) for z in (x, y))
        left = n - sum(int(v).bit_count() for v in x & ~y)
        assert left >= common
        if n >= 1500 and common < n / 10:
            assert left < n * 0.8  # it tells something, however long the sets are


def _components(sets, num, den=100):
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if den * common >= num * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_loose_copies_and_long_texts(spark):
    """More copies than a small bucket has, from 0 to 20 % of the words edited, and texts of 20,000 words."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    base = [r.choice(vocabulary) for _ in range(120)]
    for i in range(90):
        own = list(base)
        for _ in range(i % 5):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        texts.append(" ".join(own))
    for n in (20000, 6000):
        long = [r.choice(vocabulary) for _ in range(n)]
        for edits in (0, n // 200, n // 100, n // 20):
            own = list(long)
            for _ in range(edits):
                own[r.randrange(n)] = r.choice(vocabulary)
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    comp = _components(sets, 85)
    least = {}
    for i, c in enumerate(comp):
        least.setdefault(c, i)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {g.doc_id: g for g in neardup.near_duplicates(docs).collect()}
    assert [(got[i].component_id, got[i].n_shingles) for i in range(len(texts))] == [(least[c], len(s)) for c, s in zip(comp, sets, strict=True)]
    assert 3 < len(set(comp)) < 60


def test_line_dedup_looks_lines_up_where_they_stand(spark):
    """Beyond bitmap_most wanted lines; texts that are not UTF-8; columns that clash."""
    r = random.Random(2)
    say = lambda n: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    lines = [say(r.randint(1, 14)) for _ in range(60)]
    rows = [(i % 70 or None, "\n".join(r.choice(lines) + r.choice(["", "", ".", "!"]) for _ in range(r.randint(0, 6))), "x", 1, 2) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, gone long, n_lines int").withColumn("text", F.when(F.col("doc_id") == 5, F.expr("cast(x'41ff420a41ff42' as string)")).otherwise(F.col("text")))
    raw = lambda df: Counter(tuple(x) for x in df.select("doc_id", F.hex(F.col("text").cast("binary")), "_id", "gone", "n_lines", "n_dropped").collect())
    one, two = raw(linededup.dedup_lines(docs)), raw(linededup.dedup_lines(docs, bitmap_most=0))
    assert one == two and sum(one.values()) == 90
    assert {x[1] for x in one if x[0] == 5} <= {"41EFBFBD42", ""}


def test_lines_are_compared_on_their_sets(monkeypatch):
    r = random.Random(6)
    lines = ["".join(r.choice("abé ") for _ in range(n)).encode() for n in (1, 3, 6, 7, 8, 20, 21, 300, 60_000)] + [b"aaaaaaaaaaaa", b"aaaaaaaa", b"ab\xffcdefghi"]
    sets = [{t[i : i + 7] for i in range(len(t) - 6)} or {t} for t in (x.decode("utf-8", "replace") for x in lines)]
    pairs = [(i, j) for i in range(len(lines)) for j in range(len(lines))]
    for part in (1 << 18, 11):
        monkeypatch.setattr(linededup, "_PART", part if part > 11 else 1000)
        n, m, common = linededup._common([lines[i] for i, _ in pairs], [lines[j] for _, j in pairs], 7)
        assert [tuple(map(int, x)) for x in zip(n, m, common, strict=True)] == [(len(sets[i]), len(sets[j]), len(sets[i] & sets[j])) for i, j in pairs]


def test_bitmap_has_no_false_negative():
    values = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    words = np.zeros(1 << 10, np.int64)
    place = values >> np.uint64(64 - 16)
    np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (place & np.uint64(63))).view(np.int64))
    assert in_bitmap(words, values).all()
