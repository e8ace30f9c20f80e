"""Benchmark decontamination by a prefix-filtered set join, verified on item-sized windows.

A window is 10 consecutive words of an item (all its words if fewer). Whole containment makes the necessary prefix of
a window's shingles one token long: a document with the window has the window's rarest shingle. So

1. one pass over the texts keeps, per document, the stretches whose 5-word shingles all pass a bitmap of the
   benchmark's shingles. The bitmap has a fixed size, whatever the benchmark's; what it lets through by chance falls
   out below;
2. shingles of the stretches are counted over all documents, which orders each window's shingles by rarity;
3. distinct stretches are joined with windows on the window's rarest shingle only. The shingle's place in window and
   stretch fixes where the window would start; it must fit into the stretch (length and position bounds), and its
   words must be equal there (verification on words, not hashes);
4. hit words are united per stretch and summed per document. Stretches of one document share no word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HashCache, bitmap, discard, in_bitmap, join_hot, materialize, slices, small, trimmed
from .sketch import rolling

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased, as bytes: all else becomes a space.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _short(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"\x00item " + b" ".join(words)) if words else 0


def _windows(window: int, k: int):
    """Items -> (item_id, words array<string>, tokens array<long>, k): its windows with the shingles of each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in small(batches):
            rows, words_, tokens_, ks = [], [], [], []
            for r, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                ws = _words(t or b"")
                if not ws:
                    continue
                size = min(window, len(ws))
                kk = min(k, size)
                h = rolling(np.array([cache[w] for w in ws], np.uint64), kk).view(np.int64)
                for i in range(len(ws) - size + 1):
                    rows.append(r)
                    words_.append([w.decode("utf-8", "replace") for w in ws[i : i + size]])
                    tokens_.append(h[i : i + size - kk + 1].tolist())
                    ks.append(kk)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words_, pa.list_(pa.string())), pa.array(tokens_, pa.list_(pa.int64())), pa.array(ks, pa.int32())], names=["item_id", "words", "tokens", "k"])

    return cut


def _stretches(bitmaps: dict[int, np.ndarray]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in small(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, j in slices([len(t) for t in texts]):
                words = [_words(t) for t in texts[i:j]]
                lengths = np.array([len(w) for w in words], np.int64)
                flat = np.fromiter((h for w in words for h in map(cache.__getitem__, w)), np.uint64, int(lengths.sum()))
                ends = np.cumsum(lengths)
                owner = np.repeat(np.arange(len(words)), lengths)
                cover = np.zeros(len(flat) + 1, np.int64)
                for k, bits in bitmaps.items():
                    h = rolling(flat, k)
                    at = np.flatnonzero(in_bitmap(bits, h))
                    at = at[at + k <= ends[owner[at]]]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + k, -1)
                on = np.cumsum(cover[:-1]) > 0
                found: list[list[str]] = [[] for _ in words]
                if on.any():
                    edge = np.ones(len(flat) + 1, bool)
                    edge[1:-1] = (on[1:] != on[:-1]) | (owner[1:] != owner[:-1])
                    cuts = np.flatnonzero(edge)
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        if on[a]:
                            d = int(owner[a])
                            base = int(ends[d] - lengths[d])
                            found[d].append(b" ".join(words[d][a - base : b - base]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(lengths), pa.array(found, pa.list_(pa.string()))], names=["id", "n_words", "stretches"])

    return find


def _tokens(ks: list[int]):
    """Stretches -> (sid, pos, token, k)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in small(batches):
            rows, pos, tok, kk = [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                h = np.array([cache[w] for w in t.encode().split(b" ")], np.uint64)
                for k in ks:
                    x = rolling(h, k).view(np.int64)
                    rows.append(np.full(len(x), r))
                    pos.append(np.arange(len(x)))
                    tok.append(x)
                    kk.append(np.full(len(x), k, np.int32))
            cat = lambda v, t: pa.array(np.concatenate(v).astype(t) if v else np.zeros(0, t))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(cat(rows, np.int64)), cat(pos, np.int64), cat(tok, np.int64), cat(kk, np.int32)], names=["sid", "pos", "token", "k"])

    return cut


def contaminated_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5, log2_bits: int = 22) -> DataFrame:
    """(id, n_words, n_hit, items array<string> sorted, n_items, contaminated), a row for each row of docs.

    A word is hit if it lies inside an occurrence of any window of an item. Words are cut after lower-casing A-Z at
    every ASCII character that is no letter or digit. Null and wordless texts have no words and hit nothing; wordless
    items have no window; a null item id is not named. Repeated rows each return a row; repeated items count once by
    id. Empty tables on either side are allowed; bytes that are not UTF-8 are read as U+FFFD. The bitmap that every worker gets is 2**log2_bits bits per shingle
    length, so its size does not grow with either table.
    """
    ids, its = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    bench = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    windows = materialize(bench.mapInArrow(trimmed(_windows(window, k)), f"item_id {its}, words array<string>, tokens array<bigint>, k int"), "windows")
    ks = [r["k"] for r in windows.select("k").distinct().collect()]  # at most k values
    bitmaps = {kk: bitmap(windows.where(F.col("k") == kk).select(F.explode("tokens").alias("token")), "token", log2_bits) for kk in ks}
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = materialize(src.mapInArrow(trimmed(_stretches(bitmaps)), f"id {ids}, n_words bigint, stretches array<string>"), "stretches")

    texts = found.where("size(stretches) > 0").select(F.explode("stretches").alias("stretch")).groupBy("stretch").agg(F.count("*").alias("times"))
    texts = materialize(texts.withColumn("sid", F.sha2("stretch", 256)), "texts")
    tokens = materialize(texts.select("sid", "stretch").mapInArrow(trimmed(_tokens(ks)), "sid string, pos bigint, token bigint, k int"), "tokens")
    df = tokens.join(texts.select("sid", "times"), "sid").groupBy("token", "k").agg(F.sum("times").alias("df"))
    uses = windows.select("words", "tokens", "k").distinct().select("words", "k", F.posexplode("tokens").alias("offset", "token"))
    rarest = uses.join(df, ["token", "k"], "left").groupBy("words", "k").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "token")).alias("r"))
    prefix = rarest.where("r.df > 0").select("words", "k", "r.offset", "r.token", F.size("words").alias("size"))
    placed = tokens.join(prefix, ["token", "k"]).join(texts.select("sid", "stretch"), "sid").withColumn("start", F.col("pos") - F.col("offset")).withColumn("own", F.split("stretch", " "))
    placed = placed.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.size("own")))
    hits = materialize(placed.where(F.slice("own", (F.col("start") + 1).cast("int"), F.col("size")) == F.col("words")).select("sid", "words", "start", "size"), "hits")

    order = Window.partitionBy("sid").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    reach = F.coalesce(F.max(end).over(order), F.lit(0))
    covered = hits.select("sid", "start", "size").distinct().withColumn("fresh", F.greatest(F.lit(0), end - F.greatest("start", reach)))
    covered = covered.groupBy("sid").agg(F.sum("fresh").alias("hit"))
    owners = windows.select("words", F.col("item_id").cast("string").alias("item_id")).distinct()
    named = hits.select("sid", "words").distinct().join(owners, "words").groupBy("sid").agg(F.collect_set("item_id").alias("items"))
    per = materialize(covered.join(named, "sid"), "per")
    discard(windows, texts, tokens, hits)

    # A document's stretches are part of its row's key, so rows that share an id and differ in text stay apart.
    keyed = found.withColumn("key", F.when(F.size("stretches") > 0, F.sha2(F.concat_ws("\n", "stretches"), 256)))
    used = keyed.where("key is not null").select("key", "stretches").dropDuplicates(["key"]).select("key", F.explode("stretches").alias("stretch")).withColumn("sid", F.sha2("stretch", 256)).join(per, "sid")
    docs_hit = used.groupBy("key").agg(F.sum("hit").alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Most documents have no stretch: they stay out of the join, where their null key would be one hot key.
    some = keyed.where("key is not null").select("id", "n_words", "key")
    counts = materialize(some.groupBy("key").agg(F.count("*").alias("n")), "counts")
    some = join_hot(some, docs_hit, "key", counts, "left").drop("key")
    none = keyed.where("key is null").select("id", "n_words", F.lit(None).cast("long").alias("hit"), F.lit(None).cast("array<string>").alias("items"))
    out = some.unionByName(none)
    n_hit, named_ = F.coalesce("hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), named_.alias("items"), F.size(named_).cast("long").alias("n_items"), (n_hit > 0).alias("contaminated"))


def items_digest(items) -> F.Column:
    """Lower-case hex SHA-256 of the sorted ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)
