"""Toxicity by multiple-instance learning: labels are of documents, scores are of sentences.

A sentence's probability is logistic in the summed weights of its words (a word's own weight and those of its
prefixes, hashed); a document's is the noisy-or of its sentences: 1 - prod(1 - p). Training maximises the likelihood
of document labels only, so the sentences that make a document toxic are found, not given.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, release_memory, small, trimmed

DIM = 1 << 18
#: Everything but letters, digits and bytes of non-ASCII characters parts words; . ! ? and line feeds part sentences.
_TABLE = bytes((b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 10 if b in b".!?\n" else 32) for b in range(256))
_PREFIXES = (4, 5, 6, 7, 8)


def _features(word: bytes) -> list[int]:
    parts = [b"w" + word, *(b"p" + word[:n] for n in _PREFIXES if len(word) > n)]
    return [xxhash.xxh32_intdigest(p) & (DIM - 1) for p in parts]


#: Full stops, exclamation and question marks of other scripts.
_ENDS = [c.encode() for c in "。！？｡؟۔।॥…"]


def _sentences(text: bytes) -> list[bytes]:
    """The sentences, each as long as in the text; the bytes between two of them are one mark's."""
    plain = text.translate(_TABLE)
    if not text.isascii():
        for mark in _ENDS:
            if mark in plain:
                plain = plain.replace(mark, b"\n" + b" " * (len(mark) - 1))
    return plain.split(b"\n")


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _train(texts: list[bytes], y: np.ndarray, weight: np.ndarray, rounds: int, l2: float, rate: float) -> tuple[np.ndarray, float]:
    vocabulary: dict[bytes, int] = {}
    word, sent, doc, n_sent = array("i"), array("i"), array("i"), 0
    for d, t in enumerate(texts):
        for s in _sentences(t):
            if ws := s.split():
                word.extend(vocabulary.setdefault(w, len(vocabulary)) for w in ws)
                sent.extend([n_sent] * len(ws))
                doc.append(d)
                n_sent += 1
    w = np.zeros(DIM)
    if not n_sent:
        return w, -6.0
    word, sent, doc = (np.frombuffer(x, np.int32) for x in (word, sent, doc))
    feats, owner = array("i"), array("i")
    for i, v in enumerate(vocabulary):
        f = _features(v)
        feats.extend(f)
        owner.extend([i] * len(f))
    n_words = len(vocabulary)
    vocabulary.clear()
    feats, owner = np.frombuffer(feats, np.int32), np.frombuffer(owner, np.int32)
    # A feature of fewer than four documents says nothing that carries over.
    pairs = distinct(word.astype(np.int64) * len(texts) + doc[sent])
    seen = np.bincount(pairs // len(texts), minlength=n_words)
    df = np.bincount(feats, weights=seen[owner], minlength=DIM)
    keep = df[feats] >= 4
    owner, feats = owner[keep], feats[keep]
    bias, m, v, mb, vb = -4.0, np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    sign = y[doc] == 1
    for step in range(1, rounds + 1):
        value = np.bincount(owner, weights=w[feats], minlength=n_words)
        z = bias + np.bincount(sent, weights=value[word], minlength=n_sent)
        p = 0.5 * (1 + np.tanh(z / 2))
        log_clean = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=len(texts))
        clean = np.exp(np.minimum(log_clean, -1e-9))
        dz = np.where(sign, -(clean / (1 - clean))[doc], 1.0) * p * weight[doc]
        gv = np.bincount(word, weights=dz[sent], minlength=n_words)
        g = np.bincount(feats, weights=gv[owner], minlength=DIM) / len(texts) + l2 * w
        gb = dz.sum() / len(texts)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, float(bias)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_each: int = 1500, max_bytes: int = 200_000, rounds: int = 250, l2: float = 2e-4, rate: float = 0.05) -> dict:
    """A model from at most max_each labelled documents of either label, the first by crc32 of the id.

    What is learned from is bounded: max_bytes of a text, one text of an id. Rows held out (crc32 mod 4 = 2), unlabelled or absent from docs are not used. The two labels are weighed by how
    many labels each has in the whole table. Without both labels the model scores every document as the bias says.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rank = [F.crc32(F.col("id").cast("string").cast("binary")), "id"]
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(*rank).limit(max_each)
        chosen = part if chosen is None else chosen.unionByName(part)
    text = docs.select(F.col(id_col).alias("id"), F.substring(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 1, max_bytes).alias("text"))
    # Rows that share an id share its label; the driver gets one of them, the first by its hash.
    rows = text.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"]))
    y = np.array([r["y"] for r in rows], int)
    taken = np.bincount(y, minlength=2)
    if not taken.all():
        return {"at": np.zeros(0, np.int64), "w": np.zeros(0), "bias": -6.0}
    share = np.array([total.get(0, 0) / taken[0], total.get(1, 0) / taken[1]])
    weight = share[y] / share[y].mean()
    texts = [bytes(r["text"]) for r in rows]
    rows.clear()
    w, bias = _train(texts, y, weight, rounds, l2, rate)
    texts.clear()
    release_memory()
    at = np.flatnonzero(np.abs(w) > 1e-4)
    return {"at": at, "w": w[at], "bias": bias}


class _Weights(dict):
    def __init__(self, w: np.ndarray, limit: int = 300_000):
        self.w, self.limit = w, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        v = self[word] = float(self.w[_features(word)].sum())
        return v


class _Scorer:
    """Scores texts; one for all batches of a task, so that weights and words are looked up once."""

    def __init__(self, model: dict):
        w = np.zeros(DIM)
        w[model["at"]] = model["w"]
        self.cache, self.bias = _Weights(w), model["bias"]

    def sentences(self, text: bytes) -> list[tuple[bytes, float]]:
        """Each sentence and its log odds; wordless ones are out of the question."""
        return [(s, self.bias + sum(map(self.cache.__getitem__, ws)) if (ws := s.split()) else -60.0) for s in _sentences(text)]

    def odds(self, text: bytes | None) -> np.ndarray:
        return np.array([z for _, z in self.sentences(text or b"")])


def _noisy_or(z: np.ndarray) -> float:
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def _scorer(model: dict):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in small(batches):
            scores, worst, top, flagged = [], [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                z = scorer.odds(t)
                scores.append(_noisy_or(z))
                k = int(z.argmax())
                worst.append(k)
                top.append(float(1 / (1 + np.exp(-z[k]))))
                flagged.append(int((z > 0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(worst, pa.int64()), pa.array(top, pa.float64()), pa.array(flagged, pa.int64())], names=["id", "score", "worst_sentence", "worst_score", "n_flagged"])

    return score


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, worst_sentence, worst_score, n_flagged) for each row of docs; sentences are numbered from 0.

    Only the text is read. Null, empty and wordless texts score about 0. Repeated rows each return a row.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(trimmed(_scorer(model)), f"id {kind}, score double, worst_sentence bigint, worst_score double, n_flagged bigint")
    return out.withColumnRenamed("id", id_col)


def _locator(model: dict, threshold: float):
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in small(batches):
            owners, starts, ends, ps = [], [], [], []
            for r, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                at, raw = 0, t or b""
                seen = chars = 0  # bytes of the text whose code points are counted
                for s, z in scorer.sentences(raw):
                    if (p := 1 / (1 + np.exp(-z))) >= threshold:
                        a, b = at + len(s) - len(s.lstrip()), at + len(s)
                        chars += len(raw[seen:a].decode("utf-8", "replace"))
                        owners.append(r)
                        starts.append(chars)
                        chars += len(raw[a:b].decode("utf-8", "replace"))
                        ends.append(chars)
                        ps.append(float(p))
                        seen = b
                    at += len(s) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(ps, pa.float64())], names=["id", "start", "end", "score"])

    return locate


def locate_toxic_sentences(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, start, end, score): a row for each sentence whose probability reaches the threshold; code points, end exclusive.

    Blanks in front of a sentence are not part of it. Null, empty and wordless texts give no row, repeated rows each
    their own, an empty table none. Bytes that are not UTF-8 count as U+FFFD. Other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(trimmed(_locator(model, threshold)), f"id {kind}, start bigint, end bigint, score double").withColumnRenamed("id", id_col)


def _dropper(model: dict, place: int, threshold: float):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in small(batches):
            yield batch.filter(pa.array([_noisy_or(scorer.odds(t)) < threshold for t in batch.column(place).cast(pa.binary()).to_pylist()], pa.bool_()))

    return drop


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; in one pass, without a join.

    Null, empty and wordless texts score about 0 and stay. Repeated rows are scored alike. An empty table stays empty.
    """
    return docs.mapInArrow(trimmed(_dropper(model, docs.columns.index(text_col), threshold)), docs.schema)
