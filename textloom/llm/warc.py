"""WARC archives compressed by a Zstandard dictionary of their own records.

An archive is a .warc.zst file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then each record as a
frame of its own, so that any record can be read alone. Archives are written through Spark's text writer, hence to
any file system Spark reaches: a frame is a row, and the writer's line separator is an empty skippable frame (magic
0x184D2A50), which readers of Zstandard streams pass over. No frame holds the separator's bytes, so Spark's text reader
gives the frames back as rows: archives of any size are split among tasks and never held whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, scratch_path, small

_SEPARATOR = "P*M\x18\0\0\0\0"
_SEPARATOR_BYTES = _SEPARATOR.encode()
#: ASCII characters that a header holds as they are; the others of a URL, and %, are percent-encoded.
_URL_SAFE = "".join(chr(c) for c in range(0x20, 0x7F) if chr(c) != "%")
_URN = "urn:textloom:page"
_DICT_MAGIC = b"\x5d\x2a\x4d\x18"
_CRLF = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _uid(page_id) -> str:
    """The record id of a page. Characters that a header cannot hold are percent-encoded; a null id has none."""
    return f"<{_URN}>" if page_id is None else f"<{_URN}:{quote(str(page_id), safe='')}>"


def _page_id(uid: str | None) -> str | None:
    return unquote(uid[len(_URN) + 2 : -1]) if uid and uid.startswith(f"<{_URN}:") else None


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str = "2026-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit has no block; what it leaves out is told by its headers."""
    revisit = refers_to is not None
    uid = _uid
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {uid(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=_URL_SAFE))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {uid(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def parse_record(raw: bytes) -> dict:
    """Headers by lower-case name, and `payload`: the body of the HTTP response, or None for a revisit."""
    head, _, rest = raw.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    out: dict = {(p := x.partition(": "))[0].lower(): p[2] for x in lines[1:]}
    n = int(out["content-length"])
    if rest[n:] != _CRLF * 2:
        raise ValueError("record is cut off")
    out["payload"] = None if out["warc-type"] == "revisit" else rest[:n].partition(_CRLF * 2)[2]
    return out


def build_dictionary(samples: list[bytes], size: int = 64 * 1024) -> bytes:
    """A dictionary trained on records; with too few or too uniform samples, their raw content serves as one."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _frame(coder: zstandard.ZstdCompressor, raw: bytes) -> bytes:
    """The record as one frame that does not hold the separator."""
    frame = coder.compress(raw)
    if _SEPARATOR_BYTES not in frame:
        return frame
    # Literals of the record: a block that ends within each of them parts them by the next block's header.
    out, at = coder.compressobj(), 0
    parts = []
    while (i := raw.find(_SEPARATOR_BYTES, at)) >= 0:
        parts += [out.compress(raw[at : i + 4]), out.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)]
        at = i + 4
    frame = b"".join([*parts, out.compress(raw[at:]), out.flush()])
    if _SEPARATOR_BYTES in frame:
        raise ValueError("a frame holds the separator of frames")
    return frame


def _packer(dictionary: bytes, level: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None), True
        for batch in small(batches):
            frames, size = [], 0
            for page_id, url, html, digest, ref in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if first:
                    frames.append(_DICT_MAGIC + struct.pack("<I", len(dictionary)) + dictionary)
                    first = False
                frames.append(_frame(coder, record(page_id, url, html or b"", digest, ref)))
                size += len(frames[-1])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
                    frames, size = [], 0
            if frames:
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    return pack


def split_frames(data: bytes) -> tuple[bytes, list[bytes]]:
    """(dictionary, data frames) of an archive."""
    at, dictionary, frames = 0, b"", []
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (n,) = struct.unpack_from("<I", data, at + 4)
            if at == 0 and magic == 0x184D2A5D:
                dictionary = data[8 : 8 + n]
            at += 8 + n
            continue
        end = _frame_end(data, at)
        frames.append(data[at:end])
        at = end
    return dictionary, frames


def _frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, from its block headers (RFC 8878, 3.1.1)."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return pos + 4 * (flags >> 2 & 1)


class _Decoder:
    """Decompresses frames by the dictionaries of their archives; those of one number are tried in turn."""

    def __init__(self, dictionaries: list[bytes]):
        self.by_id: dict[int, list[zstandard.ZstdDecompressor]] = {0: [zstandard.ZstdDecompressor()]}
        for d in dictionaries:
            made = zstandard.ZstdCompressionDict(d)
            self.by_id.setdefault(made.dict_id(), []).insert(0, zstandard.ZstdDecompressor(dict_data=made))

    def __call__(self, frame: bytes) -> dict:
        error: Exception = ValueError("no dictionary for a frame")
        for coder in self.by_id.get(zstandard.get_frame_parameters(frame).dict_id, ()):
            try:
                return parse_record(coder.decompressobj().decompress(frame))
            except (zstandard.ZstdError, ValueError) as e:
                error = e
        raise error


def _unpacker(dictionaries: list[bytes]):
    names = ["record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _Decoder(dictionaries)
        for batch in small(batches):
            rows = []
            for frame in batch.column(0).to_pylist():
                if frame and struct.unpack_from("<I", frame)[0] & 0xFFFFFFF0 != 0x184D2A50:
                    r = decode(frame)
                    digest, n, body, url = r["warc-payload-digest"].removeprefix("sha1:"), int(r["x-payload-length"]), r["payload"], r.get("warc-target-uri")
                    rows.append((_page_id(r["warc-record-id"]), url and unquote(url), n, digest, r["warc-type"], _page_id(r.get("warc-refers-to")), body is None or (len(body) == n and base32_sha1(body) == digest)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)

    return unpack


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        body = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in body], pa.int64()), pa.array([base32_sha1(x) for x in body]), pa.array([hashlib.sha256(x).digest() for x in body], pa.binary())], names=["page_id", "n", "digest", "full"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, per_archive: int = 1 << 30, samples: int = 400, sample_bytes: int = 100_000, level: int = 3) -> None:
    """Write a record for each row of pages, as .warc.zst archives in the folder `path`.

    Of rows with equal payloads (UTF-8 of the html, null as empty) of at least min_bytes, the one with the smallest id
    is the response, the others are revisits of it; of rows that share that id too, one is the response. Smaller
    payloads are all responses. A null id is larger than any other. The dictionary is built from the first sample_bytes
    of the records of the `samples` pages with the smallest hashes of their ids, a table of bounded size; every record
    is written whole. Each task writes an archive of what it has read; small ones are joined as long as there are more
    than one of per_archive bytes, before compression, or one for each core. Nulls in url leave its header out. An empty
    table writes no archive; repeated rows each get a record; other columns are not read.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    known = materialize(src.select("page_id", "html").mapInArrow(_digests, f"page_id {kind}, n bigint, digest string, full binary"), "digests")
    copies = known.where(F.col("n") >= min_bytes).groupBy("full").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    ids = materialize(known.join(copies, "full").select("page_id", "digest", "first"), "copies")
    # Rows that repeat the first page's id: one of them stays the response, so the place among them decides.
    twice = ids.where(F.col("page_id").eqNullSafe(F.col("first"))).groupBy("page_id", "digest").agg(F.count("*").alias("c")).where("c > 1").select("page_id", "digest", F.lit(True).alias("again"))
    refs = ids.select("page_id", "digest", "first").distinct().join(twice, ["page_id", "digest"], "left")
    total = known.agg(F.sum("n")).first()[0] or 0
    body = src.withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).withColumn("digest", _digest_column("payload"))
    r = refs.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first", "again")
    body = body.join(r, body["page_id"].eqNullSafe(r["_p"]) & (body["digest"] == r["_d"]), "left")
    lone, many = body.where(F.col("again").isNull()), body.where(F.col("again"))
    place = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    ref = lambda extra: F.when(F.col("first").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first")) | extra), F.col("first"))
    cols = ["page_id", "url", "payload", "digest"]
    out = lone.select(*cols, ref(F.lit(False)).alias("refers_to"))
    if twice.limit(1).count():
        out = out.unionByName(many.withColumn("place", place).select(*cols, ref(F.col("place") > 1).alias("refers_to")))
    # Ids first, pages then: a sort that carries pages would send every task's candidates to the driver.
    some = src.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(samples)
    head = F.substring(F.coalesce("html", F.lit("")).cast("binary"), 1, sample_bytes)
    sample = src.join(F.broadcast(some), "page_id").select("page_id", "url", head.alias("head")).limit(2 * samples).collect()
    dictionary = build_dictionary([record(x["page_id"], x["url"], b := bytes(x["head"]), base32_sha1(b), None) for x in sample])
    frames = out.coalesce(max(spark.sparkContext.defaultParallelism, -(-total // per_archive))).mapInArrow(_packer(dictionary, level), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", _SEPARATOR).text(path)
    discard(known, ids)


def _digest_column(payload: str) -> F.Column:
    """Base32 of the SHA-1, without leaving the JVM: 160 bits are 32 digits of 5."""
    hexed = F.sha1(payload)
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(4):  # 10 hex digits are 40 bits are 8 digits
        v = F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 10).cast("long")
        parts += [F.substring(alphabet, (F.shiftright(v, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, url, payload_bytes, payload_digest, record_type, refers_to, intact) of each record below path.

    record_id and refers_to are the pages' ids as text. An empty folder gives no rows.
    """
    kind = "record_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, intact boolean"
    frames = spark.read.option("lineSep", _SEPARATOR).option("pathGlobFilter", "part-*").text(path).select(F.col("value").cast("binary").alias("frame"))
    heads = frames.where(F.substring("frame", 1, 4) == F.lit(_DICT_MAGIC)).distinct().collect()  # one for each writing
    return frames.mapInArrow(_unpacker([bytes(r["frame"])[8:] for r in heads if len(r["frame"]) > 8]), kind)


def archive_pages(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write the pages' archives to the shared folder and return what reading them back gives.

    A record whose payload does not have the digest and length that its headers tell raises an error.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col=id_col, **options)
    kind = pages.schema[id_col].dataType
    id_ = lambda c: F.col(c).cast(kind)
    rows = read_archives(spark, path).where(F.when(F.col("intact"), F.lit(True)).otherwise(F.raise_error(F.lit("archive damaged")).cast("boolean")))
    return rows.select(id_("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", id_("refers_to").alias("refers_to"))
