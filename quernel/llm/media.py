"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads.

A payload is named by its SHA-256. Each task appends the payloads it holds to
tar shards of its own in the shared folder (plain ustar: any tar reads them), so
payloads are never shuffled; of payloads that several rows hold, the row of
least key writes. Rows carry digest, shard, offset and length. A second pass
reads only the first bytes of each range and fills the metadata columns. A task
that is lost leaves an orphan shard, which no row names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tarfile
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, shared_dir, small

SHARD_BYTES, HEAD, HEAD_RAW = 256 << 20, 1536, 4096
INDEX = "digest string, shard string, offset long, length long, raw_length long, encoding string"
META = "media_type string, width int, height int, sample_rate int, duration_ms long, charset string, lang string, title string"
_PLAIN = ("image/png", "image/jpeg", "image/gif")
_NONE = dict.fromkeys(("media_type", "width", "height", "sample_rate", "duration_ms", "charset", "lang", "title"))


def _jpeg(head: bytes) -> dict:
    at = 2
    while at + 9 < len(head) and head[at] == 0xFF:
        kind = head[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return {"width": width, "height": height}
        else:
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return {}


def _wav(head: bytes) -> dict:
    at, rate, per_second = 12, None, 0
    while at + 8 <= len(head):
        kind, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if kind == b"fmt " and at + 20 <= len(head):
            rate, per_second = struct.unpack("<II", head[at + 12 : at + 20])
        if kind == b"data":
            return {"sample_rate": rate, "duration_ms": size * 1000 // per_second if per_second else None}
        at += 8 + size + size % 2
    return {"sample_rate": rate}


def _more(meta: dict, head: bytes) -> bool:
    """Whether the header goes on after ``head``."""
    kind = meta["media_type"]
    if kind == "text/html":
        return not re.search(rb"</head|<body", head, re.I)
    return kind == "image/jpeg" and meta["width"] is None or kind == "audio/wav" and meta["duration_ms"] is None


def _html(head: bytes) -> dict:
    charset = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w-]+)", head, re.I)
    name = charset[1].decode("ascii").lower() if charset else None
    try:
        text = head.decode(name or "utf-8", "ignore")
    except LookupError:
        text = head.decode("utf-8", "ignore")
    lang = re.search(r"<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", text, re.I)
    title = re.search(r"<title[^>]*>(.*?)</title", text, re.I | re.S)
    return {"charset": name, "lang": lang[1].lower() if lang else None, "title": " ".join(title[1].split()) if title else None}


def sniff(head: bytes) -> dict:
    """Metadata from a payload's first bytes; fields that they don't show are None."""
    out = dict(_NONE)
    if not head:
        return out | {"media_type": "application/x-empty"}
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return out | {"media_type": "image/png"} | dict(zip(("width", "height"), struct.unpack(">II", head[16:24])))
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return out | {"media_type": "image/gif"} | dict(zip(("width", "height"), struct.unpack("<HH", head[6:10])))
    if head[:3] == b"\xff\xd8\xff":
        return out | {"media_type": "image/jpeg"} | _jpeg(head)
    if head[:2] == b"BM" and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        return out | {"media_type": "image/bmp", "width": width, "height": abs(height)}
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return out | {"media_type": "audio/wav"} | _wav(head)
    if re.match(rb"\s*(<!--.*?-->\s*)*<(!doctype html|html|head|body)\b", head, re.I | re.S):
        return out | {"media_type": "text/html"} | _html(head)
    try:
        text = head[:-3] if len(head) > 3 else head
        text.decode("utf-8")
        return out | {"media_type": "application/octet-stream" if b"\0" in head else "text/plain", "charset": None if b"\0" in head else "utf-8"}
    except UnicodeDecodeError as e:
        return out | {"media_type": "application/octet-stream"} if e.start < len(text) - 3 else out | {"media_type": "text/plain", "charset": "utf-8"}


def _open(path: str, how: str):
    """A file of the shared folder, through whatever filesystem its URI names."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if how == "w":
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(inner, compression=None)
    return system.open_input_file(inner)


class _Shard:
    def __init__(self, folder: str):
        self.path = f"{folder}/shard-{uuid.uuid4().hex}.tar"
        self.file, self.at = _open(self.path, "w"), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.file.write(head)
        self.file.write(data)
        begin = self.at + len(head)
        fill = -len(data) % 512
        self.file.write(b"\0" * fill)
        self.at = begin + len(data) + fill
        return begin

    def close(self) -> None:
        self.file.write(b"\0" * 1024)
        self.file.close()


def store(rows: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads of ``rows`` (key, payload, digest, holder) and return the index, one row for each digest."""

    def write(batches):
        shard, seen = None, set()
        for pdf in batches:
            out = []
            for key, payload, digest, holder in zip(pdf["key"], pdf["payload"], pdf["digest"], pdf["holder"]):
                if digest is None or digest in seen or not (pd.isna(holder) or holder == key):
                    continue
                seen.add(digest)
                payload = bytes(payload)
                plain = sniff(payload[:HEAD_RAW])["media_type"] in _PLAIN
                data = payload if plain else zlib.compress(payload, 6)
                shard = shard or _Shard(folder)
                begin = shard.add(digest if plain else digest + ".zz", data)
                out.append((digest, shard.path, begin, len(data), len(payload), "plain" if plain else "deflate"))
                if shard.at >= shard_bytes:
                    shard.close()
                    shard = None
            yield pd.DataFrame(out, columns=["digest", "shard", "offset", "length", "raw_length", "encoding"])
        if shard:
            shard.close()

    index = materialise(rows.select("key", "payload", "digest", "holder").mapInPandas(write, INDEX), "media-index")
    first = F.min(F.struct("shard", "offset", "length", "raw_length", "encoding")).alias("at")
    return index.groupBy("digest").agg(first).select("digest", "at.*")


def _read(file, offset: int, length: int, encoding: str, most: int | None = None) -> bytes:
    file.seek(offset)
    raw = file.read(length if most is None else min(length, most))
    if encoding == "plain":
        return raw
    return zlib.decompress(raw) if most is None else zlib.decompressobj().decompress(raw, most * HEAD_RAW // HEAD)


def _look(file, offset: int, length: int, encoding: str, head: int) -> dict:
    """Metadata from the first ``head`` stored bytes; where the header goes on (a picture's long comment, a late title) from four times as many, and so on."""
    while True:
        data = _read(file, offset, length, encoding, head)
        meta = sniff(data)
        if not _more(meta, data) or head >= length and len(data) < head * HEAD_RAW // HEAD:
            return meta
        head *= 4


def describe(index: DataFrame, head: int = HEAD) -> DataFrame:
    """``index`` and the metadata columns, from the first ``head`` stored bytes of each range, and from more only where a header is longer."""
    fields = list(_NONE)

    def look(batches):
        path, file = None, None
        for pdf in batches:
            found = []
            for shard, offset, length, encoding in zip(pdf["shard"], pdf["offset"], pdf["length"], pdf["encoding"]):
                if shard != path:
                    if file:
                        file.close()
                    path, file = shard, _open(shard, "r")
                found.append(_look(file, offset, length, encoding, head))
            meta = pd.DataFrame(found, columns=fields, dtype=object)
            for c in ("width", "height", "sample_rate", "duration_ms"):
                meta[c] = meta[c].astype("Int64")
            yield pd.concat([pdf.reset_index(drop=True), meta], axis=1)
        if file:
            file.close()

    near = index.repartition("shard").sortWithinPartitions("shard", "offset")
    return near.mapInPandas(look, f"{INDEX}, {META}")


def media_columns(rows: DataFrame, key: str = "page_id", payload: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """key, digest, shard, offset, length, raw_length, encoding and the metadata columns, a row for each row of ``rows``.

    Equal payloads share a digest and a range. A null payload has null in all
    other columns; an empty one has length of an empty stream and type
    application/x-empty; a null key is kept. Text columns are stored as UTF-8.
    Repeated rows share a range each; of several, the one of least key (a null least) is stored.
    A long payload is one range. An empty table gives no rows and no shard.
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    folder = re.sub("^file:/+", "file:///", folder)
    body = F.col(payload) if dict(rows.dtypes)[payload] == "binary" else F.encode(F.col(payload), "UTF-8")
    held = rows.select(F.col(key).cast("long").alias("key"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = materialise(held.select("key", "digest"), "digests")
    none = F.lit(-(1 << 63))
    repeated = slim.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min(F.coalesce("key", none)).alias("holder")).where("n > 1").select("digest", "holder")
    repeated = materialise(repeated, "repeated")
    index = store(held.join(small(repeated, repeated.count()), "digest", "left").select(F.coalesce("key", none).alias("key"), "payload", "digest", "holder"), folder, shard_bytes)
    ranges = materialise(index, "ranges")
    described = materialise(describe(ranges), "described")
    discard(ranges, repeated)
    return slim.join(described, "digest", "left").select(F.col("key").alias(key), *(c for c in described.columns))


def fetch(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """key and payload of rows that ``media_columns`` returned; fails if a payload doesn't have its digest."""

    def load(batches):
        path, file = None, None
        for pdf in batches:
            out = []
            for shard, offset, length, encoding, digest in zip(pdf["shard"], pdf["offset"], pdf["length"], pdf["encoding"], pdf["digest"]):
                if shard is None:
                    out.append(None)
                    continue
                if shard != path:
                    path, file = shard, _open(shard, "r")
                data = _read(file, int(offset), int(length), encoding)
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{shard}: the payload at {offset} is not {digest}")
                out.append(data)
            yield pd.DataFrame({key: pdf[key], "payload": pd.Series(out, dtype=object)})

    return rows.select(key, "digest", "shard", "offset", "length", "encoding").mapInPandas(load, f"{key} long, payload binary")
