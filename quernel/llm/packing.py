"""Packing: concatenate all documents in one order and cut the stream into fixed windows.

Pass one: texts go by ranges of the order key, a range a task, and are tokenised
in order there. A task's stream is written as blocks of ``BLOCK`` windows' ids, each with
its place in the task's stream and the documents in it. The tasks' totals, a
number each, are summed to global offsets. Pass two needs no shuffle: every block
is cut on its own and yields the windows that lie wholly inside. What is before the
first and after the last of those are boundary records, which only a block's
first and last ids make, and which are put together by window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bounded, materialise, pieces, slices

LENGTH, BLOCK, PART_BYTES = 2048, 64, 32 << 20
SEGMENT = "struct<doc_id:long,doc_start:int,win_start:int,length:int>"
SCHEMA = f"window_id long, n_tokens int, tokens array<int>, segments array<{SEGMENT}>"
STREAM = "bucket int, begin long, n int, head binary, body binary, tail binary, doc_ids array<long>, doc_starts array<int>, sizes array<int>"
PIECE = f"window_id long, win_start int, tokens array<int>, segments array<{SEGMENT}>"


def _cut(doc_ids: pa.Array, starts: np.ndarray, stream: np.ndarray, begin: int, doc_starts: np.ndarray, first: int, last: int, length: int) -> pa.RecordBatch:
    """Windows ``first`` to ``last`` of ``stream``, whose first id is at ``begin``.

    ``starts``: where each document begins in the stream (global); ``doc_starts``: which of its ids that is.
    """
    lo, hi = first * length, last * length
    ids = stream[lo - begin : hi - begin].astype(np.int32)
    n = last - first
    cuts = np.unique(np.concatenate([starts[(starts > lo) & (starts < hi)], np.arange(first, last) * length]))
    of = np.searchsorted(starts, cuts, side="right") - 1
    window = cuts // length - first
    sizes = np.diff(np.append(cuts, hi))
    segments = pa.StructArray.from_arrays(
        [doc_ids.take(pa.array(of)), pa.array(cuts - starts[of] + doc_starts[of], pa.int32()), pa.array(cuts % length, pa.int32()), pa.array(sizes, pa.int32())],
        names=["doc_id", "doc_start", "win_start", "length"],
    )
    bounds = np.searchsorted(window, np.arange(n + 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(first, last), pa.int64()),
            pa.array(np.full(n, length), pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * length, pa.int32()), pa.array(ids)),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), segments),
        ],
        names=["window_id", "n_tokens", "tokens", "segments"],
    )


def _blocks(batches, enc: tokens.Encoder, bucket: int, size: int, edge: int):
    """One task's documents in order (doc_id, text) as blocks of ``size`` ids; the first and last ``edge`` ids of a block are columns of their own."""
    mark = np.array([enc.end], dtype=f"<u{enc.width}").tobytes()
    held, ids, starts, sizes, n, begin = [], [], [], [], 0, 0  # of the block that is being filled

    def block():
        raw, w = b"".join(held), enc.width
        first = min(n, edge) * w
        last = max(first, len(raw) - edge * w)
        fields = (bucket, begin, n, raw[:first], raw[first:last], raw[last:], ids, starts, sizes)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(fields, kinds)], names=[f.split()[0] for f in STREAM.split(", ")])

    for b in (part for whole in batches for part in slices(whole, "text")):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            packed = enc.pack(text) + mark
            at, total = 0, len(packed) // enc.width
            while at < total:
                take = min(total - at, size - n)
                held.append(packed[at * enc.width : (at + take) * enc.width])
                ids.append(doc_id)
                starts.append(at)
                sizes.append(take)
                at, n = at + take, n + take
                if n == size:
                    yield block()
                    begin += n
                    held, ids, starts, sizes, n = [], [], [], [], 0
    if n:
        yield block()


def _rows(batches):
    """Of each block: bucket, begin, n, its head, body and tail, and doc_ids, doc_starts and sizes as arrays."""
    for b in batches:
        lists = [b.column(c) for c in ("doc_ids", "doc_starts", "sizes")]
        for i, (bucket, begin, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("bucket", "begin", "n")))):
            parts = [b.column(c)[i].as_buffer() if c in b.schema.names else b"" for c in ("head", "body", "tail")]
            ids, starts, sizes = (x[i].values for x in lists)
            yield bucket, begin, n, parts, ids, starts.to_numpy().astype(np.int64), sizes.to_numpy().astype(np.int64)


def pack(docs: DataFrame, length: int = LENGTH, vocab: str = tokens.VOCAB, order: tuple = (), part_bytes: int = PART_BYTES, block: int = BLOCK) -> DataFrame:
    """Windows of ``length`` ids over all documents in order of ``order`` (column expressions; by default doc_id), each document followed by an end mark.

    Rows: window_id from 0, n_tokens, tokens, and segments (doc_id, doc_start:
    the document's first id here, win_start, length) in order. All windows are
    full but the last. A null text adds nothing, an empty one its end mark. A
    null key comes first; rows of one key follow in order of a hash of their texts, so
    repeated rows stand side by side, and however many they are they go to
    several tasks. A text longer than a block is cut into several blocks. No
    text at all gives no row. Other columns are not read. The driver and each task hold one number for each
    ``part_bytes`` of text.
    """
    spark = docs.sparkSession
    bounded(spark)
    enc = tokens.encoder(vocab)
    width = enc.width
    by = list(order) or [F.col("doc_id").cast("long")]
    names = [f"key_{i}" for i in range(len(by))]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(n) for c, n in zip(by, names))).where("text is not null")
    total = keyed.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = pieces(total, part_bytes, 1)
    key = [*names, "h", "row"]
    placed = keyed.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    if parts > 1:
        placed = placed.repartitionByRange(parts, *key)
    else:
        placed = placed.coalesce(1)
    placed = placed.sortWithinPartitions(*key).select("doc_id", "text")
    stream = materialise(placed.mapInArrow(lambda bs: _blocks(bs, tokens.encoder(vocab), TaskContext.get().partitionId(), block * length, length - 1), STREAM), "stream")

    sums = stream.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(parts, dtype=np.int64)
    totals[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    base = spark.sparkContext.broadcast(np.cumsum(totals) - totals)

    def whole(batches):
        for bucket, begin, n, parts, ids, starts, sizes in _rows(batches):
            at = int(base.value[bucket]) + begin
            first, last = -(-at // length), (at + n) // length
            if last > first:
                yield _cut(ids, at + np.cumsum(sizes) - sizes, np.frombuffer(b"".join(parts), dtype=f"<u{width}"), at, starts, first, last, length)

    def records(batches):
        for bucket, begin, n, parts, ids, starts, sizes in _rows(batches):
            at = int(base.value[bucket]) + begin
            first, last = -(-at // length), (at + n) // length
            spans = [(at, at + n)] if first > last else [(at, first * length), (last * length, at + n)]
            begins = at + np.cumsum(sizes) - sizes
            head, tail = (np.frombuffer(p, dtype=f"<u{width}").astype(np.int32) for p in (parts[0], parts[2]))
            short = len(head) + len(tail) == n
            for lo, hi in spans:
                if lo == hi:
                    continue
                if short:
                    piece = np.concatenate([head, tail])[lo - at : hi - at]
                else:
                    piece = head[: hi - at] if lo == at else tail[len(tail) - (hi - lo) :]
                inside = np.flatnonzero((begins < hi) & (begins + sizes > lo))
                a, z = np.maximum(begins[inside], lo), np.minimum(begins[inside] + sizes[inside], hi)
                segments = pa.StructArray.from_arrays(
                    [ids.take(pa.array(inside)), pa.array(starts[inside] + a - begins[inside], pa.int32()), pa.array(a % length, pa.int32()), pa.array(z - a, pa.int32())],
                    names=["doc_id", "doc_start", "win_start", "length"],
                )
                one = lambda values, k: pa.ListArray.from_arrays(pa.array([0, k], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lo // length], pa.int64()), pa.array([lo % length], pa.int32()), one(pa.array(piece), len(piece)), one(segments, len(inside))],
                    names=["window_id", "win_start", "tokens", "segments"],
                )

    inside = stream.mapInArrow(whole, SCHEMA)
    cut = stream.drop("body").mapInArrow(records, PIECE)
    pieces_of = F.array_sort(F.collect_list(F.struct("win_start", "tokens", "segments")))
    # A document that a block's end cuts inside a window is one segment again.
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, s: F.struct(last(acc)["doc_id"].alias("doc_id"), last(acc)["doc_start"].alias("doc_start"), last(acc)["win_start"].alias("win_start"), (last(acc)["length"] + s["length"]).alias("length"))
    joined = F.aggregate(
        F.flatten(F.transform("parts", lambda p: p["segments"])), F.array().cast(f"array<{SEGMENT}>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["doc_start"] > 0), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer(acc, s)))).otherwise(F.concat(acc, F.array(s))),
    )
    across = cut.groupBy("window_id").agg(pieces_of.alias("parts")).select(
        "window_id",
        F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["tokens"])).alias("n_tokens"),
        F.flatten(F.transform("parts", lambda p: p["tokens"])).alias("tokens"),
        joined.alias("segments"),
    )
    return inside.unionByName(across)
