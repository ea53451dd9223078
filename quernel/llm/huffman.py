"""Token-ID output: canonical length-limited Huffman coding of ids from global counts.

Code lengths come from the package-merge algorithm over the corpus-wide counts,
so they are optimal under the limit; codes are canonical, so the lengths alone
are the code book. Documents are coded in blocks of ``BLOCK`` ids that start on
a byte; every ``EVERY`` ids a block notes its bit offset, so a reader can begin
at any note. Decoding looks ``max_len`` bits up in a table and advances all
notes of a block together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialise, slices

BLOCK, EVERY, MAX_LEN = 4096, 256, 20
SCHEMA = "doc_id long, block_no int, n_tokens int, n_bits long, payload binary, checkpoints array<int>"


def code_lengths(counts: np.ndarray, max_len: int = MAX_LEN) -> np.ndarray:
    """Lengths by package-merge; 0 for ids that don't occur. Ties go by id, so equal counts always give the same code."""
    counts = np.asarray(counts, dtype=np.int64)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_len:
        raise ValueError(f"{len(used)} ids need codes of more than {max_len} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64) if counts.sum() >= 1 << 58 else counts[order]
    merged, kinds = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(max_len - 1):
        half = len(merged) // 2
        both = np.concatenate([leaves, merged[0 : 2 * half : 2] + merged[1 : 2 * half : 2]])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        kinds.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(kinds):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code, last = 0, 0
    firsts = np.bincount(lengths[used], minlength=int(lengths.max(initial=0)) + 1)
    at = 0
    for length in range(1, len(firsts)):
        code <<= length - last
        last = length
        n = int(firsts[length])
        codes[order[at : at + n]] = code + np.arange(n, dtype=np.uint64)
        code += n
        at += n
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every ``max_len`` bits ahead: the id they begin with, and its length."""
    top = int(lengths.max(initial=1))
    symbols, steps = np.zeros(1 << top, dtype=np.uint32), np.zeros(1 << top, dtype=np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = (1 << (top - lengths[order].astype(np.int64))).astype(np.int64)
    n = int(spans.sum())
    symbols[:n], steps[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbols, steps, top


def pack_bits(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code ``ids``, beginning a byte at each of ``starts`` (sorted, from 0).

    Returns the bytes, each block's first byte, its bits, and each id's bit offset in its block.
    """
    n_bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(n_bits)
    before = ends - n_bits
    bounds = np.append(starts, len(ids))
    total = np.append(before, ends[-1] if len(ids) else 0)
    bits = total[bounds[1:]] - total[bounds[:-1]]
    size = (bits + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(starts)), np.diff(bounds))
    inside = before - total[bounds[:-1]][of]
    at = first[:-1][of] * 8 + inside
    words = np.zeros(int(first[-1]) // 8 + 2, dtype=np.uint64)
    if len(ids):
        w, end = at >> 6, (at & 63) + n_bits
        c, fits = codes[ids], end <= 64
        put = np.where(fits, c << np.where(fits, 64 - end, 0).astype(np.uint64), c >> np.where(fits, 0, end - 64).astype(np.uint64))
        new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        words[w[new]] = np.add.reduceat(put, new)
        over = np.flatnonzero(~fits)
        words[w[over] + 1] |= c[over] << (128 - end[over]).astype(np.uint64)
    return np.frombuffer(words.astype(">u8").tobytes(), dtype=np.uint8)[: int(first[-1])], first, bits, inside


def unpack(payload: bytes, n_tokens: int, checkpoints, table, every: int = EVERY) -> np.ndarray:
    """Ids of a block; all stretches between notes advance together."""
    symbols, steps, top = table
    if not n_tokens:
        return np.zeros(0, dtype=np.uint32)
    data = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
    pos = np.asarray(checkpoints, dtype=np.int64)
    out = np.zeros((len(pos), every), dtype=np.uint32)
    shift, mask = np.uint64(64 - top), np.uint64((1 << top) - 1)
    last = len(data) - 8
    for k in range(min(every, n_tokens)):
        byte = np.minimum(pos >> 3, last)
        ahead = np.zeros(len(pos), dtype=np.uint64)
        for j in range(5):
            ahead = (ahead << np.uint64(8)) | data[byte + j]
        look = (ahead << np.uint64(24) << (pos & 7).astype(np.uint64)) >> shift & mask
        out[:, k] = symbols[look]
        pos = pos + steps[look]
    return out.reshape(-1)[:n_tokens]


def unpack_range(payload: bytes, n_tokens: int, checkpoints, table, start: int, stop: int, every: int = EVERY) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, read from the note before ``start`` on."""
    stop = min(stop, n_tokens)
    if start >= stop:
        return np.zeros(0, dtype=np.uint32)
    first = start // every
    marks = list(checkpoints)[first : (stop - 1) // every + 1]
    return unpack(payload, min(n_tokens - first * every, len(marks) * every), marks, table, every)[start - first * every : stop - first * every]


def global_counts(ids: DataFrame, column: str, size: int, width: int) -> np.ndarray:
    """Occurrences of every id over all rows; one row for each id and task is shuffled, so the vocabulary bounds it."""

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in (part for whole in batches for part in slices(whole, column)):
            values = b.column(column)
            ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
            data = values.buffers()[2]
            if data is not None and ends[-1] > ends[0]:
                total += np.bincount(np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(f"<u{width}"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = ids.select(column).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, dtype=np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts


def encode(docs: DataFrame, vocab: str = tokens.VOCAB, max_len: int = MAX_LEN, block: int = BLOCK, every: int = EVERY) -> DataFrame:
    """Huffman-coded blocks of the ids of ``docs`` (doc_id, text), and the code book.

    Rows: doc_id, block_no from 0, n_tokens, n_bits, payload, checkpoints (bit
    offset of every ``every``-th id). The one row with a null doc_id and block_no
    -1 is the code book: its payload has each id's code length in a byte.

    A null text gives one block with null payload, an empty one a block of 0
    ids; rows with a null doc_id are coded under it (block_no from 0). Repeated
    doc_ids give the blocks of each row; every block decodes on its own. An
    empty table gives a code book of zeros. Other columns are not read.
    """
    spark = docs.sparkSession
    enc = tokens.encoder(vocab)
    ids = materialise(tokens.with_ids(docs.select("doc_id", "text"), "text", vocab), "ids")
    width, size = enc.width, enc.size
    lengths = code_lengths(global_counts(ids, "ids", size, width), max_len)
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches):
        book = shared.value
        codes = canonical(book)
        for b in (part for whole in batches for part in slices(whole, "ids", 1 << 20)):
            column = b.column("ids")
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // width
            data = column.buffers()[2]
            raw = np.frombuffer(data if data is not None else b"", dtype=np.uint8)[offsets[0] * width : offsets[-1] * width].view(f"<u{width}")
            n = np.diff(offsets)
            blocks = np.maximum(1, -(-n // block))
            doc = np.repeat(np.arange(len(n)), blocks)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = (offsets[:-1] - offsets[0])[doc] + number * block
            size_of = np.minimum(n[doc] - number * block, block)
            valid = ~column.is_null().to_numpy(zero_copy_only=False)
            full = np.flatnonzero(size_of > 0)
            packed, first, bits, inside = pack_bits(raw, starts[full], book, codes)
            n_bits = np.zeros(len(doc), dtype=np.int64)
            n_bits[full] = bits
            ends = np.zeros(len(doc) + 1, dtype=np.int32)
            ends[full + 1] = np.diff(first)
            ends = np.cumsum(ends, dtype=np.int32)
            notes = -(-size_of // every)
            note_doc = np.repeat(np.arange(len(doc)), notes)
            note_at = starts[note_doc] + (np.arange(len(note_doc)) - np.repeat(np.cumsum(notes) - notes, notes)) * every
            mask = np.packbits(valid[doc], bitorder="little").tobytes()
            payload = pa.Array.from_buffers(pa.binary(), len(doc), [pa.py_buffer(mask), pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(doc)),
                    pa.array(number, pa.int32()),
                    pa.array(size_of, pa.int32()),
                    pa.array(n_bits, pa.int64()),
                    payload,
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(notes)]), pa.int32()), pa.array(inside[note_at], pa.int32())),
                ],
                names=["doc_id", "block_no", "n_tokens", "n_bits", "payload", "checkpoints"],
            )

    coded = ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, SCHEMA)
    book = spark.createDataFrame([(None, -1, int((lengths > 0).sum()), 8 * size, bytearray(lengths.tobytes()), [])], SCHEMA)
    return coded.unionByName(book)


def decode(coded: DataFrame, every: int = EVERY) -> DataFrame:
    """doc_id, block_no, ids of every block that ``encode`` wrote; null where the text was null."""
    book = coded.where("block_no = -1 and doc_id is null").select("payload").first()
    lengths = np.frombuffer(bytes(book[0]), dtype=np.uint8)
    shared = coded.sparkSession.sparkContext.broadcast(lengths)

    def run(batches):
        table = decode_table(shared.value)
        for b in batches:
            out = [
                None if p is None else unpack(p, n, c, table, every).astype(np.int64)
                for p, n, c in zip(*(b.column(x).to_pylist() for x in ("payload", "n_tokens", "checkpoints")))
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("block_no"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "block_no", "ids"])

    return coded.where("block_no >= 0").mapInArrow(run, "doc_id long, block_no int, ids array<int>")
