"""Embedding near-dedup by sorted projection passes.

A pass projects every vector on 64 random directions and orders all vectors by
the concatenated signs; near vectors share long prefixes, so they lie close.
Each vector is compared with its next ``WINDOW`` neighbours, also across
partition bounds, and with every earlier one that shares its first bits, however
many they are, so neighbours below the threshold don't crowd near ones out. How
many bits follows from the number of vectors, and how many passes from the bits
(see ``plan``). Pairs of at least the threshold cosine are united over
all passes. Equal vectors are united first and sorted once, so runs of copies
never fill a window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, pieces
from .components import components

THRESHOLD, PASSES, WINDOW, PER_PARTITION, SEED = 0.95, 12, 32, 100_000, 20240311
RECALL, PER_RUN = 0.95, 256  # of pairs at the threshold; vectors that share their first bits, if they lie evenly
_ROW = "kind int, part int, pass int, dim int, key long, id long, v binary, other long, cosine double"


def plan(rows: int, threshold: float = THRESHOLD, passes: int = PASSES) -> tuple[int, int]:
    """First bits that rows compared with each other share, and passes (``passes`` at least).

    A pair at the threshold shares a bit with probability 1 - acos(threshold) / pi,
    so ``RECALL`` of such pairs share their first bits in one of the passes.
    """
    same = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    needed = lambda bits: math.ceil(math.log(1 - RECALL) / math.log(1 - same**bits)) if same < 1 else 1
    bits = max(1, math.ceil(math.log2(max(1, rows) / PER_RUN)))
    while bits < 63 and needed(bits + 1) <= passes:
        bits += 1
    return bits, max(passes, needed(bits))


def directions(number: int, dim: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, number, dim])).standard_normal((dim, 64)).astype(np.float32)


def keys(v: np.ndarray, number: int, seed: int) -> np.ndarray:
    """64 signs of random projections, the first highest, as order-preserving signed integers."""
    bits = np.packbits(v @ directions(number, v.shape[1], seed) >= 0, axis=1)
    return (bits.view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _unit(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id, v: unit vectors as packed float32; rows without a key, or whose vector is null, empty, zero or not finite, are left out."""

    def run(batches):
        for b in batches:
            sizes = np.where(b.column("id").is_valid().to_numpy(zero_copy_only=False), b.column("v").value_lengths().fill_null(0).to_numpy(), 0)
            for dim in np.unique(sizes[sizes > 0]):
                rows = b.take(pa.array(np.flatnonzero(sizes == dim)))
                raw = rows.column("v").flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy().reshape(-1, dim)
                norm = np.linalg.norm(raw, axis=1)
                good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
                unit = (raw[good] / norm[good, None]).astype("<f4")
                packed = pa.Array.from_buffers(pa.binary(4 * int(dim)), len(good), [None, pa.py_buffer(unit.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(good)), packed], names=["id", "v"])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).mapInArrow(run, "id long, v binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return data[ends[0] : ends[-1]].view("<f4").reshape(-1, dim)


def _near(v: np.ndarray, ids: np.ndarray, window: int, threshold: float, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs among neighbours of which the later is at or after row ``new``."""
    a, b, c = [], [], []
    for k in range(1, min(window, len(ids) - 1) + 1):
        lo = max(new, k)
        cos = np.einsum("ij,ij->i", v[lo:].astype(np.float64), v[lo - k : len(v) - k].astype(np.float64))
        hit = np.flatnonzero(cos >= threshold)
        a.append(ids[lo - k + hit])
        b.append(ids[lo + hit])
        c.append(cos[hit])
    none = np.zeros(0)
    return np.concatenate([*a, none]).astype(np.int64), np.concatenate([*b, none]).astype(np.int64), np.concatenate([*c, none])


def _runs(v: np.ndarray, ids: np.ndarray, run: np.ndarray, window: int, threshold: float, new: int, label: np.ndarray, rows: int = 256, columns: int = 16_384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs further apart than the window of which the later is at or after row ``new``, with equal ``run``; only as many as connect what all such pairs do, which ``label`` (changed here) tells."""
    start, out = np.searchsorted(run, run), []
    far = new + np.flatnonzero(start[new:] < np.arange(new, len(ids)) - window)
    for k in range(0, len(far), rows):
        later = far[k : k + rows]
        for lo in range(int(start[later[0]]), int(later[-1]) - window, columns):
            hi = min(lo + columns, int(later[-1]) - window)
            i, j = np.nonzero(v[later] @ v[lo:hi].T >= threshold - 1e-5)
            i, j = later[i], j + lo
            fits = (j >= start[i]) & (j < i - window)
            i, j = i[fits], j[fits]
            while len(i):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                _, one = np.unique(i, return_index=True)
                cos = np.einsum("ij,ij->i", v[i[one]].astype(np.float64), v[j[one]].astype(np.float64))
                for a, b, c in zip(i[one].tolist(), j[one].tolist(), cos.tolist()):
                    if c >= threshold and label[a] != label[b]:
                        out.append((ids[b], ids[a], c))
                        label[label == label[a]] = label[b]
                left = np.ones(len(i), dtype=bool)
                left[one] = False
                i, j = i[left], j[left]
    a, b, c = zip(*out) if out else ((), (), ())
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(c, dtype=np.float64)


def similar(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, per_partition: int = PER_PARTITION, seed: int = SEED) -> DataFrame:
    """Edges a, b: equal vectors (to the least key among them) and verified pairs of all passes."""
    unit = materialise(_unit(vectors, key, column), "unit")
    once = unit.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    once = materialise(once, "once")
    n_once = once.count()
    bits, passes = plan(n_once, threshold, passes)
    equal = unit.withColumnRenamed("id", "b").join(once.where("n > 1").select("v", F.col("id").alias("a")), "v").where("a != b").select("a", "b")

    def project(batches):
        for b in batches:
            sizes = pa.compute.binary_length(b.column("v")).to_numpy() // 4
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                rows = b.take(pa.array(at))
                v = _matrix(rows.column("v"), int(dim))
                for p in range(passes):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p), pa.int32()), pa.array(np.full(n, dim), pa.int32()), pa.array(keys(v, p, seed)), rows.column("id"), rows.column("v")],
                        names=["pass", "dim", "key", "id", "v"],
                    )

    def compare(batches, part=None, edges=True):
        """Windows over sorted rows; keeps the first and last rows of the partition for the windows across its bounds."""
        part = TaskContext.get().partitionId() if part is None else part
        held, head, seen, label = None, [], 0, np.zeros(0, dtype=np.int64)
        for b in batches:
            change = np.flatnonzero((np.diff(b.column("pass").to_numpy()) != 0) | (np.diff(b.column("dim").to_numpy()) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, b.num_rows]):
                rows = b.slice(lo, hi - lo)
                if not rows.num_rows:
                    continue
                if seen < window:
                    head.append(rows.slice(0, window - seen))
                seen += rows.num_rows
                same = held is not None and held.column("pass")[0] == rows.column("pass")[0] and held.column("dim")[0] == rows.column("dim")[0]
                both = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0] if same else rows
                v, ids, run, new = _matrix(both.column("v"), both.column("dim")[0].as_py()), both.column("id").to_numpy(), both.column("key").to_numpy() >> (64 - bits), held.num_rows if same else 0
                label = np.concatenate([label[:new], len(ids) + np.arange(new, len(ids))])
                x, y, c = (np.concatenate(p) for p in zip(_near(v, ids, window, threshold, new), _runs(v, ids, run, window, threshold, new, label)))
                n = len(x)
                if n:
                    none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n), pa.int32()), *none, pa.array(x), pa.nulls(n, pa.binary()), pa.array(y), pa.array(c)], names=[f.split()[0] for f in _ROW.split(", ")])
                keep = max(0, min(both.num_rows - window, int(np.searchsorted(run, run[-1]))))
                held, label = both.slice(keep), np.unique(label[keep:], return_inverse=True)[1]
        if not edges or held is None:
            return
        for kind, rows in [(1, r) for r in head] + [(2, held.slice(max(0, held.num_rows - window)))]:
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, part - (kind == 1)), pa.int32()), *(rows.column(c) for c in ("pass", "dim", "key", "id", "v")), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())],
                names=[f.split()[0] for f in _ROW.split(", ")],
            )

    parts = pieces(n_once * passes, per_partition)
    lined = once.select("id", "v").mapInArrow(project, "pass int, dim int, key long, id long, v binary")
    lined = lined.repartitionByRange(parts, "pass", "dim", F.shiftright("key", 64 - bits)).sortWithinPartitions("pass", "dim", "key", "id")
    found = materialise(lined.mapInArrow(compare, _ROW), "neighbours")

    def across(pdf):
        import pandas as pd

        rows = pdf.sort_values(["pass", "dim", "key", "id"], kind="stable")
        batch = pa.RecordBatch.from_pandas(rows[["pass", "dim", "key", "id", "v"]], schema=pa.schema([("pass", pa.int32()), ("dim", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("v", pa.binary())]), preserve_index=False)
        out = [(r.column("id").to_pylist(), r.column("other").to_pylist()) for r in compare([batch], 0, False)]
        return pd.DataFrame({"a": [i for x, _ in out for i in x], "b": [i for _, x in out for i in x]}, dtype="int64")

    bounds = found.where("kind > 0").select("part", "pass", "dim", "key", "id", "v")
    over = bounds.groupBy("part").applyInPandas(across, "a long, b long")
    edges = equal.unionByName(found.where("kind = 0").select(F.col("id").alias("a"), F.col("other").alias("b"))).unionByName(over)
    edges = materialise(edges, "near")
    discard(unit, once, found)
    return edges


def near_duplicates(vectors: DataFrame, key: str = "vec_id", **options) -> DataFrame:
    """vec_id, keep_id: every vector that has near duplicates, and the least vector of its group, which stays.

    Groups are connected components of pairs with a cosine of at least the
    threshold. Vectors without a key, and null, empty, zero or non-finite ones, are
    in no group; vectors of other lengths are never near. Repeated keys count
    once. No rows come of an empty table.
    """
    roots = components(similar(vectors, key, **options))
    return roots.select(F.col("node").alias(key), F.col("root").alias("keep_id"))


#: DuckDB twin: all pairs.
SQL = r"""
WITH RECURSIVE unit AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) >= {t}),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT node AS vec_id, min(other) AS keep_id FROM reach GROUP BY node HAVING min(other) < node
""".replace("{t}", str(THRESHOLD))
