"""Sharding by Karmarkar-Karp differencing: balanced bytes for groups that must not be split.

Each group starts as a partial partition (its bytes in one slot, nothing in the
others). The two partial partitions of largest spread are joined again and
again, the fullest slot of one onto the emptiest of the other, until one is
left: its slots are the shards. Groups are differenced inside hash buckets of
bounded size in parallel; what a bucket leaves is itself a partial partition of
small spread, and those are differenced in turn, level by level, by the same
rule. Only group keys and sizes move, never texts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, materialise, pieces, small

SHARDS, PER_BUCKET = 64, 20_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference the rows of ``sums`` (partial partitions, any slot order) down to one.

    Returns the slots' totals, fullest first, and for each row which final slot
    each of its slots went to. Ties go to the lower row.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    state = [[int(sums[i, j]) for j in order[i]] for i in range(n)]
    heap = [(state[i][-1] - state[i][0], i) for i in range(n)]
    heapq.heapify(heap)
    joins: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        new = [x + y for x, y in zip(state[a], reversed(state[b]))]
        at = sorted(range(k), key=new.__getitem__, reverse=True)
        state.append([new[j] for j in at])
        state[a] = state[b] = None  # type: ignore[call-overload]
        joins.append((a, b, at))
        me = len(state) - 1
        heapq.heappush(heap, (state[me][-1] - state[me][0], me))
    root = len(state) - 1
    final: list = [None] * len(state)
    final[root] = np.arange(k, dtype=np.int32)
    for me, (a, b, at) in zip(range(root, n - 1, -1), reversed(joins)):
        place = np.empty(k, dtype=np.int32)
        place[at] = final[me]
        final[a], final[b] = place, place[::-1]
        final[me] = None
    slots = np.empty((n, k), dtype=np.int32)
    for i in range(n):
        slots[i, order[i]] = final[i]
    return np.array(state[root], dtype=np.int64), slots


def assign(groups: DataFrame, shards: int = SHARDS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``groups`` (key binary, bytes long; keys distinct) with its shard: key, bytes, shard."""
    groups = checkpointed(groups.select("key", "bytes"))
    buckets = pieces(groups.count(), per_bucket)
    placed = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        sums = np.zeros((len(pdf), shards), dtype=np.int64)
        sums[:, 0] = pdf["bytes"]
        totals, slots = difference(sums)
        out = pd.DataFrame({"bucket": pdf["bucket"], "key": pdf["key"], "bytes": pdf["bytes"], "slot": slots[:, 0], "totals": None}).astype({"key": object})
        last = pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "key": [None], "bytes": [None], "slot": [-1], "totals": [totals]})
        return pd.concat([out.astype({"bytes": "Int64"}), last.astype({"bytes": "Int64"})])

    level = materialise(placed.groupBy("bucket").applyInPandas(first, "bucket int, key binary, bytes long, slot int, totals array<long>"), "slots")
    members = level.where("slot >= 0").select("bucket", "key", "bytes", "slot")
    left = level.where("slot < 0").select(F.col("bucket").alias("node"), "totals")
    n, fan = buckets, max(2, per_bucket // shards)
    where = None  # bucket, slots: the shard of each of its slots
    while True:
        up = pieces(n, fan)

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node", kind="stable")
            totals, slots = difference(np.stack(pdf["totals"].to_numpy()))
            return pd.DataFrame({"up": pdf["up"], "node": pdf["node"], "slots": list(slots), "totals": [totals, *[None] * (len(pdf) - 1)]})

        joined = left.withColumn("up", F.pmod(F.col("node"), F.lit(up)).cast("int"))
        joined = checkpointed(joined.groupBy("up").applyInPandas(join, "up int, node int, slots array<int>, totals array<long>"))
        step = joined.select("node", "up", "slots")
        if where is None:
            where = step.select(F.col("node").alias("bucket"), "up", "slots")
        else:
            below = where.select("bucket", F.col("up").alias("node"), F.col("slots").alias("inner"))
            where = below.join(small(step, n, wide=4 * shards), "node").select("bucket", "up", F.transform("inner", lambda s: F.get("slots", s)).alias("slots"))
        if up == 1:
            break
        left, n = joined.where("totals is not null").select(F.col("up").alias("node"), "totals"), up
    where = where.select("bucket", "slots")
    return members.join(small(where, buckets, wide=4 * shards), "bucket").select("key", "bytes", F.get("slots", F.col("slot")).alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """doc_id, bytes, shard: copies of one text stay in one shard, and shards hold nearly equal bytes.

    A group is all rows with one text (by digest); a group larger than an even
    share fills its shard alone. A null text counts 0 bytes, and all null texts are
    one group, all empty ones another. A null doc_id keeps its row; repeated
    rows are members of their group each. Of groups of equal bytes the one of lower digest is
    placed first. A text's length is only a number here. An empty table gives no rows. Other
    columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    rows = materialise(rows, "sizes")
    found = assign(rows.groupBy("key").agg(F.sum("bytes").alias("bytes")), shards, per_bucket)
    return rows.join(found.select("key", "shard"), "key").select("doc_id", "bytes", "shard")
