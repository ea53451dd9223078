"""Vector search: candidate joins, exact and clustered top-k, several metrics (J-01 ... J-13, V-15 ... V-20, U-01, U-02, K-02 ... K-04)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from . import nearest

#: Query vectors are broadcast up to this many rows; beyond it the cross join is left to the optimizer.
MAX_BROADCAST_QUERIES = 20_000
#: Vectors in a block of ``knn``. Either side is cut into parts of about ``LEAST`` vectors, but ``PARTS`` of them are enough until they have ``MOST`` each.
BLOCK, PARTS, LEAST, MOST = 1024, 8, 12_288, 131_072


def prepare(vectors: DataFrame, column: str = "embedding", normalise: bool = True) -> DataFrame:
    v = V.double(F.col(column))
    return vectors.withColumn(column, V.normalise(v) if normalise else v)


def candidates(embeddings: DataFrame, chunks: DataFrame, documents: list | None = None, content_types: list | None = None, strategies: list | None = None, models: list | None = None) -> DataFrame:
    """J-01, J-02, F-04: embeddings with their chunks; an empty list is no filter. Filters reach the scans."""
    for name, values, side in (("model", models, "e"), ("document_id", documents, "c"), ("content_type", content_types, "c"), ("strategy", strategies, "c")):
        if values and side == "e":
            embeddings = embeddings.where(F.col(name).isin(*values))
        elif values:
            chunks = chunks.where(F.col(name).isin(*values))
    return embeddings.join(chunks, "chunk_id")


def scores(queries: DataFrame, vectors: DataFrame, metric: str = "cosine", query: str = "query_id", key: str = "vec_id", column: str = "embedding", n_queries: int | None = None) -> DataFrame:
    """J-05, J-06: every query against every vector: query, key, score, distance."""
    n = queries.limit(MAX_BROADCAST_QUERIES + 1).count() if n_queries is None else n_queries
    q = queries.select(query, F.col(column).alias("__q"))
    q = F.broadcast(q) if n <= MAX_BROADCAST_QUERIES else q
    score = V.similarity(metric, F.col(column), F.col("__q"))
    return vectors.select(key, column).crossJoin(q).select(query, key, score.alias("score")).withColumn("distance", V.as_distance(F.col("score")))


def top_k(scored: DataFrame, k: int, least: float = 0.0, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """K-02: per query the k best of at least ``least``; the rank filter becomes a group limit before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(key))
    return scored.where(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", least: float = 0.0, **names) -> DataFrame:
    """Exact nearest neighbours under one metric."""
    which = {n: names[n] for n in ("query", "key") if n in names}
    return top_k(scores(queries, vectors, metric, **names), k, least, **which)


def _blocks(vectors: DataFrame, key: str, column: str, metric: str, most: int | None = None) -> DataFrame:
    """dim, at, ids, v: packed keys and vectors of up to ``BLOCK`` rows of one dimension, with a running number; null and empty vectors are left out.

    ``most``: of equal vectors in a block, only so many of the lowest keys stay.
    """

    def run(batches):
        at = TaskContext.get().partitionId()
        for b in batches:
            sizes = b.column("v").value_lengths().fill_null(0).to_numpy()
            for dim in np.unique(sizes[sizes > 0]):
                rows = b.take(pa.array(np.flatnonzero(sizes == dim)))
                for start in range(0, rows.num_rows, BLOCK):
                    part = rows.slice(start, BLOCK)
                    values = nearest.prepared(metric, part.column("v").flatten().fill_null(0.0).to_numpy().astype("<f8").reshape(-1, dim))
                    ids = part.column("k").to_numpy().astype("<i8")
                    if most is not None:
                        kept = nearest.lowest(ids, values, most)
                        values, ids = values[kept], ids[kept]
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([at], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["dim", "at", "ids", "v"])
                    at += 1

    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), V.double(F.col(column)).alias("v"))
    return rows.mapInArrow(run, "dim int, at int, ids binary, v binary")


def _parts(rows: int) -> int:
    return max(1, -(-rows // MOST), min(PARTS, -(-rows // LEAST)))


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", least: float = 0.0, query: str = "query_id", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """J-05, K-02 for query tables of any size: query, key, score, rank of the k best of each query, ties by key.

    Both sides are packed into blocks and cut into parts, and each pair of parts is a cell: one task, which holds
    its queries and their k best while the blocks of the other part pass by (``nearest.Nearest``). So each side is shuffled
    once for each part of the other, and to the final ranking k rows for each query and part of the searched side.
    Scores are rounded to 9 digits before they are ranked.
    """
    n_queries, n_vectors = _parts(queries.count()), _parts(vectors.count())

    def best(batches):
        dim, asked, found = None, [], None

        def out():
            for i, j, s in found.found() if found else ():
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(s)], names=[query, key, "score"])

        for b in batches:
            for at in range(b.num_rows):
                size, searched = b.column("dim")[at].as_py(), b.column("searched")[at].as_py()
                ids = np.frombuffer(b.column("ids")[at].as_buffer(), "<i8").copy()
                v = np.frombuffer(b.column("v")[at].as_buffer(), "<f8").reshape(-1, size).copy()
                if size != dim:
                    yield from out()
                    dim, asked, found = size, [], None
                if not searched:
                    asked.append((ids, v))
                    continue
                if asked:
                    found, asked = nearest.Nearest(metric, k, least, *(np.concatenate(x) for x in zip(*asked))), []
                if found:
                    found.feed(ids, v)
        yield from out()

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = _blocks(queries, query, column, metric).select("dim", F.lit(0).alias("searched"), "ids", "v", F.pmod("at", F.lit(n_queries)).alias("i"), each(n_vectors).alias("j"))
    searched = _blocks(vectors, key, column, metric, k).select("dim", F.lit(1).alias("searched"), "ids", "v", each(n_queries).alias("i"), F.pmod("at", F.lit(n_vectors)).alias("j"))
    cells = asked.unionByName(searched).repartitionById(n_queries * n_vectors, F.col("i") * n_vectors + F.col("j"))
    scored = cells.sortWithinPartitions("dim", "searched").select("dim", "searched", "ids", "v").mapInArrow(best, f"{query} long, {key} long, score double")
    return top_k(scored, k, least, query, key)


def hybrid(queries: DataFrame, vectors: DataFrame, weights: dict[str, float], k: int = 10, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """V-16, A-15, K-04: the 2k best of each metric, weighted (weights summing to 1) and added; an absent metric adds 0."""
    scale = sum(weights.values()) or 1.0
    parts = None
    for metric, w in weights.items():
        one = knn(queries, vectors, 2 * k, metric, query=query, key=key).select(query, key, (F.col("score") * (w / scale)).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return top_k(parts.groupBy(query, key).agg(F.round(F.sum("part"), 9).alias("score")), k, query=query, key=key)


def adaptive(queries: DataFrame, vectors: DataFrame, metrics: tuple[str, ...] = ("cosine", "euclidean", "manhattan", "dot"), query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """V-17, A-14: metric, variance: population variances of the top 10 scores, summed over at most ten queries (lowest ids); largest first."""
    few = queries.orderBy(query).limit(10)
    out = None
    for m in metrics:
        one = knn(few, vectors, 10, m, query=query, key=key).groupBy(query).agg(F.var_pop("score").alias("v")).select(F.lit(m).alias("metric"), "v")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("metric").agg(F.sum("v").alias("variance")).orderBy(F.col("variance").desc(), "metric")


def compare(queries: DataFrame, vectors: DataFrame, metrics: tuple[str, ...] = ("cosine", "euclidean", "manhattan", "dot"), k: int = 10, **names) -> DataFrame:
    """V-18: the top k under each metric."""
    out = None
    for m in metrics:
        one = knn(queries, vectors, k, m, **names).withColumn("metric", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def ivf_index(vectors: DataFrame, n: int, column: str = "embedding", seed: int = 42):
    """J-12: k-means cells; min(100, floor(sqrt n)) of them. Returns the vectors with their cell, and the centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cells = max(2, min(100, int(n**0.5)))
    fed = vectors.withColumn("__features", array_to_vector(F.col(column)))
    model = KMeans(k=cells, seed=seed, featuresCol="__features", predictionCol="cell", maxIter=10).fit(fed)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    return model.transform(fed).drop("__features"), centres


def ivf_search(queries: DataFrame, indexed: DataFrame, centres: DataFrame, k: int = 10, probes: int = 10, metric: str = "cosine", query: str = "query_id", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The top k within the ``probes`` cells nearest to each query; vectors and queries meet in an equi-join on the cell."""
    q = queries.select(query, F.col(column).alias("__q"))
    near = Window.partitionBy(query).orderBy(V.distance(F.col("__q"), F.col("centre")), "cell")
    probed = q.crossJoin(F.broadcast(centres)).withColumn("__n", F.row_number().over(near)).where(F.col("__n") <= probes).select(query, "__q", "cell")
    scored = indexed.select(key, column, "cell").join(probed, "cell").select(query, key, V.similarity(metric, F.col(column), F.col("__q")).alias("score"))
    return top_k(scored, k, query=query, key=key)


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """U-01, U-02: one row a key, the first in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def vocabulary(texts: DataFrame, body: str = "text", most: int = 100) -> DataFrame:
    """A-16, K-09: pos, term, idf of the ``most`` frequent words; idf ln(N / (df + 1)) may be 0 or less."""
    words = texts.select(T.words(F.col(body)).alias("w"))
    counted = words.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    top = counted.orderBy(F.col("n").desc(), "term").limit(most).join(df, "term")
    pos = F.row_number().over(Window.orderBy(F.col("n").desc(), "term")) - 1
    return top.crossJoin(F.broadcast(texts.agg(F.count("*").alias("docs")))).select(pos.alias("pos"), "term", F.ln(F.col("docs") / (F.col("df") + 1)).alias("idf"))


def bag_embedding(texts: DataFrame, vocab: DataFrame, key: str, body: str = "text") -> DataFrame:
    """V-20: key, embedding: idf added for each occurrence of a vocabulary word, then unit length; zeros without any."""
    words = F.broadcast(vocab.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term", "idf"))), lambda s: s).alias("__v")))  # the vocabulary is bounded
    toks = T.words(F.col(body))
    raw = F.transform("__v", lambda s: F.size(F.filter("__t", lambda t: t == s["term"])) * s["idf"])
    return texts.select(key, toks.alias("__t")).crossJoin(words).select(key, V.normalise(raw).alias("embedding"))


def backfill(memories: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Z-04: embeddings for rows that lack one; existing ones are kept."""
    return memories.join(fresh.select(key, F.col("embedding").alias("__e")), key, "left").withColumn("embedding", F.coalesce("embedding", "__e")).drop("__e")


def integrated(found: DataFrame, body: str = "text", similarity: str = "score", days: Column | None = None) -> DataFrame:
    """Section 3.1's last steps, Z-10: similarity, relevance, ranking score, quality and rank of each found row."""
    rank = F.least(F.lit(1.0), F.col(similarity) * 0.6 + T.content_quality(F.col(body)) * 0.3 + (F.lit(0.0) if days is None else F.exp(days * -0.1 / 365)) * 0.1)
    return found.withColumn("quality", T.quality(F.col(body), newline_bonus=False)).withColumn("ranking_score", rank)
