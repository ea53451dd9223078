"""The search service: variants and models, over-fetch, filters, re-ranking (K-03, U-01, U-02, R-13, Z-07, Z-09, Z-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters as FL
from . import rank, search


def prefilter(node) -> dict:
    """Z-09: fields and values of plain metadata criteria, alone or in a list; groups and other kinds are ignored, they apply after the search."""
    plain = lambda c: isinstance(c, FL.Criterion) and c.kind == "metadata" and isinstance(c.field, str)
    return {c.field: c.value for c in (node if isinstance(node, list) else [node]) if plain(c)}


def ranking(algorithm: str, query: str, similarity: Column, hybrid: Column) -> Column:
    """R-13: the score that an algorithm ranks found rows by; names without a formula of their own (page rank, learned, neural) are hybrid.

    BM25 and TF-IDF need the corpus: rank by ``rank.bm25`` or ``rank.tfidf`` of the found rows and join their scores.
    """
    return similarity if algorithm.lower() in ("cosine", "cosine_similarity") else hybrid


def retrieve(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = 0.5, metric: str = "cosine", query: str = "query_id", key: str = "vec_id", model: str | None = None) -> DataFrame:
    """K-03, U-01, U-02: candidates of all variants (rows of ``queries``: query, variant, embedding and, if named, model).

    Each variant fetches 2 k at 0.8 of the threshold among vectors of its model; of a query's
    equal keys that of the first variant (and model) stays.
    """
    names = ["variant", model] if model else ["variant"]
    numbered = queries.select(query, *names, "embedding", F.xxhash64(query, *names).alias("__id"))
    asked = numbered.select("__id", "embedding", *([model] if model else []))
    if model:
        parts = [search.knn(asked.where(F.col(model) == m), vectors.where(F.col(model) == m), 2 * k, metric, 0.8 * least, "__id", key) for m in sorted(r[0] for r in queries.select(model).distinct().collect())]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    else:
        found = search.knn(asked, vectors, 2 * k, metric, 0.8 * least, "__id", key)
    joined = found.join(numbered.select("__id", query, *names), "__id").drop("__id", "rank")
    first = joined.groupBy(query, key).agg(F.min_by("score", F.struct(*names)).alias("score"))
    return first


def search_texts(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = 10, least: float = 0.5, node=None, algorithm: str = "hybrid", hybrid: Column | None = None, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """The whole search: plain metadata criteria reach the scan of ``chunks`` and so the searched vectors, the rest filters what is found; then the k best by ``ranking``.

    ``chunks``: key and whatever the filters and ``hybrid`` (default: the similarity) read.
    """
    wanted = prefilter(node)
    for name, value in wanted.items():
        chunks = chunks.where(FL.compile(FL.Criterion(name, "EQUALS", value), chunks))
    within = vectors.join(chunks.select(key), key, "left_semi") if wanted else vectors
    found = retrieve(queries, within, k, least, query=query, key=key).join(chunks, key).withColumn("similarity_score", F.col("score"))
    left = [node] if node is not None and not isinstance(node, list) else node or []
    for c in left:
        found = FL.apply(found, c)
    scored = found.withColumn("score", ranking(algorithm, "", F.col("similarity_score"), F.col("similarity_score") if hybrid is None else hybrid))
    return rank.top_k(scored, k, "score", key, [query])


def log_statistics(log: DataFrame) -> DataFrame:
    """Z-07: searches, cache hits and mean times of a log (cached, seconds, results)."""
    return log.agg(F.count("*").alias("searches"), F.count_if("cached").alias("cache_hits"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean_seconds"), F.coalesce(F.avg("results"), F.lit(0.0)).alias("mean_results"))
