"""What surrounds a search: embedding generators, caches as tables, batches, request logs (C-01 ... C-07, E-01 ... E-07, V-21, Z-01, Z-06 ... Z-09, Z-14 ... Z-16, A-17 ... A-29, U-04)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import search

#: E-01: model name -> function from a series of texts to lists of numbers.
GENERATORS: dict[str, Callable[[pd.Series], list[list[float]]]] = {}
#: E-03: name -> function from a DataFrame to a boolean Column; E-04: name -> Column of a feature.
FILTERS: dict[str, Callable[[DataFrame], Column]] = {}
FEATURES: dict[str, Callable[[DataFrame], Column]] = {}


def add_generator(model: str, generate: Callable[[pd.Series], list[list[float]]]) -> None:
    """E-01, V-21."""
    GENERATORS[model] = generate


def text_id(text: Column) -> Column:
    """X-55, Z-16: the key of a text or query: MD5 of it, trimmed and in lower case."""
    return F.md5(F.lower(F.trim(text)))


def embed(rows: DataFrame, model: str, body: str = "text") -> DataFrame:
    """V-21: rows and their embedding; blank texts are left out."""
    generate = GENERATORS[model]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(generate(texts), index=texts.index)

    kept = rows.where(F.trim(F.coalesce(F.col(body), F.lit(""))) != "")
    return kept.withColumn("embedding", run(F.col(body))).withColumn("embedding_model", F.lit(model))


def embed_cached(rows: DataFrame, cache: DataFrame, model: str, body: str = "text") -> tuple[DataFrame, DataFrame]:
    """C-03: rows with embeddings, and what is new for the cache (text_key, embedding_model, embedding).

    Each distinct text that the cache lacks is embedded once.
    """
    keyed = rows.withColumn("text_key", text_id(F.col(body)))
    known = cache.where(F.col("embedding_model") == model).select("text_key", "embedding")
    misses = keyed.join(known.select("text_key"), "text_key", "left_anti").groupBy("text_key").agg(F.min(body).alias(body))
    fresh = embed(misses, model, body).select("text_key", "embedding_model", "embedding")
    every = known.unionByName(fresh.select("text_key", "embedding"))
    return keyed.join(every, "text_key").drop("text_key"), fresh


def search_by_text(text: str, model: str, vectors: DataFrame, k: int = 10, least: float = 0.5, **names) -> DataFrame:
    """Z-01: the query embedded by ``model`` against that model's vectors."""
    spark = vectors.sparkSession
    query = embed(spark.createDataFrame([(0, text)], "query_id long, text string"), model).select("query_id", "embedding")
    return search.knn(query, vectors.where(F.col("embedding_model") == model), k, least=least, **names)


def live_cache(cache: DataFrame, now: Column, ttl_seconds: int, most: int = 1000) -> DataFrame:
    """C-01, C-04: entries not older than the lifetime, of those the ``most`` latest used."""
    fresh = cache.where(F.col("stored_at") >= now - F.make_interval(secs=F.lit(ttl_seconds)))
    return fresh.orderBy(F.col("used_at").desc(), "key").limit(most)


def process_batch(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """E-05: ``f`` over Arrow batches. Where it raises it is called for each row of the batch, and only rows on which it raises alone give none, whatever the batches' size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield f(pdf)
            except Exception:  # noqa: BLE001 - some row of the batch
                for i in range(len(pdf)):
                    try:
                        yield f(pdf.iloc[i : i + 1])
                    except Exception:  # noqa: BLE001 - this row has no result
                        continue

    return rows.mapInPandas(run, schema)


def retry(f: Callable[[], object], times: int = 3, first: float = 1.0, wait: Callable[[float], None] = time.sleep) -> object:
    """C-07: call again after 1, 2, 4 ... times ``first`` seconds; the last error is raised."""
    for k in range(times):
        try:
            return f()
        except Exception:  # noqa: BLE001
            if k + 1 == times:
                raise
            wait(first * 2**k)
    return None


def result_id(chunk_id: Column, other: Column, row: Column) -> Column:
    """Z-08: chunk id, else id, else a hash of the row."""
    return F.coalesce(chunk_id.cast("string"), other.cast("string"), F.xxhash64(row).cast("string"))


def request_history(log: DataFrame, at: str = "at", requests: int = 100, per: list[str] | None = None) -> DataFrame:
    """Z-14: the last ``requests`` rows, of each group if ``per`` is given."""
    if per:
        w = Window.partitionBy(*per).orderBy(F.col(at).desc())
        return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= requests).drop("__n")
    return log.orderBy(F.col(at).desc()).limit(requests)


def id_sets(found: DataFrame, truth: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """A-27: precision, recall and F1 of each query's ids; 0 where not defined."""
    both = found.select(query, key).distinct().withColumn("f", F.lit(1)).join(truth.select(query, key).distinct().withColumn("t", F.lit(1)), [query, key], "full")
    n = both.groupBy(query).agg(F.sum(F.col("f") * F.col("t")).alias("hit"), F.sum("f").alias("f"), F.sum("t").alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hit = F.coalesce("hit", F.lit(0))
    return n.select(query, zero(F.try_divide(hit, F.col("f"))).alias("precision"), zero(F.try_divide(hit, F.col("t"))).alias("recall"), zero(F.try_divide(2 * hit, F.coalesce("f", F.lit(0)) + F.coalesce("t", F.lit(0)))).alias("f1"))


def facets(rows: DataFrame, *names: str) -> DataFrame:
    """A-28: facet, value, n for each distinct value of the named columns, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in names))).alias("p")
    return rows.select(pairs).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def head(values: Column, most: int) -> Column:
    """K-10."""
    return F.slice(values, 1, most)


def overlap(a: Column, b: Column) -> Column:
    """U-04: shared members over the smaller set; 0 if one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))), F.lit(0.0))


def by_start(found: Column) -> Column:
    """K-08: an array of structs whose first field is the start, in order of it."""
    return F.array_sort(found)


def timings(log: DataFrame) -> DataFrame:
    """A-29, A-18: searches, mean seconds and searches a second by phase."""
    return log.groupBy("phase").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_seconds"), F.try_divide(F.count("*"), F.sum("seconds")).alias("per_second"))


def features(docs: DataFrame, query: str, names: dict[str, Column] | None = None, body: str = "text") -> DataFrame:
    """Z-06: the ranking features of every row, registered ones included."""
    from . import rank

    t = F.col(body)
    built = {"lexical": rank.lexical_overlap(t, query), "term_frequency": rank.term_frequency(t, query), "length": T.length_score(t), "quality": T.content_quality(t), "entity": rank.entity_matching(t, query)}
    built |= names or {}
    built |= {n: f(docs) for n, f in FEATURES.items()}
    return docs.withColumns({f"feature_{n}": c for n, c in built.items()})
