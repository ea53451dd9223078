"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from . import embeddings, huffman, jaccard, media, mixing, packing, sharding, substring, toxicity, urlfilter
from .common import table


def op1_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_huffman_token_ids(spark, sf_dir):
    return huffman.encode(table(spark, sf_dir, "documents"))


def op9_temperature_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return substring.dedup(table(spark, sf_dir, "documents"), counts=True)


def op6_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(urlfilter.RULES, "expr string, action string, priority int")
    return urlfilter.decide(table(spark, sf_dir, "pages"), rules)


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_media_columns(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_huffman_token_ids, op3_embedding_near_dedup, op4_ngram_jaccard_join, op5_substring_dedup, op6_toxicity, op7_url_filters, op8_packing, op9_temperature_mixing, op10_media_columns)}

ORACLES: dict[str, str] = {"op9_temperature_mixing": mixing.SQL, "op3_embedding_near_dedup": embeddings.SQL, "op4_ngram_jaccard_join": jaccard.SQL, "op5_substring_dedup": substring.SQL, "op7_url_filters": urlfilter.SQL}
