"""Corpus preparation in five stages; each stage's output is written as Parquet and reread as the next one's documents.

toxic documents go; of each group of similar documents one stays; passages that
repeat are cut from all but their first document; sources are mixed to target
weights (each shown whole at least once); the result is packed into windows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quernel.llm import jaccard, mixing, packing, substring, toxicity
from quernel.llm.common import materialise, table


def drop_toxic(spark, docs, sf_dir):
    """Documents that the factorization machine, fitted on the labels, doesn't call toxic.

    A null or empty text has no terms and stays; a null doc_id, and repeated rows,
    are judged by their texts like others. Without labels of both classes all
    stay. No rows come of no rows.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_similar(spark, docs, sf_dir):
    """One document of each group whose word n-gram sets are similar: that of least doc_id, null last, then least digest of the text.

    Null and empty texts, and texts without words, are in no group and stay. Rows
    alike in doc_id and text stay together. No rows come of no rows.
    """
    return jaccard.dedup(docs)


def cut_repeats(spark, docs, sf_dir):
    """Texts without passages that an earlier document has; n_chars follows. Texts that had words and have none left go; those that had none stay.

    Earlier is of lesser doc_id, null last, then of lesser digest of the text. Rows
    alike in doc_id and text stay alike. No rows come of no rows.
    """
    words = "text rlike '[^ \\\\t\\\\n\\\\f\\\\r]'"
    out = substring.dedup(docs.withColumn("__words", F.expr(words)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(f"text is null or not __words or {words}").drop("__words")


def mix_sources(spark, docs, sf_dir):
    """Every document, as often as its source's weight asks, in the mixed order.

    A null source is one of its own; null and blank texts, and null doc_ids, are
    shown like others. Repeated rows are mixed each. No rows come of no rows.
    """
    return mixing.realise(docs)


def pack_windows(spark, docs, sf_dir):
    """Windows of token ids with the documents in them, in the order in which ``docs`` is stored (by number of file, then row).

    Rows that don't come from files are packed in order of doc_id. A null text
    adds nothing, an empty one its end mark; a null doc_id stays null in the
    segments; repeated rows are packed each. No rows come of no rows.
    """
    stored = F.col("_metadata.file_name")
    number = F.regexp_extract(stored, r"part-(\d+)", 1).try_cast("long")
    try:
        docs.select(stored)
    except AnalysisException:
        return packing.pack(docs)
    return packing.pack(docs, order=(number, stored, F.col("_metadata.row_index")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_similar),
    ("substring_dedup", cut_repeats),
    ("temperature_mixing", mix_sources),
    ("packing", pack_windows),
]

#: A model is fitted and a tokenizer run, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
