"""Sources (S-01 ... S-16): typed reads; parsers for binary files are given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ``legal_results`` reads from a result file.
LEGAL = """document_info struct<document_type:string, case_number:string, court_name:string, date_issued:string,
 parties:struct<defendants:array<string>, plaintiffs:array<string>, prosecutors:array<string>, judges:array<string>>, charges:array<string>, verdict:string,
 sentence:string, legal_references:array<string>, key_facts:array<string>>, processing_timestamp string, confidence_score double"""
EMBEDDING = "chunk_id string, embedding array<double>, embedding_model string, embedding_dimension int, processing_time double, quality_score double, is_normalized boolean"
PAGES = "path string, page_no int, text string"
SPANS = "path string, page_no int, block_no int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double"
IMAGES = r"(?i)\.(png|jpe?g|tiff?|bmp|gif)$"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is scanned in fewer pieces than twice their number (one file of few row groups); else as it is.

    Costs a shuffle of a small table, and never of a large one, which has more pieces than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """S-13."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, path: str, pattern: str | None = None, content: bool = True) -> DataFrame:
    """S-05, S-10: path, stem, modified, length and (if wanted) content of files whose path matches ``pattern``; the listing alone reads no file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    found = found.withColumn("stem", stem)
    if pattern:
        found = found.where(F.col("path").rlike(pattern))
    return found.select("path", "stem", F.col("modificationTime").alias("modified"), "length", *(["content"] if content else []))


def images(spark: SparkSession, path: str) -> DataFrame:
    """S-05."""
    return files(spark, path, IMAGES)


def parse(rows: DataFrame, parser: Callable[[str, bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """S-01, S-03, S-04, S-06, S-08: ``parser(path, content)`` yields rows of ``schema`` (without path) for each file.

    The parser (a PDF or OCR library) is the caller's. A file on which it raises
    gives no rows; ``failures`` tells which.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(path, *r) for r in parser(path, bytes(content))]
                except Exception:  # noqa: BLE001 - a broken file must not end the job
                    continue
            yield pd.DataFrame(out, columns=names)

    return rows.select("path", "content").mapInPandas(run, schema)


def failures(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files without a parsed row."""
    return rows.select("path").join(parsed.select("path").distinct(), "path", "left_anti")


def document_texts(pages: DataFrame) -> DataFrame:
    """S-01, S-02: path, text (pages joined by line breaks), pages, total_pages."""
    ordered = pages.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    texts = F.transform("p", lambda x: F.coalesce(x["text"], F.lit("")))
    return ordered.select("path", F.array_join(texts, "\n").alias("text"), texts.alias("pages"), F.size("p").alias("total_pages"))


def legal_results(spark: SparkSession, path: str) -> DataFrame:
    """S-09: result files, and their path."""
    return spark.read.schema(LEGAL).option("multiLine", "true").json(path).withColumn("path", F.input_file_name())


def summary(spark: SparkSession, path: str) -> DataFrame:
    """S-11: path of the summary, name and raw JSON of each entry of ``detailed_results``."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json(F.get_json_object("value", "$.detailed_results"), "map<string,string>").alias("m"))
    return raw.select("path", F.explode("m").alias("name", "result"))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """S-12: quality 0 and normalised true where missing."""
    rows = spark.read.schema(EMBEDDING).option("multiLine", "true").json(path)
    return rows.withColumn("quality_score", F.coalesce("quality_score", F.lit(0.0))).withColumn("is_normalized", F.coalesce("is_normalized", F.lit(True)))


def memories(rows: DataFrame) -> DataFrame:
    """S-14: defaults of memory rows."""
    defaults: dict[str, Column] = {"access_count": F.lit(0), "decay_factor": F.lit(1.0), "status": F.lit("active"), "tags": F.array().cast("array<string>")}
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows


def sessions(rows: DataFrame, user: str | None = None) -> DataFrame:
    """S-15: sessions, latest activity first."""
    rows = rows if user is None else rows.where(F.col("user_id") == user)
    return rows.orderBy(F.col("last_activity").desc(), "session_id")


def tables(spark: SparkSession) -> list[str]:
    """S-16."""
    return sorted(t.name for t in spark.catalog.listTables())
