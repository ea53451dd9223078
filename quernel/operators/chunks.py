"""Chunkers (X-06 ... X-10, N-02 ... N-05, E-02). All but paragraph positions are built-in expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

DEFAULTS = {"chunk_size": 1000, "overlap": 100, "min_size": 50, "max_size": 2000, "sentences": 3}
LEGAL_DEFAULTS = {"chunk_size": 1500, "overlap": 50, "min_size": 100, "max_size": 1500, "sentences": 3}
HEADERS = (
    r"(?iu)^(?:phần)\s+([IVX]+|[0-9]+)[.:]?\s*([^\n]+)|^(?:chương)\s+([IVX]+|[0-9]+)[.:]?\s*([^\n]+)|^(?:điều|khoản|mục)\s+([0-9]+)[.:]?\s*([^\n]+)"
    r"|^([0-9]+)[.)]\s*([^\n]+)|^([a-z][.)])\s*([^\n]+)"
)


def _rows(docs: DataFrame, key: str, chunks: Column, kind: str = "text") -> DataFrame:
    # An inner explode would compute the chunks twice, the first time to see whether there are any.
    out = docs.select(key, F.posexplode_outer(chunks).alias("chunk_index", "content")).where("content is not null")
    return out.select(key, "chunk_index", "content", F.length("content").alias("chunk_size"), F.lit(kind).alias("content_type"))


def sentence_chunks(docs: DataFrame, key: str = "doc_id", body: str = "text", sentences: int = 3, overlap: int = 0, min_size: int = 50) -> DataFrame:
    """X-06, N-02: every ``sentences`` sentences, the last ``overlap`` of one beginning the next; shorter than ``min_size`` dropped."""
    step = max(1, sentences - overlap)
    groups = T.let(T.sentences(F.col(body)), lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(step)), lambda i: F.array_join(F.slice(s, i + 1, sentences), " ")))
    return _rows(docs, key, F.filter(groups, lambda c: F.length(c) >= min_size))


def _pack(parts: Column, size: int, overlap: int) -> Column:
    """N-04: fold parts into strings of about ``size`` characters; a string's last ``overlap`` characters begin the next."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(acc: Column, part: Column) -> Column:
        full = (acc["n"] + F.length(part) > size) & (acc["now"] != "")
        tail = F.substring(acc["now"], F.greatest(F.length(acc["now"]) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else F.lit("")
        fresh = F.when(tail == "", part).otherwise(F.concat(tail, F.lit(" "), part))
        grown = F.when(acc["now"] == "", part).otherwise(F.concat(acc["now"], F.lit(" "), part))
        length = F.when(tail == "", F.length(part)).otherwise(F.length(tail) + F.length(part) + 1)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, fresh).otherwise(grown).alias("now"),
            F.when(full, length).otherwise(acc["n"] + F.length(part) + 1).alias("n"),
        )

    return F.aggregate(parts, start, add, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def fixed_size_chunks(docs: DataFrame, key: str = "doc_id", body: str = "text", chunk_size: int = 1000, overlap: int = 100) -> DataFrame:
    """X-08: sentences folded to ``chunk_size`` characters with a character tail; the last chunk stays at any size."""
    return _rows(docs, key, _pack(T.sentences(F.col(body)), chunk_size, overlap))


def paragraph_chunks(docs: DataFrame, key: str = "doc_id", body: str = "text", min_size: int = 50, max_size: int = 2000) -> DataFrame:
    """X-07: paragraphs (blank lines between); under ``min_size`` dropped, over ``max_size`` folded by sentences."""
    parts = F.filter(F.transform(F.split(F.col(body), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= min_size)
    cut = F.transform(parts, lambda p: F.when(F.length(p) > max_size, _pack(T.sentences(p), max_size, 0)).otherwise(F.array(p)))
    return _rows(docs, key, F.flatten(cut))


def legal_section_chunks(docs: DataFrame, key: str = "doc_id", body: str = "text", min_size: int = 50) -> DataFrame:
    """X-09, N-03: a header line begins a section, which runs to the next; key, chunk_index, section_title, content, ..."""
    lines = docs.select(key, F.posexplode(F.transform(F.split(F.col(body), "\n"), lambda x: F.trim(x))).alias("at", "line")).where("line != ''")
    head = F.col("line").rlike(HEADERS)
    run = F.sum(head.cast("int")).over(Window.partitionBy(key).orderBy("at"))
    packed = lines.withColumn("head", head).withColumn("section", run).groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("at", "line", "head"))).alias("ls"))
    body_text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    first = F.element_at("ls", 1)
    sections = packed.select(key, "section", F.when(first["head"], first["line"]).alias("section_title"), body_text.alias("content")).where(F.length("content") >= min_size)
    index = F.row_number().over(Window.partitionBy(key).orderBy("section")) - 1
    return sections.select(key, index.alias("chunk_index"), "section_title", "content", F.length("content").alias("chunk_size"), F.lit("legal_section").alias("content_type"))


def strategy(document_type: Column, body: Column) -> Column:
    """X-10."""
    paragraphs = F.size(F.split(body, r"\n\s*\n"))
    return (
        F.when(F.contains(F.lower(F.coalesce(document_type, F.lit(""))), F.lit("legal")), "legal_section")
        .when((paragraphs > 5) & (F.length(body) > 2000), "paragraph").when(F.size(T.sentences(body)) > 20, "sentence").otherwise("fixed_size")
    )


_CHUNKERS: dict[str, Callable] = {"sentence": sentence_chunks, "paragraph": paragraph_chunks, "fixed_size": fixed_size_chunks, "legal_section": legal_section_chunks}


def register(name: str, chunker: Callable[..., DataFrame]) -> None:
    """E-02: ``chunker(docs, key, body, **options)`` under a new name."""
    _CHUNKERS[name] = chunker


def chunk(docs: DataFrame, how: str, key: str = "doc_id", body: str = "text", **options) -> DataFrame:
    """Chunks with scores (X-04, X-05); 'semantic' is declared but has no chunker, as in the reference."""
    if how not in _CHUNKERS:
        raise ValueError(f"no chunker for {how}")
    return scored(_CHUNKERS[how](docs, key, body, **options)).withColumn("strategy", F.lit(how))


def scored(chunks: DataFrame) -> DataFrame:
    s = F.col("__s")
    chunks = chunks.select("*", F.inline(F.array(F.struct(T.sentences(F.col("content")).alias("__s")))))
    return chunks.select(*(c for c in chunks.columns if c != "__s"), F.size(T.split_words(F.col("content"))).alias("word_count"), F.size(s).alias("sentence_count"), T.coherence(s).alias("coherence_score"), T.completeness(F.col("content"), s).alias("completeness_score"))


def gap_sections(blocks: DataFrame, page_height: Column, key: str = "page_id") -> DataFrame:
    """N-05, X-45: layout blocks (x0, y0, x1, y1) from top to bottom; a gap of 5 % of the page begins a section. Bounding box and count of each."""
    w = Window.partitionBy(key).orderBy("y0", "x0")
    new = F.coalesce(F.col("y0") - F.lag("y1").over(w) >= page_height * 0.05, F.lit(True))
    numbered = blocks.withColumn("__new", new.cast("int")).withColumn("section", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "section").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("blocks"))


def ocr_blocks(words: DataFrame, key: str = "page_id") -> DataFrame:
    """S-07: OCR words (block, line, word_no, text) to lines, lines to blocks."""
    line = words.where(F.trim("text") != "").groupBy(key, "block", "line").agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w"))
    line = line.select(key, "block", "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))
    return line.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
