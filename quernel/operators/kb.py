"""Knowledge base: deduplicating inserts, entity resolution, search and statistics (W-01 ... W-18, J-03, J-04, J-07 ... J-11, A-01 ... A-10, K-01, U-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T


def file_hash(content: Column) -> Column:
    """X-32."""
    return F.sha2(content, 256)


def insert_if_absent(new: DataFrame, existing: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """W-01, W-03, W-04, W-10, J-07: rows of ``new`` to append: of equal keys the first in order, none that exists."""
    once = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), order).alias("__r")).select("__r.*")
    return once if existing is None else once.join(existing.select(*keys).distinct(), keys, "left_anti")


def resolve_entities(mentions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """W-02: mentions (seq, entity_type, name) to entities with normalised name, first name seen and frequency (mentions); merged with existing ones."""
    fresh = mentions.withColumn("normalized_name", X.normalise_entity(F.col("name"))).groupBy("entity_type", "normalized_name").agg(F.min_by("name", "seq").alias("name"), F.count("*").alias("frequency"))
    if existing is None:
        return fresh
    both = existing.select("entity_type", "normalized_name", "name", "frequency", F.lit(0).alias("__new")).unionByName(fresh.withColumn("__new", F.lit(1)))
    return both.groupBy("entity_type", "normalized_name").agg(F.min_by("name", "__new").alias("name"), F.sum("frequency").alias("frequency"))


def link(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """W-03: document, entity edges once each, with the constant confidence 0.8."""
    keyed = mentions.withColumn("normalized_name", X.normalise_entity(F.col("name"))).select("document_id", "entity_type", "normalized_name").distinct()
    return keyed.join(entities.select("entity_type", "normalized_name"), ["entity_type", "normalized_name"]).withColumn("confidence_score", F.lit(0.8))


def count_references(mentions: DataFrame) -> DataFrame:
    """W-05: citation counts with the law's name and article."""
    counted = mentions.groupBy("name").agg(F.count("*").alias("citation_count"))
    return counted.select("*", X.law_reference(F.col("name")).alias("ref")).select("name", "ref.law_name", "ref.article_number", "citation_count")


def cases(docs: DataFrame) -> DataFrame:
    """W-06: a closed case for every document with a case number."""
    return docs.where(F.coalesce("case_number", F.lit("")) != "").withColumn("status", F.lit("Closed"))


def search_rows(docs: DataFrame) -> DataFrame:
    """W-07: content and keywords for the search index."""
    return docs.select("document_id", F.concat_ws(" ", "filename", "raw_text").alias("content"), X.keywords(F.col("raw_text")).alias("keywords"), F.col("confidence_score").alias("relevance_score"))


def replace_partition(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """W-11, W-17: all rows of the keys in ``new`` are replaced by it."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """W-15, U-06: the latest row of each key."""
    both = existing.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("__r")).select("__r.*")


def delete(rows: DataFrame, **wanted) -> tuple[DataFrame, DataFrame]:
    """W-09, W-18: what stays, and one row with the number deleted. No criterion deletes all."""
    gone = F.lit(True)
    for name, value in wanted.items():
        gone = gone & (F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    gone = F.coalesce(gone, F.lit(False))
    return rows.where(~gone), rows.agg(F.count_if(gone).alias("deleted"))


def find(docs: DataFrame, text: str | None = None, document_type: str | None = None, case_number: str | None = None, court_name: str | None = None, date_from=None, date_to=None, min_confidence: float | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """F-01 ... F-03, K-01, X-41: conjunctive search; best confidence, then newest, then id."""
    like = lambda c, v: F.ilike(F.col(c), F.lit(f"%{v}%"))
    out = docs
    for test in (
        text and like("raw_text", text), document_type and (F.col("document_type") == document_type), case_number and like("case_number", case_number),
        court_name and like("court_name", court_name), date_from and (F.col("date_issued") >= date_from), date_to and (F.col("date_issued") <= date_to),
    ):
        if test is not None and not isinstance(test, str):
            out = out.where(test)
    if min_confidence is not None:
        out = out.where(F.col("confidence_score") >= min_confidence)
    page = out.orderBy(F.col("confidence_score").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id").offset(offset).limit(limit)
    return page.withColumn("summary", T.summary(F.col("raw_text"))).drop("raw_text")


def first_case(docs: DataFrame, case_rows: DataFrame) -> DataFrame:
    """J-04: every document with its first case, or nulls."""
    one = case_rows.groupBy("document_id").agg(F.min_by(F.struct(*[c for c in case_rows.columns if c != "document_id"]), "id").alias("case"))
    return docs.join(one.withColumnRenamed("document_id", "id"), "id", "left")


def one_hop(edges: DataFrame, entity_id: int) -> DataFrame:
    """J-09: neighbours and the role the entity plays."""
    out = edges.where(F.col("source_id") == entity_id).select(F.col("target_id").alias("neighbour"), F.lit("source").alias("role"), "relationship_type")
    return out.unionByName(edges.where(F.col("target_id") == entity_id).select(F.col("source_id").alias("neighbour"), F.lit("target").alias("role"), "relationship_type"))


def statistics(docs: DataFrame, by: str | None = None) -> DataFrame:
    """A-01 ... A-03, A-10: counts and averages, null as 0; by group if named."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggs = [F.count("*").alias("documents")]
    for c in ("processing_time", "confidence_score", "text_length"):
        if c in docs.columns:
            aggs.append(zero(F.avg(c)).alias(f"avg_{c}"))
    if "text_length" in docs.columns:
        aggs.append(F.coalesce(F.sum("text_length"), F.lit(0)).alias("total_text_length"))
    return docs.groupBy(by).agg(*aggs) if by else docs.agg(*aggs)


def status_report(rows: DataFrame, status: str = "status") -> DataFrame:
    """A-07 ... A-09: one row of counts by status and the success rate; 0 when empty."""
    done, n = F.count_if(F.col(status) == "completed"), F.count("*")
    return rows.agg(n.alias("total"), done.alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"), F.count_if(F.col(status) == "pending").alias("pending"), F.coalesce(F.try_divide(done.cast("double"), n), F.lit(0.0)).alias("success_rate"))


def embedding_statistics(rows: DataFrame, by: str = "embedding_model") -> DataFrame:
    """A-04 ... A-06."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("quality").alias("avg_quality"), F.min("quality").alias("min_quality"), F.max("quality").alias("max_quality"), F.min_by("dimension", "id").alias("dimension"))


def match_by_stem(pdfs: DataFrame, jsons: DataFrame) -> DataFrame:
    """S-10, J-11: result files with their document by file stem; files without one are left out."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]+$", "")
    return pdfs.withColumn("stem", stem(F.col("path"))).join(jsons.select(stem(F.col("path")).alias("stem"), F.col("path").alias("json_path")), "stem")


def document_kind(document_type: Column) -> Column:
    """X-28: stored kind of a document type."""
    kinds = {"Bản án": "judgment", "Quyết định": "decision", "Cáo trạng": "indictment", "Biên bản": "minutes"}
    out = F.lit("other")
    for prefix, kind in reversed(kinds.items()):
        out = F.when(F.startswith(document_type, F.lit(prefix)), kind).otherwise(out)
    return out


def entity_kind(name: Column) -> Column:
    """X-28: stored kind of a key of extracted entities; null for others, whose rows are dropped."""
    kinds = {"persons": "person", "organizations": "organization", "locations": "location", "dates": "date", "amounts": "amount", "case_numbers": "case_number", "legal_references": "legal_reference", "charges": "charge"}
    return F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[name]


def case_type(document_type: Column) -> Column:
    """X-28: criminal, civil or, for all others, administrative."""
    low = F.lower(document_type)
    return F.when(F.contains(low, F.lit("hình sự")), "Criminal").when(F.contains(low, F.lit("dân sự")), "Civil").otherwise("Administrative")


def entities_of(entities: DataFrame, links: DataFrame, documents: list | None = None) -> DataFrame:
    """J-03: the entities of the given documents (of all, if none are given): document_id and the entity's columns."""
    wanted = links if documents is None else links.where(F.col("document_id").isin(*documents))
    return wanted.select("document_id", "entity_type", "normalized_name").join(entities, ["entity_type", "normalized_name"])


def chunks_by_strategy(chunks: DataFrame) -> DataFrame:
    """A-07: chunks of each strategy that has any."""
    return chunks.groupBy("strategy").agg(F.count("*").alias("chunks"))


def failed(docs: DataFrame, status: str = "status") -> DataFrame:
    """C-12: what to process again; its results replace stored ones (``replace_partition``)."""
    return docs.where(F.col(status) == "failed")
