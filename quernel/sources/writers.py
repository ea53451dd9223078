"""Sinks (W-08, W-11 ... W-14, W-17 ... W-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """W-08: add rows, partitioned by ``by``."""
    (rows.write.partitionBy(*by) if by else rows.write).mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """W-11, W-17: partitions in ``rows`` replace those on disk; others stay as they are."""
    rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def save_json(rows: DataFrame, path: str) -> None:
    """W-12, W-14: one JSON object a line."""
    rows.write.mode("overwrite").json(path)


def knowledge_summary(statistics: DataFrame, docs: DataFrame, recent: int = 10) -> DataFrame:
    """W-13: one row, json: statistics and the ``recent`` latest documents."""
    latest = docs.orderBy(F.col("created_at").desc(), "id").limit(recent)
    listed = latest.agg(F.sort_array(F.collect_list(F.struct("created_at", *(c for c in latest.columns if c != "created_at"))), asc=False).alias("recent_documents"))
    stats = statistics.agg(F.collect_list(F.struct(*statistics.columns)).alias("statistics"))
    return stats.crossJoin(listed).select(F.to_json(F.struct("statistics", "recent_documents")).alias("json"))


def delete_session(sessions: DataFrame, entries: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """W-18: both tables without one session."""
    other = F.col("session_id") != session_id
    return sessions.where(other), entries.where(other)


def pending(migrations: DataFrame, applied: DataFrame) -> DataFrame:
    """W-19, U-05: migrations to run, in order of version."""
    return migrations.join(applied.select("version"), "version", "left_anti").orderBy("version")


def migration_status(migrations: DataFrame, applied: DataFrame) -> DataFrame:
    """W-19: version and whether it has been applied."""
    done = applied.select("version", F.lit("applied").alias("status")).distinct()
    return migrations.select("version").join(done, "version", "left").select("version", F.coalesce("status", F.lit("pending")).alias("status"))


def backup(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    """W-20: copies of tables; restoring is the same the other way round."""
    for name in names:
        spark.read.parquet(f"{source}/{name}.parquet").write.mode("overwrite").parquet(f"{target}/{name}.parquet")
