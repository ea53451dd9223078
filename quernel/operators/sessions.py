"""Conversations and memories (K-05 ... K-07, F-41 ... F-45, A-17 ... A-23, N-07, C-08 ... C-13, R-23, R-24, Z-03 ... Z-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from . import rank as R


def last_n(turns: DataFrame, n: int, session: str = "conv_id", order: str = "turn", include_system: bool = True) -> DataFrame:
    """K-06, F-45: the last n messages of each session; system messages go after the cut, so fewer may stay."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    out = turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
    return out if include_system else out.where("role != 'system'")


def summaries(turns: DataFrame, session: str = "conv_id", order: str = "turn", clip: int = 100, most: int = 500) -> DataFrame:
    """K-07: 'role: text' of the first two and last two messages (all of up to four), each clipped, joined by ' | ', clipped."""
    n = F.count("*").over(Window.partitionBy(session))
    at = F.row_number().over(Window.partitionBy(session).orderBy(order))
    kept = turns.withColumn("__n", n).withColumn("__i", at).where((F.col("__n") <= 4) | (F.col("__i") <= 2) | (F.col("__i") > F.col("__n") - 2))
    line = F.concat("role", F.lit(": "), F.substring("text", 1, clip))
    rows = kept.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("__i", line.alias("line")))).alias("ls"))
    return rows.select(session, F.substring(F.array_join(F.transform("ls", lambda x: x["line"]), " | "), 1, most).alias("summary"))


def compress(turns: DataFrame, session: str = "conv_id", order: str = "turn", longest: int = 40, keep: int = 20) -> DataFrame:
    """C-08: sessions of more than ``longest`` messages become a summary (turn -1, role system) and their last ``keep``."""
    n = turns.groupBy(session).agg(F.count("*").alias("__n"))
    long = turns.join(n.where(F.col("__n") > longest).select(session), session, "left_semi")
    short = turns.join(n.where(F.col("__n") <= longest).select(session), session, "left_semi").select(session, order, "role", "text")
    head = summaries(long, session, order).select(session, F.lit(-1).cast("long").alias(order), F.lit("system").alias("role"), F.col("summary").alias("text"))
    return short.unionByName(last_n(long, keep, session, order).select(session, order, "role", "text")).unionByName(head)


def totals(turns: DataFrame, session: str = "conv_id") -> DataFrame:
    """A-21: messages by role and token estimate of each session."""
    return turns.groupBy(session).agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


def rolling_requests(log: DataFrame, by: str, at: str, tokens: Column | None = None, seconds: int = 60) -> DataFrame:
    """N-07: requests (and tokens) of the ``seconds`` up to each request, itself included, the far end excluded."""
    millis = F.unix_millis(F.col(at).cast("timestamp"))
    w = Window.partitionBy(by).orderBy("__ms").rangeBetween(-(seconds * 1000 - 1), 0)
    out = log.withColumn("__ms", millis).withColumn("requests", F.count("*").over(w))
    return (out if tokens is None else out.withColumn("tokens_used", F.sum(tokens).over(w))).drop("__ms")


def live(rows: DataFrame, as_of: Column, expiry: str = "expiry") -> DataFrame:
    """F-43: entries without expiry never expire."""
    return rows.where(F.col(expiry).isNull() | (F.col(expiry) >= as_of))


def purge(sessions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """C-09."""
    return sessions.where(F.col("last_activity") >= as_of - F.make_dt_interval(F.lit(days)))


def recall(memories: DataFrame, query: str, as_of: Column, tags: list[str] | None = None, types: list[str] | None = None, session_id: str | None = None, user_id: str | None = None, min_importance: int = 1, limit: int = 50, query_vector: Column | None = None) -> DataFrame:
    """F-41, F-42, K-05, R-23: active memories whose content has the query, most important then newest, cut to ``limit``, then the tag filter, then scored."""
    out = memories.where((F.col("status") == "active") & (F.col("importance") >= min_importance) & F.ilike(F.col("content"), F.lit(f"%{query}%")))
    for name, value in (("session_id", session_id), ("user_id", user_id)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if types:
        out = out.where(F.col("memory_type").isin(*types))
    out = out.orderBy(F.col("importance").desc(), F.col("timestamp").desc(), "id").limit(limit)
    wanted = F.array(*map(F.lit, tags or [])).cast("array<string>")
    if tags:
        out = out.where(F.arrays_overlap("tags", wanted))
    words = sorted(set(query.lower().split()))
    keyword = F.size(F.array_intersect(F.array(*map(F.lit, words)), T.words(F.col("content")))).cast("double") / max(1, len(words))
    tagged = F.coalesce(F.try_divide(F.size(F.array_intersect("tags", wanted)).cast("double"), F.size(wanted)), F.lit(0.0))
    match = keyword * 0.5 + tagged * 0.3
    if query_vector is not None:
        match = F.greatest(match, V.cosine(V.double(F.col("embedding")), query_vector))
    days = F.datediff(as_of, F.col("timestamp"))
    return out.withColumn("score", R.memory_score(match, F.col("importance").cast("double"), days, F.coalesce("access_count", F.lit(0)).cast("double")))


def touch(memories: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """W-16: access count and time of the returned ids."""
    hit = ids.select("id", F.lit(True).alias("__hit")).distinct()
    joined = memories.join(hit, "id", "left")
    return joined.withColumn("access_count", F.when(F.col("__hit"), F.col("access_count") + 1).otherwise(F.col("access_count"))).withColumn("last_accessed", F.when(F.col("__hit"), as_of).otherwise(F.col("last_accessed"))).drop("__hit")


def associated(memories: DataFrame) -> DataFrame:
    """J-08: each memory with those it names; ids that don't exist are dropped."""
    edges = memories.select("id", F.explode("associations").alias("other"))
    return edges.join(memories.select(F.col("id").alias("other"), F.col("content").alias("other_content")), "other")


def consolidate(memories: DataFrame, least: int = 3, most: int = 100, items: int = 5) -> DataFrame:
    """A-22, A-23: one summary row a session of ``least`` or more conversation memories (the newest ``most``)."""
    w = Window.partitionBy("session_id").orderBy(F.col("timestamp").desc(), "id")
    kept = memories.where("memory_type = 'conversation'").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    clip = F.when(F.col("importance") >= 3, F.struct("timestamp", "id", F.substring("content", 1, 100).alias("c")))
    out = kept.groupBy("session_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("topics"), F.array_sort(F.collect_list(clip)).alias("cs"))
    return out.where(F.col("n") >= least).select("session_id", "n", "first", "last", F.slice("topics", 1, items).alias("topics"), F.transform(F.slice("cs", 1, items), lambda x: x["c"]).alias("items"))


def due(memories: DataFrame, threshold: int = 50) -> DataFrame:
    """A-23: sessions with so many conversation memories that they are to be consolidated."""
    return memories.where("memory_type = 'conversation'").groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def session_summary(memories: DataFrame) -> DataFrame:
    """C-11: session_id, content: the most important (then newest) summary stored of each session, else one made by ``consolidate``; sessions with neither have no row."""
    best = F.max_by("content", F.struct("importance", "timestamp", "id"))
    stored = memories.where("memory_type = 'summary'").groupBy("session_id").agg(best.alias("stored"))
    made = consolidate(memories).select("session_id", F.array_join("items", " | ").alias("made"))
    return stored.join(made, "session_id", "full").select("session_id", F.coalesce("stored", "made").alias("content"))


def expire(memories: DataFrame, cutoff: Column, most: int = 1000) -> DataFrame:
    """C-10, D20: of the first ``most`` memories of importance 2 or more, those of exactly 2, accessed less than twice and older than the cutoff, become expired."""
    seen = memories.where("status = 'active' and importance >= 2").orderBy(F.col("importance").desc(), F.col("timestamp").desc(), "id").limit(most)
    gone = seen.where((F.col("importance") == 2) & (F.col("access_count") < 2) & (F.col("timestamp") < cutoff)).select("id", F.lit(True).alias("__gone"))
    return memories.join(gone, "id", "left").withColumn("status", F.when(F.col("__gone"), "expired").otherwise(F.col("status"))).drop("__gone")


def memory_statistics(memories: DataFrame) -> DataFrame:
    """Z-05."""
    return memories.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "consolidated").alias("consolidated"), F.coalesce(F.avg("importance"), F.lit(0.0)).alias("average_importance"), F.max_by("id", F.struct("access_count", "id")).alias("most_accessed"))


def ema(log: DataFrame, by: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """A-19: exponential moving average of each group's values in order; the first value starts it. A null value adds nothing.

    A run of values turns an average x into x d^n + s, with d = 1 - alpha. Rows go by
    ranges of (group, order) to tasks; n and s of each group's run in a task are folded in order,
    so no group has to fit a task.
    """
    keep = 1 - alpha
    rows = log.where(F.col(value).isNotNull()).select(by, F.col(order).alias("__o"), F.col(value).cast("double").alias("__v"))
    rows = rows.repartitionByRange(by, "__o").withColumn("__part", F.spark_partition_id())
    run = Window.partitionBy(by, "__part")
    rows = rows.withColumn("__k", F.count("*").over(run) - F.row_number().over(run.orderBy("__o")))
    runs = rows.groupBy(by, "__part").agg(F.count("*").alias("n"), F.sum(F.col("__v") * alpha * F.pow(F.lit(keep), F.col("__k"))).alias("s"), F.max_by("__v", "__k").alias("first"))
    parts = runs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__part", "n", "s", "first"))).alias("ps"))
    fold = F.aggregate("ps", F.element_at("ps", 1)["first"], lambda a, p: a * F.pow(F.lit(keep), p["n"]) + p["s"])
    return parts.select(by, fold.alias("ema"))


def hit_rate(log: DataFrame, hit: Column) -> DataFrame:
    """A-18, A-20."""
    return log.agg(F.count("*").alias("queries"), F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count("*")), F.lit(0.0)).alias("hit_rate"))


def template_usage(log: DataFrame) -> DataFrame:
    """A-17: total, success rate, the five most used templates and the last ten uses."""
    per = log.groupBy("template").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "template"))), 1, 5), lambda x: x["template"])
    whole = per.agg(F.sum("n").alias("total"), F.coalesce(F.try_divide(F.sum("ok").cast("double"), F.sum("n")), F.lit(0.0)).alias("success_rate"), top.alias("top"))
    last = log.orderBy(F.col("at").desc(), F.col("template").desc()).limit(10).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "template"))), lambda x: x["template"]).alias("recent"))
    return whole.crossJoin(F.broadcast(last))  # a row each


def prompt_context(turns: DataFrame, session: str = "conv_id", order: str = "turn", n: int = 5, clip: int = 200) -> DataFrame:
    """C-13: the last turns of each session, clipped, as one text."""
    rows = last_n(turns, n, session, order).groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, F.concat("role", F.lit(": "), F.substring("text", 1, clip)).alias("line")))).alias("ls"))
    return rows.select(session, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("context"))
