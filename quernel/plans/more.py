"""More registered queries: stores, memories, services, scores, chunkers, and literal legal texts (whose SQL states the expected values)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import normalise as N
from ..functions import text as T
from ..functions import vector as V
from ..operators import chunks, filters, kb, prompts, query, rank, search, service, serving, sessions
from .catalog import _SENT, _UNIT, _docs, _query, _r, _table, _topk_sql

NOW = "2024-02-01"


# Stores.
_MENTIONS = "m AS (SELECT event_id, event_id % 100 AS document_id, event_type AS entity_type, CASE WHEN event_id % 3 = 0 THEN 'Ông ' || user_id ELSE CAST(user_id AS VARCHAR) END AS name, CAST(user_id AS VARCHAR) AS normal FROM events)"


def _mentions(spark, sf_dir):
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Ông "), F.col("user_id"))).otherwise(F.col("user_id").cast("string"))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 100).alias("document_id"), F.col("event_type").alias("entity_type"), name.alias("name"))


@_query(f"WITH {_MENTIONS} SELECT entity_type, normal AS normalized_name, arg_min(name, event_id) AS name, count(*) AS frequency FROM m GROUP BY 1, 2")
def entities_with_honorifics(spark, sf_dir):
    """W-02, X-27."""
    return kb.resolve_entities(_mentions(spark, sf_dir))


@_query(f"WITH {_MENTIONS} SELECT DISTINCT document_id, entity_type, normal AS normalized_name, 0.8 AS confidence_score FROM m")
def entity_links(spark, sf_dir):
    """W-03."""
    m = _mentions(spark, sf_dir)
    return kb.link(kb.resolve_entities(m), m).withColumn("confidence_score", F.col("confidence_score").cast("double"))


@_query(f"""WITH {_MENTIONS}, e AS (SELECT entity_type, normal, arg_min(name, event_id) AS name, count(*) AS frequency FROM m GROUP BY 1, 2)
  SELECT DISTINCT m.document_id, e.entity_type, e.name, e.frequency FROM m JOIN e USING (entity_type, normal) WHERE m.document_id IN (3, 17, 42)""")
def entities_of_documents(spark, sf_dir):
    """J-03."""
    m = _mentions(spark, sf_dir)
    entities = kb.resolve_entities(m)
    return kb.entities_of(entities, kb.link(entities, m), [3, 17, 42]).select("document_id", "entity_type", "name", "frequency")


@_query("""SELECT 'Điều ' || user_id || ' Luật ' || event_type AS name, 'Luật ' || event_type AS law_name, CAST(user_id AS VARCHAR) AS article_number, count(*) AS citation_count FROM events GROUP BY event_type, user_id""")
def reference_counts(spark, sf_dir):
    """W-05, X-29."""
    names = _table(spark, sf_dir, "events").select(F.concat(F.lit("Điều "), F.col("user_id"), F.lit(" Luật "), F.col("event_type")).alias("name"))
    return kb.count_references(names)


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE source END AS case_number, 'Closed' AS status FROM documents WHERE doc_id % 3 = 2")
def closed_cases(spark, sf_dir):
    """W-06."""
    number = F.when(F.col("doc_id") % 3 == 2, F.col("source")).when(F.col("doc_id") % 3 == 1, "")
    return kb.cases(_table(spark, sf_dir, "documents").select("doc_id", number.alias("case_number")))


@_query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY doc_id, w),
  k AS (SELECT doc_id, list(w ORDER BY n DESC, w)[1:50] AS keywords FROM c GROUP BY doc_id)
  SELECT d.doc_id AS document_id, source || ' ' || text AS content, coalesce(array_to_string(keywords, ' '), '') AS keywords FROM documents d LEFT JOIN k USING (doc_id)""")
def search_index_rows(spark, sf_dir):
    """W-07, X-30."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), F.col("text").alias("raw_text"), F.lit(1.0).alias("confidence_score"))
    return kb.search_rows(docs).select("document_id", "content", F.array_join("keywords", " ").alias("keywords"))


@_query("SELECT event_id, user_id, value FROM events WHERE user_id % 10 <> 0 UNION ALL SELECT event_id, user_id, -1.0 FROM events WHERE user_id % 10 = 0 AND event_id % 2 = 0 UNION ALL SELECT event_id, user_id, value FROM events WHERE user_id % 10 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0 AND user_id % 10 = 0)")
def replaced_chunks(spark, sf_dir):
    """W-11, W-17."""
    old = _table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return kb.replace_partition(old, old.where("user_id % 10 = 0 and event_id % 2 = 0").withColumn("value", F.lit(-1.0)), "user_id")


@_query("SELECT user_id, max(event_id) AS event_id, arg_max(CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'new ' || event_type END, event_id) AS event_type FROM events GROUP BY user_id")
def latest_rows(spark, sf_dir):
    """W-15, U-06."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return kb.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumn("event_type", F.concat(F.lit("new "), F.col("event_type"))), "user_id", "event_id")


@_query("SELECT 'left' AS what, count(*) FILTER (NOT coalesce(label IN (1, 2) AND vec_id < 300, false)) AS n FROM embeddings UNION ALL SELECT 'deleted', count(*) FILTER (label IN (1, 2) AND vec_id < 300) FROM embeddings")
def deleted_embeddings(spark, sf_dir):
    """W-09, W-18."""
    v = _table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") < 300).alias("old"))
    left, gone = kb.delete(v, label=[1, 2], old=True)
    return left.agg(F.lit("left").alias("what"), F.count("*").alias("n")).unionByName(gone.select(F.lit("deleted").alias("what"), F.col("deleted").alias("n")))


@_query("""SELECT c_custkey AS id, c_name, k AS first_order, t AS total FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k, arg_min(o_totalprice, o_orderkey) AS t FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def first_cases(spark, sf_dir):
    """J-04: a customer's first order, or nulls."""
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return kb.first_case(docs, rows).select("id", "c_name", F.col("case.id").alias("first_order"), F.col("case.o_totalprice").alias("total"))


@_query("""SELECT s_nationkey AS neighbour, 'source' AS role, 'in' AS relationship_type FROM supplier WHERE s_suppkey = 7
  UNION ALL SELECT s_suppkey, 'target', 'in' FROM supplier WHERE s_nationkey = 7""")
def entity_neighbours(spark, sf_dir):
    """J-09."""
    edges = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("source_id"), F.col("s_nationkey").cast("long").alias("target_id"), F.lit("in").alias("relationship_type"))
    return kb.one_hop(edges, 7)


@_query("""SELECT d.doc_id, 'out/' || d.doc_id || '.json' AS json_path FROM documents d WHERE d.doc_id % 4 = 1""")
def results_by_stem(spark, sf_dir):
    """S-10, J-11."""
    d = _table(spark, sf_dir, "documents")
    pdfs = d.select("doc_id", F.concat(F.lit("in/"), F.col("doc_id"), F.lit(".pdf")).alias("path"))
    return kb.match_by_stem(pdfs, d.where("doc_id % 4 = 1").select(F.concat(F.lit("out/"), F.col("doc_id"), F.lit(".json")).alias("path"))).select("doc_id", "json_path")


_STATUS = "CASE event_type WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END"


@_query(f"SELECT count(*) AS total, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'pending') AS pending, round(count(*) FILTER (s = 'completed') / count(*), 6) AS success_rate FROM (SELECT {_STATUS} AS s FROM events)")
def processing_report(spark, sf_dir):
    """A-07 ... A-09."""
    return kb.status_report(_table(spark, sf_dir, "events").select(F.expr(_STATUS).alias("status"))).withColumn("success_rate", _r("success_rate"))


@_query(f"SELECT event_id FROM events WHERE {_STATUS} = 'failed'")
def failed_documents(spark, sf_dir):
    """C-12."""
    return kb.failed(_table(spark, sf_dir, "events").withColumn("status", F.expr(_STATUS))).select("event_id")


@_query("SELECT event_type AS strategy, count(*) AS chunks FROM events GROUP BY 1")
def chunk_strategies(spark, sf_dir):
    """A-07."""
    return kb.chunks_by_strategy(_table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy")))


@_query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facet_values(spark, sf_dir):
    """A-28."""
    return serving.facets(_table(spark, sf_dir, "documents"), "lang", "source")


@_query("""WITH f AS (SELECT DISTINCT lang AS q, doc_id FROM documents WHERE n_chars > 800), t AS (SELECT DISTINCT lang AS q, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
  b AS (SELECT coalesce(f.q, t.q) AS q, CASE WHEN f.doc_id IS NOT NULL AND t.doc_id IS NOT NULL THEN 1 ELSE 0 END AS h, CASE WHEN f.doc_id IS NULL THEN 0 ELSE 1 END AS f, CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS t FROM f FULL JOIN t ON f.q = t.q AND f.doc_id = t.doc_id)
  SELECT q AS query_id, round(coalesce(sum(h) / nullif(sum(f), 0), 0), 6) AS precision, round(coalesce(sum(h) / nullif(sum(t), 0), 0), 6) AS recall, round(coalesce(2 * sum(h) / nullif(sum(f) + sum(t), 0), 0), 6) AS f1 FROM b GROUP BY q""")
def id_set_scores(spark, sf_dir):
    """A-27."""
    d = _table(spark, sf_dir, "documents").withColumnRenamed("lang", "query_id")
    truth = d.join(_table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    return serving.id_sets(d.where("n_chars > 800"), truth).select("query_id", *(_r(c).alias(c) for c in ("precision", "recall", "f1")))


@_query("SELECT event_type AS phase, count(*) AS n, round(avg(value), 6) AS mean_seconds, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def phase_timings(spark, sf_dir):
    """A-18, A-29."""
    t = serving.timings(_table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("seconds")))
    return t.select("phase", "n", _r("mean_seconds").alias("mean_seconds"), _r("per_second").alias("per_second"))


@_query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def request_history(spark, sf_dir):
    """Z-14."""
    return serving.request_history(_table(spark, sf_dir, "events"), "event_id", 5, ["user_id"]).select("user_id", "event_id")


@_query("SELECT count(*) AS searches, count(*) FILTER (event_type = 'view') AS cache_hits, round(avg(value), 6) AS mean_seconds, round(avg(user_id), 6) AS mean_results FROM events")
def search_log_statistics(spark, sf_dir):
    """Z-07."""
    log = _table(spark, sf_dir, "events").select((F.col("event_type") == "view").alias("cached"), F.col("value").alias("seconds"), F.col("user_id").alias("results"))
    return service.log_statistics(log).withColumns({c: _r(c) for c in ("mean_seconds", "mean_results")})


# Search service.
@_query(f"""WITH {_UNIT}, asked AS (SELECT vec_id AS q, 0 AS variant, v FROM unit UNION ALL SELECT vec_id, 1, list_transform(v, lambda x: -x) FROM unit),
  s AS (SELECT b.q, b.variant, a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS s FROM unit a, asked b),
  t AS (SELECT * FROM s WHERE s >= 0.8 * 0.3 QUALIFY row_number() OVER (PARTITION BY q, variant ORDER BY s DESC, vec_id) <= 10),
  u AS (SELECT q, vec_id, arg_min(s, variant) AS s FROM t GROUP BY q, vec_id),
  d AS (SELECT u.*, label FROM u JOIN embeddings e USING (vec_id) WHERE label <> 3)
  SELECT q AS query_id, vec_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 5""")
def search_service(spark, sf_dir):
    """K-03, U-01, U-02, R-13: two variants of every query fetch twice as many at 0.8 of the threshold; then a filter and the best five."""
    v = search.prepare(_table(spark, sf_dir, "embeddings"))
    q = v.select(F.col("vec_id").alias("query_id"), "embedding").withColumn("variant", F.lit(0))
    q = q.unionByName(q.withColumn("variant", F.lit(1)).withColumn("embedding", F.transform("embedding", lambda x: -x)))
    node = filters.Group("AND", [filters.Criterion("label", "NOT_EQUALS", 3)])
    found = service.search_texts(q, v.select("vec_id", "embedding"), v.select("vec_id", "label"), 5, 0.3, node, "cosine_similarity")
    return found.select("query_id", "vec_id", _r("score").alias("score"), "rank")


@_query(f"""WITH {_UNIT} SELECT query_id, vec_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM (
  SELECT b.vec_id AS query_id, a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS s FROM unit a, unit b WHERE a.label = 2) WHERE s >= 0.24
  QUALIFY rank <= 5""")
def prefiltered_search(spark, sf_dir):
    """Z-09: a plain metadata criterion narrows what is searched, so a query still finds five where only few of its nearest have the label."""
    v = search.prepare(_table(spark, sf_dir, "embeddings"))
    q = v.select(F.col("vec_id").alias("query_id"), "embedding").withColumn("variant", F.lit(0))
    found = service.search_texts(q, v.select("vec_id", "embedding"), v.select("vec_id", "label"), 5, 0.3, [filters.Criterion("label", "EQUALS", 2)], "cosine")
    return found.select("query_id", "vec_id", _r("score").alias("score"), "rank")


# Memories and sessions: conversations stand in, one memory a turn.
_DAY = "DATE '2024-01-01' + CAST((conv_id + turn) % 28 AS INTEGER)"
_MEM = f"""m AS (SELECT conv_id * 1000 + turn AS id, text AS content, 1 + (conv_id + turn) % 5 AS importance, {_DAY} AS timestamp, CASE WHEN role = 'system' THEN 'summary' ELSE 'conversation' END AS memory_type,
  CASE WHEN turn = 6 THEN 'archived' ELSE 'active' END AS status, conv_id AS session_id, turn AS access_count FROM conversations)"""


def _memories(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("conv_id") + F.col("turn")) % 28).cast("int"))
    return _table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), (F.lit(1) + (F.col("conv_id") + F.col("turn")) % 5).alias("importance"), day.alias("timestamp"),
        F.when(F.col("role") == "system", "summary").otherwise("conversation").alias("memory_type"), F.when(F.col("turn") == 6, "archived").otherwise("active").alias("status"),
        F.col("conv_id").alias("session_id"), F.col("turn").alias("access_count"), F.array("role").alias("tags"), F.array((F.col("conv_id") * 1000 + F.col("turn") + 1)).alias("associations"),
    )


@_query(f"WITH {_MEM} SELECT id, CASE WHEN id % 7 = 0 THEN access_count + 1 ELSE access_count END AS access_count, CASE WHEN id % 7 = 0 THEN DATE '{NOW}' END AS last_accessed FROM m")
def touched_memories(spark, sf_dir):
    """W-16."""
    m = _memories(spark, sf_dir).withColumn("last_accessed", F.lit(None).cast("date"))
    return sessions.touch(m, m.where("id % 7 = 0"), F.lit(NOW).cast("date")).select("id", "access_count", "last_accessed")


@_query(f"WITH {_MEM} SELECT a.id, a.id + 1 AS other, b.content AS other_content FROM m a JOIN m b ON b.id = a.id + 1")
def associated_memories(spark, sf_dir):
    """J-08."""
    return sessions.associated(_memories(spark, sf_dir))


@_query(f"WITH {_MEM} SELECT id FROM m WHERE timestamp >= DATE '2024-01-15' OR id % 2 = 0")
def live_memories(spark, sf_dir):
    """F-43: entries expire at their time; without one, never."""
    m = _memories(spark, sf_dir).withColumn("expiry", F.when(F.col("id") % 2 == 1, F.col("timestamp")))
    return sessions.live(m, F.lit("2024-01-15").cast("date")).select("id")


@_query(f"WITH {_MEM} SELECT session_id, max(timestamp) AS last_activity FROM m GROUP BY session_id HAVING max(timestamp) >= DATE '{NOW}' - 10")
def kept_sessions(spark, sf_dir):
    """C-09."""
    s = _memories(spark, sf_dir).groupBy("session_id").agg(F.max("timestamp").alias("last_activity"))
    return sessions.purge(s, F.lit(NOW).cast("timestamp"), 10)


@_query(f"WITH {_MEM} SELECT session_id, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM m WHERE memory_type = 'conversation' GROUP BY session_id HAVING count(*) >= 3")
def consolidated_sessions(spark, sf_dir):
    """A-22."""
    return sessions.consolidate(_memories(spark, sf_dir)).select("session_id", "n", "first", "last")


@_query(f"WITH {_MEM} SELECT session_id, count(*) AS n FROM m WHERE memory_type = 'conversation' GROUP BY session_id HAVING count(*) >= 5")
def sessions_due(spark, sf_dir):
    """A-23."""
    return sessions.due(_memories(spark, sf_dir), 5)


@_query(f"""WITH {_MEM}, stored AS (SELECT session_id, arg_max(content, (importance, timestamp, id)) AS c FROM m WHERE memory_type = 'summary' GROUP BY session_id),
  c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS k FROM m WHERE memory_type = 'conversation' AND importance >= 3),
  made AS (SELECT session_id, (SELECT string_agg(substr(content, 1, 100), ' | ' ORDER BY k) FROM c WHERE c.session_id = m.session_id AND k <= 5) AS c FROM m WHERE memory_type = 'conversation' GROUP BY session_id HAVING count(*) >= 3)
  SELECT session_id, coalesce(stored.c, made.c, '') AS content FROM stored FULL JOIN made USING (session_id)""")
def session_summaries(spark, sf_dir):
    """C-11."""
    return sessions.session_summary(_memories(spark, sf_dir))


@_query(f"""WITH {_MEM}, seen AS (SELECT * FROM m WHERE status = 'active' AND importance >= 2 ORDER BY importance DESC, timestamp DESC, id LIMIT 1000)
  SELECT id, CASE WHEN id IN (SELECT id FROM seen WHERE importance = 2 AND access_count < 2 AND timestamp < DATE '2024-01-20') THEN 'expired' ELSE status END AS status FROM m""")
def expired_memories(spark, sf_dir):
    """C-10."""
    return sessions.expire(_memories(spark, sf_dir), F.lit("2024-01-20").cast("date")).select("id", "status")


@_query(f"WITH {_MEM} SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, 0 AS consolidated, round(avg(importance), 6) AS average_importance, arg_max(id, (access_count, id)) AS most_accessed FROM m")
def memory_totals(spark, sf_dir):
    """Z-05."""
    return sessions.memory_statistics(_memories(spark, sf_dir)).withColumn("average_importance", _r("average_importance"))


@_query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
  SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn) AS context FROM k WHERE k <= 5 GROUP BY conv_id""")
def prompt_contexts(spark, sf_dir):
    """C-13."""
    return sessions.prompt_context(_table(spark, sf_dir, "conversations"))


_USE = "u AS (SELECT event_type AS template, event_id AS used, value > 10 AS success FROM events)"


@_query(f"""WITH {_USE}, n AS (SELECT template, count(*) AS n FROM u GROUP BY template)
  SELECT (SELECT count(*) FROM u) AS total, round((SELECT count(*) FILTER (success) / count(*) FROM u), 6) AS success_rate,
  (SELECT string_agg(template, ' ' ORDER BY n DESC, template) FROM (SELECT * FROM n ORDER BY n DESC, template LIMIT 5)) AS top,
  (SELECT string_agg(template, ' ' ORDER BY used) FROM (SELECT * FROM u ORDER BY used DESC LIMIT 10)) AS recent""")
def template_statistics(spark, sf_dir):
    """A-17."""
    log = _table(spark, sf_dir, "events").select(F.col("event_type").alias("template"), F.col("event_id").alias("at"), (F.col("value") > 10).alias("success"))
    return sessions.template_usage(log).select("total", _r("success_rate").alias("success_rate"), F.array_join("top", " ").alias("top"), F.array_join("recent", " ").alias("recent"))


@_query("""SELECT * FROM (VALUES ('document_analysis', 'document_analysis', 5), ('legal_research', 'legal_research', 6), ('compliance_check', 'compliance_check', 7), ('legal_qa', 'legal_qa', 6), ('risk_assessment', 'risk_assessment', 7)) t(name, task, n_variables)""")
def template_lookup(spark, sf_dir):
    """F-44, X-53: the templates for Vietnam."""
    found = prompts.lookup(prompts.Library().table(spark), jurisdiction="vietnam")
    return found.select("name", "task", F.size("variables").alias("n_variables"))


# Scores.
_AGE = "CAST(doc_id % 400 AS INTEGER)"


@_query(f"""WITH d AS (SELECT *, {_AGE} AS days, n_chars % 50 AS acc FROM documents), m AS (SELECT *, CASE WHEN days <= 30 THEN 0.3 WHEN days <= 90 THEN 0.2 WHEN days <= 365 THEN 0.1 ELSE 0 END AS fresh, CASE WHEN days BETWEEN 0 AND 30 THEN 1 - days / 30.0 ELSE 0 END AS boost FROM d)
  SELECT doc_id, round(greatest(0.1, exp(-0.1 * days / 365)), 6) AS temporal, round(least(1, 0.5 + least(0.3, ln(1 + n_chars) / 20) + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END), 6) AS engagement,
   CAST(round(least(1, fresh + CASE WHEN lang = 'de' THEN 0.5 ELSE 0 END), 6) AS DOUBLE) AS metadata, round(boost, 6) AS boost, round(least(1, 0.5 * 0.6 + fresh * 0.3 + boost * 0.1), 6) AS hybrid,
   round(acc * 0.1 + greatest(0, 1 - days / 24) + 2 * 1 + 0.5, 6) AS context, CAST(round(least(1, 0.5 + CASE WHEN n_chars > 500 THEN 0.1 ELSE 0 END + CASE WHEN n_chars > 1000 THEN 0.1 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END + CASE WHEN days < 5 THEN 0.1 ELSE 0 END), 6) AS DOUBLE) AS answer,
   round((0.3 * n_chars + 0.2 * days) / 0.5, 6) AS learned FROM m""")
def relevance_scores(spark, sf_dir):
    """R-06, R-07, R-17, R-19 ... R-21, R-24, R-26."""
    days, n, lang = (F.col("doc_id") % 400).cast("int"), F.col("n_chars"), F.col("lang")
    fresh, boost = rank.metadata_relevance(days), rank.temporal_boost(days)
    return _table(spark, sf_dir, "documents").select(
        "doc_id", _r(rank.temporal(days)).alias("temporal"), _r(rank.engagement(n, lang == "en")).alias("engagement"), _r(rank.metadata_relevance(days, lang == "de")).alias("metadata"), _r(boost).alias("boost"),
        _r(rank.final_score("HYBRID", F.lit(0.5), fresh, boost)).alias("hybrid"), _r(rank.context_relevance((n % 50).cast("double"), days, F.lit(1), F.lit(0.5))).alias("context"),
        _r(rank.answer_confidence(n, lang == "en", days)).alias("answer"), _r(rank.predict({"a": n, "b": days}, {"a": 0.3, "b": 0.2})).alias("learned"),
    )


@_query(r"""WITH d AS (SELECT *, length(text) AS n, len(list_filter(['the', 'and'], lambda q: list_contains(list_filter(string_split_regex(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda w: w <> ''), q))) / 2.0 AS overlap FROM documents)
  SELECT doc_id, round(least(1, overlap * 0.3 + 0.2 * CASE WHEN n BETWEEN 100 AND 1000 THEN 1 WHEN n < 100 THEN n / 100 ELSE greatest(0.5, 1000 / n) END + 0.5 * 0.4), 6) AS relevance,
   round(coalesce(len(list_filter(['12', 'License'], lambda q: list_contains(regexp_extract_all(text, '\p{Lu}\p{L}+|\d{1,2}/\d{1,2}/\d{4}|\d+'), q))) / 2.0, 0), 6) AS entity FROM d""")
def text_relevance(spark, sf_dir):
    """R-09, R-18."""
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", _r(rank.search_relevance(t, "the and", F.lit(0.4))).alias("relevance"), _r(rank.entity_matching(t, "12 License")).alias("entity"))


@_query("""SELECT doc_id, f[1] AS feature, round(CAST(f[2] AS DOUBLE), 6) AS contribution FROM (SELECT doc_id, unnest([['lexical', CAST(0.2 * (doc_id % 3) AS VARCHAR)], ['quality', CAST(0.1 * (doc_id % 7) AS VARCHAR)], ['temporal', CAST(0.1 * 0.05 AS VARCHAR)], ['engagement', CAST(0.05 * 0.01 AS VARCHAR)]]) AS f FROM documents WHERE doc_id % 3 = 1 AND doc_id % 7 = 1)
  WHERE f[1] <> 'engagement'""")
def score_explanations(spark, sf_dir):
    """R-16: the three largest contributions."""
    c = lambda m: (F.col("doc_id") % m).cast("double")
    feats = {"lexical": c(3), "quality": c(7), "temporal": F.lit(0.05), "engagement": F.lit(0.01)}
    rows = _table(spark, sf_dir, "documents").where("doc_id % 3 = 1 and doc_id % 7 = 1").select("doc_id", F.inline(rank.explanation(feats)))
    return rows.select("doc_id", "feature", _r("contribution").alias("contribution"))


@_query("""WITH e AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
  SELECT vec_id, round(greatest(0, least(1, 10 * list_var_pop(v) + 0.3 * least(1, label / 100))), 6) AS quality, round(CASE WHEN v[1] <= 1 THEN 1 - v[1] ELSE 0 END, 6) AS distance FROM e WHERE label > 0""")
def embedding_quality(spark, sf_dir):
    """V-11, V-14."""
    v = V.double(F.col("embedding"))
    rows = _table(spark, sf_dir, "embeddings").where("label > 0")
    return rows.select("vec_id", _r(V.embedding_quality(v, F.expr("repeat('x', cast(label as int))"))).alias("quality"), _r(V.as_distance(F.get(v, F.lit(0)))).alias("distance"))


# Filters.
C, G = filters.Criterion, filters.Group


@_query("SELECT event_id FROM events WHERE value / 100 >= 0.4 ORDER BY event_id LIMIT 100")
def filter_scores_capped(spark, sf_dir):
    """F-07, F-30 ... F-32."""
    rows = _table(spark, sf_dir, "events").withColumn("similarity_score", F.col("value") / 100)
    return filters.apply(filters.apply(rows, G("AND", [])), filters.similarity(0.4), min_score=0.2, max_results=100, key="event_id").select("event_id")


@_query("SELECT event_id, value > 5 AND value < 60 AS searched, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') <= 20 AS recent FROM events WHERE value IS NOT NULL")
def search_level_filters(spark, sf_dir):
    """F-36, F-38."""
    rows = _table(spark, sf_dir, "events").where("value is not null").withColumn("similarity_score", F.when((F.col("value") > 5) & (F.col("value") < 60), 0.9).otherwise(0.1)).withColumn("content", F.lit("some text"))
    return rows.select("event_id", filters.search_level(0.5, 3, 100).alias("searched"), filters.recent(F.to_date("ts"), F.lit(NOW).cast("date"), 20).alias("recent"))


@_query("SELECT event_id FROM events WHERE abs(value - 42.5) < 1e-9 OR user_id = 7")
def filter_numbers(spark, sf_dir):
    """F-19, F-12, F-25."""
    return filters.apply(_table(spark, sf_dir, "events"), G("OR", [C("value", "EQUALS", 42.5), C("user_id", "EQUALS", 7)])).select("event_id")


@_query("SELECT event_id FROM events WHERE event_type LIKE '%err%' OR props LIKE '%err%'")
def filter_any_field(spark, sf_dir):
    """F-35; a criterion on columns that aren't there passes nothing (F-26)."""
    node = G("OR", [filters.any_field(["event_type", "props"], "ERR"), C("x", "GREATER_EQUAL", 0.5, "similarity")])
    return filters.apply(_table(spark, sf_dir, "events"), node).select("event_id")


# Chunkers.
def _fold_sql(source: str, keys: str, size: int, overlap: int) -> str:
    """Recursive twin of the sentence folding: ``source`` has ``keys`` and s, the list of sentences."""
    tail = f"substr(now, greatest(length(now) - {overlap} + 1, 1), {overlap})" if overlap else "''"
    full = f"(n + length(s[i + 1]) > {size} AND now <> '')"
    fresh = f"CASE WHEN {tail} = '' THEN s[i + 1] ELSE {tail} || ' ' || s[i + 1] END"
    return f"""f AS (SELECT {keys}, s, 0 AS i, '' AS now, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS done FROM {source}
    UNION ALL SELECT {keys}, s, i + 1, CASE WHEN i >= len(s) THEN '' WHEN {full} THEN {fresh} WHEN now = '' THEN s[i + 1] ELSE now || ' ' || s[i + 1] END,
      CASE WHEN {full} THEN length({fresh}) ELSE n + length(s[i + 1]) + 1 END, CASE WHEN i >= len(s) THEN nullif(now, '') WHEN {full} THEN now END
    FROM f WHERE i <= len(s))"""


@_query(f"""WITH RECURSIVE d AS (SELECT doc_id, {_SENT} AS s FROM documents), {_fold_sql('d', 'doc_id', 1000, 100)}
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, done AS content, length(done) AS chunk_size, 'text' AS content_type FROM f WHERE done IS NOT NULL""")
def fixed_size_chunks(spark, sf_dir):
    """X-08, N-04."""
    return chunks.fixed_size_chunks(_docs(spark, sf_dir))


_PARA = _SENT.replace("(text,", "(p,")


@_query(rf"""WITH RECURSIVE q AS (SELECT doc_id, list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(p)) AS ps FROM documents), a AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM q),
  d AS (SELECT doc_id, k, {_PARA} AS s FROM a WHERE length(p) > 2000), {_fold_sql('d', 'doc_id, k', 2000, 0)},
  c AS (SELECT doc_id, k, i, done FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, k, 0, p FROM a WHERE length(p) BETWEEN 50 AND 2000)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS INTEGER) AS chunk_index, done AS content, length(done) AS chunk_size, 'text' AS content_type FROM c""")
def paragraph_chunks(spark, sf_dir):
    """X-07."""
    return chunks.paragraph_chunks(_docs(spark, sf_dir))


_HEAD = chunks.HEADERS.replace("(?iu)", "(?i)")


@_query(f"""WITH q AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, trim(unnest(ls)) AS line, generate_subscripts(ls, 1) AS i FROM q),
  h AS (SELECT *, regexp_matches(line, '{_HEAD}') AS head FROM l WHERE line <> ''), r AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM h),
  s AS (SELECT doc_id, section, arg_min(CASE WHEN head THEN line END, i) AS t, any_value(CASE WHEN head THEN line END) AS section_title, string_agg(line, chr(10) ORDER BY i) AS content FROM r GROUP BY doc_id, section HAVING length(string_agg(line, chr(10) ORDER BY i)) >= 50)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS INTEGER) AS chunk_index, section_title, content, length(content) AS chunk_size, 'legal_section' AS content_type FROM s""")
def legal_section_chunks(spark, sf_dir):
    """X-09, N-03."""
    return chunks.legal_section_chunks(_docs(spark, sf_dir))


@_query(f"""WITH s AS (SELECT doc_id, len({_SENT}) AS ns, length(text) AS n, len(string_split_regex(text, '\\n\\s*\\n')) AS np, lang FROM documents)
  SELECT doc_id, CASE WHEN lang = 'de' THEN 'legal_section' WHEN np > 5 AND n > 2000 THEN 'paragraph' WHEN ns > 20 THEN 'sentence' ELSE 'fixed_size' END AS strategy FROM s""")
def chunk_strategy(spark, sf_dir):
    """X-10."""
    return _docs(spark, sf_dir).select("doc_id", chunks.strategy(F.when(F.col("lang") == "de", "Legal text"), F.col("text")).alias("strategy"))


# Literal legal texts; the SQL states what must come out.
_GOLDEN = [
    ("case_type", "Bản án Hình sự sơ thẩm", "Criminal"), ("case_type", "Quyết định dân sự", "Civil"), ("case_type", "Biên bản", "Administrative"),
    ("entity", "Ông  Nguyễn  Văn  A", "nguyễn văn a"), ("entity", "TÒA ÁN", "tòa án"),
    ("number", "1,5 và 1.000", "1.5 và 1,000"), ("law_number", "luật  số 45 / 2019 / QH14", "Luật số 45/2019/QH14"), ("reference", "theo điều 5 của luật đất đai", "theo Điều 5 Luật đất đai"),
    ("expand", "UBND", "Ủy ban nhân dân"), ("compose", "é", "é"), ("spaces", "  a \t b\n c ", "a b c"),
    ("date", "5/6/2023", "2023-06-05"), ("date", "2023-6-5", "2023-06-05"), ("date", "5-6-2023", "2023-06-05"), ("date", "June", None),
    ("clean", "Diéu 10  Khoán 2 của Luàt ,và 7 %", "Điều 10 Khoản 2 của Luật, và 7%"), ("kind", "locations", "location"), ("kind", "parties", None), ("article", "Điều 173 Bộ luật hình sự 2015", "173"),
]


def _quoted(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@_query("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_quoted, row))})" for row in _GOLDEN) + ") t(what, given, result)")
def literal_texts(spark, sf_dir):
    """X-11 ... X-19, X-27 ... X-31 on literal cases."""
    t, what = F.col("given"), F.col("what")
    plain = {"number": N.numbers, "law_number": N.document_numbers, "reference": N.cross_references, "compose": N.compose, "expand": lambda s: N.expand(s, True)}

    @F.udf("string")
    def by_rule(kind, s):
        return plain[kind](s) if kind in plain else None

    rows = spark.createDataFrame([r[:2] for r in _GOLDEN], "what string, given string")
    out = (
        F.when(what == "case_type", kb.case_type(t)).when(what == "entity", X.normalise_entity(t)).when(what == "date", X.parse_date(t).cast("date").cast("string")).when(what == "clean", N.clean(t))
        .when(what == "spaces", N.spaces(t)).when(what == "kind", kb.entity_kind(t)).when(what == "article", X.law_reference(t)["article_number"]).otherwise(by_rule(what, t))
    )
    return rows.select("what", "given", out.alias("result"))


_JUDGMENT = """TÒA ÁN NHÂN DÂN THÀNH PHỐ A
Bản án số: 12/2023/HS-ST
Ngày: 5/6/2023
Bị cáo: Nguyễn Văn B
Thẩm phán: Trần Thị C;
bị cáo phạm tội trộm cắp tài sản theo Điều 173 khoản 1 Bộ luật hình sự 2015
1. Bị cáo đã lấy một chiếc xe máy của bị hại.
Tuyên bố: bị cáo có tội
Phạt 2 năm tù. Bản án hình sự."""


@_query("SELECT doc_id, '12/2023/HS-ST' AS case_number, '5/6/2023' AS date_issued, 'Bản án hình sự' AS document_type, 'Nguyễn Văn B' AS defendant, 'Trần Thị C' AS judge, true AS cites FROM documents")
def legal_extraction(spark, sf_dir):
    """X-20 ... X-26: a judgment after every document's own first line."""
    text = F.concat_ws("\n", F.lit(_JUDGMENT), F.concat(F.lit("x"), F.col("doc_id")))
    d = _table(spark, sf_dir, "documents").select("doc_id", X.legal_document(text).alias("d"))
    return d.select("doc_id", "d.case_number", "d.date_issued", "d.document_type", F.col("d.parties.defendants")[0].alias("defendant"), F.col("d.parties.judges")[0].alias("judge"), F.array_contains("d.legal_references", "Điều 173 khoản 1").alias("cites"))


@_query(r"""WITH t AS (SELECT DISTINCT event_type FROM events) SELECT event_type, CASE event_type WHEN 'view' THEN 'view the agreement' ELSE event_type END AS variant FROM t""")
def query_variants(spark, sf_dir):
    """X-49: each query with the last of its one-word replacements; those without a synonym stay."""
    rows = _table(spark, sf_dir, "events").select("event_type").distinct()

    @F.udf("string")
    def replaced(kind):
        return (query.variants("view the contract", most=1)[-1]) if kind == "view" else query.variants(kind)[-1]

    return rows.select("event_type", replaced("event_type").alias("variant"))
