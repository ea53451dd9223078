"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..sources import readers
from ..operators import chunks, filters, kb, query, rank, search, sessions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TEXT = "the thention of and"
AS_OF = "2024-02-01"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    """``documents`` for queries that read every text with regular expressions."""
    return readers.spread(_table(spark, sf_dir, "documents"))


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _r(c, n=6):
    return F.round(c, n)


# Shared SQL pieces.
TOK = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)"
_TOKS = f"toks AS (SELECT doc_id, text, {TOK} AS t FROM documents)"
_TERMS = TEXT.split()


def _ranked_sql(weight: str) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf_{i}" for i, q in enumerate(_TERMS))
    df = ", ".join(f"sum(CASE WHEN tf_{i} > 0 THEN 1 ELSE 0 END) AS df_{i}" for i in range(len(_TERMS)))
    score = " + ".join(f"CASE WHEN tf_{i} > 0 THEN {weight.replace('TF', f'tf_{i}').replace('DF', f'df_{i}')} ELSE 0 END" for i in range(len(_TERMS)))
    some = " OR ".join(f"tf_{i} > 0" for i in range(len(_TERMS)))
    return f"""WITH {_TOKS}, hits AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS n_toks, {tf} FROM toks),
      stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(n_toks) AS av, {df} FROM hits),
      scored AS (SELECT doc_id, {score} AS s FROM hits, stats WHERE {some}),
      best AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) AS k FROM scored)
      SELECT doc_id, round(s, 6) AS score, CAST(k AS INTEGER) AS rank FROM best WHERE k <= 10"""


@_query(_ranked_sql("ln((n - DF + 0.5) / (DF + 0.5)) * (TF * 2.5) / (TF + 1.5 * (0.25 + 0.75 * n_toks / av))"))
def bm25_topk(spark, sf_dir):
    best = rank.top_k(rank.bm25(_docs(spark, sf_dir), TEXT), 10)
    return best.withColumn("score", _r("score"))


@_query(_ranked_sql("TF / n_toks * ln(n / DF)"))
def tfidf_topk(spark, sf_dir):
    return rank.top_k(rank.tfidf(_docs(spark, sf_dir), TEXT), 10).withColumn("score", _r("score"))


@_query(f"WITH {_TOKS} SELECT doc_id, round(len(list_intersect(list_distinct(t), {_TERMS})) / {float(len(set(_TERMS)))}, 6) AS overlap FROM toks")
def lexical_overlap(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _r(rank.lexical_overlap(F.col("text"), TEXT)).alias("overlap"))


@_query(f"""WITH {_TOKS} SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avg_len,
  (SELECT count(DISTINCT w) FROM (SELECT unnest(t) AS w FROM toks)) AS vocabulary FROM toks""")
def corpus_stats(spark, sf_dir):
    return rank.corpus_stats(_docs(spark, sf_dir)).withColumn("avg_len", _r("avg_len"))


@_query(f"""WITH {_TOKS} SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS term FROM toks) GROUP BY term ORDER BY df DESC, term LIMIT 25""")
def term_doc_freq_top(spark, sf_dir):
    return rank.document_counts(_docs(spark, sf_dir)).orderBy(F.col("df").desc(), "term").limit(25)


@_query(f"""WITH {_TOKS}, p AS (SELECT doc_id, unnest(list_distinct(t)) AS term FROM toks), d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
  SELECT doc_id, round(avg(ln((SELECT count(*) FROM documents) / df)), 6) AS idf_mean FROM p JOIN d USING (term) GROUP BY doc_id""")
def document_frequency_feature(spark, sf_dir):
    return rank.document_frequency(_docs(spark, sf_dir)).withColumn("idf_mean", _r("idf_mean"))


@_query(f"""WITH {_TOKS} SELECT doc_id, round(coalesce(len(list_filter(t, lambda x: x IN {tuple(_TERMS)})) / nullif(len(t) * {float(len(_TERMS))}, 0), 0), 9) AS tf FROM toks""")
def term_frequency_feature(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _r(rank.term_frequency(F.col("text"), TEXT), 9).alias("tf"))


_UNIT = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)"""
_L1 = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))"
_METRIC_SQL = {
    "cosine": "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))",
    "dot": "list_dot_product(a.v, b.v)",
    "euclidean": "1 / (1 + sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))))",
    "manhattan": f"1 / (1 + {_L1})",
    "chebyshev": "1 / (1 + list_max(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))))",
    "angular": "1 - 2 * acos(greatest(-1, least(1, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))))) / 3.141592653589793",
}


def _topk_sql(metric: str, k: int, queries: str = "true") -> str:
    return f"""SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k
      FROM (SELECT b.vec_id AS query_id, a.vec_id, round({_METRIC_SQL[metric]}, 9) AS s FROM unit a, unit b WHERE {queries}) WHERE s >= 0
      QUALIFY k <= {k}"""


def _unit_vectors(spark, sf_dir):
    """Every vector, as a query and as what is searched."""
    v = search.prepare(_table(spark, sf_dir, "embeddings"))
    return v.withColumnRenamed("vec_id", "query_id"), v


def _metric_query(metric: str):
    def run(spark, sf_dir):
        q, v = _unit_vectors(spark, sf_dir)
        return search.knn(q, v, 10, metric).select("query_id", "vec_id", _r("score").alias("score"), "rank")

    sql = f"WITH {_UNIT} SELECT query_id, vec_id, round(s, 6) AS score, CAST(k AS INTEGER) AS rank FROM ({_topk_sql(metric, 10)})"
    _query(sql, f"{metric}_topk")(run)


for _m in _METRIC_SQL:
    _metric_query(_m)

#: Correlation is the cosine of centred vectors; ranks are taken once for each vector, equal values sharing their mean.
_CENTRED = """unit AS (SELECT vec_id, label, list_transform(w, lambda x: x - list_avg(w)) AS v FROM raw)"""
_RAW = {
    "pearson": "raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings)",
    "spearman": """each AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
      raw AS (SELECT vec_id, label, list(r ORDER BY i) AS w FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x) + (count(*) OVER (PARTITION BY vec_id, x) - 1) / 2 AS r FROM each) GROUP BY vec_id, label)""",
}
for _m, _raw in _RAW.items():

    def _run(spark, sf_dir, metric=_m):
        v = _table(spark, sf_dir, "embeddings")
        return search.knn(v.withColumnRenamed("vec_id", "query_id"), v, 10, metric).select("query_id", "vec_id", _r("score").alias("score"), "rank")

    _query(f"WITH {_raw}, {_CENTRED} SELECT query_id, vec_id, round(s, 6) AS score, CAST(k AS INTEGER) AS rank FROM ({_topk_sql('cosine', 10)})", f"{_m}_topk")(_run)


@_query(f"""WITH {_UNIT}, centre AS (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM unit) GROUP BY i), mean AS (SELECT list(x ORDER BY i) AS v FROM centre),
  scored AS (SELECT a.vec_id, round({_METRIC_SQL["cosine"]}, 9) AS s FROM unit a, mean b),
  best AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS k FROM scored WHERE s >= 0)
  SELECT vec_id, round(s, 6) AS score, CAST(k AS INTEGER) AS rank FROM best WHERE k <= 10""")
def centroid_search(spark, sf_dir):
    """One query vector (the mean of all): the plain expression search without blocks."""
    _, v = _unit_vectors(spark, sf_dir)
    parts = v.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    q = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding")).withColumn("query_id", F.lit(0))
    found = search.scores(q, v, n_queries=1).withColumn("score", F.round("score", 9)).where("score >= 0")
    return rank.top_k(found, 10, "score", "vec_id").select("vec_id", _r("score").alias("score"), "rank")


@_query(f"""WITH {_UNIT}, parts AS (SELECT query_id, vec_id, 0.5 * s AS p FROM ({_topk_sql('cosine', 20)}) UNION ALL
  SELECT query_id, vec_id, 0.3 * s FROM ({_topk_sql('euclidean', 20)}) UNION ALL SELECT query_id, vec_id, 0.2 * s FROM ({_topk_sql('dot', 20)})),
  summed AS (SELECT query_id, vec_id, round(sum(p), 9) AS s FROM parts GROUP BY query_id, vec_id),
  best AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM summed WHERE s >= 0)
  SELECT query_id, vec_id, round(s, 6) AS score, CAST(k AS INTEGER) AS rank FROM best WHERE k <= 10""")
def hybrid_metric_topk(spark, sf_dir):
    q, v = _unit_vectors(spark, sf_dir)
    return search.hybrid(q, v, {"cosine": 0.5, "euclidean": 0.3, "dot": 0.2}).select("query_id", "vec_id", _r("score").alias("score"), "rank")


_TEN = "b.vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 10)"
_ADAPT = " UNION ALL ".join(f"SELECT '{m}' AS metric, query_id, var_pop(s) AS v FROM ({_topk_sql(m, 10, _TEN)}) GROUP BY query_id" for m in ("cosine", "euclidean", "manhattan", "dot"))


@_query(f"WITH {_UNIT} SELECT metric, round(sum(v), 9) AS variance FROM ({_ADAPT}) GROUP BY metric")
def adaptive_metric(spark, sf_dir):
    """The choice looks at ten queries; that number is the feature's own."""
    q, v = _unit_vectors(spark, sf_dir)
    return search.adaptive(q, v).withColumn("variance", _r("variance", 9))


@_query("""SELECT label, count(*) AS n, round(avg(q), 9) AS avg_quality, round(min(q), 9) AS min_quality, round(max(q), 9) AS max_quality, arg_min(len(embedding), vec_id) AS dimension FROM
  (SELECT *, list_var_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS q FROM embeddings) GROUP BY label""")
def embedding_stats_by_label(spark, sf_dir):
    v = V.double(F.col("embedding"))
    m = V.total(v) / F.size(v)
    rows = _table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), (V.total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)).alias("quality"), F.size("embedding").cast("long").alias("dimension"))
    out = kb.embedding_statistics(rows, "label")
    return out.select("label", "n", *(_r(c, 9).alias(c) for c in ("avg_quality", "min_quality", "max_quality")), "dimension")


C, G = filters.Criterion, filters.Group


def _filter_query(name: str, table: str, key: str, node, where: str):
    def run(spark, sf_dir):
        return filters.apply(_table(spark, sf_dir, table), node).select(key)

    _query(f"SELECT {key} FROM {table} WHERE {where}", name)(run)


_filter_query("filter_and", "documents", "doc_id", G("AND", [C("lang", "EQUALS", "EN"), C("n_chars", "GREATER_THAN", 500), C("source", "NOT_EQUALS", "src3")]), "lang = 'en' AND n_chars > 500 AND source <> 'src3'")
_filter_query("filter_or", "documents", "doc_id", G("OR", [C("lang", "IN_LIST", ["FR", "de"]), C("n_chars", "LESS_EQUAL", 200)]), "lang IN ('fr', 'de') OR n_chars <= 200")
_filter_query("filter_not", "documents", "doc_id", G("NOT", [C("source", "STARTS_WITH", "SRC1"), C("lang", "EQUALS", "en")]), "NOT starts_with(source, 'src1')")
_filter_query("filter_nested", "documents", "doc_id", G("AND", [G("OR", [C("source", "ENDS_WITH", "7"), C("source", "ENDS_WITH", "3")]), G("NOT", [C("lang", "EQUALS", "en")])]), "(ends_with(source, '7') OR ends_with(source, '3')) AND lang <> 'en'")
_filter_query("filter_regex", "documents", "doc_id", C("text", "REGEX_MATCH", r"LICENSE[ds]?\s+under", "content"), r"regexp_matches(text, '(?i)LICENSE[ds]?\s+under')")
_filter_query("filter_contains", "documents", "doc_id", G("AND", [C("text", "CONTAINS", "THE", "content"), C("text", "NOT_CONTAINS", "reader", "content")]), "contains(lower(text), 'the') AND NOT contains(lower(text), 'reader')")
_filter_query("filter_between", "events", "event_id", C("value", "BETWEEN", [10, 50]), "value BETWEEN 10 AND 50")
_filter_query("filter_in_list", "events", "event_id", C("event_type", "NOT_IN_LIST", ["view", "CLICK"]), "event_type NOT IN ('view', 'click')")
_filter_query("filter_dates", "events", "event_id", C("ts", "BETWEEN", ["2024-01-05T00:00:00", "2024-01-10T12:00:00Z"], "temporal"), "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10 12:00:00'")
_filter_query("filter_day", "events", "event_id", C("ts", "EQUALS", "2024-01-07", "temporal"), "CAST(ts AS DATE) = DATE '2024-01-07'")
_filter_query("filter_null", "events", "event_id", G("OR", [C("value", "IS_NULL", None), C("value", "GREATER_EQUAL", 90)]), "value IS NULL OR value >= 90")
_filter_query("filter_quality", "documents", "doc_id", filters.quality(0.75), "length(text) BETWEEN 50 AND 2000 AND contains(text, '.')")
_filter_query("filter_language", "documents", "doc_id", filters.languages("vi"), f"regexp_matches(lower(text), '[{T._DIACRITICS}]')")


@_query("""SELECT count(*) AS original_count, count(*) FILTER (lang = 'en' AND n_chars > 500) AS filtered_count,
  round(count(*) FILTER (lang = 'en' AND n_chars > 500) / count(*), 6) AS filter_ratio FROM documents""")
def filter_statistics(spark, sf_dir):
    node = G("AND", [C("lang", "EQUALS", "en"), C("n_chars", "GREATER_THAN", 500)])
    return filters.statistics(_table(spark, sf_dir, "documents"), node).select("original_count", "filtered_count", _r("filter_ratio").alias("filter_ratio"))


@_query(r"""SELECT doc_id, round(greatest(0, least(1, 0.5 + CASE WHEN length(text) BETWEEN 50 AND 2000 THEN 0.2 WHEN length(text) < 50 THEN -0.2 ELSE 0 END
  + CASE WHEN contains(text, '.') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '[\n\t]') THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS quality,
  round(CASE WHEN length(text) BETWEEN 100 AND 1000 THEN 1.0 WHEN length(text) < 100 THEN length(text) / 100 ELSE greatest(0.3, 1000 / length(text)) END, 6) AS length_score FROM documents""")
def quality_score(spark, sf_dir):
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", _r(T.quality(t)).alias("quality"), _r(T.length_score(t)).alias("length_score"))


@_query(f"SELECT lang, CASE WHEN regexp_matches(lower(text), '[{T._DIACRITICS}]') THEN 'vi' ELSE 'en' END AS detected, count(*) AS n FROM documents GROUP BY 1, 2")
def language_detect(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("lang", T.language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@_query("SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash, count(*) AS copies FROM documents GROUP BY text")
def dedup_documents(spark, sf_dir):
    hashed = _table(spark, sf_dir, "documents").select("doc_id", kb.file_hash(F.col("text")).alias("file_hash"))
    return hashed.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "file_hash", "copies")


@_query("""SELECT min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL) GROUP BY text""")
def anti_new_docs(spark, sf_dir):
    """Insert-if-absent by content hash: all documents against the stored texts (``benchmark``)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", kb.file_hash(F.col("text")).alias("file_hash"))
    stored = _table(spark, sf_dir, "benchmark").select("item_id", kb.file_hash(F.col("text")).alias("file_hash"))
    return kb.insert_if_absent(docs, stored, ["file_hash"], "doc_id").select("doc_id")


@_query("""SELECT event_type AS entity_type, lower(CAST(user_id AS VARCHAR)) AS normalized_name, CAST(user_id AS VARCHAR) AS name, count(*) AS frequency FROM events GROUP BY 1, 2, 3""")
def entity_frequency(spark, sf_dir):
    mentions = _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("entity_type"), F.col("user_id").cast("string").alias("name"))
    return kb.resolve_entities(mentions).select("entity_type", "normalized_name", "name", "frequency")


@_query("SELECT lang, count(*) AS documents, round(avg(n_chars), 6) AS avg_text_length, CAST(sum(n_chars) AS BIGINT) AS total_text_length FROM documents GROUP BY lang")
def kb_stats_by_lang(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("text_length"))
    return kb.statistics(rows, "lang").withColumn("avg_text_length", _r("avg_text_length"))


@_query("SELECT count(*) AS documents, round(avg(n_chars), 6) AS avg_text_length, CAST(sum(n_chars) AS BIGINT) AS total_text_length FROM documents")
def kb_totals(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("n_chars").alias("text_length"))
    return kb.statistics(rows).withColumn("avg_text_length", _r("avg_text_length"))


@_query("""SELECT d.doc_id AS id, d.lang AS document_type, l.quality AS confidence_score, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS summary
  FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND contains(lower(text), 'the') AND l.quality >= 1 ORDER BY l.quality DESC, n_chars DESC, id LIMIT 20 OFFSET 5""")
def faceted_search_page(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("document_type"), F.col("text").alias("raw_text"), F.col("quality").alias("confidence_score"), F.col("n_chars").alias("created_at"))
    return kb.find(rows, text="the", document_type="en", min_confidence=1, limit=20, offset=5).select("id", "document_type", "confidence_score", "summary")


@_query("SELECT e.vec_id, d.doc_id, d.lang FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.lang IN ('en', 'de')")
def candidate_join(spark, sf_dir):
    emb = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "vec_id")
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "lang", F.col("lang").alias("content_type"))
    return search.candidates(emb, rows, content_types=["en", "de"]).select("vec_id", "doc_id", "lang")


_SENT = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@_query(f"""WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), g AS (SELECT doc_id, unnest(range(0, greatest(1, len(s)), 3)) AS i, s FROM s),
  c AS (SELECT doc_id, i, array_to_string(s[i + 1:i + 3], ' ') AS content FROM g)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, content FROM c WHERE length(content) >= 50""")
def sentence_chunks(spark, sf_dir):
    return chunks.sentence_chunks(_docs(spark, sf_dir)).select("doc_id", "chunk_index", "content")


_WS = r"list_filter(string_split_regex(trim(regexp_replace(s, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


@_query(f"""WITH s AS (SELECT doc_id, text, {_SENT} AS ss FROM documents), n AS (SELECT *, list_transform(ss, lambda s: CAST(len({_WS}) AS DOUBLE)) AS ns FROM s)
  SELECT doc_id, round(CASE WHEN len(ss) <= 1 THEN 1 ELSE greatest(0, least(1, 1 - list_var_pop(ns) / (pow(list_avg(ns), 2) + 1))) END, 6) AS coherence,
   round(CASE WHEN trim(text) = '' THEN 0 ELSE least(1, len(list_filter(ss, lambda s: regexp_matches(s, '[.!?:;]$'))) / nullif(len(ss), 0)
     + CASE WHEN regexp_matches(trim(text), '^\\p{{Lu}}') THEN 0.1 ELSE 0 END) END, 6) AS completeness FROM n""".replace("\\\\p", "\\p"))
def chunk_scores(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", _r(T.coherence(s)).alias("coherence"), _r(T.completeness(F.col("text"), s)).alias("completeness"))


_CX = r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) AS ns FROM documents),
  m AS (SELECT doc_id, coalesce(len(ws) / nullif(ns, 0), 0) AS asl, coalesce(list_sum(list_transform(ws, lambda x: length(x))) / nullif(len(ws), 0), 0) AS awl, CAST(len(ws) AS BIGINT) AS nw, CAST(ns AS BIGINT) AS ns FROM w)"""


@_query(_CX + " SELECT doc_id, round(asl, 6) AS average_sentence_length, round(awl, 6) AS average_word_length, nw AS total_words, ns AS total_sentences FROM m")
def text_complexity(spark, sf_dir):
    m = _docs(spark, sf_dir).select("doc_id", T.complexity(F.col("text"), F.lit(0)).alias("m"))
    return m.select("doc_id", _r("m.average_sentence_length").alias("average_sentence_length"), _r("m.average_word_length").alias("average_word_length"), "m.total_words", "m.total_sentences")


@_query(_CX + " SELECT doc_id, round(greatest(0, least(100, 100 * (1 - (least(asl / 20, 1) + least(awl / 8, 1)) / 3))), 6) AS readability FROM m")
def readability(spark, sf_dir):
    """Without legal terms (none of the fixture's languages has them): density 0."""
    m = _docs(spark, sf_dir).select("doc_id", T.complexity(F.col("text"), F.lit(0)).alias("m"))
    return m.select("doc_id", _r(T.readability(F.col("m"))).alias("readability"))


@_query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  SELECT doc_id, count(*) AS total_lines, count(*) FILTER (regexp_matches(trim(line), '^[IVX]+\.\s*.+$')) AS roman,
   count(*) FILTER (regexp_matches(trim(line), '^\d+\.\s*.+$')) AS numbered, count(*) FILTER (regexp_matches(trim(line), '^[a-z]\)\s*.+$')) AS lettered FROM l GROUP BY doc_id""")
def section_structure(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.structure(F.col("text")).alias("s")).select("doc_id", "s.total_lines", "s.roman", "s.numbered", "s.lettered")


_HYBRID = f"""WITH {_TOKS}, f AS (SELECT doc_id, 0.4 * 0 + 0.2 * (len(list_intersect(list_distinct(t), {_TERMS})) / {float(len(set(_TERMS)))}) + 0.15 * 0.5 + 0.1 * 0.5 + 0.05 * 0.5
   + 0.1 * least(1, 0.5 + CASE WHEN length(text) BETWEEN 50 AND 2000 THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '.') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '[\\n\\t]') THEN 0.1 ELSE 0 END) AS s FROM toks)"""


def _hybrid_rows(spark, sf_dir):
    t = F.col("text")
    half = F.lit(0.5)
    feats = {"semantic": F.lit(0.0), "lexical": rank.lexical_overlap(t, TEXT), "authority": half, "temporal": half, "quality": T.content_quality(t), "engagement": half}
    return _docs(spark, sf_dir).select("doc_id", rank.hybrid(feats).alias("score"))


@_query(_HYBRID + " SELECT doc_id, round(s, 6) AS score FROM f")
def hybrid_rank(spark, sf_dir):
    return _hybrid_rows(spark, sf_dir).withColumn("score", _r("score"))


@_query(_HYBRID + " SELECT doc_id, round(CASE WHEN (SELECT max(s) > min(s) FROM f) THEN (s - (SELECT min(s) FROM f)) / ((SELECT max(s) FROM f) - (SELECT min(s) FROM f)) ELSE s END, 6) AS score FROM f")
def minmax_scores(spark, sf_dir):
    return rank.min_max(_hybrid_rows(spark, sf_dir), "score").withColumn("score", _r("score"))


@_query()
def mmr_rerank(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    texts = _table(spark, sf_dir, "documents").select("doc_id", "text")
    best = rank.top_k(rank.bm25(docs, TEXT), 20).join(texts, "doc_id").withColumn("query_id", F.lit(0))
    return rank.mmr(best, "query_id", "doc_id", "score", "text")


_RANKED = "ranked AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50)"


@_query(f"""WITH {_RANKED}, truth AS (SELECT d.lang AS query_id, d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
  m AS (SELECT r.*, CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM ranked r LEFT JOIN truth t ON r.query_id = t.query_id AND r.doc_id = t.doc_id),
  p AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) / rank AS prec FROM m), size AS (SELECT query_id, count(*) AS n FROM truth GROUP BY query_id)
  SELECT p.query_id, round(sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / count(*) FILTER (rank <= 10), 6) AS precision_at_k, round(sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / any_value(n), 6) AS recall_at_k,
   round(sum(CASE WHEN rank <= 10 AND rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) / any_value(list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg_at_k,
   round(sum(CASE WHEN rel = 1 THEN prec ELSE 0 END) / any_value(n), 6) AS average_precision FROM p JOIN size USING (query_id) GROUP BY p.query_id""")
def ndcg_map(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumnRenamed("lang", "query_id")
    ranked = rank.top_k(docs.select("query_id", "doc_id", "n_chars"), 50, "n_chars", per=["query_id"])
    truth = docs.join(_table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("query_id", "doc_id")
    out = rank.ir_metrics(ranked, truth)
    return out.select("query_id", *(_r(c).alias(c) for c in ("precision_at_k", "recall_at_k", "ndcg_at_k", "average_precision")))


@_query("SELECT feature, round(avg(v * quality), 6) AS weight FROM (SELECT quality, unnest(['n_chars', 'toxic']) AS feature, unnest([CAST(n_chars AS DOUBLE), CAST(toxic AS DOUBLE)]) AS v FROM documents JOIN labels USING (doc_id)) GROUP BY feature")
def ltr_weights(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return rank.learn_weights(rows, ["n_chars", "toxic"], "quality").withColumn("weight", _r("weight"))


@_query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3 AND role <> 'system'")
def last_n_messages(spark, sf_dir):
    return sessions.last_n(_table(spark, sf_dir, "conversations"), 3, include_system=False).select("conv_id", "turn", "role", "text")


_SUM = """n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
  sums AS (SELECT conv_id, substr(string_agg(role || ': ' || substr(text, 1, 100), ' | ' ORDER BY i), 1, 500) AS summary FROM n WHERE n <= 4 OR i <= 2 OR i > n - 2 GROUP BY conv_id)"""


@_query(f"WITH {_SUM} SELECT conv_id, summary FROM sums")
def conversation_summary(spark, sf_dir):
    return sessions.summaries(_table(spark, sf_dir, "conversations"))


@_query(f"""WITH {_SUM} SELECT conv_id, turn, role, text FROM n WHERE n <= 4 OR i > n - 2
  UNION ALL SELECT conv_id, -1, 'system', summary FROM sums WHERE conv_id IN (SELECT conv_id FROM n WHERE n > 4)""")
def context_compress(spark, sf_dir):
    return sessions.compress(_table(spark, sf_dir, "conversations"), longest=4, keep=2)


@_query("SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def session_totals(spark, sf_dir):
    return sessions.totals(_table(spark, sf_dir, "conversations"))


@_query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS requests FROM events""")
def rolling_60s_requests(spark, sf_dir):
    return sessions.rolling_requests(_table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "requests")


@_query(f"""WITH m AS (SELECT conv_id * 1000 + turn AS id, text AS content, CAST(1 + (conv_id + turn) % 5 AS BIGINT) AS importance, CAST(conv_id % 28 AS INTEGER) AS d, turn FROM conversations
    WHERE role <> 'system' AND contains(lower(text), 'the') ORDER BY importance DESC, DATE '2024-01-01' + CAST(conv_id % 28 AS INTEGER) DESC, id LIMIT 50)
  SELECT id, round(0.5 * (CASE WHEN list_contains(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'), 'the') THEN 1 ELSE 0 END) + importance / 5
   + greatest(0, 0.2 - 0.01 * (DATE '{AS_OF}' - (DATE '2024-01-01' + d))) + least(turn / 10, 0.2), 6) AS score FROM m""")
def memory_recall(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations")
    rows = t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), (F.lit(1) + (F.col("conv_id") + F.col("turn")) % 5).alias("importance"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 28).cast("int")).alias("timestamp"), F.when(F.col("role") == "system", "archived").otherwise("active").alias("status"),
        F.array(F.col("role")).alias("tags"), F.col("turn").alias("access_count"), F.lit("conversation").alias("memory_type"),
    )
    return sessions.recall(rows, "the", F.lit(AS_OF).cast("date")).select("id", _r("score").alias("score"))


_HIT = lambda words: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)


def _best_sql(tables: dict, default: str) -> str:
    most = "greatest(" + ", ".join(_HIT(w) for w in tables.values()) + ")"
    return f"CASE WHEN {most} = 0 THEN '{default}' " + " ".join(f"WHEN ({_HIT(w)}) = {most} THEN '{k}'" for k, w in tables.items()) + " END"


@_query(f"SELECT conv_id, turn, {_best_sql(query.TASKS, 'legal_research')} AS task, {_best_sql(query.JURISDICTIONS, 'vietnam')} AS jurisdiction FROM conversations")
def task_analysis(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", query.analyse(F.col("text")).alias("a"))
    return rows.select("conv_id", "turn", "a.task", "a.jurisdiction")


@_query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
  e AS (SELECT event_type, k, CAST(value AS DOUBLE) AS v FROM o WHERE k = 1 UNION ALL SELECT o.event_type, o.k, e.v * 0.9 + o.value * 0.1 FROM e JOIN o ON o.event_type = e.event_type AND o.k = e.k + 1)
  SELECT event_type, round(arg_max(v, k), 6) AS ema FROM e GROUP BY event_type""")
def ema_by_type(spark, sf_dir):
    return sessions.ema(_table(spark, sf_dir, "events").where("value is not null"), "event_type", "event_id", "value").withColumn("ema", _r("ema"))


@_query("SELECT count(*) AS queries, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_rate FROM events")
def cache_hit_rate(spark, sf_dir):
    return sessions.hit_rate(_table(spark, sf_dir, "events"), F.col("event_type") == "view").withColumn("hit_rate", _r("hit_rate"))


@_query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def orders_by_nation(spark, sf_dir):
    o, c, n = (_table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    per = o.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("t"))
    joined = per.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("k").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


from . import more  # noqa: E402, F401 - registers its queries here
