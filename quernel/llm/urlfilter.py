"""URL filters: host-suffix and path-prefix expressions, matched by digest.

Every URL becomes all its expressions: each suffix of the host (down to two
labels) with each prefix of the path, and with path and query. Rules are such
expressions too. A short prefix of the SHA-256 digest is the join key, so the
lookup table stays a few bytes a rule; a hit counts only if the whole digest
agrees. Of the rules that hit, the most specific decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

PREFIX = 8  # hexadecimal digits of the join key

#: Rules that ship with the operator: (expression, action, priority).
RULES = [
    ("cheap-pills.example.com/", "block", 0), ("spam-farm.example.org/", "block", 0), ("example.net/es/", "block", 0),
    ("blog.example.net/", "allow", 0), ("example.org/fr/", "review", 0), ("example.com/de/", "review", 0),
    ("www.spam-farm.example.org/en/", "review", 5), ("example.org/en/671", "block", 0), ("example.com/?page=2&ref=x", "block", 0),
    ("tionsh.example.net/", "allow", 0), ("blog.tionsh.example.net/es/", "block", 1), ("blog.tionsh.example.net/es/533/", "allow", 1),
    ("ththan.example.net/en/", "review", 0), ("ththan.example.net/en/", "allow", 0), ("ththan.example.net/en/369", "block", 0),
]


def _parts(url: Column) -> dict[str, Column]:
    """Host (lower case, no user, port, or dots at the ends), path (from '/', no fragment) and query ('' if none)."""
    plain = F.regexp_replace(F.trim(url), r"[\t\r\n]", "")
    rest = F.regexp_replace(F.regexp_replace(plain, "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    rest = F.regexp_replace(rest, "^/+", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^\.+|\.+$", ""), r"\.\.+", ".")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "/+", "/")
    return {"host": host, "path": path, "query": F.regexp_extract(rest, r"(\?.*)$", 1)}


def canonical(url: Column) -> Column:
    """Host, path and query as one expression: what a rule names."""
    p = _parts(url)
    return F.concat(p["host"], p["path"], p["query"])


def expressions(urls: DataFrame, url: str, *keep: str) -> DataFrame:
    """A row for each expression of each row: ``keep``, expr, host_len, path_len. No number of labels or folders is too many."""
    p = _parts(F.col(url))
    parts = urls.select(*keep, p["host"].alias("__host"), p["path"].alias("__path"), p["query"].alias("__query")).where(F.col("__host") != "")
    number = F.col("__host").rlike(r"^[0-9.]+$|^\[.*\]$")
    labels = F.split("__host", r"\.")
    n = F.size(labels)
    suffixes = F.when(number | (n < 3), F.array("__host")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))
    steps = F.split("__path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.when(i == F.size(steps), F.col("__path")).otherwise(F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))))
    paths = F.array_distinct(F.concat(prefixes, F.array(F.concat("__path", "__query"))))
    hosts = parts.select(*keep, F.explode(suffixes).alias("__h"), paths.alias("__paths"))
    both = hosts.select(*keep, "__h", F.explode("__paths").alias("__p"))
    return both.select(*keep, F.concat("__h", "__p").alias("expr"), F.length("__h").alias("host_len"), F.length("__p").alias("path_len"))


def rules_table(rules: DataFrame) -> DataFrame:
    """``rules`` (expr, action, priority) with canonical expr, digest and its short prefix; null expr or action dropped, repeats merged."""
    full = rules.where("expr is not null and action is not null").select(canonical(F.col("expr")).alias("rule"), "action", F.coalesce(F.col("priority"), F.lit(0)).cast("int").alias("priority")).distinct()
    digest = F.sha2("rule", 256)
    return full.select(digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("short"), "rule", "action", "priority")


def decide(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """The deciding rule of each row: key, url, action, rule, n_rules; action 'none' (rule null, n_rules 0) where no rule hits.

    Precedence: higher priority, longer host, longer path, then allow before
    review before block, then rule by name. A null, empty or host-less URL hits
    nothing. Repeated rows are decided alike, each kept: rows are told
    apart by nothing but their values, so equal rows get equal answers. Empty
    tables are allowed on either side. Other columns are not read.
    """
    base = urls.select(F.col(key).alias("__key"), F.col(url).alias("__url"))
    table = rules_table(rules)
    table = small(table, table.count(), wide=96)
    once = base.where(F.col("__url").isNotNull()).select("__url").distinct()
    exprs = expressions(once, "__url", "__url")
    digest = F.sha2("expr", 256)
    looked = exprs.select("__url", "host_len", "path_len", digest.alias("__digest"), F.substring(digest, 1, PREFIX).alias("short"))
    hits = looked.join(table, "short").where(F.col("__digest") == F.col("digest"))
    rank = F.when(F.col("action") == "allow", 0).when(F.col("action") == "review", 1).when(F.col("action") == "block", 2).otherwise(3)
    order = F.struct(-F.col("priority"), -F.col("host_len"), -F.col("path_len"), rank, "rule", "action")
    best = hits.groupBy("__url").agg(F.min(order).alias("__best"), F.count("*").alias("n_rules"))
    return base.join(best, "__url", "left").select(
        F.col("__key").alias(key), F.col("__url").alias(url), F.coalesce(F.col("__best.action"), F.lit("none")).alias("action"),
        F.col("__best.rule").alias("rule"), F.coalesce(F.col("n_rules"), F.lit(0)).cast("long").alias("n_rules"),
    )


_VALUES = ", ".join(f"('{e}', '{a}', {p})" for e, a, p in RULES)
#: DuckDB twin: matches rules by string comparison with the parts of each URL, without digests.
SQL = rf"""
WITH rules(expr, action, priority) AS (VALUES {_VALUES}),
raw AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^/+', '') AS rest FROM pages),
parts AS (
  SELECT page_id, url, lower(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
         CASE WHEN regexp_extract(rest, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?]*([^?]*)', 1) END AS path,
         regexp_extract(rest, '(\?.*)$', 1) AS query FROM raw),
rule_parts AS (SELECT DISTINCT expr AS rule, action, priority, regexp_extract(expr, '^([^/]*)', 1) AS rhost, regexp_extract(expr, '^[^/]*(/.*)$', 1) AS rpath FROM rules),
hits AS (
  SELECT p.page_id, p.url, r.*, length(rhost) AS hl, length(rpath) AS pl,
         CASE action WHEN 'allow' THEN 0 WHEN 'review' THEN 1 WHEN 'block' THEN 2 ELSE 3 END AS ar
  FROM parts p JOIN rule_parts r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost))
   AND (r.rpath = p.path OR r.rpath = p.path || p.query OR (ends_with(r.rpath, '/') AND starts_with(p.path, r.rpath)))),
best AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS n,
         row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, hl DESC, pl DESC, ar, rule, action) AS k FROM hits)
SELECT p.page_id, p.url, coalesce(b.action, 'none') AS action, b.rule, CAST(coalesce(b.n, 0) AS BIGINT) AS n_rules
FROM pages p LEFT JOIN best b ON p.page_id = b.page_id AND b.k = 1
"""
