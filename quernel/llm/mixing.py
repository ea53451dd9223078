"""Temperature mixing of sources, realised as block permutations within a token budget.

Source shares p become weights p^a / sum p^a. The exponent a is bisected in
[0, 1] so that the weights' entropy comes down to a target, or no source is
repeated more than a limit allows. A source's documents fall into hash blocks of
about ``block_tokens``; each epoch permutes the blocks. All epochs but the last
are whole; the last takes blocks while its part of the budget lasts, and of the
block where it runs out the documents that still fit. Only block totals are
sorted, never a source's documents, so a hot source has no hot task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, small

SEED, BLOCK_TOKENS, MAX_REPEAT, STEPS = "mix", 65536, 3.0, 60


def weights(totals: np.ndarray, a: float) -> np.ndarray:
    shares = totals / totals.sum()
    powered = np.where(shares > 0, np.power(shares, a, where=shares > 0, out=np.zeros_like(shares)), 0.0)
    return powered / powered.sum()


def solve(totals, max_repeat: float | None = None, entropy: float | None = None, budget: int | None = None, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """The exponent, and how often each source is shown (1.5: once and a half).

    The least exponent (nearest to equal weights) at which no source is shown
    more than ``max_repeat`` times and the entropy is at most ``entropy`` (nats);
    1 (the sources' own shares) if none suffices. Without a budget it is the
    least that shows every source whole. Sources without tokens are shown once.
    Rounded to 9 digits, so that the last bit of a power never decides about a document.
    """
    totals = np.asarray(totals, dtype=np.float64)
    full = totals > 0
    if not full.any():
        return 1.0, np.ones(len(totals))

    def shown(a: float) -> np.ndarray:
        per_token = np.divide(weights(totals, a), totals, where=full, out=np.zeros_like(totals))
        return per_token * budget if budget is not None else per_token / per_token[full].min()

    def suits(a: float) -> bool:
        w = weights(totals, a)[full]
        return (max_repeat is None or shown(a)[full].max() <= max_repeat) and (entropy is None or float(-(w * np.log(w)).sum()) <= entropy)

    low, high = 0.0, 1.0
    if suits(0.0):
        high = 0.0
    for _ in range(steps if high else 0):
        middle = (low + high) / 2
        low, high = (low, middle) if suits(middle) else (middle, high)
    return high, np.where(full, np.round(shown(high), 9), 1.0)


def _hex(text: Column) -> Column:
    """The first 8 hexadecimal digits as a number."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def n_tokens(text: Column) -> Column:
    """White-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def schedule(docs: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> tuple[DataFrame, int]:
    """Blocks to show in each epoch, and how many rows they are.

    Rows: src (source key), n_blocks, block, epoch, before and total (tokens of the
    epochs and blocks before, and of all that is shown of the source), tokens,
    and cut: null for a whole block, else the last in-block key that is in.
    """
    spark = docs.sparkSession
    slim = materialise(docs.select(_key(F.col("source")).alias("src"), _id(F.col("doc_id")).alias("id"), n_tokens(F.col("text")).alias("n")), "lengths")
    sources = slim.groupBy("src").agg(F.sum("n").alias("total")).orderBy("src").toPandas()
    if not len(sources):
        return spark.createDataFrame([], "src string, n_blocks long, block long, epoch int, before double, total double, tokens long, cut string"), 0
    totals = sources["total"].to_numpy(dtype=np.int64)
    _, shown = solve(totals, max_repeat, entropy, budget)
    rows = [(s, int(t), max(1, math.ceil(t / block_tokens)), float(r)) for s, t, r in zip(sources["src"], totals, shown)]
    plan = spark.createDataFrame(rows, "src string, source_tokens long, n_blocks long, shown double")
    plan = small(plan, len(rows))
    at = slim.join(plan, "src").withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "id"))).withColumn("block", F.pmod(_hex(F.col("h")), F.col("n_blocks")))
    blocks = at.groupBy("src", "block", "n_blocks", "source_tokens", "shown").agg(F.sum("n").alias("tokens"))
    epochs = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("shown").cast("int") - 1, F.lit(0)))))
    # Prefix sums in two levels, so that no task sorts all blocks of a source: totals of 4,096 ranges of the order, then inside each range.
    epochs = epochs.withColumn("o", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "src", "block"))).withColumn("range", F.substring("o", 1, 3))
    until = Window.partitionBy("src", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = epochs.groupBy("src", "epoch", "range").agg(F.sum("tokens").alias("all")).withColumn("earlier", F.coalesce(F.sum("all").over(until), F.lit(0)))
    order = Window.partitionBy("src", "epoch", "range").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, 0)
    epochs = epochs.join(ranges.drop("all"), ["src", "epoch", "range"]).withColumn("done", F.col("earlier") + F.sum("tokens").over(order)).drop("o", "range", "earlier")
    left = F.col("shown") * F.col("source_tokens") - F.col("epoch") * F.col("source_tokens")
    epochs = epochs.withColumn("left", left).where((F.col("source_tokens") == 0) | (F.col("done") - F.col("tokens") < F.col("left")))
    epochs = materialise(epochs, "blocks")
    broken = epochs.where("done > left").select("src", "block", "epoch", (F.col("left") - F.col("done") + F.col("tokens")).alias("room"))
    inner = F.md5(F.concat_ws(":", F.lit(seed), "epoch", "id"))
    fit = Window.partitionBy("src", "epoch").orderBy("inner").rangeBetween(Window.unboundedPreceding, 0)
    cuts = (
        at.select("src", "block", "id", "n").join(small(broken, len(rows)), ["src", "block"]).withColumn("inner", inner)
        .withColumn("run", F.sum("n").over(fit)).groupBy("src", "block", "epoch")
        .agg(F.coalesce(F.max(F.when(F.col("run") <= F.col("room"), F.col("inner"))), F.lit("")).alias("cut"))
    )
    out = epochs.join(cuts, ["src", "block", "epoch"], "left").select(
        "src", "n_blocks", "block", F.col("epoch").cast("int").alias("epoch"),
        (F.col("epoch") * F.col("source_tokens") + F.col("done") - F.col("tokens")).cast("double").alias("before"),
        (F.col("shown") * F.col("source_tokens")).alias("total"), "tokens", "cut",
    )
    out = materialise(out, "schedule")
    discard(slim, epochs)
    return out, out.count()


def _shown(docs: DataFrame, blocks: DataFrame, n: int, seed: str) -> DataFrame:
    """``docs`` joined to the blocks that show them; adds __s (the block's row), __id and __inner."""
    counts = blocks.groupBy("src").agg(F.max("n_blocks").alias("n_blocks"))
    keyed = docs.withColumn("__src", _key(F.col("source"))).withColumn("__id", _id(F.col("doc_id")))
    sizes = counts.select(F.col("src").alias("__src"), F.col("n_blocks").alias("__of"))
    keyed = keyed.join(small(sizes, n), "__src").withColumn("__block", F.pmod(_hex(F.md5(F.concat_ws(":", F.lit(seed), "__id"))), F.col("__of")))
    rows = blocks.select(F.col("src").alias("__src"), F.col("block").alias("__block"), F.struct("epoch", "before", "total", "tokens", "cut").alias("__s"))
    shown = keyed.join(small(rows, n), ["__src", "__block"]).withColumn("__inner", F.md5(F.concat_ws(":", F.lit(seed), F.col("__s.epoch"), "__id")))
    return shown.where(F.col("__s.cut").isNull() | (F.col("__inner") <= F.col("__s.cut")))


def _place() -> Column:
    """How far through its source's budget a shown row stands, 0 to 1; 0 for a source without tokens."""
    where = F.col("__s.before") + _hex(F.col("__inner")) / F.lit(float(1 << 32)) * F.col("__s.tokens")
    return F.when(F.col("__s.total") > 0, where / F.nullif(F.col("__s.total"), F.lit(0.0))).otherwise(F.lit(0.0))


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mixed order: doc_id, source, n_tokens, epoch, block, mix_key; a row for each time a document is shown.

    Sorted by mix_key (0 to 1 through every source's budget) sources interleave at
    their weights. A null source is a source of its own; a null or blank text has
    0 tokens and is shown with its block; a null doc_id hashes as 'null'. A text's
    length matters only to the sums. Repeated rows stay together. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "source", "text")
    blocks, n = schedule(docs, seed=seed, **options)
    shown = _shown(docs, blocks, n, seed)
    return shown.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), F.col("__s.epoch").alias("epoch"), F.col("__block").alias("block"), F.round(_place(), 9).alias("mix_key"))


def realise(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """Rows of ``docs``, all columns, as often as the mix shows them and sorted by the mixed order, so sources interleave and a document's copies stand an epoch apart.

    Written as Parquet, the files in order of their numbers, and the rows of each, are in this order.
    """
    blocks, n = schedule(docs, seed=seed, **options)
    shown = _shown(docs, blocks, n, seed).withColumn("__place", _place()).withColumn("__row", F.monotonically_increasing_id())
    return shown.orderBy("__place", "__inner", F.xxhash64("text"), "__row").select(*docs.columns)


#: DuckDB twin of ``mix`` with the defaults above.
SQL = r"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id,
         CAST(coalesce(len(regexp_extract_all(text, '\S+')), 0) AS BIGINT) AS n
  FROM documents),
sources AS (SELECT src, CAST(sum(n) AS DOUBLE) AS t FROM slim GROUP BY src),
shares AS (SELECT src, t, t / (SELECT sum(t) FROM sources) AS p FROM sources WHERE t > 0),
bisect AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS low,
         CASE WHEN (SELECT max(1 / t) / min(1 / t) FROM shares) <= {r} THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS high
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT step, low, high, (low + high) / 2 AS mid,
               (SELECT max(pow(p, (low + high) / 2) / t) / min(pow(p, (low + high) / 2) / t) FROM shares) <= {r} AS ok
        FROM bisect WHERE step < {steps} AND high > 0)),
exponent AS (SELECT arg_max(high, step) AS a FROM bisect),
plan AS (
  SELECT s.src, s.t AS source_tokens, greatest(1, CAST(ceil(s.t / {bt}) AS BIGINT)) AS n_blocks,
         CASE WHEN s.t = 0 THEN 1.0 ELSE
           round((pow(h.p, (SELECT a FROM exponent)) / h.t) / (SELECT min(pow(p, (SELECT a FROM exponent)) / t) FROM shares), 9) END AS shown
  FROM sources s LEFT JOIN shares h USING (src)),
placed AS (
  SELECT d.*, p.source_tokens, p.shown,
         CAST('0x' || substr(md5('{seed}:' || id), 1, 8) AS BIGINT) % n_blocks AS block
  FROM slim d JOIN plan p USING (src)),
blocks AS (SELECT src, block, any_value(source_tokens) AS source_tokens, any_value(shown) AS shown, sum(n) AS tokens FROM placed GROUP BY src, block),
epochs AS (SELECT b.*, unnest(range(0, greatest(1, CAST(ceil(shown) AS BIGINT)))) AS epoch FROM blocks b),
running AS (
  SELECT *, sum(tokens) OVER (PARTITION BY src, epoch ORDER BY md5('{seed}:' || epoch || ':' || src || ':' || block), block
                              ROWS UNBOUNDED PRECEDING) AS done,
         shown * source_tokens - epoch * source_tokens AS room
  FROM epochs),
taken AS (SELECT * FROM running WHERE source_tokens = 0 OR done - tokens < room),
inside AS (
  SELECT a.doc_id, a.source, a.n, t.epoch, a.block, t.done, t.tokens, t.room, t.shown, t.source_tokens,
         md5('{seed}:' || t.epoch || ':' || a.id) AS ink, t.src
  FROM placed a JOIN taken t ON a.src = t.src AND a.block = t.block),
cut AS (
  SELECT *, sum(n) OVER (PARTITION BY src, epoch, block ORDER BY ink RANGE UNBOUNDED PRECEDING) AS run FROM inside)
SELECT doc_id, source, n AS n_tokens, CAST(epoch AS INTEGER) AS epoch, block,
       round(CASE WHEN source_tokens > 0
         THEN (epoch * source_tokens + done - tokens + CAST('0x' || substr(ink, 1, 8) AS BIGINT) / 4294967296.0 * tokens) / (shown * source_tokens)
         ELSE 0 END, 9) AS mix_key
FROM cut WHERE done <= room OR source_tokens = 0 OR run <= room - (done - tokens)
""".format(r=MAX_REPEAT, steps=STEPS, bt=BLOCK_TOKENS, seed=SEED)
