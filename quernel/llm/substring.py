"""Substring dedup: sliding spans of several consecutive sentences.

From every sentence on, the run of ``SPAN`` consecutive sentences, or of as many more as it
takes to have ``MIN_WORDS`` words, is hashed; the hashes are joined over
the whole corpus, and every sentence that lies in a repeated span other than
the span's first occurrence is removed. A batch already knows which of its own
occurrences can't be first, so only one row for each batch and hash goes into
the global join, and a passage that all documents share makes no hot key.

Texts without stops, and long sentences, are cut after certain words, told by the
words themselves and not by their place, so a passage is cut alike wherever it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import discard, materialise, slices

SPAN, LONGEST, MIN_WORDS, ANCHOR = 3, 8, 24, 4
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 12, 13, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SALT = textvec.mix(np.arange(101, 101 + 64, dtype=np.uint64))


def sentences(column, longest: int = LONGEST):
    """Of each text: first byte, hash and words of every sentence, and how many sentences come before each text.

    A sentence ends with a word (run of non-space) that ends in . ! or ?, and before
    a line break. Of more than ``longest`` words it is cut after every word whose last
    byte and number of bytes add up to a multiple of ``ANCHOR``, or that repeats the word before. Hashes fold ASCII case and read
    any white space between words alike.
    """
    data, ends = textvec.buffers(column)
    starts, stops = textvec.runs(~_SPACE[data], ends)
    n = len(starts)
    counts = np.searchsorted(starts, ends)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), counts, ends
    lines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    first = np.zeros(n, dtype=bool)
    first[1:] = _STOP[data[stops[:-1] - 1]] | (lines[starts[1:]] > lines[stops[:-1]])
    first[counts[:-1][counts[:-1] < n]] = True
    at = np.flatnonzero(first)
    sizes = np.diff(np.append(at, n))
    words = textvec.Spans(_FOLD[data]).hash(starts, stops)
    again = np.zeros(n, dtype=bool)
    again[1:] = words[1:] == words[:-1]
    again[counts[:-1][counts[:-1] < n]] = False
    anchor = again | ((_FOLD[data[stops - 1]].astype(np.int64) + stops - starts) % ANCHOR == 0)
    first[1:] |= anchor[:-1] & np.repeat(sizes > longest, sizes)[1:]
    begin = np.flatnonzero(first)
    sizes = np.diff(np.append(begin, n))
    place = np.arange(n) - np.repeat(begin, sizes)
    sums = np.add.reduceat(textvec.mix(words ^ _SALT[place % 64] + (place // 64).astype(np.uint64)), begin)
    return starts[begin], textvec.mix(sums + sizes.astype(np.uint64)), sizes, np.searchsorted(begin, counts), ends


def _stops(sizes: np.ndarray, counts: np.ndarray, span: int, min_words: int) -> np.ndarray:
    """Where the span from each sentence on ends (the sentence after it); 0 where its text ends before."""
    n = len(sizes)
    words = np.concatenate([[0], np.cumsum(sizes)])
    to = np.maximum(np.arange(n) + span, np.searchsorted(words, words[:-1] + min_words))
    return np.where(to <= np.repeat(counts[1:], np.diff(counts)), to, 0)


def _spans(docs: DataFrame, span: int, longest: int, min_words: int) -> DataFrame:
    """h, doc_id, x (digest of the text), pos, first (whether it may be the first occurrence of all)."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            _, hashes, sizes, counts, _ = sentences(b.column("text"), longest)
            n = len(hashes)
            if n < span:
                continue
            to = _stops(sizes, counts, span, min_words)
            keep = np.flatnonzero(to)
            power, inverse = textvec.powers(n + 1)
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(textvec.mix(hashes) * power[:n], dtype=np.uint64)])
            h = textvec.mix((sums[to[keep]] - sums[keep]) * inverse[keep] + (to[keep] - keep).astype(np.uint64))
            doc = np.repeat(np.arange(len(counts) - 1), np.diff(counts))[keep]
            pos = keep - counts[doc]
            ids = b.column("doc_id")
            low = ids.is_null().to_numpy(zero_copy_only=False)[doc], ids.fill_null(0).to_numpy()[doc], b.column("x").to_numpy()[doc]
            order = np.lexsort((pos, low[2], low[1], low[0], h))
            first = np.ones(len(order), dtype=bool)
            first[1:] = h[order][1:] != h[order][:-1]
            mine = np.empty(len(order), dtype=bool)
            mine[order] = first
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), ids.take(pa.array(doc)), b.column("x").take(pa.array(doc)), pa.array(pos, pa.int32()), pa.array(mine)],
                names=["h", "doc_id", "x", "pos", "first"],
            )

    return docs.mapInArrow(run, "h long, doc_id long, x long, pos int, first boolean")


def dedup(docs: DataFrame, span: int = SPAN, longest: int = LONGEST, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without sentences that non-first repeated spans cover.

    Occurrences are in order of doc_id (null last), then place. With ``counts``
    the columns are doc_id, text, n_sentences, n_removed. Kept sentences stay byte for byte; each
    takes along the white space after it. Texts of under ``min_words`` words or
    ``span`` sentences are left alone. A text may become empty; null and
    empty texts stay. A text's length only costs time. Rows alike in doc_id and text count as one document, each
    kept with the same text. An empty table gives an empty one.
    """
    digest = F.xxhash64("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("x")).where(F.col("text").isNotNull())
    found = materialise(_spans(keyed, span, longest, min_words), "spans")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "x", "pos")
    least = F.min(place).over(Window.partitionBy("h"))
    later = found.where("first").withColumn("least", least).where(place != F.col("least")).select("doc_id", "x", "pos")
    later = later.unionByName(found.where("not first").select("doc_id", "x", "pos"))
    cut = materialise(later.groupBy("doc_id", "x").agg(F.collect_set("pos").alias("__cut")), "cut")
    discard(found)
    cut = cut.select(F.col("doc_id").alias("__doc"), F.col("x").alias("__x"), "__cut")
    mine = docs if not counts else docs.select("doc_id", "text")
    left = mine.withColumn("__key", digest)
    joined = left.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__x")), "left").select(*mine.columns, "__cut")
    fields = list(mine.schema.fields)
    if counts:
        fields += [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]
    names = list(mine.columns)

    def remove(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            column = b.column("text")
            cuts = b.column("__cut")
            starts, _, sizes, before, ends = sentences(column, longest)
            data, _ = textvec.buffers(column)
            edges = np.zeros(len(starts) + 1, dtype=np.int64)
            lists = cuts.offsets.to_numpy().astype(np.int64)
            which = np.repeat(np.arange(len(b)), np.diff(lists))
            at = cuts.values.to_numpy()[lists[0] : lists[-1]].astype(np.int64) + before[which]
            np.add.at(edges, at, 1)
            np.add.at(edges, _stops(sizes, before, span, min_words)[at], -1)
            gone = np.cumsum(edges[:-1]) > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(before[:-1], len(gone))) * (np.diff(before) > 0) if len(b) else np.zeros(0, dtype=np.int64)
            stops = np.append(starts[1:], len(data))
            last = before[1:][np.diff(before) > 0] - 1
            stops[last] = ends[1:][np.diff(before) > 0]
            raw = data.tobytes()
            valid = ~column.is_null().to_numpy(zero_copy_only=False)
            texts = []
            for i in range(len(b)):
                lo, hi = int(ends[i]), int(ends[i + 1])
                if not valid[i]:
                    texts.append(None)
                elif not removed[i]:
                    texts.append(raw[lo:hi])
                else:
                    a, z = before[i], before[i + 1]
                    kept = np.flatnonzero(~gone[a:z]) + a
                    texts.append(raw[lo : starts[a]] + b"".join([raw[p:q] for p, q in zip(starts[kept].tolist(), stops[kept].tolist())]))
            out = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else b.column(c) for c in names]
            if counts:
                out += [pa.array(np.diff(before), pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return joined.mapInArrow(remove, T.StructType(fields))


#: DuckDB twin of ``dedup`` with ``counts``: compares the sentences themselves, no hashes.
SQL = r"""
WITH tok AS (
  SELECT doc_id, i, list[i] AS tk, translate(regexp_replace(list[i], '[ \t\n\f\r]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
  FROM (SELECT doc_id, list, unnest(range(1, len(list) + 1)) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\f\r]+[ \t\n\f\r]*') AS list FROM documents))),
flagged AS (
  SELECT *, CASE WHEN regexp_matches(lag(tk) OVER w, '[.!?][ \t\n\f\r]*$') OR contains(lag(tk) OVER w, chr(10)) THEN 1 ELSE 0 END AS b,
         CASE WHEN (unicode(right(lag(word) OVER w, 1)) + strlen(lag(word) OVER w)) % {anchor} = 0 OR lag(word, 1) OVER w = lag(word, 2) OVER w THEN 1 ELSE 0 END AS after_anchor
  FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
segments AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS seg FROM flagged),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, seg) AS seg_words, row_number() OVER (PARTITION BY doc_id, seg ORDER BY i) AS k FROM segments),
placed AS (
  SELECT *, sum(CASE WHEN k > 1 AND seg_words > {longest} THEN after_anchor ELSE 0 END) OVER (PARTITION BY doc_id, seg ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM sized),
sent AS (
  SELECT doc_id, seg, part, count(*) AS words, string_agg(tk, '' ORDER BY i) AS raw, string_agg(word, ' ' ORDER BY i) AS norm
  FROM placed GROUP BY doc_id, seg, part),
numbered AS (
  SELECT *, row_number() OVER w AS pos, sum(words) OVER (w ROWS UNBOUNDED PRECEDING) - words AS before FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY seg, part)),
spans AS (
  SELECT a.doc_id, a.pos, count(*) AS n, string_agg(b.norm, chr(1) ORDER BY b.pos) AS span, sum(b.words) AS words
  FROM (SELECT doc_id, pos, before, unnest(range(pos, pos + {most})) AS other FROM numbered) a JOIN numbered b ON a.doc_id = b.doc_id AND a.other = b.pos
  WHERE b.pos < a.pos + {span} OR b.before - a.before < {least} GROUP BY a.doc_id, a.pos),
later AS (SELECT doc_id, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, pos) AS k FROM spans WHERE n >= {span} AND words >= {least}) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM later),
kept AS (
  SELECT n.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN raw ELSE '' END, '' ORDER BY n.pos) AS body, count(*) AS n_sentences, count(g.pos) AS n_removed
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE regexp_extract(d.text, '^[ \t\n\f\r]*') || k.body END AS text,
       coalesce(k.n_sentences, 0) AS n_sentences, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""".replace("{longest}", str(LONGEST)).replace("{least}", str(MIN_WORDS)).replace("{span}", str(SPAN)).replace("{anchor}", str(ANCHOR)).replace("{most}", str(max(SPAN, MIN_WORDS)))
