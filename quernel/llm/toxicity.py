"""Toxicity: a factorization machine over hashed terms.

score = bias + sum of weights of a document's terms + sum over pairs of terms of
the inner product of their factors. The pairwise part learns that terms are
worse together (an insult with the mention of a group) than each alone. Terms
are 64-bit hashes of a document's distinct words and of the words' first bytes,
so inflected and coined forms share terms with their stems.

Fitting has two steps. The first takes terms that are more or less frequent in
toxic rows than in all. Where its scores don't tell all held-out rows apart, the second goes on
from there with the most frequent terms beside, whatever their evidence, so words that
are harmless alone and toxic together, or the reverse, get factors too; of both
models the one of greater F1 on the held-out rows is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import bounded, discard, materialise, slices, small

PREFIXES, FACTORS, MIN_ROWS, EPOCHS, EVIDENCE, MAX_TRAIN_ROWS, WIDE = (3, 4, 5), 4, 3, 12, 4.0, 20_000, 10_000
_SALTS = textvec.mix(np.arange(11, 31, dtype=np.uint64))


def terms(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each (lower-case) text, and where each text's begin."""
    data, ends = textvec.buffers(column)
    starts, stops, counts = textvec.words(data, ends)
    n = len(ends) - 1
    spans = textvec.Spans(data)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(counts))
    whole = spans.hash(starts, stops)
    order = np.lexsort((whole, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = order[new]
    starts, stops, doc = starts[at], stops[at], doc[at]
    found, owner = [whole[at]], [doc]
    for k, size in enumerate(PREFIXES):
        long = stops - starts > size
        h = spans.hash(starts[long], starts[long] + size) ^ _SALTS[k]
        d = doc[long]
        o = np.lexsort((h, d))
        h, d = h[o], d[o]
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        found.append(h[keep])
        owner.append(d[keep])
    doc = np.concatenate(owner)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(doc[order], np.arange(n + 1))


class Model:
    """Sorted terms with weight and factors, bias, and the score from which a text counts as toxic."""

    def __init__(self, known, weight, factors, bias, cut, f1=1.0):
        self.known, self.weight, self.factors, self.bias, self.cut, self.f1 = known, weight, factors, bias, cut, f1
        self.seen = None  # first bits of the known terms; made where rows are scored

    def score(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        if not len(self.known) or not len(found):
            return np.full(n, self.bias)
        if self.seen is None:
            self.seen = np.zeros(1 << 24, dtype=bool)
            self.seen[self.known >> np.uint64(40)] = True
        maybe = np.flatnonzero(self.seen[found >> np.uint64(40)])
        at = np.minimum(np.searchsorted(self.known, found[maybe]), len(self.known) - 1)
        hit = self.known[at] == found[maybe]
        at, maybe = at[hit], maybe[hit]
        doc = np.searchsorted(bounds, maybe, side="right") - 1
        out = self.bias + np.bincount(doc, self.weight[at], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[at, k]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def _evident(n, toxic, share: float, rows: int, least: int, evidence: float, greatest, root, size):
    """Whether a term of ``n`` rows, ``toxic`` of them toxic, is in ``least`` rows and ``evidence`` standard deviations more or less frequent in toxic ones than in all."""
    spread = root(greatest(n * share * (1 - share) * (1 - n / max(1, rows)), 1e-9))
    return (n >= least) & (size(toxic - n * share) >= evidence * spread)


def _known(rows: list[np.ndarray], y: np.ndarray, fit: np.ndarray, least: int, evidence: float) -> np.ndarray:
    """Terms of the fitted rows that there is evidence for."""
    none = [np.zeros(0, dtype=np.uint64)]
    values, n = np.unique(np.concatenate([*(rows[i] for i in fit), *none]), return_counts=True)
    bad, m = np.unique(np.concatenate([*(rows[i] for i in fit if y[i]), *none]), return_counts=True)
    toxic = np.zeros(len(values))
    toxic[np.searchsorted(values, bad)] = m
    return values[_evident(n, toxic, y[fit].mean() if len(fit) else 0.0, len(fit), least, evidence, np.maximum, np.sqrt, np.abs)]


def _places(rows: list[np.ndarray], known: np.ndarray) -> list[np.ndarray]:
    """Of each row, where its known terms are."""
    if not len(known):
        return [np.zeros(0, dtype=np.int64) for _ in rows]
    out = []
    for r in rows:
        at = np.minimum(np.searchsorted(known, r), len(known) - 1)
        out.append(at[known[at] == r])
    return out


def _frequent(rows: list[np.ndarray], fit: np.ndarray, least: int, wide: int) -> np.ndarray:
    """The ``wide`` most frequent terms of the fitted rows (of at least ``least``), equally frequent ones by value."""
    values, n = np.unique(np.concatenate([*(rows[i] for i in fit), np.zeros(0, dtype=np.uint64)]), return_counts=True)
    values, n = values[n >= least], n[n >= least]
    return np.sort(values[np.argsort(-n, kind="stable")[:wide]])


def train(rows: list[np.ndarray], toxic: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, least: int = MIN_ROWS, evidence: float = EVIDENCE, wide: int = WIDE, seed: int = 7, held: np.ndarray | None = None) -> Model:
    """Both steps; of the rows, ``held`` (a fifth) chooses the cut and takes no part in fitting.

    Rows should come in a fixed order; the same rows give the same model.
    """
    y = np.asarray(toxic, dtype=np.float64)
    held = np.isin(np.arange(len(y)), np.random.Generator(np.random.PCG64(seed)).permutation(len(y))[: len(y) // 5]) if held is None else np.asarray(held, dtype=bool)
    fit = np.flatnonzero(~held)
    known = _known(rows, y, fit, least, evidence)
    model = descend(rows, y, held, known, factors, epochs, seed)
    if model.f1 < 1:
        more = descend(rows, y, held, np.union1d(known, _frequent(rows, fit, least, wide)), factors, epochs, seed, model)
        model = more if more.f1 > model.f1 else model
    return model


def descend(rows: list[np.ndarray], y: np.ndarray, held: np.ndarray, known: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7, start: Model | None = None) -> Model:
    """AdaGrad on the logistic loss, batches of 64, over ``known`` terms, from ``start`` on; held-out rows choose the cut.

    Rows of one class only, or without any known term, give a model that calls nothing toxic (or, if all are toxic, held-out ones included, everything).
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    held, fit = np.flatnonzero(held), np.flatnonzero(~held)
    index = _places(rows, known)
    m = len(known)
    w, v = np.zeros(m), rng.normal(0, 0.02, (m, factors))
    gw, gv, gb, b = np.full(m, 1e-2), np.full((m, factors), 1e-2), 1e-2, 0.0
    if not len(known) or not len(fit) or y[fit].min() == y[fit].max():
        alike = not len(y) or y.min() == y.max()
        return Model(known, w, v * 0, 5.0 if len(y) and y.min() > 0 else -5.0, 0.0, float(alike))
    b = float(np.log(y[fit].mean() / (1 - y[fit].mean()))) if 0 < y[fit].mean() < 1 else 0.0
    if start is not None and len(start.known):
        at = np.searchsorted(known, start.known)
        w[at], v[at], b = start.weight, start.factors, start.bias
    for epoch in range(epochs):
        rate = 0.15 / (1 + 0.15 * epoch)
        order = rng.permutation(fit)
        for lo in range(0, len(order), 64):
            batch = order[lo : lo + 64]
            at = np.concatenate([index[i] for i in batch])
            sizes = np.array([len(index[i]) for i in batch])
            doc = np.repeat(np.arange(len(batch)), sizes)
            rowv = v[at]
            sums = np.stack([np.bincount(doc, rowv[:, k], len(batch)) for k in range(factors)], axis=1)
            squares = np.bincount(doc, (rowv * rowv).sum(axis=1), len(batch))
            z = b + np.bincount(doc, w[at], len(batch)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = (p - y[batch])
            used, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, g[doc], len(used)) + 2e-3 * w[used]
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            each = g[doc][:, None] * (sums[doc] - rowv)
            for k in range(factors):
                dv = np.bincount(inverse, each[:, k], len(used)) + 2e-2 * v[used, k]
                gv[used, k] += dv * dv
                v[used, k] -= 0.2 * rate * dv / np.sqrt(gv[used, k])
            gb += g.sum() ** 2
            b -= rate * g.sum() / np.sqrt(gb)
    model = Model(known, w, v, b, 0.0)
    none = [np.zeros(0, dtype=np.uint64)]  # held may be empty
    z = model.score(np.concatenate([*(rows[i] for i in held), *none]), np.cumsum([0, *(len(rows[i]) for i in held)]))
    model.cut = best_cut(z, y[held])
    said = z >= model.cut
    if len(held) and 0 < y[held].sum() < len(held):
        model.f1 = float(2 * (said * y[held]).sum() / (said.sum() + y[held].sum()))
    return model


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The score of greatest F1 among those from which at least half of the rows are toxic; of several, the middle of the widest gap.

    Scores that tell nothing apart leave no such cut, or only one below all rows;
    then the cut lies above all scores, so that clean rows stay. 0 if
    there is nothing to choose by.
    """
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    after = np.cumsum(y[::-1])[::-1]
    called = np.arange(len(y), 0, -1)
    f1 = 2 * after / (called + y.sum())
    gaps = np.diff(z, prepend=z[0])
    f1[(gaps <= 0) | (2 * after < called)] = -1
    if f1.max() < 0:
        return float(z[-1] + 0.5)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = best[np.argmax(gaps[best])]
    return float((z[at] + z[at - 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, **options) -> Model:
    """Fit on at most ``max_train_rows`` labelled documents: those whose doc_id hashes lowest, so the same at any partitioning.

    The sample is the bound; it is joined to the documents by doc_id (of several texts of one doc_id the
    greatest counts) and hashed into
    terms where the documents are. Terms are counted over all tasks, and only
    those of the step go to the one task that fits.
    """
    spark = docs.sparkSession
    least, evidence, wide = options.get("least", MIN_ROWS), options.get("evidence", EVIDENCE), options.get("wide", WIDE)
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id").cast("long")), F.lit(5)) == 0)
    chosen = materialise(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows), "chosen")
    text = docs.select("doc_id", F.lower("text").alias("text")).where("text is not null").join(small(chosen, max_train_rows), "doc_id")
    text = text.groupBy("doc_id", "toxic", "held").agg(F.max("text").alias("text"))

    def hashed(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            found, bounds = terms(b.column("text"))
            packed = pa.array([found[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "toxic", "held")), packed], names=["doc_id", "toxic", "held", "terms"])

    sample = text.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "held", "text").mapInArrow(hashed, "doc_id long, toxic int, held boolean, terms binary")
    sample = materialise(sample, "labelled")

    def tally(batches):
        for b in (part for whole in batches for part in slices(whole, "terms", 1 << 20)):
            data, ends = textvec.buffers(b.column("terms"))
            values, at = np.unique(data.view(np.uint64), return_inverse=True)
            bad = np.repeat(b.column("toxic").to_numpy(), np.diff(ends) // 8)
            n, m = np.bincount(at, minlength=len(values)), np.bincount(at, bad, len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n), pa.array(m)], names=["term", "n", "toxic"])

    fitted_on = sample.where("not held")
    n_rows, share = fitted_on.agg(F.count("*"), F.coalesce(F.avg("toxic"), F.lit(0.0))).first()
    counted = fitted_on.select("toxic", "terms").mapInArrow(tally, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= least)
    counted = materialise(counted, "terms")
    column = lambda x: x if not isinstance(x, float) else F.lit(x)
    good = _evident(F.col("n"), F.col("toxic"), float(share), n_rows, least, evidence, lambda a, b: F.greatest(a, column(b)), F.sqrt, F.abs)
    sorted_terms = lambda df: np.sort(df.select("term").toArrow().column("term").to_numpy().view(np.uint64))
    model = _step(sample, sorted_terms(counted.where(good)), None, options)
    if model is not None and model.f1 < 1:
        frequent = sorted_terms(counted.orderBy(F.col("n").desc(), F.expr("shiftright(term, 63)").desc(), "term").limit(wide))
        more = _step(sample, np.union1d(model.known, frequent), model, options)
        model = more if more.f1 > model.f1 else model
    discard(chosen, sample, counted)
    return model or Model(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros((0, 1)), -5.0, 0.0)


def _step(sample: DataFrame, known: np.ndarray, start: Model | None, options: dict) -> Model | None:
    """A model of the sample (doc_id, toxic, held, terms) over ``known`` terms, fitted in one task; None if there are no rows."""

    def narrowed(batches):
        for b in (part for whole in batches for part in slices(whole, "terms", 1 << 20)):
            data, ends = textvec.buffers(b.column("terms"))
            values = data.view(np.uint64)
            hit = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), dtype=bool)
            before = np.concatenate([[0], np.cumsum(hit)])[ends // 8]
            kept = np.ascontiguousarray(values[hit])
            packed = pa.array([kept[a:z].tobytes() for a, z in zip(before[:-1], before[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "toxic", "held")), packed], names=["doc_id", "toxic", "held", "terms"])

    chosen = {k: v for k, v in options.items() if k in ("factors", "epochs", "seed")}

    def fitted(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()
        split = [np.frombuffer(t.as_buffer(), dtype=np.uint64) for t in rows.column("terms")]
        m = descend(split, rows.column("toxic").to_numpy().astype(np.float64), rows.column("held").to_numpy(), known, start=start, **chosen)
        used = np.flatnonzero((np.abs(m.weight) > 1e-6) | (np.abs(m.factors).max(axis=1, initial=0) > 1e-6))
        blobs = m.known[used].tobytes(), m.weight[used].astype("<f4").tobytes(), m.factors[used].astype("<f4").tobytes()
        return pa.table({**{n: pa.array([b], pa.binary()) for n, b in zip(("known", "weight", "factors"), blobs)}, "k": pa.array([m.factors.shape[1]], pa.int32()), "bias": [float(m.bias)], "cut": [float(m.cut)], "f1": [float(m.f1)]})

    rows = sample.mapInArrow(narrowed, "doc_id long, toxic int, held boolean, terms binary")
    got = rows.groupBy(F.lit(1).alias("one")).applyInArrow(lambda t: fitted(t), "known binary, weight binary, factors binary, k int, bias double, cut double, f1 double").first()
    if got is None:
        return None
    f4 = lambda b: np.frombuffer(bytes(b), dtype="<f4").astype(np.float64)
    return Model(np.frombuffer(bytes(got["known"]), dtype=np.uint64), f4(got["weight"]), f4(got["factors"]).reshape(-1, got["k"]), got["bias"], got["cut"], got["f1"])


def score(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keep``, toxicity (0 to 1, from 0.5 on toxic) and toxic, for every row of ``docs``.

    Whole texts are scored. A null or empty text has no terms and gets the bias
    alone; a null doc_id keeps its row; repeated rows score alike. Without
    labels of both classes nothing is called toxic (all, if every label is).
    """
    z = _margin(docs, fit(docs, labels, max_train_rows, **options))
    scored = docs.select(*keep, z(F.lower("text")).alias("__z"))
    at_most = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("__z")))
    return scored.select(*keep, (1 / (1 + F.exp(-at_most))).alias("toxicity"), (F.col("__z") >= 0).alias("toxic"))


def _margin(docs: DataFrame, model: Model):
    """Column function: by how much the score of a lower-case text passes the cut.

    Only that one column goes to Python and only a number comes back; the rows'
    other columns stay in the JVM.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.weight, model.factors, model.bias, model.cut))

    @F.arrow_udf("double")
    def margin(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*shared.value)
        for texts in batches:
            parts = slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")
            yield pa.array(np.concatenate([model.score(*terms(b.column("text"))) - model.cut for b in parts] or [np.zeros(0)]))

    return margin


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that aren't toxic, with all their columns."""
    z = _margin(docs, fit(docs, labels, **options))
    return docs.where(z(F.lower("text")) < 0)
