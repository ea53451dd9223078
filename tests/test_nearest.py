"""Nearest neighbours in blocks against plain scoring of every pair."""

import numpy as np
import pytest

from quernel.operators import nearest, search, service


def _unit(rng, n, dim=64):
    v = rng.standard_normal((n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _plain(metric, q, v, ids, k, least):
    """Ids of each query's k best, all pairs scored."""
    q, v = nearest.prepared(metric, q), nearest.prepared(metric, v)
    out = []
    for x in q:
        if metric in ("manhattan", "chebyshev", "euclidean"):
            gap = np.abs(v - x)
            s = 1 / (1 + {"manhattan": gap.sum(axis=1), "chebyshev": gap.max(axis=1), "euclidean": np.sqrt((gap * gap).sum(axis=1))}[metric])
        else:
            s = (v * x).sum(axis=1)
            if metric != "dot":
                by = np.linalg.norm(x) * np.linalg.norm(v, axis=1)
                s = np.divide(s, by, out=np.zeros_like(s), where=by > 0)
            if metric == "angular":
                s = 1 - 2 * np.arccos(np.clip(s, -1, 1)) / np.pi
        s = np.round(s, 9)
        order = np.lexsort((ids, -s))
        out.append([int(i) for i in ids[order[s[order] >= least][:k]]])
    return out


def _streamed(metric, q, v, ids, k, least):
    found = nearest.Nearest(metric, k, least, np.arange(len(q)), nearest.prepared(metric, q))
    for at in range(0, len(v), 1000):
        block = nearest.prepared(metric, v[at : at + 1000])
        kept = nearest.lowest(ids[at : at + 1000], block, k)
        found.feed(ids[at : at + 1000][kept], block[kept])
    got = [[] for _ in q]
    for queries, keys, _ in found.found():
        for i, j in zip(queries.tolist(), keys.tolist()):
            got[i].append(j)
    return found, got


def _cases(rng):
    grid = lambda n: rng.integers(-2, 3, (n, 4)).astype(float)
    around = _unit(rng, 1)
    scale = lambda n: 10.0 ** rng.integers(-3, 4, (n, 1))
    return {
        "directions": (_unit(rng, 60), _unit(rng, 5000)), "ties": (grid(60), grid(5000)), "near": (around + 1e-5 * _unit(rng, 30), around + 1e-5 * _unit(rng, 2500)),
        "lengths": (_unit(rng, 30) * scale(30), _unit(rng, 2500) * scale(2500)), "wide": (_unit(rng, 20, 300), _unit(rng, 2500, 300)),
        "zeros": (np.concatenate([np.zeros((5, 64)), _unit(rng, 20)]), np.concatenate([np.zeros((1500, 64)), _unit(rng, 1500)])), "outliers": (rng.standard_cauchy((30, 64)), rng.standard_cauchy((2500, 64))),
    }


@pytest.mark.parametrize("metric", ["manhattan", "spearman", "chebyshev", "cosine", "pearson", "euclidean", "dot", "angular"])
def test_few_pairs_are_scored_and_none_is_lost(metric, monkeypatch):
    rng = np.random.default_rng(5)
    for name, (q, v) in _cases(rng).items():
        ids = rng.permutation(len(v))
        for least in (0.0, 0.24):
            scored = []
            exact = nearest.Nearest._exact
            monkeypatch.setattr(nearest.Nearest, "_exact", lambda self, rows, *rest: scored.append(len(rows)) or exact(self, rows, *rest))
            _, got = _streamed(metric, q, v, ids, 10, least)
            monkeypatch.undo()
            assert got == _plain(metric, q, v, ids, 10, least), (name, least)
            if name == "directions":
                assert sum(scored) < 0.1 * len(q) * len(v)


def test_ranks_of_a_block_share_ties():
    got = nearest.average_ranks(np.array([[3.0, 1.0, 3.0, 2.0], [5.0, 5.0, 5.0, 5.0], [1.0, 2.0, 3.0, 4.0]]))
    assert got.tolist() == [[3.5, 1.0, 3.5, 2.0], [2.5, 2.5, 2.5, 2.5], [1.0, 2.0, 3.0, 4.0]]


def test_equal_vectors_count_once():
    """Of equal vectors only the k of lowest id are compared; equal queries are compared once."""
    v = np.array([[1.0, 0.0]] * 500 + [[0.0, 1.0]] * 3)
    assert nearest.lowest(np.arange(503)[::-1].copy(), v, 2).tolist() == [498, 499, 501, 502]
    found, got = _streamed("cosine", np.array([[0.0, 0.0]] * 300), v, np.arange(503), 3, 0.0)
    assert len(found.q) == 1 and got == [[0, 1, 2]] * 300


def test_rows_to_the_final_ranking_do_not_grow_with_blocks(spark, monkeypatch):
    """k rows leave a cell for each query, however many blocks are searched; parts of both sides give the rows of one cell."""
    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(_unit(rng, 1200, 8))], "vec_id long, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "query_id")
    rows = []
    best = search.top_k
    monkeypatch.setattr(search, "top_k", lambda scored, *rest: rows.append(scored.count()) or best(scored, *rest))
    one = sorted(map(tuple, search.knn(q, v, 3, "manhattan").collect()))
    monkeypatch.setattr(search, "LEAST", 400)
    cells = sorted(map(tuple, search.knn(q, v, 3, "manhattan").collect()))
    assert one == cells and len(one) == 3600
    assert rows == [3600, 3 * 3600]


def _left(monkeypatch):
    """Numbers of the rows that each search sends to its final ranking."""
    rows, best = [], search.top_k
    monkeypatch.setattr(search, "top_k", lambda scored, *rest, **names: rows.append(scored.count()) or best(scored, *rest, **names))
    return rows


def test_service_searches_in_cells(spark, monkeypatch):
    """Variants of a query fetch their 2 k best of each part of the vectors, and the parts don't change what is found."""
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(_unit(rng, 1200, 8))], "vec_id long, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "query_id").where("query_id < 300")
    q = q.selectExpr("query_id", "embedding", "0 AS variant").union(q.selectExpr("query_id", "transform(embedding, x -> -x)", "1"))
    rows = _left(monkeypatch)
    one = sorted(map(tuple, service.retrieve(q, v, 3, 0.1).collect()))
    monkeypatch.setattr(search, "LEAST", 400)
    assert sorted(map(tuple, service.retrieve(q, v, 3, 0.1).collect())) == one
    assert rows == [600 * 6, 3 * 600 * 6]
