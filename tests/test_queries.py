"""Every core query against its SQL over the small tables; queries without SQL must give rows."""

import pytest

from quernel.plans import catalog

from oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, small_dir, name):
    compare(catalog.QUERIES[name](spark, small_dir), catalog.ORACLES[name], small_dir)


def test_only_these_have_no_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"mmr_rerank"}


def test_mmr_rerank_against_plain_loops(spark, small_dir):
    """Greedy re-ranking of the 20 best, one row after the other."""
    import re

    from quernel.operators import rank

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    score = {r["doc_id"]: r["score"] for r in rank.top_k(rank.bm25(docs, catalog.TEXT), 20).collect()}
    sets = {d: {t for t in re.split(r"\s+", re.sub(r"[^\w\s]", " ", text[d].lower())) if len(t) > 1} for d in score}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    left = sorted(score, key=lambda d: (-score[d], d))
    chosen = [left.pop(0)]
    while left:
        best = max(left, key=lambda d: (0.5 * score[d] - 0.5 * min(like(d, c) for c in chosen), -left.index(d)))
        chosen.append(best)
        left.remove(best)
    got = sorted(catalog.QUERIES["mmr_rerank"](spark, small_dir).collect(), key=lambda r: r["position"])
    assert [r["doc_id"] for r in got] == chosen and len(chosen) == 20
