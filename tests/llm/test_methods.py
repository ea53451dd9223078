"""The operators against brute force, exact optima or held-out rows."""

import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import compare
from quernel.llm import embeddings, huffman, jaccard, mixing, packing, queries, sharding, substring, toxicity


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, small_dir, name):
    compare(queries.QUERIES[name](spark, small_dir), queries.ORACLES[name], small_dir)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql(spark, small_dir, name):
    assert queries.QUERIES[name](spark, small_dir).count() > 0


def test_differencing_is_balanced_and_whole():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 1000) for _ in range(400)), reverse=True)
    sums = np.zeros((len(sizes), 8), dtype=np.int64)
    sums[:, 0] = sizes
    totals, slots = sharding.difference(sums)
    again = np.zeros(8, dtype=np.int64)
    for i, s in enumerate(sizes):
        again[slots[i, 0]] += s
    assert sorted(again, reverse=True) == list(totals) and sum(totals) == sum(sizes)
    greedy = [0] * 8
    for s in sizes:
        greedy[greedy.index(min(greedy))] += s
    assert totals[0] - totals[-1] <= max(greedy) - min(greedy)


def test_differencing_two_ways_known():
    sums = np.zeros((5, 2), dtype=np.int64)
    sums[:, 0] = [8, 7, 6, 5, 4]
    assert sorted(sharding.difference(sums)[0]) == [14, 16]


def test_code_lengths_are_optimal():
    """Against all length vectors that satisfy Kraft's inequality."""
    rng = random.Random(5)
    for _ in range(20):
        counts = [rng.randint(1, 50) for _ in range(5)]
        best = min(sum(c * n for c, n in zip(counts, ns)) for ns in itertools.product(range(1, 4), repeat=5) if sum(2.0**-n for n in ns) <= 1)
        lengths = huffman.code_lengths(np.array(counts), 3)
        assert sum(2.0 ** -int(n) for n in lengths) <= 1 and lengths.max() <= 3
        assert sum(c * int(n) for c, n in zip(counts, lengths)) == best


def test_ranges_decode_from_checkpoints():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.5, 3000).clip(0, 499).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=500), 12)
    codes, table = huffman.canonical(lengths), huffman.decode_table(lengths)
    packed, _, _, inside = huffman.pack_bits(ids, np.array([0]), lengths, codes)
    notes = inside[::256]
    for a, z in ((0, 3000), (255, 257), (2999, 3000), (1000, 1000), (256, 512)):
        assert huffman.unpack_range(packed.tobytes(), 3000, notes, table, a, z).tolist() == ids[a:z].tolist()


def _texts(rng, words, n):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(3, 120))) for _ in range(n)]


def test_texts_are_encoded_in_one_call(monkeypatch):
    """op2, op8: a text of words that never came before took a call for each of them."""
    import tiktoken

    from quernel.llm import tokens

    calls, plain = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(text) or plain(self, text))
    enc = tokens.Encoder(tokens.VOCAB)
    enc.pack(" ".join(f"word{i}" for i in range(1000)))
    assert len(calls) == 1


def test_packing_encodes_each_text_once(monkeypatch):
    """op8: its blocks took a call for each new word of a text."""
    import tiktoken

    from quernel.llm import tokens

    calls, plain = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(text) or plain(self, text))
    enc = tokens.Encoder(tokens.VOCAB)
    texts = [" ".join(f"word{i}x{k}" for i in range(300)) for k in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    blocks = list(packing._blocks([batch], enc, 0, 512, 63))
    assert len(calls) == 5
    got = b"".join(b.column(c)[0].as_py() for b in blocks for c in ("head", "body", "tail"))
    assert np.frombuffer(got, dtype=f"<u{enc.width}").tolist() == [i for t in texts for i in [*enc.encoding.encode_ordinary(t), enc.end]]


def test_cut_texts_give_the_ids_of_the_whole_pattern():
    from quernel.llm import tokens

    enc = tokens.encoder(tokens.VOCAB)
    rng = random.Random(7)
    parts = [" ", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u200b", "\u3000", "a", "The", "don't", "'s", "1", ".", ",,", "é", "e\u0301", "日本", "🙂", "\0"]
    texts = ["", " ", "  ", "a  ", "a\n ", "  a", "\n\n\n", *("".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(20_000))]
    for text in texts:
        assert np.frombuffer(enc.pack(text), dtype=f"<u{enc.width}").tolist() == enc.encoding.encode_ordinary(text), repr(text)


def test_jaccard_recall_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = _texts(rng, words, 80)
    for t in list(texts):
        for share in (0.02, 0.06, 0.12, 0.2):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in t.split()))
    grams = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (t.split() for t in texts)]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= jaccard.THRESHOLD}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["keep_id"] for r in jaccard.pairs(docs).collect()}
    root = lambda i: found.get(i, i)
    together = sum(root(i) == root(j) for i, j in want)
    assert len(want) > 100 and together >= 0.9 * len(want)
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in want:
        a, b = sorted((top(i), top(j)))
        parent[b] = a
    assert all(top(i) == top(k) for i, k in found.items())


def test_embedding_recall_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((60, 32))
    v = np.concatenate([base, base + 0.12 * rng.standard_normal(base.shape), base[:20] + 0.03 * rng.standard_normal((20, 32)), base[:5]])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= embeddings.THRESHOLD)) if i > j}
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["keep_id"] for r in embeddings.near_duplicates(df, per_partition=50).collect()}
    root = lambda i: found.get(i, i)
    assert len(near) > 40 and sum(root(i) == root(j) for i, j in near) >= 0.9 * len(near)


def _pair_model(share, label, n=3000, seed=2):
    """Accuracy on held-out rows of a model of texts with two words, each in ``share`` of the rows, that ``label`` decides by."""
    rng = random.Random(seed)
    rows, y = [], []
    for _ in range(n):
        a, b = rng.random() < share, rng.random() < share
        rows.append(" ".join([f"n{rng.randint(0, 30)}" for _ in range(6)] + ["grok"] * a + ["blim"] * b))
        y.append(float(label(a, b)))
    found, bounds = toxicity.terms(pa.array(rows))
    split = [found[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
    fit = n * 4 // 5
    model = toxicity.train(split[:fit], np.array(y[:fit]))
    z = model.score(np.concatenate(split[fit:]), np.cumsum([0, *(len(s) for s in split[fit:])]))
    return ((z >= model.cut) == np.array(y[fit:], dtype=bool)).mean(), model


def test_machine_learns_pairs():
    """Labels that only the pair of two words decides: a sum of single weights can't. In the second case neither word tells anything alone."""
    right, model = _pair_model(0.5, lambda a, b: a and b)
    assert right > 0.97 and np.abs(model.factors).max() > 0.1
    right, model = _pair_model(0.5, lambda a, b: a != b)
    assert right > 0.97 and np.abs(model.factors).max() > 0.1


def test_machine_learns_rare_pairs():
    """An insult and a mention, each in 12 % of the rows and harmless alone."""
    right, model = _pair_model(0.12, lambda a, b: a and b, n=8000)
    assert right > 0.995 and np.abs(model.factors).max() > 0.1


def test_toxicity_samples_no_more_than_its_bound(spark):
    """Repeated doc_ids don't multiply the sample; pairs of words that are harmless alone are learned through the distributed fit as well."""
    rng, rows, labels = random.Random(8), [], []
    for i in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([f"n{rng.randint(0, 30)}" for _ in range(6)] + ["Grok"] * a + ["blim"] * b)))
        labels.append((i, 0, int(a != b)))
    docs = spark.createDataFrame(rows + rows[:300] * 3, "doc_id long, text string")
    lab = spark.createDataFrame(labels[:1500], "doc_id long, quality int, toxic int")
    said = {r["doc_id"]: r["said"] for r in toxicity.score(docs, lab, max_train_rows=1200).withColumnRenamed("toxic", "said").collect()}
    assert sum(said[i] == bool(t) for i, _, t in labels[1500:]) > 0.95 * 500


def test_toxicity_on_held_out_labels(spark):
    """Fit on even labelled documents of the 0.1 tables, judged on odd ones."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    scored = toxicity.score(docs, labels.where(~odd)).withColumnRenamed("toxic", "said").join(labels.where(odd), "doc_id")
    n = {(r["said"], r["toxic"]): r["count"] for r in scored.groupBy("said", "toxic").count().collect()}
    right, false, missed = n.get((True, 1), 0), n.get((True, 0), 0), n.get((False, 1), 0)
    assert right / max(1, right + missed) > 0.85 and right / max(1, right + false) > 0.85


def test_mixing_weights():
    totals = np.array([8000, 1000, 1000])
    a, shown = mixing.solve(totals, max_repeat=3.0)
    assert abs(shown.max() - 3.0) < 1e-6 and abs(shown.min() - 1.0) < 1e-9 and 0 < a < 1
    assert mixing.solve(totals, max_repeat=None)[0] == 0.0
    a, _ = mixing.solve(totals, None, entropy=0.9)
    w = mixing.weights(totals.astype(float), a)
    assert abs(-(w * np.log(w)).sum() - 0.9) < 1e-6


def test_mixing_keeps_the_budget(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    total = docs.agg(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    shown = mixing.mix(docs, budget=2 * total, max_repeat=None, block_tokens=500)
    n = shown.agg(F.sum("n_tokens")).first()[0]
    assert n <= 2 * total and n > 1.6 * total


def test_pipeline_stages(spark, small_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert len(pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    kept = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialise(stage(spark, docs, small_dir), name)
        assert out.columns == docs.columns
        kept.append(out.count())
        docs = out
    assert kept[1] >= 0.5 * kept[0] and kept[2] < kept[1] and kept[3] > 0 and kept[4] >= kept[3]
    windows = pipeline.STAGES[-1][1](spark, docs, small_dir).select("window_id", "n_tokens").collect()
    assert [w["n_tokens"] for w in sorted(windows)][:-1] == [packing.LENGTH] * (len(windows) - 1)


def test_results_are_plain_rows(spark, small_dir):
    """Every registered result can be written as JSON-like rows; ids are integers."""
    rows = queries.QUERIES["op4_ngram_jaccard_join"](spark, small_dir).limit(3).collect()
    assert all(isinstance(r["doc_id"], int) for r in rows) and json.dumps([r.asDict() for r in rows])


def test_substring_cuts_a_shared_passage(spark):
    passage = " ".join(f"Sentence number {i} speaks of the same thing again and again." for i in range(8))
    docs = spark.createDataFrame([(i, f"Own opening {i} here. {passage} Own end {i} here.") for i in range(50)], "doc_id long, text string")
    text = {r["doc_id"]: r["text"] for r in substring.dedup(docs).collect()}
    assert passage in text[0] and all(passage not in text[i] and f"Own opening {i} here." in text[i] and f"Own end {i} here." in text[i] for i in range(1, 50))
