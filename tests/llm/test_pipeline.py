"""Every stage of the pipeline against a plain version of it, each on what the stage before kept."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quernel.llm import jaccard, mixing, packing, substring, textvec, tokens, toxicity

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, small_dir):
    """Rows of each stage's input, and at the end of the last one's output."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(pipeline.materialise(stage(spark, out[-1], small_dir), name))
    stored = lambda d: sorted(d.select("*", "_metadata.file_name", "_metadata.row_index").collect(), key=lambda r: (r["file_name"], r["row_index"]))
    return [[{c: v for c, v in r.asDict(recursive=True).items() if c not in ("file_name", "row_index")} for r in stored(d)] for d in out]


def test_toxicity(spark, small_dir, stages):
    """Weights and all pairs of factors added one by one."""
    m = toxicity.fit(spark.read.parquet(f"{small_dir}/documents.parquet"), spark.read.parquet(f"{small_dir}/labels.parquet"))
    place = {int(t): i for i, t in enumerate(m.known)}
    kept = set()
    for row in stages[0]:
        found, _ = toxicity.terms(pa.array([row["text"].lower()]))
        at = [place[int(t)] for t in found if int(t) in place]
        z = m.bias + sum(m.weight[i] for i in at) + sum(float(m.factors[i] @ m.factors[j]) for x, i in enumerate(at) for j in at[:x])
        if z < m.cut:
            kept.add(row["doc_id"])
    assert {r["doc_id"] for r in stages[1]} == kept and len(kept) > 0.8 * len(stages[0])


def _words(text):
    data, ends = textvec.buffers(pa.array([text.lower()]))
    starts, stops, _ = textvec.words(data, ends)
    raw = data.tobytes()
    return [raw[a:z] for a, z in zip(starts, stops)]


def test_jaccard(stages):
    sets = {}
    for r in stages[1]:
        w = _words(r["text"])
        if w:
            sets[r["doc_id"]] = {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))}
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= jaccard.THRESHOLD:
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    gone = {d for d in ids if top(d) != d}
    assert {r["doc_id"] for r in stages[2]} == {r["doc_id"] for r in stages[1]} - gone and gone


def _sql(sql, rows):
    table = pa.Table.from_pylist([{k: r[k] for k in ("doc_id", "text", "source")} for r in rows])
    con = duckdb.connect()
    con.register("documents", table)
    return con.sql(sql).fetchall()


def test_substring(stages):
    want = {r[0]: r[1] for r in _sql(f"SELECT doc_id, text FROM ({substring.SQL})", stages[2])}
    assert {r["doc_id"]: r["text"] for r in stages[3]} == {d: t for d, t in want.items() if t.strip(" \t\n\f\r")}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3])


def test_mixing(stages):
    want = Counter(r[0] for r in _sql(f"SELECT doc_id FROM ({mixing.SQL})", stages[3]))
    assert Counter(r["doc_id"] for r in stages[4]) == want and set(want) == {r["doc_id"] for r in stages[3]}


def test_mixed_order(spark, stages):
    """Rows are stored by mix_key; copies of a document are an epoch apart and sources interleave."""
    docs = spark.createDataFrame([(r["doc_id"], r["source"], r["text"]) for r in stages[3]], "doc_id long, source string, text string")
    keys = {}
    for r in mixing.mix(docs).collect():
        keys.setdefault(r["doc_id"], []).append(r["mix_key"])
    keys = {d: sorted(k) for d, k in keys.items()}
    seen, line = Counter(), []
    for r in stages[4]:
        line.append(keys[r["doc_id"]][seen[r["doc_id"]]])
        seen[r["doc_id"]] += 1
    assert line == sorted(line) and max(seen.values()) > 1
    order = [r["doc_id"] for r in stages[4]]
    places = {d: [i for i, x in enumerate(order) if x == d] for d in seen if seen[d] > 1}
    gaps = [b - a for at in places.values() for a, b in zip(at, at[1:])]
    assert np.median(gaps) > 0.2 * len(order) / max(seen.values())
    half = Counter(r["source"] for r in stages[4][: len(order) // 2])
    assert set(half) == {r["source"] for r in stages[4]}


def test_packing(stages):
    enc = tokens.encoder(tokens.VOCAB)
    windows = sorted(stages[5], key=lambda w: w["window_id"])
    stream = np.array([i for w in windows for i in w["tokens"]])
    ends = np.flatnonzero(stream == enc.end)
    pieces = [tuple(p[:-1]) for p in np.split(stream, ends + 1)[:-1]]
    texts = stages[4]
    assert [s["doc_id"] for w in windows for s in w["segments"] if s["doc_start"] == 0] == [r["doc_id"] for r in texts]
    assert pieces == [tuple(enc.encoding.encode_ordinary(r["text"])) for r in texts]
    assert all(w["n_tokens"] == packing.LENGTH for w in windows[:-1])


ODD = [
    (1, "one two three four five six seven eight nine ten. Once more, with other words!", "en", "a", 78),
    (1, "one two three four five six seven eight nine ten. Once more, with other words!", "en", "a", 78),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "a row without an id has a text all the same", "en", "b", 43),
    (None, None, None, "b", None),
    (4, " ".join(f"word{i}" for i in range(40_000)), "en", "b", 388_889),
    (5, "   \n\t ", "fr", None, 6),
    (6, "one two three four five six seven eight nine ten. Once more, with other words!", "en", "c", 78),
    (7, "short", None, "c", 5),
]


@pytest.mark.parametrize("rows", (ODD, []))
def test_stages_take_odd_rows(spark, tmp_path, rows):
    """Nulls in every column, empty and very long texts, repeated rows, a clashing extra column, and no rows at all."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kinds).selectExpr("*", "cast(null as int) as bucket", "'x' as row")
    spark.createDataFrame([(1, 0, 0), (4, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        kept.append(sorted(str(r["doc_id"]) for r in docs.collect()))
    windows = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    if not rows:
        assert kept == [[]] * 4 and not windows
        return
    everything = sorted(str(r[0]) for r in rows)
    assert kept[0] == everything and kept[1] == [d for d in everything if d != "6"] and kept[2] == kept[1] and set(kept[3]) == set(kept[2])
    assert {s["doc_id"] for w in windows for s in w["segments"]} == {1, 2, 4, 5, 7, None}


@pytest.mark.parametrize("length, block, part_bytes", ((7, 1, 50), (16, 2, 300), (5, 64, 1 << 20), (64, 3, 2000)))
def test_packing_cuts_blocks_anywhere(spark, length, block, part_bytes):
    """Blocks and tasks end inside windows and documents; a third of the rows share one doc_id and text."""
    rng = np.random.default_rng(length)
    rows = [(int(i), " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(0, 40)))) for i in rng.permutation(60)] + [(30, "always the same text")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    windows = sorted(packing.pack(docs, length=length, block=block, part_bytes=part_bytes).collect(), key=lambda w: w["window_id"])
    assert [w["window_id"] for w in windows] == list(range(len(windows))) and all(w["n_tokens"] == length for w in windows[:-1])
    enc = tokens.encoder(tokens.VOCAB)
    stream, found = [i for w in windows for i in w["tokens"]], []
    for w in windows:
        assert sum(s["length"] for s in w["segments"]) == w["n_tokens"] == len(w["tokens"])
        assert [s["win_start"] for s in w["segments"]] == [sum(s["length"] for s in w["segments"][:i]) for i in range(len(w["segments"]))]
        for k, s in enumerate(w["segments"]):
            assert s["doc_start"] == 0 or k == 0
            ids = w["tokens"][s["win_start"] : s["win_start"] + s["length"]]
            if s["doc_start"] == 0:
                found.append((s["doc_id"], ids))
            else:
                assert s["doc_id"] == found[-1][0] and s["doc_start"] == len(found[-1][1])
                found[-1] = (s["doc_id"], found[-1][1] + ids)
    want = [(d, [*enc.encoding.encode_ordinary(t), enc.end]) for d, t in rows]
    assert [d for d, _ in found] == sorted(d for d, _ in want) and sorted(found) == sorted(want) and stream == [i for _, ids in found for i in ids]
