"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from quernel.llm import embeddings, huffman, jaccard, media, mixing, packing, sharding, substring, toxicity, urlfilter

SENTENCES = [f"The {w} walks along the {w} river every single morning before work." for w in ("red", "blue", "green", "old", "young", "tall", "shy")]
PASSAGE = " ".join(SENTENCES[:5])
LONG = " ".join(f"word{i}" for i in range(60_000))
EXTRA = "bucket int, n_tokens long, x int, h long, key string, toxic int, toxicity double, ids binary, block int, epoch int, root long, __cut_ int, n_sentences long, rank int, row long, payload string, digest string"
ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "a row without an id has a text all the same", "en", "b", 43),
    (None, None, None, "b", None),
    (4, LONG, "en", "b", len(LONG)),
    (5, "   \n\t ", "fr", None, 6),
    (6, "Hello. " + PASSAGE + " Unlike the others.", "en", "c", 400),
    (7, PASSAGE + " Here it ends in another way.", "en", "c", 380),
    (8, "one two three four five six seven eight nine ten", "en", "c", 48),
    (9, "wort für wort, é è ü ß 你好 世界 🎉 done", "de", "c", 40),
]
BASE = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, BASE)
    for part in EXTRA.split(", "):
        name, kind = part.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def labels(spark, rows=((1, 0, 0), (6, 1, 1), (None, 1, 1), (4, 0, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("key", F.lit(1)).withColumn("action", F.lit("y"))


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_sharding(docs, empty):
    rows = sharding.shard(docs, shards=4).collect()
    assert len(rows) == len(ROWS)
    by_text = {r[0]: set() for r in ROWS}
    shard = {r["doc_id"]: r["shard"] for r in rows if r["doc_id"] is not None}
    assert shard[1] == shard[8] and by_text
    assert sorted(r["bytes"] for r in rows) == sorted(len((t or "").encode()) for _, t, *_ in ROWS)
    assert sharding.shard(empty, shards=4).count() == 0


def test_huffman_round_trip(spark, docs, empty):
    from quernel.llm import tokens

    coded = huffman.encode(docs, block=512, every=64).cache()
    got = sorted((str(r["doc_id"]), r["block_no"], r["ids"]) for r in huffman.decode(coded, 64).where("ids is not null").collect())
    enc = tokens.encoder(tokens.VOCAB)
    want = []
    for doc_id, text, *_ in ROWS:
        if text is not None:
            ids = enc.encoding.encode_ordinary(text)
            want += [(str(doc_id), k, ids[k * 512 : (k + 1) * 512]) for k in range(max(1, -(-len(ids) // 512)))]
    assert got == sorted(want)
    assert coded.where("payload is null").count() == 2
    none = huffman.encode(empty).collect()
    assert len(none) == 1 and none[0]["block_no"] == -1 and not any(none[0]["payload"])


def test_jaccard(docs, empty):
    found = {(r["doc_id"], r["keep_id"]) for r in jaccard.pairs(docs).collect()}
    assert found == {(8, 1), (7, 6)}
    kept = jaccard.dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted((str(r["doc_id"]) for r in kept.collect()))
    assert ids == sorted(map(str, (1, 1, 2, 3, None, None, 4, 5, 6, 9)))
    assert jaccard.pairs(empty).count() == 0 and jaccard.dedup(empty).count() == 0


def test_substring(docs, empty):
    out = substring.dedup(docs)
    assert out.columns == docs.columns
    rows = out.select("doc_id", "text").collect()
    assert len(rows) == len(ROWS)
    text = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    assert text[7] == "Here it ends in another way." and text[6] == ROWS[8][1] and text[4] == LONG and text[2] == "" and text[3] is None
    assert substring.dedup(docs, counts=True).columns == ["doc_id", "text", "n_sentences", "n_removed"]
    assert substring.dedup(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rows = toxicity.score(docs, labels(spark)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["toxicity"] <= 1 for r in rows)
    assert toxicity.clean(docs, labels(spark)).columns == docs.columns
    assert toxicity.clean(docs, labels(spark, ())).count() == len(ROWS)
    assert toxicity.clean(empty, labels(spark)).count() == 0


def test_packing(docs, empty):
    from quernel.llm import tokens

    enc = tokens.encoder(tokens.VOCAB)
    rows = packing.pack(docs, length=256, part_bytes=100_000, block=3).orderBy("window_id").collect()
    stream = [i for r in rows for i in r["tokens"]]
    order = sorted(((-1 if d is None else d, enc.pack(t)) for d, t, *_ in ROWS if t is not None))
    import numpy as np

    want = [i for _, p in order for i in [*np.frombuffer(p, f"<u{enc.width}").tolist(), enc.end]]
    assert stream == want
    assert [r["window_id"] for r in rows] == list(range(len(rows))) and all(r["n_tokens"] == 256 for r in rows[:-1])
    for r in rows:
        assert sum(s["length"] for s in r["segments"]) == r["n_tokens"] == len(r["tokens"])
    assert packing.pack(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert {r["source"] for r in rows} == {"a", "b", "c", None} and all(0 <= r["mix_key"] <= 1 for r in rows)
    assert sum(r["epoch"] == 0 for r in rows) == len(ROWS)
    assert mixing.realise(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.realise(empty).count() == 0


def test_embeddings(spark):
    v = [1.0, 0.0, 0.5]
    rows = [(1, v), (2, v), (2, v), (3, [0.0, 1.0, 0.0]), (None, v), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [2.0, 0.0, 1.01]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).withColumn("label", F.lit(3))
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == [(2, 1), (8, 1)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_url_filters(spark):
    rules = spark.createDataFrame([("example.com/", "block", 0), ("www.example.com/ok/", "allow", 0), (None, "block", 0), ("example.com/", "block", 0)], "expr string, action string, priority int")
    urls = [(1, "http://a.b.Example.com:80/x", "h"), (2, "https://www.example.com/ok/y?q=1#f", "h"), (3, None, "h"), (4, "", "h"), (None, "http://example.com", "h"), (5, "http://notexample.com/", "h"), (5, "http://notexample.com/", "h"), (6, "http://example.com/" + "p/" * 3000, "h")]
    got = sorted((str(r["page_id"]), r["action"]) for r in urlfilter.decide(pages(spark, urls), rules).collect())
    assert got == sorted([("1", "block"), ("2", "allow"), ("3", "none"), ("4", "none"), ("None", "block"), ("5", "none"), ("5", "none"), ("6", "block")])
    assert urlfilter.decide(pages(spark, []), rules).count() == 0
    assert urlfilter.decide(pages(spark, urls), rules.limit(0)).where("action <> 'none'").count() == 0


def test_media(spark):
    html = "<html lang='en'><head><title>T</title></head></html>"
    rows = [(1, "u", html), (1, "u", html), (2, "u", html), (None, "u", html), (3, "u", None), (4, "u", ""), (5, "u", "x" * 3_000_000), (None, "u", "other"), (None, "u", "other")]
    found = media.media_columns(pages(spark, rows)).cache()
    assert found.count() == len(rows)
    assert found.select("digest").where("digest is not null").distinct().count() == 4
    back = sorted((str(r["page_id"]), None if r["payload"] is None else bytes(r["payload"]).decode()) for r in media.fetch(found).collect() if r["payload"] is not None)
    assert back == sorted((str(k), h) for k, _, h in rows if h is not None)
    assert {r["title"] for r in found.where("media_type = 'text/html'").collect()} == {"T"}
    assert media.media_columns(pages(spark, [])).count() == 0
