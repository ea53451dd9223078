"""Cases that the operators once did by less than the whole."""

import math

import numpy as np
import pytest

from quernel.llm import embeddings, jaccard, substring


def test_jaccard_finds_small_sets(spark):
    """Pairs just similar enough, in every size band that isn't sampled: sizes alike, and as far apart as can be."""
    t, rows, bands = jaccard.THRESHOLD, [], {}
    for a in (2, 3, 4, 5, 6, 7, 8, 10, 13, 16, 17, 21, 26, 27, 34, 41, 42, 53, 64):
        for b in {a, (a + int(a / t)) // 2, int(a / t)}:
            both = math.ceil(t * (a + b) / (1 + t) - 1e-9)
            if both > a or both == a == b:
                continue
            for k in range(20):
                words = [f"w{a}x{b}x{k}x{i}" for i in range(a + b - both)]
                bands.setdefault(a, []).append(len(rows))
                rows += [(len(rows), " ".join(words[:a])), (len(rows) + 1, " ".join(words[a - both :]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["keep_id"]) for r in jaccard.pairs(docs, n=1).collect()}
    missed = {a: sum((i + 1, i) not in found for i in at) / len(at) for a, at in bands.items()}
    assert max(missed.values()) <= 0.02 and all(k == d - 1 and k % 2 == 0 for d, k in found), missed


def test_jaccard_finds_a_short_text_with_another_last_word(spark):
    texts = [f"Of{k} th{k} on{k} re{k} at{k} ingedre{k}, {end}." for k in range(20) for end in ("the", "ble")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in jaccard.pairs(docs).collect()} == {(2 * k + 1, 2 * k) for k in range(20)}


def test_jaccard_finds_large_sets(spark):
    """Pairs just similar enough, of sets of 97 to 3,000 features: sizes alike, and as far apart as can be. None may be missed."""
    t, rows = jaccard.THRESHOLD, []
    for a in (97, 110, 130, 160, 200, 270, 400, 800, 3000):
        for b in (a, int(a / t)):
            both = math.ceil(t * (a + b) / (1 + t) - 1e-9)
            for k in range(1 if a == 3000 else 20):
                words = [f"w{a}x{b}x{k}x{i}" for i in range(a + b - both)]
                rows += [(len(rows), " ".join(words[:a])), (len(rows) + 1, " ".join(words[a - both :]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in jaccard.pairs(docs, n=1).collect()} == {(i + 1, i) for i in range(0, len(rows), 2)}
    assert {tuple(r) for r in jaccard.join(docs, n=1).select("doc_id", "class_id", "n_links").collect()} == {(i, i - i % 2, 1) for i in range(len(rows))}


def test_jaccard_counts_all_links(spark):
    """A cluster in which not all are similar to all, exact copies, texts without words and one without a doc_id, against brute force."""
    import random

    rng, base = random.Random(6), [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(f"o{rng.randint(0, 10**6)}" if rng.random() < 0.002 * (i % 60) else w for w in base)) for i in range(120)]
    rows += [(200 + i, rows[i][1].upper()) for i in range(5)] + [(300 + i, " ".join(rng.choice(base) for _ in range(150))) for i in range(40)]
    rows += [(400, ""), (401, None), (402, "--"), (403, "alone"), (404, "alone!"), (405, "alone too"), (None, "w0"), (406, "W0")]
    grams = {}
    for d, text in rows:
        w = [v.strip("!-") for v in (text or "").lower().split() if v.strip("!-")]
        grams[d] = {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()
    links = {d: {e for e in grams if e != d and grams[d] and len(grams[d] & grams[e]) >= jaccard.THRESHOLD * len(grams[d] | grams[e])} for d in grams}
    want = set()
    for d in grams:
        seen, todo = {d}, [d]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        want.add((d, min((e for e in seen if e is not None), default=None), len(links[d])))
    assert 2000 < sum(map(len, links.values())) and any(0 < len(links[d]) < 100 for d in range(120))
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    found = jaccard.join(docs)
    assert found.columns == ["doc_id", "class_id", "n_links"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert {(r["doc_id"], r["keep_id"]) for r in jaccard.pairs(docs).collect()} == {(d, k) for d, k, n in want if d != k}


@pytest.mark.parametrize("most", (1 << 16, 50))
def test_jaccard_sends_near_copies_once(spark, monkeypatch, most):
    """60 groups of 20 near copies, of 15 pieces' bytes: all links are found, and what is shuffled is a few times their features. With ``most`` pairs a cell the groups are split."""
    import random
    import time

    monkeypatch.setattr(jaccard, "CELL_BYTES", 1 << 16)
    monkeypatch.setattr(jaccard, "GROUP_PAIRS", most, raising=False)
    rng, rows = random.Random(8), []
    for g in range(60):
        words = [f"g{g}x{i}x{rng.randint(0, 10**6)}" for i in range(101)]
        rows += [(20 * g + k, " ".join([*words[: 5 * k], f"k{k}", *words[5 * k + 1 :]])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def written():
        sc = spark.sparkContext._jsc.sc()
        spark.range(1).collect()
        sc.listenerBus().waitUntilEmpty()
        time.sleep(0.5)
        held = sc.statusStore().executorList(False)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    before = written()
    got = {tuple(r) for r in jaccard.join(docs).select("doc_id", "class_id", "n_links").collect()}
    assert got == {(d, d - d % 20, 19) for d, _ in rows}
    moved = (written() - before) / (1200 * 100 * 8)
    assert most == 50 or 1 < moved < 6, moved
    if most == 50:
        assert {(r["doc_id"], r["keep_id"]) for r in jaccard.pairs(docs).collect()} == {(d, d - d % 20) for d, _ in rows if d % 20}


def test_jaccard_prefixes_lose_no_pair():
    """Any order of features gives every similar pair, also one that counts of other texts give; a held bound of one pair yields them in parts."""
    rng = np.random.default_rng(9)
    words = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(words, rng.integers(1, 60))) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[: max(1, len(s) - int(k))], rng.choice(words, int(k))])) for s in sets for k in rng.integers(0, 12, 4)]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (c := len(np.intersect1d(sets[i], sets[j]))) / (len(sets[i]) + len(sets[j]) - c) >= jaccard.THRESHOLD}
    bounds = np.cumsum([0, *map(len, sets)])
    bits = [np.frombuffer(f, dtype=np.uint64) for f in jaccard.parities(np.concatenate(sets), bounds)]
    assert all(jaccard.near(bits[i], bits[j], jaccard.THRESHOLD) for i, j in want) and not all(jaccard.near(bits[0], b, jaccard.THRESHOLD) for b in bits)
    for levels in (np.zeros(1 << jaccard.SLOT_BITS, dtype=np.uint8), rng.integers(0, 256, 1 << jaccard.SLOT_BITS).astype(np.uint8)):
        owner, gram, before, rank = jaccard.postings(np.concatenate(sets), bounds, levels, jaccard.THRESHOLD)
        parts = list(jaccard.candidate_pairs(gram, owner, before, np.diff(bounds)[owner], rank, jaccard.THRESHOLD, most=1))
        assert len(parts) > 1 and want <= {tuple(p) for found in parts for p in found.tolist()} and len(want) > 100


def test_embeddings_finds_pairs_at_the_threshold_in_a_dense_cluster(spark):
    """6,000 vectors at a cosine of about 0.88 to each other, so hundreds lie between near ones in every pass."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    middle, around = unit(rng.standard_normal(64)), unit(rng.standard_normal((6000, 64)))
    v = np.sqrt(0.88) * middle + np.sqrt(0.12) * unit(around - (around @ middle)[:, None] * middle)
    other = rng.standard_normal((300, 64))
    other = unit(other - (other * v[:300]).sum(axis=1, keepdims=True) * v[:300])
    v = np.concatenate([v, 0.953 * v[:300] + np.sqrt(1 - 0.953**2) * other])
    df = spark.createDataFrame([(i, row) for i, row in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["keep_id"] for r in embeddings.near_duplicates(df, per_partition=20_000).collect()}
    root = lambda i: found.get(i, i)
    assert sum(root(i) == root(6000 + i) for i in range(300)) >= 0.95 * 300


def test_pipeline_keeps_texts_that_had_no_words(spark):
    """Substring dedup drops a text that it emptied, not one that was blank before."""
    pipeline = pytest.importorskip("corpus_pipeline")
    passage = " ".join(f"Sentence number {i} speaks of the same thing again and again." for i in range(4))
    rows = [(1, passage, 5), (2, passage, 5), (3, "", 0), (4, " \n\t ", 4), (5, None, None), (6, "One word.", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    out = pipeline.cut_repeats(spark, docs, None)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: (passage, len(passage)), 3: ("", 0), 4: (" \n\t ", 4), 5: (None, None), 6: ("One word.", 9)}


@pytest.mark.parametrize("number", (1, 2, 300))
def test_jaccard_on_unlike_documents(spark, number):
    """No two sets share a signature in any bucket."""
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i}", "s") for i in range(number)], "doc_id long, text string, source string")
    assert jaccard.pairs(docs).count() == 0
    assert jaccard.dedup(docs).count() == number
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.drop_similar(spark, docs, None)
    assert out.columns == docs.columns and out.count() == number


def test_substring_finds_passages_at_any_place_in_a_sentence(spark):
    """51 words without a stop, behind and before 0 to 20 words without one; short stopless lines; and one word over and over."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    rows, passages = [], []
    for p in range(20):
        passage = " ".join(word() for _ in range(51))
        for k in range(21):
            rows.append((len(rows), " ".join([*(word() for _ in range(k)), passage, *(word() for _ in range((7 * k) % 21))])))
        passages.append(passage)
    same, shouts = len(rows), "".join(f"{word()}!! " for _ in range(60))
    rows += [(same, "Osas " * 900), (same + 1, word() + " osas" * 900), (same + 2, word() + " " + shouts), (same + 3, shouts + word())]
    out = {r["doc_id"]: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    later = [i for i in range(same) if i % 21]
    assert sum(out[i]["n_removed"] > 0 for i in later) >= 0.99 * len(later)
    assert all(out[i]["text"] == rows[i][1] for i in range(same) if not i % 21) and out[same + 2]["n_removed"] == 0
    assert len(out[same + 1]["text"].split()) < 40 and out[same + 3]["n_removed"] >= 55


def test_substring_leaves_short_repeats(spark):
    """A shared heading of 14 words is no passage."""
    rows = [(i, f"One heading that every one of these texts has, of fourteen words in all.\nAn own text number {i} with the words a{i} b{i} c{i} d{i} e{i} and f{i}.") for i in range(40)]
    assert {(r["doc_id"], r["text"]) for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(rows)


def test_sharding_query_is_whole_and_balanced(spark, small_dir):
    """Bytes and copies from plain reads; shards are no worse than those of the greedy rule (largest group first to the emptiest shard) and no group is split."""
    from collections import defaultdict

    from quernel.llm import queries

    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_sharding"](spark, small_dir).collect()
    assert {r["doc_id"]: r["bytes"] for r in rows} == {d: len(t.encode()) for d, t in text.items()} and len(rows) == len(text)
    groups, shards, bytes_of = defaultdict(set), [0] * 64, defaultdict(int)
    for r in rows:
        groups[text[r["doc_id"]]].add(r["shard"])
        bytes_of[text[r["doc_id"]]] += r["bytes"]
        shards[r["shard"]] += r["bytes"]
    assert all(len(g) == 1 for g in groups.values())
    greedy = [0] * 64
    for n in sorted(bytes_of.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += n
    assert max(shards) - min(shards) <= max(greedy) - min(greedy)


def test_media_query_against_plain_reads(spark, small_dir):
    """Digest, lengths and metadata from the whole payloads, and the payloads themselves from their ranges."""
    import hashlib

    from quernel.llm import media, queries

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    found = queries.QUERIES["op10_media_columns"](spark, small_dir).cache()
    rows = {r["page_id"]: r.asDict() for r in found.collect()}
    assert rows.keys() == pages.keys()
    for k, html in pages.items():
        raw = html.encode()
        assert rows[k]["digest"] == hashlib.sha256(raw).hexdigest() and rows[k]["raw_length"] == len(raw)
        whole = media.sniff(raw)
        assert {c: rows[k][c] for c in whole} == whole
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in media.fetch(found).collect()} == pages


def test_media_reads_on_where_headers_are_long(spark):
    import struct
    import zlib

    from quernel.llm import media

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\0" * 50
    exif = b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", 60_002) + bytes(60_000) for _ in range(2))
    jpeg = exif + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 300, 400) + b"\0" * 500
    gif = b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0" * 20
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 5, -6) + bytes(20)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16)
    wav = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + struct.pack("<4sI", b"LIST", 9001) + bytes(9002) + fmt + struct.pack("<4sI", b"data", 32_000) + bytes(100)
    noise = b"".join(zlib.crc32(bytes([i % 256, i // 256])).to_bytes(4, "big").hex().encode() for i in range(9000))
    html = b"<html lang='fr'><head><script>" + noise + b"</script><meta charset='utf-8'><title>Late</title></head></html>"
    rows = list(enumerate((png, jpeg, gif, bmp, wav, html)))
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "page_id long, html binary")
    got = {r["page_id"]: (r["media_type"], r["width"], r["height"], r["sample_rate"], r["duration_ms"], r["title"], r["lang"]) for r in media.media_columns(df).collect()}
    none = (None,) * 2
    assert got == {
        0: ("image/png", 640, 480, *none, *none), 1: ("image/jpeg", 400, 300, *none, *none), 2: ("image/gif", 7, 9, *none, *none),
        3: ("image/bmp", 5, 6, *none, *none), 4: ("audio/wav", None, None, 8000, 2000, *none), 5: ("text/html", *none, *none, "Late", "fr"),
    }
