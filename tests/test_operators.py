"""Literal cases for the functions and operators that the driver's tables don't exercise."""

from pyspark.sql import functions as F

from quernel.functions import extract, normalise, terms
from quernel.operators import filters, kb, prompts, query, rank, search, service, serving, sessions
from quernel.sources import readers, writers
from quernel.streaming import streams

JUDGMENT = """TÒA ÁN NHÂN DÂN THÀNH PHỐ A
Bản án số: 12/2023/HS-ST
Ngày: 5/6/2023
Bị cáo: Nguyễn Văn B
Thẩm phán: Trần Thị C;
bị cáo phạm tội trộm cắp tài sản theo Điều 173 khoản 1 Bộ luật hình sự 2015
1. Bị cáo đã lấy một chiếc xe máy của bị hại.
Tuyên bố: bị cáo có tội
Phạt 2 năm tù. Bản án hình sự."""


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_extraction(spark):
    d = one(spark, JUDGMENT, extract.legal_document(F.col("t")).alias("d"), extract.confidence(extract.legal_document(F.col("t"))).alias("c"))
    assert d["d"]["case_number"] == "12/2023/HS-ST" and d["d"]["date_issued"] == "5/6/2023"
    assert d["d"]["document_type"] == "Bản án hình sự" and d["d"]["parties"]["defendants"][0] == "Nguyễn Văn B"
    assert "Điều 173 khoản 1" in d["d"]["legal_references"] and 0.5 < d["c"] <= 1
    assert one(spark, "Ông  NAM ", extract.normalise_entity(F.col("t")).alias("n"))["n"] == "nam"
    assert one(spark, "2023-5-6", extract.parse_date(F.col("t")).cast("date").cast("string").alias("n"))["n"] == "2023-05-06"
    assert one(spark, JUDGMENT, terms.counts(F.col("t")).alias("n"))["n"]["court_terms"]["thẩm phán"] == 1


def test_normalisation(spark):
    rows = spark.createDataFrame([("Diéu 10  Khoán 2 của Luàt ,và 7 %",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(normalise.clean(F.col("t"))).collect()] == ["Điều 10 Khoản 2 của Luật, và 7%", None, ""]
    assert normalise.numbers("1,5 và 1.000") == "1.5 và 1,000"
    assert normalise.expand("UBND Q. 1") == "UBND Quận 1" and normalise.expand("UBND", True) == "Ủy ban nhân dân"
    assert normalise.document_numbers("luật  số 45 / 2019 / QH14") == "Luật số 45/2019/QH14"
    assert normalise.cross_references("theo điều 5 của luật đất đai") == "theo Điều 5 Luật đất đai"
    assert normalise.compose("é") == "é"


def test_filters_treat_null_as_false(spark):
    df = spark.createDataFrame([(1, "Abc", 5.0), (2, None, None), (3, "xyz", 7.0)], "id int, s string, v double")
    ids = lambda node: sorted(r["id"] for r in filters.apply(df, node).collect())
    assert ids(filters.Criterion("s", "NOT_EQUALS", "zzz")) == [1, 3]
    assert ids(filters.Criterion("v", "NOT_IN_LIST", [5.0])) == [3]
    assert ids(filters.Criterion("s", "IS_NULL", None)) == [2]
    assert ids(filters.Criterion("s", "EQUALS", "ABC")) == [1]
    assert ids(filters.Group("OR", [filters.Criterion("v", "BETWEEN", [5, 6]), filters.Criterion("s", "ENDS_WITH", "YZ")])) == [1, 3]


def test_knowledge_base(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, h string")
    old = spark.createDataFrame([("b",)], "h string")
    assert sorted(r["id"] for r in kb.insert_if_absent(new, old, ["h"], "id").collect()) == [1, 4]
    mentions = spark.createDataFrame([(1, "p", "Ông Nam"), (2, "p", "NAM"), (3, "o", "Tòa")], "seq int, entity_type string, name string")
    got = {(r["entity_type"], r["normalized_name"]): (r["name"], r["frequency"]) for r in kb.resolve_entities(mentions).collect()}
    assert got == {("p", "nam"): ("Ông Nam", 2), ("o", "tòa"): ("Tòa", 1)}


def test_blocks_equal_expressions(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(6)]) for i in range(40)]
    v = spark.createDataFrame(rows + [(99, None), (98, []), (97, [1.0, 2.0])], "vec_id long, embedding array<double>")
    q = v.where("size(embedding) = 6").withColumnRenamed("vec_id", "query_id")
    for metric in ("cosine", "euclidean", "manhattan", "chebyshev", "dot", "angular", "pearson", "spearman"):
        a = {(r[0], r[1]): (round(r[2], 7), r[3]) for r in search.knn(q, v, 5, metric).collect()}
        plain = search.scores(q, v.where("size(embedding) = 6"), metric).withColumn("score", F.round("score", 9))
        b = {(r[0], r[1]): (round(r[2], 7), r[3]) for r in search.top_k(plain, 5).select("query_id", "vec_id", "score", "rank").collect()}
        assert a == b


def test_clustered_search_finds_most(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(200)]
    v = search.prepare(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    indexed, centres = search.ivf_index(v, 200)
    q = v.withColumnRenamed("vec_id", "query_id")
    near = {(r["query_id"], r["vec_id"]) for r in search.ivf_search(q, indexed, centres, 5, probes=10).collect()}
    exact = {(r["query_id"], r["vec_id"]) for r in search.knn(q, v, 5).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_document_counts_shuffle_terms_not_postings(spark):
    docs = spark.createDataFrame([(i, f"same words again, again w{i % 3}") for i in range(60)] + [(90, None), (91, ""), (92, "a b")], "doc_id long, text string").repartition(2)
    found = rank.document_counts(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(term" in plan and "hashpartitioning(doc_id" not in plan
    assert plan.count("regexp_replace") == 1
    assert {r["term"]: r["df"] for r in found.collect()} == {"same": 60, "words": 60, "again": 60, "w0": 20, "w1": 20, "w2": 20}


def test_ranking_pieces(spark):
    got = spark.createDataFrame([(["a", "b"], ["b", "c"])], "a array<string>, b array<string>").select(rank.jaccard(F.col("a"), F.col("b")), serving.overlap(F.col("a"), F.col("b"))).first()
    assert abs(got[0] - 1 / 3) < 1e-9 and got[1] == 0.5
    assert query.preprocess("What's the Contract, and NOT it?")
    found, truth = spark.createDataFrame([(1, 1), (1, 2)], "query_id int, doc_id int"), spark.createDataFrame([(1, 2), (1, 3)], "query_id int, doc_id int")
    assert tuple(serving.id_sets(found, truth).first())[1:] == (0.5, 0.5, 0.5)


def test_cached_embeddings(spark):
    serving.add_generator("lengths", lambda texts: [[float(len(t)), 1.0] for t in texts])
    rows = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "de"), (4, " ")], "id int, text string")
    cache = spark.createDataFrame([], "text_key string, embedding_model string, embedding array<double>")
    out, fresh = serving.embed_cached(rows, cache, "lengths")
    assert {r["id"]: r["embedding"][0] for r in out.collect()} == {1: 3.0, 2: 3.0, 3: 2.0} and fresh.count() == 2
    out, fresh = serving.embed_cached(rows, fresh, "lengths")
    assert out.count() == 3 and fresh.count() == 0
    calls = []
    assert serving.retry(lambda: calls.append(1) or len(calls) > 2 or 1 / 0, wait=lambda s: None) is True and len(calls) == 3


def test_batch_errors_drop_rows_alone(spark):
    rows = spark.range(0, 10, numPartitions=2)
    assert serving.process_batch(rows, lambda pdf: pdf, "id long").count() == 10
    assert serving.process_batch(rows, lambda pdf: 1 / 0, "id long").count() == 0

    def picky(pdf):
        if (pdf["id"] == 3).any():
            raise ValueError
        return pdf

    assert sorted(r["id"] for r in serving.process_batch(rows, picky, "id long").collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]


def test_filters_without_their_columns_pass_nothing(spark):
    df = spark.createDataFrame([(1, "2024-01-05")], "id int, day string")
    for node in (filters.similarity(0.1), filters.Criterion("when", "GREATER_EQUAL", "2024-01-01", "temporal"), filters.Criterion("day", "BETWEEN", "2024", "temporal"), filters.Criterion("day", "BETWEEN", ["x"], "temporal")):
        assert filters.apply(df, node).count() == 0
    assert filters.apply(df, filters.Criterion("day", "BETWEEN", ["2024-01-01", "2024-02-01"], "temporal")).count() == 1


def test_prompts(spark):
    import pytest

    lib = prompts.Library()
    text = lib.prompt("legal_qa", **prompts.variables("Is it valid?"))
    assert "Is it valid?" in text["user"] and text["system"]
    with pytest.raises(ValueError, match="missing: question"):
        lib.prompt("legal_qa", legal_area="x", jurisdiction="x", context="x", questioner_background="x", urgency_level="x")
    with pytest.raises(ValueError, match="no template"):
        lib.prompt("nothing")
    assert lib.add(prompts.Template("My Own", "legal_qa", "s", ["a"])) == "my_own" and "A: 7" in lib.prompt("my_own", a=7)["user"]
    use = sessions.template_usage(lib.usage(spark)).first()
    assert use["total"] == 4 and use["success_rate"] == 0.5 and use["top"][0] == "legal_qa" and use["recent"][-1] == "my_own"
    assert [r["name"] for r in prompts.lookup(lib.table(spark), "legal_qa").collect()] == ["legal_qa", "my_own"]
    assert [r["name"] for r in prompts.lookup(lib.table(spark), document_type="contract").collect()] == ["contract_review"]
    assert len(prompts.follow_ups("legal_research")) == 3 and prompts.follow_ups("x") == prompts.follow_ups("legal_qa")


def test_moving_average_over_ranges(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("aaab"), i, rng.random()) for i in range(3000)]
    want = {}
    for g, _, v in rows:
        want[g] = v if g not in want else 0.9 * want[g] + 0.1 * v
    got = {r["g"]: r["ema"] for r in sessions.ema(spark.createDataFrame(rows, "g string, i int, v double").repartition(3), "g", "i", "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_service_takes_models_apart(spark):
    v = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", [0.8, 0.6]), (3, "n", [1.0, 0.1])], "vec_id long, model string, embedding array<double>")
    q = spark.createDataFrame([(0, 0, "m", [1.0, 0.0]), (0, 1, "n", [0.0, 1.0])], "query_id int, variant int, model string, embedding array<double>")
    assert sorted((r["vec_id"], round(r["score"], 6)) for r in service.retrieve(q, v, 5, 0.5, model="model").collect()) == [(1, 1.0), (2, 0.8)]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PNG").write_bytes(b"x")
    (tmp_path / "in/b.txt").write_bytes(b"one\ntwo")
    (tmp_path / "in/s.json").write_text('{"detailed_results": {"a.pdf": {"ok": true}, "b.pdf": {"ok": false}}}')
    assert [r["stem"] for r in readers.images(spark, str(tmp_path / "in")).collect()] == ["a"]
    raw = readers.files(spark, str(tmp_path / "in"), r"\.(txt|PNG)$")

    def parser(path, content):
        if path.endswith("PNG"):
            raise ValueError
        return enumerate(content.decode().split("\n"), 1)

    pages = readers.parse(raw, parser, readers.PAGES)
    assert readers.document_texts(pages).select("text", "total_pages").first() == ("one\ntwo", 2)
    assert readers.failures(raw, pages).count() == 1
    assert {r["name"] for r in readers.summary(spark, str(tmp_path / "in/s.json")).collect()} == {"a.pdf", "b.pdf"}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    writers.append(rows, str(tmp_path / "t"), ["p"])
    writers.replace_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), str(tmp_path / "t"), ["p"])
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 9]
    m = spark.createDataFrame([(1,), (2,)], "version int")
    assert [r["version"] for r in writers.pending(m, m.where("version = 1")).collect()] == [2]


def test_streams(spark, tmp_path):
    rows = [(1, "u", "2024-01-01 00:00:05", 1.0), (2, "u", "2024-01-01 00:00:50", 2.0), (2, "u", "2024-01-01 00:00:51", 2.0), (3, "v", "2024-01-01 00:05:00", 3.0), (4, "v", "2024-01-02 00:00:00", 4.0)]
    spark.createDataFrame(rows, "id long, user string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, user string, ts timestamp, value double").parquet(str(tmp_path / "in"))

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("t").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{len(list(tmp_path.iterdir()))}")).start()
        q.awaitTermination(120)
        return spark.table("t").collect()

    counts = run(streams.request_windows(stream, "user", "ts"), "append")
    assert {(r["user"], r["requests"]) for r in counts} >= {("u", 3), ("v", 1)}
    assert len(run(streams.first_seen(stream, ["id"], "ts"), "append")) == 4
    ema = {r["user"]: r["ema"] for r in run(streams.latest_response(stream, "user", "value", "ts"), "update")}
    assert abs(ema["u"] - (0.9 * (0.9 * 1 + 0.1 * 2) + 0.2)) < 1e-9
    seen = []
    streams.ingest(stream, lambda b, i: seen.append(b.count()), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert sum(seen) == 5


def test_entry_works_without_the_llm_parts(spark, tmp_path):
    """The entry file alone with the rest of the library, in another process."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quernel", tmp_path / "quernel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
