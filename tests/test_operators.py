"""Operators on small made rows: readers, chunking, retrieval both ways, answers, gates, incremental ingest."""

import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import sources as S
from lodestone.operators import answers as A
from lodestone.operators import chunking as C
from lodestone.operators import retrieval as R
from lodestone.streaming import ingest

CATALOG = """version: 1
sources:
  - id: wiki  # the wiki
    name: "Team wiki"
    priority: p0
    acl: public-to-company
    owner:
      team: docs
    doc_types: [guide, "how-to"]
    languages: [en, de]
    location: https://wiki.example/base/
    sample_doc_ids: [setup, faq]
  - id: old
    priority: exclude
    languages: en
other:
  - id: not-a-source
"""


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "wiki").mkdir()
    (root / "wiki" / "setup.md").write_text('---\nid: setup\ntitle: "Set it up"\nlanguage: de\n---\n\n# Heading\nbody\n\n')
    (root / "wiki" / "faq.md").write_text("# Questions\nanswers é\n")
    (root / "wiki" / "wrong.md").write_text("---\nid: right\n---\ntext\n")
    names = [("setup", "wiki"), ("faq", "wiki"), ("wrong", "wiki"), ("gone", "wiki"), ("elsewhere", "nowhere")]
    docs = [{"id": i, "title": i, "source_id": s, "path": f"corpus/{s}/{i}.md"} for i, s in names]
    (root / "manifest.json").write_text(json.dumps({"version": 1, "generated_at": "now", "documents": docs}, indent=1))
    (root / "catalog.yaml").write_text(CATALOG)
    return root


def test_catalog(spark, corpus):
    rows = {r.source_id: r for r in S.read_catalog(spark, str(corpus / "catalog.yaml")).collect()}
    assert set(rows) == {"wiki", "old"}
    assert (rows["wiki"].team, rows["wiki"].doc_types, rows["wiki"].location) == ("docs", ["guide", "how-to"], "https://wiki.example/base/")
    assert rows["old"].languages == ["en"] and rows["old"].sample_doc_ids == []


def test_documents(spark, corpus):
    catalog = S.read_catalog(spark, str(corpus / "catalog.yaml"))
    docs = S.build_documents(S.read_manifest(spark, str(corpus / "manifest.json")), catalog, S.read_markdown(spark, str(corpus)))
    got = {r.path.split("/")[-1][:-3]: r for r in docs.collect()}
    assert {k: r.error for k, r in got.items()} == {"setup": None, "faq": None, "wrong": "id mismatch", "gone": "missing file"}
    assert (got["setup"].title, got["setup"].language, got["setup"].text) == ("Set it up", "de", "# Heading\nbody\n")
    assert (got["faq"].title, got["faq"].language, got["faq"].char_count) == ("Questions", "en", len("# Questions\nanswers é\n"))
    assert got["faq"].updated_at and got["faq"].acl == "public-to-company"


def test_json_lines_round_trip(spark, tmp_path):
    rows = [("d::0000", "d", "s", 0, "naïve ё", ["h"], 7, "a", "t", "p0", "en", "sha256:x")]
    S.write_json_lines(spark.createDataFrame(rows, S.CHUNK), str(tmp_path / "chunks"))
    assert [tuple(r) for r in S.read_chunks(spark, str(tmp_path / "chunks")).collect()] == rows


def test_sections_and_packing():
    text = "before\n# One\na\n## Two\n```\n# not a heading\n```\n### Three\nc\n# Four\n#### five\n"
    assert [h for h, _ in C.sections(text)] == [[], ["One"], ["One", "Two"], ["One", "Two", "Three"], ["Four"]]
    assert C.paragraphs("a\nb\n\n```\nx\n\ny\n```\nlast\n```\nopen") == ["a\nb", "```\nx\n\ny\n```", "last", "```\nopen"]
    fence = "```\n" + "x" * 100 + "\n```"
    assert fence in C.pack("short\n\n" + fence, 80, 10)[-1]
    assert C.pack("y" * 100, 40, 10) == ["y" * 40, "y" * 40, "y" * 40]
    with pytest.raises(ValueError):
        C.split_markdown(10, 10)


def test_chunks_and_report(spark):
    rows = [("a", "# T\n" + "word " * 20 + "\n# U\nhi"), ("b", "tiny"), ("c", "  "), ("d", "tiny")]
    docs = spark.createDataFrame([(i, "s", "", t, "acl", "t", "p0", "en") for i, t in rows], "doc_id string, source_id string, title string, text string, acl string, team string, priority string, language string")
    chunks = C.chunk(docs)
    got = {r.chunk_id: (r.heading_path, r.text) for r in chunks.collect()}
    assert set(got) == {"a::0000", "b::0000", "d::0000"} and got["b::0000"] == (["b"], "tiny\n") and got["a::0000"][0] == ["T"]
    assert sorted(r.chunk_id for r in C.keep_first(chunks).collect()) == ["a::0000", "b::0000"]
    report = C.chunk_report(docs, chunks).first().asDict()
    assert report == {"docs_in": 4, "chunks_before_dedupe": 3, "chunks_dropped": 1, "empty_docs": 1, "chunks_out": 2, "deduped": 1}


@pytest.mark.parametrize("most", [4096, 7])
def test_dense_scores_broadcast_and_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(R, "VECTOR_BLOCK", 50)
    x = np.random.default_rng(1).normal(size=(230, 6))
    vectors = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (999, None)], "id long, vector array<double>")
    queries = vectors.where("id % 10 = 0 OR id = 999").selectExpr("id AS query_id", "vector")
    got = {(r.query_id, r.id): r.score for r in R.dense_scores(vectors, queries, 5, most).collect()}
    scores = x[::10] @ x.T
    want = {(10 * i, int(j)): scores[i, j] for i in range(23) for j in np.argsort(-scores[i])[:5]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert R.dense_scores(vectors, queries.limit(0), 5, most).count() == 0 and R.dense_scores(vectors.limit(0), queries, 5, most).count() == 0


def test_equal_vectors_are_scored_in_bounded_memory():
    equal = pa.RecordBatch.from_pydict({"id": list(range(4096)), "v": pa.array([[1.0] * 64] * 4096, pa.list_(pa.float32()))})
    tracemalloc.start()
    rows = [b.num_rows for b in R._dense_scorer(pa.array(range(256)), np.ones((256, 64)), 10)(iter([equal]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) == 4096 * 256 and max(rows) <= R.PAIRS and peak < 100e6


def test_fusion(spark):
    part = lambda rows: spark.createDataFrame(rows, "query_id long, id string, rank int")
    got = R.fuse(part([(1, "a", 1), (1, "b", 2)]), part([(1, "b", 1), (1, "c", 2)])).orderBy("rank").collect()
    assert [(r.id, r.dense_rank, r.bm25_rank) for r in got] == [("b", 2, 1), ("a", 1, None), ("c", None, 2)]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_search_modes_and_filters(spark):
    docs = spark.createDataFrame([("a", "alpha beta", "t1"), ("b", "alpha", "t2"), ("c", "gamma", "t1")], "id string, text string, team string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    queries = spark.createDataFrame([(1, "Alpha alpha", [1.0, 0.0])], "query_id long, question string, vector array<double>")
    index = R.build_lexical(docs, "id")
    run = lambda **o: [r.id for r in R.search(index, vectors, docs.select("id", "team"), queries, **o).orderBy("rank").collect()]
    assert run(mode="dense") == ["a", "b", "c"] and run(mode="bm25") == ["b", "a"]
    assert run(team="t1") == ["a", "c"] == run(team="t1", overfetch=None) and run(team="none") == []
    with pytest.raises(ValueError):
        run(mode="other")


def test_embeddings_are_reused(spark):
    chunks = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "chunk_id string, text string, content_hash string")
    first = R.embed_incremental(chunks, None, R.HashEmbedder(8))
    flags = lambda e, changed: {r.chunk_id: r.reused for r in R.embed_incremental(changed, first, e).collect()}
    changed = chunks.withColumn("content_hash", F.when(F.col("chunk_id") == "b", "new").otherwise(F.col("content_hash")))
    assert flags(R.HashEmbedder(8), changed) == {"a": True, "b": False}
    assert flags(R.HashEmbedder(16), chunks) == {"a": False, "b": False}


def test_answers_and_refusals(spark):
    hits = spark.createDataFrame([(1, 1, "a::0", "a", "s", ["A"], "text of a"), (1, 2, "a::1", "a", "s", ["A", "B"], "# head\n---\nmore"), (2, 1, "a::0", "a", "s", ["A"], "text of a")], "query_id long, rank int, chunk_id string, doc_id string, source_id string, heading_path array<string>, text string")
    queries = spark.createDataFrame([(1, "How is it done?"), (2, "Where is it?"), (3, "And this?"), (4, " ")], "query_id long, question string")
    sure = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.9), (4, 0.9)], "query_id long, confidence double")
    cited = hits.withColumn("index", F.col("rank").cast("long"))
    got = {r.query_id: r for r in A.ask(hits, queries, sure, cited).collect()}
    assert {i: r.refuse_reason for i, r in got.items()} == {1: None, 2: "low_confidence", 3: "empty_retrieval", 4: "empty_query"}
    assert got[1].answer == f"{A.LEAD}\n\n**A** [1]\ntext of a\n\n**A / B** [2]\nhead\nmore" and got[1].n_citations == 2
    assert A.first_per_document(hits).count() == 2


def test_rates_and_winner(spark):
    rows = [("refuse", True, True, True), ("answer", False, True, True), ("answer", True, True, False)]
    got = A.ask_rates(spark.createDataFrame(rows, "expected_behavior string, refuse boolean, citation_ok boolean, grounded_ok boolean")).first()
    assert (got.refuse_rate, got.answered_rate, got.grounded_among_answered) == (1.0, 0.5, 1.0)
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "query_id long, first_rank long")
    m = A.recall_mrr(ranks.where("query_id < 3")).first()
    assert (m.recall_at_1, m.recall_at_10, m.mrr) == (0.5, 1.0, 0.75) and A.recall_mrr(ranks).first().mrr == pytest.approx(0.5)
    runs = spark.createDataFrame([("x", 1.0, 0.8), ("y", 1.0, 0.9), ("z", 1.0, 0.9)], "run string, recall_at_10 double, mrr double")
    assert A.winner(runs, ("recall_at_10", "mrr")).first().run == "y"


def test_gold_errors(spark):
    good = ("q-one", "A question?", "how-to", "answer", ["a"], "a", ["wiki"], "p0", None, None, None, "en")
    rows = [good, ("bad id", "Hm", "riddle", "answer", [], "b", ["else"], "p0", None, None, None, "en")]
    got = {r.id: r.errors for r in A.gold_errors(spark.createDataFrame(rows, S.GOLD), spark.createDataFrame([("wiki",)], "source_id string")).collect()}
    assert got["q-one"] == [] and set(got["bad id"]) == {"bad id", "short question", "bad query_type", "no relevant document", "primary not relevant", "unknown source"}


def test_gated_write(spark, tmp_path):
    df = spark.range(3)
    no, yes = (spark.createDataFrame([(ok,)], "ok boolean") for ok in (False, True))
    assert not S.gated_write(df, no, str(tmp_path / "t")) and not (tmp_path / "t").exists()
    assert S.gated_write(df, yes, str(tmp_path / "t")) and spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_ingest_takes_each_content_once(spark, tmp_path):
    schema = "doc_id string, source_id string, title string, text string, acl string, team string, priority string, language string"
    place = lambda n: str(tmp_path / n)
    run = lambda: ingest(spark, place("in"), schema, place("out"), place("state")).awaitTermination()
    for batch in ([("a", "first text"), ("b", "first text")], [("c", "first text"), ("d", "second text")]):
        spark.createDataFrame([(i, "s", "", t, "x", "t", "p0", "en") for i, t in batch], schema).write.mode("append").parquet(place("in"))
        run()
    assert sorted(r.chunk_id for r in spark.read.parquet(place("out")).collect()) == ["a::0000", "d::0000"]


def test_every_term_of_every_document_is_returned(spark):
    from lodestone import plans

    sf = "/root/testdata/sf0.001"
    got = plans.queries()["all_term_frequencies"](spark, sf)
    n = plans.queries()["tokenize_counts"](spark, sf).agg(F.sum("n_tokens")).first()[0]
    assert got.agg(F.sum("tf")).first()[0] == n and got.where("tf = 1").count() > 0 and got.count() == got.select("doc_id", "term").distinct().count()


def test_keep_first_keeps_one_row_without_content(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "doc_id long, content_hash string")
    got = C.keep_first(rows, order=("doc_id",))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2] and set(got.columns) == {"doc_id", "content_hash"}
