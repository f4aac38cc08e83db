"""The inverted index against plain scores, and how many blocks its searches read."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import inverted as I
from lodestone.operators import retrieval as R


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    return {i: " ".join(["all", *(f"t{min(int(x), 60)}" for x in rng.zipf(1.3, rng.integers(0, 60))), *(["rare"] * (i in (17, 418))), *(["all"] * (i % 7))]) for i in range(600)} | {600: "", 601: None}


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").coalesce(2)
    return I.write_inverted(R.build_lexical(docs, "id"), str(tmp_path_factory.mktemp("inverted")), width=16)


def scores(texts, question):
    words = {i: Counter((t or "").split()) for i, t in texts.items()}
    n, avg, df = len(words), sum(map(Counter.total, words.values())) / len(words), Counter(w for c in words.values() for w in c)
    part = lambda w, c: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / avg))
    return {i: s for i, c in words.items() if (s := sum(part(w, c) for w in (question or "").lower().split() if c[w])) > 0}


ASKED = {0: "rare", 1: "all", 2: "T3 t3 t17 rare", 3: "nothing", 4: None, 5: "all t1 t2 t59", 6: "t41 t42 t43 t44"}


@pytest.mark.parametrize(("k", "first", "few"), [(1, 1, 2000), (4, 2, 2000), (4, 2, 1), (50, 1, 2000), (1000, 3, 2000)])
def test_best_equal_plain_scores(spark, texts, index, monkeypatch, k, first, few):
    monkeypatch.setattr(I, "FEW_TERMS", few)
    monkeypatch.setattr(I, "QUERIES", 3)
    queries = spark.createDataFrame(list(ASKED.items()), "query_id long, question string")
    got = {(r.query_id, r.id): r.score for r in I.search_blocks(index, queries, k, first).collect()}
    want = {}
    for q, text in ASKED.items():
        own = scores(texts, text)
        want |= {(q, i): own[i] for i in sorted(own, key=lambda i: (-round(own[i], 9), i))[:k]}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_rare_words_read_few_blocks(spark, index):
    queries = spark.createDataFrame([(0, "rare"), (1, "all"), (2, "all rare")], "query_id long, question string")
    read = {r.query_id: (r.blocks, r.read) for r in I.blocks_read(index, queries, 1).collect()}
    assert read[0][0] == 2 and read[0][1] <= 2
    assert read[1][0] >= 38 and read[1][1] < read[1][0] / 2  # ranges without a document of many "all" are passed over
    assert read[2][0] == read[1][0] + 2 and read[2][1] <= 6


def test_blocks(spark, index, texts):
    blocks = index.blocks.collect()
    words = {i: Counter((t or "").split()) for i, t in texts.items()}
    assert {(b.term, i): (t, n) for b in blocks for i, t, n in zip(b.ids, b.tfs, b.dls, strict=True)} == {(w, i): (c[w], c.total()) for i, c in words.items() for w in c}
    assert max(len(b.ids) for b in blocks) <= 16 and len({(b.term, b.range) for b in blocks}) == len(blocks)
    row = index.stats.first()
    assert all(b.peak == pytest.approx(max(t * 2.5 / (t + 1.5 * (0.25 + 0.75 * n / row.avgdl)) for t, n in zip(b.tfs, b.dls, strict=True))) for b in blocks)


def test_terms_reach_the_scan_as_a_filter(spark, index):
    words = spark.createDataFrame([(0, "rare", 1.0)], "query_id long, term string, w double")
    plan = I.range_bounds(index, words)._jdf.queryExecution().toString()
    assert "EqualTo(term,rare)" in plan and "ids" not in plan.split("ReadSchema")[-1]


def test_empty_inputs(spark, index, tmp_path):
    none = spark.createDataFrame([], "query_id long, question string")
    assert I.search_blocks(index, none, 3).count() == 0
    docs = spark.createDataFrame([], "id long, text string")
    empty = I.write_inverted(R.build_lexical(docs, "id"), str(tmp_path / "x"))
    assert I.search_blocks(empty, spark.createDataFrame([(1, "a")], "query_id long, question string"), 3).count() == 0


def test_blocks_are_written_where_they_lie(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "RUN", 400)
    monkeypatch.setattr(I, "BATCH", 50)
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").coalesce(2)
    index = I.write_inverted(R.store_lexical(R.build_lexical(docs, "id"), str(tmp_path / "l")), str(tmp_path / "i"), width=16)
    files = index.blocks.select("range", F.input_file_name().alias("f")).groupBy("range").agg(F.countDistinct("f").alias("n"))
    assert files.where("n > 1").count() == 0  # a range's blocks never leave their task
    assert sorted(i for r in index.members.collect() for i in r.ids) == sorted(texts)
    queries = spark.createDataFrame(list(ASKED.items()), "query_id long, question string")
    for q, text in ASKED.items():
        own = scores(texts, text)
        got = [(r.id, round(r.score, 9)) for r in I.search_blocks(index, queries.where(F.col("query_id") == q), 4).orderBy(F.desc("score"), "id").collect()] if q in (0, 5) else None
        assert got is None or dict(got) == {i: round(own[i], 9) for i in sorted(own, key=lambda i: (-round(own[i], 9), i))[:4]}


def test_blocks_are_shuffled_once(spark, index):
    words = spark.createDataFrame([(0, "rare", 1.0), (1, "all", 1.0)], "query_id long, term string, w double")
    pairs = spark.createDataFrame([(q, r.range) for r in index.members.collect() for q in (0, 1)], "query_id long, range long")
    plan = I._best(index, words, pairs, 3, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "term" not in " ".join(x for x in plan.splitlines() if "Join" in x)
