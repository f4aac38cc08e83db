"""Reports, thresholds as maps, sketches of percentiles, gates measured while writing, ingest by state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import sources as S
from lodestone.operators import reports as P
from lodestone.streaming import ingest


def test_thresholds_merge_over_defaults(spark):
    row = spark.createDataFrame([(0.8, 0.4, 3)], "recall_at_10 double, mrr double, n long")
    got = P.gated(row, P.RETRIEVAL_GATES).first()
    assert got.thresholds == P.RETRIEVAL_GATES and got.gates == {"recall_at_10": True, "mrr": False} and not got.passed
    own = F.create_map(F.lit("mrr"), F.lit(0.4), F.lit("n"), F.lit(3.0))
    assert P.gated(row, P.RETRIEVAL_GATES, own).first().gates == {"recall_at_10": True, "mrr": True, "n": True}
    assert P.gated(row, P.RETRIEVAL_GATES, F.create_map(F.lit("absent"), F.lit(0.0))).first().gates["absent"] is False
    assert P.gated(row, {"mrr": 0.1}, F.lit(None).cast("map<string,double>")).first().passed


def test_eval_report_lists_misses(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 11)], "query_id long, first_rank long")
    docs = spark.createDataFrame([(3, "a", 1), (3, "b", 2), (4, "c", 1)], "query_id long, doc_id string, doc_rank long")
    got = P.eval_report(ranks, docs, most=1).first()
    assert (got.n, got.recall_at_1, got.recall_at_10, got.mrr, got.n_misses) == (4, 0.25, 0.5, 0.375, 2)
    assert [tuple(m) for m in got.misses] == [(3, None, ["a", "b"])] and not got.passed
    assert P.eval_report(ranks.limit(0), docs).first().misses == []


def test_ask_report_lists_failures(spark):
    rows = [(1, "refuse", False, None, False, True, True, []), (2, "answer", False, None, True, True, False, ["x"]), (3, "answer", True, "secret", True, True, True, []), (4, "answer", False, None, True, False, True, ["y"])]
    cases = spark.createDataFrame(rows, "query_id long, expected_behavior string, refuse boolean, refuse_reason string, refuse_ok boolean, citation_ok boolean, grounded_ok boolean, cited_doc_ids array<string>")
    assert sorted((r.query_id, r.failure) for r in P.case_failures(cases).collect()) == [(1, "not refused"), (2, "not grounded"), (4, "broken citation")]
    got = P.ask_report(cases).first()
    assert (got.refuse_failures, got.ungrounded, got.broken_citations, got.refuse_rate) == (1, 1, 1, 0.0) and [f.query_id for f in got.failures] == [1, 2, 4]


def test_sketches_merge_without_the_rows(spark, tmp_path):
    values = np.random.default_rng(1).lognormal(size=40_000)
    rows = spark.createDataFrame([(f"2024-01-{1 + i % 10:02d}", "e" if i % 3 else "f", float(v)) for i, v in enumerate(values)] + [("2024-01-01", "e", None)], "ts string, event_type string, value double")
    P.latency_sketches(rows).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 20 and stored.agg(F.max(F.length("sketch"))).first()[0] < 8000
    own = {"e": np.array([v for i, v in enumerate(values) if i % 3]), "f": values[::3]}
    for r in P.percentiles(stored).collect():
        assert r.n == len(own[r.event_type])
        for name, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert abs((own[r.event_type] <= r[name]).mean() - share) <= 0.0165


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("other", "other")
    return out, n


def test_observed_write_measures_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "t")
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    chunks = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", None)], "chunk_id string, text string").mapInPandas(touch, "chunk_id string, text string")
    metrics = S.chunk_metrics(("chunk_id", "text"))
    (ok, values), n = jobs(spark, "fails", lambda: S.observed_write(chunks, path, metrics, lambda m: m["incomplete"] == 0))
    assert not ok and values == {"rows": 3, "incomplete": 1, "chars": 6} and n == 1 and seen.value == 3
    assert not list(tmp_path.iterdir())
    assert S.observed_write(chunks.where("text IS NOT NULL"), path, metrics, lambda m: m["incomplete"] == 0)[0]
    assert not S.observed_write(chunks, path, metrics, lambda m: m["incomplete"] == 0)[0]
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception, match="broken"):
        S.observed_write(spark.range(1).select(F.raise_error(F.lit("broken")).alias("x")), path, {"rows": F.count(F.lit(1))}, bool)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_written_tables_are_in_key_order(spark, tmp_path):
    S.write_table(spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7), str(tmp_path / "t"), "k")
    parts = [[r.k for r in spark.read.parquet(str(p)).collect()] for p in sorted((tmp_path / "t").glob("part-*"))]
    assert sum(parts, []) == list(range(1000))


DOC = "doc_id string, source_id string, title string, text string, acl string, team string, priority string, language string"


def test_ingest_forgets_after_expiry_and_replays_nothing(spark, tmp_path):
    place = lambda n: str(tmp_path / n)
    run = lambda: ingest(spark, place("in"), f"{DOC}, at string", place("out"), place("state"), "at", "2 days").awaitTermination()
    put = lambda rows: spark.createDataFrame([(i, "s", "", t, "x", "t", "p0", "en", at) for i, t, at in rows], f"{DOC}, at string").write.mode("append").parquet(place("in"))
    have = lambda: sorted(r.chunk_id for r in spark.read.parquet(place("out")).collect())
    put([("a", "first text", "2024-01-01"), ("b", "first text", "2024-01-01")])
    run()
    run()  # restarted without new documents
    put([("c", "first text", "2024-01-02"), ("d", "second text", "2024-01-09")])
    run()
    once = have()
    assert len(once) == 2 and once[1] == "d::0000"
    put([("e", "first text", "2024-01-10")])  # forgotten by now
    run()
    assert have() == [*once, "e::0000"] and set(spark.read.parquet(place("out")).columns) >= {"chunk_id", "content_hash"}
