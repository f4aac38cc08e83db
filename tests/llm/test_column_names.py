"""Columns beside the ones that an operator reads may have any name, and keep their values."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import op01_language_id, op05_quality, op10_mixing

SF = "/root/testdata/sf0.001"
NAMES = ("times", "target", "source_size", "_lettered", "_text", "_k0", "_p", "_s", "_h", "_row", "_copy", "_times", "_bound", "a.b", "c`d", "k", "s", "h")


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    return docs.select("*", *[F.concat(F.lit(f"{i} "), "doc_id").alias(c) for i, c in enumerate(NAMES)])


def values(df, added=()):
    out = df.collect()
    assert df.columns == [*("doc_id", "text", "lang", "source"), *NAMES, *added]
    assert all(r[4 + i] == f"{i} {r.doc_id}" for r in out for i in range(len(NAMES)))
    return out


def test_language(spark, clashing):
    stats = op01_language_id.fit(clashing, F.col("text"), F.col("lang"), F.col("doc_id"))
    got = values(op01_language_id.predict(clashing, stats, rate=True), ("lang_pred", "score", "rate"))
    plain = {r.doc_id: r.lang_pred for r in op01_language_id.predict(clashing.select("doc_id", "text"), stats).collect()}
    assert {r.doc_id: r.lang_pred for r in got} == plain
    few = op01_language_id.predict(clashing, stats, keep=["a.b", "_lettered"])
    assert few.columns == ["a.b", "_lettered", "lang_pred", "score"] and few.count() == len(got)
    assert len(values(op01_language_id.predict(clashing, ([], [], [])), ("lang_pred", "score"))) == len(got)


def test_quality(spark, clashing):
    model = op05_quality.fit(clashing, spark.read.parquet(f"{SF}/labels.parquet"))
    got = values(op05_quality.score(clashing, model), ("score", "predicted"))
    plain = {r.doc_id: r.score for r in op05_quality.score(clashing.select("doc_id", "text"), model).collect()}
    assert {r.doc_id: r.score for r in got} == plain


def test_mixed(spark, clashing):
    got = sorted(r.doc_id for r in values(op10_mixing.mixed(clashing)))
    assert got == sorted(r.doc_id for r in op10_mixing.mixed(clashing.select("doc_id", "text", "source")).collect())
    taken = {r.doc_id: r.taken // max(r["size"], 1) for r in op10_mixing.mix(clashing).collect()}
    assert all(got.count(i) == n for i, n in taken.items())
