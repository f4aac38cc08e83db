"""The pipeline's language stage: other languages and letters at random go, texts of the learned languages stay."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import op01_language_id

SF = "/root/testdata/sf0.001"


def test_other_languages_and_gibberish_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    letters = random.Random(1)
    planted = ["zxqv kkjw pppl qqzx wvut", "Съешь же ещё этих мягких французских булок, да выпей чаю.", "これは日本語の文章です。学習していない言語です。", "Η γλώσσα αυτή δεν έχει μαθευτεί ποτέ.", "".join(letters.choices("abcdefghijklmnopqrstuvwxyz     ", k=400)), None, "", "123 456"]
    rows = spark.createDataFrame([(10**9 + i, t, None, "src1", 0) for i, t in enumerate(planted)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(rows), SF)
    assert kept.where("doc_id >= 1000000000").count() == 0
    assert docs.join(kept.select("doc_id"), "doc_id", "left_anti").count() <= 0.01 * docs.count()


def test_rates(spark):
    docs = spark.createDataFrame([(i, f"the cat sat on mat {i % 5}", "en", "x") for i in range(40)] + [(None, "the cat", "en", "x"), (50, None, "en", "x"), (51, "?!", "en", "x")], "doc_id long, text string, lang string, rate string")
    stats = op01_language_id.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    usual = op01_language_id.usual_rates(docs, stats)
    assert set(usual) == {"en"} and 0 < usual["en"] < 2
    got = {r.doc_id: (r.lang_pred, r.rate) for r in op01_language_id.predict(docs, stats, keep=["doc_id", "rate"], rate=True).collect()}
    assert got[50] == got[51] == ("und", None) and 0 < got[1][1] < 2
    assert op01_language_id.usual_rates(docs.limit(0), stats) == {}
    assert op01_language_id.predict(docs, ([], [], []), rate=True).where("rate IS NULL").count() == docs.count()


def test_usual_rates_are_those_of_all_labelled_texts(spark, monkeypatch):
    letters = random.Random(2)
    texts = [f"the cat sat on mat {i} " + "".join(letters.choices("etaoin shrdlu", k=i % 50)) for i in range(401)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(900 + i, f"le chat dort {i}", "fr") for i in range(3)], "doc_id long, text string, lang string")
    stats = op01_language_id.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    monkeypatch.setattr(op01_language_id, "SAMPLE_DOCS", 3)
    rows = op01_language_id.predict(docs, stats, rate=True).where("lang = lang_pred").collect()
    usual = op01_language_id.usual_rates(docs, stats)
    for lang in ("en", "fr"):
        own = sorted(round(r.rate, 3) for r in rows if r.lang == lang)
        assert usual[lang] == own[(len(own) - 1) // 2]
