"""A training corpus from the documents table: language, quality, near-copies, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op01_language_id, op05_quality, op07_minhash_dedup, op08_packing
from lodestone.llm import op10_mixing as mixing
from lodestone.llm.common import table, written
from lodestone.llm.queries import tokenizer
from lodestone.session import discard, scratch, ship

#: Texts of no known language, or with less than this share of belief in one, are rejected.
LEAST_BELIEF = 0.5
#: So are texts whose code is longer than this many times the usual rate of their language, and SLACK bits.
MOST_RATE, SLACK = 2.0, 96
#: Numbers of dropped copies that are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 2_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: the best learned language also codes them about as well as its own texts."""
    stats = op01_language_id.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    found = written(op01_language_id.predict(docs.select(*COLUMNS), stats, rate=True))
    usual = op01_language_id.medians(found)
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in usual.items() for x in kv]).cast("map<string,double>"), F.col("lang_pred")) * MOST_RATE
    coded = F.coalesce(F.col("rate") <= limit + SLACK / F.greatest(F.octet_length("text"), F.lit(1)), F.lit(True))
    return found.where((F.col("lang_pred") != op01_language_id.UNKNOWN) & (F.col("score") >= LEAST_BELIEF) & coded).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model takes for good."""
    model = op05_quality.fit(docs, table(spark, sf_dir, "labels"))
    return op05_quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the smallest key, or any if none has a key.

    Five-word shingles at a similarity of 0.8 or more. Rows are told apart by numbers of their own: rows that repeat a
    key but not its text stay, and so do rows without a key that are like no other. Texts without words all stay."""
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    groups = written(op07_minhash_dedup.dedup(rows, k=5, num=80, den=100, key="_row").select("_row", "component_id"))
    named = groups.join(rows.select("_row", F.col("doc_id").isNull().alias("none"), "doc_id"), "_row")
    kept = named.groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "_row"))["_row"].alias("_row"))
    dropped = written(groups.select("_row").join(kept.select("_row"), "_row", "left_anti"))
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_KEYS else dropped
    return rows.join(dropped, "_row", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return op08_packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing)]

#: Models and tokenizers have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a table that the next one reads, and that is deleted then."""
    ship(spark)
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir))
        # What the stage made on the way, and the table it read, are used up.
        discard(*before, *made[:-1])
        before = [docs]
    return docs
