"""The queries op1 to op10 and pipeline over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_language_id, op02_ann, op04_lm, op03_token_counts, op05_quality, op08_packing
from . import op06_embedding_dedup, op07_minhash_dedup, op09_html
from . import op10_mixing as mixing
from . import op11_periodic_runs, op12_token_files, op13_token_alignment
from .common import remainder, table
from .oracles import SQL


def tokenizer(name: str) -> str:
    """A public tokenizer's file; the package lies beside the library on every worker."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    seen = docs.where(~held)
    stats = op01_language_id.fit(seen, F.col("text"), F.col("lang"), F.col("doc_id"))
    out = op01_language_id.predict(docs, stats, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op04_lm.score(docs, remainder(F.col("doc_id"), 10) == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = op05_quality.fit(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    out = op05_quality.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_minhash_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_html.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)

def op12_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_token_alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_ann, op3_token_counts, op4_lm, op5_quality, op6_embedding_dedup, op7_minhash_dedup, op8_packing, op9_html, op10_mixing, op11_runs, op12_binary, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
