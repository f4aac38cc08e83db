"""The stored index: chunks, their words, their vectors and what it was built from, as tables in one folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.retrieval import LexicalIndex, build_lexical, load_lexical, store_lexical

EMBEDDINGS = "chunk_id string, embedding array<float>, content_hash string, model_name string, reused boolean"


@dataclass
class Index:
    """lexical tables (None: for dense searches only), vectors(id, vector), meta(id and the chunk's other columns) and
    info, one row (None where nothing was stored)."""

    lexical: LexicalIndex | None
    vectors: DataFrame
    meta: DataFrame
    info: DataFrame | None


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """Vectors of chunks and, beside them, one row of meta: model_name, dim, count, normalized."""
    embeddings.write.mode("overwrite").parquet(f"{path}/vectors")
    own = embeddings.sparkSession.read.schema(embeddings.schema).parquet(f"{path}/vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    own.agg(F.max("model_name").alias("model_name"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"), F.count("*").alias("count"), F.coalesce(F.bool_and(F.abs(norm - 1) < 1e-3), F.lit(True)).alias("normalized")).write.mode("overwrite").json(f"{path}/meta")


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Vectors written before; none where there are none yet."""
    try:
        return spark.read.parquet(f"{path}/vectors")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], EMBEDDINGS)


def alignment(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: aligned, vectors without a chunk, chunks without a vector. Both by id."""
    have = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    both = have(chunks, "c").join(have(vectors, "v"), "id", "full")
    return both.agg(F.count_if(F.col("c") & F.col("v")).alias("aligned"), F.count_if(F.col("c").isNull()).alias("vectors_without_chunk"), F.count_if(F.col("v").isNull()).alias("chunks_without_vector"))


def write_index(chunks: DataFrame, vectors: DataFrame, path: str, text: str = "text", model: str = "", drop_unembedded: bool = True) -> Index:
    """The index of chunks (id, doc_id, text, ...) and vectors (id, vector), written to a folder.

    A vector without a chunk is an error. A chunk without a vector is left out, unless drop_unembedded is false (then
    only words find it). Rows that repeat an id are expected to be equal."""
    spark = chunks.sparkSession
    lost = alignment(chunks, vectors).first()["vectors_without_chunk"]
    if lost:
        raise ValueError(f"{lost} vectors have no chunk")
    vectors.select("id", "vector").write.mode("overwrite").parquet(f"{path}/vectors")
    own = spark.read.schema(vectors.select("id", "vector").schema).parquet(f"{path}/vectors")
    kept = chunks.join(own.select("id"), "id", "left_semi") if drop_unembedded else chunks
    kept.write.mode("overwrite").parquet(f"{path}/meta")
    meta = spark.read.schema(kept.schema).parquet(f"{path}/meta")
    lexical = store_lexical(build_lexical(meta, "id", text), f"{path}/lexical")
    sizes = own.agg(F.count("*").alias("n_vectors"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"))
    words = lexical.terms.agg(F.count("*").alias("vocabulary"))
    info = lexical.stats.select(F.col("n").alias("n_chunks"), "avgdl").join(words).join(sizes).withColumns({"model": F.lit(model), "built_at": F.current_timestamp()})  # one row each
    info.write.mode("overwrite").parquet(f"{path}/info")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(load_lexical(spark, f"{path}/lexical"), *(spark.read.parquet(f"{path}/{t}") for t in ("vectors", "meta", "info")))


def build_report(index: Index) -> DataFrame:
    """One row: n_chunks, n_vectors, dim, vocabulary, avgdl."""
    return index.info.select("n_chunks", "n_vectors", "dim", "vocabulary", "avgdl")
