"""Token counts through a digest cache.

The cache is a table (tokenizer digest, content digest, n_tokens). A text's content digest is the SHA-256 of its
normalised content: null becomes the empty text, and nothing else changes, since any further change could change the
count. Texts are joined with the cache on both digests, each distinct text that misses is encoded once, and the new
counts are appended before the final join.

At most one copy of a missing text per map task enters the shuffle, and it travels compressed: a text that a third of
all rows share costs each task one row. Results are whole for any input: null, empty and very long texts, repeated
rows, and empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, shared_dir
from .wordcache import PieceCounts

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
_counters: dict[str, PieceCounts] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _digest(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first copy of each text in this task, compressed."""
    seen, press = set(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in byte_chunks(batch, "text"):
            first = [i for i, d in enumerate(part.column("digest").to_pylist()) if not (d in seen or seen.add(d))]
            part = part.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([press.compress(t) for t in part.column("text").to_pylist()], pa.binary())], names=["digest", "packed"])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = PieceCounts(path)
        seen, unpress = set(), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in byte_chunks(batch, "packed", 1 << 20):
                digests = part.column("digest").to_pylist()
                first = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
                packed = part.column("packed")
                texts = [unpress.decompress(packed[i].as_py()).decode() for i in first]
                yield pa.RecordBatch.from_pydict({"digest": pa.array([digests[i] for i in first], pa.binary()), "n_tokens": pa.array(_counters[path].of(texts), pa.int64())})

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of docs: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer: path of a `tokenizers` file, at the same place on every worker. cache: folder of the cache table,
    made if missing; None: a new one in the shared folder. A second call with the same cache encodes only new texts."""
    spark = docs.sparkSession
    cache = cache or shared_dir(spark)
    version = tokenizer_digest(tokenizer)
    keyed = docs.select(F.col(key).alias(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), _digest(F.col(text)).alias("digest"))
    texts = docs.select(_digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    if known.limit(1).count():
        texts = texts.join(known, "digest", "left_anti")
    missed = texts.mapInArrow(_once, "digest binary, packed binary").repartition("digest").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    missed.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    return keyed.join(counts, "digest").select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
