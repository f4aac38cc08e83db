"""Incremental ingest: new documents as they arrive become chunks in a table, each content once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.chunking import chunk

ORDER = ["doc_id", "chunk_index"]


def _first(expiry_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The first chunk of a content that wasn't there before; copies are looked through one batch at a time."""
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for rows in batches:
            best = rows if best is None else pd.concat([best, rows])
            best = best.sort_values(ORDER, kind="stable").head(1)
        if not state.exists:
            state.update((True,))
            if expiry_ms is not None:
                until = int(best["_time"].iloc[0].timestamp() * 1000) + expiry_ms if pd.notna(best["_time"].iloc[0]) else 0
                state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
            yield best.drop(columns=["_time"], errors="ignore")

    return run


def fresh_chunks(docs: DataFrame, time: str | None = None, expiry: str = "30 days") -> DataFrame:
    """Chunks of a stream of documents, each content once, by state keyed by content hash: what was written before isn't
    read. Of a batch's chunks with one content the first by document and place counts.

    With the name of a column of times, a content is forgotten, and its state freed, once the stream's time is `expiry`
    past it; without one it is remembered for good."""
    rows = docs if time is None else docs.withColumn("_time", F.col(time).cast("timestamp"))
    chunks = chunk(rows, keep=() if time is None else ("_time",)).drop("raw", "kept")
    schema = chunks.drop("_time").schema
    if time is not None:
        chunks = chunks.withWatermark("_time", expiry)
    expiry_ms = None if time is None else int(pd.Timedelta(expiry).total_seconds() * 1000)
    kind = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    return chunks.groupBy("content_hash").applyInPandasWithState(_first(expiry_ms), schema, "seen boolean", "append", kind)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, time: str | None = None, expiry: str = "30 days") -> StreamingQuery:
    """Chunk the Parquet documents that appear under source; the target gets the contents that it lacks.

    State is hash-partitioned and kept in the checkpoint, so a batch reads its own documents and the state of their
    contents only. The file sink takes each batch once, whether it is replayed or the query restarted."""
    docs = spark.readStream.schema(schema).parquet(source)
    out = fresh_chunks(docs, time, expiry).writeStream.format("parquet").option("path", target).outputMode("append")
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
