"""What the operators share: tables, the shared folder, Arrow helpers, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..session import discard, shared_dir, written  # noqa: F401  (operators take them from here)

#: Text handled at once inside a task, in bytes: bounds a task's Python memory whatever the batch size.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Narrow rows, written and counted: to be broadcast if they are few, and joined by shuffle if not."""
    df = written(df)
    return F.broadcast(df) if df.count() <= most else df


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def named(name: str) -> Column:
    """A column of the top level by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, str], list[StructField]]:
    """docs with only these columns, called _k0, _k1, ... so that no name can clash; the new name of each; their fields."""
    unique = list(dict.fromkeys(names))
    at = {c: f"_k{i}" for i, c in enumerate(unique)}
    out = docs.select(*[named(c).alias(at[c]) for c in unique])
    return out, at, [StructField(c, f.dataType) for c, f in zip(unique, out.schema, strict=True)]


def byte_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column holds about `limit` bytes each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every id in edges (a, b): component_id is the smallest id reachable.

    Labels start at the smallest neighbour and take, in each round, the smallest label next door and then the label
    of their label. Each round is a written table, so a lost executor costs one round at most."""
    both = edges.select("a", "b").where("a <> b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component_id")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component_id").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component_id", "near").alias("c"), F.col("component_id").alias("was"))
        jump = labels.select(F.col("id").alias("c"), F.col("component_id").alias("further"))
        new = written(step.join(jump, "c", "left").select("id", F.least("c", "further").alias("component_id"), "was"))
        changed = new.where("component_id <> was").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels.select("id", "component_id")
