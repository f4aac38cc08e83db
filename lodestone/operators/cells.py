"""Exact dense top-k that leaves cells of vectors unread.

Vectors are dealt to the nearest of about sqrt(n) centres, which are vectors of a sample bounded by CENTRES; a cluster of
more than CELL vectors is cut into parts by hash, so a vector that a third of all rows share is many cells. A cell is one
stored row: its mean, the largest distance from it, and its ids and vectors. The inner product of a query q with any
vector of a cell is at most q . mean + |q| * radius.

For up to QUERIES queries at once, which are sent to all tasks: each task keeps each query's FIRST cells with the largest
bounds among its own; the best of those over all tasks are scored; the k-th score is a floor, and only cells whose bound
reaches a query's floor are scored after them. Pairs of queries and cells are never listed but for those.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import rank_by
from lodestone.session import written

CENTRES, CELL, FIRST, QUERIES = 4096, 2048, 4, 1024
#: Bounds are compared with this much room for rounding, relative to the lengths of the vectors.
ROOM = 1e-9


@dataclass
class CellIndex:
    """bounds(cell, mean, radius, n) and cells(cell, ids, vectors: one flat list); both have one row per cell."""

    bounds: DataFrame
    cells: DataFrame


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest(centres: np.ndarray):
    length = (centres**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = matrix(part.column("vector"), centres.shape[1])
                yield part.append_column("cluster", pa.array(np.argmax(x @ centres.T - length, axis=1).astype(np.int64)))

    return run


def _cell(dim: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        x = matrix(rows["vector"].combine_chunks(), dim)
        mean = x.mean(axis=0)
        radius = float(np.sqrt(((x - mean) ** 2).sum(axis=1).max()))
        ids = rows["id"].combine_chunks()
        return pa.table({"cell": [f"{key[0].as_py()}.{key[1].as_py()}"], "mean": [mean.tolist()], "radius": [radius], "n": [len(x)], "ids": pa.array([ids.to_pylist()], pa.list_(ids.type)), "vectors": [x.ravel().tolist()]})

    return run


def write_cells(vectors: DataFrame, path: str) -> CellIndex:
    """The index of vectors (id, vector) of one length, written to a folder. Null vectors are left out; vectors of another
    length than the others, or with null or non-finite components, are an error."""
    spark = vectors.sparkSession
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.min(F.size("vector")).alias("least"), F.count_if(bad).alias("bad")).first()
    if size["n"] and (size["dim"] != size["least"] or size["bad"] or not size["dim"]):
        raise ValueError("vectors must be finite and of one length")
    dim, wanted = size["dim"] or 1, min(CENTRES, max(1, round(size["n"] ** 0.5)))
    # By hash of the id: a bounded sample, alike in each run. Repeated vectors make empty clusters, which do no harm.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").toArrow()["vector"].combine_chunks()
    centres = matrix(sample, dim) if size["n"] else np.zeros((1, dim))
    kind = rows.schema["id"].dataType.simpleString()
    dealt = written(rows.mapInArrow(_nearest(centres), f"id {kind}, vector array<double>, cluster long"))
    parts = dealt.groupBy("cluster").agg(F.ceil(F.count("*") / CELL).alias("parts"))  # one row per centre
    cut = dealt.join(F.broadcast(parts), "cluster").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "parts"))
    made = cut.select("cluster", "part", "id", "vector").groupBy("cluster", "part").applyInArrow(_cell(dim), f"cell string, mean array<double>, radius double, n long, ids array<{kind}>, vectors array<double>")
    made.write.mode("overwrite").parquet(f"{path}/all")
    own = spark.read.schema(made.schema).parquet(f"{path}/all")
    own.select("cell", "mean", "radius", "n").write.mode("overwrite").parquet(f"{path}/bounds")
    return load_cells(spark, path)


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    return CellIndex(spark.read.parquet(f"{path}/bounds"), spark.read.parquet(f"{path}/all").select("cell", "ids", "vectors"))


def restricted(index: CellIndex, allow: DataFrame | None) -> CellIndex:
    """The index as a filter (cell, mask) leaves it (access): cells without an allowed vector are neither bounded nor
    read, and other vectors are passed over before any product. None leaves all."""
    return index if allow is None else replace(index, bounds=index.bounds.join(allow, "cell", "left_semi"), cells=index.cells.join(allow, "cell"))


def _bounds(part: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    """(cells, queries): no vector of the cell has a larger inner product with the query."""
    length, mean = np.sqrt((q**2).sum(axis=1)), matrix(part.column("mean"), q.shape[1])
    radius = part.column("radius").to_numpy(zero_copy_only=False)
    reach = np.sqrt((mean**2).sum(axis=1)) + radius
    return mean @ q.T + np.outer(radius, length) + ROOM * (1 + np.outer(reach, length))


def _pairs(part: pa.RecordBatch, cell: np.ndarray, query: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column("cell").take(pa.array(cell)), pa.array(query.astype(np.int64)), pa.array(bound)], names=["cell", "q", "bound"])


def _first_cells(q: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                bound = _bounds(part, q)
                cell = np.argpartition(-bound, min(most, len(bound)) - 1, axis=0)[:most]
                query = np.broadcast_to(np.arange(len(q)), cell.shape)
                yield _pairs(part, cell.ravel(), query.ravel(), np.take_along_axis(bound, cell, axis=0).ravel())

    return run


def _open_cells(q: np.ndarray, floor: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                bound = _bounds(part, q)
                cell, query = np.nonzero(bound >= floor)
                yield _pairs(part, cell, query, bound[cell, query])

    return run


def _score(q: np.ndarray, k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                own = np.array(row.column("queries")[0].as_py())
                ids, x = row.column("ids")[0].values, matrix(row.column("vectors"), q.shape[1])
                if "mask" in row.schema.names:
                    bits = np.unpackbits(np.array(row.column("mask")[0].as_py(), "<i8").view(np.uint8), bitorder="little")
                    keep = np.flatnonzero(bits[: len(x)])
                    ids, x = ids.take(pa.array(keep)), x[keep]
                product = x @ q[own].T
                least = np.partition(product, max(0, len(x) - k), axis=0)[max(0, len(x) - k)]
                at, who = np.nonzero(product >= least - ROOM * (1 + np.abs(least)))
                score = (x[at] * q[own[who]]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own[who].astype(np.int64)), ids.take(pa.array(at)), pa.array(score)], schema=schema)

    return run


def _scores(index: CellIndex, pairs: DataFrame, q: np.ndarray, k: int) -> DataFrame:
    """(q, id, score): of each pair's cell at least the query's k best. A cell is read once for all of its queries."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = index.cells.schema["ids"].dataType.elementType.simpleString()
    schema = f"q long, id {kind}, score double"
    by_cell = pairs.groupBy("cell").agg(F.collect_list("q").alias("queries"))  # QUERIES of them at most
    arrow = to_arrow_schema(pairs.sparkSession.createDataFrame([], schema).schema)
    return by_cell.join(index.cells, "cell").select("queries", "ids", "vectors", *(["mask"] if "mask" in index.cells.columns else [])).mapInArrow(_score(q, k, arrow), schema)


def plan_cells(index: CellIndex, q: np.ndarray, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores of the first cells, those pairs (cell, q), the pairs that may hold better vectors)."""
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "cell"))
    best = index.bounds.mapInArrow(_first_cells(q, first), "cell string, q long, bound double")
    start = written(best.withColumn("place", order).where(F.col("place") <= first).select("cell", "q"))
    scores = written(_scores(index, start, q, k))
    kth = scores.withColumn("rank", rank_by(F.col("score"), "id", name="q")).where(F.col("rank") == k).select("q", "score").collect()  # a number per query
    floor = np.full(len(q), -np.inf)
    for row in kth:
        floor[row["q"]] = row["score"] - 1e-8  # ranks are over nine digits
    pairs = index.bounds.mapInArrow(_open_cells(q, floor), "cell string, q long, bound double")
    return scores, start, written(pairs.join(start, ["cell", "q"], "left_anti").select("cell", "q"))


def search_cells(index: CellIndex, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """(query_id, id, score): each query's k largest inner products, as retrieval.dense_scores() finds them.

    queries: (query_id, vector) of the index's length; null vectors take no part."""
    spark = queries.sparkSession
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    kind = index.cells.schema["ids"].dataType.elementType.simpleString()
    name = queries.schema["query_id"].dataType.simpleString()
    groups = max(1, -(-asked.count() // QUERIES))
    out = []
    for g in range(groups):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).orderBy("query_id").toArrow()
        if not own.num_rows or not index.bounds.limit(1).count():
            continue
        dim = len(own["vector"][0])
        q = matrix(own["vector"].combine_chunks(), dim)
        scores, _, more = plan_cells(index, q, k, first)
        both = scores.unionByName(_scores(index, more, q, k)) if more.limit(1).count() else scores
        names = spark.createDataFrame(list(enumerate(own["query_id"].to_pylist())), f"q long, query_id {name}")
        out.append(both.join(F.broadcast(names), "q").select("query_id", "id", "score"))  # QUERIES names, about
    found = functools.reduce(DataFrame.union, out) if out else spark.createDataFrame([], f"query_id {name}, id {kind}, score double")
    return found.withColumn("rank", rank_by(F.col("score"), "id")).where(F.col("rank") <= k).drop("rank")


def vectors_read(index: CellIndex, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """(q, vectors): how many vectors the search reads for each query, by its place in the order of query ids."""
    own = queries.where("vector IS NOT NULL").orderBy("query_id").select(F.col("vector").cast("array<double>").alias("vector")).toArrow()
    _, start, more = plan_cells(index, matrix(own["vector"].combine_chunks(), len(own["vector"][0])), k, first)
    return start.unionByName(more).join(index.bounds.select("cell", "n"), "cell").groupBy("q").agg(F.sum("n").alias("vectors"))
