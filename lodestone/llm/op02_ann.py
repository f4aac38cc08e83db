"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes nearest direction: rows are scaled by the largest norm and given one more coordinate
that makes them unit vectors, queries are scaled to unit length. Each table has `hashes` functions
floor((a.x + b) / WIDTH) with Gaussian a. For a neighbour at similarity s to the query, a.x is normal with mean
s * (a.q) and variance 1 - s^2, so the chance of every bucket is known; a query visits buckets in falling order of
that chance until the chance of having met the neighbour reaches what the tables need together for RECALL; the first bucket's k best
scores are a floor for the rows that the others return. s is
measured on a bounded sample, at the similarity of the k-th neighbour. Candidates of all tables are ranked by their
exact inner products.

Buckets are cut into blocks of rows and of queries, and each pair of blocks is one task that returns k rows a query at
most; pairs never become rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .op06_embedding_dedup import valid

TABLES, RECALL, WIDTH = 2, 0.96, 1.5
#: Rows that a bucket holds on average, and at most in one block; queries in one block.
BUCKET_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096, 1024
MAX_HASHES = 9
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 64
_SPREAD = math.log(math.sqrt(2 * math.pi * math.e) / WIDTH)  # entropy of one hash
_erf = np.vectorize(math.erf)


def functions(dim: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (TABLES, hashes, dim + 1) and offsets (TABLES, hashes)."""
    rng = np.random.default_rng(dim)
    return rng.normal(size=(TABLES, hashes, dim + 1)), rng.uniform(0, WIDTH, (TABLES, hashes))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    x = x / norm
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])


def bucket(cells) -> int:
    return sum((int(c) + 64) << (7 * j) for j, c in enumerate(cells))


def buckets_of(x: np.ndarray, norm: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, TABLES): the bucket of each row in each table."""
    cells = np.floor((np.einsum("nd,thd->nth", lifted(x, norm), a) + b) / WIDTH).astype(np.int64)
    cells = np.clip(cells, -64, 63) + 64
    return (cells << (7 * np.arange(cells.shape[2]))).sum(axis=2)


def probes_of(q: np.ndarray, s: float, a: np.ndarray, b: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each query, (table, bucket) in each table in falling order of success, up to the chance needed."""
    need = 1 - (1 - RECALL) ** (1 / TABLES)
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    mean = s * np.einsum("nd,thd->nth", unit, a[:, :, :-1])
    cells = np.arange(math.floor(-6 / WIDTH), math.ceil(6 / WIDTH) + 2)
    edge = (cells[:, None, None] * WIDTH - b)[None]  # (1, cells, tables, hashes)
    cdf = 0.5 * (1 + _erf((edge - mean[:, None]) / (math.sqrt(1 - s * s) * math.sqrt(2))))
    chance = np.diff(cdf, axis=1)
    order = np.argsort(-chance, axis=1, kind="stable")
    out = []
    for i in range(len(q)):
        found = []
        for t in range(a.shape[0]):
            p = [chance[i, order[i, :, t, j], t, j] for j in range(a.shape[1])]
            c = [cells[order[i, :, t, j]] for j in range(a.shape[1])]
            start = (0,) * len(p)
            heap, got = [(-math.prod(x[0] for x in p), start, 0)], 0.0
            while heap and got < need:
                neg, at, last = heapq.heappop(heap)
                got -= neg
                found.append((t, bucket(c[j][k] for j, k in enumerate(at))))
                for j in range(last, len(p)):
                    if at[j] + 1 < len(p[j]) and p[j][at[j]] > 0:
                        more = (*at[:j], at[j] + 1, *at[j + 1 :])
                        heapq.heappush(heap, (neg / p[j][at[j]] * p[j][at[j] + 1], more, j))
        out.append(found)
    return out


def similarity(rows: np.ndarray, row_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, norm: float, k: int, n: int) -> float:
    """Similarity of the k-th neighbour of n, as a sample shows it: low, as for one query in five."""
    if not len(rows) or not len(queries):
        return 0.5
    sims = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (rows / norm).T
    sims[query_ids[:, None] == row_ids[None, :]] = -1
    rank = min(len(rows), max(1, math.ceil(k * len(rows) / n)))
    return float(np.clip(np.percentile(-np.sort(-sims, axis=1)[:, rank - 1], 20), 0.05, 0.999))


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray) -> pd.DataFrame:
    """The k rows with the largest inner products for each query, without its own and those below its floor; equal
    scores by smaller id."""
    s = q @ x.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    m = min(k, len(ids))
    least = np.maximum(-np.partition(-s, m - 1, axis=1)[:, m - 1], floor)
    out = []
    for i in range(len(q)):
        at = np.flatnonzero((s[i] >= least[i] - 1e-9 * max(1.0, abs(least[i]))) & (s[i] > -np.inf)) if np.isfinite(least[i]) else np.flatnonzero(s[i] > -np.inf)
        if len(at):
            exact = (x[at] * q[i]).sum(axis=1)
            top = np.lexsort((ids[at], -exact))[:k]
            out.append((np.full(len(top), q_ids[i]), ids[at][top], exact[top]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in v])


def search(rows: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for the rows where is_query holds, k rows of largest inner product.

    Rows with a null key, and vectors that are null, zero, or hold null or non-finite components take no part; vectors
    of different lengths don't meet. A product that is too large for a double is an infinite score. A query for which the probes find fewer than k rows visits every bucket of one table, so it gets all rows
    where there are fewer. Keys are integers and name a vector; repeated rows count once. Empty input gives no rows."""
    sc = rows.sparkSession.sparkContext
    good = rows.where(valid(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    good = written(good.withColumns({"dim": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))}))
    plans, found = {}, None
    for r in good.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect():
        hashes = int(min(MAX_HASHES, max(1, round(math.log(max(r["n"] / BUCKET_ROWS, 1)) / _SPREAD))))
        own = good.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id"), "id")
        some, ask = (x.select("id", "v").collect() for x in (own.limit(SAMPLE_ROWS), own.where("q").limit(SAMPLE_QUERIES)))
        mat = lambda z, dim=r["dim"]: (np.array([y["v"] for y in z], float).reshape(len(z), dim), np.array([y["id"] for y in z]))
        s = similarity(*mat(some), *mat(ask), r["norm"], k, r["n"])
        plans[r["dim"]] = (*functions(r["dim"], hashes), r["norm"], s)
    shared = sc.broadcast(plans)

    def by_dim(v: pd.Series, f) -> pd.Series:
        out = [None] * len(v)
        size = np.array([len(x) for x in v])
        for dim in set(size.tolist()):
            at = np.flatnonzero(size == dim)
            for i, o in zip(at, f(_matrix(v.iloc[at]), *shared.value[dim]), strict=True):
                out[i] = o
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<long>")
    def placed(v: pd.Series) -> pd.Series:
        return by_dim(v, lambda x, a, b, norm, s: buckets_of(x, norm, a, b))

    @F.pandas_udf("array<struct<t:int,b:long,o:int>>")
    def probed(v: pd.Series) -> pd.Series:
        return by_dim(v, lambda x, a, b, norm, s: [[{"t": t, "b": c, "o": o} for o, (t, c) in enumerate(p)] for p in probes_of(x, s, a, b)])

    cells = ["dim", "t", "b"]
    index = written(good.withColumn("p", placed("v")).select("id", "v", "dim", F.posexplode("p").alias("t", "b")))
    sizes = index.groupBy(*cells).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))

    def ranked(probes: DataFrame) -> DataFrame:
        asked = probes.groupBy(*cells).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("seats"))
        plan = written(sizes.join(asked, cells))
        block, seat = (F.pmod(F.xxhash64("id", F.lit(i)), F.col(c)).cast("int") for i, c in enumerate(("blocks", "seats")))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = index.join(plan, cells).withColumn("block", block).withColumn("seat", every("seats")).select(*cells, "block", "seat", "id", "v")
        right = probes.join(plan, cells).withColumn("seat", seat).withColumn("block", every("blocks")).select(*cells, "block", "seat", "id", "v", "floor")
        task = [*cells, "block", "seat"]

        def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(q):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return best(q["id"].to_numpy(), _matrix(q["v"]), x["id"].to_numpy(), _matrix(x["v"]), k, q["floor"].to_numpy())

        return left.groupBy(*task).cogroup(right.groupBy(*task)).applyInPandas(compare, "query_id long, vec_id long, score double")

    queries = good.where("q").select("id", "v", "dim")
    none = F.lit(float("-inf"))
    asked = written(queries.withColumn("p", F.explode(probed("v"))).select("id", "v", "dim", "p.t", "p.b", "p.o"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # The likeliest bucket first: what lies below its k best can't be among the k best of all.
    first = written(ranked(asked.where("o = 0").withColumn("floor", none)).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
    floors = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = asked.where("o > 0").join(floors, "id", "left").withColumn("floor", F.coalesce("floor", none))
    hits = written(first.union(ranked(written(rest))).dropDuplicates(["query_id", "vec_id"]))
    few = queries.join(hits.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) < k).select("id", "v", "dim")
    few = written(few.join(sizes.where("t = 0").select("dim", "t", "b"), "dim").select("id", "v", "dim", "t", "b", none.alias("floor")))
    if few.limit(1).count():
        hits = hits.union(ranked(few)).dropDuplicates(["query_id", "vec_id"])
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
