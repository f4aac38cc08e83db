"""Near-copies among embeddings by a pivot-permutation index.

A vector is described by its PREFIX nearest reference points in order. An inverted list per label and pivot holds the
vectors with that pivot in their prefix; two vectors that share SHARED pivots or more are candidates, counted in the
list of the first pivot they share, and their cosine is then taken in double precision. Of pairs at cosine 0.98, two
prefixes of 8 share 2 pivots in 99.97% or more (64 and 256 dimensions, 512 to 16,384 pivots; a test measures it), and
in 99.4% or more in 8 dimensions.

The number of pivots grows with the square root of the number of vectors, and so does the length of a list. Equal
vectors are one class throughout. A long list is cut into blocks, and each pair of blocks is one task, so no list,
however hot, is gathered in one task; pairs are counted inside the tasks and never become rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_few, components, written

PREFIX, SHARED = 8, 2
BLOCK = 2048
#: Pivots: so many times the root of the number of vectors, within bounds; the upper one bounds what is broadcast.
PIVOTS_PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 2.26, 32, 16_384
#: So many pivots are chosen to lie apart, by this cosine; further ones are vectors of the sample as they come.
APART, PIVOT_COSINE = 2048, 0.8


def valid(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, float) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Reference points by dimension, from a bounded sample by hash of 4 * APART vectors, or n if that is more: first
    up to APART that lie apart, then others, then random directions. All n lie in the space of the vectors."""
    dims = [r[0] for r in vectors.select(F.size("vector")).distinct().collect()]
    out = {}
    for dim in dims:
        own = vectors.where(F.size("vector") == dim).orderBy(F.xxhash64("vector"), "cid").limit(max(4 * min(n, APART), n)).select("vector").toPandas()["vector"]
        sample = _unit(own) if len(own) else np.zeros((0, dim))
        most = min(n, APART)
        chosen, taken, count = np.zeros((most, dim)), np.zeros(len(sample), bool), 0
        for i, v in enumerate(sample):
            if count < most and (not count or (chosen[:count] @ v).max() < PIVOT_COSINE):
                chosen[count], taken[i] = v, True
                count += 1
        chosen = np.vstack([chosen[:count], sample[~taken][: max(0, n - APART)]])
        fill = np.random.default_rng(dim).normal(size=(n - len(chosen), dim))
        out[dim] = np.vstack([chosen, fill / np.linalg.norm(fill, axis=1, keepdims=True)])
    return out


def _linked(u: np.ndarray, prefix: np.ndarray, n_pivots: int, pivot: int, least: float) -> np.ndarray:
    """Which pairs of rows are candidates of this list and have the cosine."""
    hot = np.zeros((len(u), n_pivots), np.float32)
    np.put_along_axis(hot, prefix, 1, axis=1)
    own = (hot @ hot.T >= min(SHARED, prefix.shape[1])) & (hot[:, :pivot] @ hot[:, :pivot].T == 0)
    own &= u @ u.T >= least
    np.fill_diagonal(own, False)
    return own


def dedup(rows: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: key, n_links (other rows of the label with cosine >= least), component_id, kept.

    Rows with a null label or an invalid vector link with nothing. Vectors of different lengths don't link. Keys are
    integers; rows that repeat a key and its vector count as further copies. A row with a null key links and counts
    like any other, but names no component: it belongs to the smallest key reachable, and only where there is none is
    its component null and the row kept. Empty input gives no rows."""
    spark = rows.sparkSession
    all_rows = rows.select(F.col(key).cast("long").alias("id"), F.when(F.col(label).isNotNull() & valid(F.col(vector)), F.col(vector).cast("array<double>")).alias("vector"), F.col(label).cast("string").alias("label"))
    good = all_rows.where("vector is not null")
    # Classes have numbers of their own: written with them, so that they never change.
    classes = written(good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("m")).withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    n_pivots = int(min(MAX_PIVOTS, max(MIN_PIVOTS, PIVOTS_PER_ROOT * n**0.5)))
    pivots = spark.sparkContext.broadcast(choose_pivots(classes, n_pivots))

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        out = [None] * len(v)
        size = np.array([len(x) for x in v])
        for dim, p in pivots.value.items():
            at = np.flatnonzero(size == dim)
            if len(at):
                order = np.argsort(-(_unit(v.iloc[at]) @ p.T), axis=1, kind="stable")[:, :PREFIX].astype(np.int32)
                for i, o in zip(at, order, strict=True):
                    out[i] = o
        return pd.Series(out, dtype=object)

    described = classes.withColumns({"prefix": nearest("vector"), "dim": F.size("vector")}).where("prefix is not null")
    posted = written(described.withColumn("pivot", F.explode("prefix")))
    lists = ["label", "dim", "pivot"]
    sizes = posted.groupBy(*lists).agg(F.count("*").alias("n")).where("n > 1")
    dealt = posted.join(sizes, lists)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = dealt.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # Block b meets every block: as the first of the pair (b, x) for x >= b, as the second of (x, b) for x < b.
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*lists, "cid", "m", "vector", "prefix", F.least("b", "x").alias("b1"), F.greatest("b", "x").alias("b2"), "b")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid")
        cid, m, b = group["cid"].to_numpy(), group["m"].to_numpy(), group["b"].to_numpy()
        pivot, b1, b2 = (int(group[c].iloc[0]) for c in ("pivot", "b1", "b2"))
        own = _linked(_unit(group["vector"]), np.stack(group["prefix"].tolist()).astype(np.int64), n_pivots, pivot, least)
        if b1 != b2:
            own &= b[:, None] != b[None, :]
        links = own @ m
        root = np.arange(len(cid))
        while True:  # smallest row reachable inside the block
            near = np.where(own, root[None, :], len(cid)).min(axis=1, initial=len(cid))
            new = np.minimum(root, near)
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(links)
        return pd.DataFrame({"cid": cid[at], "links": links[at], "root": cid[root[at]]})

    found = written(dealt.groupBy(*lists, "b1", "b2").applyInPandas(compare, "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("cid"), F.col("component_id").alias("group"))
    named = broadcast_few(groups.join(classes.select("cid", "rep"), "cid").groupBy("group").agg(F.min("rep").alias("name")))
    per_class = classes.join(links, "cid", "left").join(groups, "cid", "left").join(named, "group", "left").select(
        "label", "vector", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("name", "rep").alias("component_id")
    )
    # A row without a valid vector keeps its null on the left side and finds no class.
    out = all_rows.join(per_class, ["label", "vector"], "left")
    own = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
