"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash; a source's share of size s is the documents whose hashes lie under a threshold, and a larger
share contains a smaller one. Sizes are summed by source and hash bucket; the bucket that holds the budget is found by
a running sum over at most BUCKETS rows a source, and only that bucket is split again, level by level, down to single
hashes. The mix is then one filter: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Hexadecimal digits of the hash per level, and levels: 4 * 3 digits tell 2.8e14 documents of a source apart.
DIGITS, LEVELS = 3, 4
BUCKETS = 16**DIGITS
#: Tables with a row per source are broadcast up to so many sources; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target of each source: sources by code point, null last, weigh `weights` in turn and share share * all sizes;
    none gets more than most times its size, and what is over goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weigh = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), sum(weigh.values()), {}
    full = True
    for s in sorted(size, key=lambda s: most * size[s] / weigh[s]):
        full = full and most * size[s] * open_ <= left * weigh[s]
        out[s] = float(most * size[s]) if full else left / open_ * weigh[s]
        if full:
            left -= most * size[s]
            open_ -= weigh[s]
    return out


def _hash(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _small(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= BROADCAST_SOURCES else table


def thresholds(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> list[tuple]:
    """(source, its size, target, times, bound, closed) for rows (s, size, h): documents of the source are taken
    `times` times, and once more where the hash is below the bound (or at it, if closed)."""
    spark = rows.sparkSession
    sizes = [(r["s"], r["n"]) for r in rows.groupBy("s").agg(F.sum("size").alias("n")).collect()]
    goal = targets(sizes, weights, share, most)
    size = dict(sizes)
    times = {s: int(goal[s] // n) if n else 0 for s, n in sizes}
    budget = {s: goal[s] - times[s] * n for s, n in sizes}
    at = {s: ("", 0, 0) for s, _ in sizes}  # a prefix of the hash, the sizes before it, and the sizes with it
    for level in range(LEVELS):
        plan = spark.createDataFrame([(s, float(budget[s]), at[s][0], at[s][1]) for s in at], "p string, budget double, prefix string, below long")
        there = rows.join(_small(plan, len(sizes)), F.col("s").eqNullSafe(F.col("p")) & F.col("h").startswith(F.col("prefix")))
        sums = there.groupBy("p", "budget", "prefix", "below", F.substring("h", 1 + DIGITS * level, DIGITS).alias("d")).agg(F.sum("size").alias("n"))
        running = F.col("below") + F.sum("n").over(Window.partitionBy("p").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
        over = sums.withColumn("upto", running).where("upto > budget")
        first = over.groupBy("p").agg(F.min(F.struct(F.concat("prefix", "d").alias("prefix"), (F.col("upto") - F.col("n")).alias("below"), "n")).alias("b"))
        at = {r["p"]: tuple(r["b"]) for r in first.collect()}
    # The boundary is down to one hash: it is taken if that comes nearer. A source without one has no words.
    near = {s: n - (budget[s] - below) < budget[s] - below for s, (_, below, n) in at.items()}
    return [(s, size[s], float(goal[s]), times[s], at[s][0] if s in at else "", near.get(s, False)) for s in size]


def with_times(rows: DataFrame, ends: list[tuple], source: Column, h: Column, most: int = MOST) -> DataFrame:
    """rows with source_size, target and times (how often the mix takes the row)."""
    table = rows.sparkSession.createDataFrame(ends, "_p string, source_size long, target double, _times long, _bound string, _closed boolean")
    head = F.substring(h, 1, DIGITS * LEVELS)
    once = (F.col("_times") < most) & ((head < F.col("_bound")) | (F.col("_closed") & (head == F.col("_bound"))))
    joined = rows.join(_small(table, len(ends)), source.eqNullSafe(F.col("_p")))
    return joined.withColumn("times", F.col("_times") + F.when(once, 1).otherwise(0)).drop("_p", "_times", "_bound", "_closed")


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return written(docs.select(F.col(key).alias("k"), F.col(source).alias("s"), size_of(F.col(text)).alias("size"), _hash(F.col(key)).alias("h")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per document: key, size, source_size, target, taken (words the mix takes of it: 0, size, 2 * size, ...).

    A source with target t and size s takes every document floor(t / s) times, and once more those with the smallest
    hashes, up to the sum that comes nearest to t - s * floor(t / s). Rows with the same key in a source share a hash
    and are taken alike. Words are counted once per row; a null text has size 0, and null is a source of its own.
    What reaches the driver is a row of a few dozen bytes per source; it is counted there before it is broadcast. Empty
    input gives no rows."""
    rows = _sized(docs, key, text, source)
    out = with_times(rows, thresholds(rows, weights, share, most), F.col("s"), F.col("h"), most)
    return out.select(F.col("k").alias(key), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken. The texts are filtered where they lie. Columns of
    docs may have any name; a row is carried as one struct."""
    ends = thresholds(_sized(docs, key, text, source), weights, share, most)
    rows = docs.select(F.struct("*").alias("_row"), F.col(source).alias("_s"), _hash(F.col(key)).alias("_h"))
    out = with_times(rows, ends, F.col("_s"), F.col("_h"), most)
    return out.where("times > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("_row.*")
