"""An inverted index in blocks with maxima, and exact top-k search that skips blocks.

Documents are cut into ranges of RANGE documents where they lie. A block holds the postings of one term in one range,
and the largest contribution that any of them can make. A task writes its ranges' blocks where they lie, in runs of about
RUN postings, each in the order of its terms, so a filter on terms reaches the statistics of files' pages. Nothing is
shuffled or sorted beyond a run, and the blocks of a frequent term lie in as many files as its ranges.

A search first reads the blocks' maxima alone: for a query they bound what any document of a range can score. The ranges
with the largest bounds are scored first; the k-th score found there is a floor, and only ranges whose bound reaches it
are scored after them. Each needed block is shuffled once to its group of ranges, whatever the number of its postings or
of the queries that ask for it, up to QUERIES queries a group.

A restricted index has a mask of the documents that an access filter allows in each range (access): ranges without any
are neither bounded nor read, and other documents' postings are passed over before anything is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import B, K1, LexicalIndex, query_weights, rank_by
from lodestone.session import written

#: Documents of a range; ranges that are scored together; ranges that are scored first; queries scored together.
RANGE, GROUP, FIRST, QUERIES = 256, 16, 2, 1024
#: Query terms up to which they are handed to the scan as a filter on its files; more are joined.
FEW_TERMS = 2000
#: Postings that are put in order together, about, and blocks that leave a task together.
RUN, BATCH = 2_000_000, 16_384
#: Ranges (for each group of queries) that are broadcast; more are joined by shuffle.
BROADCAST_RANGES = 1_000_000


@dataclass
class InvertedIndex:
    """blocks(term, range, peak, ids, tfs, dls, slots: places in the range), terms(term, df), stats(n, avgdl, k1, b): one
    row, and members(range, ids: all its documents, by slot)."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    members: DataFrame


def _parts(tf: np.ndarray, dl: np.ndarray, average: float, k1: float, b: float) -> np.ndarray:
    """What a posting adds to a score for each unit of its term's weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))


def _invert(width: int, average: float, k1: float, b: float):
    def block(batch: pa.RecordBatch, name: int) -> pa.RecordBatch:
        """The blocks of one range, by term, and its members under no term."""
        lists = batch.column("terms")
        coded = lists.flatten().dictionary_encode()
        what = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(what, kind="stable")
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[order]
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[order]
        dl = batch.column("dl").to_numpy(zero_copy_only=False)[doc]
        cuts = np.append(0, np.cumsum(np.bincount(what, minlength=len(coded.dictionary))))
        peak = np.maximum.reduceat(_parts(tf, dl, average, k1, b), cuts[:-1]) if len(tf) else np.zeros(0)
        cuts = pa.array(np.append(cuts, [len(doc) + batch.num_rows]), pa.int32())
        ids = pa.concat_arrays([batch.column("id").take(pa.array(doc)), batch.column("id")])
        rest = np.zeros(batch.num_rows, np.int32)
        numbers = (pa.array(np.append(tf, rest).astype(np.int32)), pa.array(np.append(dl, rest).astype(np.int32)), pa.array(np.append(doc, np.arange(batch.num_rows)), pa.int16()))
        lists = [pa.ListArray.from_arrays(cuts, x) for x in (ids, *numbers)]
        terms = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)])
        return pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(terms), name)), pa.array(np.append(peak, 0.0)), *lists], names=["term", "range", "peak", "ids", "tfs", "dls", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, made, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, width):
                made.append(block(batch.slice(a, width), name))
                name, size = name + 1, size + len(made[-1].column("slots").flatten())
                if size >= RUN:
                    yield from _in_order(made)
                    made, size = [], 0
        if made:
            yield from _in_order(made)

    return run


def _in_order(made: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """These ranges' rows by term and range, members first."""
    rows = pa.Table.from_batches(made)
    order = pc.sort_indices(rows, sort_keys=[("term", "ascending"), ("range", "ascending")], null_placement="at_start")
    for a in range(0, len(order), BATCH):
        yield from rows.take(order.slice(a, BATCH)).combine_chunks().to_batches()


def write_inverted(index: LexicalIndex, path: str, width: int = RANGE, k1: float = K1, b: float = B) -> InvertedIndex:
    """The inverted form of an index, written to a folder in one pass over its documents. No group of postings larger than
    a range's is ever built, and none is shuffled: a term that all documents have is cut like any other."""
    stats = index.stats.first()
    kind = index.documents.schema["id"].dataType.simpleString()
    rows = index.documents.select("id", F.col("dl").cast("long").alias("dl"), "terms", "tfs")
    made = rows.mapInArrow(_invert(width, stats["avgdl"] or 1.0, k1, b), f"term string, range long, peak double, ids array<{kind}>, tfs array<int>, dls array<int>, slots array<short>")
    made.write.mode("overwrite").parquet(f"{path}/blocks")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.stats.withColumns({"k1": F.lit(float(k1)), "b": F.lit(float(b))}).write.mode("overwrite").parquet(f"{path}/stats")
    return load_inverted(index.documents.sparkSession, path)


def load_inverted(spark: SparkSession, path: str) -> InvertedIndex:
    rows, terms, stats = (spark.read.parquet(f"{path}/{t}") for t in ("blocks", "terms", "stats"))
    return InvertedIndex(rows.where("term IS NOT NULL"), terms, stats, rows.where("term IS NULL").select("range", "ids"))


def restricted(index: InvertedIndex, allow: DataFrame | None) -> InvertedIndex:
    """The index as a filter (range, mask) leaves it: the same statistics, only the allowed documents. None leaves all."""
    return index if allow is None else replace(index, blocks=index.blocks.join(allow, "range"))


def _of_terms(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of the terms of words: by a filter that the scan can skip files' parts with, or by a join if they are many."""
    terms = words.select("term").distinct()
    few = [r.term for r in terms.limit(FEW_TERMS + 1).collect()]
    return rows.where(F.col("term").isin(few)) if len(few) <= FEW_TERMS else rows.join(terms, "term", "left_semi")


def range_bounds(index: InvertedIndex, words: DataFrame) -> DataFrame:
    """(query_id, range, bound): no document of the range scores more for the query; ranges without its words are left
    out. Postings aren't read."""
    peaks = _of_terms(index.blocks.select("term", "range", "peak"), words)
    return words.join(peaks, "term").groupBy("query_id", "range").agg(F.sum(F.col("w") * F.col("peak")).alias("bound"))


def _set(masks: pa.Array, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether each slot's bit is set in the mask of its row."""
    n = masks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = masks.flatten().to_numpy(zero_copy_only=False)
    return words[(np.cumsum(n) - n)[row] + (slot >> 6)] >> (slot & 63) & 1 == 1


def _score(average: float, k1: float, b: float, k: int, schema: pa.Schema):
    def run(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        """The k best documents of these ranges for each query that wants some of them."""
        if not wanted.num_rows or not blocks.num_rows:
            return schema.empty_table()
        block = {key: i for i, key in enumerate(zip(blocks["term"].to_pylist(), blocks["range"].to_pylist(), strict=True))}
        lists = blocks["ids"].combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lambda c: blocks[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids, tf, dl = lists.flatten(), flat("tfs"), flat("dls")
        if "mask" in blocks.column_names:
            row = np.repeat(np.arange(len(size)), size)
            keep = np.flatnonzero(_set(blocks["mask"].combine_chunks(), row, flat("slots").astype(np.int64)))
            ids, tf, dl, size = ids.take(pa.array(keep)), tf[keep], dl[keep], np.bincount(row[keep], minlength=len(size))
        start = np.cumsum(size) - size
        part, coded = _parts(tf, dl, average, k1, b), ids.dictionary_encode()
        doc, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        rows = np.array([block.get(key, -1) for key in zip(wanted["term"].to_pylist(), wanted["range"].to_pylist(), strict=True)], np.int64)
        weight, names = wanted["w"].to_numpy(), wanted["query_id"].combine_chunks().dictionary_encode()
        who = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(who, kind="stable")
        order = order[rows[order] >= 0]
        cuts = np.searchsorted(who[order], np.arange(len(names.dictionary) + 1))
        out = []
        for q in range(len(names.dictionary)):
            own = order[cuts[q] : cuts[q + 1]]
            if not len(own):
                continue
            many = size[rows[own]]
            at = np.repeat(start[rows[own]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            scores = np.bincount(doc[at], part[at] * np.repeat(weight[own], many), n)
            hit = np.flatnonzero(scores > 0)
            if len(hit) > k:  # ties at the edge are settled later, over nine digits
                hit = hit[scores[hit] >= np.partition(scores[hit], len(hit) - k)[len(hit) - k] - 1e-8]
            out.append((q, hit, scores[hit]))
        queries = np.repeat([q for q, _, _ in out], [len(h) for _, h, _ in out]).astype(np.int64)
        hits, scores = (np.concatenate([x[i] for x in out]) if out else np.zeros(0) for i in (1, 2))
        return pa.table([names.dictionary.take(pa.array(queries)), coded.dictionary.take(pa.array(hits.astype(np.int64))), pa.array(scores.astype(float))], schema=schema)

    return run


def _best(index: InvertedIndex, words: DataFrame, pairs: DataFrame, k: int, seats: int) -> DataFrame:
    """(query_id, id, score) of documents in these (query_id, range); at least the k best of each query are among them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, stats = words.sparkSession, index.stats.first()
    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"query_id {words.schema['query_id'].dataType.simpleString()}, id {kind}, score double"
    place = {"zone": F.col("range") - F.pmod(F.col("range"), F.lit(GROUP)), "seat": F.pmod(F.xxhash64("query_id"), F.lit(seats))}
    wanted = pairs.join(words, "query_id").select("query_id", "range", "term", "w").withColumns(place)
    # Ranges, not (term, range): they are few, so blocks are shuffled once, to those who score them.
    needed = written(pairs.withColumns(place).select("range", F.col("zone").alias("own_zone"), F.col("seat").alias("own_seat")).distinct())
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_RANGES else needed
    blocks = _of_terms(index.blocks, words).join(needed, "range").select("own_zone", "own_seat", "term", "range", "ids", "tfs", "dls", *(("slots", "mask") if "mask" in index.blocks.columns else ()))
    score = _score(stats["avgdl"] or 1.0, stats["k1"], stats["b"], k, to_arrow_schema(spark.createDataFrame([], schema).schema))
    return wanted.groupBy("zone", "seat").cogroup(blocks.groupBy("own_zone", "own_seat")).applyInArrow(score, schema)


def plan_ranges(index: InvertedIndex, words: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores of each query's first ranges, those ranges, the ranges that may hold better documents)."""
    bounds = written(range_bounds(index, words))
    seats = max(1, -(-words.agg(F.countDistinct("query_id").alias("n")).first()["n"] // QUERIES))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    start = written(bounds.withColumn("place", order).where(F.col("place") <= first).select("query_id", "range"))
    scores = written(_best(index, words, start, k, seats))
    kth = scores.withColumn("rank", rank_by(F.col("score"), "id")).where(F.col("rank") == k)
    rest = bounds.join(start, ["query_id", "range"], "left_anti").join(kth.select("query_id", F.col("score").alias("floor")), "query_id", "left")
    more = written(rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-8)).select("query_id", "range"))
    return scores, start, more


def search_blocks(index: InvertedIndex, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """(query_id, id, score): the k best documents of each query (query_id, question) with a score above 0, as
    retrieval.lexical_scores() finds them. A repeated word counts twice; queries without known words have no rows."""
    words = written(query_weights(index, queries).select("query_id", "term", "w"))
    seats = max(1, -(-words.agg(F.countDistinct("query_id").alias("n")).first()["n"] // QUERIES))
    scores, _, more = plan_ranges(index, words, k, first)
    both = scores.unionByName(_best(index, words, more, k, seats)) if more.limit(1).count() else scores
    return both.withColumn("rank", rank_by(F.col("score"), "id")).where(F.col("rank") <= k).drop("rank")


def blocks_read(index: InvertedIndex, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """(query_id, blocks, read): blocks that hold a word of the query, and those among them that its search reads."""
    words = written(query_weights(index, queries).select("query_id", "term", "w"))
    _, start, more = plan_ranges(index, words, k, first)
    all_blocks = words.join(_of_terms(index.blocks.select("term", "range"), words), "term")
    used = start.unionByName(more).withColumn("used", F.lit(1))
    return all_blocks.join(used, ["query_id", "range"], "left").groupBy("query_id").agg(F.count("*").alias("blocks"), F.count("used").alias("read"))
