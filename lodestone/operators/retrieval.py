"""Lexical, dense and fused retrieval for a batch of queries: every result is keyed by query_id."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import tokens
from lodestone.session import written

K1, B, RRF = 1.5, 0.75, 60
TOP_K, CANDIDATES = 5, 20
#: Queries and query words that are broadcast at once, about; vectors multiplied at once; products held at once.
QUERY_BLOCK, WORD_BLOCK, VECTOR_BLOCK, PRODUCTS = 1024, 500_000, 4096, 4 << 20
#: Products of vectors that a task holds at once, a few times over, and scored pairs that it sends at once.
DENSE_PRODUCTS, PAIRS = 1 << 19, 1 << 14


def rank_by(score: Column, *ties: str | Column, name: str = "query_id") -> Column:
    """1-based rank by falling score; scores are compared to nine digits, so the order of summation can't swap rows."""
    return F.row_number().over(Window.partitionBy(name).orderBy(F.round(score, 9).desc(), *ties))


@dataclass
class LexicalIndex:
    """documents(id, dl, terms, tfs): one row per document, its distinct terms in order and how often it has each;
    terms(term, df); stats(n, avgdl): one row, over all documents, empty ones included."""

    documents: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, id, tf, dl)"""
        rows = self.documents.select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        return rows.select(F.col("p.terms").alias("term"), "id", F.col("p.tfs").alias("tf"), "dl")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once per row, however often body's own lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(words: Column) -> Column:
    """struct(terms, tfs) of a sorted list of words: where runs of equal words start, and how long they are. Nothing is
    exploded, so a document's terms are counted where the document lies."""

    def counted(w: Column, starts: Column) -> Column:
        tfs = F.transform(starts, lambda i, j: (F.coalesce(F.get(starts, j + 1), F.size(w)) - i).cast("long"))
        return F.struct(F.transform(starts, lambda i: F.get(w, i)).alias("terms"), tfs.alias("tfs"), F.size(w).alias("dl"))

    def starts_of(w: Column) -> Column:
        every = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))

    return _bound(words, lambda w: _bound(starts_of(w), lambda s: counted(w, s)))


def _statistics(documents: DataFrame) -> LexicalIndex:
    terms = documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    stats = documents.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    return LexicalIndex(documents, terms, stats)


def build_lexical(docs: DataFrame, key: str, text: str = "text") -> LexicalIndex:
    """The index as plans over docs: each of its tables reads docs anew. store_lexical() writes them once."""
    counts = docs.select(F.col(key).alias("id"), term_counts(F.sort_array(tokens(F.col(text)))).alias("c"))
    return _statistics(counts.select("id", "c.dl", "c.terms", "c.tfs"))


def store_lexical(index: LexicalIndex, path: str) -> LexicalIndex:
    """The index written to a folder: documents once, terms and statistics from what was written."""
    spark = index.documents.sparkSession
    index.documents.write.mode("overwrite").parquet(f"{path}/documents")
    own = _statistics(spark.read.schema(index.documents.schema).parquet(f"{path}/documents"))
    own.terms.write.mode("overwrite").parquet(f"{path}/terms")
    own.stats.write.mode("overwrite").parquet(f"{path}/stats")
    return load_lexical(spark, path)


def load_lexical(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("documents", "terms", "stats")))


class _Best:
    """The k best scores of each query in this task so far; what lies below them needn't leave the task."""

    def __init__(self, n: int, k: int | None):
        self.k, self.top = k, np.full((n, k or 0), -np.inf)

    def keep(self, scores: np.ndarray) -> np.ndarray:
        """Which of these scores (rows, queries) may be among the k best; ties at the edge are settled later."""
        if self.k is None:
            return np.ones(scores.shape, bool)
        both = np.concatenate([self.top, scores.T], axis=1)
        self.top = np.partition(both, scores.shape[0], axis=1)[:, scores.shape[0] :]
        least = self.top.min(axis=1)
        return scores >= np.where(np.isfinite(least), least - 1e-9 * np.maximum(1, np.abs(least)), -np.inf)


def query_weights(index, queries: DataFrame) -> DataFrame:
    """(query_id, term, w, avgdl): how often the query has the word, times the word's weight in the whole index. index
    has terms(term, df) and stats(n, avgdl)."""
    words = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return words.join(index.terms, "term").join(F.broadcast(index.stats)).select("query_id", "term", (F.col("qtf") * idf).alias("w"), "avgdl")  # stats is one row


def _scorer(words: pd.DataFrame, k: int | None, k1: float, b: float):
    """Scores of batches of the index's documents for all queries of `words`, document by document inside a task."""
    names, who = np.unique(words["query_id"].to_numpy(), return_inverse=True)
    terms, what = np.unique(words["term"].to_numpy().astype(str), return_inverse=True)
    order = np.argsort(what, kind="stable")
    who, weight = who[order], words["w"].to_numpy(float)[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(what, minlength=len(terms)))])
    average, n = float(words["avgdl"].iloc[0]), len(names)
    names, terms = pa.array(names), pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(n, k)
        for batch in batches:
            lists = batch.column("terms")
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            doc, tf, at = doc[at >= 0], tf[at >= 0], at[at >= 0]
            dl = batch.column("dl").to_numpy(zero_copy_only=False)[doc]
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))
            many = first[at + 1] - first[at]
            # Slices of documents whose products, and whose table of scores, are of bounded size.
            work = np.maximum(np.bincount(doc, many, batch.num_rows), n)
            cut = np.flatnonzero(np.diff(np.cumsum(work) // PRODUCTS, prepend=0)).tolist()
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if hi <= lo:
                    continue
                own = slice(*np.searchsorted(doc, [lo, hi]))
                m = many[own]
                posting = np.repeat(np.arange(own.start, own.stop), m)
                query = first[at[posting]] + np.arange(len(posting)) - np.repeat(np.cumsum(m) - m, m)
                scores = np.bincount((doc[posting] - lo) * n + who[query], part[posting] * weight[query], (hi - lo) * n).reshape(hi - lo, n)
                row, q = np.nonzero(best.keep(scores) & (scores > 0))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column("id").take(pa.array(row + lo)), pa.array(scores[row, q])], names=["query_id", "id", "score"])

    return run


def _seats(queries: DataFrame, seats: int) -> Iterator[DataFrame]:
    """The queries in groups by hash."""
    for i in range(seats):
        yield queries if seats == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(seats)) == i)


def lexical_scores(index: LexicalIndex, queries: DataFrame, k: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score): BM25 above 0, of all documents, or of each query's k best. queries: (query_id, question);
    a repeated word counts twice.

    Statistics are those of the whole index, whatever is filtered later. The queries' words are grouped and broadcast
    for about QUERY_BLOCK queries and WORD_BLOCK words at once; more are a further pass over the index. A document
    is scored where it lies, for all queries, so no posting is shuffled, however frequent its word; a task sends only
    what may be among the k best of its documents."""
    spark = queries.sparkSession
    words = written(query_weights(index, queries))
    size = words.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("q")).first()
    seats = max(1, -(-size["n"] // WORD_BLOCK), -(-size["q"] // QUERY_BLOCK))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.documents.schema['id'].dataType.simpleString()}, score double"
    parts = [index.documents.select("id", "dl", "terms", "tfs").mapInArrow(_scorer(own, k, k1, b), schema) for seat in _seats(words, seats) if len(own := seat.toPandas())]
    out = functools.reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
    return out if k is None else out.withColumn("rank", rank_by(F.col("score"), "id")).where(F.col("rank") <= k).drop("rank")


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), float)


def _dense_scorer(names: pa.Array, q: np.ndarray, k: int):
    """Scores of batches (id, v) for the queries `names`, whose vectors are the rows of q. About DENSE_PRODUCTS products
    are held at once, and PAIRS rows are sent at once, however many vectors are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(q), k)
        step = max(1, min(VECTOR_BLOCK, DENSE_PRODUCTS // len(q)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                own = batch.slice(lo, step)
                if (own.column("v").value_lengths().to_numpy(zero_copy_only=False) != q.shape[1]).any():
                    raise ValueError(f"vectors must have {q.shape[1]} components")
                x = own.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
                rows, whose = np.nonzero(best.keep(x @ q.T))
                for a in range(0, len(rows), PAIRS):
                    row, who = rows[a : a + PAIRS], whose[a : a + PAIRS]
                    score = (x[row] * q[who]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), own.column("id").take(pa.array(row)), pa.array(score)], names=["query_id", "id", "score"])

    return run


def dense_scores(vectors: DataFrame, queries: DataFrame, k: int, most: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score): for each query its k largest inner products, zero and negative ones included.

    vectors: (id, vector); queries: (query_id, vector); null vectors take no part. Up to `most` queries, all of one
    length, are broadcast, and vectors stay where they lie; more queries are further passes over the vectors. A task
    multiplies blocks and sends only what may be among the k best of its vectors."""
    queries = queries.select("query_id", F.col("vector").alias("q")).where("q is not null")
    vectors = vectors.select("id", F.col("vector").alias("v")).where("v is not null")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"

    kind = to_arrow_type(queries.schema["query_id"].dataType)

    def scorer(few: pd.DataFrame):
        few = few.sort_values("query_id")
        return _dense_scorer(pa.array(few["query_id"], kind, from_pandas=True), _matrix(few["q"]), k)

    few = queries.limit(most + 1).toPandas()
    if len(few) <= most:
        groups = [few]
    else:
        queries = written(queries)  # each pass reads its share of them
        groups = (g.toPandas() for g in _seats(queries, -(-queries.count() // most)))
    parts = [vectors.mapInArrow(scorer(g), schema) for g in groups if len(g)]
    best = functools.reduce(DataFrame.union, parts) if parts else vectors.sparkSession.createDataFrame([], schema)
    return best.withColumn("rank", rank_by(F.col("score"), "id")).where(F.col("rank") <= k).drop("rank")


def allowed(meta: DataFrame, team: str = "", acl: str = "", priority: str = "", source_id: str = "") -> DataFrame | None:
    """Ids that meet every filter given; None without filters (an empty string is none)."""
    wanted = {k: v for k, v in (("team", team), ("acl", acl), ("priority", priority), ("source_id", source_id)) if v}
    out = meta
    for k, v in wanted.items():
        out = out.where(F.col(k) == v)
    return out.select("id") if wanted else None


def ranking(scores: DataFrame, candidates: int, allow: DataFrame | None = None, overfetch: int | None = 3, top_k: int = TOP_K, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """(query_id, id, score, rank): the first `candidates` allowed rows.

    overfetch: the ranking is cut at this many times as many rows before the filter; None filters first. Either way
    nothing that isn't allowed is returned."""
    if allow is not None and overfetch is None:
        scores, allow = scores.join(allow, "id", "left_semi"), None
    limit = max(candidates, top_k) * (overfetch or 1)
    rows = scores.withColumn("rank", rank_by(F.col("score"), *ties)).where(F.col("rank") <= limit)
    if allow is not None:
        rows = rows.join(allow, "id", "left_semi")
    return rows.withColumn("rank", rank_by(F.col("score"), *ties)).where(F.col("rank") <= candidates)


def fuse(dense: DataFrame, lexical: DataFrame, k: int = RRF) -> DataFrame:
    """(query_id, id, score, dense_rank, bm25_rank, rank): reciprocal ranks added up; ties by dense, then lexical rank."""
    both = dense.select("query_id", "id", "rank", F.lit("d").alias("s")).unionByName(lexical.select("query_id", "id", "rank", F.lit("b").alias("s")))
    rows = both.groupBy("query_id", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.max(F.when(F.col("s") == "d", F.col("rank"))).cast("long").alias("dense_rank"), F.max(F.when(F.col("s") == "b", F.col("rank"))).cast("long").alias("bm25_rank"))
    return rows.withColumn("rank", rank_by(F.col("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), "id"))


class Embedder(Protocol):
    model_name: str
    dim: int

    def passages(self, texts: list[str]) -> np.ndarray: ...

    def queries(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors drawn from a generator that the text's digest seeds: equal texts get equal vectors, nothing more."""

    def __init__(self, dim: int = 64):
        self.dim, self.model_name = dim, f"hash-{dim}"

    def passages(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            seed = int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "little") % (1 << 32)
            v = np.random.default_rng(seed).standard_normal(self.dim).astype(np.float32)
            out[i] = v / max(float(np.linalg.norm(v)), 1e-12)
        return out

    queries = passages


class SentenceEmbedder:
    """A sentence-transformers model, loaded once per worker, with the prefixes that its family is trained on."""

    def __init__(self, model_name: str, dim: int):
        self.model_name, self.dim, self._model = model_name, dim, None

    def _encode(self, texts: list[str], prefix: str) -> np.ndarray:
        if self._model is None:
            from sentence_transformers import SentenceTransformer  # optional

            self._model = SentenceTransformer(self.model_name)
        return np.asarray(self._model.encode([prefix + t for t in texts], normalize_embeddings=True), np.float32)

    def passages(self, texts: list[str]) -> np.ndarray:
        return self._encode(texts, "passage: ")

    def queries(self, texts: list[str]) -> np.ndarray:
        return self._encode(texts, "query: ")


def create_embedder(backend: str, model_name: str = "", dim: int = 64) -> Embedder:
    if backend == "hash":
        return HashEmbedder(dim)
    if backend in ("sentence_transformers", "st"):
        return SentenceEmbedder(model_name, dim)
    raise ValueError(f"unknown embedding backend: {backend}")


def embed(texts: DataFrame, embedder: Embedder, column: str = "text", out: str = "embedding", query: bool = False) -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = (embedder.queries if query else embedder.passages)(s.tolist())
            yield pd.Series(list(v))

    return texts.withColumn(out, run(column))


def embed_incremental(chunks: DataFrame, previous: DataFrame | None, embedder: Embedder) -> DataFrame:
    """(chunk_id, embedding, content_hash, model_name, reused): a vector is reused if its id, content, model and size
    are the same; only the others are computed."""
    own = chunks.select("chunk_id", "text", "content_hash")
    name = F.lit(embedder.model_name)
    if previous is None:
        return embed(own, embedder).select("chunk_id", "embedding", "content_hash", name.alias("model_name"), F.lit(False).alias("reused"))
    usable = previous.where((F.col("model_name") == name) & (F.size("embedding") == embedder.dim)).select("chunk_id", "content_hash", "embedding")
    kept = own.join(usable, ["chunk_id", "content_hash"]).select("chunk_id", "embedding", "content_hash", name.alias("model_name"), F.lit(True).alias("reused"))
    new = embed(own.join(usable, ["chunk_id", "content_hash"], "left_anti"), embedder)
    return kept.unionByName(new.select("chunk_id", "embedding", "content_hash", name.alias("model_name"), F.lit(False).alias("reused")))


def search(lexical: LexicalIndex | None, vectors: DataFrame | None, meta: DataFrame, queries: DataFrame, mode: str = "hybrid", top_k: int = TOP_K, candidates: int = CANDIDATES, rrf_k: int = RRF, overfetch: int | None = 3, **filters: str) -> DataFrame:
    """Hits of a batch of queries (query_id, question, vector): scores, ranks and the columns of meta (by id).

    mode: dense, bm25 or hybrid; the branch that isn't asked for isn't planned. Single modes return their own score."""
    if mode not in ("dense", "bm25", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    allow = allowed(meta, **filters)
    deep = max(candidates, top_k) * (overfetch or 1)
    cut = lambda s: ranking(s, candidates, allow, overfetch, top_k)
    dense = lexical_rank = None
    if mode != "bm25":
        reach = vectors.join(allow, "id", "left_semi") if allow is not None and overfetch is None else vectors
        dense = cut(dense_scores(reach, queries.select("query_id", "vector"), deep))
    if mode != "dense":
        if allow is not None and overfetch is None:
            lexical = LexicalIndex(lexical.documents.join(allow, "id", "left_semi"), lexical.terms, lexical.stats)
        lexical_rank = cut(lexical_scores(lexical, queries.select("query_id", "question"), deep))
    if mode == "hybrid":
        rows = fuse(dense, lexical_rank, rrf_k)
    else:
        one = dense if mode == "dense" else lexical_rank
        rank = F.col("rank").cast("long")
        none = F.lit(None).cast("long")
        rows = one.select("query_id", "id", "score", (rank if mode == "dense" else none).alias("dense_rank"), (none if mode == "dense" else rank).alias("bm25_rank"), "rank")
    return rows.where(F.col("rank") <= top_k).join(meta, "id", "left")
