"""Questions answered end to end from an index, evaluation over gold cases, and sweeps over parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dot
from lodestone.operators import answers as A
from lodestone.operators import retrieval as R
from lodestone.operators.indexing import Index
from lodestone.session import written


def found(index: Index, queries: DataFrame, mode: str = "hybrid", top_k: int = R.TOP_K, **options) -> DataFrame:
    """search() over a stored index, written once: what follows joins the hits several times."""
    return written(R.search(index.lexical, index.vectors, index.meta, queries, mode=mode, top_k=top_k, **options).withColumnRenamed("id", "chunk_id"))


def _confidence(index: Index, hits: DataFrame, queries: DataFrame) -> DataFrame:
    return A.confidence(hits.withColumnRenamed("chunk_id", "id"), index.vectors, queries)


def ask(index: Index, queries: DataFrame, documents: DataFrame, locations: DataFrame, mode: str = "hybrid", top_k: int = R.TOP_K, least: float = A.MIN_DENSE, nearest: int = A.NEAREST, context: int = A.CONTEXT, backend: str = "extractive", make_client: Callable | None = None, **options) -> DataFrame:
    """answers.ask() for queries (query_id, question, vector): retrieval at max(top_k, nearest), confidence, refusals,
    citations and answers. options: search()'s candidates, rrf_k, overfetch and filters."""
    hits = found(index, queries, mode, max(top_k, nearest), **options)
    sure = written(_confidence(index, hits, queries))
    return A.ask(hits, queries.select("query_id", "question"), sure, None, least, documents, locations, nearest, context, backend, make_client)


def ask_cases(index: Index, queries: DataFrame, cases: DataFrame, documents: DataFrame, locations: DataFrame, mode: str = "hybrid", top_k: int = R.TOP_K, least: float = A.MIN_DENSE, nearest: int = A.NEAREST, context: int = A.CONTEXT, **options) -> DataFrame:
    """answers.ask_cases() of what ask() says to the queries. What is refused and cited decides them, so no answer is
    written and no text is fetched."""
    bare = replace(index, meta=index.meta.withColumn("text", F.lit(None).cast("string")))
    hits = found(bare, queries, mode, max(top_k, nearest), **options)
    decisions = written(A.decide(hits, queries.select("query_id", "question"), _confidence(index, hits, queries), least))
    cited = A.cite(hits, decisions, documents, locations, nearest, context)
    lists = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "doc_id", "path"))).alias("citations"))
    said = decisions.select("query_id", F.col("refuse_reason").isNotNull().alias("refuse"), "refuse_reason").join(lists, "query_id", "left")
    return A.ask_cases(said, cases)


def retrieval_ranks(index: Index, queries: DataFrame, relevant: DataFrame, mode: str, top_k: int = 10, ks: tuple[int, ...] = (1, 5, 10), **options) -> tuple[DataFrame, DataFrame]:
    """(first ranks, ranked documents) of queries: max(top_k, ks) chunks are fetched, and ranked by their documents."""
    docs = A.first_per_document(found(index, queries, mode, max(top_k, *ks), **options).select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "rank"), max(ks))
    return A.first_relevant(docs, relevant, queries), docs


def retrieval_sweep(index: Index, queries: DataFrame, relevant: DataFrame, modes: tuple[str, ...] = ("hybrid", "dense", "bm25"), top_k: int = 10, ks: tuple[int, ...] = (1, 5, 10), **options) -> DataFrame:
    """One row per mode: run, place (in the order of modes), n, recall_at_k, mrr and the gates."""
    out = None
    for i, mode in enumerate(modes):
        ranks, _ = retrieval_ranks(index, queries, relevant, mode, top_k, ks, **options)
        own = ranks.withColumns({"run": F.lit(mode), "place": F.lit(i)})
        out = own if out is None else out.union(own)
    return A.recall_mrr(out, ks, max(ks), by=("run", "place"))


def _states(index: Index, hits: DataFrame, queries: DataFrame, cases: DataFrame, documents: DataFrame, locations: DataFrame, depths: list[int], nearest: int, context: int) -> DataFrame:
    """One row per case and depth: expected_behavior, depth, confidence, whether it is refused whatever the confidence
    (fixed), and whether its citations hold if answered (cited, grounded) and if refused (refused_cited).

    Each hit is multiplied with its query once; confidences of all depths are maxima over prefixes of the ranks."""
    product = hits.select("query_id", F.col("chunk_id").alias("id"), "rank").join(index.vectors, "id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    product = product.select("query_id", "rank", dot(F.col("vector"), F.col("q")).alias("p"))
    upto = lambda name, agg, of: [agg(F.when(F.col("rank") <= d, of)).alias(f"_{name}{d}") for d in depths]
    sure = product.groupBy("query_id").agg(*upto("p", F.max, F.col("p")))
    many = hits.groupBy("query_id").agg(*upto("n", F.count, F.lit(1)))
    per_depth = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"_p{d}").alias("p"), F.coalesce(f"_n{d}", F.lit(0)).alias("n")) for d in depths])
    rows = cases.join(queries, "query_id").join(sure, "query_id", "left").join(many, "query_id", "left").withColumn("_d", F.explode(per_depth)).withColumn("depth", F.col("_d.depth"))
    rows = rows.withColumn("confidence", F.when(F.col("vector").isNotNull(), F.coalesce("_d.p", F.lit(0.0)))).withColumn("fixed", A.reason(F.col("question"), F.col("_d.n"), F.lit(None).cast("double"), F.lit(0.0)))
    # Citations of both outcomes at each depth, whichever a threshold will choose.
    both = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(r).alias("refused")) for d in depths for r in (False, True)])
    spread = lambda df: df.withColumn("_s", F.explode(both)).withColumn("query_id", F.struct(F.col("query_id").alias("id"), F.col("_s.depth").alias("depth"), F.col("_s.refused").alias("refused")))
    outcomes = spread(queries.select("query_id")).select("query_id", F.when(F.col("_s.refused"), "refused").alias("refuse_reason"))
    cited = A.cite(spread(hits).where(F.col("rank") <= F.col("_s.depth")).drop("_s"), outcomes, documents, locations, nearest, context)
    lists = cited.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "path")).alias("c"))
    kept = lists.groupBy(F.col("query_id.id").alias("query_id"), F.col("query_id.depth").alias("depth"))
    kept = kept.agg(F.max(F.when(~F.col("query_id.refused"), F.col("c"))).alias("c"), F.max(F.when(F.col("query_id.refused"), F.col("c"))).alias("r"))
    rows, answered = rows.join(kept, ["query_id", "depth"], "left"), F.lit(False)
    return rows.select(
        "depth", "expected_behavior", "confidence", F.col("fixed").isNotNull().alias("fixed"), A.citation_ok(answered, F.lit(None).cast("string"), F.col("c")).alias("cited"),
        A.grounded_ok(answered, F.col("c"), F.col("relevant_doc_ids")).alias("grounded"), A.citation_ok(F.lit(True), F.coalesce("fixed", F.lit("low_confidence")), F.col("r")).alias("refused_cited"),
    )


def ask_sweep(index: Index, queries: DataFrame, cases: DataFrame, documents: DataFrame, locations: DataFrame, least: tuple[float, ...] = (A.MIN_DENSE,), top_ks: tuple[int, ...] = (R.TOP_K,), backends: tuple[str, ...] = ("extractive",), nearest: int = A.NEAREST, context: int = A.CONTEXT, mode: str = "hybrid", **options) -> DataFrame:
    """One row per backend, threshold and depth, in this order of nesting: run, place, backend, min_dense, top_k, and
    ask_rates().

    The queries are searched once, at the largest depth. Cases are counted by depth, outcome and how many thresholds
    their confidence reaches; every threshold's rates are sums over those few counts, so what is shuffled doesn't grow
    with the thresholds. Rates say what is refused and cited, which no backend changes: no answer is written."""
    depths = sorted({max(k, nearest) for k in top_ks})
    hits = found(index, queries, mode, depths[-1], **options)
    ordered = sorted({float(s) for s in least})
    reached = F.size(F.filter(F.array(*map(F.lit, ordered)), lambda s: s <= F.col("confidence")))
    states = _states(index, hits, queries, cases, documents, locations, depths, nearest, context).withColumn("reached", F.when(F.col("confidence").isNull(), len(ordered)).otherwise(reached))
    counts = states.drop("confidence").groupBy("depth", "reached", "expected_behavior", "fixed", "cited", "grounded", "refused_cited").agg(F.count("*").alias("cases"))
    grid = [(f"{b}:{float(s)}:{int(k)}", i, b, float(s), int(k), max(k, nearest), ordered.index(float(s))) for i, (b, s, k) in enumerate((b, s, k) for b in backends for s in least for k in top_ks)]
    runs = counts.sparkSession.createDataFrame(grid, "run string, place int, backend string, min_dense double, top_k int, depth int, number int")
    rows = counts.join(F.broadcast(runs), "depth")  # a sweep's runs are a few
    rows = rows.withColumn("refuse", F.col("fixed") | ((F.col("min_dense") > 0) & (F.col("reached") <= F.col("number"))))
    rows = rows.withColumn("citation_ok", F.when(F.col("refuse"), F.col("refused_cited")).otherwise(F.col("cited"))).withColumn("grounded_ok", F.col("refuse") | F.col("grounded"))
    return A.ask_rates(rows, by=("run", "place", "backend", "min_dense", "top_k"), weight=F.col("cases"))


def best_retrieval(runs: DataFrame) -> DataFrame:
    """The run with the best recall at 10, then MRR; the first in place where they are equal."""
    return A.winner(runs, ("recall_at_10", "mrr"), order="place")


def best_ask(runs: DataFrame, gates: tuple[float, float, float] = (0.9, 1.0, 0.8)) -> DataFrame:
    """The run that passes the gates, then answers most, then is grounded and refuses best; then the first in place."""
    done: Column = (F.col("refuse_rate") >= gates[0]) & (F.col("citation_contract_rate") >= gates[1]) & (F.col("grounded_among_answered") >= gates[2])
    return A.winner(runs.withColumn("_done", done.cast("int")), ("_done", "answered_rate", "grounded_among_answered", "refuse_rate"), order="place").drop("_done")


def report(retrieval: DataFrame, asked: DataFrame) -> str:
    """Both sweeps and their winners as markdown."""
    parts = ["# Experiments", "## Retrieval", A.markdown(retrieval.orderBy("place"), ("run", "recall_at_1", "recall_at_5", "recall_at_10", "mrr", "n"))]
    parts += ["## Answers", A.markdown(asked.orderBy("place"), ("backend", "min_dense", "top_k", "refuse_rate", "answered_rate", "grounded_among_answered", "citation_contract_rate"))]
    winners = [f"- {name}: **{row['run']}**" for name, row in (("retrieval", best_retrieval(retrieval).first()), ("answers", best_ask(asked).first())) if row]
    return "\n\n".join([*parts, "## Winners", "\n".join(winners)]) + "\n"
