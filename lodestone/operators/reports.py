"""Reports: metrics, the gates that they pass, and the cases behind what they miss; percentiles from sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import answers as A
from lodestone.operators import corpus

#: What reports ask for where nothing else is given.
RETRIEVAL_GATES = {"recall_at_10": 0.7, "mrr": 0.5}
ASK_GATES = {"refuse_rate": 0.9, "citation_contract_rate": 1.0, "grounded_rate": 0.8}
#: Size parameter of a sketch: ranks are wrong by 1.65% at most, in 99 of 100 sketches.
SKETCH_K = 200


def thresholds(defaults: dict[str, float], own: Column | None = None) -> Column:
    """A map of metric to threshold: the defaults, with those of the map `own` in their place or beside them."""
    base = F.create_map(*[F.lit(x) for name, least in defaults.items() for x in (name, float(least))])
    if own is None:
        return base
    given = F.coalesce(own.cast("map<string,double>"), F.create_map().cast("map<string,double>"))
    return F.map_concat(F.map_filter(base, lambda name, _: ~F.map_contains_key(given, name)), given)


def gated(row: DataFrame, defaults: dict[str, float], own: Column | None = None) -> DataFrame:
    """row with `thresholds`, `gates` (whether each threshold is reached) and `passed`. A threshold for a metric that the
    row doesn't have fails."""
    metrics = F.create_map(*[x for n, kind in row.dtypes if kind in ("double", "bigint", "int") for x in (F.lit(n), F.col(n).cast("double"))])
    out = row.withColumn("thresholds", thresholds(defaults, own))
    out = out.withColumn("gates", F.transform_values("thresholds", lambda name, least: F.coalesce(F.try_element_at(metrics, name) >= least, F.lit(False))))
    return out.withColumn("passed", F.forall(F.map_values("gates"), lambda ok: ok))


def eval_report(ranks: DataFrame, docs: DataFrame, own: Column | None = None, ks: tuple[int, ...] = (1, 5, 10), shown: int = 5, most: int = 100) -> DataFrame:
    """One row: n, recall_at_k, mrr, thresholds, gates, passed, n_misses, and the first `most` misses by query: each with
    its first relevant rank and what was retrieved. ranks: (query_id, first_rank); docs: (query_id, doc_id, doc_rank)."""
    metrics = A.recall_mrr(ranks, ks, max(ks)).drop("recall_ok", "mrr_ok")
    missed = corpus.misses(ranks, docs, max(ks), shown)
    first = missed.orderBy("query_id").limit(most).agg(F.array_sort(F.collect_list(F.struct("query_id", "first_rank", "retrieved"))).alias("misses"))
    return gated(metrics, RETRIEVAL_GATES, own).join(missed.agg(F.count("*").alias("n_misses"))).join(first)  # one row each


def case_failures(cases: DataFrame) -> DataFrame:
    """(query_id, failure, refuse_reason, cited_doc_ids) of answers.ask_cases(): what should have been refused and was
    not, answers without a relevant document among what they cite, and broken citations. A case may fail twice."""
    answer = F.col("expected_behavior") == "answer"
    kinds = F.array(F.when(~F.col("refuse_ok"), "not refused"), F.when(~F.col("citation_ok"), "broken citation"), F.when(answer & ~F.col("grounded_ok"), "not grounded"))
    return cases.select("query_id", F.explode(F.array_compact(kinds)).alias("failure"), "refuse_reason", "cited_doc_ids")


def ask_report(cases: DataFrame, own: Column | None = None, most: int = 100) -> DataFrame:
    """One row: ask_rates(), thresholds, gates, passed, n_failures by kind, and the first `most` failures by query."""
    rates = A.ask_rates(cases).drop("refuse_ok", "citation_contract_ok", "grounded_ok")
    failed = case_failures(cases)
    kinds = {"refuse_failures": "not refused", "ungrounded": "not grounded", "broken_citations": "broken citation"}
    counts = failed.agg(*[F.count_if(F.col("failure") == kind).alias(name) for name, kind in kinds.items()])
    first = failed.orderBy("query_id", "failure").limit(most).agg(F.array_sort(F.collect_list(F.struct("query_id", "failure", "refuse_reason", "cited_doc_ids"))).alias("failures"))
    return gated(rates, ASK_GATES, own).join(counts).join(first)  # one row each


def embed_report(embeddings: DataFrame) -> DataFrame:
    """One row about vectors of retrieval.embed_incremental(): total, new, reused, dim, models."""
    dim = F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("long")
    return embeddings.agg(F.count("*").alias("total"), F.count_if(~F.col("reused")).alias("new"), F.count_if("reused").alias("reused"), dim.alias("dim"), F.countDistinct("model_name").alias("models"))


def latency_sketches(events: DataFrame, by: tuple[str, ...] = ("event_type",), value: str = "value", ts: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """(by, day, n, sketch): a quantile sketch of a day's values, of bounded size, made in tasks and merged. Null values
    are left out; days are the session's."""
    rows = events.where(F.col(value).isNotNull())
    return rows.groupBy(*by, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def percentiles(sketches: DataFrame, by: tuple[str, ...] = ("event_type",), shares: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = SKETCH_K) -> DataFrame:
    """(by, n, p50, p95, ...): quantiles of the days together, from their sketches alone."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("s"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias(f"p{f'{100 * p:g}'.replace('.', '_')}") for p in shares])
