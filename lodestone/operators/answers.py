"""Refusing, citing and answering, and how well that went."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import dot, or_else, quote, refuse_reason
from lodestone.operators.chunking import fences
from lodestone.operators.corpus import gold_errors, quality_gate  # noqa: F401  (part of this module's interface)

MIN_DENSE, NEAREST, QUOTE_CHARS, CONTEXT, EXCERPT = 0.28, 3, 280, 4, 420
MESSAGES = {
    "empty_query": "Please ask a question.",
    "secret": "Secrets and personal data can't be given here.",
    "out_of_scope": "This question isn't about the documentation.",
    "empty_retrieval": "Nothing on this was found in the documents.",
    "low_confidence": "The documents found are too far from the question.",
    "not_in_context": "What was found doesn't hold the facts to answer this.",
}
_HEADING_MARK = re.compile(r"^#{1,6}\s+")
LEAD = "According to the documentation:"
NEAREST_LEAD = "Nearest documents:"
NO_CONTEXT, NO_TEXT = "There is no text to answer from.", "The texts found hold nothing readable."
INSTRUCTIONS = "Answer only from CONTEXT, in the language of the question, and mark each statement with the number of its source, like [1]. Say so if CONTEXT has no answer. Give no secrets or personal data."


def confidence(hits: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, confidence): largest inner product of the query's vector with those of its hits; 0 without hits, null
    for a query without a vector."""
    near = hits.join(vectors.select("id", F.col("vector").alias("v")), "id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    best = near.groupBy("query_id").agg(F.max(dot(F.col("v"), F.col("q"))).alias("confidence"))
    rows = queries.select("query_id", F.col("vector").isNotNull().alias("_v")).join(best, "query_id", "left")
    return rows.select("query_id", F.when(F.col("_v"), F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def reason(question: Column, n_hits: Column, sure: Column, least: Column) -> Column:
    """Why to refuse; null to answer. The wording counts first, then missing hits, then low confidence."""
    return F.coalesce(refuse_reason(question), F.when(F.coalesce(n_hits, F.lit(0)) == 0, "empty_retrieval").when(sure.isNotNull() & (least > 0) & (sure < least), "low_confidence"))


def message(code: Column, default: str = "This can't be answered.") -> Column:
    known = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return F.when(code.isNotNull(), F.coalesce(F.element_at(known, code), F.lit(default)))


def first_per_document(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Each query's best hit per document, ranked anew; blank documents are skipped."""
    rows = hits.where(F.coalesce("doc_id", F.lit("")) != "").groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    rows = rows.withColumn("doc_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    return rows if limit is None else rows.where(F.col("doc_rank") <= limit)


def citations(hits: DataFrame, documents: DataFrame, locations: DataFrame, quote_chars: int = QUOTE_CHARS, scheme: str = "docs://", limit: int | None = None) -> DataFrame:
    """Numbered citations of hits (query_id, rank, chunk_id, doc_id, source_id, heading_path, text).

    documents: (doc_id, path); locations: (source_id, location). A missing path or location falls back to one made
    from the ids. A chunk is cited once per query. The chunk's text comes last, for those who build answers."""
    rows = hits if limit is None else hits.where(F.col("rank") <= limit)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).where("n = 1")
    rows = rows.withColumn("index", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    rows = rows.join(documents, "doc_id", "left").join(locations, "source_id", "left")
    path = or_else(F.col("path"), F.concat_ws("/", F.lit("corpus"), "source_id", F.concat("doc_id", F.lit(".md"))))
    base = F.regexp_replace(F.coalesce("location", F.lit("")), "/+$", "")
    url = F.when(base == "", F.concat(F.lit(scheme), "doc_id")).otherwise(F.concat(base, F.lit("#"), "doc_id"))
    return rows.select("query_id", "index", "chunk_id", "doc_id", "source_id", path.alias("path"), url.alias("url"), "heading_path", quote(F.col("text"), quote_chars).alias("quote"), "text")


def excerpt_of(text: str, limit: int = EXCERPT) -> str:
    """The first lines of a chunk, stripped, without heading marks, and without blank lines and those that start with
    `---`: up to the line with which they hold `limit` characters, then clipped. Fenced blocks on the way come whole;
    of one that isn't closed, eight lines."""
    lines = text.splitlines()
    blocks = {f.start: f for f in fences(lines)}
    fenced = {i for f in blocks.values() for i in f}
    out: list[str] = []
    for i, line in enumerate(lines):
        if i in blocks:
            own = [x.rstrip() for x in lines[i : blocks[i].stop]]
            shut = len(own) > 1 and own[-1].lstrip().startswith("```")
            own[0], own[-1] = own[0].strip(), own[-1].strip() if shut else own[-1]
            out.append("\n".join(own if shut else own[:8]))
        elif i not in fenced and (plain := _HEADING_MARK.sub("", line.strip())) and not plain.startswith("---"):
            out.append(plain)
            if sum(map(len, out)) >= limit:
                break
    joined = "\n".join(out).strip()
    return joined if len(joined) <= limit else joined[:limit].rstrip() + "…"


def excerpt(text: Column) -> Column:
    """excerpt_of as a column function; the scan over lines keeps state, so it is Arrow."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: excerpt_of(t or ""))

    return run(text)


def extractive(cited: DataFrame, excerpt_column: Callable[[Column], Column] = excerpt, most: int = CONTEXT) -> DataFrame:
    """(query_id, answer): the lead, then `**heading** [n]` and an excerpt for each of the first citations (with text);
    citations without readable text are left out, and a query with no other says so."""
    rows = cited.where(F.col("index") <= most).withColumn("_e", excerpt_column(F.col("text")))
    block = F.concat(F.lit("**"), _heading(), F.lit("** ["), F.col("index").cast("string"), F.lit("]\n"), F.col("_e"))
    rows = rows.withColumn("block", F.when(F.coalesce("_e", F.lit("")) != "", block))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("index", "block")))).alias("b"))
    full = F.array_join(F.concat(F.array(F.lit(LEAD)), F.transform("b", lambda x: x["block"])), "\n\n")
    return lists.select("query_id", F.when(F.size("b") > 0, full).otherwise(F.lit(NO_TEXT)).alias("answer"))


def _heading() -> Column:
    names = F.array_join("heading_path", " / ")
    return or_else(names, F.col("doc_id"))


def prompts(cited: DataFrame, queries: DataFrame, most: int = CONTEXT) -> DataFrame:
    """(query_id, prompt): the question, and the numbered texts of its first citations, for a language model."""
    block = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] doc_id="), F.col("doc_id"), F.lit(" path="), F.coalesce("path", F.lit("")), F.lit(" ("), _heading(), F.lit(")\n"), F.coalesce("text", F.lit("")))
    rows = cited.where(F.col("index") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", block.alias("block")))).alias("b"))
    context = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return queries.join(rows, "query_id").select("query_id", F.concat(F.lit(f"{INSTRUCTIONS}\n\nQUESTION:\n"), F.col("question"), F.lit("\n\nCONTEXT:\n"), context).alias("prompt"))


def generate(cited: DataFrame, queries: DataFrame, backend: str = "extractive", make_client: Callable[[], Callable[[list[str]], list[str]]] | None = None, most: int = CONTEXT) -> DataFrame:
    """(query_id, answer) by the backend: extractive, or openai / llm, which send prompts() through a client.

    make_client is called once in each task and returns a function from prompts to answers; it holds keys, retries and
    time limits. Batches are those of Arrow."""
    if backend == "extractive":
        return extractive(cited, most=most)
    if backend not in ("openai", "llm"):
        raise ValueError(f"unknown generation backend: {backend}")
    if make_client is None:
        raise RuntimeError("this backend needs a client")
    asked = prompts(cited, queries, most)

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            yield pd.DataFrame({"query_id": batch["query_id"], "answer": [a.strip() for a in client(batch["prompt"].tolist())]})

    return asked.mapInPandas(complete, f"query_id {asked.schema['query_id'].dataType.simpleString()}, answer string")


def decide(hits: DataFrame, queries: DataFrame, sure: DataFrame, least: float | Column = MIN_DENSE) -> DataFrame:
    """(query_id, question, confidence, refuse_reason) for every query, those without hits included."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    rows = queries.join(n, "query_id", "left").join(sure.select("query_id", "confidence"), "query_id", "left")
    why = reason(F.col("question"), F.col("n_hits"), F.col("confidence"), least if isinstance(least, Column) else F.lit(least))
    return rows.select("query_id", "question", "confidence", why.alias("refuse_reason"))


def cite(hits: DataFrame, decisions: DataFrame, documents: DataFrame, locations: DataFrame, nearest: int = NEAREST, context: int = CONTEXT, quote_chars: int = QUOTE_CHARS) -> DataFrame:
    """citations() of what each query shows: an answered one its first `context` hits, a refused one the best hits of
    its first `nearest` documents."""
    rows = hits.join(decisions.select("query_id", F.col("refuse_reason").isNotNull().alias("_refused")), "query_id")
    best = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")) == 1
    rows = rows.withColumn("_best", best & (F.coalesce("doc_id", F.lit("")) != ""))
    order = F.sum(F.col("_best").cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_n", order).where((F.col("_refused") & F.col("_best") & (F.col("_n") <= nearest)) | (~F.col("_refused") & (F.col("rank") <= context)))
    return citations(rows.drop("_refused", "_best", "_n"), documents, locations, quote_chars)


def ask(hits: DataFrame, queries: DataFrame, sure: DataFrame, cited: DataFrame | None = None, least: float | Column = MIN_DENSE, documents: DataFrame | None = None, locations: DataFrame | None = None, nearest: int = NEAREST, context: int = CONTEXT, backend: str = "extractive", make_client: Callable | None = None) -> DataFrame:
    """One response per query, refused ones included: query_id, refuse, refuse_reason, confidence, answer, n_citations,
    citations (array of structs, by index), retrieved (ids of the chunks found, by rank).

    Refusals come after retrieval, so they still carry citations: the nearest documents, which the answer lists.
    cited: citations made elsewhere (query_id, index, heading_path, text, ...), in place of cite()'s."""
    decisions = decide(hits, queries, sure, least)
    if cited is None:
        cited = cite(hits, decisions, documents, locations, nearest, context)
    shown = [c for c in ("index", "chunk_id", "doc_id", "source_id", "path", "url", "heading_path", "quote") if c in cited.columns]
    answers = generate(cited.join(decisions.where("refuse_reason is null").select("query_id"), "query_id", "left_semi"), queries, backend, make_client, context)
    lists = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("citations"))
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    rows = decisions.join(answers, "query_id", "left").join(lists, "query_id", "left").join(found, "query_id", "left")
    refused = F.col("refuse_reason").isNotNull()
    text = message(F.col("refuse_reason"))
    if "path" in shown:
        lines = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("- ["), c["index"].cast("string"), F.lit("] "), or_else(c["path"], c["doc_id"]))), "\n")
        text = F.when(F.size("citations") > 0, F.concat(text, F.lit(f"\n\n{NEAREST_LEAD}\n"), lines)).otherwise(text)
    return rows.select(
        "query_id", refused.alias("refuse"), "refuse_reason", "confidence", F.when(refused, text).otherwise(F.coalesce("answer", F.lit(NO_CONTEXT))).alias("answer"),
        F.when(F.col("citations").isNull(), 0).otherwise(F.size("citations")).cast("long").alias("n_citations"), "citations", "retrieved",
    )


def citation_ok(refuse: Column, why: Column, citations: Column) -> Column:
    """Every citation has a path; none at all is right only for refusals of empty questions or results."""
    none = citations.isNull() | (F.size(citations) == 0)
    return F.when(none, refuse & F.coalesce(why.isin("empty_retrieval", "empty_query"), F.lit(False))).otherwise(F.forall(citations, lambda c: F.coalesce(c["path"], F.lit("")) != ""))


def grounded_ok(refuse: Column, citations: Column, relevant: Column) -> Column:
    """A relevant document is cited; true for refusals, and for cases without relevant documents."""
    wanted = F.coalesce(relevant, F.array().cast("array<string>"))
    cited = F.transform(F.coalesce(citations, F.lit(None)), lambda c: c["doc_id"].cast("string"))
    return refuse | (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap(cited, wanted), F.lit(False))


def ask_cases(responses: DataFrame, cases: DataFrame) -> DataFrame:
    """cases (query_id, expected_behavior, relevant_doc_ids) with refuse, refuse_reason, refuse_ok, citation_ok,
    grounded_ok and the cited documents."""
    rows = cases.join(responses.select("query_id", "refuse", "refuse_reason", "citations"), "query_id")
    r, c = F.col("refuse"), F.col("citations")
    return rows.select(
        "query_id", "expected_behavior", "refuse", "refuse_reason", ((F.col("expected_behavior") != "refuse") | r).alias("refuse_ok"), citation_ok(r, F.col("refuse_reason"), c).alias("citation_ok"),
        grounded_ok(r, c, F.col("relevant_doc_ids")).alias("grounded_ok"), F.transform(c, lambda x: x["doc_id"]).alias("cited_doc_ids"),
    )


def counted(of: Column, weight: Column | None = None) -> Column:
    """Number of the rows `of`, or the sum of their weights."""
    return F.count_if(of) if weight is None else F.coalesce(F.sum(F.when(of, weight)), F.lit(0))


def rate(hit: Column, of: Column, empty: float, weight: Column | None = None) -> Column:
    """Share of the rows `of` that are also `hit`; `empty` where there are none."""
    return F.when(counted(of, weight) == 0, F.lit(empty)).otherwise(counted(of & hit, weight) / counted(of, weight))


def ask_rates(cases: DataFrame, by: tuple[str, ...] = (), gates: tuple[float, float, float] = (0.9, 1.0, 0.8), weight: Column | None = None) -> DataFrame:
    """Rates of cases (expected_behavior, refuse, citation_ok, grounded_ok), and whether they pass the gates: n_refuse,
    n_answer, refuse_rate, citation_contract_rate, grounded_rate (refusals count as grounded), answered_rate,
    answer_refuse_rate, grounded_among_answered, refuse_ok, citation_contract_ok, grounded_ok. weight: how many cases a
    row stands for."""
    should = F.col("expected_behavior") == "refuse"
    answers = F.col("expected_behavior") == "answer"
    share = lambda hit, of, empty: rate(hit, of, empty, weight)
    refuse, grounded = F.col("refuse"), F.col("grounded_ok")
    out = cases.groupBy(*by).agg(
        counted(should, weight).alias("n_refuse"), counted(answers, weight).alias("n_answer"),
        share(refuse, should, 1.0).alias("refuse_rate"), share(F.col("citation_ok"), F.lit(True), 0.0).alias("citation_contract_rate"), share(grounded, answers, 1.0).alias("grounded_rate"),
        share(~refuse, answers, 1.0).alias("answered_rate"), share(refuse, answers, 0.0).alias("answer_refuse_rate"), share(grounded, answers & ~refuse, 0.0).alias("grounded_among_answered"),
    )
    passed = zip(("refuse", "citation_contract", "grounded"), gates, strict=True)
    return out.withColumns({f"{n}_ok": F.col(f"{n}_rate") >= g for n, g in passed})


def first_relevant(docs: DataFrame, relevant: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, first_rank) for every case: rank of the first relevant document, null without one.

    docs: (query_id, doc_id, doc_rank); relevant: (query_id, doc_id)."""
    met = docs.join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("doc_rank").cast("long").alias("first_rank"))
    return cases.select("query_id").join(met, "query_id", "left")


def recall_mrr(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), mrr_k: int = 10, gates: tuple[float, float] = (0.7, 0.5), by: tuple[str, ...] = ()) -> DataFrame:
    """recall_at_k, mrr and the gates over (query_id, first_rank). A recall that isn't asked for fails its gate."""
    hit = lambda k: F.coalesce(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0))
    mrr = F.coalesce(F.avg(F.when(F.col("first_rank") <= mrr_k, 1.0 / F.col("first_rank")).otherwise(0.0)), F.lit(0.0))
    out = ranks.groupBy(*by).agg(F.count("*").alias("n"), *[hit(k).alias(f"recall_at_{k}") for k in ks], mrr.alias("mrr"))
    at10 = F.col("recall_at_10") if 10 in ks else F.lit(0.0)
    return out.withColumns({"recall_ok": at10 >= gates[0], "mrr_ok": F.col("mrr") >= gates[1]})


def winner(runs: DataFrame, keys: tuple[str, ...], order: str = "run") -> DataFrame:
    """The run with the largest keys in turn; the first by `order` where all are equal."""
    return runs.orderBy(*[F.desc(k) for k in keys], order).limit(1)


def markdown(runs: DataFrame, columns: tuple[str, ...]) -> str:
    """Runs as a markdown table; a sweep has a few dozen rows."""
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in columns) + " |" for r in runs.select(*columns).collect()])
