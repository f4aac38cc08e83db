"""What a corpus has to cover: scopes of sources, gold cases, coverage, and checks of chunks and gold items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import strip

# The fields of a gold item and of a chunk, and the values that fields may have.
GOLD_FIELDS = ("id", "question", "query_type", "expected_behavior", "relevant_doc_ids", "primary_doc_id", "source_ids", "source_priority", "reference_answer", "notes", "tags", "language")
GOLD_REQUIRED = ("id", "question", "query_type", "expected_behavior", "source_priority")
QUERY_TYPES = ("how-to", "troubleshooting", "where-is", "concept", "policy")
GOLD_VALUES = {"query_type": QUERY_TYPES, "expected_behavior": ("answer", "refuse"), "source_priority": ("p0", "p1"), "language": ("ru", "en", "mixed")}
CHUNK_FIELDS = ("chunk_id", "doc_id", "source_id", "chunk_index", "text", "heading_path", "acl", "team", "priority", "language", "content_hash")


def in_scope(catalog: DataFrame, priorities: tuple[str, ...], exclude: tuple[str, ...] = ("exclude",)) -> DataFrame:
    """Sources of these priorities; exclusion beats inclusion. A null priority is in no scope."""
    return catalog.where(F.col("priority").isin(*priorities) & ~F.col("priority").isin(*exclude))


def scope_counts(manifest: DataFrame, scoped: DataFrame) -> DataFrame:
    """One row: total, in_scope, skipped rows of a manifest. Scoped sources are distinct before the join."""
    known = scoped.select("source_id").distinct().withColumn("_in", F.lit(True))
    rows = manifest.select("source_id").groupBy("source_id").agg(F.count("*").alias("k")).join(known, "source_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(total("k").alias("total"), total(F.when(F.col("_in"), F.col("k"))).alias("in_scope"), total(F.when(F.col("_in").isNull(), F.col("k"))).alias("skipped"))


def counts_by_source(rows: DataFrame) -> DataFrame:
    """(source_id, n), sorted by source."""
    return rows.groupBy("source_id").agg(F.count("*").alias("n")).orderBy("source_id")


def _ids(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _own_documents() -> Column:
    """Relevant documents of a gold item, and its primary one."""
    primary = F.when(F.coalesce("primary_doc_id", F.lit("")) != "", F.array("primary_doc_id")).otherwise(F.array().cast("array<string>"))
    return F.array_union(_ids("relevant_doc_ids"), primary)


def gold_documents(gold: DataFrame) -> DataFrame:
    """(doc_id): every document that a gold item names."""
    return gold.select(F.explode(_own_documents()).alias("doc_id")).distinct()


def priority_documents(gold: DataFrame, priority: str = "p0") -> DataFrame:
    """(doc_id): documents that cases of this priority need, refusals aside."""
    wanted = (F.col("source_priority") == priority) & ~F.col("expected_behavior").eqNullSafe("refuse")
    return gold_documents(gold.where(wanted))


def eval_cases(gold: DataFrame, priorities: tuple[str, ...] | None = ("p0",), behaviors: tuple[str, ...] | None = ("answer",)) -> DataFrame:
    """Gold items of these priorities and behaviours (None: any); items to answer need a relevant document."""
    out = gold.where(~F.col("expected_behavior").eqNullSafe("answer") | (F.size(_ids("relevant_doc_ids")) > 0))
    if priorities is not None:
        out = out.where(F.col("source_priority").isin(*priorities))
    return out if behaviors is None else out.where(F.col("expected_behavior").isin(*behaviors))


def ask_cases(gold: DataFrame, priorities: tuple[str, ...] = ("p0",), answer_limit: int | None = None, order: str = "line") -> DataFrame:
    """Items to refuse, then items to answer, with `part` (0, 1): sort by part and `order`. answer_limit: only the
    first so many items to answer, by `order` (lines of a file)."""
    refuse, answer = (eval_cases(gold, priorities, (b,)).withColumn("part", F.lit(i)) for i, b in enumerate(("refuse", "answer")))
    return refuse.unionByName(answer if answer_limit is None else answer.orderBy(order).limit(answer_limit))


def sample_documents(catalog: DataFrame) -> DataFrame:
    """(doc_id): every sample that a catalog names."""
    return catalog.select(F.explode("sample_doc_ids").alias("doc_id")).distinct()


def coverage_gaps(catalog: DataFrame, gold: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(gap, id): documents that samples or gold items name and the manifest or the disk lacks, manifest paths without
    a file, and sources that gold items name and the catalog lacks. manifest: (id, path); files: (stem, tail)."""
    required = sample_documents(catalog).union(gold_documents(gold)).distinct()
    gap = lambda name, rows: rows.select(F.lit(name).alias("gap"), F.col(rows.columns[0]).alias("id"))
    lacks = lambda rows, there: rows.join(there.distinct(), rows.columns[0], "left_anti")
    named = gold.select(F.explode("source_ids").alias("source_id")).distinct()
    paths = manifest.select(F.regexp_extract("path", r"([^/]+/[^/]+\.md)$", 1).alias("tail"), "path")
    return (
        gap("not in the manifest", lacks(required, manifest.select(F.col("id").alias("doc_id"))))
        .union(gap("not on disk", lacks(required, files.select(F.col("stem").alias("doc_id")))))
        .union(gap("path without a file", paths.join(files.select("tail").distinct(), "tail", "left_anti").select("path")))
        .union(gap("source not in the catalog", lacks(named, catalog.select("source_id"))))
    )


def misses(ranks: DataFrame, docs: DataFrame, k: int = 10, shown: int = 5) -> DataFrame:
    """(query_id, first_rank, retrieved): cases whose first relevant document isn't among the first k, with the first
    `shown` documents retrieved. ranks: (query_id, first_rank); docs: (query_id, doc_id, doc_rank)."""
    missed = ranks.where(F.col("first_rank").isNull() | (F.col("first_rank") > k))
    near = docs.where(F.col("doc_rank") <= shown).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_rank", "doc_id"))).alias("d"))
    return missed.join(near, "query_id", "left").select("query_id", "first_rank", F.coalesce(F.transform("d", lambda x: x["doc_id"]), F.array().cast("array<string>")).alias("retrieved"))


def gold_counts(gold: DataFrame) -> DataFrame:
    """(field, value, n) over query types and expected behaviours; null values count under null."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("query_type", "expected_behavior")])
    return gold.select(F.explode(fields).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def gold_warnings(gold: DataFrame, few: int = 30, types: int = 3) -> DataFrame:
    """One row: items, types, refusals, and `warnings` where there are too few of them."""
    counts = gold.agg(F.count("*").alias("items"), F.countDistinct("query_type").alias("types"), F.count_if(F.col("expected_behavior") == "refuse").alias("refusals"))
    texts = F.array(F.when(F.col("items") < few, "few items"), F.when(F.col("types") < types, "few types"), F.when(F.col("refusals") < 1, "no refusals"))
    return counts.withColumn("warnings", F.array_compact(texts))


def unknown_keys(lines: DataFrame, known: tuple[str, ...] = GOLD_FIELDS, value: str = "value") -> DataFrame:
    """lines with `unknown`: keys of each JSON object that aren't fields; null for lines that are no object."""
    return lines.withColumn("unknown", F.array_except(F.json_object_keys(F.col(value)), F.array(*map(F.lit, known))))


def gold_errors(gold: DataFrame, sources: DataFrame) -> DataFrame:
    """gold with `errors`: broken ids, short questions, unknown values, missing or foreign references. Null fields are
    missing; equal rows have equal errors."""
    rows = gold.withColumn("_row", F.xxhash64(F.to_json(F.struct(*gold.columns))))
    foreign = rows.select("_row", F.explode("source_ids").alias("source_id")).join(sources.select("source_id").distinct(), "source_id", "left_anti")
    rows = rows.join(foreign.select("_row").distinct().withColumn("_foreign", F.lit(True)), "_row", "left")
    relevant, blank = _ids("relevant_doc_ids"), lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    check = lambda bad, text: F.when(bad, F.lit(text))
    answered, primary = F.col("expected_behavior") == "answer", F.col("primary_doc_id")
    required = [check(F.coalesce(F.col(c), F.lit("")) == "", f"missing {c}") for c in GOLD_REQUIRED]
    errors = F.array(
        *required, check(F.col("relevant_doc_ids").isNull(), "missing relevant_doc_ids"), check(~F.col("id").rlike("^q-[a-z0-9-]+$"), "bad id"), check(F.length(strip(F.col("question"))) < 5, "short question"),
        *[check(~F.col(c).isin(*known), f"bad {c}") for c, known in GOLD_VALUES.items() if c in gold.columns], check(F.exists(relevant, blank), "blank relevant document"),
        check(answered & (F.size("relevant_doc_ids") == 0), "no relevant document"), check(answered & blank(primary), "no primary document"), check(answered & ~blank(primary) & ~F.array_contains(relevant, primary), "primary not relevant"),
        check(F.col("_foreign"), "unknown source"),
    )
    return rows.withColumn("errors", F.array_compact(errors)).drop("_row", "_foreign")


def chunk_errors(chunks: DataFrame, fields: tuple[str, ...] = CHUNK_FIELDS, limit: int | None = 20) -> DataFrame:
    """(chunk_id, error): the first field that each incomplete chunk lacks; of many, the first `limit` by id."""
    first = F.coalesce(*[F.when(F.col(c).isNull(), f"missing {c}") for c in fields])
    out = chunks.select("chunk_id", first.alias("error")).where("error is not null")
    return out if limit is None else out.orderBy("chunk_id", "error").limit(limit)


def quality_gate(documents: DataFrame, chunks: DataFrame, gold_ids: DataFrame, priorities: tuple[str, ...] = ("p0",)) -> DataFrame:
    """One row: docs_with_chunks, orphans (documents without chunks), missing_gold, incomplete chunks, ok.

    gold_ids: documents that cases of priority p0 need; without p0 among `priorities` they aren't asked for."""
    own = documents.select("doc_id").distinct().join(chunks.select("doc_id").distinct().withColumn("_has", F.lit(True)), "doc_id", "left")
    docs = own.agg(F.count("_has").alias("docs_with_chunks"), F.count_if(F.col("_has").isNull()).alias("orphans"))
    missing = gold_ids.join(documents.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("missing_gold"))
    if "p0" not in priorities:
        missing = missing.select(F.lit(0).cast("long").alias("missing_gold"))
    bad = chunk_errors(chunks, limit=None).agg(F.count("*").alias("incomplete"))
    ok = (F.col("orphans") == 0) & (F.col("missing_gold") == 0) & (F.col("incomplete") == 0)
    return docs.join(missing).join(bad).withColumn("ok", ok)  # one row each
