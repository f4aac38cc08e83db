"""Reading catalogs, manifests, markdown files and tables of documents; writing tables, JSON lines and reports."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import content_hash, or_else, strip

CATALOG = "source_id string, name string, priority string, acl string, team string, doc_types array<string>, languages array<string>, location string, sample_doc_ids array<string>"
DOCUMENT = "doc_id string, source_id string, title string, path string, text string, language string, acl string, team string, priority string, doc_types array<string>, content_hash string, char_count long, updated_at string"
CHUNK = "chunk_id string, doc_id string, source_id string, chunk_index long, text string, heading_path array<string>, char_count long, acl string, team string, priority string, language string, content_hash string"
GOLD = "id string, question string, query_type string, expected_behavior string, relevant_doc_ids array<string>, primary_doc_id string, source_ids array<string>, source_priority string, reference_answer string, notes string, tags array<string>, language string"
MANIFEST = "version long, generated_at string, documents array<struct<id:string,title:string,source_id:string,path:string>>"
FRONTMATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)\z"


def flow_list(value: Column) -> Column:
    """`[a, "b"]` as a list; a scalar as a list of one; nothing as an empty list."""
    inner = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^\[|\]$", "")
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.filter(items, lambda x: x != "")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The `sources:` block of a YAML catalog: a `- id:` line starts a source, deeper `key: value` lines belong to it."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    rows = lines.selectExpr("n", "trim(regexp_replace(line, '(^|\\\\s)#.*$', '')) AS line", "line rlike '^\\\\S' AS top").orderBy("n").collect()  # a catalog is a small file
    out, own, inside = [], None, False
    for r in rows:
        if r["top"] and r["line"].endswith(":"):
            inside = r["line"] == "sources:"
            continue
        if not inside or ":" not in r["line"]:
            continue
        key, value = (x.strip().strip("\"'") for x in r["line"].split(":", 1))
        if key.startswith("- "):
            own, key = {}, key[2:].strip()
            out.append(own)
        if own is not None and value:
            own[key] = value
    many = {"doc_types", "languages", "sample_doc_ids"}
    flat = [tuple(o.get("id" if c == "source_id" else c) or o.get(c) for c in ("source_id", "name", "priority", "acl", "team", "doc_types", "languages", "location", "sample_doc_ids")) for o in out]
    df = spark.createDataFrame(flat, "source_id string, name string, priority string, acl string, team string, doc_types string, languages string, location string, sample_doc_ids string")
    return df.select(*[flow_list(F.col(c)).alias(c) if c in many else F.col(c) for c in df.columns])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("documents"))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(file, stem, raw, modified): every markdown file under root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    return files.select(F.col("path").alias("file"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), F.decode("content", "UTF-8").alias("raw"), F.date_format("modificationTime", "yyyy-MM-dd").alias("modified"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)


def frontmatter(raw: Column) -> tuple[Column, Column]:
    """(fields, body) of a markdown text: `key: value` lines between two `---` lines at the very start."""
    head = F.regexp_extract(raw, FRONTMATTER, 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: F.instr(x, ":") > 0)
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']|[\"']$", ""))
    body = strip(F.when(raw.rlike(FRONTMATTER), F.regexp_extract(raw, FRONTMATTER, 2)).otherwise(raw))
    return F.map_from_entries(F.transform(pairs, entry)), F.when(raw.rlike(FRONTMATTER) | (body != ""), F.concat(body, F.lit("\n"))).otherwise(body)


def build_documents(manifest: DataFrame, catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Documents of the catalogued sources, with an `error` column: missing file, or an id or source that disagrees.

    Access fields come from the catalog, never from the text. Title: frontmatter, first heading, id. Language:
    frontmatter, the source's first, `ru`."""
    meta = catalog.select("source_id", "acl", "team", "priority", "doc_types", "languages")
    rows = manifest.join(meta, "source_id").withColumn("stem", F.regexp_extract("path", r"([^/]+)\.md$", 1))
    at = files.withColumn("tail", F.regexp_extract("file", r"([^/]+/[^/]+\.md)$", 1)).select("tail", "raw", "modified")
    rows = rows.withColumn("tail", F.regexp_extract("path", r"([^/]+/[^/]+\.md)$", 1)).join(at, "tail", "left")
    fields, body = frontmatter(F.col("raw"))
    rows = rows.withColumns({"f": fields, "text": body})
    doc_id = or_else(F.col("f")["id"], F.col("stem"))
    error = F.when(F.col("raw").isNull(), "missing file").when(doc_id != F.col("stem"), "id mismatch").when(or_else(F.col("f")["source_id"], F.col("source_id")) != F.col("source_id"), "source mismatch")
    return rows.select(
        doc_id.alias("doc_id"), "source_id", or_else(F.col("f")["title"], strip(F.regexp_extract("text", r"(?m)^# (.*)$", 1)), doc_id).alias("title"), "path", "text",
        or_else(F.col("f")["language"], F.col("languages")[0], F.lit("ru")).alias("language"), "acl", "team", "priority", "doc_types", content_hash(F.col("text")).alias("content_hash"),
        F.length("text").cast("long").alias("char_count"), or_else(F.col("f")["updated_at"], F.col("modified")).alias("updated_at"), error.alias("error"),
    )


def document_paths(documents: DataFrame) -> DataFrame:
    """(doc_id, path), one row per document; the largest path where rows disagree."""
    return documents.groupBy("doc_id").agg(F.max("path").alias("path"))


def source_locations(catalog: DataFrame) -> DataFrame:
    """(source_id, location) of the sources that have one."""
    return catalog.where(or_else(F.col("location")).isNotNull()).select("source_id", "location")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, *keys: str) -> None:
    """A Parquet table, laid out by keys where given, so that readers skip files."""
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(path)


def report(df: DataFrame) -> str:
    """A one-row report as indented JSON."""
    return json.dumps(df.first().asDict(recursive=True), indent=2, ensure_ascii=False, default=str)


def gated_write(df: DataFrame, gate: DataFrame, path: str, skip_gate: bool = False) -> bool:
    """Write df if the gate's one row has ok, or regardless with skip_gate; whether the gate was passed."""
    ok = bool(gate.first()["ok"])
    if ok or skip_gate:
        write_table(df, path)
    return ok


def observed_write(df: DataFrame, path: str, metrics: dict[str, Column], passed: Callable[[dict], bool], keys: tuple[str, ...] = ()) -> tuple[bool, dict]:
    """Write df and measure it in the same pass; publish it at path only if its metrics pass. Returns (passed, metrics).

    metrics: aggregates over df's rows, without DISTINCT. Rows are written beside path and renamed into its place, so a
    table that fails its gate, or a job that fails, leaves what lies at path as it was."""
    spark, aside = df.sparkSession, f"{path}-{uuid.uuid4().hex}"
    seen = Observation()
    measured = df.observe(seen, *[c.alias(n) for n, c in metrics.items()])
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write_table(measured, aside, *keys)
        values = seen.get
        ok = bool(passed(values))
        if ok:
            files.delete(place(path), True)
            files.mkdirs(place(path).getParent())
            if not files.rename(place(aside), place(path)):
                raise OSError(f"{path} can't be published")
    finally:
        files.delete(place(aside), True)
    return ok, values


def chunk_metrics(fields: tuple[str, ...]) -> dict[str, Column]:
    """rows, chars, and incomplete: rows that lack one of the fields; for observed_write()."""
    lacks = functools.reduce(lambda a, b: a | b, [F.col(f).isNull() for f in fields])
    return {"rows": F.count(F.lit(1)), "incomplete": F.count_if(lacks), "chars": F.coalesce(F.sum(F.length("text")), F.lit(0))}
