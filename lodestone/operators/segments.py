"""An index that takes changes: segments, tombstones, statistics as sums of deltas, and snapshots that are published whole.

    <path>/segments/<name>/documents   rows that one change added: id, content_hash, dl, terms, tfs and kept columns
    <path>/segments/<name>/dead        (segment, id): rows of older segments that the change replaced or deleted
    <path>/segments/<name>/deltas      (term, df): by how much the change moved each term's document frequency
    <path>/snapshots/<number>          one row per live segment: segment, place, rows, dead, words

A change writes a segment of its own and then a snapshot that lists it beside the older ones, whose files stay as they
are. A snapshot is written aside and renamed into its place, so a reader sees all of it or the one before; a reader keeps
the snapshot that it opened, whatever is published meanwhile. Two writers can't publish the same number: the later one
fails and starts anew from the newer snapshot. compact() writes live rows as one segment; collect_garbage() deletes what
no kept snapshot lists.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import content_hash, tokens
from lodestone.operators.retrieval import LexicalIndex, term_counts

SNAPSHOT = "segment string, place long, rows long, dead long, words long"
#: Dead rows up to which they are broadcast to the segments that hold them.
FEW_DEAD = 1_000_000


class Conflict(RuntimeError):
    """Another writer published the snapshot number that this change was about to take."""


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system and path of a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published snapshots, rising."""
    files, place = _folder(spark, f"{path}/snapshots")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n) for n in names if n.isdigit())


@dataclass
class Snapshot:
    """One state of the index: its number (0 before the first change) and its segments."""

    spark: SparkSession
    path: str
    number: int
    segments: DataFrame

    def _tables(self, name: str) -> DataFrame | None:
        """One of the tables of all live segments, with `segment`; None without segments."""
        names = [r.segment for r in self.segments.orderBy("place").collect()]
        if not names:
            return None
        return self.spark.read.option("basePath", f"{self.path}/segments").parquet(*[f"{self.path}/segments/segment={n}/{name}" for n in names])

    def documents(self) -> DataFrame | None:
        """Live rows, with the segment that holds each. Rows of segments without dead rows pass no join."""
        rows, dead = self._tables("documents"), self._tables("dead")
        if rows is None:
            return None
        n = self.segments.agg(F.sum("dead").alias("n")).first()["n"]
        if not n:
            return rows
        dead = dead.select(F.col("of").alias("segment"), "id")
        return rows.join(F.broadcast(dead) if n <= FEW_DEAD else dead, ["segment", "id"], "left_anti")

    def lexical(self) -> LexicalIndex | None:
        """The index as retrieval and inverted take it. Statistics come from the deltas and the snapshot alone."""
        docs = self.documents()
        if docs is None:
            return None
        terms = self._tables("deltas").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        live = F.sum(F.col("rows") - F.col("dead"))
        stats = self.segments.agg(live.alias("n"), F.when(live > 0, F.sum("words") / live).otherwise(0.0).alias("avgdl"))
        return LexicalIndex(docs.select("id", "dl", "terms", "tfs"), terms, stats)


def open_snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot:
    """The newest snapshot, or an older one that is kept. What is published later doesn't change it."""
    known = snapshots(spark, path)
    number = (known[-1] if known else 0) if number is None else number
    if number and number not in known:
        raise ValueError(f"no snapshot {number}")
    rows = spark.read.schema(SNAPSHOT).parquet(f"{path}/snapshots/{number}") if number else spark.createDataFrame([], SNAPSHOT)
    return Snapshot(spark, path, number, rows)


def _name() -> str:
    """A new segment's name: never one that reads as a number."""
    return f"s{uuid.uuid4().hex}"


def _publish(old: Snapshot, rows: DataFrame) -> Snapshot:
    """Write rows as the snapshot after old: aside first, then renamed."""
    spark, number = old.spark, old.number + 1
    aside = f"{old.path}/aside-{uuid.uuid4().hex}"
    rows.select(*[f.split()[0] for f in SNAPSHOT.split(", ")]).coalesce(1).write.parquet(aside)
    (files, place), source = _folder(spark, f"{old.path}/snapshots/{number}"), _folder(spark, aside)[1]
    files.mkdirs(place.getParent())
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    try:  # a rename that fails where the name is taken; FileSystem.rename() would move into it
        hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(source), files.makeQualified(place), gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as e:
        files.delete(source, True)
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        raise Conflict(f"snapshot {number} is there") from None
    return open_snapshot(spark, old.path, number)


def _write(old: Snapshot, name: str, table: str, df: DataFrame) -> DataFrame:
    place = f"{old.path}/segments/segment={name}/{table}"
    df.write.parquet(place)
    return old.spark.read.schema(df.schema).parquet(place)


def apply_changes(spark: SparkSession, path: str, changed: DataFrame, deleted: DataFrame | None = None, text: str = "text", keep: tuple[str, ...] = ()) -> Snapshot:
    """Publish a snapshot with these rows (id, text, `keep`) added or replaced and these ids deleted.

    A row whose id and content hash are live already is unchanged: it isn't written, and its columns stay as they were.
    Of rows that repeat an id in one change, the one with the smallest content hash counts; ids that are both changed and
    deleted are changed; null ids are left out; a null text is empty. Unchanged segments keep their files."""
    old = open_snapshot(spark, path)
    rows = changed.where("id IS NOT NULL").select("id", *keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("content_hash", content_hash(F.col("_text")))
    first = rows.groupBy("id").agg(F.min("content_hash").alias("content_hash"))
    rows = rows.join(first, ["id", "content_hash"], "left_semi").dropDuplicates(["id"])
    live = old.documents()
    if live is not None:
        held = live.select("segment", "id", F.col("content_hash").alias("held"))
        rows = rows.join(held.select("id", F.col("held").alias("content_hash")), ["id", "content_hash"], "left_anti")
    counts = rows.withColumn("c", term_counts(F.sort_array(tokens(F.col("_text"))))).select("id", "content_hash", "c.dl", "c.terms", "c.tfs", *keep)
    name = _name()
    own = _write(old, name, "documents", counts)
    gone = own.select("id")
    if deleted is not None:
        kept = changed.select("id").where("id IS NOT NULL")
        gone = gone.unionByName(deleted.select("id").distinct().join(kept, "id", "left_anti"))
    lost = spark.createDataFrame([], f"of string, {own.select('id').schema.simpleString()[7:-1].replace(':', ' ')}") if live is None else held.join(gone, "id", "left_semi").select(F.col("segment").alias("of"), "id")
    dead = _write(old, name, "dead", lost)
    moved = own.select(F.explode("terms").alias("term"), F.lit(1).alias("by"))
    if live is not None:
        was = live.join(dead.select(F.col("of").alias("segment"), "id"), ["segment", "id"], "left_semi")
        moved = moved.unionByName(was.select(F.explode("terms").alias("term"), F.lit(-1).alias("by")))
        minus = was.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("n")).first()["n"]
    _write(old, name, "deltas", moved.groupBy("term").agg(F.sum("by").alias("df")).where("df <> 0"))
    size = own.agg(F.count("*").alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("words")).first()
    if not size["rows"] and not dead.limit(1).count():
        return old  # nothing changed
    entry = [(name, old.number, size["rows"], dead.count(), size["words"] - (minus if live is not None else 0))]
    return _publish(old, old.segments.unionByName(spark.createDataFrame(entry, SNAPSHOT)))


def compact(spark: SparkSession, path: str) -> Snapshot:
    """Publish a snapshot with all live rows in one segment. Older snapshots stay readable."""
    old = open_snapshot(spark, path)
    live, index = old.documents(), old.lexical()
    if live is None:
        return old
    name = _name()
    own = _write(old, name, "documents", live.drop("segment"))
    _write(old, name, "dead", old._tables("dead").drop("segment").limit(0))
    _write(old, name, "deltas", index.terms)
    size = own.agg(F.count("*").alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("words")).first()
    return _publish(old, spark.createDataFrame([(name, old.number, size["rows"], 0, size["words"])], SNAPSHOT))


def collect_garbage(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all but the newest `keep` snapshots, and the segments that none of those lists; returns their names. No
    writer may be at work, since its segment isn't listed yet."""
    known = snapshots(spark, path)
    used = {r.segment for n in known[-keep:] for r in open_snapshot(spark, path, n).segments.collect()}
    files, place = _folder(spark, f"{path}/segments")
    names = [s.getPath().getName().removeprefix("segment=") for s in files.listStatus(place)] if files.exists(place) else []
    for n in known[:-keep]:
        files.delete(_folder(spark, f"{path}/snapshots/{n}")[1], True)
    gone = sorted(n for n in names if n not in used)
    for n in gone:
        files.delete(_folder(spark, f"{path}/segments/segment={n}")[1], True)
    return gone
