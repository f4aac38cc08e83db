"""Access filters as bitsets over the numbered members of an index's groups.

A group is what an index stores together: a range of documents (inverted) or a cell of vectors (cells). Its members have
slots, 0 and up. For each field, and each value that some member has there, a group has one mask: words of 64 bits, bit
slot % 64 of word slot // 64 set where the member has the value. Words without a bit are zeros, which Parquet's run
lengths store in next to nothing; values that no member has are no row.

A filter on several fields is the bitwise AND of their masks, group by group, where the masks lie. Groups without a bit
left are dropped before anything is bounded or read, and a scorer passes over the members whose bit isn't set: ids are
joined with metadata once, when the masks are built, and in no search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import written

FIELDS = ("team", "acl", "priority", "source_id")
WORD = 64


def masks(members: DataFrame, meta: DataFrame, group: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(field, value, group, mask) of members (group, ids: its members in the order of slots) by the columns `fields` of
    meta (id, ...).

    A null field is no value, and a member that meta doesn't know has none. Of rows of meta that repeat an id each
    counts. Values are compared as text. At most one row per group, field and word is ever put together."""
    slots = members.select(group, F.ceil(F.size("ids") / WORD).cast("int").alias("words"), F.posexplode("ids").alias("slot", "id"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    known = meta.select("id", pairs).select("id", "p.field", "p.value").where("value IS NOT NULL")
    bit = F.expr(f"shiftleft(1L, slot % {WORD})")
    words = slots.join(known, "id").groupBy(group, "words", "field", "value", F.expr(f"slot div {WORD}").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    full = words.groupBy(group, "words", "field", "value").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    mask = F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return full.select("field", "value", group, mask.alias("mask"))


def write_masks(rows: DataFrame, path: str) -> DataFrame:
    """Masks written to a folder in the order of fields and values, so a filter on them reaches the files' statistics; a
    value that all members have is spread over files like any other."""
    group = rows.columns[2]
    rows.repartitionByRange("field", "value", group).sortWithinPartitions("field", "value", group).write.mode("overwrite").parquet(path)
    return load_masks(rows.sparkSession, path)


def load_masks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def allowed(stored: DataFrame, **filters: str) -> DataFrame | None:
    """(group, mask) of the groups in which some member meets every filter given; None without filters (an empty string
    is none). A value or a field that no member has allows nothing."""
    wanted = {k: v for k, v in filters.items() if v}
    if not wanted:
        return None
    group = stored.columns[2]
    any_of = F.lit(False)
    for field, value in wanted.items():
        any_of = any_of | ((F.col("field") == field) & (F.col("value") == value))
    found = stored.where(any_of).groupBy(group).agg(F.collect_list("mask").alias("m")).where(F.size("m") == len(wanted))  # a mask for each filter
    mask = F.aggregate(F.slice("m", 2, len(wanted)), F.get("m", F.lit(0)), _both)
    return written(found.select(group, mask.alias("mask")).where(F.exists("mask", lambda x: x != 0)))


def allowed_counts(stored: DataFrame) -> DataFrame:
    """(field, value, n): how many members have each value."""
    bits = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    return stored.groupBy("field", "value").agg(F.sum(bits).alias("n"))
