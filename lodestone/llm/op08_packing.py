"""Packing tokenised documents into sequences by bounded-space online best-fit.

Pieces arrive one by one. Open bins are keyed by their free space in the bits of one integer: the best fit for a
length is the lowest set bit at or above it. When more than `open_bins` are open, the fullest closes. Documents are
dealt by hash to shards of about SHARD_PIECES pieces; each shard is packed by one task and wastes at most the free
space of its last open bins, whatever the size of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, written
from .wordcache import WordIds

CAPACITY = 2048
OPEN_BINS = 256
SHARD_PIECES = 20_000
PIECES = "piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, WordIds] = {}


def pack(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """For lengths in order of arrival (1 to capacity each): the bin and the place in it of each."""
    bins, places, free_bits, n_open, count = [], [], 0, 0, 0
    at: dict[int, list[int]] = {}
    for length in lengths:
        fit = free_bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            own = at[free].pop()
            if not at[free]:
                free_bits ^= 1 << free
            n_open -= 1
        else:
            own, free, count = count, capacity, count + 1
        bins.append(own)
        places.append(capacity - free)
        left = free - length
        if left:
            at.setdefault(left, []).append(own)
            free_bits |= 1 << left
            n_open += 1
            if n_open > open_bins:
                low = (free_bits & -free_bits).bit_length() - 1
                at[low].pop()
                if not at[low]:
                    free_bits ^= 1 << low
                n_open -= 1
    return bins, places


def _pieces(path: str, close: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        for batch in batches:
            for part in byte_chunks(batch, "_text", 2 << 20):
                ids, sizes = _encoders[path].of(part.column("_text"), close)
                raw, base = memoryview(ids.astype("<u4")).cast("B"), 0
                row, start, length, crc = [], [], [], []
                for i, n in enumerate(sizes.tolist()):
                    for s in range(0, n, capacity):
                        m = min(capacity, n - s)
                        row.append(i)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(raw[4 * (base + s) : 4 * (base + s + m)]))
                    base += n
                start = np.array(start, np.int64)
                kept = part.select(range(1, part.num_columns)).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(start // capacity, pa.int32()), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[*kept.schema.names, "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", close: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, ids_crc32 for each piece of at most `capacity` ids; a null text is empty.

    A document is its ids and then the id `close`, so every document has at least one piece."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(F.col(text).alias("_text"), F.col(key).alias(key)).mapInArrow(_pieces(tokenizer, close, capacity), f"`{key}` {kind}, {PIECES}")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", close: int = 0, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """pieces() with sequence_id and offset: no sequence is longer than `capacity`, and none has gaps.

    Repeated documents and repeated keys are packed as often as they occur. Pieces are written, and numbered by their
    places in the written table; they are dealt and arrive in the order of a hash of that number, so rows that repeat
    spread like others, and a task that is run again packs alike. No two pieces tie. Empty input gives no rows."""
    cut = written(pieces(docs, tokenizer, key, text, close, capacity))
    shards = max(1, -(-cut.count() // SHARD_PIECES))
    kind = cut.schema[key].dataType.simpleString()
    mixed = F.xxhash64(F.monotonically_increasing_id())

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order", kind="stable")
        bins, places = pack(rows["length"].tolist(), capacity, open_bins)
        rows["sequence_id"] = np.array(bins, np.int64) * shards + rows["shard"]
        rows["offset"] = np.array(places, np.int64)
        return rows[[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = cut.withColumn("order", mixed).withColumn("shard", F.pmod("order", F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInPandas(one, f"`{key}` {kind}, {PIECES}, sequence_id long, offset long")
