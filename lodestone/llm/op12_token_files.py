"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, cut into blocks of BLOCK ids. A block stores its minimum, the differences
from it in the low `width` bits of each, packed 32 at a time, and an exception list (place and remaining high bits) for
differences that need more. width is the bit length of that percentile of the block's differences which makes the
block smallest. All numbers are little-endian:

    head       magic (8 bytes)
    blocks     each: minimum u32, width u8, unused u8, exceptions u16; packed words u32; places u16, high bits u32
    index      u64 place of each block's start, and of the last one's end
    documents  Arrow stream (key, n_tokens), in order
    tail       u64: ids, ids a block, place of the index, place of the documents; magic (8 bytes)

The index lets a reader fetch any range of ids by the blocks that hold it.

Documents are dealt by ranges of (key, number of the row), so files follow one another in ascending key order and a key
that many rows share is spread over files. Each task encodes its range and writes one file in the shared folder, under
a name of its own; a written manifest lists the files of the tasks that succeeded, so a task that is run again leaves
at most a file that nothing names. Files are read back each by a task; where a file's first document starts is summed
over the manifest, which has one row per file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_chunks, shared_dir
from .wordcache import PieceIds

MAGIC = b"PFORIDS1"
BLOCK = 1024  # ids; a multiple of 32 * 32
PERCENTILES = (0.75, 0.9, 0.95, 0.98, 0.99, 1.0)
#: Blocks that are packed or unpacked at once.
GROUP = 512
MANIFEST = "part int, file string, n_documents long, n_tokens long"
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("unused", "u1"), ("exceptions", "<u2")])
_encoders: dict[str, PieceIds] = {}


def _shifts(width: int) -> Iterator[tuple[int, int, int]]:
    """For each of 32 values: its number, the word where its lowest bit goes, and that bit."""
    for j in range(32 if width else 0):
        yield j, j * width >> 5, j * width & 31


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks of differences (blocks, BLOCK) in `width` bits each: (blocks, words)."""
    lanes = values.reshape(len(values), 32, -1)
    out = np.zeros((len(values), width, lanes.shape[2]), np.uint32)
    for j, word, bit in _shifts(width):
        out[:, word] |= lanes[:, j] << np.uint32(bit)
        if bit + width > 32:
            out[:, word + 1] |= lanes[:, j] >> np.uint32(32 - bit)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int, block: int) -> np.ndarray:
    lanes = words.reshape(len(words), width, block // 32)
    out = np.zeros((len(words), 32, block // 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for j, word, bit in _shifts(width):
        out[:, j] = lanes[:, word] >> np.uint32(bit)
        if bit + width > 32:
            out[:, j] |= lanes[:, word + 1] << np.uint32(32 - bit)
    return out.reshape(len(words), -1) & mask


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of whole numbers below 2^32."""
    return np.frexp(x.astype(np.float64))[1]


def encode_blocks(ids: np.ndarray, percentiles: tuple[float, ...] = PERCENTILES) -> list[bytes]:
    """Whole blocks of uint32 ids as bytes; the last one may be shorter and is filled up with its smallest id."""
    short = -len(ids) % BLOCK
    blocks = np.append(ids, np.full(short, ids[-(len(ids) % BLOCK) :].min() if short else 0, np.uint32)).astype(np.uint32).reshape(-1, BLOCK)
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    ranked = np.sort(rest, axis=1)
    widths = np.stack([_bits(ranked[:, int(np.ceil(p * BLOCK)) - 1]) for p in percentiles])
    over = np.stack([(rest >> np.minimum(w, 31)[:, None].astype(np.uint32) > 0).sum(axis=1) * (w < 32) for w in widths])
    best = np.argmin(widths * (BLOCK // 8) + over * 6, axis=0)
    width = widths[best, np.arange(len(blocks))]
    packed: list[bytes] = [b""] * len(blocks)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        words = _pack(rest[own] & np.uint32((1 << w) - 1), w)
        for i, row in zip(own.tolist(), words, strict=True):
            packed[i] = row.astype("<u4").tobytes()
    high = np.where(width[:, None] < 32, rest >> np.minimum(width, 31)[:, None].astype(np.uint32), 0)
    row, place = np.nonzero(high)
    value, cut = high[row, place], np.searchsorted(row, np.arange(len(blocks) + 1))
    head = np.zeros(len(blocks), _HEAD)
    head["low"], head["width"], head["exceptions"] = low, width, np.diff(cut)
    heads = head.tobytes()
    return [
        heads[8 * i : 8 * i + 8] + packed[i] + place[a:b].astype("<u2").tobytes() + value[a:b].astype("<u4").tobytes()
        for i, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False))
    ]


def decode_blocks(raw: memoryview, cuts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Ids of the blocks that lie at cuts[i] to cuts[i + 1] of raw."""
    begin = [int(c) for c in cuts[:-1]]
    head = np.frombuffer(b"".join(raw[a : a + 8] for a in begin), _HEAD)
    out = np.zeros((len(begin), block), np.uint32)
    for w in np.unique(head["width"]).tolist():
        own = np.flatnonzero(head["width"] == w)
        size = w * block // 8
        words = np.frombuffer(b"".join(raw[begin[i] + 8 : begin[i] + 8 + size] for i in own.tolist()), "<u4").reshape(len(own), -1)
        if w:
            out[own] = _unpack(words, w, block)
    for i in np.flatnonzero(head["exceptions"]).tolist():
        n, at = int(head["exceptions"][i]), begin[i] + 8 + int(head["width"][i]) * block // 8
        place = np.frombuffer(raw, "<u2", n, at)
        out[i, place] |= np.frombuffer(raw, "<u4", n, at + 2 * n) << np.uint32(head["width"][i])
    return (out + head["low"][:, None]).reshape(-1)


class Writer:
    """One file: documents are added in order; ids leave memory a group of blocks at a time."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.place, self.starts, self.waiting, self.held, self.n = out, 0, [], [], 0, 0
        self.documents: list[pa.RecordBatch] = []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.place += len(raw)

    def _flush(self, keep: int) -> None:
        """Pack what waits, but for the last `keep` ids."""
        ids = np.concatenate(self.waiting)
        whole = len(ids) - keep
        for a in range(0, whole, GROUP * BLOCK):
            for raw in encode_blocks(ids[a : min(whole, a + GROUP * BLOCK)]):
                self.starts.append(self.place)
                self._put(raw)
        self.waiting, self.held = [ids[whole:]], keep

    def add(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents with these keys; ids of all, one after the other, and how many each has."""
        self.documents.append(pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64())], names=["key", "n_tokens"]))
        self.waiting.append(ids.astype(np.uint32))
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= GROUP * BLOCK:
            self._flush(self.held % BLOCK)

    def close(self) -> None:
        if self.held:
            self._flush(0)
        index = self.place
        self._put(np.array([*self.starts, index], "<u8").tobytes())
        documents, sink = self.place, pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.documents[0].schema) as stream:
            for batch in self.documents:
                stream.write_batch(batch)
        self._put(sink.getvalue().to_pybytes())
        self._put(np.array([self.n, BLOCK, index, documents], "<u8").tobytes() + MAGIC)
        self.out.close()


class Reader:
    """One file: its documents, and any range of its ids."""

    def __init__(self, path: str):
        store, name = pafs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(40, size - 40)
        if tail[32:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.n, self.block, index, self.at = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        self.index = np.frombuffer(self.file.read_at(self.at - index, index), "<u8").astype(np.int64)
        self.until = size - 40

    def documents(self) -> pa.Table:
        """(key, n_tokens) in order."""
        return pa.ipc.open_stream(self.file.read_at(self.until - self.at, self.at)).read_all()

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop - 1 of the file; only the blocks that hold them are read."""
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        cuts = self.index[first : last + 1]
        raw = memoryview(self.file.read_at(int(cuts[-1] - cuts[0]), int(cuts[0])))
        return decode_blocks(raw, cuts - cuts[0], self.block)[start - first * self.block : stop - first * self.block]


def _write(folder: str, tokenizer: str, close: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = PieceIds(tokenizer)
        writer, rows, name = None, 0, f"{folder}/{uuid.uuid4().hex}.pfor"
        for batch in batches:
            for part in byte_chunks(batch, "_text", 2 << 20):
                if writer is None:
                    store, path = pafs.FileSystem.from_uri(name)
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    writer = Writer(store.open_output_stream(path))
                ids, sizes = _encoders[tokenizer].of(part.column("_text"), close)
                writer.add(part.column("_key"), ids, sizes)
                rows += part.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "n_documents": [rows], "n_tokens": [writer.n]})

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", close: int = 2, files: int | None = None) -> DataFrame:
    """The ids of docs in ascending key order, written as files under `folder`; returns the manifest, one row per file:
    part (files in order), file, n_documents, n_tokens.

    folder: an address that all machines share and Arrow can open (file:, hdfs:, s3:, gs:). A document is its ids and
    then `close`; a null text is empty; null keys come first; equal keys follow one another in the order of their rows.
    files: how many; None lets the session's shuffle partitions say. Without documents there are no files."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*([files] if files else []), "_key", "_row").sortWithinPartitions("_key", "_row")
    dealt.mapInArrow(_write(f"{folder}/data", tokenizer, close), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return load_manifest(spark, folder)


def load_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            reader = Reader(name)
            at, left = 0, []
            for keys in reader.documents().to_batches():
                sizes = keys.column("n_tokens").to_numpy()
                ends = at + np.cumsum(sizes)
                # Ids come a group of blocks at a time; a document's crc goes on from one group to the next.
                crcs = []
                for first, last in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                    crc = 0
                    while first < last:
                        if not left or first >= left[1]:
                            a = first // (GROUP * reader.block) * GROUP * reader.block
                            ids = reader.ids(a, a + GROUP * reader.block)
                            left = [a, a + len(ids), memoryview(ids.astype("<u4")).cast("B")]
                        until = min(last, left[1])
                        crc = zlib.crc32(left[2][4 * (first - left[0]) : 4 * (until - left[0])], crc)
                        first = until
                    crcs.append(crc)
                yield pa.RecordBatch.from_arrays([keys.column("key"), pa.array(start + ends - sizes, pa.int64()), keys.column("n_tokens"), pa.array(crcs, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])
                at = int(ends[-1]) if len(ends) else at


def read_documents(manifest: DataFrame, key_type: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), n_tokens and ids_crc32 of every document, from the files alone."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("start"))
    dealt = files.repartition(max(1, manifest.count()))
    return dealt.mapInArrow(_read, f"key {key_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", close: int = 2) -> DataFrame:
    """write_tokens(), and what read_documents() finds in its files. folder: None takes a new one in the shared folder."""
    manifest = write_tokens(docs, tokenizer, folder or shared_dir(docs.sparkSession), key, text, close)
    return read_documents(manifest, docs.select(F.col(key)).schema[0].dataType.simpleString(), key)
