"""Alignment of two tokenizers' tokens by their bytes, by divide and conquer at shared cuts.

Both tokenizers write the same bytes, a space and the text. A shared cut is a byte offset where a token of each ends. An
interval between two shared cuts is divided at a shared cut near its middle, found by bisecting one side's ends for ends
of the other side's, and both halves are treated alike; an interval without a cut inside is a group. The ends of a group
link its last token of A and its last token of B. All intervals of a chunk of texts are divided together, level by level.

Neither tokenizer has tokens that go on past a space, so every space between words is a shared cut that is known before
anything is encoded: the pieces between are aligned once for each distinct piece that a worker meets. Texts with runs of
white space are aligned as one interval.

Texts are encoded once. A task writes a block for each chunk of its documents: what needs no counts, and the links by
distinct piece. How often two ids are linked in the whole corpus is added up from the blocks, in tasks first and then by
pair of ids. The table of pairs is bounded by both vocabularies, not by documents. It reaches the workers as sorted
arrays, SEGMENT pairs at once; each further segment is one more pass over the blocks, and the passes are added up.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, written
from .wordcache import _ranges, cuttable

#: Pairs of ids that are sent to the workers at once: 64 MB.
SEGMENT = 4_000_000
#: Distinct pieces that one worker keeps aligned, and pairs that a task counts before it sends them on.
PIECES = 100_000
#: Pieces joined by their spaces and encoded at once.
AT_ONCE = 1000
ROWS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
BLOCK = "n_a array<long>, n_b array<long>, n_links array<long>, n_best array<long>, count_sum array<long>, sha array<string>, n_units binary, units binary, unit_links binary, links binary"


def shared_cuts(a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), rising, for each end that token i of a and token j of b share. a and b: where tokens end, rising.
    a_stop and b_stop: shared cuts known before, as numbers of tokens in front of them; the last one is the end of all."""
    a0, b0 = np.append(0, a_stop[:-1])[: len(a_stop)], np.append(0, b_stop[:-1])[: len(b_stop)]
    a1, b1, cuts = a_stop, b_stop, [np.stack([a_stop, b_stop]) - 1]
    while len(b0):
        # For each interval: ends of b inside it, from the middle one to both sides, until one is an end of a.
        middle = (b0 + b1 - 1) // 2
        i, j = np.full(len(b0), -1), np.full(len(b0), -1)
        open_, step = np.flatnonzero(b1 - b0 > 1), 0
        while len(open_):
            at = middle[open_] + (step + 1) // 2 * (1 if step % 2 else -1)
            inside = (at >= b0[open_]) & (at < b1[open_] - 1)
            end = b[np.where(inside, at, 0)]
            near = np.searchsorted(a, end)
            hit = inside & (a[near] == end) & (near < a1[open_] - 1)
            i[open_[hit]], j[open_[hit]] = near[hit], at[hit]
            step += 1
            open_ = open_[~hit & (step <= b1[open_] - b0[open_])]
        found = i >= 0
        i, j = i[found], j[found]
        cuts.append(np.stack([i, j]))
        a0, a1 = np.concatenate([a0[found], i + 1]), np.concatenate([i + 1, a1[found]])
        b0, b1 = np.concatenate([b0[found], j + 1]), np.concatenate([j + 1, b1[found]])
    i, j = np.sort(np.concatenate(cuts, axis=1), axis=1)  # both rise together
    return i, j


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level tokens and their bytes: printable ones are themselves, others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class _Side:
    """A tokenizer with the bytes of its tokens: `flat` holds them one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array(list(map(len, tokens)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.opens = np.array([t.startswith(b" ") for t in tokens])

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with a space in front, and how many each has."""
        each = self.encode(texts) if texts else []
        return np.fromiter((i for ids in each for i in ids), np.int64), np.array(list(map(len, each)), np.int64)

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces without white space at their ends: many make one text, in which a token that starts with
        a space starts a piece."""
        ids, _ = self.texts([" ".join(pieces[k : k + AT_ONCE]) for k in range(0, len(pieces), AT_ONCE)])
        return ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return _ranges(self.flat, self.start[ids], self.size[ids])


class ByteLevel(_Side):
    """A `tokenizers` byte-level file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        alphabet = byte_alphabet()
        tokens = [b""] * (max(self.tok.get_vocab().values()) + 1)
        for token, i in self.tok.get_vocab().items():
            tokens[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        super().__init__(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces(_Side):
    """A sentencepiece model, which puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i in ids for p in [self.model.id_to_piece(i)]])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


#: What stands for a space in sentencepiece models. A text that holds it has other bytes than its tokens.
SPACE = "\u2581"


class Units:
    """Pieces or whole texts: sizes has the tokens of a, of b, and the links of each (-1 where the tokens' bytes differ
    from the text's); links their pairs of ids, as a * width + b; groups their groups as text."""

    def __init__(self):
        self.sizes, self.links, self.groups = np.zeros((0, 3), np.int64), np.zeros(0, np.uint32), []

    def add(self, sizes: np.ndarray, links: np.ndarray, groups: list[bytes]) -> None:
        self.sizes, self.links = np.concatenate([self.sizes, sizes]), np.concatenate([self.links, links.astype(np.uint32)])
        self.groups += groups


class Aligner:
    """Both tokenizers, and the pieces that were aligned so far."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.width = len(self.b.size)
        if len(self.a.size) * self.width > 1 << 32:
            raise ValueError("pairs of ids need more than 32 bits")
        digits = [b"%d," % i for i in range(max(len(self.a.size), self.width))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.n_digits = np.array(list(map(len, digits)), np.int64)
        self.first_digit = np.cumsum(self.n_digits) - self.n_digits
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.kept = Units()

    def align(self, texts: list[str], whole: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Sizes, links and groups of texts. whole: texts are encoded one by one; else they are pieces."""
        sizes, groups = np.zeros((len(texts), 3), np.int64), [b""] * len(texts)
        sizes[:, 2] = -1
        own = np.array([k for k, t in enumerate(texts) if t and SPACE not in t], np.int64)
        some = [texts[k] for k in own.tolist()]
        (a, n_a), (b, n_b) = ((side.texts if whole else side.pieces)(some) for side in (self.a, self.b))
        want = np.array([len(t.encode()) + 1 for t in some], np.int64)
        raw = np.frombuffer("".join([" " + t for t in some]).encode(), np.uint8)
        of = np.arange(len(own))
        sound = np.ones(len(own), bool)
        for side, ids, n in ((self.a, a, n_a), (self.b, b, n_b)):
            sound &= np.bincount(np.repeat(of, n), side.size[ids], len(own)) == want
        for side, ids, n in ((self.a, a, n_a), (self.b, b, n_b)):
            same = side.bytes_of(ids[np.repeat(sound, n)]) == raw[np.repeat(sound, want)]
            good = np.flatnonzero(sound)
            sound[good[np.bincount(np.repeat(np.arange(len(good)), want[good]), ~same, len(good)) > 0]] = False
            # Unsound texts leave the other side's bytes as well before they are compared.
        own, a, b, n_a, n_b = own[sound], a[np.repeat(sound, n_a)], b[np.repeat(sound, n_b)], n_a[sound], n_b[sound]
        if not len(own):
            return sizes, np.zeros(0, np.int64), groups
        i, j = shared_cuts(np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b]), np.cumsum(n_a), np.cumsum(n_b))
        stop = np.searchsorted(i, np.cumsum(n_a) - 1) + 1  # groups up to each text's end
        sizes[own] = np.stack([n_a, n_b, np.diff(stop, prepend=0)], axis=1)
        # The text of all groups: tokens of a, tokens of b, group by group, each with the mark that follows it.
        line = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
        place_a, place_b = np.arange(len(a)) + np.append(0, j + 1)[group_a], np.arange(len(b)) + (i + 1)[group_b]
        line[place_a], line[place_b] = a, b
        size = self.n_digits[line]
        text, after = _ranges(self.digits, self.first_digit[line], size).copy(), np.cumsum(size) - 1
        text[after[place_a[i]]], text[after[place_b[j]]] = ord("|"), ord(";")
        ends, text = (after[place_b[j[stop - 1]]]).tolist(), text.tobytes()
        for k, begin, end in zip(own.tolist(), [0, *(e + 1 for e in ends)], ends, strict=False):
            groups[k] = text[begin:end]
        return sizes, a[i] * self.width + b[j], groups

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Units]:
        """The units of all texts, how many each text has, and what units are: the kept pieces and, after them, whole
        texts of this chunk. A null or empty text is one whole text, without tokens."""
        if len(self.kept.groups) > PIECES:
            self.forget()
        texts = pc.fill_null(texts, "")
        plain = cuttable(texts, []) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.kept.add(*self.align(new, False))
        out = self.kept
        if not plain.all():
            out = Units()
            out.add(self.kept.sizes, self.kept.links, self.kept.groups)
            out.add(*self.align(texts.filter(pa.array(~plain)).to_pylist(), True))
        count = np.ones(len(texts), np.int64)
        count[plain] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        unit, cut = np.empty(int(count.sum()), np.int64), np.repeat(plain, count)
        unit[cut] = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        unit[~cut] = len(self.number) + np.arange(int((~plain).sum()))
        return unit, count, out


@functools.lru_cache(maxsize=1)
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _per_text(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of `count` values each."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(count))])


def _block(aligner: Aligner, part: pa.RecordBatch) -> pa.RecordBatch:
    """One row for some documents: arrays over them; n_units and the units of each, numbered within the block; how many
    links each of the block's units has, and those links."""
    unit, count, units = aligner.units(part.column("_text"))
    sound = _per_text(units.sizes[unit, 2] < 0, count) == 0
    unit, count = unit[np.repeat(sound, count)], np.where(sound, count, 0)
    totals = [_per_text(units.sizes[unit, c], count) for c in range(3)]
    names, begin, digests = unit.tolist(), 0, []
    for n, ok in zip(count.tolist(), sound.tolist(), strict=True):
        digests.append(hashlib.sha256(b";".join([units.groups[u] for u in names[begin : begin + n]])).hexdigest() if ok else "")
        begin += n
    own, number = np.unique(unit, return_inverse=True)
    many = np.maximum(units.sizes[:, 2], 0)
    links = _ranges(units.links, (np.cumsum(many) - many)[own], many[own])
    raw = lambda x: [x.astype("<u4").tobytes()]
    lists = {"n_a": totals[0], "n_b": totals[1], "n_links": totals[2], "n_best": 0 * count, "count_sum": 0 * count, "sha": digests}
    return pa.RecordBatch.from_arrays(
        [*(pa.array([pa.array(v).to_pylist()]) for v in [part.column("_key"), *lists.values()]), *(pa.array(raw(x), pa.binary()) for x in (count, number, many[own], links))],
        names=["keys", *lists, "n_units", "units", "unit_links", "links"],
    )


def _encode(a: str, b: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "_text", 1 << 20):
                yield _block(_aligner(a, b), part).cast(schema)

    return run


def _opened(row: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_units, units, unit_links and links of a block."""
    return tuple(np.frombuffer(row.column(c)[k].as_py(), "<u4").astype(np.int64) for c in ("n_units", "units", "unit_links", "links"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of a task's blocks, added up."""
    total, times, held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(total), pa.array(times)], names=["pair", "n"])
    for batch in batches:
        for k in range(batch.num_rows):
            _, unit, many, links = _opened(batch, k)
            used = np.repeat(np.bincount(unit, minlength=len(many)), many)
            total, at = np.unique(np.concatenate([total, links]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, used]), len(total)).astype(np.int64)
            if len(total) > PIECES:
                yield rows()
                total, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield rows()


def _counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of all blocks."""
    pairs = written(blocks.select("units", "unit_links", "links", "n_units").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    most = pairs.groupBy((F.col("pair") % width).alias("b_id")).agg(F.max("n").alias("most"))
    return written(pairs.withColumn("b_id", F.col("pair") % width).join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _add(segment, schema: pa.Schema):
    """Blocks with the counts of one segment added to n_best and count_sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = segment.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                count, unit, many, links = _opened(row, 0)
                at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
                known = pair[at] == links if len(pair) else np.zeros(len(links), bool)
                for name, values in (("n_best", best), ("count_sum", n)):
                    own = _per_text(_per_text(np.where(known, values[at] if len(values) else 0, 0), many)[unit], count)
                    own += row.column(name)[0].values.to_numpy()
                    row = row.set_column(row.schema.get_field_index(name), name, pa.array([own.tolist()], pa.list_(pa.int64())))
                yield row.cast(schema)

    return run


def _segment(counts: DataFrame, number: int, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of `of` parts of the pairs, sorted."""
    own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(of)) == number).select("pair", "n", F.col("best").cast("long")).toPandas().sort_values("pair")
    return tuple(own[c].to_numpy(np.int64) for c in ("pair", "n", "best"))


def _blocks(docs: DataFrame, a: str, b: str, key: str, text: str) -> tuple[DataFrame, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(text).alias("_text"), F.col(key).alias("_key"))
    schema = f"keys array<{rows.schema['_key'].dataType.simpleString()}>, {BLOCK}"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    return written(rows.mapInArrow(_encode(a, b, arrow), schema)), arrow


def link_counts(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """(a_id, b_id, n, best): how often the corpus links these ids, and whether no other id of A is linked to b_id more
    often. One row per pair that is linked at all."""
    width = _aligner(a, b).width
    return _counts(_blocks(docs, a, b, text, text)[0], width).select((F.col("pair") / width).cast("long").alias("a_id"), (F.col("pair") % width).alias("b_id"), "n", "best")


def align_documents(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per row of docs: key, n_a and n_b (tokens), n_groups, n_links, n_best (links whose count is the highest of
    their id of B), count_sum (over links), groups_sha256 (of `a1,a2|b1;a3|b2,b3`).

    a: path of a byte-level `tokenizers` file; b: path of a sentencepiece model that puts a space in front; both at the
    same place on every worker. Null and empty texts, and those whose tokens' bytes on either side aren't a space and
    the text, have no tokens: zeros and an empty string. Repeated rows count as often as they occur; without documents
    there are no rows; other columns aren't read."""
    blocks, schema = _blocks(docs, a, b, key, text)
    counts = _counts(blocks, _aligner(a, b).width)
    parts = max(1, -(-counts.count() // segment))
    for i in range(parts):
        arrays = docs.sparkSession.sparkContext.broadcast(_segment(counts, i, parts))
        blocks = blocks.mapInArrow(_add(arrays, schema), blocks.schema)
        if i < parts - 1:
            blocks = written(blocks)  # a worker holds one segment at a time
    out = blocks.select(F.inline(F.arrays_zip("keys", "n_a", "n_b", "n_links", "n_best", "count_sum", "sha")))
    return out.select(F.col("keys").alias(key), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"))
