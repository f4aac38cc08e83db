"""Scoring texts with an n-gram model held in a log-frequency Bloom filter.

Texts are tokenised once into blocks: the block's distinct tokens as sorted 64-bit hashes, and each text as numbers
into them. Exact unigram counts are summed over blocks in shards of the hash space, each block sending each distinct
token once, and go back to the blocks in the same packed form. Bigrams of the learning texts are counted likewise.

The filter holds quantised counts: an n-gram of count c enters with every level from 0 to floor(log_BASE(c)), and its
count is read by probing rising levels until one is missing. It is never in one place: each shard of the bigrams' hash
space builds its own part, ENTRY_BITS for each entry, probes it for the bigrams of every block, held-out texts too, and
sends the levels back. So the filter grows with the corpus, without a ceiling, and its parts don't grow. A level stands
for the least count that has it, so what is read is never above the true count, false positives aside. Unigrams' exact
counts are at hand in each block. The model draws each context's bigrams towards the unigrams:
P(w | v) = (q(v w) + PRIOR * P(w)) / (c(v) + PRIOR), with P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) and q the count read
from the filter. For every v, known or not, the sum over all learned words and one for all others is at most 1.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, written

#: With so many bits an entry, 1 of 5,000 absent n-grams reads as held.
ENTRY_BITS, PROBES, BASE = 32, 4, 1.5
SEGMENTS = 64
#: So many occurrences of a context weigh as much as the unigrams. On held-out texts of 10,000 documents a token has
#: -4.28 (log10) under unigrams, -3.80 with 12 and -3.69 with 128, the best; but 128 hides the pairs of small corpora.
PRIOR = 12
BLOCK_BYTES = 8 << 20
#: Entries of packed arrays that one shard sums, and bits of a bigram's hash inside its shard.
SHARD_ENTRIES, SHARD_BITS = 2 << 20, 40
_NO_ID = -(1 << 63)  # stands for a null key
END = b"\n"  # no word holds white space
_K = np.random.default_rng(11).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _K[0]
    h = (h ^ (h >> np.uint64(29))) * _K[1]
    return h ^ (h >> np.uint64(32))


def level_of(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(c, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


#: What a level stands for: the least whole number that has it.
COUNT_AT = np.ceil(BASE ** np.arange(64) - 1e-9)


def quantised(held: np.ndarray) -> np.ndarray:
    """The count that a level stands for, of levels plus one; 0 for 0."""
    return np.append(0.0, COUNT_AT)[held]


def smoothed(pair: np.ndarray, before: np.ndarray, own: np.ndarray, below: float) -> np.ndarray:
    """P(w | v) from the count of v w that the filter gives, the exact counts of v and w, and N + 0.1 (V + 1)."""
    return (np.minimum(pair, np.minimum(before, own)) + PRIOR * (own + 0.1) / below) / (before + PRIOR)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_chunks(batch, "text", BLOCK_BYTES):
            number: dict[bytes, int] = {END: 0}
            docs, ends, n = [], [], 0
            for text in part.column("text").to_pylist():
                words = text.lower().split() if text else []
                docs.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
                docs.append(np.zeros(1, np.uint32))
                n += len(words) + 1
                ends.append(n)
            words = np.concatenate(docs)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            words, ends = place[words], np.array(ends, np.int64)
            held = np.asarray(part.column("held").to_pylist(), bool)
            learn = np.repeat(~held, np.diff(ends, prepend=0))
            counts = np.bincount(words[learn], minlength=len(order)).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([int.from_bytes(os.urandom(8), "little") >> 1], pa.int64()),
                "ids": pa.array([np.asarray(part.column("id").fill_null(_NO_ID)).tobytes()], pa.binary()),
                "held": pa.array([held.tobytes()], pa.binary()),
                "ends": pa.array([ends.tobytes()], pa.binary()),
                "words": pa.array([_pack(words)], pa.binary()),
                "hashes": pa.array([hashes[order].tobytes()], pa.binary()),
                "counts": pa.array([_pack(counts)], pa.binary()),
                "types": pa.array([len(order)], pa.int64()),
                "tokens": pa.array([len(words)], pa.int64()),
            })


BLOCKS = "block long, ids binary, held binary, ends binary, words binary, hashes binary, counts binary, types long, tokens long"


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the 2^bits equal ranges of the hash space start in sorted keys."""
    bounds = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def _deal_unigrams(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = np.frombuffer(r["hashes"], np.uint64), _unpack(r["counts"], np.uint32)
                cut = _cuts(keys, bits)
                at = np.flatnonzero(np.diff(cut)).tolist()  # never more rows than tokens, however many shards
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(at, pa.int32()), "block": pa.array([r["block"]] * len(at), pa.int64()),
                    "keys": pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in at], pa.binary()), "n": pa.array([_pack(counts[cut[i] : cut[i + 1]]) for i in at], pa.binary()),
                })

    return run


def _sum_unigrams(t: pa.Table) -> pa.Table:
    """For each block its tokens' counts in the corpus, and once (block -1) how many types and tokens the shard has learned."""
    blocks, shard = t.column("block").to_pylist(), t.column("shard")[0].as_py()
    keys = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
    n = np.concatenate([_unpack(x, np.uint32) for x in t.column("n").to_pylist()]).astype(np.int64)
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, n, len(every)).astype(np.int64)
    out = np.split(total[back], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({
        "shard": pa.array([shard] * (len(blocks) + 1), pa.int32()), "block": pa.array([*blocks, -1], pa.int64()),
        "n": pa.array([*map(_pack, out), None], pa.binary()),
        "types": pa.array([0] * len(blocks) + [int((total > 0).sum())], pa.int64()), "tokens": pa.array([0] * len(blocks) + [int(total.sum())], pa.int64()),
    })


def _before(words: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    """The token before each token; a text starts after an end."""
    v = np.concatenate([[end], words[:-1]])
    v[ends[:-1]] = end
    return v


def bigram_keys(hv: np.ndarray, hw: np.ndarray, bits: int) -> np.ndarray:
    return _mix(_mix(hv) * _K[2] + hw * _K[3]) & ~np.uint64((1 << (64 - bits - SHARD_BITS)) - 1)


_END_HASH = np.uint64(xxhash.xxh64_intdigest(END))


def _pairs(r: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct bigrams in order, the one at each token, and the token before each token."""
    hashes, words, ends = np.frombuffer(r["hashes"], np.uint64), _unpack(r["words"], np.uint32), np.frombuffer(r["ends"], np.int64)
    v = _before(words, ends, int(np.searchsorted(hashes, _END_HASH)))
    pair, at = np.unique(v.astype(np.uint64) << np.uint64(32) | words, return_inverse=True)
    pv, pw = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keys, back = np.unique(bigram_keys(hashes[pv], hashes[pw], bits), return_inverse=True)
    return keys, back[at], v


def _deal_bigrams(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, at, _ = _pairs(r, bits)
                learn = np.repeat(~np.frombuffer(r["held"], bool), np.diff(np.frombuffer(r["ends"], np.int64), prepend=0))
                n = np.bincount(at[learn], minlength=len(keys)).astype(np.uint32)
                cut = _cuts(keys, bits)
                full = np.flatnonzero(np.diff(cut)).tolist()
                # Five bytes say where a key lies in its shard.
                small = (keys >> np.uint64(64 - bits - SHARD_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SHARD_BITS // 8]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(full, pa.int32()), "block": pa.array([r["block"]] * len(full), pa.int64()),
                    "keys": pa.array([small[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()), "n": pa.array([_pack(n[cut[i] : cut[i + 1]]) for i in full], pa.binary()),
                })

    return run


def _sum_bigrams(bits: int):
    """For each block the levels of its bigrams, read from the shard's part of the filter: 0 where it isn't held."""

    def run(t: pa.Table) -> pa.Table:
        shard, dealt = t.column("shard")[0].as_py(), t.column("keys").to_pylist()
        small = np.frombuffer(b"".join(dealt), np.uint8).reshape(-1, SHARD_BITS // 8)
        wide = np.zeros((len(small), 8), np.uint8)
        wide[:, : SHARD_BITS // 8] = small
        base = np.uint64(shard << (64 - bits)) if bits else np.uint64(0)
        keys = (wide.view("<u8").reshape(-1) << np.uint64(64 - bits - SHARD_BITS)) | base
        n = np.concatenate([_unpack(x, np.uint32) for x in t.column("n").to_pylist()])
        every, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back, n, len(every)).astype(np.int64)
        learned = total > 0
        level = build_filter(every[learned], total[learned]).levels(every)
        out = np.split((level + 1).astype(np.uint8)[back], np.cumsum([len(x) // (SHARD_BITS // 8) for x in dealt])[:-1])
        return pa.table({"shard": t.column("shard"), "block": t.column("block"), "level": pa.array([_pack(x) for x in out], pa.binary())})

    return run


class Filter:
    """The log-frequency filter: SEGMENTS equal parts of a bit array, by the top bits of an n-gram's hash."""

    def __init__(self, bits_per_segment: int, data: np.ndarray):
        self.m, self.data = bits_per_segment, data  # (SEGMENTS, bits_per_segment / 8)

    @staticmethod
    def place(keys: np.ndarray, level: int, probe: int, m: int) -> np.ndarray:
        salt = (level * PROBES + probe + 1) * int(_K[4]) % (1 << 64)
        return _mix(keys + np.uint64(salt)) % np.uint64(m)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key; 0 where it isn't held."""
        level = self.levels(keys)
        return np.where(level >= 0, COUNT_AT[level], 0.0)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key; -1 where it isn't held."""
        level = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for lv in range(64):
            for p in range(PROBES):  # most absent n-grams miss at their first bits
                left = left[self._has(keys[left], lv, p)]
            if not len(left):
                break
            level[left] = lv
        return level

    def _has(self, keys: np.ndarray, level: int, probe: int) -> np.ndarray:
        p = self.place(keys, level, probe, self.m)
        seg = (keys >> np.uint64(58)).astype(np.int64)
        return (self.data[seg, (p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def unigram_keys(hashes: np.ndarray) -> np.ndarray:
    return _mix(hashes * _K[6])


def _deal_to_segments(least: int, unigrams: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist(), strict=True):
                keys, n = np.frombuffer(keys, np.uint64), _unpack(n, np.int64)
                keys = unigram_keys(keys) if unigrams else keys
                lv = level_of(n)
                keys, lv = keys[lv >= least], lv[lv >= least]
                seg = (keys >> np.uint64(58)).astype(np.int64)
                order = np.argsort(seg, kind="stable")
                cut = np.searchsorted(seg[order], np.arange(SEGMENTS + 1))
                keys, lv = keys[order], lv[order].astype(np.uint8)
                at = [i for i in range(SEGMENTS) if cut[i + 1] > cut[i]]
                yield pa.RecordBatch.from_pydict({"segment": pa.array(at, pa.int32()), "keys": pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in at], pa.binary()), "lv": pa.array([lv[cut[i] : cut[i + 1]].tobytes() for i in at], pa.binary())})

    return run


def _fill(m: int):
    def run(t: pa.Table) -> pa.Table:
        bits = np.zeros(m, np.uint8)
        for keys, lv in zip(t.column("keys").to_pylist(), t.column("lv").to_pylist(), strict=True):
            keys, lv = np.frombuffer(keys, np.uint64), np.frombuffer(lv, np.uint8)
            for x in range(int(lv.max(initial=0)) + 1):
                for i in range(PROBES):
                    bits[Filter.place(keys[lv >= x], x, i, m).astype(np.int64)] = 1
        return pa.table({"segment": pa.array([t.column("segment")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


def build_filter(keys: np.ndarray, n: np.ndarray) -> Filter:
    """The filter of keys with counts n, as large as they need."""
    entries = np.bincount((keys >> np.uint64(58)).astype(np.int64), level_of(n) + 1, SEGMENTS)
    m = 8 * (int(entries.max()) * ENTRY_BITS // 8 + 8)
    data = np.zeros((SEGMENTS, m // 8), np.uint8)
    for part in _deal_to_segments(0, False)(iter([pa.RecordBatch.from_pydict({"keys": [keys.tobytes()], "n": [_pack(n)]})])):
        for i in range(part.num_rows):
            r = _fill(m)(pa.Table.from_batches([part.slice(i, 1)])).to_pylist()[0]
            data[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return Filter(m, data)


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held: which rows aren't learned from (null: learned from). A null text is empty: one end. Keys are integers;
    repeated rows are learned from and scored as often as they occur. Empty input gives no rows."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).cast("binary").alias("text"))
    blocks = written(source.mapInArrow(_tokenise, BLOCKS))
    size = blocks.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    shards = lambda n: max(0, int(np.ceil(np.log2(max(n or 1, 1) / SHARD_ENTRIES))))
    ub, bb = shards(size["types"]), shards(size["tokens"])
    summed = written(blocks.select("block", "hashes", "counts").mapInArrow(_deal_unigrams(ub), "shard int, block long, keys binary, n binary").groupBy("shard").applyInArrow(_sum_unigrams, "shard int, block long, n binary, types long, tokens long"))
    total = summed.agg(F.sum("types").alias("v"), F.sum("tokens").alias("n")).first()
    n_all, v_all = int(total["n"] or 0), int(total["v"] or 0)
    levels = blocks.select("block", "hashes", "words", "ends", "held").mapInArrow(_deal_bigrams(bb), "shard int, block long, keys binary, n binary").groupBy("shard").applyInArrow(_sum_bigrams(bb), "shard int, block long, level binary")
    below = n_all + 0.1 * (v_all + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        back = sorted(zip(*(right.column(x).to_pylist() for x in ("bigram", "shard", "n")), strict=True))
        c = np.concatenate([_unpack(x, np.int64) for bigram, _, x in back if not bigram])
        both = np.concatenate([_unpack(x, np.uint8) for bigram, _, x in back if bigram])
        words, ends = _unpack(r["words"], np.uint32), np.frombuffer(r["ends"], np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        base = np.log10((c + 0.1) / below)[words]
        _, at, v = _pairs(r, bb)
        logp = np.log10(smoothed(quantised(both)[at], c[v], c[words], below))
        add = lambda x: np.add.reduceat(x, starts)
        ids = np.frombuffer(r["ids"], np.int64)
        return pa.table({
            "id": pa.array(ids, mask=ids == _NO_ID), "held_out": pa.array(np.frombuffer(r["held"], bool)), "n_tokens": pa.array(np.diff(ends, prepend=0)),
            "n_known": pa.array(add((c > 0)[words].astype(np.int64))), "train_tokens": pa.array(np.full(len(ends), n_all)), "base_score": pa.array(add(base)), "score": pa.array(add(logp)),
        })

    counts = summed.where("block <> -1").select("block", F.lit(False).alias("bigram"), "shard", "n").union(levels.select("block", F.lit(True), "shard", "level"))
    own = blocks.select("block", "ids", "held", "ends", "words", "hashes")
    out = own.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", key)
