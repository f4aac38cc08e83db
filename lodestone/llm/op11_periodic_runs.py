"""Periodic runs inside each document, by seeds that are extended along diagonals.

A run is a stretch of consecutive words with smallest period q and length at least max(least, times * q) that no
neighbouring word extends. Moved by q it overlaps itself in at least (times - 1) * q words, or in least - q of them. For
lags of K to 2K - 1 (K = 8, 16, 32, ...; the first lags start at 1) that overlap is at least 2K - 1 words, so it holds
one whole K-gram that starts at a multiple of K. For each K

1. all K-grams of the documents are indexed: equal grams get equal numbers, made from the numbers of their halves;
2. pairs of a gram at a multiple of K and an equal gram of the same document K to 2K - 1 words on are seeds: at most 2K
   for each K words, so at most two for each word, whatever repeats;
3. a table of the furthest covered word per lag passes over seeds that lie where an earlier seed of their lag reached;
4. what is left is extended to both sides, by the numbers of ever shorter grams.

Extensions of one stretch under several lags are multiples of its smallest period, which stays. Documents are
independent, so nothing is shuffled and a lost task costs that task alone. A document of n words takes O(n log^2 n) time
and O(n log n) memory, whatever its words are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks

#: A run has at least LEAST words and TIMES periods; seeds of the first level are grams of FIRST words.
LEAST, TIMES, FIRST = 24, 3, 8
DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges start, start + 1, ... of these sizes, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _named(key: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0; places that aren't kept get -1."""
    out = np.full(len(key), -1, np.int64)
    out[kept] = np.unique(key[kept], return_inverse=True)[1]
    return out


def _doubled(names: np.ndarray, half: int, left: np.ndarray) -> np.ndarray:
    """Numbers of grams twice as long as those of `names`; left: words from each place to its document's end."""
    kept = left >= 2 * half
    later = np.append(names[half:], np.zeros(min(half, len(names)), np.int64))
    return _named(names * (len(names) + 1) + later, kept)


def _seeds(names: np.ndarray, k: int, first_lag: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag): grams at multiples of k in their document, and equal grams first_lag to 2k - 1 words on. Numbers
    tell documents apart, since equal grams of two documents have different ones. at: a word's place in its document."""
    have = np.flatnonzero(names >= 0)
    n = len(names) + 2 * k
    index = np.sort(names[have] * n + have)
    anchor = have[at[have] % k == 0]
    low = np.searchsorted(index, names[anchor] * n + anchor + first_lag)
    many = np.searchsorted(index, names[anchor] * n + anchor + 2 * k) - low
    place = np.repeat(anchor, many)
    return place, index[_spread(low, many)] % n - place


def _uncovered(place: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, covered, lag): for each lag its seeds in order; those that start where the one before ends are covered
    by it, and the first of such a chain goes on with the furthest covered place."""
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    opens = np.ones(len(place), bool)
    opens[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + k)
    first = np.flatnonzero(opens)
    return place[first], place[np.append(first[1:], len(place)) - 1] + k if len(first) else place, lag[first]


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run, by start and period. words: numbers of the words of documents, one after
    the other; sizes: words of each document. Starts count from the first word of the first document."""
    if times < 3 or least < 3 * FIRST:
        raise ValueError("seeds hold for 3 periods and 24 words, or more")
    ends = np.repeat(np.cumsum(sizes), sizes)
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    here = np.arange(len(words))
    left = ends - here
    doc = np.repeat(np.arange(len(sizes)), sizes)
    levels = [_named(doc * (int(words.max(initial=0)) + 1) + words, left >= 1)]  # grams of 1, 2, 4, ... words
    for power in range(FIRST.bit_length() - 1):
        levels.append(_doubled(levels[-1], 1 << power, left))
    found, k, longest = [], FIRST, int(sizes.max(initial=0))
    while longest >= max(least, times * k if k > FIRST else 0):
        place, lag = _seeds(levels[-1], k, 1 if k == FIRST else k, here - begins)
        start, reach, lag = _uncovered(place, lag, k)
        for names, step in zip(levels[-2::-1], (1 << p for p in range(len(levels) - 2, -1, -1)), strict=True):
            # Neither side goes on by a whole gram of k words, so each shorter length is taken once at most.
            right = ends[start] - reach - lag >= step
            right[right] = names[reach[right]] == names[(reach + lag)[right]]
            reach = reach + step * right
            back = start - begins[start] >= step
            back[back] = names[(start - step)[back]] == names[(start + lag - step)[back]]
            start = start - step * back
        size = reach - start + lag
        good = size >= np.maximum(least, times * lag)
        found.append(np.stack([start[good], size[good], lag[good]]))
        if len(np.unique(own := levels[-1][levels[-1] >= 0])) == len(own):
            break  # no gram of this length occurs twice, so no longer one does
        levels.append(_doubled(levels[-1], k, left))
        k *= 2
    start, size, lag = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((lag, size, start))
    start, size, lag = start[order], size[order], lag[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    start, size, lag = start[smallest], size[smallest], lag[smallest]
    order = np.lexsort((lag, start))
    return start[order], size[order], lag[order]


def _repeats(words: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
    """Which documents may hold one gram of `span` words twice, by hashes: never false for one that does."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    h = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ doc * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    step = 1
    while step < span:
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + h[step:] if len(h) > step else h[:0]
        h ^= h >> np.uint64(32)
        step *= 2
    inside = doc[: len(h)] == doc[len(doc) - len(h) :]
    h, doc = h[inside], doc[: len(inside)][inside]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(sizes), bool)
    out[doc[order[1:]][same].astype(np.int64)] = True
    return out


def planted(key: str | None, n: int) -> np.ndarray | None:
    """Places in a document of n words that its words come from, where its key asks for a repeating tail; else None."""
    h = zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of these texts, and how many each text has; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    parent = pc.list_parent_indices(lists).filter(real).to_numpy(zero_copy_only=False)
    return flat.filter(real), np.bincount(parent, minlength=len(texts)).astype(np.int64)


def _kept(n: int, starts: np.ndarray, sizes: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts + periods, 1)
    np.add.at(edge, starts + sizes, -1)
    return np.cumsum(edge[:-1]) == 0


def _collapsed(flat: pa.Array, sizes: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """Kept words of each document joined by one space."""
    cuts = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(sizes))]
    lists = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), flat.filter(pa.array(keep)).cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()


def _best(size: list[int], period: list[int]) -> int:
    """The run with the greatest length by period, exactly; the first of equals (runs come by start and period)."""
    best = 0
    for i in range(1, len(size)):
        if size[i] * period[best] > size[best] * period[i]:
            best = i
    return best


def _analyse(key: int, least: int, times: int, plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "_text"):
                flat, sizes = words_of(part.column("_text"))
                begins = np.cumsum(sizes) - sizes
                if plant:
                    source = np.arange(len(flat))
                    for i, name in enumerate(part.column("_name").to_pylist()):
                        own = planted(name, int(sizes[i]))
                        if own is not None:
                            source[begins[i] : begins[i] + sizes[i]] = begins[i] + own
                    flat = flat.take(pa.array(source))
                number = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                # The least overlap of a run with itself is 2 * FIRST words.
                docs = np.flatnonzero(_repeats(number, sizes, 2 * FIRST) & (sizes >= least))
                some = _spread(begins[docs], sizes[docs])
                start, size, period = find_runs(number[some], sizes[docs], least, times)
                start = some[start] if len(start) else start
                of = np.searchsorted(begins + sizes, start, side="right")
                texts = _collapsed(flat, sizes, _kept(len(flat), start, size, period))
                rows = {n: [None] * len(sizes) for n in ("start", "length", "period", "exponent_milli")}
                lists = [b""] * len(sizes)
                cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
                for i in np.unique(of).tolist():
                    own = slice(cuts[i], cuts[i + 1])
                    s, n, q = (start[own] - begins[i]).tolist(), size[own].tolist(), period[own].tolist()
                    b = _best(n, q)
                    rows["start"][i], rows["length"][i], rows["period"][i], rows["exponent_milli"][i] = s[b], n[b], q[b], 1000 * n[b] // q[b]
                    lists[i] = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, q, strict=True)).encode()
                digest = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
                columns = [pa.array(np.diff(cuts), pa.int64()), *(pa.array(v, pa.int64()) for v in rows.values()), digest(lists), digest(texts)]
                yield pa.RecordBatch.from_arrays([part.column(key), *columns], names=[part.schema.names[key], "n_runs", *rows, "runs_sha256", "collapsed_sha256"])

    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, plant: bool = False) -> DataFrame:
    """One row per row of docs: key, n_runs; start, length, period and exponent_milli of the run with the greatest
    length by period (ties: smallest start, then period; nulls without a run); runs_sha256 over a line
    `start,length,period` for each run; collapsed_sha256 over the words that no run holds after its first period.

    Words are `[^\\x20\\x09-\\x0D]+` and told apart exactly. plant: words of documents whose crc32(key as text) is
    divisible by ten are first replaced as planted() says. Null and empty texts have no words, and the digests of an
    empty text; a null key plants nothing; repeated rows are answered each for itself; other columns aren't read."""
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(text).alias("_text"), F.col(key).cast("string").alias("_name"), F.col(key).alias(key))
    return rows.mapInArrow(_analyse(2, least, times, plant), f"`{key}` {kind}, {DIGEST}")


def _spans(key: int, least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "_text"):
                flat, sizes = words_of(part.column("_text"))
                number = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                start, size, period = find_runs(number, sizes, least, times)
                ends = np.cumsum(sizes)
                of = np.searchsorted(ends, start, side="right")
                keys = part.column(key).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in (start - (ends - sizes)[of], size, period))], names=[part.schema.names[key], "start", "length", "period"])

    return run


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(key, start, length, period) of every run of every document, in words from 0."""
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(text).alias("_text"), F.col(key).alias(key))
    return rows.mapInArrow(_spans(1, least, times), f"`{key}` {kind}, start long, length long, period long")


def _collapse(text: int, least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, batch.schema.names[text]):
                flat, sizes = words_of(part.column(text))
                number = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                start, size, period = find_runs(number, sizes, least, times)
                texts = pa.array(_collapsed(flat, sizes, _kept(len(flat), start, size, period)), pa.binary()).cast(pa.string())
                touched = np.zeros(len(sizes), bool)
                touched[np.searchsorted(np.cumsum(sizes), start, side="right")] = True
                yield part.set_column(text, part.schema.field(text), pc.if_else(pa.array(touched), texts, part.column(text)))

    return run


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with each run cut down to its first period. A text that holds a run becomes its kept words joined by one
    space; all other texts, null ones too, and all other columns stay as they are."""
    return docs.mapInArrow(_collapse(docs.columns.index(text), least, times), docs.schema)
