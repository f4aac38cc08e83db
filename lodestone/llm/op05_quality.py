"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into one of at most BINS bins. Cyclic boosting visits the features in turn and adds a
shallow tree of one feature, fitted to the current gradients, to that feature's look-up table; then the pairs that
explain most of what is left get tables of two features in the same way. A score is a sum of table entries.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import byte_chunks, numbered

FEATURES = ("log_chars", "word_length", "vocabulary", "repeats", "symbols", "upper", "digits", "commas_stops", "breaks", "non_ascii", "line_copies", "exclamations")
#: Labelled rows learned from, in expectation: a bounded sample by hash of the id.
SAMPLE_ROWS = 20_000
BINS, CYCLES, RATE, LEAVES, PAIRS, LEAST = 32, 150, 0.1, 3, 8, 20


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES for each text; all are shares or logarithms, and 0 for an empty text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode()
        h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, n = text.split(), len(raw)
        m = max(len(words), 1)
        lines = text.split("\n")
        letters = max(h[65:91].sum() + h[97:123].sum(), 1)
        punct = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
        plain = h[44] + h[46]
        out[i] = (
            np.log1p(n), n / m, np.log1p(len(set(words))) / np.log1p(m), sum(map(operator.eq, words, words[1:])) / m, (punct - plain) / n, h[65:91].sum() / letters,
            h[48:58].sum() / n, plain / m, len(lines) / m, h[128:].sum() / n, 1 - len(set(lines)) / len(lines), h[33] / m,
        )
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_chunks(batch, "_text"):
            x = features([t or "" for t in part.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(c) for c in x.T)], names=[*part.schema.names[1:], *FEATURES])


def _leaf_steps(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """The step of each bin: a tree of up to `leaves` leaves over ordered bins, each with LEAST rows or more."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in itertools.pairwise(cuts):
            if b - a < 2:
                continue
            cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
            gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            gain[(cn[:-1] < LEAST) | (cn[-1] - cn[:-1] < LEAST)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(g))
    for a, b in itertools.pairwise(cuts):
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return step


class Additive:
    """The fitted model: cuts of each feature, a table for each feature and for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        qs = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(c, qs)) if len(c) else np.zeros(0) for c in x.T]
        mean = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        self.base = float(np.log(mean / (1 - mean)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if len(y) < 2 * LEAST or len(set(y.tolist())) < 2:
            return
        b = self._bins(x)
        f = np.full(len(y), self.base)
        for _ in range(CYCLES):
            for j, t in enumerate(self.tables):
                self._boost(b[j], t, f, y, lambda g, h, n: _leaf_steps(g, h, n, LEAVES))
        g = y - 1 / (1 + np.exp(-f))
        gains = {}
        for j, k in itertools.combinations(range(len(b)), 2):  # coarse grids show which pairs are left to explain
            cell = (b[j] * 4 // len(self.tables[j])) * 4 + b[k] * 4 // len(self.tables[k])
            n = np.bincount(cell, minlength=16)
            gains[j, k] = (np.bincount(cell, g, 16) ** 2 / (n + 10)).sum()
        self.pairs = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
        self.pair_tables = [np.zeros((len(self.tables[j]), len(self.tables[k]))) for j, k in self.pairs]
        for _ in range(CYCLES // 3):
            for (j, k), t in zip(self.pairs, self.pair_tables, strict=True):
                self._boost(b[j] * t.shape[1] + b[k], t.reshape(-1), f, y, lambda g, h, n, shape=t.shape: _pair_steps(g.reshape(shape), h.reshape(shape), n.reshape(shape)).reshape(-1))

    @staticmethod
    def _boost(cell, t, f, y, tree) -> None:
        p = 1 / (1 + np.exp(-f))
        step = RATE * tree(np.bincount(cell, y - p, len(t)), np.bincount(cell, p * (1 - p), len(t)), np.bincount(cell, minlength=len(t)))
        t += step
        f += step[cell]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        f = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[b[j]]
        for (j, k), t in zip(self.pairs, self.pair_tables, strict=True):
            f += t[b[j], b[k]]
        return 1 / (1 + np.exp(-f))


def _pair_steps(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree that cuts the first feature once at best and each side once by the second."""
    cut = np.flatnonzero(np.diff(_leaf_steps(g.sum(1), h.sum(1), n.sum(1), 2)))
    at = int(cut[0]) + 1 if len(cut) else max(1, len(g) // 2)
    out = np.zeros_like(g)
    for side in (slice(0, at), slice(at, None)):
        out[side] = _leaf_steps(g[side].sum(0), h[side].sum(0), n[side].sum(0), 2)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Additive:
    """A model of label 1 against 0, learned from about SAMPLE_ROWS rows of labels whose key is in docs.

    Rows with a null key or label are left out; of repeated keys the largest label counts, and of rows of docs that
    repeat a key the one with the smallest features. Without rows, or with one class only, the model is a constant."""
    own = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    share = min(1.0, SAMPLE_ROWS / max(own.count(), 1))
    own = own.where(F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 30)) < share * (1 << 30)).groupBy("k").agg(F.max("y").alias("y"))
    # The sample's size is bounded by SAMPLE_ROWS, whatever the tables' sizes.
    rows = docs.select(F.col(text).alias("_text"), F.col(key).alias("k")).join(F.broadcast(own), "k").select("_text", "k", "y")
    kind = rows.schema["k"].dataType.simpleString()
    found = rows.mapInArrow(_features, f"k {kind}, y int, " + ", ".join(f"{c} double" for c in FEATURES))
    data = found.groupBy("k", "y").agg(F.min(F.struct(*FEATURES)).alias("x")).select("k", "y", "x.*").toPandas().sort_values("k")
    return Additive(data[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), (data["y"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Additive, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (None: all) with score (0 to 1) and predicted (1 if score >= 0.5); columns of docs
    with these two names are replaced, others may have any name. A null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    rows, at, fields = numbered(docs, [*names, text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, at[text]):
                s = shared.value.score(features([t or "" for t in part.column(at[text]).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(at[c]) for c in names), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return rows.mapInArrow(run, StructType([*fields[: len(names)], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
