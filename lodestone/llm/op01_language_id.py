"""Language identification by prediction by partial matching over bytes.

For each language, counts of the bytes that follow every context of 0 to 3 bytes in labelled texts. Where a context
has not seen a byte, an escape (distinct bytes / (occurrences + distinct bytes)) leads to the context without its
oldest byte, in the end to one byte in 256. The counts are frozen; a text's code length under a language is the exact
sum over all its bytes, and the shortest code wins. Costs are laid out once per worker as tables (context, byte,
language) of LANGS languages each, so that scoring is two array look-ups a byte and table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import byte_chunks, named, numbered

ORDER = 3
#: Labelled texts learned from, per language, in expectation: a bounded sample by hash of the id.
SAMPLE_DOCS = 300
#: Languages in one table, and tables that a worker keeps; further ones are laid out anew for each chunk of texts.
LANGS, TABLES = 8, 8
UNKNOWN = "und"
_LETTER = r"\p{L}"
_models: dict[tuple[str, int], Model] = {}


class Model:
    """Frozen statistics: languages in order, and for each the counts of 4-grams of bytes (as unsigned integers)."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.langs, n_lang = langs, len(langs)
        used = np.zeros(256, bool)
        used[0] = True
        for g in grams:
            for shift in (0, 8, 16, 24):
                used[(g >> shift) & 255] = True
        self.code = np.zeros(256, np.int32)  # 0: a byte never seen in learning
        self.code[used] = np.arange(1, used.sum() + 1)
        a = self.a = int(used.sum()) + 1
        parts = [[self.code[(g >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0)] for g in grams]
        rows = np.full((1, a, n_lang), 8.0, np.float32)
        at = np.zeros(1, np.int64)  # context code -> row of its longest known suffix
        all_rows, offset = [], 0
        for k in range(ORDER + 1):
            ctx = [sum(p[3 - j] * a ** (j - 1) for j in range(1, k + 1)) + np.zeros(len(p[0]), np.int64) for p in parts]
            keys = np.unique(np.concatenate(ctx)) if n_lang else np.zeros(0, np.int64)
            parent = at if k == 0 else np.tile(at, a)
            own = parent[keys] if k else np.zeros(len(keys), np.int64)
            mine = (np.concatenate(all_rows)[own] if k else np.repeat(rows, len(keys), 0)).copy()
            for j in range(n_lang):
                where = np.searchsorted(keys, ctx[j])
                ok = (where < len(keys)) & (keys[np.minimum(where, max(len(keys) - 1, 0))] == ctx[j]) if len(keys) else np.zeros(len(ctx[j]), bool)
                cell, back = np.unique(where[ok] * a + parts[j][3][ok], return_inverse=True)
                c = np.bincount(back, counts[j][ok], len(cell))
                s, sym = cell // a, cell % a
                n = np.bincount(s, c, len(keys))
                d = np.bincount(s, minlength=len(keys))
                seen = n > 0
                mine[seen, :, j] -= np.log2(d[seen] / (n[seen] + d[seen]))[:, None]
                mine[s, sym, j] = -np.log2(c / (n[s] + d[s]))
            new = parent.copy()
            new[keys] = offset + np.arange(len(keys))
            at, offset = new, offset + len(keys)
            all_rows.append(mine)
        self.at = at.astype(np.int32)
        self.cost = np.concatenate(all_rows).reshape(-1, n_lang)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        joined = np.frombuffer(b"".join(x for t in texts for x in (b"\0\0\0", t)), np.uint8)
        starts = np.cumsum([0] + [len(t) + 3 for t in texts[:-1]])
        c = np.concatenate([[1, 1, 1], self.code[joined]]).astype(np.int32)
        state = self.at[(c[:-3] * self.a + c[1:-2]) * self.a + c[2:-1]]
        cost = self.cost[state.astype(np.int64) * self.a + c[3:]]
        for k in range(3):
            cost[starts + k] = 0
        return np.add.reduceat(cost, starts, axis=0, dtype=np.float64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_chunks(batch, "text"):
            langs = part.column("lang").to_pylist()
            texts = part.column("text").to_pylist()
            for lang in sorted(set(langs)):
                b = np.frombuffer(b"".join(b"\0\0\0" + t for t, x in zip(texts, langs, strict=True) if x == lang), np.uint8).astype(np.int64)
                g = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                keep = np.ones(len(g), bool)
                ends = np.cumsum([len(t) + 3 for t, x in zip(texts, langs, strict=True) if x == lang])[:-1]
                for k in range(3):  # grams that end in a later text's padding
                    at = ends - 3 + k
                    keep[at[(at >= 0) & (at < len(g))]] = False
                g, n = np.unique(g[keep], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g, pa.int64()), "n": pa.array(n, pa.int64())})


def fit(docs: DataFrame, text: Column, lang: Column, key: Column) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Statistics of labelled texts: all columns are expressions on docs; rows with a null text or lang are left out.

    About SAMPLE_DOCS whole texts of each language are learned from, those with the smallest hashes of the key, or of
    the text where the key is null. Rows that repeat a key are all in the sample or all out of it."""
    rows = docs.select(lang.alias("lang"), text.cast("binary").alias("text"), key.cast("string").alias("key")).where("lang is not null and text is not null")
    share = {r["lang"]: min(1.0, SAMPLE_DOCS / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return [], [], []
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    rows = rows.withColumn("h", F.when(F.col("key").isNotNull(), F.xxhash64("key")).otherwise(F.xxhash64("text")))
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30))
    grams = sample.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    grams = grams.sort_values(["lang", "gram"])
    langs = sorted(grams["lang"].unique())
    by = [grams[grams["lang"] == x] for x in langs]
    return langs, [g["gram"].to_numpy(np.int64) for g in by], [g["n"].to_numpy(np.int64) for g in by]


def usual_rates(docs: DataFrame, stats, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """medians() of all labelled texts of docs under the model."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text <> ''")
    return medians(predict(rows, stats, keep=["lang"], rate=True))


def medians(found: DataFrame) -> dict[str, float]:
    """The median code length of each learned language, in bits a byte to three digits, over all texts of found (lang,
    lang_pred, rate) that are labelled with it and taken for it: the least rate that half of them don't exceed.

    Texts are counted by language and rate, so what is ordered are a few thousand counts a language."""
    counts = found.where("lang = lang_pred AND rate IS NOT NULL").groupBy("lang", F.round("rate", 3).alias("rate")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang")
    ranked = counts.withColumns({"upto": F.sum("n").over(own.orderBy("rate")), "all": F.sum("n").over(own)})
    return {r["lang"]: r["rate"] for r in ranked.where(F.col("upto") * 2 >= F.col("all")).groupBy("lang").agg(F.min("rate").alias("rate")).collect()}


def predict(docs: DataFrame, stats, text: str = "text", keep: Sequence[str] | None = None, rate: bool = False) -> DataFrame:
    """The columns `keep` of docs (None: all) with lang_pred and score (the share of the best language's 2^-bits in
    their sum; 0 where unknown); columns of docs with these two names are replaced, others may have any name.

    A null text, or one without a letter, is `und`; so is every text if nothing was learned. Equal code lengths go to
    the first language by code point. rate: one more column, `rate`, the code length in bits a byte under the best
    language; null where unknown."""
    added = ("lang_pred", "score", "rate") if rate else ("lang_pred", "score")
    names = [c for c in (keep or docs.columns) if c not in added]
    if not stats[0]:
        out = docs.select(*map(named, names), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
        return out.withColumn("rate", F.lit(None).cast("double")) if rate else out
    shared, key, langs = docs.sparkSession.sparkContext.broadcast(stats), uuid.uuid4().hex, stats[0]
    starts = range(0, len(langs), LANGS)
    rows, at, fields = numbered(docs, [*names, text])

    def model(start: int) -> Model:
        if (key, start) not in _models:
            if len(_models) >= TABLES or any(k != key for k, _ in _models):
                _models.clear()
            _models[key, start] = Model(*(x[start : start + LANGS] for x in shared.value))
        return _models[key, start]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, at[text], 2 << 20):
                known = part.column("_lettered").to_pylist()
                texts = [t.encode() if k else b"" for t, k in zip(part.column(at[text]).to_pylist(), known, strict=True)]
                bits = np.hstack([model(a).bits(texts) for a in starts])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                found = pa.array([langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)])
                columns = [*(part.column(at[c]) for c in names), found, pa.array(np.where(known, share, 0.0))]
                if rate:
                    columns.append(pa.array(bits.min(axis=1) / np.maximum([len(t) for t in texts], 1), mask=~np.array(known, bool)))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    lettered = F.coalesce(F.col(at[text]).rlike(_LETTER), F.lit(False))
    kinds = (StringType(), DoubleType(), DoubleType())
    schema = StructType([*fields[: len(names)], *(StructField(c, k) for c, k in zip(added, kinds, strict=False))])
    return rows.withColumn("_lettered", lettered).mapInArrow(score, schema)
