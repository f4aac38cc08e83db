"""Periodic runs against every lag of every document, and on awkward rows."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from lodestone.llm import op11_periodic_runs, queries
from lodestone.llm.op11_periodic_runs import find_runs

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=24, times=3):
    """Every stretch on every lag; of lags with the same words, the smallest."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, size, q) for (i, size), q in found.items())


def brute_row(key, text, plant=True):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def periodic(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        block = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, rng.choice([3, 20, 60])))]
        words += block * rng.choice([1, 1, 2, 3, 4, 10])
        del words[len(words) - rng.randint(0, min(3, len(words))) :]
    return words


def test_runs_equal_every_lag_of_random_documents():
    rng = random.Random(7)
    for _ in range(400):
        docs = [periodic(rng) for _ in range(rng.randint(0, 4))]
        got = find_runs(np.array(sum(docs, []), np.int64), np.array(list(map(len, docs)), np.int64))
        begins = np.cumsum([0, *map(len, docs)]).tolist()
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted((s + b, size, q) for b, d in zip(begins, docs, strict=False) for s, size, q in brute_runs(d))


@pytest.mark.parametrize("words", [np.zeros(300_000, np.int64), np.arange(300_000) % 99_999, np.random.default_rng(3).integers(0, 2, 300_000)], ids=["one word", "three long periods", "two words"])
def test_long_documents_take_little_longer_than_linear_time(words):
    began = time.process_time()
    start, size, period = find_runs(words, np.array([len(words)]))
    assert time.process_time() - began < 20
    for s, n, q in zip(start.tolist(), size.tolist(), period.tolist(), strict=True):
        assert (words[s : s + n - q] == words[s + q : s + n]).all() and n >= max(24, 3 * q)
    if words.max() != 1:
        assert size.tolist() == [300_000]


def test_query_equals_brute_force(spark):
    got = sorted(map(tuple, queries.op11_runs(spark, SF).collect()))
    assert got == sorted(brute_row(*r) for r in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall())
    assert sum(r[1] > 0 for r in got) > 5


def test_awkward_rows(spark):
    tens = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a b " * 12, "a b " * 11 + "a", "x " * 24, "x " * 23, " x y\x1c " * 30, "ä ß\n" * 40 + "c " * 30, "w " * 5000 + " ".join(map(str, range(200)))]
    rows = [(k, t) for t in texts for k in (1, tens[0], tens[1], None)] + [(1, texts[4])] * 3
    docs = spark.createDataFrame([(k, t, "z", 5, 1.0) for k, t in rows], "doc_id long, text string, n_runs string, start int, `a.b` double")
    got = op11_periodic_runs.periodic_runs(docs, plant=True)
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, got.collect())) == order(brute_row(*r) for r in rows)
    assert op11_periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    spans = op11_periodic_runs.runs(docs.where("doc_id = 1"))
    assert order(map(tuple, spans.collect())) == order((k, *r) for k, t in rows if k == 1 for r in brute_runs(re.findall("[^\\x20\\x09-\\x0D]+", t or "")))


def test_collapse_keeps_other_texts_and_columns(spark):
    rows = [("keep  this\n text", 1), ("say " + "na na hey " * 20 + "bye", 2), (None, 3), ("", 4)]
    got = op11_periodic_runs.collapse(spark.createDataFrame(rows, "text string, start int"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [rows[0], ("say na na hey bye", 2), rows[2], rows[3]]
    assert op11_periodic_runs.collapse(got.limit(0)).count() == 0


def test_keys_of_any_type(spark):
    docs = spark.createDataFrame([("a.b", "x y " * 20)], "`the key` string, body string")
    row = op11_periodic_runs.periodic_runs(docs, key="the key", text="body").first()
    assert (row["the key"], row.n_runs, row.start, row.length, row.period) == ("a.b", 1, 0, 40, 2)
