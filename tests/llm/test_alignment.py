"""Alignment against a plain version: every common end of whole texts, and counts in a dictionary."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import op13_token_alignment, queries
from lodestone.llm.op13_token_alignment import align_documents, byte_alphabet, link_counts, shared_cuts

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", "a b", " a b", "a b ", "x  y   z", "a\nb\t c", "don't ▁ we", "▁", "<|endoftext|> </s> <0x41>", "é Ⅳ 😀 日本語", "é ﬁ", "a\x00b", "﻿x", "a　b \x85 c", "12345,6 !!! ...", "word " * 3000, "naïve Ångström"]
tok = Tokenizer.from_file(A)
tok.encode_special_tokens = True
model = sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """[(id, bytes)] of both sides, or none where bytes differ."""
    if not text:
        return [], []
    alphabet = byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        p = model.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
    same = all(b"".join(x for _, x in side) == (" " + text).encode() for side in (a, b))
    return (a, b) if same else ([], [])


def brute(rows):
    ends = lambda side: {sum(len(x) for _, x in side[: i + 1]): i for i in range(len(side))}
    linked, out = [], []
    for _, text in rows:
        a, b = tokens(text) if len(text or "") < 5000 else tokens_fast(text)
        ea, eb = running(a), running(b)
        linked.append((a, b, [(ea[e], eb[e]) for e in sorted(ea.keys() & eb.keys())]))
    counts = Counter((a[i][0], b[j][0]) for a, b, cuts in linked for i, j in cuts)
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    for (key, _), (a, b, cuts) in zip(rows, linked, strict=True):
        groups, i0, j0 = [], 0, 0
        for i, j in cuts:
            groups.append(",".join(str(x) for x, _ in a[i0 : i + 1]) + "|" + ",".join(str(x) for x, _ in b[j0 : j + 1]))
            i0, j0 = i + 1, j + 1
        own = [(counts[a[i][0], b[j][0]], most[b[j][0]]) for i, j in cuts]
        out.append((key, len(a), len(b), len(groups), len(own), sum(n == m for n, m in own), sum(n for n, _ in own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out, counts


tokens_fast = tokens


def running(side):
    at, out = 0, {}
    for i, (_, x) in enumerate(side):
        at += len(x)
        out[at] = i
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_cuts_are_all_common_ends():
    rng = random.Random(4)
    for _ in range(1000):
        n = rng.randint(1, 40)
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})) for _ in "ab")
        common = sorted(set(a.tolist()) & set(b.tolist()))
        known = sorted({*rng.sample(common, rng.randint(0, len(common))), n})
        i, j = shared_cuts(a, b, np.searchsorted(a, known) + 1, np.searchsorted(b, known) + 1)
        assert a[i].tolist() == b[j].tolist() == common
    a, b = np.arange(1, 200_001), np.arange(2, 200_001, 2)
    assert len(shared_cuts(a, b, np.array([len(a)]), np.array([len(b)]))[0]) == 100_000
    a = np.arange(1, 1001)
    i, j = shared_cuts(np.append(a, 5000), np.append(a + 1000, 5000), np.array([1001]), np.array([1001]))
    assert (i.tolist(), j.tolist()) == ([1000], [1000])  # no end but the last one is shared


def test_query_equals_plain_version(spark):
    want, _ = brute(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall())
    assert order(queries.op13_alignment(spark, SF).collect()) == order(want)


def test_awkward_rows_segments_and_forgotten_pieces(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a b"), (3, "a b"), (None, "a b c"), (None, None)]
    docs = spark.createDataFrame([(k, t, "z", 1.5) for k, t in rows], "doc_id long, text string, n_a string, `a.b` double")
    want, counts = brute(rows)
    assert order(align_documents(docs, A, B).collect()) == order(want)
    assert order(align_documents(docs, A, B, segment=40).collect()) == order(want)
    assert {(r.a_id, r.b_id): r.n for r in link_counts(docs, A, B).collect()} == counts
    assert align_documents(docs.limit(0), A, B).count() == 0
    monkeypatch.setattr(op13_token_alignment, "PIECES", 3)
    small = op13_token_alignment.Aligner(A, B)
    import pyarrow as pa

    for t in ("one two three four", "two five", "one six seven eight nine"):
        unit, count, units = small.units(pa.array([t]))
        assert b";".join(units.groups[u] for u in unit).decode() == align_text(t) and count.tolist() == [len(t.split())]


def align_text(text):
    a, b = tokens(text)
    ea, eb = running(a), running(b)
    out, i0, j0 = [], 0, 0
    for e in sorted(ea.keys() & eb.keys()):
        out.append(",".join(str(x) for x, _ in a[i0 : ea[e] + 1]) + "|" + ",".join(str(x) for x, _ in b[j0 : eb[e] + 1]))
        i0, j0 = ea[e] + 1, eb[e] + 1
    return ";".join(out)
