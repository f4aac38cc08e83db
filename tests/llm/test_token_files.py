"""Token files: blocks and files are exact round trips, and the query equals the library."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import op12_token_files, queries, wordcache
from lodestone.llm.op12_token_files import BLOCK, Reader, Writer, decode_blocks, encode_blocks
from lodestone.session import shared_dir

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "a b", " a b", "a b ", "don't we'll I 's x", "a\nb\tc", "a\n b", "x y  z", "a　　b", "<|endoftext|> hi<|endoftext|>", "é ï 😀 日本 123 45.6,7", "a\x1c b", "a\x1cb c", "\x85x y", 'word, (word) "x" it\'s .', "w " * 9000]


TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["small", "wide", "one value", "outliers", "full range", "one id"])
@pytest.mark.parametrize("n", [1, 31, BLOCK, BLOCK + 1, 5 * BLOCK + 77])
def test_blocks(kind, n):
    rng = np.random.default_rng(n)
    ids = {
        "small": rng.integers(1000, 1016, n), "wide": rng.integers(0, 50_257, n), "one value": np.full(n, 7), "one id": np.full(n, 2**32 - 1),
        "outliers": np.where(rng.random(n) < 0.02, rng.integers(0, 2**32, n), rng.integers(5, 9, n)), "full range": rng.integers(0, 2**32, n),
    }[kind].astype(np.uint32)
    blocks = encode_blocks(ids)
    cuts = np.cumsum([0, *map(len, blocks)])
    assert len(blocks) == -(-n // BLOCK)
    assert (decode_blocks(memoryview(b"".join(blocks)), cuts)[:n] == ids).all()
    if kind == "outliers" and n == 5 * BLOCK + 77:  # 2 bits each and some exceptions, against 32 bits
        assert cuts[-1] < 4 * n / 5


def test_reading_a_range_touches_its_blocks_only(tmp_path):
    ids = np.random.default_rng(5).integers(0, 50_257, 40 * BLOCK + 5).astype(np.uint32)
    writer = Writer(pa.OSFile(str(tmp_path / "x"), "wb"))
    for a in range(0, len(ids), 999):
        own = ids[a : a + 999]
        writer.add(pa.array([a, -a]), own, np.array([min(9, len(own)), len(own) - min(9, len(own))]))
    writer.close()
    reader = Reader(f"file://{tmp_path}/x")
    read = []

    class Spy:
        def read_at(self, n, at, file=reader.file):
            read.append(n)
            return file.read_at(n, at)

    reader.file = Spy()
    for a, b in [(0, len(ids)), (0, 1), (BLOCK - 1, BLOCK + 1), (7 * BLOCK, 8 * BLOCK), (len(ids) - 1, len(ids) + 50), (9, 9), (len(ids), len(ids))]:
        read.clear()
        assert (reader.ids(a, b) == ids[a:b]).all()
        assert sum(read) <= (min(b, len(ids)) // BLOCK - a // BLOCK + 1) * (BLOCK * 4 + 8)
    assert reader.documents().column("n_tokens").to_numpy().sum() == len(ids) == reader.n
    with pytest.raises(ValueError):
        (tmp_path / "y").write_bytes(b"0" * 100)
        Reader(f"file://{tmp_path}/y")


def test_pieces_equal_the_library(monkeypatch):
    monkeypatch.setattr(wordcache, "WORDS", 40)
    monkeypatch.setattr(wordcache, "PIECES", 40)  # pieces are forgotten and learned again
    pieces, tok, rng = wordcache.PieceIds(PATH), TOKENIZER, random.Random(2)
    bits = ["a", "B", " ", "  ", "\n", "'s", "é", "1", "?", ".", " ", "日", "<|endoftext|>", "\x1c", "\x85", " x", " the", *(f" w{i}" for i in range(60))]
    for texts in [TEXTS, [], *(["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(20)] for _ in range(60))]:
        for close in (None, 2):
            ids, sizes = pieces.of(pa.array(texts, pa.string()), close)
            want = [tok.encode(t or "", add_special_tokens=False).ids + [2] * (close is not None) for t in texts]
            assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_a_word_is_encoded_once_whatever_marks_or_lines_surround_it():
    pieces, sent = wordcache.PieceIds(PATH), []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return TOKENIZER.encode_batch_fast(texts, **options)

    pieces.tok = Spy()
    words = ["".join(c) for c in itertools.product("abé", "xyz", "qüw", "rst")]
    text = "".join(f" {w}{m}" for m in ["", ",", ".", "!?", "###", ".***", '")'] for w in words)[1:]
    lines = "".join(f" {v}.\n{w}," for v, w in itertools.pairwise(words))[1:]
    for texts in ([text, lines], [lines], [text]):
        ids, sizes = pieces.of(texts)
        assert ids.tolist() == sum(map(whole, texts), []) and sizes.tolist() == [len(whole(t)) for t in texts]
    # Once after a space, once after a line feed, and the two texts' first words; not once for each mark and neighbour.
    assert sum(c.isalpha() for t in sent for c in t) <= 4 * (2 * len(words) + 4)


def test_marks_that_do_not_close_a_word():
    # Apostrophes, marks alone, digits, letters beyond the Latin blocks and combining ones, at a text's or line's start too.
    words = ["it's", "it'", "dogs'.", "'s", "...", ".", "a.b", "a.b.", "1,", "a1,", "Привет,", "日本.", "e\u0301.", "ǅ!", "ª;", "µ:", "ɐ,", "_x_", "x_", "@", "<|endoftext|", "a\tb,", "\x1ca.", "ß\x85,"]
    texts = [*words, *(f"{v} {w}" for v in words for w in words), *(f"{v}\n{w}" for v in words for w in words), "\n", "a\n", "\na", "a\n\nb", "a \nb", "a\r\nb"]
    pieces = wordcache.PieceIds(PATH)
    for _ in range(2):  # learned, then looked up
        ids, sizes = pieces.of(texts, 2)
        want = [[*whole(t), 2] for t in texts]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def expected(rows, close=2):
    """Documents in key order, nulls first; equal keys keep their order."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole(text), close]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark):
    got = queries.op12_binary(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall())


def test_awkward_rows_and_files(spark):
    rows = [(i * 7 % 19 - 5, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (None, None), (3, "same"), (3, "same"), (3, "")]
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id long, text string, start string, key int").coalesce(1)
    got = op12_token_files.round_trip(docs, PATH)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows)
    assert op12_token_files.round_trip(docs.limit(0), PATH).count() == 0
    # A key that all rows share is spread over files, and files follow one another.
    folder = shared_dir(spark)
    same = spark.range(2000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("w "), "id").alias("text"))
    manifest = op12_token_files.write_tokens(same, PATH, folder, files=5)
    assert manifest.count() == 5 and manifest.where("n_documents > 800").count() == 0
    again = op12_token_files.read_documents(op12_token_files.load_manifest(spark, folder), "int").orderBy("start").collect()
    assert len(again) == 2000 and all(a.start + a.n_tokens == b.start for a, b in zip(again, again[1:]))
