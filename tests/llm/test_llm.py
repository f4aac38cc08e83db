"""Each operator against a brute-force version, and on awkward rows."""

import html
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import op01_language_id, op02_ann, op03_token_counts, op04_lm, op05_quality, op06_embedding_dedup, op07_minhash_dedup, op08_packing, op09_html, op10_mixing, queries, wordcache
from lodestone.llm.common import components

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "   \n", "one", "a b c", "a b c", "A B c!", "word " * 30_000, "special <|endoftext|> text  with   spaces\x1c end", "été naïve ﬁ İstanbul ΣΑΣ", "́x y", "don't we'll 12345 !!! ... ,.;"]


@pytest.fixture(scope="module")
def tables():
    return {t: duckdb.sql(f"SELECT * FROM read_parquet('{SF}/{t}.parquet')").df() for t in ("documents", "embeddings", "pages", "labels")}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], ["a", None, "b"][i % 3], 9.0, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "a", 9.0, "x"), (None, "null key here", "en", "a", 9.0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, path string")


def united(pairs, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(50, 3), (100, 101), (7, 7)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in united(pairs, {x for p in pairs for x in p}).items()}


def test_language_held_out(spark, tables):
    got = queries.op1_language_id(spark, SF).toPandas().merge(tables["documents"], on="doc_id")
    assert len(got) == len(tables["documents"]) and got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95 and got.score.between(0, 1).all()


def brute_bits(learned, text):
    """Code length of a text: contexts of 3 to 0 bytes, escapes to shorter ones, in the end one byte of 256."""
    seen = defaultdict(Counter)
    for t in learned:
        t = b"\0\0\0" + t
        for i in range(3, len(t)):
            for k in range(4):
                seen[t[i - k : i]][t[i]] += 1
    total, text = 0.0, b"\0\0\0" + text
    for i in range(3, len(text)):
        for k in (3, 2, 1, 0):
            c = seen.get(text[i - k : i])
            if c and text[i] in c:
                total -= np.log2(c[text[i]] / (c.total() + len(c)))
                break
            total -= np.log2(len(c) / (c.total() + len(c))) if c else 0
        else:
            total += 8
    return total


def language_stats(learned):
    grams = {}
    for lang, texts in sorted(learned.items()):
        c = Counter(int.from_bytes(p[i - 3 : i + 1], "big") for t in texts for p in [b"\0\0\0" + t] for i in range(3, len(p)))
        grams[lang] = np.array(sorted(c)), np.array([c[g] for g in sorted(c)])
    return list(grams), [g for g, _ in grams.values()], [n for _, n in grams.values()]


def test_language_code_length(spark, tables, monkeypatch):
    docs = tables["documents"]
    learned = {lang: [t.encode() for t in own.text[:6]] for lang, own in docs.groupby("lang")}
    stats = language_stats(learned)
    texts = [t.encode()[:900] for t in docs.text[-12:]] + [b"", b"a", "\u4e2d \x00".encode()]
    want = np.array([[brute_bits(learned[lang], t) for lang in stats[0]] for t in texts])
    assert np.allclose(op01_language_id.Model(*stats).bits(texts), want, rtol=1e-5, atol=1e-3)
    # Tables of fewer languages than there are, and fewer kept, give the same.
    df = spark.createDataFrame([(i, t.decode(errors="ignore")) for i, t in enumerate(texts)], "doc_id long, text string")
    one = sorted(op01_language_id.predict(df, stats).collect())
    monkeypatch.setattr(op01_language_id, "LANGS", 1)
    monkeypatch.setattr(op01_language_id, "TABLES", 2)
    assert len(stats[0]) == 4 and sorted(op01_language_id.predict(df, stats).collect()) == one


def test_language_sample_is_bounded(spark, monkeypatch):
    """Rows without a key don't all enter the sample."""
    monkeypatch.setattr(op01_language_id, "SAMPLE_DOCS", 20)
    rows = [(None, f"text number {i}", "en") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stats = op01_language_id.fit(df, F.col("text"), F.col("lang"), F.col("doc_id"))
    sizes = dict(zip(stats[0], (int(n.sum()) for n in stats[2]), strict=True))
    assert 0 < sizes["en"] < 60 * 20


def test_language_odd_rows(spark, odd):
    stats = op01_language_id.fit(odd, F.col("text"), F.col("lang"), F.col("doc_id"))
    got = op01_language_id.predict(odd, stats).collect()
    assert len(got) == odd.count() and all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in got)
    assert {r.lang_pred for r in op01_language_id.predict(odd, ([], [], [])).collect()} == {"und"}
    assert op01_language_id.predict(odd.limit(0), stats).count() == 0


def test_neighbours(spark, tables):
    got = queries.op2_ann(spark, SF).toPandas()
    x = np.stack(tables["embeddings"].sort_values("vec_id").embedding).astype(float)
    q = np.arange(0, len(x), 20)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -9
    hit = [len(set(np.argsort(-s[i])[:20]) & set(got[got.query_id == k].vec_id)) / 20 for i, k in enumerate(q)]
    assert np.mean(hit) >= 0.9 and (got.groupby("query_id")["rank"].max() == 20).all()
    for r in got.sample(50, random_state=1).itertuples():
        assert r.score == pytest.approx(x[r.query_id] @ x[r.vec_id], abs=1e-12)


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [2.0, None]), (7, [3.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in op02_ann.search(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, -1.0)]
    assert op02_ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_token_counts(spark, tables, odd):
    path = queries.tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in op03_token_counts.count_tokens(df, path).collect()) == want


def test_token_cache(spark, odd, tmp_path):
    path, cache = queries.tokenizer("byte_bpe_50k.json"), str(tmp_path / "cache")
    size = lambda: spark.read.parquet(cache).count()
    op03_token_counts.count_tokens(odd.where("doc_id < 5"), path, cache)
    assert size() == 4  # null and empty are one text, and "a b c" is another
    op03_token_counts.count_tokens(odd, path, cache)
    assert size() == odd.selectExpr("coalesce(text, '') t").distinct().count()
    assert op03_token_counts.count_tokens(odd.limit(0), path, cache).count() == 0


def test_word_caches_match_the_library(monkeypatch):
    monkeypatch.setattr(wordcache, "CACHE_WORDS", 8)
    texts = [t or "" for t in TEXTS] + ["Word, word. WORD; <|ENDOFTEXT|> x<|endoftext|>y", "a\n b", "a \nb ", " lead", "x  y"]
    for name, cls in (("word_bpe_49k.json", wordcache.WordIds), ("byte_bpe_50k.json", wordcache.PieceCounts)):
        path = public_tokenizers.path(name)
        tok, own = Tokenizer.from_file(str(path)), cls(str(path))
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):
            if cls is wordcache.PieceCounts:
                assert own.of(texts) == list(map(len, want))
            else:
                ids, n = own.of(texts, close=0)
                assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*w, 0] for w in want]


def test_language_model(spark, tables, odd):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"], zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and r.doc_id is not None) for r in df.select("doc_id", "text").collect()]
        c = Counter(w for _, ws, held in rows if not held for w in ws)
        n, below = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
        want = sorted((str(i), held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 0.1) / below) for w in ws), 4)) for i, ws, held in rows)
        got = op04_lm.score(df, op04_lm.F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score <= 0 for r in got)
    assert op04_lm.score(odd.limit(0), F.lit(False)).count() == 0


def brute_scores(rows):
    """Sum of log10 P(w | v) for each text (id, words, held) from counts of pairs rounded down to their levels."""
    end, uni, two = b"\n", Counter(), Counter()
    for _, ws, held in rows:
        if not held:
            uni.update(ws)
            two.update(zip([end, *ws], ws, strict=False))
    q = lambda c: max((x for x in (int(np.ceil(1.5**k - 1e-9)) for k in range(40)) if x <= c), default=0)
    below = sum(uni.values()) + 0.1 * (len(uni) + 1)
    p = lambda v, w: (q(two[v, w]) + 12 * (uni[w] + 0.1) / below) / (uni[v] + 12)
    return {i: sum(np.log10(p(v, w)) for v, w in zip([end, *ws], ws, strict=False)) for i, ws, _ in rows}


def lm_rows(df):
    return [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"], zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in df.select("doc_id", "text").collect()]


def test_language_model_at_any_size(spark, monkeypatch):
    """Scores are those of all counts, however small a fixed room would be, and in however many shards."""
    monkeypatch.setattr(op04_lm, "FILTER_BITS", 1 << 19, raising=False)
    monkeypatch.setattr(op04_lm, "SHARD_ENTRIES", 2000)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm_rows(df)
    want = brute_scores(rows)
    got = {r.doc_id: r.score for r in op04_lm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect()}
    off = np.array([abs(got[i] - want[i]) / len(ws) for i, ws, _ in rows])
    assert got.keys() == want.keys() and off.mean() < 0.002 and (off < 0.002).mean() > 0.9


def test_bigrams_seen_once_count(spark):
    """Two held-out texts of the same words: the one whose bigrams were each learned once scores higher."""
    rows = [(1, "red green blue", False), (2, "red green blue", True), (3, "blue red green", True), (4, "green grey", False)]
    got = {r.doc_id: r for r in op04_lm.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), F.col("held")).collect()}
    assert got[2].base_score == pytest.approx(got[3].base_score) and got[2].score > got[3].score + 0.5
    want = brute_scores([(i, [*t.encode().split(), b"\n"], h) for i, t, h in rows])
    assert all(got[i].score == pytest.approx(want[i]) for i in want)


def test_probabilities_sum_to_at_most_one(tables):
    """Over all learned words and one for the others, after every context: common, rare and never learned."""
    end, uni, two = b"\n", Counter(), Counter()
    for t in tables["documents"].text[:60]:
        ws = [*t.encode().lower().split(), end]
        uni.update(ws)
        two.update(zip([end, *ws], ws, strict=False))
    words = sorted(uni)
    hashed = {w: np.uint64(xxhash.xxh64_intdigest(w)) for w in [*words, b"never learned"]}
    key = lambda v, ws: op04_lm.bigram_keys(np.array([hashed[v]]), np.array([hashed[w] for w in ws]), 0)
    pairs = sorted(two)
    keys = np.concatenate([key(v, [w]) for v, w in pairs])
    order = np.argsort(keys)
    held = op04_lm.build_filter(keys[order], np.array([two[p] for p in pairs])[order])
    below = sum(uni.values()) + 0.1 * (len(uni) + 1)
    own = np.array([uni[w] for w in words])
    for v in [w for w, _ in uni.most_common(20)] + words[:20] + [b"never learned"]:
        read = held.counts(key(v, words))
        p = op04_lm.smoothed(read, np.full(len(words), uni[v]), own, below)
        unknown = op04_lm.smoothed(np.zeros(1), np.array([uni[v]]), np.zeros(1), below)
        wrong = 5 * len(words) / 5000 / (uni[v] + op04_lm.PRIOR)  # 1 of 5,000 absent pairs reads as held
        assert 0.3 < p.sum() + unknown[0] <= 1 + wrong
        exact = op04_lm.smoothed(np.minimum(read, [two[v, w] for w in words]), np.full(len(words), uni[v]), own, below)
        assert exact.sum() + unknown[0] <= 1 + 1e-9


def test_bloom_counts():
    keys = np.random.default_rng(0).integers(1, 1 << 63, 3000).astype(np.uint64) << np.uint64(1)
    n = np.random.default_rng(1).integers(1, 500, 3000)
    import pyarrow as pa

    dealt = next(op04_lm._deal_to_segments(0, False)(iter([pa.RecordBatch.from_pydict({"keys": [keys.tobytes()], "n": [op04_lm._pack(n)]})])))
    data, m = np.zeros((op04_lm.SEGMENTS, 4096 // 8 * 4), np.uint8), 4096 * 4
    for i in range(dealt.num_rows):
        t = op04_lm._fill(m)(pa.Table.from_batches([dealt.slice(i, 1)])).to_pylist()[0]
        data[t["segment"]] = np.frombuffer(t["bits"], np.uint8)
    f = op04_lm.Filter(m, data)
    assert (op04_lm.level_of(np.ceil(f.counts(keys))) >= op04_lm.level_of(n)).all()  # never less
    assert (op04_lm.level_of(np.ceil(f.counts(keys))) == op04_lm.level_of(n)).mean() > 0.95
    assert (f.counts(keys + np.uint64(1)) > 0).mean() < 0.02


def test_quality(spark, tables, odd):
    got = queries.op5_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("SELECT doc_id, quality FROM read_parquet('/root/testdata/sf0.01/labels.parquet')").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 1000 and (held.predicted == held.quality).mean() > 0.95
    model = op05_quality.fit(odd, odd.selectExpr("doc_id", "CAST(NULL AS INT) AS quality"))
    rows = op05_quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert op05_quality.score(odd.limit(0), model).count() == 0


def test_quality_tables_are_sums_of_trees(tables, monkeypatch):
    """What cyclic boosting leaves in the tables scores as the base and all trees' steps added up row by row."""
    x = op05_quality.features(tables["documents"].text.tolist())
    y = (np.arange(len(x)) % 3 > 0).astype(float)
    steps, whole = [], op05_quality.Additive._boost

    def boost(cell, t, f, y, tree):
        before = t.copy()
        whole(cell, t, f, y, tree)
        steps.append((t - before)[cell])

    monkeypatch.setattr(op05_quality.Additive, "_boost", staticmethod(boost))
    model = op05_quality.Additive(x, y)
    assert len(steps) == op05_quality.CYCLES * len(op05_quality.FEATURES) + op05_quality.CYCLES // 3 * op05_quality.PAIRS
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(model.base + np.sum(steps, axis=0)))))
    one = [sum(t[np.searchsorted(c, v, side="right")] for c, v, t in zip(model.cuts, row, model.tables, strict=True)) for row in x]
    two = [sum(t[np.searchsorted(model.cuts[j], row[j], side="right"), np.searchsorted(model.cuts[k], row[k], side="right")] for (j, k), t in zip(model.pairs, model.pair_tables, strict=True)) for row in x]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(model.base + np.array(one) + np.array(two)))))


def test_embedding_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + 0.02 * (i // 60) * rng.normal(size=16)).tolist(), [1, 2, None][i % 60 // 20]) for i in range(300)]
    rows += [(900 + i, rows[5][1], 1) for i in range(4)] + [(950, None, 1), (951, [0.0] * 16, 1), (952, [float("inf")] * 16, 1), (953, [1.0], 1)]
    got = {r.vec_id: r for r in op06_embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    ok = [r for r in rows if r[2] is not None and r[0] not in (950, 951, 952, 953)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in ok}
    pairs = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[:k] if a[2] == b[2] and unit[a[0]] @ unit[b[0]] >= 0.98]
    links, comp = Counter(x for p in pairs for x in p), united(pairs, [r[0] for r in rows])
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], c, c == i) for i, c in comp.items()}
    assert op06_embedding_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_embedding_rows_without_a_key(spark):
    """They link and count like others, and belong to the smallest key that they reach."""
    near = lambda x: [1.0, x]
    rows = [(1, near(0.0)), (None, near(0.1)), (2, near(0.2)), (None, near(0.1)), (5, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.1]), (None, None)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in op06_embedding_dedup.dedup(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")).collect())
    want = [(1, 3, 1, True), (None, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), (5, 0, 5, True), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)]
    assert got == Counter(want)


def test_pivots_meet_nearly_all_pairs(spark):
    """Of pairs at cosine 0.98 exactly, at least 99.5% are candidates."""
    rng = np.random.default_rng(0)
    for n_pivots in (64, 4096):
        p, x, z = (rng.normal(size=(n, 64)) for n in (n_pivots, 3000, 3000))
        p, x = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (p, x))
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        first = lambda v, p=p: np.argsort(-(v @ p.T), axis=1)[:, : op06_embedding_dedup.PREFIX]
        shared = (first(x)[:, :, None] == first(y)[:, None, :]).sum((1, 2))
        assert (shared >= op06_embedding_dedup.SHARED).mean() >= 0.995


def brute_copies(rows, k=3, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    both = Counter((a, b) for ids in at.values() for n, b in enumerate(sorted(ids)) for a in sorted(ids)[:n])
    return sets, united([p for p, c in both.items() if den * c >= num * (len(sets[p[0]]) + len(sets[p[1]]) - c)], sets)


def test_text_copies(spark, tables, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words, 120).tolist() for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(120):  # families whose members differ in a few places, some near the threshold
        t = list(base[i % 4])
        for p in rng.choice(120, i % 5, replace=False):
            t[p] = f"x{rng.integers(1000)}"
        rows.append((100 + i, " ".join(t)))
    monkeypatch.setattr(op07_minhash_dedup, "BLOCK", 8)
    monkeypatch.setattr(op07_minhash_dedup, "LEADERS", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op07_minhash_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, comp = brute_copies(rows)
    assert got == {i: (len(sets[i]), c, c == i) for i, c in comp.items()}
    monkeypatch.undo()
    docs = list(tables["documents"][["doc_id", "text"]].itertuples(index=False, name=None))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op7_minhash_dedup(spark, SF).collect()}
    sets, comp = brute_copies(docs)
    assert got == {i: (len(sets[i]), c, c == i) for i, c in comp.items()}


def test_text_copies_by_row(spark):
    """Keys only name rows: one key may have different texts, and rows without a key are linked like others."""
    t = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(1, t[0]), (5, t[0]), (5, t[1]), (7, t[2]), (7, t[3]), (None, t[1] + " more"), (None, t[3]), (None, "of its own"), (None, "of its own"), (9, None), (None, None), (8, t[3])]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op07_minhash_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, 38, 1, True), (5, 38, 1, False), (5, 38, 5, True), (7, 38, 7, True), (7, 38, 7, True), (None, 39, 5, False), (None, 38, 7, False), (None, 1, None, True), (None, 1, None, True), (9, 0, 9, True), (None, 0, None, True), (8, 38, 7, False)]
    assert got == Counter(want)


def test_text_copies_for_long_shingles(spark):
    """Texts of fewer words than a shingle are one shingle, in order."""
    words = [f"w{i}" for i in range(11)]
    swapped = [words[8], *words[1:8], words[0], *words[9:]]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(swapped)), (4, " ".join(words[:10]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op07_minhash_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=12).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 4)}
    assert op07_minhash_dedup.trees(0.85) == 10 and op07_minhash_dedup.trees(0.8) > 10


def test_text_copies_odd_rows(spark, odd):
    assert op07_minhash_dedup.dedup(odd).count() == odd.count()
    assert op07_minhash_dedup.dedup(odd.limit(0)).count() == 0


def test_packing(spark, odd):
    path = queries.tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            want.update((r.doc_id, i, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes())) for i, s in enumerate(range(0, len(ids), 2048)))
        got = op08_packing.pack_documents(df, path).toPandas()
        assert Counter((None if x[0] != x[0] else int(x[0]), *map(int, x[1:])) for x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
        got = got.sort_values(["sequence_id", "offset"])
        by = got.groupby("sequence_id").length
        assert (by.cumsum() - got.length == got.offset).all() and by.sum().max() <= 2048
        assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 2048 + 2
    assert op08_packing.pack_documents(odd.limit(0), path).count() == 0


def test_best_fit_closes_the_fullest():
    assert op08_packing.pack([6, 5, 4, 5], 10, 8) == ([0, 1, 0, 1], [0, 0, 6, 5])
    assert op08_packing.pack([6, 5, 4, 5], 10, 1) == ([0, 1, 1, 2], [0, 0, 5, 0])


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>x<p>no</p></script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>menu</a></ul></nav><div class="cookie-notice">cookies</div><main><article class="post-12"><h1>Head &amp; more</h1><p>First <b>bold<br>line.<p>Second&nbsp; one
</p><!-- no --><div class="ad-slot">buy</div><form>f</form><ul><li>item one<li>item two</ul></article><section class="comments"><p>reader says</p></section></main>
<aside>side</aside><footer>&copy; foot</footer></body>"""


def test_html(spark, tables):
    rows = [(1, "http://h.example/a", PAGE), (2, "http://h.example/b", None), (3, None, ""), (4, "x", "no tags at all &lt;ok&gt;"), (5, "http://h.example/c", "<nav>menu only</nav>"), (6, "http://h.example/d", PAGE.split("</article>")[0])]
    got = {r.page_id: r.text for r in op09_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "Head & more\nFirst bold line.\nSecond one\nitem one\nitem two"
    assert got == {1: text, 2: "", 3: "", 4: "no tags at all <ok>", 5: "", 6: text}
    pages = queries.op9_html(spark, SF).toPandas()
    assert len(pages) == len(tables["pages"]) and (pages.n_chars == pages.text.str.len()).all() and (pages.n_chars > 0).mean() > 0.95


def test_html_loses_no_readable_text(spark):
    long = "words of the body " * 200
    menu = "<div><a href=/>home</a> <a href=/x>other</a></div>"
    first = f"{menu}<article><h1><a href=/a>Head</a></h1><p>Lede</p><div class=body><p>{long}</p></div></article>"
    second = f"{menu}<div class=body><p>aside</p></div><section><a name=top><p>{long}</p><p>end</p></section>"
    third = f"<article><p>One</p><p><a href=/b>A   &amp;&amp;&amp;   B</a> x</p><table><tr><td>{long}</table></article>"
    rows = [(i, "http://h.example/a", f"<body>{p}</body>") for i, p in enumerate([first, first, second, third])]
    got = {r.page_id: r.text.split("\n") for r in op09_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = ["Head", "Lede", long.strip()]
    assert got[0] == got[1] == want and got[2][-3:] == ["aside", long.strip(), "end"] and got[3] == ["One", "A &&& B x", long.strip()]


def test_html_goes_on_after_open_elements():
    text = lambda page: [t for t, *_ in op09_html.blocks(page)]
    assert text("<p>a<svg class=i /> b</p><p>c</p><svg><text>no</text></svg><p>d") == ["a b", "c", "d"]
    for tag in ("title", "svg", "template"):
        assert text(f"<p>a</p><{tag}><p>b</p>") == ["a", "b"] and text(f"<p>a</p><{tag}>no</{tag}><p>b</p>") == ["a", "b"]


def test_html_time_grows_with_length():
    n = 1 << 20
    pages = ["<" + "a" * n, "<b " * (n // 3), "<b '" * (n // 4) + ">", "<b '>" * (n // 5) + "x", '<b "' + "' > " * (n // 4), "<b " + '"" ' * (n // 3) + ">", "<p title=x>" * (n // 11), "<div>" * (n // 5), "<div>" * (n // 10) + "</ul>" * (n // 10), "<svg>" * (n // 5), "</svg" + " " * n, "<!--" * (n // 4), "<!" * (n // 2), "&amp" * (n // 4), "&" * n, "<a =" + " " * n + ">", "x < y " * (n // 6), "<td><p>a" * (n // 8), "<p>It's</p>" * (n // 11)]
    for page in pages:
        began = time.process_time()
        op09_html.Page(page).vote()
        assert time.process_time() - began < 8, page[:20]  # a machine may be slow; growth with the square takes hours
    assert [t for t, *_ in op09_html.blocks("<p>a < b<p title='x>y'>c<p title='d>e</p>f")] == ["a < b", "c", "e", "f"]


def test_html_votes_overrule_a_page(spark):
    """The host's path counts where a page holds more text elsewhere than the page itself would have left out."""
    article = lambda n, x="": f"<div class='box-{n}'><div class='body'><h1>Head {n}</h1><p>{'text of it ' * 30}</p></div><div class='extra'>{x}</div></div>"
    promo = f"<p>{'longer than one block, but not than the article ' * 6}</p>"
    rows = [(i, "http://h.example/a", article(i)) for i in range(4)] + [(4, "http://h.example/a", article(4, promo)), (5, "http://other.example/a", article(5, promo)), (6, "http://h.example/a", f"<section><p>{'another template ' * 9}</p></section>"), (7, "http://h.example/b", article(7, promo * 9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.host: r.path for r in op09_html.host_paths(pages).collect()}["h.example"] == "div.box-#/div.body"
    got = {r.page_id: r.text.split("\n") for r in op09_html.extract(pages).collect()}
    body = ("text of it " * 30).strip()
    assert all(got[i] == [f"Head {i}", body] for i in range(5)) and got[6] == [("another template " * 9).strip()]
    assert len(got[7]) == 2 + 9  # the host's path holds too little of this page, which keeps all its text


def test_html_keeps_siblings_forms_and_lines(spark):
    intro, body = "an introduction " * 20, "the body of it " * 30
    page = lambda inner: f"<body>{inner}</body>"
    rows = [
        (0, "http://one.example/", page(f"<div class=p><div class=intro><p>{intro}</p></div><div class=content><h1>Head</h1><p>{body}</p></div><div class=more><a href=/a>x</a> <a href=/b>y</a></div></div>")),
        (1, "http://form.example/", page(f"<form><div class=c><h1>Head</h1><p>{body}</p><fieldset><p>{intro}</p></fieldset><label>Name</label><input><button>Go</button></div></form><form><p>find</p></form>")),
        (2, "http://line.example/", page("<p>Press <button>Save</button> now, <label>or <b>not</b></label>later <select><option>1</select>on.</p><p>End <button>open<p>next</p>")),
        *((i, "http://many.example/", page(f"<div class=c><p>{body} {i}</p></div><div class=promo><p>the same on all pages</p></div><div class=note><p>only on page {i}</p></div>")) for i in range(3, 7)),
    ]
    got = {r.page_id: r.text.split("\n") for r in op09_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    intro, body = intro.strip(), body.strip()
    assert got[0] == [intro, "Head", body] and got[1] == ["Head", body]
    assert got[2] == ["Press now, later on.", "End", "next"] or got[2] == ["Press now, later on.", "End"]
    assert all(got[i] == [f"{body} {i}", f"only on page {i}"] for i in range(3, 7))


def test_html_names_do_not_empty_an_article(spark):
    rows = [(1, "http://a.example/", "<article><div class='content widget'><p>all of the text</p></div></article>"), (2, "http://b.example/", "<article class=notice><p>the text lies here</p><div class=ad>buy</div></article>"), (3, "http://c.example/", "<article><p>Short.</p></article><div class=ad>longer than the text itself</div>")]
    got = {r.page_id: r.text for r in op09_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "all of the text", 2: "the text lies here", 3: "Short."}


def test_html_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "<p>x", "own", 9, "p")], "page_id long, url string, html string, text string, `_host` long, `path` string")
    got = op09_html.extract(df, keep=("page_id", "html", "text", "_host", "path")).first().asDict()
    assert got == {"page_id": 1, "html": "<p>x", "_host": 9, "path": "p", "text": "x", "n_chars": 1}


def test_html_of_all_pages(spark, tables):
    """The given pages hold one article each, all of whose blocks are the text, and nothing else is."""
    for r in queries.op9_html(spark, SF).collect():
        page = tables["pages"].set_index("page_id").html[r.page_id] or ""
        own = "".join(re.findall(r"(?s)<article>(.*?)</article>", page))
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?[a-z]+\b[^>]*>", lambda m: m[0] if m[0] == "<br>" else "", b))).split()) for b in re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|table|tr|td|blockquote|pre|section)\b[^>]*>", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", own))]
        assert r.text == "\n".join(b for b in blocks if b), r.page_id


def test_mixing(spark, tables, odd):
    got = queries.op10_mixing(spark, SF).toPandas().merge(tables["documents"], on="doc_id")
    assert got["size"].tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in got.text]
    by = got.groupby("source")
    assert (by.taken.sum() - by.target.first()).abs().max() <= by["size"].max().max() / 2 + 1
    assert by.target.first().sum() == pytest.approx(1.5 * got["size"].sum()) and (got.taken <= 2 * got["size"]).all()
    rows = op10_mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    assert op10_mixing.mix(odd.limit(0)).count() == 0
    times = Counter(r.doc_id for r in op10_mixing.mixed(odd).collect())
    assert all(times[r.doc_id] == r.taken // r["size"] for r in rows if r["size"] and r.doc_id != 4)


def test_targets():
    got = op10_mixing.targets([("b", 100), ("a", 10), (None, 50), ("c", 40)])
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(300) and all(got[s] <= 2 * n for s, n in [("a", 10), ("b", 100), ("c", 40), (None, 50)])


def test_pipeline(spark, tables):
    """Each stage against a plainer version of it on its own input."""
    import corpus_pipeline
    from lodestone.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows_of = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        seen[name] = docs.count()
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "language":
            model = op01_language_id.Model(*op01_language_id.fit(before, F.col("text"), F.col("lang"), F.col("doc_id")))
            bits = model.bits([(t or "").encode() for _, t in rows])
            share = 1 / (2.0 ** (bits.min(axis=1, keepdims=True) - bits).clip(-1000)).sum(axis=1)
            assert rows_of(docs) == Counter(r for r, p in zip(rows, share, strict=True) if p >= 0.5 and re.search(r"[^\W\d_]", r[1] or ""))
        if name == "quality":
            model = op05_quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert rows_of(docs) == Counter(r for r, p in zip(rows, model.score(op05_quality.features([t or "" for _, t in rows])), strict=True) if p >= 0.5)
        if name == "near_copies":
            comp = brute_copies(rows, 5, 80)[1]
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(i for i, c in comp.items() if i == c)
        if name == "mixture":
            sizes = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0D]+", r.text)), r.source, r.text) for r in before.collect()}
            by = Counter()
            for n, s, _ in sizes.values():
                by[s] += n
            goal, taken, got = op10_mixing.targets(list(by.items())), Counter(), rows_of(docs)
            for (i, t), times in got.items():
                assert t == sizes[i][2] and times <= 2
                taken[sizes[i][1]] += times * sizes[i][0]
            assert all(abs(taken[s] - goal[s]) <= max(n for n, s2, _ in sizes.values() if s2 == s) / 2 + 1 for s in by)
        if name == "packing":
            tok, want = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json")), Counter()
            for i, t in rows:
                n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
                want.update((i, a, min(2048, n - a)) for a in range(0, n, 2048))
            assert Counter((r.doc_id, r.start, r.length) for r in docs.collect()) == want
    assert 0 < seen["near_copies"] < seen["quality"] < seen["language"] <= 200 and seen["quality"] > 0.7 * len(tables["documents"])


def test_pipeline_loses_no_text(spark):
    """Rows that repeat a key but not its text, and rows without a key, stay unless they are copies."""
    import corpus_pipeline

    t = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(1, t[0]), (5, t[0]), (5, t[1]), (7, t[2]), (7, t[3]), (None, t[3]), (None, t[4]), (None, t[4]), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, SF).collect())
    assert got == Counter([(1, t[0]), (5, t[1]), (7, t[2]), (7, t[3]), (None, t[4]), (9, None), (9, None)])
    # The tables that stages make on the way are deleted; the result's own is not.
    from lodestone import session

    with session.scratch() as made:
        out = corpus_pipeline.run(spark, SF)
        left = [m for m in made if spark._jvm.org.apache.hadoop.fs.Path(m._written_to).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(m._written_to))]
    assert [m._written_to for m in left] == [out._written_to] and out.count()


def test_pipeline_odd_rows(spark, odd):
    import corpus_pipeline

    docs = odd.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS LONG) AS n_chars", "path AS lang_pred")
    docs = docs.unionByName(docs.where("doc_id IS NULL").withColumn("text", F.lit("another text without a key")))
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    assert kept.count(None) == 2 and kept.count(4) == 1 and 5 not in kept and set(range(len(TEXTS))) - {5} <= {*kept, 4}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert stage(spark, docs, SF).count() >= 0, name
