"""Stored indexes, answers end to end, evaluation, sweeps, markdown against brute force, coverage and gold checks."""

import hashlib
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import functions as L
from lodestone import plans
from lodestone import sources as S
from lodestone.operators import answers as A
from lodestone.operators import chunking as C
from lodestone.operators import corpus, experiments, indexing
from lodestone.operators import retrieval as R

SF = "/root/testdata/sf0.001"
FENCE = r"^[^\S\n]*```.*?(?:^[^\S\n]*```[^\n]*$|\Z)"


def brute_paragraphs(text):
    return [m.strip("\n") for m in re.findall(rf"(?ms){FENCE}|(?:^(?![^\S\n]*```)[^\n]*\S[^\n]*(?:\n|\Z))+", text)]


def brute_sections(text):
    masked = re.sub(rf"(?ms){FENCE}", lambda m: re.sub(r"[^\n]", "x", m[0]), text)
    heads = [(m.start(), len(m[1]), m[2].strip()) for m in re.finditer(r"(?m)^(#{1,3})\s+(.*)$", masked)]
    cuts = sorted({0, *(h[0] for h in heads)})
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        path = {}
        for at, depth, name in heads:
            if at <= a:
                path = {d: n for d, n in path.items() if d < depth} | {depth: name}
        if text[a:b].strip():
            yield [path[d] for d in sorted(path)], text[a:b].strip()


def brute_parts(text, size, overlap):
    for path, body in brute_sections(text):
        if len(body) <= size:
            yield path, body
            continue
        own = []
        for p in brute_paragraphs(body):
            whole = "\n\n".join(own).strip()
            if not own and len(p) > size:
                at = 0
                while True:
                    yield path, p[at : at + size].strip()
                    if at + size >= len(p):
                        break
                    at += size - overlap
            elif own and len(whole) + 2 + len(p) > size:
                yield path, whole
                tail = whole[max(0, len(whole) - overlap) :].strip()
                own = [x for x in (tail, p) if x]
            else:
                own.append(p)
        if own:
            yield path, "\n\n".join(own).strip()


def made_markdown(seed):
    rng = np.random.default_rng(seed)
    words = lambda: " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(1, 30)))
    kinds = [lambda: words() + "\n", lambda: "\n", lambda: f"{'#' * rng.integers(1, 6)} {words()[:20]}\n", lambda: f"  ```py\n{words()}\n\n# x\n", lambda: "```\n", lambda: " " * 30 + words() + "  \n", lambda: "y" * rng.integers(50, 300) + "\n\n"]
    return "".join(kinds[k]() for k in rng.choice(len(kinds), 25, p=[0.35, 0.25, 0.1, 0.08, 0.08, 0.08, 0.06]))


@pytest.mark.parametrize("seed", range(60))
def test_markdown_against_brute_force(seed):
    text = made_markdown(seed)
    assert C.sections(text) == list(brute_sections(text)) and C.paragraphs(text) == brute_paragraphs(text)
    for size, overlap in ((120, 20), (60, 0), (300, 90)):
        got = [(h, s) for h, body in C.sections(text) for p in C.pack(body, size, overlap) if (s := p.strip())]
        assert got == [(h, s.strip()) for h, s in brute_parts(text, size, overlap) if s.strip()]


def test_packing_of_all_turns_against_brute_force(spark):
    got = Counter((r.conv_id, r.turn, r.i, r.heading, r.text) for r in plans.queries()["fence_safe_packing"](spark, SF).collect())
    want = Counter()
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        t = r.text or ""
        text = f"# conversation {r.conv_id}\n## turn {r.turn}\n{t}\n\n```text\n{t[:300]}\n\n# no heading\n```\n{t}"
        want.update((r.conv_id, r.turn, i, " > ".join(h), s) for i, (h, s) in enumerate((h, p.strip()) for h, p in brute_parts(text, 600, 80) if p.strip()))
    assert got == want


def test_overlap_tail_is_stripped_or_left_out():
    blank = "x" * 50 + " " * 40
    assert C.pack(f"{blank}\n\n{'z' * 60}\n\n{'v' * 30}", 100, 20)[1:] == [f"{'x' * 20}\n\n{'z' * 60}", f"{'z' * 20}\n\n{'v' * 30}"]


def test_excerpts():
    fence = "```sh\n" + "run it now\n" * 90 + "```"
    assert len(A.excerpt_of(f"{fence}\nrest")) <= A.EXCERPT + 1 and A.excerpt_of(f"{fence}\nrest").endswith("…")
    assert A.excerpt_of("  ## Head\n\n---- rule\n --- x\n#### Four\n- item\n") == "Head\nFour\n- item"
    assert A.excerpt_of("```\n" + "a \n" * 20) == "```\n" + "a\n" * 6 + "a" and A.excerpt_of("") == ""
    lines = [f"line {i} " + "x" * 60 for i in range(20)]
    kept = A.excerpt_of("\n".join(lines)).split("\n")
    assert kept[0] == lines[0] and kept[-1].endswith("…")
    assert A.excerpt_of("\n".join(lines[:3])) == "\n".join(lines[:3])


def test_hash_embeddings_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.embedding for r in plans.queries()["hash_embed"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        seed = int(hashlib.sha256((t or "").encode()).hexdigest()[:16], 16).to_bytes(8, "big")[:4]
        v = np.random.default_rng(int.from_bytes(seed, "little")).standard_normal(16).astype(np.float32)
        assert np.allclose(got[i], v / np.linalg.norm(v), atol=1e-6)


def test_embedders(spark, tmp_path):
    assert R.create_embedder("hash", dim=8).dim == 8 and R.create_embedder("st", "name", 4).model_name == "name"
    with pytest.raises(ValueError):
        R.create_embedder("other")
    sent = []
    e = R.SentenceEmbedder("name", 2)
    e._model = type("M", (), {"encode": lambda self, texts, **k: sent.extend(texts) or np.ones((len(texts), 2))})()
    assert e.passages(["a"]).dtype == np.float32 and e.queries(["b"]).shape == (1, 2) and sent == ["passage: a", "query: b"]
    path = str(tmp_path / "e")
    assert indexing.load_embeddings(spark, path).count() == 0
    chunks = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "chunk_id string, text string, content_hash string")
    indexing.write_embeddings(R.embed_incremental(chunks, indexing.load_embeddings(spark, path), R.HashEmbedder(8)), path)
    again = R.embed_incremental(chunks, indexing.load_embeddings(spark, path), R.HashEmbedder(8))
    meta = spark.read.json(f"{path}/meta").first()
    assert all(r.reused for r in again.collect()) and (meta.model_name, meta.dim, meta["count"], meta.normalized) == ("hash-8", 8, 2, True)


CHUNKS = [("a::0000", "a", "wiki", "t1", "Alpha beta. How to alpha."), ("a::0001", "a", "wiki", "t1", "# Alpha\n---\ngamma"), ("b::0000", "b", "wiki", "t2", "beta beta delta"), ("c::0000", "c", "old", "t1", "   "), ("d::0000", "d", "old", "t2", "no vector alpha")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    chunks = spark.createDataFrame([(*c[:4], "open", "p0", [c[1].upper()], c[4]) for c in CHUNKS], "id string, doc_id string, source_id string, team string, acl string, priority string, heading_path array<string>, text string")
    vectors = spark.createDataFrame([("a::0000", [1.0, 0.0]), ("a::0001", [0.8, 0.6]), ("b::0000", [0.0, 1.0]), ("c::0000", [-1.0, 0.0])], "id string, vector array<double>")
    path = str(tmp_path_factory.mktemp("index") / "own")
    with pytest.raises(ValueError):
        indexing.write_index(chunks.where("id <> 'b::0000'"), vectors, path)
    indexing.write_index(chunks, vectors, path, model="none")
    return indexing.load_index(spark, path)


def test_stored_index(index):
    report = indexing.build_report(index).first()
    assert (report.n_chunks, report.n_vectors, report.dim) == (4, 4, 2) and index.meta.where("id = 'd::0000'").count() == 0
    postings = {(r.term, r.id): (r.tf, r.dl) for r in index.lexical.postings.collect()}
    assert postings[("alpha", "a::0000")] == (1, 5) and postings[("alpha.", "a::0000")] == (1, 5) and postings[("beta", "b::0000")] == (2, 3)
    assert report.vocabulary == len({t for t, _ in postings}) and {r.term: r.df for r in index.lexical.terms.collect()}["beta"] == 1


def test_lexical_scores_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = {i: " ".join(f"t{min(int(x), 40)}" for x in rng.zipf(1.3, rng.integers(0, 60))) for i in range(150)} | {150: "", 151: None}
    asked = {i: " ".join(f"t{x}" for x in rng.integers(0, 45, 8)) + " T1 t1" for i in range(12)} | {12: "nothing", 13: None}
    docs, queries = spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame(list(asked.items()), "query_id long, question string")
    words = {i: Counter((t or "").split()) for i, t in texts.items()}
    n, avg = len(words), sum(map(Counter.total, words.values())) / len(words)
    df = Counter(w for c in words.values() for w in c)
    score = lambda q, c: sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / avg)) for w in q.lower().split() if c[w])
    want = {(q, i): s for q, t in asked.items() for i, c in words.items() if (s := score(t or "", c)) > 0}
    monkeypatch.setattr(R, "PRODUCTS", 200)
    for block in (1024, 5):
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        got = {(r.query_id, r.id): r.score for r in R.lexical_scores(R.build_lexical(docs, "id"), queries).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        best = {(r.query_id, r.id) for r in R.lexical_scores(R.build_lexical(docs, "id"), queries, 4).collect()}
        assert best == {(q, i) for q in asked for s, i in sorted((-round(s, 9), i) for (q2, i), s in want.items() if q2 == q)[:4]}
    assert R.lexical_scores(R.build_lexical(docs.limit(0), "id"), queries).count() == 0 == R.lexical_scores(R.build_lexical(docs, "id"), queries.limit(0), 3).count()


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([("a", "docs/a.md")], "doc_id string, path string"), spark.createDataFrame([("wiki", "https://wiki.example/")], "source_id string, location string")


def test_ask_end_to_end(spark, index, places):
    queries = spark.createDataFrame([(1, "How to alpha?", [1.0, 0.0]), (2, "What is the password?", [1.0, 0.0]), (3, "alpha", [0.05, 0.05]), (4, " ", [1.0, 0.0])], "query_id long, question string, vector array<double>")
    got = {r.query_id: r for r in experiments.ask(index, queries, *places).collect()}
    assert {i: r.refuse_reason for i, r in got.items()} == {1: None, 2: "secret", 3: "low_confidence", 4: "empty_query"}
    first = got[1]
    assert first.answer.startswith(f"{A.LEAD}\n\n**A** [1]\nAlpha beta. How to alpha.") and "gamma" in first.answer and "---" not in first.answer
    assert first.citations[0].path == "docs/a.md" and first.citations[0].url == "https://wiki.example#a" and first.n_citations == 4 and first.confidence == pytest.approx(1)
    # A refusal comes after retrieval: it lists the nearest documents, each once.
    assert [c.doc_id for c in got[2].citations] == ["a", "b", "c"] and got[2].answer.startswith(A.MESSAGES["secret"]) and f"{A.NEAREST_LEAD}\n- [1] docs/a.md\n- [2] corpus/wiki/b.md" in got[2].answer
    none = experiments.ask(index, queries, *places, team="nobody").collect()
    assert {r.query_id: r.refuse_reason for r in none} == {1: "empty_retrieval", 2: "secret", 3: "empty_retrieval", 4: "empty_query"} and all(r.n_citations == 0 for r in none)
    mine = experiments.ask(index, queries, *places, team="t2", least=0.0).collect()
    assert {c.doc_id for r in mine for c in r.citations or []} == {"b"}  # nothing else leaks


def test_generation_backends(spark, index, places):
    queries = spark.createDataFrame([(1, "How to alpha?", [1.0, 0.0])], "query_id long, question string, vector array<double>")
    run = lambda **o: experiments.ask(index, queries, *places, **o).first().answer
    assert run(backend="llm", make_client=lambda: lambda ps: [f" {len(p) > 0 and p.count('doc_id=')} of {p.split('QUESTION:')[1].split()[0]} " for p in ps]) == "4 of How"
    with pytest.raises(ValueError):
        run(backend="other")
    with pytest.raises(RuntimeError):
        run(backend="openai")
    blank = spark.createDataFrame([(1, 1, "c::0", "c", ["C"], "  \n---\n")], "query_id long, index long, chunk_id string, doc_id string, heading_path array<string>, text string")
    assert A.extractive(blank).first().answer == A.NO_TEXT


def test_citation_and_grounding_rules(spark):
    c = "array<struct<doc_id:string,path:string>>"
    rows = [(True, "empty_query", None, ["a"]), (True, "secret", None, ["a"]), (False, None, [], ["a"]), (False, None, [("a", "p"), ("b", "")], ["a"]), (False, None, [("b", "p")], ["a"]), (False, None, [("b", "p")], []), (False, None, [("a", "p")], ["a"])]
    df = spark.createDataFrame(rows, f"refuse boolean, why string, cited {c}, relevant array<string>")
    got = df.select(A.citation_ok(F.col("refuse"), F.col("why"), F.col("cited")).alias("c"), A.grounded_ok(F.col("refuse"), F.col("cited"), F.col("relevant")).alias("g")).collect()
    assert [(r.c, r.g) for r in got] == [(True, True), (False, True), (False, False), (False, True), (True, False), (True, True), (True, True)]


def test_sweeps_winners_and_report(spark, index, places):
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "beta", [0.6, 0.8]), (3, "delta password", [0.0, 1.0])], "query_id long, question string, vector array<double>")
    relevant = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "query_id long, doc_id string")
    runs = experiments.retrieval_sweep(index, queries, relevant)
    assert {r.run: (r.n, r.recall_at_10) for r in runs.collect()} == {"hybrid": (3, 1.0), "dense": (3, 1.0), "bm25": (3, 1.0)} and experiments.best_retrieval(runs).count() == 1
    cases = spark.createDataFrame([(1, "answer", ["a"]), (2, "answer", ["b"]), (3, "refuse", [])], "query_id long, expected_behavior string, relevant_doc_ids array<string>")
    asked = experiments.ask_sweep(index, queries, cases, *places, least=(0.5, 2.0), top_ks=(3, 5))
    got = {(r.min_dense, r.top_k): r for r in asked.collect()}
    assert len(got) == 4 and all(r.refuse_rate == 1 for r in got.values())
    assert got[0.5, 5].answered_rate == 1 and got[2.0, 3].answered_rate == 0 == got[2.0, 3].grounded_among_answered and got[2.0, 3].answer_refuse_rate == 1
    one = A.ask_rates(A.ask_cases(experiments.ask(index, queries, *places, least=0.5), cases)).first()
    assert (one.refuse_rate, one.grounded_rate, one.citation_contract_ok) == (got[0.5, 5].refuse_rate, got[0.5, 5].grounded_rate, got[0.5, 5].citation_contract_ok)
    assert (experiments.best_ask(asked).first().min_dense, experiments.best_ask(asked).first().top_k) == (0.5, 3)
    text = experiments.report(runs, asked)
    assert text.count("\n| ") == 2 + 3 + 4 and "- answers: **extractive:0.5:3**" in text
    empty = A.ask_rates(A.ask_cases(experiments.ask(index, queries, *places), cases.limit(0))).first()
    assert (empty.refuse_rate, empty.citation_contract_rate, empty.grounded_rate, empty.answered_rate) == (1.0, 0.0, 1.0, 1.0)


def test_a_sweep_of_many_thresholds_shuffles_no_more(spark, index, places):
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "beta", [0.6, 0.8]), (3, "", [0.0, 1.0]), (4, "gamma", None)], "query_id long, question string, vector array<double>")
    cases = spark.createDataFrame([(1, "answer", ["a"]), (2, "answer", ["b"]), (3, "refuse", []), (4, "answer", ["zz"])], "query_id long, expected_behavior string, relevant_doc_ids array<string>")
    many = [0.0, *(i / 20 for i in range(1, 30))]
    few, all_ = (experiments.ask_sweep(index, queries, cases, *places, least=tuple(s), top_ks=(3, 5)) for s in (many[:2], many))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(few) == exchanges(all_)
    rows = {(r.min_dense, r.top_k): r for r in all_.collect()}
    assert len(rows) == 60
    for least in (0.0, 0.95, 1.0, 1.05):
        one = A.ask_rates(A.ask_cases(experiments.ask(index, queries, *places, least=least), cases)).first()
        got = rows[least, 5]
        assert all(got[c] == pytest.approx(one[c]) for c in ("n_refuse", "n_answer", "refuse_rate", "citation_contract_rate", "grounded_rate", "answered_rate", "answer_refuse_rate", "grounded_among_answered"))


@pytest.mark.parametrize("mode", ["hybrid", "dense"])
def test_cases_are_judged_without_words_texts_or_answers(spark, index, places, mode):
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "beta", [0.6, 0.8]), (3, "", [0.0, 1.0]), (4, "gamma", None)], "query_id long, question string, vector array<double>")
    cases = spark.createDataFrame([(1, "answer", ["a"]), (2, "answer", ["b"]), (3, "refuse", []), (4, "answer", ["zz"])], "query_id long, expected_behavior string, relevant_doc_ids array<string>")
    own = index if mode == "hybrid" else replace(index, lexical=None)
    for least in (0.5, 1.05):
        want = A.ask_cases(experiments.ask(index, queries, *places, mode=mode, least=least), cases)
        got = experiments.ask_cases(own, queries, cases, *places, mode=mode, least=least)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_scopes_and_counts(spark):
    catalog = spark.createDataFrame([("a", "p0"), ("b", "p1"), ("c", "exclude"), ("d", None)], "source_id string, priority string")
    scoped = corpus.in_scope(catalog, ("p0", "exclude"))
    assert [r.source_id for r in scoped.collect()] == ["a"]
    manifest = spark.createDataFrame([("a",), ("a",), ("b",), ("z",), (None,)], "source_id string")
    assert corpus.scope_counts(manifest, scoped).first().asDict() == {"total": 5, "in_scope": 2, "skipped": 3} and corpus.scope_counts(manifest.limit(0), scoped).first()["total"] == 0
    assert [(r.source_id, r.n) for r in corpus.counts_by_source(manifest).collect()] == [(None, 1), ("a", 2), ("b", 1), ("z", 1)]


def test_gold_selection_and_warnings(spark):
    item = lambda i, behavior, relevant, primary, priority: (i, "A question?", "how-to", behavior, relevant, primary, ["wiki"], priority, None, None, None, "en")
    gold = spark.createDataFrame([item("q-1", "answer", ["a", "b"], "a", "p0"), item("q-2", "refuse", ["x"], None, "p0"), item("q-3", "answer", [], "c", "p0"), item("q-4", "answer", None, None, "p0"), item("q-5", "answer", ["d"], "", "p1"), item("q-6", None, ["e"], None, "p0")], S.GOLD)
    names = lambda df, c: sorted(r[c] for r in df.collect())
    assert names(corpus.priority_documents(gold), "doc_id") == ["a", "b", "c", "e"] and names(corpus.gold_documents(gold), "doc_id") == ["a", "b", "c", "d", "e", "x"]
    assert names(corpus.eval_cases(gold), "id") == ["q-1"] and names(corpus.eval_cases(gold, None, None), "id") == ["q-1", "q-2", "q-5", "q-6"]
    asked = corpus.ask_cases(gold, ("p0", "p1"), 1, order="id").orderBy("part", "id").collect()
    assert [(r.id, r.part) for r in asked] == [("q-2", 0), ("q-1", 1)]
    assert corpus.gold_warnings(gold).first().warnings == ["few items", "few types"]
    lines = spark.createDataFrame([('{"id": 1, "extra": 2}',), ('{"id": 1}',), ("no object",)], "value string")
    assert [r.unknown for r in corpus.unknown_keys(lines).collect()] == [["extra"], [], None]


def test_gold_errors_of_missing_and_blank_fields(spark):
    base = {"id": "q-1", "question": "A question?", "query_type": "how-to", "expected_behavior": "answer", "relevant_doc_ids": ["a"], "primary_doc_id": "a", "source_ids": ["wiki"], "source_priority": "p0", "reference_answer": None, "notes": None, "tags": None, "language": "en"}
    changes = [({}, set()), ({"id": "q-2", "primary_doc_id": None}, {"no primary document"}), ({"id": "q-3", "relevant_doc_ids": None}, {"missing relevant_doc_ids", "primary not relevant"}), ({"id": "q-4", "relevant_doc_ids": ["a", " "]}, {"blank relevant document"}), ({"id": "q-5", "question": "  Why  ", "source_priority": "p9", "language": "fr"}, {"short question", "bad source_priority", "bad language"}), ({"id": "q-6", "expected_behavior": "refuse", "relevant_doc_ids": [], "primary_doc_id": None, "source_ids": None, "language": None}, set()), ({"id": None, "query_type": None}, {"missing id", "missing query_type"}), ({"id": "q-7", "source_ids": ["wiki", "x"]}, {"unknown source"})]
    gold = spark.createDataFrame([tuple((base | c).values()) for c, _ in changes] * 2, S.GOLD)
    got = Counter((r.id, frozenset(r.errors)) for r in corpus.gold_errors(gold, spark.createDataFrame([("wiki",), ("wiki",)], "source_id string")).collect())
    assert got == Counter({((base | c)["id"], frozenset(e)): 2 for c, e in changes})


def test_coverage_and_chunk_errors(spark):
    catalog = spark.createDataFrame([("wiki", ["a", "b"])], "source_id string, sample_doc_ids array<string>")
    gold = spark.createDataFrame([("q-1", ["b", "c"], "d", ["wiki", "else"])], "id string, relevant_doc_ids array<string>, primary_doc_id string, source_ids array<string>")
    manifest = spark.createDataFrame([("a", "corpus/wiki/a.md"), ("b", "corpus/wiki/b.md")], "id string, path string")
    files = spark.createDataFrame([("a", "wiki/a.md"), ("c", "wiki/c.md")], "stem string, tail string")
    got = sorted((r.gap, r.id) for r in corpus.coverage_gaps(catalog, gold, manifest, files).collect())
    assert got == [("not in the manifest", "c"), ("not in the manifest", "d"), ("not on disk", "b"), ("not on disk", "d"), ("path without a file", "corpus/wiki/b.md"), ("source not in the catalog", "else")]
    row = ("a::0", "a", "s", 0, "t", ["h"], 1, "acl", "t", "p0", "en", "x")
    chunks = spark.createDataFrame([row, ("b::0", "b", None, None, *row[4:]), ("c::0", *row[1:5], None, *row[6:])], S.CHUNK)
    assert [(r.chunk_id, r.error) for r in corpus.chunk_errors(chunks).collect()] == [("b::0", "missing source_id"), ("c::0", "missing heading_path")]
    docs, ids = spark.createDataFrame([("a",), ("b",), ("z",)], "doc_id string"), spark.createDataFrame([("a",), ("gone",)], "doc_id string")
    gate = corpus.quality_gate(docs, chunks, ids).first()
    assert (gate.docs_with_chunks, gate.orphans, gate.missing_gold, gate.incomplete, gate.ok) == (2, 1, 1, 2, False)
    good = corpus.quality_gate(docs.where("doc_id = 'a'"), chunks.where("chunk_id = 'a::0'"), ids, priorities=("p1",)).first()
    assert good.ok and good.missing_gold == 0


def test_readers_reports_and_ids(spark, tmp_path):
    doc = ("a", "s", "T", "p/a.md", "text", "en", "open", "t", "p0", ["x"], "sha256:0", 4, "2024-01-01")
    S.write_json_lines(spark.createDataFrame([doc], S.DOCUMENT), str(tmp_path / "d"))
    docs = S.read_documents(spark, str(tmp_path / "d"))
    assert tuple(docs.first()) == doc and S.document_paths(docs).first().path == "p/a.md"
    (tmp_path / "g.jsonl").write_text('{"id": "q-1", "question": "Why?"}\n\n{"id": "q-2", "relevant_doc_ids": ["a"]}\n')
    assert [(r.id, r.relevant_doc_ids) for r in S.read_gold(spark, str(tmp_path / "g.jsonl")).collect()] == [("q-1", None), ("q-2", ["a"])]
    assert S.report(docs.selectExpr("count(*) AS n", "named_struct('é', 1) AS s")) == '{\n  "n": 1,\n  "s": {\n    "é": 1\n  }\n}'
    catalog = spark.createDataFrame([("a", "x://y"), ("b", ""), ("c", None)], "source_id string, location string")
    assert [r.source_id for r in S.source_locations(catalog).collect()] == ["a"]
    ids = spark.createDataFrame([(" x ",), ("y" * 200,), ("",), (None,)], "h string").select(L.request_id(F.col("h")).alias("i")).collect()
    assert [r.i for r in ids[:2]] == ["x", "y" * 128] and all(len(r.i) == 36 for r in ids[2:])
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(L.normalized(F.col("v")).alias("u")).collect()
    assert [r.u for r in unit] == [[0.6, 0.8], [0.0, 0.0]]
