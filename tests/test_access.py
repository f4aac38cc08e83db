"""Access masks against plain filters, and what restricted searches leave unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import access
from lodestone.operators import cells as K
from lodestone.operators import inverted as I
from lodestone.operators import retrieval as R

N = 700
FILTERS = [{"team": "a"}, {"team": "b", "acl": "x"}, {"team": "a", "acl": "y", "priority": "p0"}, {"team": "once"}, {"team": "none"}, {"team": "a", "acl": "nowhere"}, {"colour": "red"}]


@pytest.fixture(scope="module")
def meta(spark):
    """Everyone of team a, but for some; a value that one document has; nulls; a repeated row; a document unknown here."""
    rows = [(i, "once" if i == 333 else None if i % 10 == 3 else "b" if i % 5 == 0 or i < 100 else "a", "x" if i % 3 else "y", "p0" if i % 2 else None) for i in range(N - 1)]
    return spark.createDataFrame([*rows, rows[4], (9999, "a", "x", "p0")], "id long, team string, acl string, priority string")


@pytest.fixture(scope="module")
def words(spark, meta, tmp_path_factory):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"t{min(int(x), 40)}" for x in rng.zipf(1.4, rng.integers(0, 40)))) for i in range(N - 1)] + [(N - 1, None)]
    docs = spark.createDataFrame(texts, "id long, text string").coalesce(2)
    lexical = R.build_lexical(docs, "id")
    path = tmp_path_factory.mktemp("words")
    index = I.write_inverted(lexical, str(path / "i"), width=100)
    return lexical, index, access.write_masks(access.masks(index.members, meta, "range", ("team", "acl", "priority")), str(path / "m"))


@pytest.fixture(scope="module")
def vectors(spark, meta, tmp_path_factory):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 6)) * 4
    # Vectors of a neighbourhood share a team, as documents of one team are alike.
    x = centres[np.arange(N) * 20 // N] + 0.1 * rng.standard_normal((N, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    path = tmp_path_factory.mktemp("vectors")
    index = K.write_cells(df, str(path / "i"))
    return df, index, access.write_masks(access.masks(index.cells, meta, "cell", ("team", "acl", "priority")), str(path / "m"))


def plain(meta, filters):
    return meta.where(F.lit("colour" not in filters)).where(" AND ".join(f"{k} = '{v}'" for k, v in filters.items() if k != "colour") or "true").select("id").distinct()


def rows_of(df):
    return {(r.query_id, r.id): round(r.score, 9) for r in df.collect()}


QUESTIONS = [(0, "t1"), (1, "t7 t9 t40"), (2, "t39 t2"), (3, ""), (4, None), (5, "unknown")]


@pytest.mark.parametrize(("filters", "k"), [*((f, 12) for f in FILTERS[:3]), *((f, 1) for f in FILTERS[1:])])
def test_words(spark, words, meta, filters, k):
    lexical, index, stored = words
    queries = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    only = R.LexicalIndex(lexical.documents.join(plain(meta, filters), "id", "left_semi"), lexical.terms, lexical.stats)
    assert rows_of(I.search_blocks(I.restricted(index, access.allowed(stored, **filters)), queries, k)) == rows_of(R.lexical_scores(only, queries, k))


@pytest.mark.parametrize("filters", FILTERS)
def test_vectors(spark, vectors, meta, filters):
    df, index, stored = vectors
    queries = df.where("id % 50 = 0").selectExpr("id AS query_id", "vector")
    got = K.search_cells(K.restricted(index, access.allowed(stored, **filters)), queries, 5)
    assert rows_of(got) == rows_of(R.dense_scores(df.join(plain(meta, filters), "id", "left_semi"), queries, 5))


def test_masks_are_members(words, meta):
    _, index, stored = words
    members = {r["range"]: r.ids for r in index.members.collect()}
    assert sorted(i for ids in members.values() for i in ids) == list(range(N))
    got = {(r.field, r.value, members[r["range"]][s]) for r in stored.collect() for s in range(64 * len(r.mask)) if r.mask[s // 64] >> (s % 64) & 1}
    known = {r.id: r for r in meta.where(f"id < {N}").collect()}
    assert got == {(f, r[f], i) for i, r in known.items() for f in ("team", "acl", "priority") if r[f] is not None}
    assert {(r.field, r.value): r.n for r in access.allowed_counts(stored).collect()} == {(f, v): sum(r[f] == v for r in known.values()) for f, v, _ in got}


def test_no_filter_is_none(words):
    _, index, stored = words
    assert access.allowed(stored) is None and access.allowed(stored, team="", acl="") is None and I.restricted(index, None) is index


def test_groups_without_allowed_members_stay_unread(spark, words, vectors):
    _, index, stored = words
    queries = spark.createDataFrame([(0, "t1")], "query_id long, question string")
    few = access.allowed(stored, team="once")
    assert few.count() == 1
    assert I.blocks_read(I.restricted(index, few), queries, 5).first().blocks == 1 < I.blocks_read(index, queries, 5).first().blocks
    df, index, stored = vectors
    cut = K.restricted(index, access.allowed(stored, team="once"))
    assert cut.bounds.count() == 1 < index.bounds.count()


def test_searches_join_no_ids_and_masks_are_pruned(words, spark):
    _, index, stored = words
    allow = access.allowed(stored, team="a", acl="x")
    cut = I.restricted(index, allow)
    plan = cut.blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Join Inner, (range#" in plan
    scan = stored.where("field = 'team' AND value = 'a'")._jdf.queryExecution().toString()
    assert "EqualTo(field,team)" in scan and "EqualTo(value,a)" in scan


def test_empty(spark, meta, words, tmp_path):
    _, index, _ = words
    none = access.write_masks(access.masks(index.members, meta.where("false"), "range", ("team",)), str(tmp_path / "m"))
    assert none.count() == 0 and access.allowed(none, team="a").count() == 0
