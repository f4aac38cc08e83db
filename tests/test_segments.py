"""An index after changes equals one that is built anew; snapshots are whole, pinned and in order."""

import os
import threading
from collections import Counter

import pytest

from lodestone.operators import inverted, retrieval, segments as S

CHANGES = [
    ([(1, "alpha beta"), (2, "beta beta gamma"), (3, None), (4, "same text"), (4, "same text"), (None, "no id")], []),
    ([(2, "delta"), (4, "same text"), (5, "alpha alpha")], [1, 99]),
    ([(1, "alpha back"), (5, "alpha alpha")], [5, 3]),
    ([], [2]),
]


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def state(snapshot):
    index = snapshot.lexical()
    docs = {r.id: dict(zip(r.terms, r.tfs, strict=True)) for r in index.documents.collect()}
    return docs, {r.term: r.df for r in index.terms.collect()}, tuple(index.stats.first())


def rebuilt(docs):
    words = {i: Counter((t or "").split()) for i, t in docs.items()}
    n = len(words)
    return {i: dict(c) for i, c in words.items()}, dict(Counter(w for c in words.values() for w in c)), (n, sum(c.total() for c in words.values()) / n if n else 0.0)


def change(spark, path, changed, deleted):
    return S.apply_changes(spark, path, spark.createDataFrame(changed, "id long, text string"), spark.createDataFrame([(i,) for i in deleted], "id long"))


def test_changes_equal_a_rebuilt_index(spark, tmp_path):
    path, docs, seen = str(tmp_path / "index"), {}, {}
    for number, (changed, deleted) in enumerate(CHANGES, 1):
        before = files(path)
        snapshot = change(spark, path, changed, deleted)
        for i in deleted:
            docs.pop(i, None)
        docs |= {i: t for i, t in changed if i is not None}
        assert snapshot.number == number and state(snapshot) == rebuilt(docs)
        assert before.items() <= files(path).items()  # older segments aren't rewritten
        seen[number] = dict(docs)
    added = [r.rows for r in S.open_snapshot(spark, path).segments.orderBy("place").collect()]
    assert added == [4, 2, 1, 0]  # unchanged rows aren't written again: 4 in the second change, 5 in the third
    for number, old in seen.items():
        assert state(S.open_snapshot(spark, path, number)) == rebuilt(old)
    assert change(spark, path, [(1, "alpha back")], [77]).number == 4  # no change, no snapshot
    pinned = S.open_snapshot(spark, path)
    compacted = S.compact(spark, path)
    assert compacted.segments.count() == 1 and state(compacted) == state(pinned) == rebuilt(docs)
    assert state(change(spark, path, [(8, "after alpha")], [])) == rebuilt(docs | {8: "after alpha"})
    assert len(S.collect_garbage(spark, path)) == 5 and state(S.open_snapshot(spark, path)) == rebuilt(docs | {8: "after alpha"})
    with pytest.raises(ValueError):
        S.open_snapshot(spark, path, 2)


def test_search_reads_any_snapshot(spark, tmp_path):
    path = str(tmp_path / "index")
    for changed, deleted in CHANGES[:3]:
        snapshot = change(spark, path, changed, deleted)
    queries = spark.createDataFrame([(0, "alpha same")], "query_id long, question string")
    want = sorted((r.id, round(r.score, 9)) for r in retrieval.lexical_scores(snapshot.lexical(), queries, 5).collect())
    blocks = inverted.write_inverted(snapshot.lexical(), str(tmp_path / "blocks"))
    assert [i for i, _ in want] == [1, 4, 5] and want == sorted((r.id, round(r.score, 9)) for r in inverted.search_blocks(blocks, queries, 5).collect())


def test_many_dead_rows_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FEW_DEAD", 0)
    path = str(tmp_path / "index")
    for changed, deleted in CHANGES[:2]:
        snapshot = change(spark, path, changed, deleted)
    assert set(state(snapshot)[0]) == {2, 3, 4, 5}


def test_readers_never_see_half_a_snapshot(spark, tmp_path):
    """A reader opens the index again and again while a writer publishes; every state that it meets is a whole one."""
    path, seen, done = str(tmp_path / "index"), [], threading.Event()

    def read():
        while not done.is_set():
            snapshot = S.open_snapshot(spark, path)
            if snapshot.number:
                seen.append((snapshot.number, *snapshot.lexical().stats.first()))

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 4):
        change(spark, path, [(n * 10 + i, "w " * n) for i in range(n)], [])
    done.set()
    reader.join()
    whole = {1: (1, 1.0), 2: (3, 5 / 3), 3: (6, 14 / 6)}
    assert seen and all((n, avg) == pytest.approx(whole[number]) for number, n, avg in seen)


def test_two_writers_conflict(spark, tmp_path):
    path = str(tmp_path / "index")
    change(spark, path, [(1, "a")], [])
    stale = S.open_snapshot(spark, path)
    change(spark, path, [(2, "b")], [])
    with pytest.raises(S.Conflict):
        S._publish(stale, stale.segments)
    assert state(S.open_snapshot(spark, path))[2] == (2, 1.0) and not [n for n in os.listdir(path) if n.startswith("aside")]
