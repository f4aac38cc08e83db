"""Near-copies among texts by a chosen-path set similarity join.

A text is its set of distinct word shingles. Each set has COORDINATES minwise tokens. In each of some independent
trees, a node selects coordinates at random, 1 / 0.85 of them on average, and a set goes on to one child per selected
coordinate, named by its token there; two sets with similarity s meet in a child with probability s, and branching
makes up for the loss. So many trees are grown that a pair at the threshold meets in one of them with chance RECALL, by
the chance that its branching in a tree dies out before LEVELS. Nodes of at most SMALL sets are compared exhaustively on their minwise tokens; larger ones
branch again, and what is still large after LEVELS is a family of near copies.

Equal sets are one class from the start. Sets that look similar form families, and inside a family links are
confirmed on the full sets. A family of more than BLOCK sets is dealt to blocks that all hold the same LEADERS; sets
that these blocks leave apart are then compared with every block. So no group is gathered in one task, copies never
become pairs of rows, and every candidate pair is either linked through others or compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_few, byte_chunks, components, written

COORDINATES, LEVELS, SMALL = 64, 4, 64
RECALL = 0.9999
#: Paths of more sets than this are hot: they are counted and joined apart from the others, without a shuffle by path.
HOT, BROADCAST_PATHS = 256, 1_000_000
#: Pairs whose minwise tokens agree less than this aren't candidates: 0.85 less five standard deviations.
LOOKS = 0.6
BLOCK, LEADERS = 256, 16
#: A table of families of at most this many rows is broadcast to the texts; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
_rng = np.random.default_rng(7)
_ODD = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _K[0]
    h = (h ^ (h >> np.uint64(29))) * _K[1]
    return h ^ (h >> np.uint64(32))


def trees(share: float) -> int:
    """Trees that let a pair at similarity `share` meet with chance RECALL: a child is drawn for one coordinate, and a
    second one with chance 1 / share - 1; the pair goes on in each with chance `share`."""
    lost, more = 0.0, 1 / share - 1
    for _ in range(LEVELS):
        lost = (1 - share + share * lost) * (1 - more * share + more * share * lost)
    return math.ceil(math.log(1 - RECALL) / math.log(lost))


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct k-word shingles of each text; fewer words are one shingle, none are no set.
    k is 1 or more. Different shingles of one pair of texts share a hash with a chance of about 1e-19 each."""
    number: dict[bytes, int] = {}
    words = [t.lower().split() if t else [] for t in texts]
    index = [[number.setdefault(w, len(number)) for w in ws] for ws in words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    out = []
    for ix in index:
        h = hashes[ix] if ix else np.zeros(0, np.uint64)
        if len(h) < k:
            s = h[:1] * _K[2]
            for j in range(1, len(h)):
                s = _mix(s) + h[j : j + 1] * _K[2 + j % 6]
            out.append(_mix(s + np.uint64(len(h))))
            continue
        s = h[: len(h) - k + 1] * _K[2]
        for j in range(1, k):
            s = _mix(s) + h[j : len(h) - k + 1 + j] * _K[2 + j % 6]
        out.append(np.unique(_mix(s)))
    return out


def minwise(s: np.ndarray) -> np.ndarray:
    """COORDINATES minwise tokens of a set, 32 bits each."""
    if len(s) > 4096:
        return np.minimum.reduce([minwise(s[i : i + 4096]) for i in range(0, len(s), 4096)])
    return ((s[:, None] * _ODD[None, :]) >> np.uint64(32)).min(axis=0).astype(np.uint32)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "text"):
                ids = part.column("id").to_pylist()
                sets = shingle_sets(part.column("text").to_pylist(), k)
                digest = [xxhash.xxh128_digest(s.tobytes()) if len(s) else b"none" + str(i).encode() for s, i in zip(sets, ids, strict=True)]
                sig = [minwise(s).tobytes() if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "content": part.column("content"), "n": pa.array(map(len, sets), pa.int64()), "digest": pa.array(digest, pa.binary()), "sig": pa.array(sig, pa.binary())})

    return run


def _children(level: int, fraction: float, n_trees: int):
    """Paths of the next level: (path, rep, tree) for each selected coordinate of each row (path, rep, sig)."""
    chance = 1 / fraction - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, COORDINATES)
            rep = batch.column("rep").to_numpy()
            paths, reps = [], []
            starts = [np.full(len(rep), t * 7919 + 1, np.uint64) for t in range(n_trees)] if level == 0 else [batch.column("path").to_numpy().view(np.uint64)]
            for start in starts:
                draw = _mix(start * _K[3] + np.uint64(level + 1))
                for j in range(2):  # one coordinate always, a second with the chance that makes 1 / fraction
                    pick = (_mix(draw + np.uint64(j + 1)) >> np.uint64(11)).astype(np.int64) % COORDINATES
                    go = np.ones(len(rep), bool) if j == 0 else (_mix(draw + np.uint64(99)) >> np.uint64(11)) / float(1 << 53) < chance
                    token = sig[np.arange(len(rep)), pick].astype(np.uint64)
                    paths.append(_mix(draw * _K[4] + token * _K[5] + pick.astype(np.uint64))[go])
                    reps.append(rep[go])
            yield pa.RecordBatch.from_pydict({"path": pa.array(np.concatenate(paths).view(np.int64)), "rep": pa.array(np.concatenate(reps))})

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            here = tuple(c[a] for c in cols)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i


def _look_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each small node, a forest of edges over the pairs that look alike."""
    a, b = [], []
    for node in _runs(batches, ["path"]):
        rep = node.column("rep").to_pylist()
        sig = np.frombuffer(b"".join(node.column("sig").to_pylist()), np.uint32).reshape(len(rep), COORDINATES)
        joined = _Union(len(rep))
        for i in range(1, len(rep)):
            for j in np.flatnonzero((sig[:i] == sig[i]).mean(axis=1) >= LOOKS).tolist():
                if joined.root(i) != joined.root(j):
                    joined.join(i, j)
                    a.append(rep[j])
                    b.append(rep[i])
        if len(a) > 50_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(x) + len(y) - len(np.union1d(x, y))
    return den * both >= num * (len(x) + len(y) - both)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), k)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*part.schema.names[1:], "set"])

    return run


def _confirm(num: int, den: int):
    """In each block, a forest of confirmed links: all pairs, but those joined already and those of two `guest`-less
    rows in a block that was compared before (guest: 1 for sets that the first pass left apart, 0 or null else)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, ["family", "block", "seat"]):
            rep, guest = block.column("rep").to_pylist(), block.column("guest").to_pylist()
            part = block.column("part").to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in block.column("set").to_pylist()]
            size = np.array([len(s) for s in sets])
            sig = np.stack([minwise(s) for s in sets])
            joined, a, b = _Union(len(rep)), [], []
            first: dict[int, int] = {}
            for i, p in enumerate(part):
                if p is not None and first.setdefault(p, i) != i:
                    joined.join(first[p], i)
            again = any(guest)
            for i in range(1, len(rep)):
                fits = (den * np.minimum(size[:i], size[i]) >= num * np.maximum(size[:i], size[i])) & ((sig[:i] == sig[i]).mean(axis=1) >= LOOKS)
                for j in np.flatnonzero(fits).tolist():
                    if again and not (guest[i] or guest[j]) or joined.root(i) == joined.root(j):
                        continue
                    if rep[i] == rep[j] or _similar(sets[i], sets[j], num, den):
                        joined.join(i, j)
                        a.append(rep[j])
                        b.append(rep[i])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sized(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """paths with the sizes of those in `sizes`. Hot paths are few (a path in HOT at most), and are broadcast after a
    count, so their rows stay where they lie; only the others are joined by path."""
    hot = sizes.where(F.col("size") > HOT)
    if hot.count() > BROADCAST_PATHS:
        return paths.join(sizes, "path")
    known = paths.join(F.broadcast(hot.select("path", F.col("size").alias("_hot"))), "path", "left")
    cold = known.where("_hot is null").drop("_hot").join(sizes.where(F.col("size") <= HOT), "path")
    return cold.unionByName(known.where("_hot is not null").withColumnRenamed("_hot", "size"))


def dedup(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id, kept; links have den * |intersection| >= num * |union|.

    A null text, or one without words, has no shingles and links with nothing. Keys are integers and only name rows:
    rows that repeat a key are linked by their texts like any others. A row with a null key links as well, and belongs
    to the smallest key that it reaches; only where there is none is its component null and the row kept. Pairs are
    confirmed on the 64-bit hashes of their shingles. k is 1 or more. Empty input gives no rows."""
    source = docs.select(F.col(text).cast("binary").alias("text"), F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("content"))
    described = written(source.mapInArrow(_describe(k), "id long, content long, n long, digest binary, sig binary"))
    # A class is named by a number of its own; its text is found again by the smallest key and content that it has.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("r")
    classes = described.groupBy("digest").agg(first, F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes.select("digest", F.col("r.id").alias("name"), F.col("r.content").alias("content"), "n", "sig", F.monotonically_increasing_id().alias("rep")))
    reps = classes.where("n > 0").select("rep", "sig")
    n_trees = trees(num / den)

    # Branch level by level; small nodes are compared, single sets drop out.
    alike = None
    rows = reps
    for level in range(LEVELS):
        paths = written(rows.mapInArrow(_children(level, num / den, n_trees), "path long, rep long").distinct())
        sizes = written(paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"))
        nodes = written(_sized(paths, sizes))
        small = nodes.where(F.col("size") <= SMALL).select("path", "rep").join(reps, "rep").repartition("path").sortWithinPartitions("path", "rep")
        edges = small.mapInArrow(_look_alike, "a long, b long").distinct()
        large = nodes.where(F.col("size") > SMALL)
        if level == LEVELS - 1:
            leaders = broadcast_few(large.groupBy("path").agg(F.min("rep").alias("a")), BROADCAST_PATHS)
            star = large.join(leaders, "path").select("a", F.col("rep").alias("b")).where("a <> b").distinct()
            edges = edges.union(star)
        edges = written(edges)
        alike = edges if alike is None else alike.union(edges)
        if not large.limit(1).count():
            break
        rows = large.select("path", "rep").join(reps, "rep")

    families = components(alike).select(F.col("id").alias("rep"), F.col("component_id").alias("family"))
    families = written(families.join(families.groupBy("family").agg(F.count("*").alias("size")), "family"))
    few = families.count() <= BROADCAST_ROWS
    wanted = families.join(classes.select("rep", "name", "content"), "rep")
    wanted = F.broadcast(wanted) if few else wanted
    # Rows without a key that share a text all match their class: one of them is enough.
    own = ["text", "rep", "family", "size"]
    keyed = source.where("id is not null").join(wanted.where("name is not null"), (F.col("id") == F.col("name")) & (source["content"] == wanted["content"])).select(*own)
    rest = source.where("id is null").join(wanted.where("name is null"), source["content"] == wanted["content"]).select(*own).dropDuplicates(["rep"])
    texts = keyed.unionByName(rest)
    sets = written(texts.select("text", "rep", "family", "size").mapInArrow(_sets(k), "rep long, family long, size long, set binary"))

    # First pass: blocks of large families hold the leaders as well.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = sets.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("rep"), blocks).cast("int")})
    place = ["family", "block", "seat"]
    columns = [*place, "rep", "set", F.lit(None).cast("int").alias("guest"), F.lit(None).cast("long").alias("part")]
    home = dealt.withColumn("seat", F.lit(0)).select(*columns)
    big = families.where(F.col("size") > BLOCK)
    some_big = big.limit(1).count() > 0
    if some_big:
        rank = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 40))
        # About LEADERS by a hash threshold on the family's size: no sort, no group in one task.
        leads = dealt.where((F.col("size") > BLOCK) & (rank < LEADERS / F.col("size") * (1 << 40)))
        guests = leads.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("at <> block")
        home = home.union(guests.select("family", F.col("at").alias("block"), F.lit(0).alias("seat"), "rep", "set", F.lit(None).cast("int").alias("guest"), F.lit(None).cast("long").alias("part")))
    confirm = lambda df: written(df.repartition(*place).sortWithinPartitions(*place, "rep").mapInArrow(_confirm(num, den), "a long, b long"))
    links = confirm(home)
    groups = components(links)
    if some_big:
        # Second pass: in a large family, sets outside its largest part meet every block.
        parts = big.join(groups, F.col("rep") == F.col("id"), "left").select("rep", "family", "size", F.coalesce("component_id", "rep").alias("part"))
        counts = parts.groupBy("family", "part").agg(F.count("*").alias("c"))
        main = counts.groupBy("family").agg(F.max(F.struct("c", F.col("part").alias("p")))["p"].alias("main"))
        parts = written(parts.join(main, "family").withColumn("guest", (F.col("part") != F.col("main")).cast("int")))
        apart = parts.where("guest = 1")
        if apart.limit(1).count():
            held = sets.join(parts.select("rep", "part", "guest"), "rep").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("rep"), blocks).cast("int")})
            # Sets apart sit in seats of BLOCK each; every seat meets every block of the family.
            seats = apart.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("seats"))
            held = held.join(seats, "family").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("seats")).cast("int"))
            stay = held.withColumn("seat", F.explode(F.sequence(F.lit(0), F.col("seats") - 1))).select(*place, "rep", "set", F.lit(0).alias("guest"), "part")
            visit = held.where("guest = 1").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("family", F.col("at").alias("block"), F.col("own").alias("seat"), "rep", "set", "guest", "part")
            links = links.union(confirm(stay.union(visit)))
            groups = components(links)

    groups = groups.select(F.col("id").alias("rep"), F.col("component_id").alias("group"))
    named = broadcast_few(groups.join(classes.select("rep", "name"), "rep").groupBy("group").agg(F.min("name").alias("least")))
    per_class = classes.join(groups, "rep", "left").join(named, "group", "left").select("digest", F.coalesce("least", "name").alias("own"))
    out = described.select("id", "n", "digest").join(per_class, "digest")
    component = F.when(F.col("n") > 0, F.col("own")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
