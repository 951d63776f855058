"""MinHash near-duplicate groups by an LSH forest.

1. Each text becomes the set of its hashed shingles, a MinHash signature and a sketch (the least hash in each of BINS ranges); equal sets
   become one class.
2. The forest: every tree reads the signature in an order of its own. Classes whose signatures share the first DEPTH values
   form a region. Members of a region are candidates of each other; a region of more than REGION members is sorted by the whole
   signature instead, and candidates are the neighbours there, those with the longest common prefixes: as deep as it takes to
   have REGION / 2 of them on each side. The sort is by range over all tasks, so a large region is no single task's.
   So depth follows the region: 3 where that leaves few, as deep as needed where many agree. Candidates whose sketches agree
   in ESTIMATE of the ranges are linked, as stars.
3. Components of these links are coarse clusters: they hold every pair at or above the limit that some tree brings together.
   Neighbours are not all pairs, so members of regions over REGION are joined once more, by a prefix filter: two sets at the limit
   share one of the first elements of each, in any order common to all sets; the order here is rarest first. Members of different
   clusters that share such an element are compared, in blocks where many do, and clusters with agreeing sketches are merged.
4. Inside a cluster, links are decided on full sets. Clusters over BLOCK members are dealt out as pairs of blocks,
   so no task holds more than two blocks. Each task returns a spanning star of what it linked, never all pairs.

Chance that a pair exactly at the limit (0.8) is missed: no tree of 24 has its first 3 values equal, 3e-8; fewer than ESTIMATE (0.68) of 256
ranges agree, 1e-6. Texts that share half of their elements agree so far with a chance of 5e-9, so strangers seldom chain. Both are the same
in regions of any size.

Defined results: null and empty texts (or white space) have an empty set, no links and themselves as component. Repeated
ids: every row is kept in the result. Rows without an id have no component and are kept; only rows with one are linked. A text shorter than a shingle has one shingle, its whole word sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import cut, table
from .components import components

TREES, SIZE = 24, 72
DEPTH = 3
REGION = 512
BINS, ESTIMATE = 256, 0.68
BLOCK = 1024
#: Counters of elements that share them by hash; they only order elements, so a shared one costs time, never a pair.
COUNTERS = 1 << 18
#: Ids that may be broadcast to filter texts; more of them are joined by shuffle.
BROADCAST_IDS = 500_000


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (keys of the set), sig and sketch (null where the set is empty)."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long, sig array<smallint>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature = shingles.MinHash(SIZE)
        for batch in batches:
            n, k1, k2, sig, bins = [], [], [], [], []
            for s in shingles.sets_of(batch.column("text"), width):
                a, b = shingles.set_key(s)
                n.append(len(s))
                k1.append(a)
                k2.append(b)
                sig.append(signature(s) if len(s) else None)
                bins.append(shingles.sketch(s, BINS).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.list_(pa.int16())), pa.array(bins, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "sig", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _turned() -> Column:
    """The signature in the order of the tree: a rotation by three places a tree."""
    start = (F.col("tree") * 3).cast("int")
    return F.concat(F.slice("sig", start + 1, F.lit(SIZE)), F.slice("sig", F.lit(1), start))


def _streamed(batches: Iterator[pa.RecordBatch], key: str, handle) -> Iterator[pa.RecordBatch]:
    """handle(table) for each run of equal keys in batches sorted by `key`; the rows of one key are held at a time."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None else now
        keys = now.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cuts):
            yield from handle(now.slice(0, cuts[-1]), np.concatenate(([0], cuts[:-1])))
        rest = now.slice(cuts[-1]) if len(cuts) else now
    if rest is not None and rest.num_rows:
        yield from handle(rest.combine_chunks(), np.array([0]))


def _stars(near, n: int) -> np.ndarray:
    """Root (a place) of each of n places; near(i) tells which places are linked with i."""
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i], queue = i, [i]
            while queue:
                new = np.flatnonzero(near(queue.pop()) & (root < 0))
                root[new] = i
                queue += new.tolist()
    return root


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(ids: list, roots: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], schema=_EDGE)


def _agreeing(ids: np.ndarray, sketches: np.ndarray) -> tuple[list, list]:
    """A star for each set of rows whose sketches agree in ESTIMATE of the ranges, directly or over others."""
    if len(ids) == 2:
        return ([ids[1]], [ids[0]]) if shingles.alike(sketches[0], sketches[1], ESTIMATE) else ([], [])
    root = _stars(lambda k: shingles.alike(sketches, sketches[k], ESTIMATE), len(ids))
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[other].tolist(), ids[root[other]].tolist()


def _sketches(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column("sketch").combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return rows.column("rep").to_numpy(), data.reshape(len(column), BINS)


def _region_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside regions of at most REGION members; rows sorted by key."""

    def handle(rows: pa.Table, cuts: np.ndarray):
        ids, sig = _sketches(rows)
        a, b = [], []
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
            if j - i > 1:
                x, y = _agreeing(ids[i:j], sig[i:j])
                a += x
                b += y
        if a:
            yield _edges(a, b)

    yield from _streamed(batches, "key", handle)


def _neighbour_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among neighbours in the sorted order of a tree: windows of REGION rows that overlap by half."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, now]) if rest is not None else now
        while rest.num_rows > REGION:
            a, b = _agreeing(*_sketches(rest.slice(0, REGION)))
            yield _edges(a, b)
            rest = rest.slice(max(1, REGION // 2))
        rest = rest.combine_chunks()
    if rest is not None and rest.num_rows > 1:
        yield _edges(*_agreeing(*_sketches(rest)))


def forest_links(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Candidate links (a, b) of the classes `reps` (rep, sig, sketch), a sparse graph; members (rep) of regions over REGION, if any."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    first = reps.select("rep", "sig", trees).select("rep", "tree", F.xxhash64("tree", F.slice(_turned(), 1, DEPTH)).alias("key"))
    sizes = first.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(first.join(sizes, "key"))
    small = shared.filter(F.col("n") <= REGION).select("key", "rep").join(reps.select("rep", "sketch"), "rep")
    links = small.repartition("key").sortWithinPartitions("key", "rep").select("key", "rep", "sketch").mapInArrow(_region_links, "a long, b long")
    large, crowded = shared.filter(F.col("n") > REGION), None
    if not large.isEmpty():
        crowded = large.select("rep").distinct()
        order = large.select("rep", "tree", "key").join(reps, "rep").select("rep", "sketch", "key", _turned().alias("turned"))
        ordered = order.repartitionByRange("key", "turned").sortWithinPartitions("key", "turned", "rep").select("rep", "sketch")
        links = links.unionByName(ordered.mapInArrow(_neighbour_links, "a long, b long"))
    return links.filter("a <> b"), crowded


def _counted(width: int):
    """(counter, n): how many elements of the sets of a task fall to each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s in shingles.sets_of(batch.column("text"), width):
                n[(s % np.uint64(COUNTERS)).astype(np.int64)] += 1
        at = np.flatnonzero(n)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(n[part])], names=["counter", "n"])

    return run


def _prefixes(width: int, percent: int, counts: np.ndarray):
    """(rep, element): the rarest elements of each set, as many as a set at the limit must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.zeros(0, np.uint64)]
            for s in shingles.sets_of(batch.column("text"), width):
                order = np.lexsort((s, counts[(s % np.uint64(len(counts))).astype(np.int64)]))
                first.append(s[order[: len(s) + percent * len(s) // -100 + 1]] if len(s) else s)
            reps = np.repeat(batch.column("doc_id").to_numpy(), [len(x) for x in first[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(np.concatenate(first).view(np.int64))], names=["rep", "element"])

    return run


def _merging_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between clusters of the same key that have members with agreeing sketches, a spanning forest; rows sorted by key."""

    def handle(rows: pa.Table, cuts: np.ndarray):
        every, sigs = _sketches(rows)
        roots = rows.column("root").to_numpy()
        a, b = [], []
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(every)], strict=True):
            ids, sig, (_, root, size) = every[i:j], sigs[i:j], np.unique(roots[i:j], return_inverse=True, return_counts=True)
            # Of two members in different clusters one at least is outside the largest.
            for k in np.flatnonzero(root != size.argmax()).tolist() if len(size) > 1 else []:
                other = np.flatnonzero(root != root[k])
                other = other[shingles.alike(sig[other], sig[k], ESTIMATE)]
                for r, at in zip(*np.unique(root[other], return_index=True), strict=True):
                    a.append(ids[k])
                    b.append(ids[other[at]])
                    root[root == r] = root[k]
        if a:
            yield _edges(a, b)

    yield from _streamed(batches, "key", handle)


def crowded_links(docs: DataFrame, reps: DataFrame, crowded: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate links (a, b) of members of regions over REGION (`crowded`) between clusters (id, root), by a prefix filter."""
    crowded = cut(crowded)
    ids = crowded.select(F.col("rep").alias("doc_id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id")
    counted = texts.select("text").mapInArrow(_counted(width), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    counts = np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)
    first = cut(texts.mapInArrow(_prefixes(width, percent, counts), "rep long, element long"))
    member = crowded.join(clusters.select(F.col("id").alias("rep"), "root"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"))
    first = cut(first.join(member, "rep"))
    # Elements with the same members count once; those of one cluster need no comparison.
    same = F.count("*").alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("x"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s")
    lists = first.groupBy("element").agg(*same, F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    lists = lists.groupBy("n", "x", "s").agg(F.min("element").alias("element"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = first.join(lists.select("element", blocks.alias("blocks")), "element").withColumn("block", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select(F.xxhash64("element", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "rep", "root").join(reps.select("rep", "sketch"), "rep")
    return cells.repartition("key").sortWithinPartitions("key", "rep").select("key", "rep", "root", "sketch").mapInArrow(_merging_links, "a long, b long")


def _exact_links(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handle(rows: pa.Table, cuts: np.ndarray):
            ids = rows.column("doc_id").to_numpy()
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=False):
                part = list(shingles.sets_of(rows.column("text").slice(i, j - i), width))
                size = np.array([len(s) for s in part])
                names, flat = np.unique(np.concatenate(part), return_inverse=True)
                start = np.concatenate(([0], np.cumsum(size)[:-1]))
                mark = np.zeros(len(names), np.int64)

                def near(k, start=start, size=size, flat=flat, mark=mark):
                    own = flat[start[k] : start[k] + size[k]]
                    mark[own] = 1
                    both = np.add.reduceat(mark[flat], start)
                    mark[own] = 0
                    return 100 * both >= percent * (size + size[k] - both)

                root = _stars(near, j - i)
                other = np.flatnonzero(root != np.arange(j - i))
                if len(other):
                    yield _edges(ids[i + other].tolist(), ids[i + root[other]].tolist())

        yield from _streamed(batches, "cell", handle)

    return run


def exact_links(docs: DataFrame, clusters: DataFrame, width: int, percent: int) -> tuple[DataFrame, bool]:
    """Links (a, b) decided on full sets inside clusters (id, root), as spanning stars; whether a cluster was dealt out in blocks."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = cut(clusters.join(sizes, "root").select(F.col("id").alias("doc_id"), "root", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")))
    count, most = members.agg(F.count("*"), F.max("blocks")).first()
    ids = F.broadcast(members) if count <= BROADCAST_IDS else members
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cells = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.xxhash64("root", low, high).alias("cell"), "doc_id", "text")
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "doc_id")
    return dealt.mapInArrow(_exact_links(width, percent), "a long, b long").filter("a <> b"), (most or 1) > 1


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked directly or not, itself included) and kept (it is that document)."""
    every = cut(signatures(docs, width))
    classes = every.filter("n_shingles > 0").groupBy("n_shingles", "k1", "k2").agg(F.min_by(F.struct("sig", "sketch"), "doc_id").alias("s"), F.min("doc_id").alias("rep"))
    classes = cut(classes.filter("rep IS NOT NULL").select("n_shingles", "k1", "k2", "rep", "s.*"))
    reps = classes.select("rep", "sig", "sketch")
    candidates, crowded = forest_links(reps)
    coarse = components(candidates, "a", "b")
    if crowded is not None:
        more = cut(crowded_links(docs, reps, crowded, coarse, width, percent))
        if not more.isEmpty():
            coarse = components(coarse.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b")
    links, dealt_out = exact_links(docs, coarse, width, percent)
    if dealt_out:
        found = components(links, "a", "b")
    else:
        found = cut(links.select(F.col("a").alias("id"), F.col("b").alias("root")))
    roots = classes.drop("sig", "sketch").join(found.select(F.col("id").alias("rep"), "root"), "rep", "left")
    roots = roots.select("n_shingles", "k1", "k2", F.least(F.coalesce("root", "rep"), "rep").alias("component_id"))
    out = every.drop("sig", "sketch").join(roots, ["n_shingles", "k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without those that a document with a smaller id is linked to; columns as they were."""
    gone = cut(near_duplicates(docs, **options).filter("NOT kept").select(F.col("doc_id").alias("_gone_id")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone_id"], "left_anti")


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 4 THEN array_to_string(w[i : i + 3], ' ') ELSE array_to_string(w, ' ') END AS element
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.element = y.element AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * p.n >= 80 * (s.n + t.n - p.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""
