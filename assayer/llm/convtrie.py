"""Conversation prefix trie: every distinct sequence of first turns is a node, with what sharing it would save.

Conversations, as sequences of 128-bit turn hashes, are dealt by sorted ranges and sorted. Each task reads its run once: neighbours are joined by
edges weighted by the turns that they share (longest common prefix), and union-find takes the edges in descending depth. Every merge of two components is a
branching node (or joins a node made at that depth); below it the components close, unary nodes included. Only nodes that a
neighbouring run can still reach, the prefixes of a run's first and last conversation, stay open: a run is contracted to two chains of open nodes, which hold sums over
all that has closed below them. The chains of FAN neighbouring runs are merged by the same union-find, round after round, until one forest is left,
which closes as a whole. A run is taken in pieces of PIECE_BYTES of hashes, so memory does not grow with it.

A closed node whose parent is still open learns the parent's name later, by a join on (run, parent); each run names its own open nodes, so no key has more
rows than a run. Hashes of the members that end at a node are streamed over (conversation, id) in order; all ids of one
group of copies pass through one task, as one hash needs, without being held.

Defined results: turns are ordered by turn (null first), role, text; null roles and texts are as empty ones. Repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. An
empty table gives no nodes, not even a root. Only the named columns are read. A conversation is held whole by one task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table

FAN = 16
PIECE_BYTES, PIECE_ROWS = 1 << 20, 4096
_TURN = 16
_NODE, _CHAIN, _OPEN = 0, 1, 2
_SCHEMA = (
    "kind int, level int, run int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "first_end long, parent binary, own binary, chain binary"
)
_KINDS = [pa.int32()] * 3 + [pa.int64()] * 8 + [pa.binary()] * 3
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_NONE = hashlib.sha256(b"").hexdigest()


class Sums:
    """What has closed at or below a node."""

    __slots__ = ("members", "least", "leaves", "saved", "children", "first_end")

    def __init__(self, members=0, least=None, leaves=0, saved=0, children=0, first_end=None):
        self.members, self.least, self.leaves, self.saved, self.children, self.first_end = members, least, leaves, saved, children, first_end

    def add(self, other: Sums) -> None:
        self.members += other.members
        self.leaves += other.leaves
        self.saved += other.saved
        self.children += other.children
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least
        if other.first_end is not None and (self.first_end is None or other.first_end < self.first_end):
            self.first_end = other.first_end

    def __reduce__(self):
        return Sums, (self.members, self.least, self.leaves, self.saved, self.children, self.first_end)


class Chain:
    """A path of turn hashes with the bytes of each turn's text, and sums held at some of its depths."""

    __slots__ = ("path", "sizes", "held")

    def __init__(self, path: bytes, sizes: list[int], held: dict[int, Sums]):
        self.path, self.sizes, self.held = path, sizes, held


def shared(a: bytes, b: bytes) -> int:
    """Turns at the start that two paths share."""
    low, high = 0, min(len(a), len(b)) // _TURN
    if a[: high * _TURN] == b[: high * _TURN]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * _TURN] == b[: mid * _TURN]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """The trie of sorted chains, by union-find over their neighbour edges in descending depth."""

    def __init__(self, rows: list[Chain], whole: bool):
        self.rows, self.whole = rows, whole
        self.depth: list[int] = []
        self.sums: list[Sums] = []
        self.same: list[int] = []  # nodes found to be one
        self.parent: list[int] = []
        self.closed: list[tuple[int, int]] = []  # node, a row below it
        self.open: list[tuple[int, int, int]] = []  # node, first and last row below it
        up = list(range(len(rows)))
        # A component: first and last row, its top node, rows with sums above their ends.
        parts = {i: (i, i, self._node(len(r.sizes), [i]), [i] if any(d < len(r.sizes) for d in r.held) else []) for i, r in enumerate(rows)}

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        lcp = [shared(a.path, b.path) for a, b in zip(rows, rows[1:], strict=False)]
        for i in sorted(range(len(lcp)), key=lcp.__getitem__, reverse=True):
            x, y = root(i), root(i + 1)
            a, b = self._lift(parts.pop(x), lcp[i]), self._lift(parts.pop(y), lcp[i])
            self.sums[a[2]].add(self.sums[b[2]])
            self.same[b[2]] = a[2]
            up[y] = x
            parts[x] = (a[0], b[1], a[2], a[3] + b[3])
        (last,) = parts.values()
        first, end, top, _ = self._lift(last, 0)
        if whole:
            self._close(top, first)
        else:
            self.open.append((top, first, end))

    def _node(self, depth: int, rows: list[int]) -> int:
        total = Sums()
        for r in rows:
            if (held := self.rows[r].held.get(depth)) is not None:
                total.add(held)
        self.depth.append(depth)
        self.sums.append(total)
        self.same.append(len(self.same))
        self.parent.append(-1)
        return len(self.depth) - 1

    def _lift(self, part: tuple, depth: int) -> tuple:
        """The component with its top node at `depth`; what lies below closes, or stays open at the ends of the run."""
        first, last, top, more = part
        ends = not self.whole and (first == 0 or last == len(self.rows) - 1)
        while self.depth[top] > depth:
            above = self._node(self.depth[top] - 1, more)
            self.parent[top] = above
            if ends:
                self.open.append((top, first, last))
            else:
                self._close(top, first)
                done, into = self.sums[top], self.sums[above]
                into.add(Sums(done.members, done.least, done.leaves, done.saved, 1))
            top = above
        return first, last, top, more

    def _close(self, node: int, row: int) -> None:
        total, depth = self.sums[node], self.depth[node]
        total.leaves = total.leaves if total.children else 1
        if depth:
            total.saved += (total.members - 1) * self.rows[row].sizes[depth - 1]
        self.closed.append((node, row))

    def name(self, row: int, depth: int) -> bytes:
        return hashlib.md5(self.rows[row].path[: depth * _TURN]).digest()

    def nodes(self, level: int, run: int, were_open: set[bytes] | None = None) -> Iterator[tuple]:
        """Rows of closed nodes; a parent that is still open is given by its name, and nodes that were open before (all, if not told which) have one."""
        still = {n for n, _, _ in self.open}
        for node, row in self.closed:
            total, depth, parent, name = self.sums[node], self.depth[node], None, None
            if depth:
                above = self.parent[node]
                while self.same[above] != above:
                    above = self.same[above]
                parent, name = (None, self.name(row, depth - 1)) if above in still else (self.sums[above].least, None)
            own = self.name(row, depth)
            own = own if were_open is None or own in were_open else None
            yield _NODE, level, run, total.least, depth, parent, total.members, total.children, total.leaves, total.saved, total.first_end, name, own, None

    def contracted(self) -> list[Chain]:
        """The chains of open nodes: of the first row, and of the last one if it has another path. Nodes of both are held by the first."""
        if self.whole:
            return []
        ends = [Chain(self.rows[i].path, self.rows[i].sizes, {}) for i in (0, -1)]
        for node, first, _ in self.open:
            ends[first != 0].held[self.depth[node]] = self.sums[node]
        return ends if ends[0].path != ends[1].path else ends[:1]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _open(chains: list[Chain]) -> set[bytes]:
    return {hashlib.md5(c.path[: d * _TURN]).digest() for c in chains for d in range(len(c.sizes) + 1)}


def _left(chains: list[Chain], level: int, run: int, names: set[bytes]) -> list[tuple]:
    """Rows of a contracted run: its chains, in order, and the names of the nodes that were open at the end of any of its pieces."""
    rows = [(_CHAIN, level, run, None, side, *[None] * 8, pickle.dumps((c.path, c.sizes, c.held))) for side, c in enumerate(chains)]
    return rows + [(_OPEN, level, run, *[None] * 9, name, None) for name in sorted(names)]


def nodes(paths: DataFrame, *, fan: int = FAN, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the trie.

    paths: conv_id, key (binary, 16 bytes a turn) and sizes (array of long, bytes of each turn's text).
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, chains, names = TaskContext.get().partitionId(), [], set()
        for batch in small_batches(batches, piece_rows, "key", PIECE_BYTES):
            for c, key, sizes in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "key", "sizes")), strict=True):
                chains.append(Chain(key, sizes, {len(sizes): Sums(1, c, 0, 0, 0, c)}))
            made = Forest(chains, False)
            yield _batch(list(made.nodes(0, run, names)))
            chains = made.contracted()
            names |= _open(chains)
        if chains:
            yield _batch(_left(chains, 0, run, names))

    def merging(level: int, whole: bool):
        def merge(group: pa.Table) -> pa.Table:
            ends = sorted(zip(*(group.column(c).to_pylist() for c in ("run", "depth", "chain")), strict=True), key=lambda r: r[:2])
            run = ends[0][0] // fan
            made = Forest([Chain(*pickle.loads(blob)) for _, _, blob in ends], whole)
            left = made.contracted()
            return pa.Table.from_batches([_batch([*made.nodes(level, run), *_left(left, level, run, _open(left))])])

        return merge

    found = cut(paths.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(first, _SCHEMA))
    every, level, runs = [found], 0, (found.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        level, whole = level + 1, runs <= fan
        chains = found.filter(F.col("kind") == _CHAIN)
        found = cut(chains.groupBy(F.floor(F.col("run") / fan).alias("group")).applyInArrow(merging(level, whole), _SCHEMA))
        every.append(found)
        if whole:
            break
        runs = -(-runs // fan)
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    closed = rows.filter(F.col("kind") == _NODE)
    late = closed.filter("own IS NOT NULL").select("own", F.col("conv_id").alias("_least"))
    named = rows.filter(F.col("kind") == _OPEN).select("level", "run", "own").join(late, "own").select("level", "run", F.col("own").alias("parent"), F.col("_least").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "first_end"]
    known = closed.filter("parent IS NULL").select(*columns)
    tops = closed.filter("parent IS NOT NULL").drop("parent_conv_id").join(named, ["level", "run", "parent"]).select(*columns)
    every_node = known.unionByName(tops)
    ended = every_node.filter("first_end IS NOT NULL").join(ends(paths), "first_end")
    return ended.unionByName(every_node.filter("first_end IS NULL").withColumn("ends_sha256", F.lit(_NONE))).drop("first_end")


def ends(paths: DataFrame) -> DataFrame:
    """(first_end, ends_sha256): for each different conversation its least id, and the hash of all its ids in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, least, digest = None, None, None
        out: list[tuple[int, str]] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.string()))], names=["first_end", "ends_sha256"])
        for batch in batches:
            for key, c in zip(batch.column("k").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key == at:
                    digest.update(b",%d" % c)
                else:
                    if at is not None:
                        out.append((least, digest.hexdigest()))
                    at, least, digest = key, c, hashlib.sha256(b"%d" % c)
            yield flush()
            out.clear()
        if at is not None:
            out.append((least, digest.hexdigest()))
            yield flush()

    return paths.select(F.md5("key").alias("k"), "conv_id").repartition("k").sortWithinPartitions("k", "conv_id").mapInArrow(run, "first_end long, ends_sha256 string")


def turns_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): of each conversation its turns in order, as structs of hash (hex) and bytes of the text."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("said"))
    coded = lambda t: F.md5(F.concat(F.octet_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))
    return whole.select("conv_id", F.transform("said", lambda t: F.struct(coded(t).alias("hash"), F.octet_length(t["text"]).cast("long").alias("size"))).alias("turns"))


def paths_of(conversations: DataFrame) -> DataFrame:
    """conv_id, key, sizes, as `nodes` takes them, of conversations with turns (structs of hash and size)."""
    return conversations.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), "")).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id, turn, role, text)."""
    return nodes(cut(paths_of(turns_of(turns))))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % 5 (all if fewer, none if absent); h is crc32 of c in decimal, mod 9."""
    own = conversations.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % 5})
    heads = conversations.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    none = F.slice("turns", 1, 0)
    first = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return nodes(cut(paths_of(rebuilt(turns_of(turns)))))


OP12_SQL = r"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(md5(strlen(r) || ':' || r || x) ORDER BY i) AS hs, list(strlen(x) ORDER BY i) AS ls FROM said GROUP BY conv_id
), sized AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % 9 AS h
  FROM own
), built AS (
  SELECT o.conv_id, list_concat(list_slice(coalesce(b.hs, []), 1, o.h), list_slice(o.hs, o.h + 1, len(o.hs))) AS hs,
    list_concat(list_slice(coalesce(b.ls, []), 1, o.h), list_slice(o.ls, o.h + 1, len(o.ls))) AS ls
  FROM sized o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), prefixes AS (
  SELECT conv_id, d, len(hs) AS n, array_to_string(list_slice(hs, 1, d), ',') AS k, CASE WHEN d > 0 THEN array_to_string(list_slice(hs, 1, d - 1), ',') END AS pk, CASE WHEN d > 0 THEN ls[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(len(hs) + 1)) AS d FROM built)
), nodes AS (
  SELECT k, d, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY k, d
), kids AS (
  SELECT pk AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), weighed AS (
  SELECT s.*, coalesce(c.n, 0) AS n_children FROM nodes s LEFT JOIN kids c ON c.k = s.k AND c.d = s.d
), summed AS (
  SELECT p.k, p.d, sum((w.n_convs - 1) * w.size)::BIGINT AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
  FROM weighed w JOIN prefixes p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY p.k, p.d
)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM weighed w JOIN summed s ON s.k = w.k AND s.d = w.d LEFT JOIN nodes u ON u.k = w.pk AND u.d = w.d - 1
"""
