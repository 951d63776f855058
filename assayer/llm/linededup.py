"""Line dedup: lines that many documents share stay only in the document with the largest id.

A line's key is the line without white space (space, ASCII controls 9 to 13) at its ends and with A-Z lower-cased; only keys of LEAST_CHARS code
points and more count. Distinct (key hash, document) pairs are counted by two grouped aggregates, so a line of a third of all documents is summed where it
is found. Hashes of lines found in `least_docs` documents go to shards by their upper bits; for each shard one task builds a minimal perfect hash and
the arrays that it indexes: fingerprints (64 bits of a 128-bit hash), counts of documents, keeper (the largest doc_id). Documents hash their lines again and
probe the arrays; no line is joined with a line.

Minimal perfect hash: levels of bits. A key takes its place in the first level where no other key has the same one; its index is the number of bits set
before. 3 to 4 bits a key; the fingerprint tells keys that are not in the set.

Arrays of together at most ARRAY_BYTES go to all tasks. Larger ones stay in their shards: each document's hashes go there (SALTS streams a shard, its arrays
before each), and what a document must drop comes back by its id. Both ways give the same rows.

Defined results: a null or empty text is one empty line, and a null text stays null. Rows with one doc_id are one document in all counts, and the keeper's lines stay in
all rows with its id. Rows without an id are together one document, and never the keeper. Ties cannot occur: ids differ. A text whose lines all go is empty.
Columns named as results are replaced, others stay as they are. Empty tables give empty tables. Very long texts are read a few at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .shingles import mix

LEAST_CHARS, LEAST_DOCS = 20, 3
SHARD_LINES = 1 << 18
ARRAY_BYTES = 32 << 20
SALTS = 8
SLICE_BYTES = 4 << 20
_ENDS = " \t\n\x0b\x0c\r"
_ROOM = 1.5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE, _6, _63 = np.uint64(1), np.uint64(6), np.uint64(63)
_OF, _GONE = "_line_dedup_of", "_line_dedup_gone"
_ARRAYS = "shard long, sizes array<long>, bits binary, prints binary, counts binary, keepers binary"


class Perfect:
    """A minimal perfect hash of distinct pairs of 64-bit integers: each pair of the set has its own index below the size of the set."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits).astype(np.int64))))

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> Perfect:
        sizes, words = [], []
        while len(a):
            size = 64 * -(-int(_ROOM * len(a) + 1) // 64)
            at = cls._place(a, b, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, np.uint8)
            level[at[alone]] = 1
            sizes.append(size)
            words.append(np.packbits(level, bitorder="little").view("<u8"))
            a, b = a[~alone], b[~alone]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"))

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(a + b * (mix(np.array([level + 1], np.uint64)) | _ONE) + _ODD) % np.uint64(size)).astype(np.int64)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each pair, or -1 for some (not all) pairs that are not in the set."""
        out = np.full(len(a), -1, np.int64)
        left, begin = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (self._place(a[left], b[left], level, size) + begin).astype(np.uint64)
            word, bit = self.bits[(at >> _6).astype(np.int64)], at & _63
            hit = (word >> bit) & _ONE == _ONE
            below = word[hit] & ((_ONE << bit[hit]) - _ONE)
            out[left[hit]] = self.before[(at[hit] >> _6).astype(np.int64)] + np.bitwise_count(below)
            left, begin = left[~hit], begin + size
        return out


class Arrays:
    """What a shard knows of its lines: document count and keeper by perfect hash, checked by the fingerprint."""

    def __init__(self, sizes, bits: bytes, prints: bytes, counts: bytes, keepers: bytes):
        self.hash = Perfect(list(sizes), np.frombuffer(bits, "<u8"))
        self.prints, self.counts, self.keepers = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<u4"), np.frombuffer(keepers, "<i8")

    @staticmethod
    def row(a: np.ndarray, b: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> tuple:
        made = Perfect.of(a, b)
        at = np.empty(len(a), np.int64)
        at[made.index(a, b)] = np.arange(len(a))
        few = np.minimum(counts, (1 << 32) - 1).astype("<u4")
        return made.sizes, made.bits.tobytes(), b[at].astype("<u8").tobytes(), few[at].tobytes(), keepers[at].astype("<i8").tobytes()

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, 0 for lines that are not here; keeper) of each line."""
        at = self.hash.index(a, b)
        if not len(self.prints):
            return np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64)
        there = (at >= 0) & (self.prints[at] == b)
        return np.where(there, self.counts[at], 0), self.keepers[at]


def lines_of(texts: pa.Array, least_chars: int = LEAST_CHARS) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; for each line its text's place and the place of its key among the different ones, or -1; (n, 2) hashes of these."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    flat = split.flatten()
    row = np.repeat(np.arange(len(split)), np.asarray(pc.list_value_length(split)))
    key = pc.ascii_lower(pc.ascii_trim(flat, characters=_ENDS))
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(key), least_chars).to_numpy(zero_copy_only=False))
    words = key.take(pa.array(long)).dictionary_encode()
    code = np.full(len(flat), -1, np.int64)
    code[long] = words.indices.to_numpy()
    digest = b"".join([xxhash.xxh3_128_digest(w) for w in words.dictionary.cast(pa.large_binary()).to_pylist()])
    return split, row, code, np.frombuffer(digest, "<u8").reshape(-1, 2)


def keyed(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(a, b, doc_id): the hash of each key, once for each row of `docs` that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 8192, "text", SLICE_BYTES):
            _, row, code, hashes = lines_of(batch.column("text"), least_chars)
            there = code >= 0
            each = np.unique(row[there] * max(1, len(hashes)) + code[there])
            found = hashes[each % max(1, len(hashes))].view("<i8")
            ids = batch.column("doc_id").take(pa.array(each // max(1, len(hashes))))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), ids], names=["a", "b", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "a long, b long, doc_id long")


def counted(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(a, b, n, keeper) of each key found in `least_docs` documents or more."""
    once = keyed(docs, least_chars).groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= least_docs)


def _shard(bits: int):
    return F.shiftrightunsigned("a", 64 - bits) if bits else F.lit(0).cast("long")


def index(lines: DataFrame, bits: int) -> DataFrame:
    """The arrays of each of 2**bits shards of counted lines."""

    def build(group: pa.Table) -> pa.Table:
        a, b, n, keeper = (group.column(c).to_numpy() for c in ("a", "b", "n", "keeper"))
        row = (group.column("shard")[0].as_py(), *Arrays.row(a.view(np.uint64), b.view(np.uint64), n, keeper))
        kinds = pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "sizes", "bits", "prints", "counts", "keepers"])

    # A document of rows without an id can be the only one of a key where least_docs is 1: it keeps its lines by an id that none has.
    rows = lines.select(_shard(bits).alias("shard"), "a", "b", "n", F.coalesce("keeper", F.lit(-(1 << 63)).cast("long")).alias("keeper"))
    return rows.groupBy("shard").applyInArrow(build, _ARRAYS)


def _probed(a: np.ndarray, b: np.ndarray, bits: int, arrays) -> tuple[np.ndarray, np.ndarray]:
    """find() over all shards; arrays: Arrays by shard."""
    count, keeper = np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64)
    shard = (a >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)
    order = np.argsort(shard, kind="stable")
    begins = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for i, j in zip(begins, np.append(begins[1:], len(a)), strict=False):
        if (held := arrays.get(int(shard[order[i]]))) is not None:
            at = order[i:j]
            count[at], keeper[at] = held.find(a[at], b[at])
    return count, keeper


def _rewritten(docs: DataFrame, goes, least_chars: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """`docs` without the lines that `goes(batch, row, code, hashes)` marks, with n_lines and n_dropped. extra: columns for `goes` only."""
    place = docs.columns.index("text")
    names = [c for c in docs.columns if c not in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 8192, place, SLICE_BYTES):
            texts = batch.column(place)
            split, row, code, hashes = lines_of(texts, least_chars)
            drop = goes(batch, row, code, hashes)
            n, gone = np.bincount(row, minlength=len(split)), np.bincount(row[drop], minlength=len(split))
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n - gone))), pa.int32()), split.flatten().filter(pa.array(~drop)))
            joined = pc.if_else(texts.is_valid(), pc.binary_join(kept, pa.scalar("\n", pa.large_string())), pa.scalar(None, pa.large_string())).cast(pa.string())
            columns = [joined if i == place else batch.column(i) for i, c in enumerate(batch.schema.names) if c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), pa.array(gone.astype(np.int64))], names=[*names, "n_lines", "n_dropped"])

    schema = docs.select(*names).limit(0).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    return docs.mapInArrow(run, schema)


def _by_arrays(docs: DataFrame, rows: list, bits: int, least_chars: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
    held: dict = {}

    def goes(batch, row, code, hashes):
        if not held:
            held["all"] = {r[0]: Arrays(*r[1:]) for r in sent.value}
        count, keeper = _probed(hashes[:, 0], hashes[:, 1], bits, held["all"])
        ids = batch.column("doc_id").cast(pa.int64())
        other = pc.fill_null(ids, 0).to_numpy()[row] != np.append(keeper, 0)[code]
        other |= pc.is_null(ids).to_numpy(zero_copy_only=False)[row]
        return (code >= 0) & (np.append(count, 0)[code] > 0) & other

    return _rewritten(docs, goes, least_chars)


def _by_shards(docs: DataFrame, arrays: DataFrame, bits: int, least_chars: int) -> DataFrame:
    probes = keyed(docs, least_chars).select(_shard(bits).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("long")).alias("salt"), F.lit(1).alias("kind"), "a", "b", "doc_id")
    copies = arrays.select("*", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt"), F.lit(0).alias("kind"))
    stream = probes.unionByName(copies, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            kind, shard, salt = (batch.column(c).to_numpy() for c in ("kind", "shard", "salt"))
            ends = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *ends], [*ends, len(kind)], strict=True):
                if j == i:
                    continue
                if kind[i] == 0:
                    one = batch.slice(i, 1).select(["sizes", "bits", "prints", "counts", "keepers"]).to_pylist()[0]
                    held, at = Arrays(**one), (shard[i], salt[i])
                elif at == (shard[i], salt[i]):
                    part = batch.slice(i, j - i).select(["doc_id", "a", "b"])
                    a, b = (part.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
                    count, keeper = held.find(a, b)
                    ids = part.column("doc_id")
                    other = (pc.fill_null(ids, 0).to_numpy() != keeper) | pc.is_null(ids).to_numpy(zero_copy_only=False)
                    yield part.filter(pa.array((count > 0) & other))

    # What a document must drop is at most as long as the document.
    gone = stream.mapInArrow(probe, "doc_id long, a long, b long").groupBy(F.col("doc_id").alias(_OF)).agg(F.collect_set(F.struct("a", "b")).alias(_GONE))
    both = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(_OF)), "left").drop(_OF)
    place = both.columns.index(_GONE)

    def goes(batch, row, code, hashes):
        cells = batch.column(place)
        drop = np.zeros(len(row), bool)
        begins = np.searchsorted(row, np.arange(len(cells) + 1))
        for k in np.flatnonzero(cells.is_valid().to_numpy(zero_copy_only=False)).tolist():
            pairs = {(x["a"], x["b"]) for x in cells[k].as_py()}
            mine = code[begins[k] : begins[k + 1]]
            there = {int(c) for c in np.unique(mine[mine >= 0]) if tuple(hashes[c].view("<i8").tolist()) in pairs}
            drop[begins[k] : begins[k + 1]] = np.isin(mine, list(there))
        return drop

    return _rewritten(both, goes, least_chars, (_GONE,))


def drop_repeated(docs: DataFrame, *, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, array_bytes: int = ARRAY_BYTES, shard_lines: int = SHARD_LINES) -> DataFrame:
    """The columns of `docs` (doc_id, text, ...), text without its repeated lines, with n_lines (before) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    lines = cut(counted(docs, least_docs, least_chars))
    bits = max(0, (lines.count() - 1) // shard_lines).bit_length()
    arrays = cut(index(lines, bits))
    sizes = [F.length(c) for c in ("bits", "prints", "counts", "keepers")]
    total = arrays.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0
    if total <= array_bytes:
        return _by_arrays(docs, arrays.collect(), bits, least_chars)
    return _by_shards(docs, arrays, bits, least_chars)


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS doc, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, doc, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM split
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM (SELECT DISTINCT k, doc_id FROM keyed WHERE length(k) >= 20) GROUP BY k HAVING count(*) >= 3
), marked AS (
  SELECT doc, doc_id, i, line, r.k IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN repeated r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc, doc_id
"""
