"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and how often ids meet.

Both tokenizers read a text with a space in front. Byte offsets where a token of A and one of B both end are cuts. They are found by divide and conquer: in
each interval a common end near the middle is looked for by bisection (outward from the middle, then among all the rest), and both halves
are taken likewise; an interval without one is a group. All intervals of a depth, of all texts of a slice, are bisected together. Inside a group
the pieces between neighbouring ends of either side are the links: one A token and one B token whose bytes overlap.

Links are counted over the corpus by id pair. Each task sums its own pairs first. Slices of texts are written once with the links of their texts, as codes
into the slice's list of pairs, so the second pass tokenises nothing. Counts of at most MOST_PAIRS pairs (by vocabulary, not by data) go to all tasks; more are joined to each
slice's list of pairs. Both ways give the same rows.

Defined results: null and empty texts, and texts whose tokens of either side do not spell the text again (U+2581 in a text does not), have no tokens.
Repeated rows are each aligned and counted. Columns other than doc_id and text are not read. An empty table gives no rows. Of equal counts all are best. Very long texts are held
one at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import ROW_BY_ROW, arrow_batches, scratch, small_batches, table
from .sptok import SPACE
from .tokenbin import Tokens, byte_signs, ranked

SLICE_BYTES = 1 << 20
MOST_PAIRS = 2_000_000
FLUSH_PAIRS = 500_000
BATCH = "8m"
NEAR = 6
MEMO = 200_000


class ByteIds(Tokens):
    """Ids of a byte-level tokenizer file; strings of special tokens are plain text. `bytes_of`: each id's bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.special = []
        self.remember(MEMO)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        byte = {sign: b for b, sign in enumerate(byte_signs())}
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            known = all(c in byte for c in word)
            self.bytes_of[i] = bytes(byte[c] for c in word) if known else word.encode()


class PieceIds:
    """Ids of a sentencepiece model. `bytes_of`: each id's bytes, U+2581 as a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        # Words are encoded apart if no piece goes on over a space.
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.known = words.Memo(lambda units: self._each([u[1:] for u in units]), MEMO)

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.library.encode(texts, out_type=int, num_threads=1)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        unclear = pc.match_substring_regex(texts, f"^$|^ |  | $|{SPACE}") if self.apart else pa.array([True] * len(texts))
        return words.encoded(texts, unclear, self._each, self.known, " ")


class Table:
    """Bytes and decimal digits of ids, for many ids at once."""

    def __init__(self, bytes_of: list[bytes]):
        self.size = np.array([len(b) for b in bytes_of], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(bytes_of), np.uint8)
        shown = [str(i).encode() for i in range(len(bytes_of))]
        self.wide = len(shown[-1]) + 1
        self.digits = np.frombuffer(b"".join(s.ljust(self.wide, b"\0") for s in shown), np.uint8).reshape(-1, self.wide)
        self.shown = np.array([len(s) for s in shown], np.int64)

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def cuts(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places in `a` of all its ends that are in `b` too, ascending.

    a, b: ascending byte ends. [low, high): intervals of places of `a`, each non-empty, the last end of each known to be common.
    """
    found = [high - 1]

    ends_b = np.zeros(int(max(a[-1], b[-1])) + 1 if len(a) else 1, bool)
    ends_b[b] = True

    def common(at: np.ndarray) -> np.ndarray:
        return ends_b[a[at]]

    while len(low):
        inner = high - low > 1
        low, high = low[inner], high[inner]
        mid = (low + high - 2) >> 1
        cut = np.full(len(low), -1, np.int64)
        left = np.arange(len(low))
        for k in range(NEAR):
            at = mid[left] + ((k + 1) // 2 if k % 2 else -(k // 2))
            inside = np.flatnonzero((at >= low[left]) & (at < high[left] - 1))
            hit = inside[common(at[inside])]
            cut[left[hit]] = at[hit]
            left = left[cut[left] < 0]
            if not len(left):
                break
        # What lies further out, of the intervals that have more.
        left = left[high[left] - 1 - low[left] > NEAR]
        if len(left):
            n = high[left] - 1 - low[left]
            ends = np.cumsum(n)
            at = np.arange(int(ends[-1])) + np.repeat(low[left] - (ends - n), n)
            of = np.repeat(left, n)
            hit = common(at)
            at, of = at[hit], of[hit]
            near = np.lexsort((np.abs(at - mid[of]), of))
            at, of = at[near], of[near]
            nearest = np.flatnonzero(np.diff(of, prepend=-1))
            cut[of[nearest]] = at[nearest]
        split = cut >= 0
        at = cut[split]
        found.append(at)
        low, high = np.concatenate((low[split], at + 1)), np.concatenate((at + 1, high[split]))
        order = np.argsort(low, kind="stable")
        low, high = low[order], high[order]
    return np.sort(np.concatenate(found))


class Aligned:
    """A slice of texts: tokens of those that both sides spell again, their groups and links.

    n_a, n_b, n_groups: of each text. a, b: all ids in order; a_group, b_group: the group of each. a_of, b_of: of each link the place of its tokens.
    """

    def __init__(self, texts: pa.Array, left: tuple, right: tuple):
        (a_ids, a_table), (b_ids, b_table) = left, right
        plain = pc.fill_null(texts.cast(pa.large_string()), "")
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), plain, pa.scalar(" ", pa.large_string()))
        held_a, held_b = a_ids.encode(spaced), b_ids.encode(plain)
        a, b = (np.frombuffer(b"".join(held), "<u4").astype(np.int64) for held in (held_a, held_b))
        n_a, n_b = (np.array([len(x) // 4 for x in held], np.int64) for held in (held_a, held_b))
        there = pc.binary_length(plain).to_numpy() > 0
        data = np.frombuffer(b"".join(x.encode() for x in spaced.to_pylist()), np.uint8)
        size = pc.binary_length(spaced).to_numpy().astype(np.int64)
        for ids, n, kind in ((a, n_a, a_table), (b, n_b, b_table)):
            there &= self._spelled(ids, n, kind, data, size)
        a, b = a[np.repeat(there, n_a)], b[np.repeat(there, n_b)]
        self.n_a, self.n_b = np.where(there, n_a, 0), np.where(there, n_b, 0)
        self.a, self.b = a, b
        a_end, b_end = np.cumsum(a_table.size[a]), np.cumsum(b_table.size[b])
        high = np.cumsum(self.n_a)[there]
        at = cuts(a_end, b_end, high - self.n_a[there], high)
        is_a, is_b = (np.zeros(int(a_end[-1]) + 1 if len(a) else 1, bool) for _ in range(2))
        is_a[a_end], is_b[b_end] = True, True
        before_a, before_b = (np.cumsum(x, dtype=np.int32) - x for x in (is_a, is_b))  # ends before each byte
        b_at = before_b[a_end[at]]
        self.a_group, self.b_group = (np.cumsum(np.bincount(x + 1, minlength=n + 1)[:n]) for x, n in ((at, len(a)), (b_at, len(b))))
        text = np.repeat(np.arange(len(texts)), self.n_a)
        self.n_groups = np.bincount(text[at], minlength=len(texts))
        both = np.flatnonzero(is_a | is_b)
        self.a_of, self.b_of = before_a[both], before_b[both]
        self.n_links = self.n_a + self.n_b - self.n_groups

    @staticmethod
    def _spelled(ids: np.ndarray, n: np.ndarray, kind: Table, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ids of each text spell its bytes."""
        ends = np.cumsum(kind.size[ids])
        made = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))])
        fits = made == size
        same = np.ones(len(n), bool)
        mine, its = kind.spell(ids, ends)[np.repeat(fits, made)], data[np.repeat(fits, size)]
        wrong = np.flatnonzero(mine != its)
        same[np.flatnonzero(fits)[np.unique(np.searchsorted(np.cumsum(size[fits]), wrong, "right"))]] = False
        return fits & same

    def shown(self, a_table: Table, b_table: Table) -> Iterator[bytes]:
        """Of each text its groups, as `a1,a2|b1;a3|b2,b3`."""
        groups = int(self.n_groups.sum())
        before_a, before_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=groups)))) for g in (self.a_group, self.b_group))
        wide = max(a_table.wide, b_table.wide)
        cells = np.zeros((len(self.a) + len(self.b), wide), np.uint8)
        length = np.empty(len(cells), np.int64)
        for ids, kind, place, last, mark in (
            (self.a, a_table, np.arange(len(self.a)) + before_b[self.a_group], before_a[1:] - 1, ord("|")),
            (self.b, b_table, np.arange(len(self.b)) + before_a[self.b_group + 1], before_b[1:] - 1, ord(";")),
        ):
            sign = np.full(len(ids), ord(","), np.uint8)
            sign[last] = mark
            cells[place, : kind.wide] = kind.digits[ids]
            length[place] = kind.shown[ids]
            cells[place, length[place]] = sign
        flat = cells.ravel()
        flat = flat[flat != 0].tobytes()
        tokens = np.cumsum(self.n_a + self.n_b)
        ends = np.concatenate(([0], np.cumsum(length + 1)))[np.concatenate(([0], tokens))].tolist()
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            yield flat[i : max(i, j - 1)]


_loaded: dict[tuple[str, str], tuple] = {}


def _sides(a_path: str, b_path: str) -> tuple:
    """Both tokenizers and their tables, read once a Python process."""
    if (a_path, b_path) not in _loaded:
        a, b = ByteIds(a_path), PieceIds(b_path)
        _loaded[a_path, b_path] = (a, Table(a.bytes_of)), (b, Table(b.bytes_of))
    return _loaded[a_path, b_path]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id and groups (array of structs of the ids a and b), empty for texts without tokens."""
    paths = (a_path or default_paths()[0], b_path or default_paths()[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = _sides(*paths)
        for batch in small_batches(batches, 8192, "text", SLICE_BYTES):
            made = Aligned(batch.column("text"), left, right)
            n = int(made.n_groups.sum())
            sides = []
            for ids, group in ((made.a, made.a_group), (made.b, made.b_group)):
                ends = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n))))
                sides.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
            ends = np.concatenate(([0], np.cumsum(made.n_groups)))
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, ["a", "b"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "groups"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, groups array<struct<a: array<int>, b: array<int>>>")


# ---- links and their counts over the corpus
_SLICES = "slice string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, pairs binary, codes binary, pair long, n long"
_NAMES = [c.split()[0] for c in _SLICES.split(", ")]
_KINDS = [pa.string(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as four runs of bytes, which files store well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _merged(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(n, first) if len(first) else n


def sliced(docs: DataFrame, paths: tuple[str, str], n_b: int) -> DataFrame:
    """Slices of texts with their groups' hashes and links, and rows of (pair, n): links of each task by pair (id of A * n_b + id of B)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = _sides(*paths)
        pairs, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def summed() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(pairs), 1 << 16):
                part = pa.array(pairs[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part[0]), k) for k in _KINDS[:-2]), *part], names=_NAMES)

        for batch in small_batches(batches, 8192, "text", SLICE_BYTES):
            made = Aligned(batch.column("text"), left, right)
            own, n, code = ranked(made.a[made.a_of] * n_b + made.b[made.b_of])
            usual = np.argsort(-n, kind="stable")  # the most usual pair has the least code
            rank = np.empty(len(own), np.int64)
            rank[usual] = np.arange(len(own))
            shas = [hashlib.sha256(x).hexdigest() if x else "" for x in made.shown(left[1], right[1])]
            ids = batch.column("doc_id").to_pylist()
            row = [uuid.uuid4().hex, ids, *(x.tolist() for x in (made.n_a, made.n_b, made.n_groups, made.n_links)), shas, own[usual].tobytes(), _planes(rank[code]), None, None]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], names=_NAMES)
            waiting.append((own, n))
            if sum(len(w) for w, _ in waiting) > len(pairs):
                pairs, counts = _merged(np.concatenate([pairs, *(w for w, _ in waiting)]), np.concatenate([counts, *(w for _, w in waiting)]))
                waiting = []
                if len(pairs) > FLUSH_PAIRS:
                    yield from summed()
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = _merged(np.concatenate([pairs, *(w for w, _ in waiting)]), np.concatenate([counts, *(w for _, w in waiting)]))
        yield from summed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SLICES)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _told(slices: DataFrame, known) -> DataFrame:
    """The rows of each text; known(batch) gives the counts and whether they are best, in the order of the slice's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            count, best = known(batch)
            code = _from_planes(batch.column("codes")[0].as_py())
            links = batch.column("n_links")[0].values
            ends = np.concatenate(([0], np.cumsum(links.to_numpy())))
            of = lambda x: pa.array(np.diff(np.concatenate(([0], np.cumsum(x[code], dtype=np.int64)))[ends]))
            columns = [batch.column(c)[0].values for c in ("doc_id", "n_a", "n_b", "n_groups")]
            out = [*columns, links, of(best), of(count), batch.column("shas")[0].values]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in _RESULT.split(", ")])

    return slices.mapInArrow(run, _RESULT)


def summary(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, *, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Of each text: tokens, groups, links, links whose pair is its B id's most frequent, and the sum of the links' counts."""
    spark = docs.sparkSession
    paths = (a_path or default_paths()[0], b_path or default_paths()[1])
    n_b = len(_sides(*paths)[1][0].bytes_of)
    folder = f"{scratch(spark).rstrip('/')}/aligned-{uuid.uuid4().hex}"
    with arrow_batches(spark, BATCH):
        sliced(docs, paths, n_b).write.options(compression="zstd", **ROW_BY_ROW).parquet(f"{folder}/slices")
    stored = spark.read.parquet(f"{folder}/slices")
    sums = stored.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n"))
    sums.write.parquet(f"{folder}/pairs")  # read three times
    sums = spark.read.parquet(f"{folder}/pairs").withColumn("b", F.col("pair") % n_b)
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    counts = sums.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    slices = stored.filter("pair IS NULL").select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "shas", "pairs", "codes")

    def kept(slices: DataFrame, known) -> DataFrame:
        with arrow_batches(spark, BATCH):
            _told(slices, known).write.parquet(f"{folder}/told")
        return spark.read.parquet(f"{folder}/told")

    if sums.count() <= most_pairs:
        every = counts.toArrow().sort_by("pair")
        sent = spark.sparkContext.broadcast(tuple(np.asarray(every.column(c).combine_chunks()) for c in ("pair", "n", "best")))

        def known(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            pair, n, best = sent.value
            at = np.searchsorted(pair, np.frombuffer(batch.column("pairs")[0].as_py(), np.int64))
            return n[at], best[at].astype(np.int64)

        return kept(slices.drop("slice"), known)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            pair = np.frombuffer(batch.column("pairs")[0].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("slice")[0].as_py()] * len(pair)), pa.array(pair)], names=["slice", "pair"])

    each = slices.select("slice", "pairs").mapInArrow(listed, "slice string, pair long").join(counts, "pair")
    lists = each.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("told")).select("slice", *[F.col(f"told.{c}").alias(f"_{c}") for c in ("pair", "n", "best")])

    def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        pair, n, best = (np.asarray(batch.column(c)[0].values.to_numpy(zero_copy_only=False)) if batch.column(c).is_valid()[0].as_py() else np.zeros(0, np.int64) for c in ("_pair", "_n", "_best"))
        at = np.searchsorted(pair, np.frombuffer(batch.column("pairs")[0].as_py(), np.int64))
        return n[at], best[at].astype(np.int64)

    return kept(slices.join(lists, "slice", "left").drop("slice"), joined)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents").select("doc_id", "text"))
