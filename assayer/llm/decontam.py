"""Benchmark decontamination by q-gram filtering and banded alignment.

An item is found in a document if some part of the document's normalised text is within the edit budget (ERROR of its length) of the whole normalised item, or within
PART_ERROR of one of its parts: its first, middle and last half, cut at words, where an item has LONG bytes or more (shorter ones: only whole, by PART_ERROR).
Edits come in bursts: a replaced word of w bytes takes w + q - 1 of the m + 1 - q q-grams with it. A text within k edits in at most BURSTS places (or any
(k + BURSTS * (q - 1)) / q edits) so shares m + 1 - q - k - BURSTS * (q - 1) q-grams, near one diagonal; LEAST_SHARE of all are asked for at least.
The scan hashes every q-gram of every document, looks it up among those of items and parts, counts hits in diagonal bands of twice the budget that
overlap by half, keeps the bands that reach the bound, and aligns with those parts only, inside the band. An alignment keeps the
differences of neighbouring cells in the bits of two integers, a step of the band at a time; items that share their beginning share its steps.

Normalised text: lower case, ASCII punctuation and white space as single spaces. Lengths and edits count UTF-8 bytes of it.
Items of at most q bytes have no q-grams to spare: they are found as they are, from word to word, anywhere in a text.

While the items have at most BLOCK_BYTES together (checked), every task holds them all, and documents are not shuffled. Beyond that,
hits (only of q-grams that a bitmap of fixed size lets through) are joined by hash with each item's rarest q-grams, as many as leave fewer than the bound needs: a pair
that reaches the bound shares one of them, and a q-gram of many items joins with few. Only such pairs are counted, and only pairs that reach the bound meet their texts. Either way documents are read once and the driver holds no more than BLOCK_BYTES of items.

Defined results: null or empty documents hold nothing; null or empty items, and those without an id, are never found. Equal items are each
reported, equal rows of items once; repeated documents are each reported. A whole item goes before its parts; of equal distances the earliest end counts. Very long texts are
scanned in slices of rows, a long row as one; empty tables give no matches. Other columns of documents stay as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

Q = 8
ERROR, PART_ERROR = 0.2, 0.06
LONG, BURSTS, LEAST_SHARE = 64, 3, 0.3
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20
#: Pairs of a hit and an item that are held at a time.
PAIRS = 2 << 20
_BITS = 22
#: Bits of the bitmap that stands for the q-grams of items without a bound on their size.
_WIDE_BITS = 26
_SPACED = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_SPACED).split())


def parts_of(item: bytes) -> list[bytes]:
    """A normalised item and, if it is long, its first, middle and last half, cut at words."""
    out, m = [item], len(item)
    for start in (0, m // 4, m // 2) if m >= LONG else ():
        end = start + m // 2
        begin = item.find(b" ", start) + 1 if start and item[start - 1 : start] != b" " else start
        stop = item.rfind(b" ", 0, end + 1) if end < m and item[end : end + 1] != b" " else end
        if stop - begin >= LONG // 3:
            out.append(item[begin:stop])
    return out


def budget(m: int, whole: bool, q: int = Q, error: float = ERROR, part_error: float = PART_ERROR) -> tuple[int, int]:
    """Edits allowed for an item or part of m bytes, and how many q-grams a text must share with it."""
    k = int(m * (error if whole and m >= LONG else part_error))
    n = m + 1 - q
    return k, max(1, int(np.ceil(LEAST_SHARE * n)), n - k - BURSTS * (q - 1))


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each run of q bytes (8 <= q <= 16)."""
    w = data.astype(np.uint64)
    two = w[:-1] | w[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(data) - q + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[q - 8 : q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


class Aligner:
    """Best matches of items with substrings of one part of a text, on the diagonals low..high (column - row).

    Rows are bytes of the item. Of a row the band holds high - low + 1 cells; each differs from the one before by -1, 0 or 1, kept as
    the bits of `more` and `less`. The first cell's value is kept too. Cells outside the part hold bytes that match nothing,
    which never makes a match better. The states of all rows of the last item are kept for the next one that begins alike.
    """

    def __init__(self, part: bytes, low: int, high: int):
        self.part, self.low, self.width = part, low, high - low + 1
        self.text = np.frombuffer(part, np.uint8)
        self.places: dict[int, int] = {}
        self.item = b""
        self.states = [(0, 0, 0)]

    def _where(self, byte: int) -> int:
        if byte not in self.places:
            self.places[byte] = int.from_bytes(np.packbits(self.text == byte, bitorder="little").tobytes(), "little")
        return self.places[byte]

    def best(self, item: bytes, most: int) -> tuple[int, int] | None:
        """(distance, end in the part) of the item, if at most `most`; the earliest end of the least distance."""
        at = self.part.find(item)
        if at >= 0:
            return 0, at + len(item)
        same, top = 0, min(len(item), len(self.states) - 1)
        while same < top:  # how far the last item began alike
            half = (same + top + 1) // 2
            same, top = (half, top) if item[:half] == self.item[:half] else (same, half - 1)
        del self.states[same + 1 :]
        self.item = item
        more, less, value = self.states[-1]
        mask = (1 << self.width) - 1
        for i in range(same, len(item)):
            shift = i + self.low
            where = self._where(item[i])
            match = (where >> shift if shift >= 0 else where << -shift) & mask
            above, below = more >> 1, less >> 1
            even = (((match & above) + above) ^ above) | match | below
            up = below | (mask & ~(even | above))
            down = even & above
            value += 1 - (even & 1)
            up <<= 1
            more, less = ((down << 1) | ~(even | up)) & mask, even & up & mask
            self.states.append((more, less, value))
            if value - less.bit_count() > most:
                return None
        best = None
        for b in range(self.width):
            if b:
                value += (more >> b & 1) - (less >> b & 1)
            if value <= most and (best is None or value < best[0]):
                best = value, min(max(len(item) + self.low + b, 0), len(self.part))
        return best


def _band(item_bytes: int, k: int, band: int) -> tuple[int, int, int, int]:
    """(start, end, low, high): the part of a text that a band covers and the band's diagonals in it."""
    low, high = (band - 1) * (k + 1) - item_bytes - k, (band + 1) * (k + 1) - 1 - item_bytes + k
    start = max(0, low)
    return start, high + item_bytes + 1, low - start, high - start


class Items:
    """Items in memory, indexed by q-gram; those of at most q bytes by an Aho-Corasick automaton."""

    def __init__(self, rows: list[tuple[int, str]], q: int, error: float, part_error: float):
        import ahocorasick

        self.q = q
        short: dict[bytes, list[int]] = defaultdict(list)
        self.ids, self.texts, self.whole = [], [], []
        for item, text in rows:
            norm = normalise(text)
            if len(norm) > q:
                for i, part in enumerate(parts_of(norm)):
                    self.ids.append(item)
                    self.texts.append(part)
                    self.whole.append(not i)
            elif norm:
                short[norm].append(item)
        self.short = ahocorasick.Automaton()
        for norm, ids in short.items():
            self.short.add_word(f" {norm.decode('latin-1')} ", (len(norm), ids))
        if short:
            self.short.make_automaton()
        size = [len(t) for t in self.texts]
        self.size = np.array(size, np.int64)
        bounds = [budget(m, w, q, error, part_error) for m, w in zip(size, self.whole, strict=True)]
        self.k, self.need = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))
        found = [grams(np.frombuffer(t, np.uint8), q) for t in self.texts]
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(size)), [len(f) for f in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(f)) for f in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.names, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(every >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _bands(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, band) of the bands that reach the bound, sorted."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        none = np.zeros(0, np.int64)
        if not self.ids or len(data) <= self.q:
            return none, none, none
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        h = grams(data, self.q)
        hit = np.flatnonzero(self.seen[h >> np.uint64(64 - _BITS)])
        name = np.searchsorted(self.names, h[hit])
        name[name == len(self.names)] = 0
        real = self.names[name] == h[hit]
        hit, name = hit[real], name[real]
        doc = np.searchsorted(at, hit, "right") - 1
        long = (len(data) + 2 * int(self.size.max())) // int(self.k.min() + 1) + 3
        keys, counts = [none], [none]
        sums = np.cumsum(self.count[name])
        cuts = [0]
        while cuts[-1] < len(hit):  # a slice of hits at a time: a q-gram of all items meets many texts
            before = sums[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(sums, before + PAIRS, "right"))))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            times = self.count[name[i:j]]
            start = np.repeat(self.first[name[i:j]] - (np.cumsum(times) - times), times)
            entry = start + np.arange(len(start))
            owner, of = self.owner[entry], np.repeat(doc[i:j], times)
            # Bands of 2 * (k + 1) diagonals, a new one each k + 1; the shift by an item's length keeps diagonals positive.
            band = (np.repeat(hit[i:j], times) - at[of] - self.place[entry] + self.size[owner]) // (self.k[owner] + 1)
            pair = (of * len(self.ids) + owner) * long
            key, count = np.unique(np.concatenate((pair + band, pair + band + 1)), return_counts=True)  # band b: diagonals of b - 1 and b
            keys.append(key)
            counts.append(count)
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate(counts), minlength=len(key))
        pair, band = key // long, key % long
        enough = count >= self.need[pair % len(self.ids)]
        pair, band = pair[enough], band[enough]
        return pair // len(self.ids), pair % len(self.ids), band

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, distance, start, end) of each item found in each text, at its best place."""
        if len(self.short):
            for i, t in enumerate(texts):
                first: dict[int, tuple[int, int]] = {}
                for last, (size, ids) in self.short.iter(f" {t.decode('latin-1')} "):
                    for item in ids:
                        first.setdefault(item, (last - 1 - size, last - 1))
                for item, (start, end) in sorted(first.items()):
                    yield i, item, 0, start, end
        docs, owners, bands = self._bands(texts)
        parts = defaultdict(list)
        for d, o, b in zip(docs.tolist(), owners.tolist(), bands.tolist(), strict=True):
            parts[d, *_band(int(self.size[o]), int(self.k[o]), b)].append(o)
        best: dict[tuple[int, int], tuple[bool, int, int, int]] = {}
        for (d, start, end, low, high), items in parts.items():
            aligner = Aligner(texts[d][start:end], low, high)
            for o in sorted(items, key=self.texts.__getitem__):
                got = aligner.best(self.texts[o], int(self.k[o]))
                if got:
                    match = not self.whole[o], got[0], start + got[1], max(0, start + got[1] - len(self.texts[o]))
                    best[d, self.ids[o]] = min(match, best.get((d, self.ids[o]), match))
        for (d, item), (_, distance, end, start) in sorted(best.items()):
            yield d, item, distance, start, end


_MATCH = "array<struct<item_id: long, distance: int, start: int, end: int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first place, normalised texts) of runs of a column of about SLICE_BYTES."""
    texts, base, size = [], 0, 0
    for i, text in enumerate(column):
        texts.append(normalise(text.as_py()))
        size += len(texts[-1]) + 1
        if size >= SLICE_BYTES or i + 1 == len(column):
            yield base, texts
            texts, base, size = [], i + 1, 0


def _found(block: Items, column: pa.Array) -> list[list[tuple[int, int, int, int]]]:
    """(item id, distance, start, end) of what each text of a column holds."""
    found: list[list] = [[] for _ in range(len(column))]
    for base, texts in _slices(column):
        for d, *match in block.scan(texts):
            found[base + d].append(tuple(match))
    return found


def _known(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()


def _held(known: DataFrame) -> list[tuple[int, str]] | None:
    """The items, if they have at most BLOCK_BYTES together."""
    if (known.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > BLOCK_BYTES:
        return None
    return [tuple(r) for r in known.orderBy("item_id", "text").collect()]


# ---- items without a bound on their size: hits are joined by hash
def _word_runs(text: bytes, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of whole words with at most q bytes in a normalised text."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    gap = np.flatnonzero(data == 32)
    base = np.uint64(0x9E3779B97F4A7C15)
    at, names = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for words in range(1, q // 2 + 2):
        if len(gap) <= words or not text:
            break
        begin, size = gap[:-words] + 1, gap[words:] - gap[:-words] - 1
        begin, size = begin[size <= q], size[size <= q]
        if not len(size):
            break
        h = size.astype(np.uint64)
        for k in range(q):
            h = np.where(k < size, (h ^ data[np.minimum(begin + k, len(data) - 1)].astype(np.uint64)) * base, h)
            h ^= h >> np.uint64(31)
        at.append(begin - 1)
        names.append(h)
    return np.concatenate(at), np.concatenate(names)


def _item_grams(q: int, error: float, part_error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                norm = normalise(text)
                for part, piece in enumerate(parts_of(norm) if norm else ()):
                    m = len(piece)
                    if m > q:
                        h = grams(np.frombuffer(piece, np.uint8), q)
                        k, need = budget(m, not part, q, error, part_error)
                    else:
                        at, h = _word_runs(piece, q)
                        h, k, need = h[at == 0][-1:], 0, 1  # the whole item
                    n = len(h)
                    columns = [pa.array(h.view(np.int64)), pa.array(np.arange(n))] + [pa.array([v] * n, pa.int64()) for v in (item, part, n, m, k, need)]
                    # Equal items with one id are told apart by their text.
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([text] * n, pa.string())], names=["gram", "place", "item_id", "part", "n", "m", "k", "need", "item"])

    return run


def _doc_hits(q: int, seen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for base, texts in _slices(batch.column("text")):
                for i, t in enumerate(texts):
                    at, h = _word_runs(t, q)
                    if len(t) >= q:
                        at, h = np.concatenate((at, np.arange(len(t) - q + 1))), np.concatenate((h, grams(np.frombuffer(t, np.uint8), q)))
                    bit = (h >> np.uint64(64 - _WIDE_BITS)).astype(np.int64)
                    there = (seen[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                    if there.any():
                        n = int(there.sum())
                        yield pa.RecordBatch.from_arrays([pa.array([keys[base + i]] * n, pa.string()), pa.array(h[there].view(np.int64)), pa.array(at[there])], names=["key", "gram", "at"])

    return run


def _aligned(q: int):
    """Matches of pairs (key, text, item_id, item, found: part, k and bands of each part that reaches its bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text, item, best = normalise(r["text"]), normalise(r["item"]), None
                pieces = parts_of(item)
                for f in r["found"] if len(item) > q else ():
                    piece = pieces[f["part"]]
                    for b in f["bands"]:
                        start, end, low, high = _band(len(piece), f["k"], b)
                        got = Aligner(text[start:end], low, high).best(piece, f["k"])
                        if got:
                            match = f["part"] > 0, got[0], start + got[1], max(0, start + got[1] - len(piece))
                            best = min(match, best or match)
                if len(item) <= q and (at := (b" " + text + b" ").find(b" " + item + b" ")) >= 0:
                    best = False, 0, at + len(item), at
                if best:
                    out.append((r["key"], {"item_id": r["item_id"], "distance": best[1], "start": best[3], "end": best[2]}))
            keys, found = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, _ARROW.value_type)], names=["key", "m"])

    return run


def _joined(docs: DataFrame, known: DataFrame, q: int, error: float, part_error: float) -> DataFrame:
    """key (of a text), matches: each text that holds an item, by equi-joins of q-gram hashes."""
    one = ["item_id", "item", "part"]
    entries = cut(known.mapInArrow(_item_grams(q, error, part_error), "gram long, place long, item_id long, part long, n long, m long, k long, need long, item string").withColumn("item", F.md5("item")))
    bit = F.shiftrightunsigned("gram", 64 - _WIDE_BITS)
    words = entries.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(gram, {64 - _WIDE_BITS}) & 63 AS int))").alias("bits"))
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**20 rows, whatever the items
    seen = np.zeros(1 << (_WIDE_BITS - 6), np.uint64)
    seen[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    texts = docs.select("key", "text").filter("text <> ''").dropDuplicates(["key"])  # copies of a text count once
    hits = cut(texts.mapInArrow(_doc_hits(q, seen), "key string, gram long, at long").distinct())
    # Of n q-grams with `need` shared, any n - need + 1 hold a shared one: the rarest of each item or part.
    often = entries.groupBy("gram").agg(F.count("*").alias("often"))
    rare = entries.join(often, "gram").withColumn("_r", F.row_number().over(Window.partitionBy(*one).orderBy("often", "gram", "place"))).filter("_r <= n - need + 1")
    pairs = hits.select("key", "gram").distinct().join(rare.select("gram", *one).distinct(), "gram").select("key", *one).distinct()
    band = F.expr("(at - place + m) div (k + 1)")
    met = pairs.join(entries.drop("n"), one).join(hits, ["key", "gram"]).select("key", *one, "k", "need", F.explode(F.array(band, band + 1)).alias("band"))
    reached = met.groupBy("key", *one, "k", "need", "band").agg(F.count("*").alias("n")).filter("n >= need")
    reached = reached.groupBy("key", *one, "k").agg(F.array_sort(F.collect_list("band")).alias("bands"))
    reached = reached.groupBy("key", "item_id", "item").agg(F.array_sort(F.collect_list(F.struct("part", "k", "bands"))).alias("found"))
    items = known.select("item_id", F.col("text").alias("_item"), F.md5("text").alias("item"))
    both = reached.join(items, ["item_id", "item"]).join(texts, "key").select("key", "text", "item_id", F.col("_item").alias("item"), "found")
    found = both.mapInArrow(_aligned(q), "key string, m struct<item_id: long, distance: int, start: int, end: int>")
    return found.groupBy("key").agg(F.array_sort(F.collect_set("m")).alias("matches"))


def matches(docs: DataFrame, items: DataFrame, *, q: int = Q, error: float = ERROR, part_error: float = PART_ERROR) -> DataFrame:
    """doc_id and matches (item_id, distance, start and end in the normalised text; by item_id) of every row of docs.

    docs: doc_id, text; items: item_id, text.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = _known(items)
    rows = _held(known)
    if rows is None:
        keyed = source.withColumn("key", F.md5("text"))
        found = keyed.select("doc_id", "key").join(_joined(keyed, known, q, error, part_error), "key", "left")
        return found.select("doc_id", F.coalesce("matches", F.expr(f"CAST(array() AS {_MATCH})")).alias("matches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(rows, q, error, part_error)
        names = ("item_id", "distance", "start", "end")
        for batch in batches:
            cells = [[dict(zip(names, m, strict=True)) for m in sorted(f)] for f in _found(block, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cells, _ARROW)], names=["doc_id", "matches"])

    return source.mapInArrow(run, f"doc_id long, matches {_MATCH}")


def keep_clean(docs: DataFrame, items: DataFrame, *, q: int = Q, error: float = ERROR, part_error: float = PART_ERROR) -> DataFrame:
    """The rows of `docs` in which no item is found, with all their columns."""
    known = _known(items)
    rows = _held(known)
    if rows is None:
        keyed = docs.select(F.col("text").cast("string"), F.md5(F.col("text").cast("string")).alias("key"))
        bad = _joined(keyed, known, q, error, part_error).select(F.col("key").alias("_bad_key"))
        return docs.join(bad, F.md5(docs["text"].cast("string")) == F.col("_bad_key"), "left_anti")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(rows, q, error, part_error)
        for batch in batches:
            clean = [not f for f in _found(block, batch.column(place))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_items"),
        F.col("matches.item_id").alias("items"),
        F.array_min("matches.distance").alias("least_distance"),
    )
