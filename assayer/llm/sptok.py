"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, for each place of a text, all pieces that end there, longest first (its output links). Each one
relaxes the best path of that place: the best path to its start and its own score, if that is more than what is known. Of equal
sums the longer last piece stays. What a piece scores depends on the model:

- scores (unigram models): its score.
- merges (the default, for models of merges as piece_bpe_32k is): its score after a neighbour that merging would leave beside it,
  else minus infinity. Each place then has one finite path only, and the whole text's is what merging in
  order of scores gives: the same ids as the library's. A plain sum of merge ranks would prefer rare splits of common words.

A character without a piece becomes its bytes. Text is normalised as the model asks: a space in front, spaces as
U+2581, nothing else. No piece crosses from another character to U+2581, and none holds a line feed, so texts are
segmented unit by unit between such places; each different word of a slice of texts once, many are remembered.

Defined results: null and empty texts have no ids and decode to an empty text. U+2581 in a text decodes to a space. Repeated rows are each
encoded. Columns named as results are replaced, others stay as they are. Empty tables give empty tables. Very long texts are
held a few at a time; one text's ids are held whole.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import small_batches, table

MEMO = 200_000
SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Any:
    """Stands for the pieces that may follow a piece where every piece may."""

    def get(self, name: str) -> _Any:
        return self


class Pieces:
    """A model's pieces and scores, read with the library; encoding and decoding are done here."""

    def __init__(self, path: str, order: str = "merges"):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [sp.unk_id()] * 256
        self.single: dict[str, tuple[int, float]] = {}
        self.automaton = ahocorasick.Automaton()
        least = 0.0
        crossing, feed = False, False
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                score = sp.get_score(i)
                least = min(least, score)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                self.automaton.add_word(piece, (len(piece), score, i, piece))
                if len(piece) == 1:
                    self.single[piece] = (i, score)
                crossing |= re.search(f"[^{SPACE}]{SPACE}", piece) is not None
                feed |= "\n" in piece
        self.automaton.make_automaton()
        self.unknown = least - UNKNOWN_PENALTY
        self.units = None if crossing else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if feed else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.score = {p: s for p, (_, s, _, _) in self.automaton.items()}
        self.any = None if order == "merges" else _Any()
        # For a piece, by the next one, the row of that one, or False where merging would not leave the two.
        self.fits: dict[str, dict] = {}
        self.known = words.Memo(self._of_units)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the neighbours with the best joint piece first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b (or b alone, if a is empty) as two pieces."""
        return self.merged(a + b) == ([a, b] if a else [b])

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of normalised text."""
        # By the last character; the place before the first one is the last element, index -1.
        score: list = [None] * len(text) + [0.0]
        back: list = [None] * len(text)  # id and text of the last piece
        if len(self.fits) > MEMO // 10:
            self.fits = {}
        rows: list = [None] * len(text) + [self._row("")]  # what may follow
        strange = [] if self.single.keys() >= set(text) else [i for i, c in enumerate(text) if c not in self.single]
        strange.append(len(text))
        done, stop = 0, strange[0]
        one = self.any is None  # of merges one path is finite: a place that has one is done
        for last, (size, gain, piece, name) in self.automaton.iter(text):
            if one and rows[last] is not None:
                continue
            while stop < last:
                self._take_strange(text, stop, score, back, rows)
                done += 1
                stop = strange[done]
            row = rows[last - size]
            if row is None:
                continue
            after = row.get(name)
            if after is None:
                before = back[last - size][1] if last >= size else ""
                after = row[name] = self._row(name) if self._fit(before, name) else False
            if after is False:
                continue
            now, total = score[last], score[last - size] + gain
            if now is None or total > now:
                score[last], back[last], rows[last] = total, (piece, name), after
        for at in strange[done:-1]:
            self._take_strange(text, at, score, back, rows)
        out, at = [], len(text) - 1
        while at >= 0:
            piece, name = back[at]
            if piece is None:
                out += [self.byte_id[b] for b in reversed(name.encode("utf-8", "replace"))]
            else:
                out.append(piece)
            at -= len(name)
        out.reverse()
        return out

    def _row(self, name: str) -> dict | _Any:
        """What may follow a piece (or begin a text, if it is empty), as far as known."""
        return self.any or self.fits.setdefault(name, {})

    def _take_strange(self, text: str, at: int, score: list, back: list, rows: list) -> None:
        """Relaxes the place after a character without a piece."""
        if score[at - 1] is not None:
            score[at], back[at], rows[at] = score[at - 1] + self.unknown, (None, text[at]), self._row(text[at])

    def _of_units(self, units: list[str]) -> list[bytes]:
        """Ids of words with their space in front."""
        return [array("I", [i for u in self.units.findall(w.replace(" ", SPACE)) for i in self.best(u)]).tobytes() for w in units]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = [(SPACE + t.replace(" ", SPACE)) if t else "" for t in texts]
        units = [self.units.findall(t) if self.units else [t] * bool(t) for t in found]
        ids = {u: array("I", self.best(u)).tobytes() for u in {u for us in units for u in us}}
        return [b"".join([ids[u] for u in us]) for us in units]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # Where a space does not begin a unit: at the start, after another one, beside U+2581.
        unclear = pc.match_substring_regex(texts, f"^$|^ |  |{SPACE}") if self.units else pa.array([True] * len(texts))
        return words.encoded(texts, unclear, self._whole, self.known, " ")

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[tuple[str, str], Pieces] = {}


def _pieces(path: str, order: str = "merges") -> Pieces:
    """The model of a path, read once a Python process."""
    if (path, order) not in _loaded:
        _loaded[path, order] = Pieces(path, order)
    return _loaded[path, order]


def encode(docs: DataFrame, model: str | None = None, order: str = "merges") -> DataFrame:
    """The columns of `docs` with ids (array of int), n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers)."""
    path = model or model_path()
    docs = docs.drop("ids", "n_tokens", "ids_crc32")  # columns of these names are replaced
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path, order)
        for batch in small_batches(batches, 4096, place, 2 << 20):
            found = pieces.encode(batch.column(place))
            ends = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            more = [ids, pa.array(np.diff(ends).astype(np.int64)), pa.array([zlib.crc32(f) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "ids", "n_tokens", "ids_crc32"])

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """The columns of `tokens` with decoded, the text of its column ids."""
    path = model or model_path()
    tokens = tokens.drop("decoded")
    place = tokens.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in small_batches(batches, 4096, place):
            texts = [pieces.decode(ids.values.to_numpy().tolist() if ids.is_valid else []) for ids in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    tokens = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    return decode(tokens).select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("same_text"))
