"""Ids of texts word by word: each different word of a slice of texts is encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def encoded(texts: pa.Array, unclear: pa.Array, whole: Callable, units: Callable, first: str = "") -> list[bytes]:
    """Ids (unsigned 32-bit) of each text, as bytes.

    texts: without nulls. `unclear` marks those that `whole` encodes (a list of texts to a list of ids); the others are split at spaces, and
    `units` encodes their different words, each with a space before it, the first of a text with `first` instead: an array of words to
    all their ids in one array and how many each has.
    """
    out: list[bytes] = [b""] * len(texts)
    mask = unclear.to_numpy(zero_copy_only=False)
    hard, easy = np.flatnonzero(mask), np.flatnonzero(~mask)
    if len(hard):
        for k, ids in zip(hard.tolist(), whole(texts.take(pa.array(hard)).to_pylist()), strict=True):
            out[k] = ids
    if not len(easy):
        return out
    split = pc.split_pattern(texts.take(pa.array(easy)), " ")
    ends = np.asarray(split.offsets) - split.offsets[0].as_py()
    words = split.flatten().dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    every = [words.dictionary]
    begin = ends[:-1]
    if first != " ":
        every.append(words.dictionary.take(pa.array(code[begin])))
        code[begin] = len(words.dictionary) + np.arange(len(begin))
    fronts = (pa.scalar(f, every[0].type) for f in (" ", first))
    flat, size = units(pa.concat_arrays([pc.binary_join_element_wise(f, e, pa.scalar("", e.type)) for f, e in zip(fronts, every, strict=False)]))
    flat, total = gathered(flat, size, code)
    cuts = np.concatenate(([0], total))[ends].tolist()
    for k, a, b in zip(easy.tolist(), cuts[:-1], cuts[1:], strict=True):
        out[k] = flat[a:b].tobytes()
    return out


def gathered(flat: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words `code`, of all words' ids in `flat`, and the end of each."""
    n = size[code]
    total = np.cumsum(n)
    shift = (np.cumsum(size) - size)[code] - (total - n)
    at = np.repeat(shift.astype(np.int32 if len(flat) >> 31 == 0 else np.int64), n)
    at += np.arange(len(at), dtype=at.dtype)
    return flat.take(at), total


class Memo:
    """Ids of words that were encoded before: the first `most` of at most `chars` characters, which in a text are the usual ones.

    `encode`: a list of words to a list of ids.
    """

    def __init__(self, encode: Callable, most: int = 300_000, chars: int = 48):
        self.encode, self.most, self.chars = encode, most, chars
        self.known, self.flat, self.size = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _encoded(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode(new.to_pylist())
        return np.frombuffer(b"".join(ids), "<u4"), np.array([len(i) // 4 for i in ids], np.int64)

    def _found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of all that is known now, and the place of each word among them."""
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        is_new, flat, size = at < 0, self.flat, self.size
        if is_new.any():
            new = words.filter(pa.array(is_new)).dictionary_encode()
            at[is_new] = len(size) + new.indices.to_numpy()
            new = new.dictionary
            made, n_made = self._encoded(new)
            flat, size = np.concatenate((flat, made)), np.concatenate((size, n_made))
            if len(self.known) < self.most:
                short = pc.less_equal(pc.utf8_length(new), self.chars).to_numpy(zero_copy_only=False)
                kept = np.concatenate((np.ones(len(self.size), bool), short))
                self.known = pa.concat_arrays([self.known, new.filter(pa.array(short))])
                self.flat, self.size = flat[np.repeat(kept, size)], size[kept]
        return flat, size, at

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, size, at = self._found(words.cast(pa.large_string()))
        return gathered(flat, size, at)[0], size[at]


#: Letters that every version of Unicode holds for letters (Latin and Cyrillic), and ASCII signs that are neither letters, digits nor white space.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ʯЀ-ҁҊ-ԯ", r"!-/:-@\[-`{-~"
_RUN = f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+"
#: Nearly all words, told in one go; what is at the front of the others.
_WORD = f"^(?P<stem> ?[{_LETTERS}]+)(?P<tail>[{_SIGNS}]*)$"
_FRONT = f"^(?P<stem>{_RUN}|\n)(?P<tail>[{_SIGNS}]*)(?P<left>(?s:.*))$"
_PIECE = f"^(?:{_RUN})$"
#: What the library splits otherwise, by the pieces and what is left behind them: a short form, more white space.
_SHORT, _WHITE = "^(?:s|t|re|ve|m|ll|d)", r"^[\s\x{85}\p{Z}]"


class Pieces(Memo):
    """Ids of words by their pieces, which the library splits there too: runs of letters, digits or signs with the space before them, single line feeds.

    `plain` encodes such runs (an array to all ids and the number of each), `encode` all other words.
    """

    def __init__(self, plain: Callable, encode: Callable, *limits: int):
        super().__init__(encode, *limits)
        self.plain = plain

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = words.cast(pa.large_string())
        split = pc.extract_regex(words, _WORD)
        stem, tail = (pc.struct_field(split, k) for k in range(2))
        longer = split.is_null().to_numpy(zero_copy_only=False)
        signed = pc.fill_null(pc.not_equal(tail, ""), False)
        parts, of_parts = [stem.filter(pa.array(~longer)), tail.filter(signed)], [np.flatnonzero(~longer), np.flatnonzero(signed)]
        whole, of, left = np.zeros(len(words), bool), np.flatnonzero(longer), words.filter(pa.array(longer))
        while len(left):
            split = pc.extract_regex(left, _FRONT)
            stem, tail, rest = (pc.struct_field(split, k) for k in range(3))
            more = pc.fill_null(pc.not_equal(rest, ""), False)
            quote = pc.and_(pc.equal(pc.if_else(pc.equal(tail, ""), stem, tail), "'"), pc.match_substring_regex(rest, _SHORT))
            feed = pc.and_(pc.equal(pc.binary_join_element_wise(stem, tail, pa.scalar("", stem.type)), "\n"), pc.match_substring_regex(rest, _WHITE))
            other = pc.fill_null(pc.or_(quote, feed), True).to_numpy(zero_copy_only=False)
            whole[of[other]] = True
            for part, there in ((stem, ~other), (tail, ~other & pc.fill_null(pc.not_equal(tail, ""), False).to_numpy(zero_copy_only=False))):
                parts.append(part.filter(pa.array(there)))
                of_parts.append(of[there])
            more = more.to_numpy(zero_copy_only=False) & ~other
            left, of = rest.filter(pa.array(more)), of[more]
        parts = [p.filter(pa.array(~whole[o])) for p, o in zip(parts, of_parts, strict=True)]
        of = np.concatenate([np.zeros(0, np.int64), *(o[~whole[o]] for o in of_parts), np.flatnonzero(whole)])
        flat, size, at = self._found(pa.concat_arrays([words[:0], *parts, words.filter(pa.array(whole))]))
        at = at[np.argsort(of, kind="stable")]
        flat, _ = gathered(flat, size, at)
        return flat, np.bincount(np.sort(of), size[at], len(words)).astype(np.int64)

    def _encoded(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        is_plain = pc.match_substring_regex(new, _PIECE).to_numpy(zero_copy_only=False)
        flat, size = self.plain(new.filter(pa.array(is_plain)))
        other, n_other = super()._encoded(new.filter(pa.array(~is_plain)))
        flat, size = np.concatenate((flat, other)), np.concatenate((size, n_other))
        back = np.empty(len(new), np.int64)
        back[np.concatenate((np.flatnonzero(is_plain), np.flatnonzero(~is_plain)))] = np.arange(len(new))
        return gathered(flat, size, back)[0], size[back]
