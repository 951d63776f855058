"""Alignment of two tokenizers against plain sets of ends."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from assayer.llm import alignment
from assayer.llm.queries import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", "Hello  world,\n\n\tit's 12345 o'clock ", "<|endoftext|> and <s> </s> <unk> <0x41>", "\u2581 is not a space", "x\u2581", "\u00e9t\u00e9 \u65e5\u672c\u8a9e\u306e\u6587 \U0001f600\U0001f3fd",
    "\x00\x01 \r\n", "x" * 3000, "ab" * 999 + " tail", "repeated words repeated words", "repeated words repeated words", " leading", "trailing ", "\u0e44\u0e17\u0e22 \u0633\u0644\u0627\u0645", "\ufeffbom", "long " * 5000,
]


def bytes_of_a():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def brute(rows):
    library, pieces, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), bytes_of_a()
    library.encode_special_tokens = True
    found = []
    for d, text in rows:
        made = None
        if text:
            want = (" " + text).encode()
            a = library.encode(" " + text, add_special_tokens=False).ids
            b = pieces.encode(text)
            a_bytes = [bytes(byte[c] for c in library.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
            if b"".join(a_bytes) == want == b"".join(b_bytes):
                a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
                cut = sorted(set(a_end) & set(b_end))
                groups, i, j = [], 0, 0
                for c in cut:
                    k, m = a_end.index(c, i) + 1, b_end.index(c, j) + 1
                    groups.append((a[i:k], b[j:m]))
                    i, j = k, m
                links, i, j = [], 0, 0
                while i < len(a) and j < len(b):  # overlap of [end - size, end)
                    links.append((a[i], b[j]))
                    x, y = a_end[i], b_end[j]
                    i, j = i + (x <= y), j + (y <= x)
                made = len(a), len(b), groups, links
        found.append((d, made))
    count = Counter(x for _, m in found if m for x in m[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out, shown = [], []
    for d, m in found:
        if m is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            shown.append((d, []))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in m[2])
        best = sum(count[x] == most[x[1]] for x in m[3])
        out.append((d, m[0], m[1], len(m[2]), len(m[3]), best, sum(count[x] for x in m[3]), hashlib.sha256(text.encode()).hexdigest()))
        shown.append((d, m[2]))
    return sorted(out, key=repr), sorted(shown, key=repr)


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 0])
def test_equals_plain_sets_of_ends(spark, most_pairs):
    rows = [*enumerate(TEXTS), (3, "repeated id"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, pair string").repartition(5)
    want, shown = brute(rows)
    got = alignment.summary(docs, most_pairs=most_pairs).collect()
    assert sorted(map(tuple, got), key=repr) == want
    if most_pairs:
        got = [(r["doc_id"], [(list(g["a"]), list(g["b"])) for g in r["groups"]]) for r in alignment.groups(docs).collect()]
        assert sorted(got, key=repr) == shown


def test_cuts_of_any_ends():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 400):
        for share in (0.02, 0.3, 0.9):
            a, b = (np.unique(np.append(rng.choice(4 * n, max(1, int(share * n)), replace=False), [4 * n, 9 * n])) for _ in range(2))
            middle = int(np.searchsorted(a, 4 * n)) + 1
            got = alignment.cuts(a, b, np.array([0, middle]), np.array([middle, len(a)]))
            assert a[got].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_empty_table(spark, empty):
    assert alignment.summary(empty).collect() == [] and alignment.groups(empty).collect() == []


def test_the_query_equals_plain_sets(spark, sf, documents):
    want, _ = brute([(int(d), t) for d, t in documents.itertuples(index=False, name=None)])
    got = queries()["op11_token_alignment"](spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_words_reach_the_library_once():
    """Whatever signs follow a word, tokenizer A encodes its letters once."""
    side = alignment.ByteIds(A)
    side.encode(pa.array([" gamma gamma, gamma. gamma;\ngamma"]))
    assert sorted(w for w in map(str, side.known.known) if w.strip(" ")) == sorted([" gamma", ",", ".", ";", "\n", "gamma"])


def test_slices_come_apart(spark, tmp_path, monkeypatch):
    """Rows of megabytes: files of them end a row group early, batches of them are small, and the session's setting is as before."""
    monkeypatch.setattr(alignment, "scratch", lambda spark: str(tmp_path))
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(5000)]
    rows = [(i, " ".join(rng.choice(words, 70_000))) for i in range(24)]
    before, seen = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), []
    told = alignment._told

    def watched(slices, known):
        seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
        return told(slices, known)

    monkeypatch.setattr(alignment, "_told", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_links for r in alignment.summary(docs).collect()}
    assert set(got) == set(range(24)) and all(got.values())
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before and seen == [alignment.BATCH]
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in tmp_path.glob("aligned-*/slices/*.parquet") for k in range(pq.ParquetFile(f).num_row_groups)]
    held = [g for g in groups if g.total_byte_size > 1 << 20]
    assert len(held) > 1 and max(g.total_byte_size for g in held) < 16 << 20
