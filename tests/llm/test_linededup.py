"""Line dedup against a plain dictionary of lines, by both ways of probing."""

import random
import re

import numpy as np
import pytest

from assayer.llm import linededup
from assayer.llm.queries import queries

ENDS = " \t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(ENDS))


def brute(rows, least_docs=3, least_chars=20):
    """doc_id -> sorted (n_lines, n_dropped, text) of each of its rows."""
    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                holders.setdefault(key_of(line), set()).add(d)
    keeper = {k: max([d for d in ds if d is not None], default=None) for k, ds in holders.items() if len(ds) >= least_docs}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in keeper or (d is not None and d == keeper[key_of(x)])]
        out.append((d, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


def made(rng):
    common = ["A line that many documents share", "one more LINE of shared text here", "short", "", "\u00c9t\u00e9 accents count as code points", "\u00a0nbsp is no white space here\u00a0"]
    rows = []
    for d in range(60):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own line {rng.random()} of document {d}" for _ in range(rng.randrange(0, 8))]
        lines = [rng.choice([x, f"  {x}\t", x.upper() if x.isascii() else x]) for x in lines]
        rows.append((d, "\n".join(lines)))
    return rows + [(7, rows[3][1]), (None, rows[4][1]), (None, common[0]), (None, common[0]), (70, None), (71, ""), (72, common[0] + "\n" + common[0]), (73, "\n\n"), (74, ("x" * 30 + "\n") * 5000)]


@pytest.mark.parametrize("array_bytes", [1 << 30, 0])
@pytest.mark.parametrize("shard_lines", [1 << 18, 2])
def test_equals_a_dictionary_of_lines(spark, array_bytes, shard_lines):
    rows = made(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = linededup.drop_repeated(docs, array_bytes=array_bytes, shard_lines=shard_lines).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_thresholds_are_parameters(spark):
    rows = [(1, "abc\nxyz"), (2, "ABC "), (3, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.drop_repeated(docs, least_docs=2, least_chars=3).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2, 3)


def test_edges_and_empty_tables(spark, edges, empty):
    got = linededup.drop_repeated(edges)
    assert got.count() == edges.count() and set(edges.columns) < set(got.columns)
    assert {r["ids"] for r in got.collect()} == {"keep me"}
    assert linededup.drop_repeated(empty).collect() == []
    assert linededup.drop_repeated(empty, array_bytes=-1).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 70_000):
        a, b = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64)
        if n > 10:  # pairs that share one half are told apart
            a[:5], b[5:10] = a[0], b[5]
        made = linededup.Perfect.of(a, b)
        assert sorted(made.index(a, b).tolist()) == list(range(n))
        assert 64 * len(made.bits) <= 4 * n + 64 * len(made.sizes) + 64
        arrays = linededup.Arrays(*linededup.Arrays.row(a, b, np.arange(n) + 3, np.arange(n)))
        count, keeper = arrays.find(a, b)
        assert count.tolist() == [i + 3 for i in range(n)] and keeper[count > 0].tolist() == list(range(n))
        other = rng.integers(0, 1 << 63, 1000, np.uint64)
        assert not arrays.find(other, other)[0].any()


def test_the_query_equals_the_dictionary(spark, sf, documents):
    rows = list(documents.itertuples(index=False, name=None))
    import hashlib

    want = {d: (n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, k, t in brute([(int(d), t) for d, t in rows])}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries()["op13_line_dedup"](spark, sf).collect()}
    assert got == want
