"""The prefix trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from assayer.llm import convtrie
from assayer.llm.queries import queries


def brute(paths):
    """paths: id -> list of (name, bytes). Rows as `nodes` gives them."""
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * p[-1][1] if p else 0)
    out = []
    for p, ms in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(paths[c]) == len(p)))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made(rng, n=120, long=0):
    paths = {}
    for c in rng.sample(range(-50, 10 * n), n):
        kind = rng.random()
        turns = [(f"t{rng.randrange(2 if kind < 0.7 else 5)}", rng.randrange(3)) for _ in range(rng.randrange(0, 6))]
        paths[c] = [(name, len(name) + size) for name, size in turns]
    for c in range(long):
        paths[100_000 + c] = [("same", 4)] * 300 + [(f"end{c % 2}", 4)] * (c % 3)
    return paths


def key(turns):
    return b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns)


def rows_of(paths):
    return [(c, bytearray(key(ts)), [size for _, size in ts]) for c, ts in paths.items()]


@pytest.mark.parametrize("fan,piece_rows", [(16, 4096), (2, 3), (3, 1)])
def test_equals_a_dictionary_of_prefixes(spark, fan, piece_rows):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        paths = made(random.Random(fan), long=7)
        frame = spark.createDataFrame(rows_of(paths), "conv_id long, key binary, sizes array<long>").repartition(4)
        got = convtrie.nodes(frame, fan=fan, piece_rows=piece_rows).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got), key=repr) == brute(paths)


@pytest.mark.parametrize("seed", range(30))
def test_forests_contract_and_merge_at_any_boundaries(seed):
    rng = random.Random(seed)
    paths = made(rng, n=rng.choice([1, 2, 5, 40]), long=rng.choice([0, 3]))
    order = sorted(paths, key=lambda c: (key(paths[c]), c))
    chains = [convtrie.Chain(key(paths[c]), [s for _, s in paths[c]], {len(paths[c]): convtrie.Sums(1, c, 0, 0, 0, c)}) for c in order]
    found, runs, at = [], [], 0
    while at < len(chains):
        step = rng.randrange(1, 6)
        made_ = convtrie.Forest(chains[at : at + step], False)
        found += list(made_.nodes(1, 0))
        runs.append(made_.contracted())
        at += step
    while len(runs) > 1:
        step = rng.randrange(2, 4)
        forests = [convtrie.Forest([c for r in runs[i : i + step] for c in r], False) for i in range(0, len(runs), step)]
        for f in forests:
            found += list(f.nodes(1, 0))
        runs = [f.contracted() for f in forests]
    found += list(convtrie.Forest(runs[0], True).nodes(1, 0))
    names = {r[12]: r[3] for r in found}
    got = [(r[3], r[4], names[r[11]] if r[11] else r[5], *r[6:10]) for r in found]
    assert sorted(got, key=repr) == [r[:-1] for r in brute(paths)]


def plain(turns):
    """id -> turns of each conversation, ordered."""
    out = {}
    for c, t, r, x in sorted([t for t in turns if t[0] is not None], key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        out.setdefault(c, []).append(((r or "", x or ""), len((x or "").encode())))
    return out


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def test_turns_of_any_kind(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, "b"), (1, 0, "assistant", None), (1, 0, "assistant", None), (2, 5, "x:y", "\u00e9\U0001f600"), (2, -3, "x", ":y"), (None, 1, "user", "lost"), (3, None, None, None), (7, 1, "user", "a"), (7, 2, "user", "a"), (8, 1, "user", "a")]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, run int")
    got = convtrie.trie(frame).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(plain(rows))


def test_rebuilding_and_empty_tables(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("abc")) for c in [0, 1, 2, 3, 4, 6, 7, 12, 15, 16, 19, 20] for t in range(rng.randrange(1, 14))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = convtrie.nodes(convtrie.paths_of(convtrie.rebuilt(convtrie.turns_of(frame)))).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rebuilt(plain(rows)))
    assert convtrie.trie(frame.limit(0)).collect() == []


def test_the_query_equals_the_dictionary(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = queries()["op12_conversation_trie"](spark, sf)
    assert set(got.columns) == set(COLUMNS)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == brute(rebuilt(plain(map(tuple, rows))))
