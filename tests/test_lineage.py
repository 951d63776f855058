"""Lineage over shared and cyclic archives, and what it adds to verdicts, against a plain walk."""

import os
import random
import time
from pathlib import Path

from assayer.operators import lineage, verdict


def walk(roots, edges, depth):
    out = {}
    for r in {r for r in roots if r is not None}:
        level, seen = {r}, {r: 0}
        for d in range(1, depth + 1):
            level = {c for p, c in edges if p in level and c is not None and c not in seen}
            seen |= dict.fromkeys(level, d)
        out |= {(r, c): d for c, d in seen.items()}
    return out


def test_reached_equals_a_plain_walk(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)] + [("n1", "n1"), ("n2", None), (None, "n3"), ("n4", "n5"), ("n5", "n4")]
    roots = ["n1", "n4", "n4", "n7", "alone", None]
    e = spark.createDataFrame(edges, "parent string, child string")
    r = spark.createDataFrame([(x,) for x in roots], "root string")
    for depth in (1, 3, 32):
        got = lineage.reached(r, e, depth=depth).collect()
        assert {(x["root"], x["content"]): x["depth"] for x in got} == walk(roots, edges, depth) and len(got) == len(walk(roots, edges, depth))
    assert lineage.reached(r.limit(0), e).collect() == [] and lineage.reached(r, e.limit(0)).count() == 4


def test_findings_count_for_every_root(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "x"), ("x", "y"), ("b", "z")], "parent string, child string")
    r = spark.createDataFrame([("a",), ("b",), ("c",)], "root string")
    found = spark.createDataFrame([("y", "medium", "crypto:x"), ("z", "high", "rule:y"), ("q", "high", "rule:y")], "content string, severity string, category string")
    roots = spark.createDataFrame([(x, False, "b", False, 0.1, False) for x in "abc"], "submission string, trusted boolean, baseline_id string, matched boolean, distance double, dynamic_gap boolean")
    got = {x["submission"]: x for x in lineage.root_verdicts(found, lineage.reached(r, e), roots).collect()}
    assert {k: x["state"] for k, x in got.items()} == {"a": "suspicious", "b": "malicious", "c": "inconclusive"}
    assert got["a"]["reasons"] == ["1 findings of medium severity"] and got["b"]["summary"] == verdict.SUMMARIES["malicious"]


def test_binaries_raise_a_repository(spark):
    rows = [("quiet", "info", "file"), ("odd", "info", "file"), ("bad", "info", "file"), ("medium", "medium", "crypto:x")]
    found = spark.createDataFrame(rows, "repo string, severity string, category string")
    binaries = spark.createDataFrame([("odd", "suspicious"), ("bad", "malicious"), ("bad", "clean"), ("only", "suspicious"), ("quiet", "inconclusive")], "repo string, state string")
    got = {r["repo"]: (r["state"], r["reasons"]) for r in verdict.repository_verdicts(found, "repo", binaries=binaries).collect()}
    assert got == {
        "quiet": ("inconclusive", ["only weak findings"]), "odd": ("suspicious", ["1 suspicious binaries"]), "bad": ("malicious", ["1 malicious binaries"]),
        "medium": ("suspicious", ["1 findings of medium severity"]), "only": ("suspicious", ["1 suspicious binaries"]),
    }
    every = spark.createDataFrame([("none",), ("bad",)], "repo string")
    got = {r["repo"]: r["state"] for r in verdict.repository_verdicts(found, "repo", every, binaries).collect()}
    assert got == {"none": "clean", "bad": "malicious"}


def test_rounds_leave_little_on_disk(spark):
    """Reached pairs are kept in columns, a few bytes each, and what a round has shuffled goes with it."""
    local = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir")
    held = lambda pattern: {f: f.stat().st_size for d in local.split(",") for f in Path(d).rglob(pattern) if f.is_file()}
    kept = lambda: {f: f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir")).rglob("part-*")}
    roots = spark.range(300).selectExpr("concat('root', id) AS root")
    edges = spark.range(300).selectExpr("concat('root', id) AS parent", "explode(sequence(0, 199)) AS n").selectExpr("parent", "concat('member', n) AS child")
    before, stored = held("shuffle_*.data"), kept()
    assert lineage.reached(roots, edges, depth=4).count() == 300 * 201
    assert sum(n for f, n in kept().items() if f not in stored) < 20 * 300 * 201
    for _ in range(50):
        left = sum(n for f, n in held("shuffle_*.data").items() if f not in before)
        if left < 100_000:
            break
        time.sleep(0.2)
    assert left < 100_000
