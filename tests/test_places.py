"""Where findings are, against Python's own search."""

import re
import time

import pytest
from pyspark.sql import functions as F

from assayer.functions import places
from assayer.operators import detectors, repository
from assayer.operators import patterns as P

TEXTS = ["", "ab", "xab\nab ab", "\n\nab", "a\nb ab\n", "é😀ab\r\n ab", "ab" * 50, ("line of ab\n" * 300), "a\n" * 3 + "xa\nbx"]


def plain(text, pattern, most=None):
    out = []
    for m in list(re.finditer(pattern, text))[:most]:
        line = text[: m.start()].rfind("\n") + 1
        out.append((m.start(), text[: m.start()].count("\n") + 1, m.start() - line + 1, m[0]))
    return out


@pytest.mark.parametrize("pattern", ["ab", "a\\n?b", "a[^b]*b", "(?<=x)ab"])
@pytest.mark.parametrize("most", [None, 2])
def test_places_equal_a_plain_search(spark, pattern, most):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").select("i", "text", places.places(F.col("text"), pattern, most).alias("p")).collect()
    for r in rows:
        assert [(p["start"], p["line"], p["column"], p["hit"]) for p in r["p"]] == plain(r["text"], pattern, most)
        for p in r["p"]:
            assert len(p["excerpt"]) <= places.BEFORE + places.SHOWN + places.AFTER and "\n" not in p["excerpt"] and p["hit"].split("\n")[0] in p["excerpt"]
    assert spark.range(1).select(places.places(F.lit(None).cast("string"), "a").alias("p")).first()["p"] is None


FILES = [
    ("a.py", "import os\nx = 1\n  eval(a); exec(b)\n"),
    ("lib/run.js", "const c = require('child_process')\nfetch(u)\n"),
    ("u.py", 'a = "http://8.8.8.8/x"\nb = "http://8.8.8.8/x"\nc = "http://169.254.169.254/y"\n'),
    ("s.c", 'connect(("8.8.4.4", 53))'),
    ("k.py", "\n\npassword = 'abcdefghijabcdefghij1'\n"),
    ("q.py", 'n = "' + "a\n" * 300 + '" s = "' + "ab " * 200 + '"'),
    ("e.py", ""),
    ("n.py", None),
]


@pytest.fixture(scope="module")
def told(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    return {(r["path"], r["category"], r["ordinal"]): r for r in detectors.observations(files, evidence=True).collect()}


def test_findings_tell_where_and_what(told):
    find = lambda path, category: [r for (p, c, _), r in sorted(told.items()) if (p, c) == (path, category)]
    (calls,) = find("a.py", "obfuscation:eval_exec")
    assert [(p["start"], p["line"], p["column"]) for p in calls["places"]] == [(18, 3, 3), (27, 3, 12)]
    assert calls["message"] == "eval exec in a.py:3 (2 times): eval(, exec(" and calls["values"] == ["eval(", "exec("]
    assert calls["places"][0]["excerpt"] == "  eval(a); "
    (imports,) = find("lib/run.js", "import:suspicious")
    assert imports["values"] == ["child_process"] and (imports["places"][0]["line"], imports["places"][0]["column"]) == (1, 20)
    assert [(r["values"], r["places"][0]["line"]) for r in find("u.py", "import:hardcoded_ip")] == [(["http://8.8.8.8/x"], 1), (["http://8.8.8.8/x"], 2)]
    assert [r["places"][0]["line"] for r in find("u.py", "import:cloud_metadata")] == [3]
    assert find("s.c", "import:hardcoded_ip")[0]["values"] == ["8.8.4.4", "53"]
    (key,) = find("k.py", "secret:api_key")
    assert key["places"][0]["line"] == 3 and "abcdef" not in str(key)
    (long,) = find("q.py", "payload:long_string")
    assert len(long["places"]) == 1 and long["places"][0]["line"] == 301 and len(long["values"][0]) == detectors.VALUE


def test_evidence_changes_no_finding(spark, told):
    files = spark.createDataFrame(FILES, "path string, content string")
    short = {(r["path"], r["category"], r["ordinal"]): tuple(r) for r in detectors.observations(files).collect()}
    assert short == {k: tuple(r)[:6] for k, r in told.items()}


def test_a_long_line_and_many_matches_stay_linear(spark):
    took = []
    for n in (20_000, 80_000):
        files = spark.createDataFrame([("m.py", 'u("http://8.8.8.8/x");' * n + "eval(a)")], "path string, content string").cache()
        files.count()
        found = files.select(places.places(F.col("content"), P.HARDCODED_IP).alias("p"))
        began = time.time()
        assert found.select(F.size("p"), F.get("p", F.lit(n - 1))["start"]).first() == (n, 22 * (n - 1) + 2)
        took.append(time.time() - began)
    assert took[1] < 16 * took[0] + 5


def test_hooks_see_what_scripts_run(spark):
    files = spark.createDataFrame([("package.json", '{"scripts": {"postinstall": "node run.js"}}'), ("run.js", "x = 1")], "path string, content string")
    found = spark.createDataFrame([("run.js", "behavioral:git_exfiltration", ["execSync('git"])], "path string, category string, values array<string>")
    assert [tuple(r)[:3] for r in repository.hook_droppers(files, found).collect()] == [("package.json", "postinstall", "run.js")]
    assert repository.hook_droppers(files, found.drop("values")).collect() == []
