"""The registered queries whose rows no SQL checks, end to end: a small table with edge rows added."""

import hashlib
import re
import shutil
import zlib

import pytest

from assayer.llm.queries import queries

MORE = [
    (900_001, None), (900_002, ""), (900_003, " \t\n"), (900_004, "\u00bd \u00b2\u00b3 \u2167 12"), (900_005, "secret: abcdef12345 and AKIA" + "Q" * 16 + " 0123456789abcdef01234567"),
    (900_006, "mail a.b@example.org, 10.1.2.3, 4111 1111 1111 1111, +49 (30) 123-4567"), (900_007, "\U0001f600 token=zz9zz9zz \U0001f600 x@y.zz 999.1.1.1"), (900_008, "passwd = 'short' api_key=\"abc.def.ghi\""),
]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    to = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(i, t, None, "edge", None) for i, t in MORE], docs.schema)
    docs.unionByName(more).write.parquet(f"{to}/documents.parquet")
    shutil.copy(f"{sf}/labels.parquet", f"{to}/labels.parquet")
    return str(to)


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


SECRETS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def luhn(m):
    digits = [int(c) for c in m[0] if c.isdigit()]
    return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


PERSONAL = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True), "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), luhn), "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15),
}


@pytest.mark.parametrize("name,kinds", [("op8_secret_scan", SECRETS), ("op10_pii", PERSONAL)])
def test_spans(spark, folder, texts, name, kinds):
    rows = {r["doc_id"]: r.asDict() for r in queries()[name](spark, folder).collect()}
    assert set(rows) == set(texts)
    places, some = list(kinds), dict.fromkeys(kinds, 0)
    for i, text in texts.items():
        base = [(m.start(), k, m.end()) for k, (pattern, valid) in kinds.items() for m in pattern.finditer(text) if valid(m)]
        base.sort(key=lambda s: (s[0], places.index(s[1])))
        for k in kinds:
            assert rows[i][f"n_{k}"] == sum(s[1] == k for s in base), (i, k)
            some[k] += rows[i][f"n_{k}"]
        assert rows[i]["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        every = rows[i]["spans"].split(",") if rows[i]["spans"] else []
        assert set(joined(base).split(",")) - {""} <= set(every)
        starts = [int(s.split(":")[1]) for s in every]
        assert starts == sorted(starts) and all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(text) for s in every)
    assert all(some.values())


def test_toxicity(spark, folder, texts):
    rows = {r["doc_id"]: r for r in queries()["op1_toxicity"](spark, folder).collect()}
    assert set(rows) == set(texts)
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in rows.items())
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 1").collect()}
    seen = [i for i in toxic if i in rows and not held_out(i)]
    assert sum(rows[i]["predicted"] for i in seen) >= 0.7 * len(seen) > 0


def test_language(spark, folder, texts):
    rows = {r["doc_id"]: r for r in queries()["op5_language_id"](spark, folder).collect()}
    assert set(rows) == set(texts)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 for i, r in rows.items())
    for i, text in texts.items():
        assert (rows[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text)), i
    known = [i for i in texts if langs[i] and held_out(i) and rows[i]["lang_pred"] != "und"]
    assert sum(rows[i]["lang_pred"] == langs[i] for i in known) >= 0.9 * len(known) > 0
