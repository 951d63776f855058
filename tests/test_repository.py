import hashlib
import json

from assayer.operators import access, artifacts, repository
from pyspark.sql import functions as F


def test_artifact_findings(spark):
    rows = [("a.exe", bytearray(b"MZ\0\0CreateRemoteThread\0WriteProcessMemory\0https://x.example/\0")), ("b", bytearray(b"")), ("c", bytearray(bytes(range(256)) * 8 + b"UPX!")), ("d", bytearray(b"MEI\014\013\012\013\016"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {(r.path, r.category, r.severity) for r in artifacts.observations(df).collect()}
    assert {("a.exe", "file", "info"), ("a.exe", "rule:ProcessInjection", "high"), ("a.exe", "capability:process_injection", "high"), ("c", "entropy", "medium"), ("d", "packer:pyinstaller", "medium")} <= got
    assert not any(p == "b" for p, _, _ in got) and ("c", "ml:classification", "medium") in {(p, c, "medium") for p, c, s in got if c.startswith("ml")}
    f = artifacts.heuristic_functions(df).filter("path = 'a.exe'").orderBy("ordinal").collect()
    assert [(r.needle, r["at"], r.start) for r in f] == [("CreateRemoteThread", 4, "0x0"), ("WriteProcessMemory", 23, "0x0"), ("https://", 42, "0x0")] and f[1].triage_score == 0.85
    base = {r.path: r for r in artifacts.baseline_rows(df, "p").collect()}
    assert base["a.exe"].artifact == hashlib.sha256(bytes(rows[0][1])).hexdigest() and base["b"].function_hashes == []
    assert artifacts.unavailable(spark.createDataFrame([("x",)], "artifact string"), {"cape": True, "angr": False}).count() == 2
    p = spark.createDataFrame([(None, "subject", None), (None, None, "")], "authenticode boolean, sigstore string, in_toto string")
    assert [r.trusted for r in artifacts.trusted(p).collect()] == [True, False]


def test_roles_and_projects(spark):
    names = ["setup.py", "pkg/__init__.py", "package.json", ".github/workflows/x.yml", "plain.txt"]
    df = spark.createDataFrame([(n,) for n in names], "path string").select("path", repository.roles(F.col("path")).alias("r"))
    assert [r.r for r in df.collect()] == [["entry_point"], ["entry_point"], ["manifest"], ["build_file"], []]
    files = spark.createDataFrame([("a", "x/setup.py"), ("b", "package.json"), ("c", "z")], "repo string, path string")
    assert {r.repo: r.project for r in repository.project_types(files, "repo").collect()} == {"a": "Python package", "b": "npm package", "c": "software project"}


def test_hook_droppers(spark):
    manifest = json.dumps({"scripts": {"preinstall": "node scripts/get.js", "postinstall": "node ok.js"}})
    files = [("package.json", manifest), ("scripts/get.js", "require('child_process'); https.get('x')"), ("ok.js", "print()")]
    found = spark.createDataFrame([("other.js", "import:suspicious")], "path string, category string")
    got = repository.hook_droppers(spark.createDataFrame(files, "path string, content string"), found).collect()
    assert [tuple(r) for r in got] == [("package.json", "preinstall", "scripts/get.js", "high")]
    leads = spark.createDataFrame([("d", "e", 1, "high")], "data_file string, exec_file string, depth int, severity string")
    assert repository.lead_findings(leads).first().path == "e"


def test_access(spark):
    h = hashlib.sha256(b"k").hexdigest()
    keys = spark.createDataFrame([(h, ["read"], None), (h, ["x"], "2024")], "key_hash string, scopes array<string>, revoked_at string")
    found = access.verified(keys, spark.createDataFrame([("k",), ("z",)], "raw string"))
    assert [r.ok for r in found.select(access.allowed(F.col("scopes"), "read").alias("ok")).collect()] == [True]
    url = spark.createDataFrame([("redis://u:secret@h:1/0",)], "u string").select(access.redacted_url(F.col("u")).alias("u")).first().u
    assert url == "redis://u:***@h:1/0"
    assert access.healthy(spark.createDataFrame([("a", True), ("b", False)], "name string, ok boolean")).first().ok is False


def test_tables(spark, tmp_path):
    from assayer.sources import tables

    spark.sql("CREATE DATABASE IF NOT EXISTS layouts")
    tables.create(spark, "layouts")
    assert spark.table("layouts.verdicts").columns[:2] == ["sha256", "state"]
    tables.drop(spark, "layouts")
    layout = "state string, reasons array<string>, score double"
    rows = spark.createDataFrame([("a", "clean", ["r"], 0.5), ("b", "malicious", [], None)], "id string, state string, reasons array<string>, score double")
    tables.write_state(rows, "id", "verdicts", f"{tmp_path}/state")
    back = tables.read_state(spark, f"{tmp_path}/state", "verdicts", layout)
    assert sorted((r.record_id, r.state, r.reasons, r.score) for r in back.collect()) == [("a", "clean", ["r"], 0.5), ("b", "malicious", [], None)]
    assert tables.lookup(back, "record_id", "b").first().state == "malicious"
    t = spark.createDataFrame([("4d5a",), ("zz",), ("",)], "t string").select(tables.payload(F.col("t")).alias("p")).collect()
    assert [None if r.p is None else bytes(r.p) for r in t] == [b"MZ", None, b""]
    tables.write_rules(spark.createDataFrame([("s", "rule A {}")], "sha256 string, text string"), f"{tmp_path}/rules")
    assert spark.read.text(f"{tmp_path}/rules").first().value == "rule A {}"
