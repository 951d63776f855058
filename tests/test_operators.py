import gzip
import io
import itertools
import json
import tarfile
import zipfile

from assayer.functions import binary
from assayer.operators import anomaly, graph, metrics, rank, responses, rules, similarity, verdict
from assayer.sources import archive, files, reports, sinks
from assayer.streaming import inbox
from pyspark.sql import functions as F


def state(high, medium, vectors, gap, distance, trusted, matched, baseline):
    """The ladder, rule by rule, as prose states it."""
    s = "malicious" if high or (medium >= 3 and vectors >= 3) else "suspicious" if medium or distance >= 0.2 else "inconclusive"
    if not high and not medium and trusted and matched and not gap:
        s = "clean"
    if s == "suspicious" and trusted and matched and not gap:
        s = "clean"
    if not trusted and not baseline and not high and not medium:
        s = "inconclusive"
    return s


def test_submission_ladder(spark):
    rows, roots, want = [], [], {}
    for i, (high, medium, gap, trusted, near) in enumerate(itertools.product((0, 1), (0, 1, 3), (0, 1), (False, True), (None, 0.1, 0.5))):
        key = str(i)
        rows += [(key, "high", "a:x")] * high + [(key, "medium", f"{'abc'[k]}:x") for k in range(medium)] + [(key, "info", "coverage_gap")] * gap
        roots.append((key, trusted, None if near is None else "b", near == 0.1, 1.0 if near is None else near, False))
        want[key] = state(high, medium, medium, gap, roots[-1][4], trusted, near == 0.1, near is not None)
    got = verdict.submission_verdicts(
        spark.createDataFrame(rows, "submission string, severity string, category string"),
        spark.createDataFrame(roots, "submission string, trusted boolean, baseline_id string, matched boolean, distance double, dynamic_gap boolean"),
    )
    assert {r.submission: r.state for r in got.collect()} == want


def test_compound_ignores_analytic_prefixes(spark):
    rows = [("a", "medium", c) for c in ("llm:x", "ast:y", "unresolved:z", "coverage_gap")] + [("b", "medium", c) for c in ("p:x", "q:x", "r:x")]
    got = verdict.repository_verdicts(spark.createDataFrame(rows, "repo string, severity string, category string"), "repo")
    assert {r.repo: r.state for r in got.collect()} == {"a": "suspicious", "b": "malicious"}


def test_nearest_baseline(spark):
    pairs = [
        ("x", ["1", "2"], ["f"], "far", 1, ["9"], ["g"]),
        ("x", ["1", "2"], ["f"], "late", 3, ["1", "2"], ["f"]),
        ("x", ["1", "2"], ["f"], "near", 2, ["1", "2"], ["f"]),
        ("e", [], [], "empty", 1, [], []),
    ]
    schema = "artifact string, chunks array<string>, functions array<string>, baseline string, ordinal int, baseline_chunks array<string>, baseline_functions array<string>"
    got = {r.artifact: r for r in similarity.compare(spark.createDataFrame(pairs, schema)).collect()}
    assert (got["x"].baseline, got["x"].distance, got["x"].matched) == ("near", 0.0, True) and got["e"].distance == 0.0
    a = spark.createDataFrame([("x", "p", ""), ("y", "", "s"), ("z", None, None)], "artifact string, product string, signer string")
    b = spark.createDataFrame([("b", "p", "s"), ("c", "", "")], "baseline string, product string, signer string")
    assert sorted(map(tuple, similarity.candidates(a, b).collect())) == [("x", "b"), ("y", "b")]


def test_graph(spark):
    code = [
        ("pkg/a.py", "from . import helper\nimport pkg.data\nopen('cfg.json')\n"),
        ("pkg/helper.py", ""),
        ("pkg/data.py", ""),
        ("web/i.js", "const x = require('../lib/u')"),
        ("lib/u.js", ""),
        ("cfg.json", ""),
    ]
    f = spark.createDataFrame(code, "path string, content string")
    refs = graph.references(f)
    got = {(r.path, r.resolved) for r in graph.resolve(refs, f).collect()}
    assert got == {("pkg/a.py", "pkg/helper.py"), ("pkg/a.py", "pkg/data.py"), ("pkg/a.py", "cfg.json"), ("web/i.js", "lib/u.js")}
    edges = spark.createDataFrame([("l", "d"), ("m", "l"), ("m", "k"), ("n", "m")], "src string, dst string")
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    leads = graph.leads(edges, one("d"), one("l", "m", "n"))
    assert {(r.exec_file, r.depth, r.severity) for r in leads.collect()} == {("l", 1, "high"), ("m", 2, "medium")}
    assert [(r.data_file, r.exec_file, r.importers) for r in graph.sibling_leads(edges, one("l"), one("k")).collect()] == [("l", "k", ["m"])]
    hooks = spark.createDataFrame([("postinstall", "x.js")], "hook string, target string")
    assert graph.hook_targets(hooks, one("b/x.js", "a/x.js", "a/yx.js")).first().path == "a/x.js"


def test_anomaly(spark):
    tags = [("d", f"f{i}", "common") for i in range(5)] + [("d", "f0", "odd"), ("small", "a", "x"), ("small", "b", "y"), ("d", "none", None)]
    got = anomaly.directory_anomalies(spark.createDataFrame(tags, "directory string, path string, capability string")).collect()
    assert [(r.path, r.score, r.peers, r.severity) for r in got] == [("f0", 0.5, 6, "medium")]


def test_rules(spark):
    wide = "powershell".encode("utf-16le").decode("latin1")
    rows = spark.createDataFrame([(1, "PowerShell and CMD.EXE"), (2, wide + " /bin/sh"), (3, "ptrace"), (4, "http://a.example.com WSAStartup")], "id int, text string")
    assert {(r.id, r.rule) for r in rules.matches(rows).collect()} == {(1, "ShellExecution"), (2, "ShellExecution"), (4, "SuspiciousNetwork")}
    assert [(r.id, r.capability) for r in rules.capabilities(rows).collect()] == [(3, "anti_analysis")]
    at = rules.needle_offsets(spark.createDataFrame([(1, "xCURLcurl WinExec winexec")], "id int, text string")).orderBy("at").collect()
    assert [(r.needle, r["at"]) for r in at] == [("curl", 1), ("curl", 5), ("WinExec", 10)]


def test_binary(spark):
    blob = bytes(range(256)) * 8
    rows = spark.createDataFrame([("a.exe", bytearray(b"MZ\x00\x01hello world\x00ok")), ("b", bytearray(b"")), ("c", bytearray(b"UPX!" + blob)), ("d.exe", bytearray(b"PK\x03\x04"))], "path string, content binary")
    got = {r.path: r for r in binary.artifacts(rows).collect()}
    assert got["a.exe"].format == "pe" and got["a.exe"].strings == ["hello world"] and got["b"].chunk_hashes == [] and got["b"].entropy == 0.0
    assert got["d.exe"].format == "unknown" and abs(got["c"].entropy - 8) < 0.01
    p = rows.select("path", binary.packer(F.col("content")).alias("p"), binary.heuristic_score(binary.score_components("content"), F.col("content")).alias("s")).collect()
    assert {r.path: r.p for r in p}["c"] == "upx" and {r.path: r.s for r in p}["b"] == 0.0 and {r.path: r.s for r in p}["c"] > 0.7


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("../x/a.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    inner = _zip({"deep.txt": b"deep"})
    rows = [("o.zip", _zip({"i.zip": inner, "dir/": b""})), ("t.tar", tar.getvalue()), ("g.gz", gzip.compress(b"text")), ("n.txt", b"no"), ("b.zip", b"PK\3\4broken")]
    df = spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")
    got = {r.path: bytes(r.content) for r in archive.unpacked(df).filter("depth > 0").collect()}
    assert got == {"o.zip!i.zip": inner, "o.zip!i.zip!deep.txt": b"deep", "t.tar!x/a.txt": b"abc", "g.gz!g": b"text"}
    assert list(archive.members("z.zip", _zip({"a": b"x" * 60, "b": b"y" * 60}), 100)) == [("a", b"x" * 60)]
    full, bomb, broken = _zip({"a": b"x" * 60, "b": b"y" * 60}), _zip({"a": b"x", "b": b"y" * 200}), _zip({"a": b"x" * 500})[:-30]
    frame = spark.createDataFrame([("full.zip", full), ("bomb.zip", bomb), ("broken.zip", broken), ("whole.zip", _zip({"a": b"x" * 60})), ("plain.txt", b"abc"), ("outer.zip", _zip({"in.zip": bomb}))], "path string, content binary")
    found = archive.scanned(frame, depth=2, cap=190)
    gaps = {r.path: r.message for r in archive.coverage_gaps(archive.scanned(frame.filter("path <> 'outer.zip'"), depth=2, cap=100)).collect()}
    assert gaps == {"full.zip": "left after 1 members of 60 bytes: over 100 bytes", "bomb.zip": "left after 1 members of 1 bytes: member of 200 bytes", "broken.zip": "left after 0 members of 0 bytes: broken archive"}
    inner = [(r.path, r.n_members) for r in archive.scanned(frame.filter("path = 'outer.zip'"), depth=2, cap=1000).filter("gap IS NOT NULL").collect()]
    assert inner == [] and found.filter("gap IS NULL AND path LIKE 'bomb.zip!%'").count() == 1


def test_walk_and_text(spark, tmp_path):
    for name, data in {"a.py": b"x", "node_modules/b.py": b"y", "empty": b"", "c/d.bin": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    w = files.walk(spark, str(tmp_path))
    assert [(r.path, r["class"]) for r in w.collect()] == [("a.py", "source"), ("c/d.bin", "binary")]
    t = w.select("path", files.text(F.col("content"), F.lit(False)).alias("t")).collect()
    assert [r.t for r in t] == ["x", None]


def test_reports(spark):
    capa = {"rules": {"inject": {"meta": {"namespace": "ns", "att&ck": ["T1"]}}, "plain": {"meta": {}}}}
    a = {"network": {"domains": [{"domain": "d.example"}]}, "signatures": [{"name": "s", "description": "t", "severity": 3}]}
    c = {"analysis": {"score": 8}, "targets": [{"iocs": {"domains": ["e"], "ips": ["1"]}}], "dropped": [{"filename": "f", "kind": "k", "sha256": "h"}]}
    df = lambda x: spark.createDataFrame([("x", json.dumps(x)), ("y", "{}"), ("z", "not json")], "artifact string, report string")
    assert {(r.category, r.severity) for r in reports.capabilities(df(capa)).collect()} == {("capability:ns", "high"), ("capability:plain", "medium")}
    assert {(r.category, r.severity) for r in reports.sandbox_a(df(a)).collect()} == {("network:dns", "medium"), ("signature:s", "high")}
    assert {r.category for r in reports.sandbox_c(df(c)).collect()} == {"sandbox:score", "network:dns", "network:ip", "dropped:file"}
    assert reports.sandbox_b(df({"injections": [{"type": "t"}]})).first().category == "injection"
    assert reports.functions(df({"functions": [{"name": "f", "entry": "0x1", "size": 3}]})).first().symbol == "f"
    real = spark.createDataFrame([("x", "capa", 1)], "artifact string, tool string, v int")
    guess = spark.createDataFrame([("x", "capa", 2), ("y", "capa", 3)], "artifact string, tool string, v int")
    assert sorted(r.v for r in reports.with_fallback(real, guess).collect()) == [1, 3]


def test_responses(spark):
    answer = lambda j: f"Words\n```json\n{j}\n```"
    rows = [
        ("x", answer('{"verdict": "malicious", "confidence": 0.9, "summary": "s", "findings": [{"severity": "high", "category": "c", "message": "m"}, {"severity": "odd"}]}'), 0.1),
        ("y", "no json", 0.1),
        ("z", answer('{"verdict": "clean", "confidence": 0.5}'), 0.1),
        ("b", answer('{"verdict": "benign"}'), 0.9),
        ("l", answer('{"verdict": "malicious"}'), 0.1),
        ("broken", answer("{nope"), 0.1),
    ]
    a = spark.createDataFrame(rows, "key string, text string, triage_score double")
    got = {(r.key, r.category, r.severity, r.advisory) for r in responses.findings(a).collect()}
    assert got == {("x", "llm:malicious_confirmed", "high", False), ("x", "c", "high", False), ("x", "llm:finding", "medium", False), ("b", "llm:benign_confirmed", "info", True)}
    got = {(r.key, r.category, r.severity) for r in responses.function_findings(a).collect()}
    assert got == {("x", "llm:function_malicious", "high"), ("x", "llm:c", "high"), ("b", "llm:function_suspicious", "medium"), ("l", "llm:function_suspicious", "medium")}
    v = spark.createDataFrame([("x", "clean"), ("y", "suspicious"), ("z", "malicious")], "key string, state string")
    assert {r.key: r.state for r in responses.overridden(v, a).collect()} == {"x": "malicious", "y": "suspicious", "z": "clean"}
    used = spark.createDataFrame([("k", i, 40, 10) for i in range(4)], "key string, ordinal int, in_tokens int, out_tokens int")
    assert responses.within_budget(used, "key", budget=100).count() == 2
    assert responses.prompts(spark.createDataFrame([("p", "c", ["f"])], "path string, content string, findings array<string>")).first().prompt == "File: p\nf\nc"


def test_ranks_and_metrics(spark):
    c = spark.createDataFrame([("r", "a", 50, 1), ("r", "a", 105, 4), ("r", "b", 80, 2), ("r", "c", 80, 3)], "repo string, path string, priority int, ordinal int")
    t = verdict.targets(c, "repo")
    assert [(r.path, r.priority, r.rank) for r in t.orderBy("rank").collect()] == [("a", 105, 1), ("b", 80, 2), ("c", 80, 3)]
    n = spark.createDataFrame([("r", 3)], "repo string, n_files int")
    assert verdict.capped_targets(t, n, "repo", most=1).count() == 1
    fns = spark.createDataFrame([("x", 0.5, 2), ("x", 0.5, 1), ("x", 0.9, 3)], "artifact string, triage_score double, ordinal int")
    assert [r.ordinal for r in rank.top_functions(fns, "artifact", limit=2).orderBy("rank").collect()] == [3, 1]
    m = metrics.confusion(spark.createDataFrame([(True, True), (False, True), (True, None)], "label boolean, verdict boolean")).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.precision, m.recall, m.f1) == (1, 1, 0, 0, 0.5, 1.0, 0.6667)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("aa1", "x"), ("aa1", "x"), ("bb2", "y")], "sha256 string, content string")
    sinks.put_content(rows, f"{tmp_path}/store")
    sinks.put_content(rows, f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store").count() == 2
    old = spark.createDataFrame([("a", 1, "old")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 2, "new"), ("b", 1, "b")], "k string, v int, x string")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"], "v").collect())) == [("a", 2, "new"), ("b", 1, "b")]


def test_stream(spark, tmp_path):
    inn = tmp_path / "in"
    inn.mkdir()
    (inn / "a.py").write_text("exec(x)")
    (inn / "copy.py").write_text("exec(x)")
    (inn / "b.py").write_text("eval(y)")
    q = inbox.analyse(inbox.arrivals(spark, str(inn)), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_rule_texts_and_cases(spark):
    rule = 'rule Good {\n  strings:\n    $a = "x"\n  condition:\n    $a\n}'
    a = spark.createDataFrame([("x", f"text\n```\n{rule}\n```"), ("y", "rule Bad {\n condition: true\n}")], "key string, text string")
    assert [(r.key, r.rule) for r in responses.rule_texts(a).collect()] == [("x", "Good")]
    c = spark.createDataFrame([("a", "malicious", "suspicious"), ("b", "clean", "clean"), ("c", "clean", "malicious"), ("d", "malicious", None)], "case string, expected string, verdict string")
    r = metrics.case_rates(metrics.case_results(c))
    assert tuple(r.first()) == (4, 1, 0, 2, 1, 1, 0.0, 0.5) and metrics.markdown(r).first().value == "| 4 | 1 | 0 | 2 | 1 | 1 | 0.0 | 0.5 |"
    f = spark.createDataFrame([("k", "g", f"m{i:02}", i) for i in range(12)], "key string, grp string, m string, o int")
    g = rank.grouped(f, "key", "grp", "m", "o").first()
    assert len(g.messages) == 10 and g.messages[0] == "m00" and g.overflow == 2


def test_disassembler_coverage(spark):
    from hashlib import sha256

    fns = [{"name": f"f{i}", "entry": f"0x{i}", "end": f"0x{i}f", "size": 3, **({"decompiled": "int x;"} if i != 1 else {})} for i in range(60)]
    rows = [("whole", json.dumps({"functions": fns[2:4]})), ("part", json.dumps({"functions": fns}))]
    found = reports.functions(spark.createDataFrame(rows, "artifact string, report string"))
    top = rank.top_functions(found.filter("artifact = 'part'"), "artifact", limit=50).orderBy("rank").collect()
    assert [r.ordinal for r in top] == list(range(50)) and [round(top[i].triage_score, 9) for i in (0, 1, 45)] == [0.9, 0.88, 0.1]
    assert (top[0].end, top[0].normalized_hash, top[1].normalized_hash) == ("0x0f", sha256(b"int x;").hexdigest(), sha256(b"f1:0x1").hexdigest())
    gaps = {(r.artifact, r.source, r.category, r.severity, r.message) for r in reports.coverage_gaps(found, limit=50).collect()}
    assert gaps == {
        ("part", "ghidra", "coverage_gap", "info", "Ghidra found 60 functions but only 50 were analyzed (limit=50)."),
        ("part", "ghidra", "coverage_gap", "info", "1 of 50 functions could not be decompiled."),
    }


def test_malformed_text(spark):
    rows = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe x"), True), (2, bytearray(b"ok \xff"), False), (3, "fü".encode(), False), (4, None, True)], "id int, content binary, known boolean")
    got = {r.id: r.t for r in rows.select("id", files.text(F.col("content"), F.col("known")).alias("t")).collect()}
    assert got == {1: b"ok \xff\xfe x".decode("utf-8", "replace"), 2: None, 3: "fü", 4: None}


def test_malformed_text_in_the_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_bytes(b"exec(x) \xff\xfe")
    inbox.analyse(inbox.arrivals(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [r.category for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["obfuscation:eval_exec"]


def test_marks_at_any_place(spark):
    """A mark that begins in the middle of a byte's digits first, then at a byte."""
    data = [bytearray(b"\x15\x55\x05\x82\x10" + b"UPX!"), bytearray(b"x" * 9000 + b"UPX!"), bytearray(b".vmp1")]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "id int, content binary").select("id", binary.packer(F.col("content")).alias("p")).orderBy("id").collect()
    assert [r.p for r in got] == ["upx", None, "vmprotect"]


def test_upsert_without_version(spark):
    schema = "k int, v int, x string"
    stored, changes = spark.createDataFrame([(1, None, "a"), (2, 5, "old"), (3, 7, "same")], schema), spark.createDataFrame([(2, None, "b"), (3, 7, "new"), (4, None, None)], schema)
    got = sorted(map(tuple, sinks.upserted(stored, changes, ["k"], "v").collect()))
    assert got == [(1, None, "a"), (2, 5, "old"), (3, 7, "new"), (4, None, None)]


def test_needle_offsets_keep_places(spark):
    texts = ["İİ cmd.exe", "Curl curl" + "x" * 50 + "CURL", "ſocket socket", "a" * 10 + "WinExecWinExec"] + ["socket " * 3000]
    found = rules.needle_offsets(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.id, r.at)):
        got.setdefault(r.id, []).append((r.needle, r.at))
    assert got[0] == [("cmd.exe", 3)] and got[1] == [("curl", 0), ("curl", 5), ("curl", 59)] and got[2] == [("socket", 7)] and got[3] == [("WinExec", 10), ("WinExec", 17)]
    assert [at for _, at in got[4]] == list(range(0, 21000, 7))
