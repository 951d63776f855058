"""Registered queries over evidence made of the given tables: reports, archives, bytes, manifests, answers, keys, code; and their SQL.

What a query reads is built of whole tables first (JSON of orders and events, bytes and archives of documents, code of parts). The SQL never
sees what was built: it states from the tables what must be found.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import binary, paths
from assayer.operators import access, anomaly, artifacts, dependencies, detectors, graph, lineage, metrics, pyast, rank, repository, responses, rulefile, similarity, verdict
from assayer.operators import patterns as P
from assayer.plans.catalog import FINDINGS_SQL, findings, query, sample_files, spread, table
from assayer.sources import archive, files, reports, tables
from assayer.sources.shared import checkpointed


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# ------------------------------------------------------------------ reports


def _orders(spark, sf_dir, **fields) -> DataFrame:
    """artifact (an order) and report (JSON), each field an array over the order's lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag"))).alias("lines"))
    cells = [F.transform("lines", f).alias(k) for k, f in fields.items()]
    return lines.select(F.col("l_orderkey").alias("artifact"), F.to_json(F.struct(*cells)).alias("report"))


_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag) - 1 AS ordinal FROM lineitem)"


@query("SELECT p_brand AS artifact, 'capability:' || CASE WHEN p_size = 1 THEN 'rule ' || p_partkey ELSE p_type END AS category, CASE WHEN p_size > 25 THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM part GROUP BY ALL")
def capability_reports(spark, sf_dir):
    """Each part is a rule of its brand's report; large ones name an attack technique, those of size 1 no namespace."""
    attack = F.when(F.col("p_size") > 40, F.array(F.lit("T1"))).otherwise(F.array().cast("array<string>"))
    meta = F.struct(F.when(F.col("p_size") > 1, F.col("p_type")).otherwise("").alias("namespace"), attack.alias("att&ck"), F.when(F.col("p_size").between(26, 40), F.array(F.lit("T2"))).alias("attack"))
    rule = F.struct(F.concat(F.lit("rule "), _text("p_partkey")), F.struct(meta.alias("meta")))
    made = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(rule)).alias("rules"))).alias("report"))
    return reports.capabilities(made.withColumnRenamed("p_brand", "artifact")).groupBy("artifact", "category", "severity").agg(F.count("*").alias("n"))


def _disassembled(spark, sf_dir):
    code = lambda x: F.when(x["l_discount"] > 0, F.concat(F.lit("return "), x["l_partkey"].cast("string")))
    place = lambda x: F.lower(F.hex(x["l_partkey"] * 16))
    one = lambda x: F.struct(F.concat(F.lit("f"), x["l_linenumber"].cast("string")).alias("name"), place(x).alias("entry"), F.lower(F.hex(x["l_partkey"] * 16 + x["l_quantity"].cast("long"))).alias("end"), x["l_quantity"].cast("long").alias("size"), code(x).alias("decompiled"))
    return reports.functions(_orders(spark, sf_dir, functions=one))


@query(
    f"""WITH {_LINES} SELECT l_orderkey AS artifact, ordinal, 'f' || l_linenumber AS symbol, lower(to_hex(l_partkey * 16)) AS start, lower(to_hex(l_partkey * 16 + CAST(l_quantity AS BIGINT))) AS "end",
        l_discount > 0 AS decompiled, round(greatest(0.1, 0.9 - 0.02 * ordinal), 4)::DOUBLE AS triage_score,
        sha256(CASE WHEN l_discount > 0 THEN 'return ' || l_partkey ELSE 'f' || l_linenumber || ':' || lower(to_hex(l_partkey * 16)) END) AS normalized_hash FROM lines"""
)
def report_functions(spark, sf_dir):
    return _disassembled(spark, sf_dir).drop("size").withColumns({"ordinal": F.col("ordinal").cast("long"), "triage_score": F.round("triage_score", 4)})


@query(f"WITH {_LINES} SELECT l_orderkey AS artifact, 'f' || l_linenumber AS symbol, ordinal + 1 AS rank FROM lines WHERE ordinal < 3")
def top_functions(spark, sf_dir):
    """The three functions with the highest triage score of each report, none under a half."""
    return rank.top_functions(_disassembled(spark, sf_dir), "artifact", limit=3, least=0.5).select("artifact", "symbol", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_LINES}, n AS (SELECT l_orderkey AS artifact, count(*) AS n, count(*) FILTER (ordinal < 4) AS seen, count(*) FILTER (ordinal < 4 AND l_discount = 0) AS bare FROM lines GROUP BY 1)
        SELECT artifact, 'coverage_gap' AS category, 'found ' || n || ' analyzed ' || seen AS what FROM n WHERE n > seen UNION ALL SELECT artifact, 'coverage_gap', 'bare ' || bare || ' of ' || seen FROM n WHERE bare > 0"""
)
def coverage_gaps(spark, sf_dir):
    found = reports.coverage_gaps(_disassembled(spark, sf_dir), limit=4)
    digits = F.regexp_extract_all("message", F.lit(r"\d+"), 0)
    what = F.when(F.col("message").contains("analyzed"), F.concat(F.lit("found "), digits[0], F.lit(" analyzed "), digits[1])).otherwise(F.concat(F.lit("bare "), digits[0], F.lit(" of "), digits[1]))
    return found.select("artifact", "category", what.alias("what"))


def _sandbox(kind: str):
    def build(spark, sf_dir):
        e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", F.col("value").cast("int").alias("v")))).alias("all"))
        of = lambda t, f: F.transform(F.filter("all", lambda x: x["event_type"] == t), f)
        named = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
        host = lambda x: F.concat(F.lit("h"), x["event_id"].cast("string"))
        mark = lambda x: F.concat(F.lit("m"), (x["v"] % 7).cast("string"))
        process = lambda x: named(process_name=F.when(x["v"] % 5 != 0, host(x)), pid=F.when(x["v"] % 3 != 0, x["event_id"]), ppid=F.lit(1))
        if kind == "a":
            cells = F.struct(of("view", lambda x: named(domain=host(x))).alias("domains")).alias("network"), of("error", lambda x: named(name=mark(x), description=F.when(x["v"] % 2 == 0, host(x)), severity=x["v"] % 6)).alias("signatures"), F.struct(of("click", process).alias("processes")).alias("behavior")
        elif kind == "b":
            cells = of("purchase", lambda x: named(type=mark(x))).alias("injections"), of("signup", lambda x: named(technique=host(x))).alias("evasions"), of("click", lambda x: named(name=F.when(x["v"] % 5 != 0, host(x)))).alias("syscalls")
        else:
            tasks = F.map_from_entries(of("click", lambda x: F.struct(host(x), named(name=F.when(x["v"] % 5 != 0, host(x)), pid=F.when(x["v"] % 3 != 0, x["event_id"])))))
            target = named(iocs=named(domains=of("view", host), ips=of("signup", host)), tasks=tasks)
            cells = F.struct((F.size("all") % 11).alias("score")).alias("analysis"), of("error", lambda x: named(name=mark(x), score=x["v"] % 10)).alias("signatures"), F.array(target).alias("targets"), of("purchase", lambda x: named(config=named(family=mark(x)))).alias("extracted"), of("error", lambda x: named(filename=host(x), kind=F.lit("k"), sha256=F.lit("0"))).alias("dropped")
        return e.select(F.col("user_id").alias("artifact"), F.to_json(F.struct(*cells)).alias("report"))

    return build


_E = "e AS (SELECT user_id AS artifact, event_id, event_type, trunc(value)::INT AS v, 'h' || event_id AS host, 'm' || (trunc(value)::INT % 7) AS mark FROM events)"
_RUN = "SELECT artifact, '{source}' AS source, '{kind}' AS kind, '{word}: ' || CASE WHEN v % 5 <> 0 THEN host ELSE 'unknown' END{pid} AS summary FROM {rows} WHERE event_type = 'click'{more}"
_PID = " || ' (PID ' || CASE WHEN v % 3 <> 0 THEN CAST(event_id AS VARCHAR) ELSE '?' END || ')'"


@query(
    f"""WITH {_E} SELECT artifact, 'network:dns' AS category, 'medium' AS severity, host AS message FROM e WHERE event_type = 'view'
        UNION ALL SELECT artifact, 'signature:' || mark, CASE WHEN v % 6 >= 3 THEN 'high' ELSE 'medium' END, CASE WHEN v % 2 = 0 THEN host ELSE mark END FROM e WHERE event_type = 'error'"""
)
def sandbox_a_findings(spark, sf_dir):
    return reports.sandbox_a(_sandbox("a")(spark, sf_dir)).drop("source")


@query(
    f"""WITH {_E} SELECT artifact, 'injection' AS category, 'high' AS severity, mark AS message FROM e WHERE event_type = 'purchase'
        UNION ALL SELECT artifact, 'anti_analysis', 'medium', host FROM e WHERE event_type = 'signup'"""
)
def sandbox_b_findings(spark, sf_dir):
    return reports.sandbox_b(_sandbox("b")(spark, sf_dir)).drop("source")


@query(
    f"""WITH {_E}, s AS (SELECT artifact, count(*) % 11 AS score FROM e GROUP BY 1)
        SELECT artifact, 'sandbox:score' AS category, CASE WHEN score >= 7 THEN 'high' ELSE 'medium' END AS severity, score || '.0' AS message FROM s WHERE score >= 4
        UNION ALL SELECT artifact, 'signature:' || mark, CASE WHEN v % 10 >= 7 THEN 'high' ELSE 'medium' END, mark FROM e WHERE event_type = 'error'
        UNION ALL SELECT artifact, CASE event_type WHEN 'view' THEN 'network:dns' ELSE 'network:ip' END, 'medium', host FROM e WHERE event_type IN ('view', 'signup')
        UNION ALL SELECT artifact, 'extracted:config', 'high', mark FROM e WHERE event_type = 'purchase' UNION ALL SELECT artifact, 'dropped:file', 'medium', host FROM e WHERE event_type = 'error'"""
)
def sandbox_c_findings(spark, sf_dir):
    return reports.sandbox_c(_sandbox("c")(spark, sf_dir)).drop("source")


@query(
    f"""WITH {_E}, first AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY event_id) AS n FROM e WHERE event_type = 'click')
        {_RUN.format(source="cape", kind="process", word="Process", pid=_PID, rows="e", more="")} UNION ALL {_RUN.format(source="drakvuf", kind="syscall", word="Syscall", pid="", rows="first", more=" AND n <= 50")}
        UNION ALL {_RUN.format(source="triage", kind="process", word="Process", pid=_PID, rows="e", more="")}"""
)
def behavior_events(spark, sf_dir):
    """Processes and system calls of all three sandboxes."""
    out = reports.events_a(_sandbox("a")(spark, sf_dir)).unionByName(reports.events_b(_sandbox("b")(spark, sf_dir)))
    return out.unionByName(reports.events_c(_sandbox("c")(spark, sf_dir)))


@query("SELECT user_id AS artifact, tool, CASE WHEN real THEN 'report' ELSE 'heuristic' END AS kind FROM (SELECT user_id, tool, bool_or(event_type = 'error') AS real FROM events, (SELECT unnest(['x', 'y']) AS tool) GROUP BY 1, 2) WHERE NOT (real AND tool = 'y') UNION ALL SELECT DISTINCT user_id, 'y', 'heuristic' FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def fallback_findings(spark, sf_dir):
    """Tool x reports on users with errors; its heuristic stands in elsewhere, and always for tool y."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("artifact"), "event_type")
    real = e.filter("event_type = 'error'").select("artifact", F.lit("x").alias("tool"), F.lit("report").alias("kind")).distinct()
    every = e.select("artifact").distinct().select("artifact", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("tool"), F.lit("heuristic").alias("kind"))
    return reports.with_fallback(real, every)


# ------------------------------------------------------------------ bytes and archives

_RANDOM = "concat({})".format(", ".join(f"unhex(sha2(concat(text, '{i}'), 256))" for i in range(64)))
_RANDOM_SQL = " || ".join(f"sha256(text || '{i}')" for i in range(64))
#: (name, bytes before the text in digits, bytes instead of the text)
_KINDS = (
    ("a.txt", "", None), ("b.exe", "4D5A", None), ("c", "7F454C46", None), ("d", "CFFAEDFE", None), ("e.bin", "504B0304", None), ("f.dll", "504B0304", None), ("g", "61" * 257 + "7573746172", None),
    ("h.tgz", "1F8B", None), ("i.dat", "1F8B", None), ("j.exe", "4D5A90555058211234", "random"), ("k.dat", "", "random"), ("l", "00" * 40 + b".themida".hex().upper(), None), ("m.gz", "", None), ("n.ZIP", "", None), ("o", "5055504558" + b"PEC2".hex().upper(), None),
)
_FORMATS = ("unknown", "pe", "elf", "mach-o", "zip", "unknown", "tar", "tar", "gzip", "pe", "unknown", "unknown", "gzip", "zip", "unknown")
_PACKED = {9: "upx", 11: "themida", 14: "pecompact"}


def _blobs(spark, sf_dir) -> DataFrame:
    """doc_id, path, content: each document as bytes of one of the kinds above, by its id."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kind = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("head"), F.lit(b == "random").alias("random")) for n, h, b in _KINDS])
    d = d.withColumn("k", F.get(kind, (F.col("doc_id") % len(_KINDS)).cast("int")))
    body = F.when(F.col("k.random"), F.expr(_RANDOM)).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", F.concat(_text("doc_id"), F.lit("/"), "k.name").alias("path"), F.concat(F.unhex("k.head"), body).alias("content"))


_BLOBS = (
    "kinds(number, name, head, random, format, packer) AS (VALUES " + ", ".join(f"({i}, '{n}', '{h}', {b == 'random'}, '{_FORMATS[i]}', {repr(_PACKED[i]) if i in _PACKED else 'NULL'})" for i, (n, h, b) in enumerate(_KINDS)) + "),\n"
    f"blobs AS (SELECT doc_id, doc_id || '/' || name AS path, format, packer, number, head || CASE WHEN random THEN upper({_RANDOM_SQL}) ELSE hex(encode(text)) END AS digits FROM documents JOIN kinds ON number = doc_id % {len(_KINDS)})"
)


@query(f"WITH {_BLOBS} SELECT path, sha256(unhex(digits)) AS sha256, length(digits) // 2 AS size, format, packer FROM blobs")
def artifact_formats(spark, sf_dir):
    c = F.col("content")
    return _blobs(spark, sf_dir).select("path", F.sha2(c, 256).alias("sha256"), F.length(c).cast("long").alias("size"), binary.file_format(F.col("path"), c).alias("format"), binary.packer(c).alias("packer"))


_SCORES = f"""{_BLOBS}, bytes AS (SELECT path, packer, length(digits) // 2 AS size, regexp_extract_all(digits, '..') AS b FROM blobs),
  spread AS (SELECT path, i, b[i] AS x FROM bytes, unnest(generate_series(1, size)) AS t(i)),
  whole AS (SELECT path, -sum(p * log2(p)) AS entropy FROM (SELECT path, count(*) / sum(count(*)) OVER (PARTITION BY path) AS p FROM spread GROUP BY path, x) GROUP BY 1),
  sections AS (SELECT path, count(*) FILTER (entropy > 7.0) AS high FROM (SELECT path, section, -sum(p * log2(p)) AS entropy FROM
    (SELECT path, (i - 1) // 1024 AS section, count(*) / sum(count(*)) OVER (PARTITION BY path, (i - 1) // 1024) AS p FROM spread JOIN bytes USING (path) WHERE i <= size // 1024 * 1024 GROUP BY path, section, x) GROUP BY 1, 2) GROUP BY 1),
  odd AS (SELECT path, count(*) FILTER (x < '20' OR x > '7E') / count(*) AS odd FROM spread WHERE i <= 4096 GROUP BY 1),
  parts AS (SELECT path, round(entropy, 6) AS entropy, round(greatest(0, (entropy - 5) / 3), 4) AS e, round(odd, 4) AS o, CASE WHEN packer IS NULL THEN 0 ELSE 1 END AS p, CASE WHEN size < 1024 THEN 0 ELSE round(coalesce(high, 0) / (size // 1024), 4) END AS h
    FROM bytes JOIN whole USING (path) JOIN odd USING (path) LEFT JOIN sections USING (path)),
  scored AS (SELECT path, entropy, e, o, h, least(greatest(e * 0.35::DOUBLE + o * 0.15::DOUBLE + p * 0.3::DOUBLE + h * 0.2::DOUBLE, 0), 1) AS score FROM parts)"""


@query(
    f"""WITH {_SCORES} SELECT path, entropy::DOUBLE AS entropy, round(e, 3)::DOUBLE AS entropy_ratio, round(o, 3)::DOUBLE AS nonprintable_ratio, round(h, 3)::DOUBLE AS high_entropy_sections, round(score, 3)::DOUBLE AS score,
        CASE WHEN score >= 0.95 THEN 'critical' WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' WHEN score >= 0.3 THEN 'low' END AS severity FROM scored"""
)
def artifact_scores(spark, sf_dir):
    """Entropy, the parts of the heuristic score, the score and its severity of every artifact."""
    c = F.col("content")
    s = _blobs(spark, sf_dir).select("path", binary.byte_entropy(c).alias("entropy"), binary.score_components(c).alias("p"), c)
    s = s.withColumn("score", binary.heuristic_score(F.col("p"), c))
    three = lambda x: F.round(x, 3)
    return s.select("path", F.round("entropy", 6).alias("entropy"), *[three(f"p.{k}").alias(k) for k in ("entropy_ratio", "nonprintable_ratio", "high_entropy_sections")], three("score").alias("score"), binary.score_severity(F.col("score")).alias("severity"))


_STRINGS = (
    ("", ), ("CreateRemoteThread", "WriteProcessMemory"), ("PowerShell", "CMD.EXE"), ("WSAStartup", "https://a.example.org/x"), ("ptrace", "IsDebuggerPresent"), ("VirtualAlloc", "mprotect", "WriteProcessMemory"),
    ("p\0o\0w\0e\0r\0s\0h\0e\0l\0l\0", "/bin/sh"), ("https://b.example.org", "WriteProcessMemory"), ("MEI\014\013\012\013\016",), ("powershell", "cmd.exe"),
)


def _strung(spark, sf_dir) -> DataFrame:
    """doc_id, path, content: each document's bytes with some strings before its text, by its id."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    more = F.get(F.array(*[F.lit(" ".join(s)) for s in _STRINGS]), (F.col("doc_id") % len(_STRINGS)).cast("int"))
    return d.select("doc_id", _text("doc_id").alias("path"), F.encode(F.concat(more, F.lit(" "), "text"), "UTF-8").alias("content"))


#: What the strings of each number must give, besides the file itself; found by reading the rules, not by running them.
_EXPECTED = """(1, 'rule:ProcessInjection', 'high'), (1, 'capability:process_injection', 'high'), (2, 'rule:ShellExecution', 'medium'), (3, 'rule:SuspiciousNetwork', 'medium'),
  (4, 'rule:AntiAnalysis', 'high'), (4, 'capability:anti_analysis', 'medium'), (5, 'rule:MemoryManipulation', 'high'), (5, 'capability:memory_exec', 'high'), (6, 'rule:ShellExecution', 'medium'),
  (7, 'capability:downloader', 'high'), (8, 'packer:pyinstaller', 'medium'), (9, 'rule:ShellExecution', 'medium'), (9, 'capability:script_execution', 'medium')"""


@query(
    f"""WITH expected(number, category, severity) AS (VALUES {_EXPECTED})
    SELECT CAST(doc_id AS VARCHAR) AS path, category, severity FROM documents JOIN expected ON number = doc_id % {len(_STRINGS)} UNION ALL SELECT CAST(doc_id AS VARCHAR), 'file', 'info' FROM documents"""
)
def artifact_findings(spark, sf_dir):
    """Findings of rules, capabilities and bundles in bytes; what each kind of string must give is stated by hand in SQL. Entropy and score: see artifact_measures."""
    found = artifacts.observations(_strung(spark, sf_dir).select("path", "content"))
    return found.filter("category NOT IN ('entropy', 'ml:classification')").select("path", "category", "severity")


@query(
    f"""WITH {_SCORES} SELECT path, 'entropy' AS category, CASE WHEN entropy >= 7.2 THEN 'medium' ELSE 'info' END AS severity FROM scored
    UNION ALL SELECT path, 'ml:classification', CASE WHEN score >= 0.95 THEN 'critical' WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END FROM scored WHERE score >= 0.3"""
)
def artifact_measures(spark, sf_dir):
    """Findings of entropy and heuristic score of every artifact."""
    found = artifacts.observations(_blobs(spark, sf_dir).select("path", "content"))
    return found.filter("category IN ('entropy', 'ml:classification')").select("path", "category", "severity")


_RULE_TEXT = r"""
rule Often { meta: severity = "high" category = "often" strings: $a = "th" nocase condition: #a > 40 }
rule Opens { meta: category = "opens" strings: $t = "Th" $u = "L" condition: $t at 0 or $u at 0 }
rule Near : place { strings: $e = "error" fullword $f = "password" $g = /[0-9]{5}/ condition: any of them and not Opens and filesize < 4KB }
rule Wide { meta: severity = "low" strings: $w = "cmd.exe" wide nocase condition: $w }
rule Never { strings: $x = "\x01\x02never" condition: all of them }
"""


@query(
    r"""WITH said AS (SELECT CAST(doc_id AS VARCHAR) AS path, text, strlen(text) AS size, starts_with(text, 'Th') OR starts_with(text, 'L') AS opens,
        len(regexp_extract_all(text, '(?i)th')) AS often, (regexp_matches(text, '(^|[^A-Za-z0-9])error([^A-Za-z0-9]|$)')) AS e, contains(text, 'password') AS f, regexp_matches(text, '[0-9]{5}') AS g FROM documents)
    SELECT path, 'Often' AS rule, 'rule:often' AS category, 'high' AS severity, often AS n FROM said WHERE often > 40
    UNION ALL SELECT path, 'Opens', 'rule:opens', 'medium', NULL FROM said WHERE opens
    UNION ALL SELECT path, 'Near', 'rule:Near', 'medium', NULL FROM said WHERE (e OR f OR g) AND NOT opens AND size < 4096"""
)
def rule_file_findings(spark, sf_dir):
    """Rules given as text, over the bytes of all documents; n is the number of matches where SQL counts them too."""
    files = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(_text("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    found = rulefile.matches(files, _RULE_TEXT)
    return found.select("path", "rule", "category", "severity", F.when(F.col("rule") == "Often", F.col("n_matches")).alias("n"))


@query(
    """WITH said AS (SELECT CAST(doc_id AS VARCHAR) AS path, text, regexp_extract_all(text, '[0-9]{5}') AS hits FROM documents),
       first AS (SELECT path, text, hits[1] AS hit, strlen(string_split_regex(text, '[0-9]{5}')[1]) AS place FROM said WHERE len(hits) > 0)
    SELECT path, '$d' AS identifier, place AS "at", hit AS data, printf('0x%x', place) AS address FROM first"""
)
def rule_file_offsets(spark, sf_dir):
    """Byte offset and bytes of the first match of a pattern of a rule text."""
    files = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(_text("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    found = rulefile.matches(files, "rule Digits { strings: $d = /[0-9]{5}/ condition: $d }").select("path", F.get("strings", F.lit(0)).alias("s"), F.get("addresses", F.lit(0)).alias("address"))
    return found.select("path", "s.identifier", "s.at", "s.data", "address")


@query(
    """WITH sized AS (SELECT doc_id, octet_length(encode(text)) AS before, n FROM (SELECT *, (['WinExec', 'dlopen', 'LoadLibrary', 'socket'])[doc_id % 4 + 1] AS n FROM documents)),
       found AS (SELECT doc_id, n AS needle, before + 1 AS place FROM sized UNION ALL SELECT doc_id, 'curl', before + length(n) + 2 FROM sized UNION ALL SELECT doc_id, n, before + length(n) + 7 FROM sized)
       SELECT f.doc_id, needle, place AS "at", printf('0x%x', greatest(place - 128, 0)) AS start, printf('0x%x', place + 384) AS "end",
         sha256(unhex(substr(hex(encode(text || ' ' || s.n || ' CURL ' || s.n)), 2 * greatest(place - 128, 0) + 1, 128))) AS region_hash
       FROM found f JOIN sized s USING (doc_id) JOIN documents d USING (doc_id)"""
)
def needle_functions(spark, sf_dir):
    """The needles written after each text are the last three of its heuristic functions (texts hold none of their own that follow)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.get(F.array(*map(F.lit, ("WinExec", "dlopen", "LoadLibrary", "socket"))), (F.col("doc_id") % 4).cast("int"))
    f = artifacts.heuristic_functions(d.select(_text("doc_id").alias("path"), F.encode(F.concat("text", F.lit(" "), n, F.lit(" CURL "), n), "UTF-8").alias("content")), limit=1 << 30)
    last = f.groupBy("path").agg(F.max("ordinal").alias("last"))
    return f.join(last, "path").filter("ordinal > last - 3").select(F.col("path").cast("long").alias("doc_id"), "needle", F.col("at").cast("long").alias("at"), "start", "end", "region_hash")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document in a zip with a folder, a hostile name, and a tar of a gzip of it."""
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            data, inner, outer = text.encode(), io.BytesIO(), io.BytesIO()
            with tarfile.open(fileobj=inner, mode="w") as t:
                info = tarfile.TarInfo("deep/x.txt.gz")
                packed = gzip.compress(data, mtime=0)
                info.size = len(packed)
                t.addfile(info, io.BytesIO(packed))
            with zipfile.ZipFile(outer, "w") as z:
                z.writestr("folder/", "")
                z.writestr("../../up/./a.txt", data)
                z.writestr("b.tar", inner.getvalue())
            rows.append((f"{doc}.zip", outer.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query(
    """SELECT doc_id || '.zip!up/a.txt' AS path, 1 AS depth, sha256(text) AS sha256 FROM documents UNION ALL SELECT doc_id || '.zip!b.tar!deep/x.txt.gz!deep/x.txt', 3, sha256(text) FROM documents"""
)
def archive_members(spark, sf_dir):
    """Every text comes out of its archive twice: under a cleaned name, and three archives deep."""
    packed = table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(_packed, "path string, content binary")
    found = archive.unpacked(packed, depth=3)
    return found.filter("path LIKE '%.txt'").select("path", "depth", F.sha2("content", 256).alias("sha256"))


def _doubled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text twice in a zip."""
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w") as z:
                z.writestr("a.txt", text)
                z.writestr("b.txt", text)
            rows.append((f"{doc}.zip", packed.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query(
    """WITH sized AS (SELECT doc_id || '.zip' AS path, strlen(text) AS n FROM documents)
    SELECT path, 'coverage_gap' AS category, CASE WHEN n > 4096 THEN 'left after 0 members of 0 bytes: member of ' || n || ' bytes' ELSE 'left after 1 members of ' || n || ' bytes: over 4096 bytes' END AS message, CASE WHEN n > 4096 THEN 0 ELSE 1 END AS n_members
    FROM sized WHERE 2 * n > 4096"""
)
def archive_gaps(spark, sf_dir):
    """Archives that hold more than a cap: what was read of them, and a finding that the rest was not."""
    packed = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInPandas(_doubled, "path string, content binary")
    found = checkpointed(archive.scanned(packed, depth=1, cap=4096))
    read = found.filter("gap IS NULL AND depth = 1").groupBy(F.split_part("path", F.lit("!"), F.lit(1)).alias("path")).agg(F.count("*").alias("n_members"))
    told = archive.coverage_gaps(found).select("path", "category", "message")
    return told.join(read, "path", "left").fillna(0, ["n_members"])


def _buried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each file at the bottom of as many zips in each other as its id says, 1 to 8; every second one twice, under two names."""
    for batch in batches:
        rows = []
        for doc, path, text in zip(batch["doc_id"], batch["path"], batch["content"], strict=True):
            name, data = path.split("/", 2)[2], text.encode()
            for level in range(doc % 8 + 1):
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w") as z:
                    z.writestr(zipfile.ZipInfo(name), data)
                    if doc % 2 and not level:
                        z.writestr(zipfile.ZipInfo(f"copy/{name}"), data)
                name, data = f"{level}.zip", packed.getvalue()
            rows.append((str(doc), f"{doc}.zip", data))
        yield pd.DataFrame(rows, columns=["root_path", "path", "content"])


@query(
    f"""WITH {FINDINGS_SQL}, c AS (SELECT split_part(path, '/', 2) AS root_path, count(*) FILTER (severity IN ('high', 'critical')) AS h, count(*) FILTER (severity = 'medium') AS m,
        len(list(DISTINCT split_part(category, ':', 1)) FILTER (severity = 'medium' AND split_part(category, ':', 1) NOT IN ('unresolved', 'ast', 'coverage_gap', 'llm'))) AS v FROM found GROUP BY 1)
    SELECT CAST(doc_id AS VARCHAR) AS root_path, CASE WHEN h > 0 OR (m >= 3 AND v >= 3) THEN 'malicious' WHEN m > 0 THEN 'suspicious' ELSE 'inconclusive' END AS state, doc_id % 8 + 1 AS depth
    FROM documents LEFT JOIN c ON root_path = CAST(doc_id AS VARCHAR)"""
)
def nested_verdicts(spark, sf_dir):
    """What lies up to eight archives deep counts for the archive that was sent in."""
    sent = sample_files(spark, sf_dir).select("doc_id", "path", "content").mapInPandas(_buried, "root_path string, path string, content binary")
    # A text is a content under its name, without the folder of copies: what is found in it hangs on both. Each is looked at once.
    name = F.replace(F.element_at(F.split("path", "!"), -1), F.lit("copy/"), F.lit(""))
    node = F.when(F.col("path").endswith(".zip"), F.col("content_sha256")).otherwise(F.concat_ws("/", "content_sha256", name))
    every = checkpointed(archive.unpacked(sent, depth=9).withColumn("content_sha256", F.sha2("content", 256)).withColumn("node", node))
    roots = every.filter("depth = 0").select(F.col("content_sha256").alias("root"), F.split_part("path", F.lit("."), F.lit(1)).alias("root_path"))
    pairs = lineage.reached(roots, every.select(F.col("parent_sha256").alias("parent"), F.col("node").alias("child")), depth=9)
    texts = every.filter("path NOT LIKE '%.zip'").groupBy(F.col("node").alias("path")).agg(F.min("content").alias("data"))
    found = detectors.observations(texts.select("path", F.decode("data", "UTF-8").alias("content"))).select(F.col("path").alias("content"), "severity", "category")
    one = roots.select(F.col("root").alias("submission"), F.lit(False).alias("trusted"), F.lit("b").alias("baseline_id"), F.lit(False).alias("matched"), F.lit(0.1).alias("distance"), F.lit(False).alias("dynamic_gap")).distinct()
    states = lineage.root_verdicts(found, pairs, one).select(F.col("submission").alias("root"), "state")
    deep = pairs.groupBy("root").agg(F.max("depth").alias("depth"))
    return roots.join(states, "root").join(deep, "root").select("root_path", "state", F.col("depth").cast("long").alias("depth"))


@query("SELECT user_id AS parent, count(*) FILTER (value >= 50 AND event_type <> 'view' AND value / 10 > 7.8) AS n FROM events GROUP BY 1 HAVING n > 2")
def encrypted_members(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("parent"), F.when(F.col("event_type") == "view", "a.DLL").otherwise("a.bin").alias("path"), F.col("value").alias("size"), (F.col("value") / 10).alias("entropy"))
    return archive.encrypted_payloads(entries)


@query("SELECT doc_id, text AS lenient, doc_id % 3 <> 1 AS strict FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN text || chr(65533) || 'x' ELSE text END AS text FROM documents)")
def file_texts(spark, sf_dir):
    """Bytes of texts, a third of them with a stray byte, decoded leniently; whether they decode strictly."""
    odd = F.when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("FF78"))).otherwise(F.unhex(F.lit("")))
    c = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.encode("text", "UTF-8"), odd).alias("c"))
    return c.select("doc_id", files.text(F.col("c"), F.lit(True)).alias("lenient"), files.text(F.col("c"), F.lit(False)).isNotNull().alias("strict"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text END AS text FROM documents")
def task_payloads(spark, sf_dir):
    """Texts as queued payloads in digits; odd ones are damaged."""
    task = F.concat(F.lower(F.hex(F.encode("text", "UTF-8"))), F.when(F.col("doc_id") % 2 == 0, "").otherwise("g"))
    return table(spark, sf_dir, "documents").select("doc_id", F.decode(tables.payload(task), "UTF-8").alias("text"))


# ------------------------------------------------------------------ baselines and sets


@query(
    """WITH sets AS (SELECT l_orderkey AS o, list_distinct(list(l_partkey % 50)) AS c, list_distinct(list(l_suppkey)) AS f FROM lineitem GROUP BY 1),
       pairs AS (SELECT a.o_orderkey AS artifact, b.o_orderkey AS baseline, x.c AS ac, y.c AS bc, x.f AS af, y.f AS bf FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey JOIN sets x ON x.o = a.o_orderkey JOIN sets y ON y.o = b.o_orderkey),
       d AS (SELECT *, len(list_intersect(af, bf)) AS shared, round_even(1 - (0.6::DOUBLE * (len(list_intersect(ac, bc))::DOUBLE / len(list_distinct(list_concat(ac, bc)))) + 0.4::DOUBLE * (len(list_intersect(af, bf))::DOUBLE / len(list_distinct(list_concat(af, bf))))), 4) AS distance FROM pairs)
       SELECT artifact, arg_min(baseline, row(distance, baseline)) AS baseline, min(distance) AS distance, min(distance) < 0.2 AS matched, arg_min(shared, row(distance, baseline)) AS shared FROM d GROUP BY 1"""
)
def baseline_compare(spark, sf_dir):
    """For each order the other order of its customer that is nearest by parts and suppliers."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 50).cast("string")).alias("chunks"), F.collect_set(_text("l_suppkey")).alias("functions"))
    o = table(spark, sf_dir, "orders").join(sets, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "chunks", "functions")
    b = o.select("o_custkey", F.col("o_orderkey").alias("baseline"), F.col("o_orderkey").alias("ordinal"), F.col("chunks").alias("baseline_chunks"), F.col("functions").alias("baseline_functions"))
    pairs = o.withColumnRenamed("o_orderkey", "artifact").join(b, "o_custkey").filter("artifact <> baseline")
    return similarity.compare(pairs).select("artifact", "baseline", "distance", "matched", F.col("shared").cast("long").alias("shared"))


@query("SELECT l_orderkey AS artifact, list_sort(list_distinct(list('h' || l_suppkey))) AS function_hashes FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, [] FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def baseline_build(spark, sf_dir):
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact")).unionByName(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact"))).distinct()
    return similarity.build(every, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact"), F.concat(F.lit("h"), _text("l_suppkey")).alias("normalized_hash")))


# ------------------------------------------------------------------ manifests, repositories, code


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{5,}') AS w FROM documents)
       SELECT doc_id || '/package.json' AS path, x AS name, 'node' AS ecosystem, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_filter([w[1], w[2]], lambda x: x IS NOT NULL)) || CASE WHEN w[3] IS NULL THEN [] ELSE [w[3]] END) AS x FROM w) GROUP BY ALL
       UNION ALL SELECT doc_id || '/requirements.txt', x, 'python', count(*) FROM (SELECT doc_id, unnest(w[4:6]) AS x FROM w) GROUP BY ALL"""
)
def manifest_names(spark, sf_dir):
    """The first six long words of each document, as dependencies of two manifests."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0).alias("w"))
    as_map = lambda a: F.map_from_arrays(a, F.transform(a, lambda x: F.lit("1")))
    first, dev = F.array_distinct(F.slice("w", 1, 2)), F.slice("w", 3, 1)
    node = w.select(F.concat(_text("doc_id"), F.lit("/package.json")).alias("path"), F.to_json(F.struct(as_map(first).alias("dependencies"), as_map(dev).alias("devDependencies"))).alias("content"))
    lines = F.array_join(F.concat(F.array(F.lit("# made")), F.transform(F.slice("w", 4, 3), lambda x, i: F.concat(x, F.get(F.array(F.lit(">=1"), F.lit(" [x]==2"), F.lit("")), i)))), "\n")
    python = w.select(F.concat(_text("doc_id"), F.lit("/requirements.txt")).alias("path"), lines.alias("content"))
    return dependencies.manifest_names(node.unionByName(python)).groupBy("path", "name", "ecosystem").agg(F.count("*").alias("n"))


_HOOK_COMMANDS = ("node scripts/a.js", "echo done", "sh b.sh", "curl -s http://x.example")


@query(
    """SELECT doc_id || '/package.json' AS path, h AS hook, (['node scripts/a.js', 'echo done', 'sh b.sh', 'curl -s http://x.example'])[doc_id % 4 + 1] AS command
       FROM documents, (SELECT unnest(['preinstall', 'postinstall']) AS h) WHERE doc_id % 4 <> 1"""
)
def manifest_hooks(spark, sf_dir):
    command = F.get(F.array(*map(F.lit, _HOOK_COMMANDS)), (F.col("doc_id") % 4).cast("int"))
    scripts = F.struct(command.alias("preinstall"), command.alias("postinstall"), command.alias("test"))
    made = table(spark, sf_dir, "documents").select(F.concat(_text("doc_id"), F.lit("/package.json")).alias("path"), F.to_json(F.struct(scripts.alias("scripts"))).alias("content"))
    return dependencies.hooks(made)


@query(
    """SELECT doc_id || '/package.json' AS path, 'postinstall' AS hook, doc_id || '/lib/run' || doc_id || '.js' AS script, 'high' AS severity FROM documents WHERE lang IN ('en', 'de')"""
)
def hook_droppers(spark, sf_dir):
    """A hook runs a script that downloads (English), has suspicious imports (German) or neither."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    script = F.concat(F.lit("lib/run"), _text("doc_id"), F.lit(".js"))
    manifest = d.select(F.concat(_text("doc_id"), F.lit("/package.json")).alias("path"), F.to_json(F.struct(F.struct(F.concat(F.lit("node  "), script).alias("postinstall")).alias("scripts"))).alias("content"))
    code = d.select(F.concat(_text("doc_id"), F.lit("/"), script).alias("path"), F.when(F.col("lang") == "en", "fetch(u)").otherwise("x = 1").alias("content"))
    imports = d.filter("lang = 'de'").select(F.concat(_text("doc_id"), F.lit("/"), script).alias("path"), F.lit("import:suspicious").alias("category"))
    return repository.hook_droppers(manifest.unionByName(code), imports)


_PATHS = ("src/setup.py", "tests/test_a.py", "Makefile", ".github/workflows/x.yml", "package.json", "ssh/kex_a.c", "web/flask_app.rs", "a/__init__.py", "data.csv")
_ROLE_SQL = "(0, ['entry_point'], 'source', false, false), (1, [], 'source', true, false), (2, ['build_file'], 'source', false, false), (3, ['build_file'], 'config', false, true), (4, ['manifest'], 'config', false, true), (5, [], 'source', false, false), (6, [], 'source', false, false), (7, ['entry_point'], 'source', false, false), (8, [], 'unknown', false, true)"


def _named(spark, sf_dir) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % len(_PATHS)).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), (F.col("doc_id") % 7).cast("string")).alias("repo"), F.concat(_text("doc_id"), F.lit("/"), name).alias("path"), "doc_id")


@query(f"WITH expected(number, roles, class, in_test, in_data) AS (VALUES {_ROLE_SQL}) SELECT doc_id, roles, class, in_test, in_data FROM documents JOIN expected ON number = doc_id % {len(_PATHS)}")
def file_roles(spark, sf_dir):
    p = F.col("path")
    return _named(spark, sf_dir).select("doc_id", repository.roles(p).alias("roles"), paths.classify(p).alias("class"), paths.is_test_path(p).alias("in_test"), paths.is_data_file(p).alias("in_data"))


@query(
    f"""WITH n AS (SELECT source || '-' || (doc_id % 7) AS repo, list(DISTINCT doc_id % {len(_PATHS)}) AS k FROM documents GROUP BY 1)
        SELECT repo, CASE WHEN list_contains(k, 5) THEN 'SSH/crypto library' WHEN list_contains(k, 4) THEN 'npm package' WHEN list_contains(k, 6) THEN 'Python web framework' WHEN list_contains(k, 0) THEN 'Python package' ELSE 'software project' END AS project FROM n"""
)
def project_types(spark, sf_dir):
    return repository.project_types(_named(spark, sf_dir), "repo")


#: (name, code, kind and target of each reference)
_CODE = (
    ("a.py", "import os.path\nfrom pkg.sub import x\nfrom . import near\nopen('data/x.json')\n", (("import", "os.path"), ("import", "pkg.sub"), ("import", ".near"), ("open", "data/x.json"))),
    ("b.js", "const x = require('./lib/a')\nimport y from '../z'\nfs.readFileSync('k.txt')\n", (("require", "./lib/a"), ("import", "../z"), ("open", "k.txt"))),
    ("c.py", "exec(open('p.txt').read())\njson.load(open('q.json'))\n", (("open", "p.txt"), ("open", "q.json"), ("open", "q.json"), ("exec_open", "p.txt"))),
    ("d.txt", "import os\n", ()),
)


def _code(spark, sf_dir, pieces) -> DataFrame:
    piece = F.array(*[F.struct(F.lit(p[0]).alias("name"), F.lit(p[1]).alias("code")) for p in pieces])
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(piece, (F.col("doc_id") % len(pieces)).cast("int")).alias("p"))
    return d.select("doc_id", F.concat(_text("doc_id"), F.lit("/"), "p.name").alias("path"), F.col("p.code").alias("content"))


@query("WITH expected(number, kind, target) AS (VALUES " + ", ".join(f"({i}, '{k}', '{t}')" for i, p in enumerate(_CODE) for k, t in p[2]) + f") SELECT doc_id, kind, target FROM documents JOIN expected ON number = doc_id % {len(_CODE)}")
def code_references(spark, sf_dir):
    return graph.references(_code(spark, sf_dir, _CODE).select("path", "content")).select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("doc_id"), "kind", "target")


#: (name, code, categories of tree and uncertainty findings)
_TREES = (
    ("fold.py", 'a = "".join(["s", "s", "h", "x"])\nb = chr(104) + "ello"\n', ("ast:resolved_obfuscation",)),
    ("plain.py", 'x = "abcd"\n', ()),
    ("exec.py", "exec(z)\n", ("unresolved:exec_of_unknown",)),
    ("home.py", "import os\nopen(os.path.expanduser('~'))\n", ("unresolved:path_construction",)),
    ("send.py", "import requests\nimport os\nrequests.request('GET', os.path.expanduser('~'))\n", ("unresolved:network_with_variable_data", "unresolved:capability_cocktail")),
    ("exit.py", "import atexit\natexit.register(f)\nopen('x')\n", ("unresolved:callback_with_side_effects",)),
    ("hex.py", 'c = bytes.fromhex("68656c6c6f").decode()\n', ("ast:resolved_obfuscation",)),
    ("broken.py", "def (\n", ()),
    ("n.js", "const http = require('http'); fopen(x); system(y)", ("unresolved:capability_cocktail",)),
)


@query("WITH expected(number, category) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, t in enumerate(_TREES) for c in t[2]) + f") SELECT doc_id, category, 'medium' AS severity FROM documents JOIN expected ON number = doc_id % {len(_TREES)}")
def tree_findings(spark, sf_dir):
    """Findings that need a syntax tree; what each piece of code must give is stated by hand in SQL."""
    code = _code(spark, sf_dir, _TREES).select("path", "content")
    none = spark.createDataFrame([], "path string, category string")
    odd = pyast.unresolved(pyast.fingerprints(code), none).unionByName(pyast.folded_findings(code))
    return odd.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("doc_id"), "category", "severity")


@query("SELECT doc_id, 'reader' AS side FROM documents WHERE doc_id % 9 IN (3, 5)")
def capability_sides(spark, sf_dir):
    """Code that reads home or local files and uses no network, and the other way round (of these pieces none)."""
    readers, senders = graph.capability_sides(pyast.fingerprints(_code(spark, sf_dir, _TREES).select("path", "content")))
    both = readers.withColumn("side", F.lit("reader")).unionByName(senders.withColumn("side", F.lit("sender")))
    return both.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("doc_id"), "side")


@query(
    """WITH edges AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
       readers AS (SELECT 'p' || p_partkey AS path FROM part WHERE p_size > 25), senders AS (SELECT 'o' || o_orderkey AS path FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size <= 25),
       near AS (SELECT data_file, exec_file, min(depth) AS depth FROM (SELECT e.dst AS data_file, e.src AS exec_file, 1 AS depth FROM edges e JOIN readers r ON e.dst = r.path UNION ALL SELECT e.dst, f.src, 2 FROM edges e JOIN readers r ON e.dst = r.path JOIN edges f ON f.dst = e.src)
                JOIN senders ON exec_file = path GROUP BY 1, 2),
       beside AS (SELECT DISTINCT x.dst AS data_file, y.dst AS exec_file FROM edges x JOIN readers r ON x.dst = r.path JOIN edges y ON x.src = y.src JOIN senders s ON y.dst = s.path ANTI JOIN near n ON n.data_file = x.dst AND n.exec_file = y.dst)
       SELECT data_file, depth, count(*) AS n FROM (SELECT data_file, exec_file, depth FROM near UNION ALL SELECT data_file, exec_file, NULL FROM beside) GROUP BY ALL"""
)
def behavioral_leads(spark, sf_dir):
    """Leads from readers (large parts) to senders (finished orders, small parts), by depth; null for those that share an importer."""
    l, o, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    name = lambda kind, c: F.concat(F.lit(kind), _text(c))
    edges = l.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).unionByName(o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))
    readers = p.filter("p_size > 25").select(name("p", "p_partkey").alias("path"))
    senders = o.filter("o_orderstatus = 'F'").select(name("o", "o_orderkey").alias("path")).unionByName(p.filter("p_size <= 25").select(name("p", "p_partkey").alias("path")))
    return graph.behavioral_leads(edges, readers, senders).groupBy("data_file", "depth").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ findings of the sample files, further on


@query(
    f"""WITH {FINDINGS_SQL}, tags AS (SELECT path, count(DISTINCT category) FILTER (category IN ({", ".join(map(repr, P.DATA_CATEGORIES))})) AS d, count(DISTINCT category) FILTER (category IN ({", ".join(map(repr, P.STRONG_DATA_CATEGORIES))})) AS s,
        count(*) FILTER (category IN ({", ".join(map(repr, P.EXEC_CATEGORIES))})) AS e FROM found GROUP BY 1)
        SELECT path, 'data' AS side FROM tags WHERE d >= 2 OR s >= 1 UNION ALL SELECT path, 'exec' FROM tags WHERE e > 0"""
)
def carrier_files(spark, sf_dir):
    data, execs = graph.carriers(findings(spark, sf_dir))
    return data.withColumn("side", F.lit("data")).unionByName(execs.withColumn("side", F.lit("exec")))


@query(
    f"""WITH {FINDINGS_SQL}, b AS (SELECT repo, path, category, place, CASE WHEN severity IN ('high', 'critical') THEN 'high' WHEN contains(category, 'behavioral') THEN 'behavioral' WHEN severity = 'medium' THEN 'other' END AS bucket FROM found),
        r AS (SELECT *, row_number() OVER (PARTITION BY repo, bucket ORDER BY path, place) AS n FROM b WHERE bucket IS NOT NULL)
        SELECT repo, bucket, count(*) AS n, list(path || ' ' || category ORDER BY n) FILTER (n <= CASE bucket WHEN 'high' THEN 50 WHEN 'behavioral' THEN 20 ELSE 30 END) AS shown FROM r GROUP BY 1, 2"""
)
def triage_buckets(spark, sf_dir):
    return verdict.triage_buckets(findings(spark, sf_dir), "repo", "path", "ordinal")


@query(
    f"""WITH {FINDINGS_SQL}, every AS (SELECT repo, path, category, severity FROM found UNION ALL SELECT repo, path, 'unresolved:' || k, 'medium' FROM files JOIN documents USING (doc_id), (SELECT unnest(['a', 'b', 'c']) AS k) WHERE lang = 'fr' AND (n_chars > 2000 OR k = 'a')),
        facts AS (SELECT f.repo, f.path, d.n_chars, coalesce(l.quality = 0, false) AS odd, coalesce(l.toxic = 1, false) AS picked, regexp_extract(f.path, '[^/]*$') AS name,
          bool_or(severity IN ('high', 'critical')) AS high, bool_or(severity = 'medium') AS medium, count(category) AS n, count(*) FILTER (starts_with(category, 'unresolved:')) AS unresolved, bool_or(starts_with(category, 'behavioral:')) AS behavioral, bool_or(starts_with(category, 'behavioral:credential_access')) AS credential
          FROM files f JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) LEFT JOIN every e ON e.path = f.path GROUP BY ALL),
        ladder AS (SELECT repo, path, greatest(CASE WHEN picked THEN 110 END, CASE WHEN n_chars > 5000 THEN 100 END, CASE WHEN n = 0 THEN NULL WHEN name = 'setup.py' AND high THEN 90 WHEN name = 'setup.py' THEN 80 END,
          CASE WHEN n = 0 THEN NULL WHEN unresolved >= 3 THEN 105 WHEN unresolved > 0 THEN 85 WHEN high AND behavioral THEN 85 WHEN odd THEN 75 WHEN credential THEN 55 WHEN medium AND n >= 2 THEN 50 END) AS priority FROM facts)
        SELECT repo, priority, count(*) AS n FROM ladder WHERE priority IS NOT NULL GROUP BY ALL"""
)
def target_ladder(spark, sf_dir):
    """How many files of each repository stand on each step of the ladder: triage names toxic documents, leads end in long ones, and odd ones are of no quality."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") == 0).alias("odd"), F.max(F.col("toxic") == 1).alias("picked"))
    f = sample_files(spark, sf_dir).select("repo", "path", "doc_id").join(d, "doc_id").join(l, "doc_id", "left")
    f = f.withColumns({"ordinal": F.col("doc_id"), "roles": repository.roles(F.col("path")), "anomaly_score": F.when(F.col("odd"), 0.8).otherwise(0.0)})
    unsure = f.filter("lang = 'fr'").select("repo", "path", F.explode(F.when(F.col("n_chars") > 2000, F.array(*map(F.lit, "abc"))).otherwise(F.array(F.lit("a")))).alias("k")).select("repo", "path", F.concat(F.lit("unresolved:"), "k").alias("category"), F.lit("medium").alias("severity"))
    found = findings(spark, sf_dir).select("repo", "path", "category", "severity").unionByName(unsure)
    leads = f.filter("n_chars > 5000").select("repo", F.col("path").alias("exec_file"))
    ranked = verdict.targets(verdict.target_candidates(f, found, leads, f.filter("picked").select("repo", "path"), "repo"), "repo")
    return ranked.groupBy("repo", "priority").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ answers, keys, provenance


def _answers(spark, sf_dir) -> DataFrame:
    """key, text, triage_score: a recorded answer for each document, some without JSON."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("doc_id") % len(v)).cast("int"))
    one = F.struct(pick("high", "low", "medium").alias("severity"), F.when(F.col("doc_id") % 2 == 0, "x:y").alias("category"), F.concat(F.lit("m"), _text("doc_id")).alias("message"))
    body = F.to_json(F.struct(pick("malicious", "benign", "suspicious", "clean").alias("verdict"), ((F.col("doc_id") % 10) / 10).alias("confidence"), F.concat(F.lit("s"), _text("doc_id")).alias("summary"), F.array(one).alias("findings")))
    text = F.when(F.col("lang") == "en", F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nbye"))).when(F.col("lang") == "de", F.concat(F.lit("```json\n{broken\n```"), body)).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return d.select(F.col("doc_id").alias("key"), text.alias("text"), ((F.col("doc_id") % 20) / 20).alias("triage_score"))


_ANSWERS = """a AS (SELECT doc_id AS key, (['malicious', 'benign', 'suspicious', 'clean'])[doc_id % 4 + 1] AS said, (doc_id % 10) / 10 AS sure, (['high', 'low', 'medium'])[doc_id % 3 + 1] AS sev, CASE WHEN doc_id % 2 = 0 THEN 'x:y' END AS cat, (doc_id % 20) / 20 AS triage FROM documents WHERE lang <> 'de')"""


@query(
    f"""WITH {_ANSWERS} SELECT key, 'llm:malicious_confirmed' AS category, 'high' AS severity, 's' || key AS message, sure < 0.7 AS advisory FROM a WHERE said = 'malicious' AND sure >= 0.7
        UNION ALL SELECT key, 'llm:benign_confirmed', 'info', 's' || key, sure < 0.7 FROM a WHERE said = 'benign'
        UNION ALL SELECT key, coalesce(cat, 'llm:finding'), CASE sev WHEN 'high' THEN 'high' ELSE 'medium' END, 'm' || key, sure < 0.7 FROM a"""
)
def answer_findings(spark, sf_dir):
    return responses.findings(_answers(spark, sf_dir)).drop("source")


@query(
    f"""WITH {_ANSWERS}, j AS (SELECT *, said = 'malicious' AND sure >= 0.7 AS bad, (said = 'malicious' AND sure < 0.7) OR said = 'suspicious' OR (said = 'benign' AND triage >= 0.85) AS doubted FROM a)
        SELECT key, CASE WHEN bad THEN 'llm:function_malicious' WHEN doubted THEN 'llm:function_suspicious' ELSE 'llm:function_benign' END AS category, CASE WHEN bad THEN 'high' WHEN doubted THEN 'medium' ELSE 'info' END AS severity FROM j WHERE bad OR doubted OR said = 'benign'
        UNION ALL SELECT key, 'llm:' || coalesce(cat, 'finding'), sev FROM a WHERE sev IN ('high', 'medium')"""
)
def function_answers(spark, sf_dir):
    return responses.function_findings(_answers(spark, sf_dir)).select("key", "category", "severity")


@query("SELECT doc_id AS key, CASE WHEN lang <> 'de' AND doc_id % 4 IN (0, 2, 3) THEN (['malicious', '', 'suspicious', 'clean'])[doc_id % 4 + 1] ELSE 'rules' END AS state FROM documents")
def verdict_override(spark, sf_dir):
    """An answer's verdict replaces the rules' where it is one of the known states."""
    a = _answers(spark, sf_dir)
    return responses.overridden(a.select("key", F.lit("rules").alias("state")), a)


@query("SELECT doc_id AS key, 'r' || doc_id AS rule FROM documents WHERE doc_id % 3 <> 1")
def rule_texts(spark, sf_dir):
    """Rules in answers: two thirds are whole, the others lack a condition."""
    body = F.when(F.col("doc_id") % 3 == 1, "strings:\n $a = \"x\"").otherwise("strings:\n $a = \"x\"\n condition:\n  $a")
    text = F.concat(F.lit("As asked:\n\nrule r"), _text("doc_id"), F.lit(" {\n "), body, F.lit("\n}\nDone."))
    return responses.rule_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), text.alias("text"))).select("key", "rule")


@query("SELECT path, sha256('File: ' || path || chr(10) || 'a' || chr(10) || 'b' || chr(10) || substr(text, 1, 500)) AS prompt_key FROM (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents)")
def prompt_texts(spark, sf_dir):
    """Prompts with the first two findings and the first 500 characters."""
    d = table(spark, sf_dir, "documents").select(_text("doc_id").alias("path"), F.col("text").alias("content"), F.array(*map(F.lit, "abc")).alias("findings"))
    return responses.prompts(d, most_chars=500, most_findings=2).select("path", "prompt_key")


@query("SELECT conv_id, turn, tokens FROM (SELECT conv_id, turn, length(text) AS tokens, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used - tokens < 400")
def answers_in_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn"), F.col("turn").alias("ordinal"), F.length("text").cast("long").alias("in_tokens"), F.lit(0).cast("long").alias("out_tokens"))
    return responses.within_budget(c, "conv_id", budget=400).select("conv_id", "turn", "tokens")


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey <> 0 AND c_acctbal > 0")
def verified_keys(spark, sf_dir):
    """Keys are hashes of names, revoked in nation 0; customers with money present theirs."""
    c = table(spark, sf_dir, "customer")
    keys = c.select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("key_hash"), F.when(F.col("c_nationkey") == 0, F.current_timestamp()).alias("revoked_at"))
    return access.verified(keys, c.filter("c_acctbal > 0").select(F.col("c_name").alias("raw"))).select("id")


@query("SELECT c_custkey, 'postgres://u:***@h' || c_nationkey || '/db' AS url, c_mktsegment = 'BUILDING' AS allowed FROM customer")
def redacted_urls(spark, sf_dir):
    url = F.concat(F.lit("postgres://u:"), F.sha1("c_name"), F.lit("@h"), _text("c_nationkey"), F.lit("/db"))
    return table(spark, sf_dir, "customer").select("c_custkey", access.redacted_url(url).alias("url"), access.allowed(F.array(F.lower("c_mktsegment"), F.lit("read")), "building").alias("allowed"))


@query("SELECT bool_and(s_acctbal > -100000) AS ok FROM supplier")
def health(spark, sf_dir):
    return access.healthy(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") > -100000).alias("ok")))


@query("SELECT l.doc_id, l.toxic = 1 OR d.lang = 'en' OR d.source = 'web' AS trusted FROM labels l JOIN documents d USING (doc_id)")
def provenance(spark, sf_dir):
    j = table(spark, sf_dir, "labels").select("doc_id", "toxic").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    rows = j.select("doc_id", F.when(F.col("toxic") == 1, True).alias("authenticode"), F.when(F.col("lang") == "en", "bundle").otherwise("").alias("sigstore"), F.when(F.col("source") == "web", "layout").alias("in_toto"))
    return artifacts.trusted(rows).select("doc_id", "trusted")


@query(
    """SELECT s_suppkey AS artifact, tool, CASE WHEN on_ THEN 'unavailable' ELSE 'skipped' END AS status FROM supplier, (VALUES ('angr', false), ('cape', true)) AS t(tool, on_)
       UNION ALL SELECT s_suppkey, 'cape', 'event' FROM supplier UNION ALL SELECT s_suppkey, 'drakvuf', 'event' FROM supplier"""
)
def unavailable_tools(spark, sf_dir):
    """Rows of tools that are not run, and the events that stand for the dynamic ones."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artifact"))
    runs = artifacts.unavailable(a, {"angr": False, "cape": True}).select("artifact", "tool", "status")
    return runs.unionByName(artifacts.placeholder_events(a, ("cape", "drakvuf")).select("artifact", F.col("source").alias("tool"), F.lit("event").alias("status")))


@query("SELECT status, expected, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS status, CASE d.lang WHEN 'en' THEN 'malicious' WHEN 'de' THEN 'suspicious' ELSE 'clean' END AS expected, CASE WHEN l.toxic = 1 THEN 'malicious' WHEN l.quality = 0 THEN 'suspicious' WHEN l.doc_id IS NOT NULL THEN 'inconclusive' ELSE 'missing' END AS v FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE CASE expected WHEN 'suspicious' THEN v IN ('suspicious', 'malicious') WHEN 'clean' THEN v IN ('clean', 'inconclusive') ELSE v = expected END GROUP BY ALL")
def passed_cases(spark, sf_dir):
    """Cases of an evaluation that pass, by what was expected; documents without a label have no verdict."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit("ok").alias("status"), F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 0, "suspicious").otherwise("inconclusive").alias("verdict"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "malicious").when(F.col("lang") == "de", "suspicious").otherwise("clean").alias("expected"))
    return metrics.case_results(metrics.joined(d, l, ["doc_id"])).filter("passed").groupBy("status", "expected").agg(F.count("*").alias("n"))


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds, count(DISTINCT event_type) FILTER (value > 50) AS rich FROM events GROUP BY 1")
def set_operations(spark, sf_dir):
    """Kinds of events of each user as a union of two sets, and how many are in the set of rich ones too."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") <= 50, F.col("event_type"))).alias("b"))
    return e.select("user_id", F.array_sort(F.array_union("a", "b")).alias("kinds"), F.size(F.array_intersect("a", F.array_union("a", "b"))).cast("long").alias("rich"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def keyed_lookup(spark, sf_dir):
    return tables.lookup(table(spark, sf_dir, "orders"), "o_orderpriority", "1-URGENT").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, k IN (0, 1, 2) AS eligible FROM (SELECT p_partkey, p_size % 5 AS k FROM part)")
def anomaly_languages(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ("a.py", "b.TSX", "x/c.mjs", "d.go", "py"))), F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", anomaly.eligible(name).alias("eligible"))


@query("SELECT sha256(c_name) AS key_hash, CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_nationkey > 3 THEN [lower(c_mktsegment)] ELSE ['submit', 'read'] END AS scopes, CASE WHEN c_nationkey > 3 THEN c_nationkey ELSE 60 END AS rate_limit FROM customer")
def issued_keys(spark, sf_dir):
    own = F.col("c_nationkey") > 3
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("raw"), _text("c_custkey").alias("name"), F.when(own, F.array(F.lower("c_mktsegment"))).alias("scopes"), F.when(own, F.col("c_nationkey")).alias("rate_limit"))
    return access.issued(c).select("key_hash", "name", "scopes", "rate_limit")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def selected_cases(spark, sf_dir):
    """The 25 dearest finished orders, as the first cases of one format."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("format"), (-F.col("o_totalprice")).alias("_p"))
    return metrics.selected(o, "_p", "o_orderkey", kind="F", most=25).select("o_orderkey")


@query(
    """WITH c AS (SELECT count(*) FILTER (q = 0 AND t = 1) AS tp, count(*) FILTER (q <> 0 AND t = 1) AS fp, count(*) FILTER (q <> 0 AND t <> 1) AS tn, count(*) FILTER (q = 0 AND t <> 1) AS fn FROM (SELECT quality AS q, toxic AS t FROM labels)),
       r AS (SELECT *, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 4) AS a, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp::DOUBLE / (tp + fp), 4) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp::DOUBLE / (tp + fn), 4) END AS r, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round((2 * tp)::DOUBLE / (2 * tp + fp + fn), 4) END AS f FROM c)
       SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7])::BIGINT AS place, unnest(['# Evaluation', printf('- **Accuracy**: %.2f%%', a * 100), printf('- **Precision**: %.2f%%', p * 100), printf('- **Recall**: %.2f%%', r * 100), printf('- **F1 Score**: %.2f%%', f * 100),
         printf('Actual MAL %5d %5d', tp, fn), printf('Actual BEN %5d %5d', fp, tn), '## Verdicts']) AS value FROM r
       UNION ALL SELECT 100 + row_number() OVER (ORDER BY v), '- ' || v || ': ' || n FROM (SELECT CASE WHEN toxic = 1 THEN 'malicious' ELSE 'clean' END AS v, count(*) AS n FROM labels GROUP BY 1)"""
)
def evaluation_report(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    counts = metrics.confusion(l.select((F.col("quality") == 0).alias("label"), (F.col("toxic") == 1).alias("verdict")))
    return metrics.report(counts, l.select(F.when(F.col("toxic") == 1, "malicious").otherwise("clean").alias("verdict")))
