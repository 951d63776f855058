"""Reports of outside tools (JSON) as findings. Tools themselves are not run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "artifact", "source", "category", "severity", "message"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _rows(reports: DataFrame, path: str, schema: str) -> DataFrame:
    """(artifact, e) for each element of the array at `path`."""
    items = F.from_json(F.get_json_object("report", path), f"array<{schema}>")
    return reports.select("artifact", F.explode(items).alias("e"))


def _finding(rows: DataFrame, source: str, category: Column, severity: Column, message: Column) -> DataFrame:
    return rows.select("artifact", F.lit(source).alias("source"), category.alias("category"), severity.alias("severity"), message.alias("message"))


def capabilities(reports: DataFrame) -> DataFrame:
    """Findings of capability reports (artifact, report): one a rule, high where it names attack techniques."""
    parsed = F.from_json("report", "struct<rules: map<string, struct<meta: struct<namespace: string, `att&ck`: array<string>, attack: array<string>>>>>")
    rows = reports.select("artifact", F.explode(parsed["rules"]).alias("rule", "r"))
    attacks = F.concat(F.coalesce(F.col("r.meta.`att&ck`"), F.array().cast("array<string>")), F.coalesce(F.col("r.meta.attack"), F.array().cast("array<string>")))
    category = F.concat(F.lit("capability:"), F.coalesce(F.nullif(F.col("r.meta.namespace"), F.lit("")), F.col("rule")))
    return _finding(rows, "capa", category, F.when(F.size(attacks) > 0, "high").otherwise("medium"), F.col("rule"))


def functions(reports: DataFrame) -> DataFrame:
    """(artifact, ordinal, symbol, start, end, size, decompiled, triage_score, normalized_hash) of disassembler reports; first functions score most."""
    items = F.from_json(F.get_json_object("report", "$.functions"), "array<struct<name: string, entry: string, end: string, size: long, decompiled: string>>")
    rows = reports.select("artifact", F.posexplode(items).alias("ordinal", "f"))
    name, entry, code = F.col("f.name"), F.col("f.entry"), F.col("f.decompiled")
    score = F.greatest(F.lit(0.1), F.lit(0.9) - F.lit(0.02) * F.col("ordinal"))
    normal = F.sha2(F.coalesce(F.nullif(code, F.lit("")), F.concat(name, F.lit(":"), entry)), 256)
    return rows.select(
        "artifact", "ordinal", name.alias("symbol"), entry.alias("start"), F.col("f.end").alias("end"), "f.size",
        code.isNotNull().alias("decompiled"), score.alias("triage_score"), normal.alias("normalized_hash"),
    )


def coverage_gaps(functions: DataFrame, *, limit: int) -> DataFrame:
    """Findings of artifacts with more functions than the `limit` that are analysed, and with undecompiled ones among those."""
    seen = F.col("ordinal") < limit
    n = functions.groupBy("artifact").agg(F.count("*").alias("n"), F.count_if(seen).alias("seen"), F.count_if(seen & ~F.col("decompiled")).alias("bare"))
    more = n.filter("n > seen").withColumn("m", F.format_string(f"Ghidra found %d functions but only %d were analyzed (limit={limit}).", "n", "seen"))
    bare = n.filter("bare > 0").withColumn("m", F.format_string("%d of %d functions could not be decompiled.", "bare", "seen"))
    return _finding(more.unionByName(bare), "ghidra", F.lit("coverage_gap"), F.lit("info"), F.col("m"))


def sandbox_a(reports: DataFrame) -> DataFrame:
    """Names looked up, and signatures (high from severity 3)."""
    names = _rows(reports, "$.network.domains", "struct<domain: string>")
    marks = _rows(reports, "$.signatures", "struct<name: string, description: string, severity: int>")
    return _finding(names, "cape", F.lit("network:dns"), F.lit("medium"), F.col("e.domain")).unionByName(
        _finding(marks, "cape", F.concat(F.lit("signature:"), "e.name"), F.when(F.col("e.severity") >= 3, "high").otherwise("medium"), F.coalesce("e.description", "e.name"))
    )


def sandbox_b(reports: DataFrame) -> DataFrame:
    """Injections and evasions."""
    injected, evaded = _rows(reports, "$.injections", "struct<type: string>"), _rows(reports, "$.evasions", "struct<technique: string>")
    return _finding(injected, "drakvuf", F.lit("injection"), F.lit("high"), F.col("e.type")).unionByName(
        _finding(evaded, "drakvuf", F.lit("anti_analysis"), F.lit("medium"), F.col("e.technique"))
    )


def sandbox_c(reports: DataFrame) -> DataFrame:
    """Overall score (high from 7, medium from 4), signatures, addresses, extracted configurations and dropped files."""
    score = reports.select("artifact", _get(F.try_parse_json("report"), "$.analysis.score", "double").alias("s")).filter("s >= 4")
    out = _finding(score, "triage", F.lit("sandbox:score"), F.when(F.col("s") >= 7, "high").otherwise("medium"), F.col("s").cast("string"))
    marks = _rows(reports, "$.signatures", "struct<name: string, score: int>")
    level = F.when(F.col("e.score") >= 7, "high").otherwise("medium")
    out = out.unionByName(_finding(marks, "triage", F.concat(F.lit("signature:"), "e.name"), level, F.col("e.name")))
    found = _rows(reports, "$.targets", "struct<iocs: struct<domains: array<string>, ips: array<string>>>")
    for field, kind in (("domains", "network:dns"), ("ips", "network:ip")):
        out = out.unionByName(_finding(found.select("artifact", F.explode(f"e.iocs.{field}").alias("x")), "triage", F.lit(kind), F.lit("medium"), F.col("x")))
    family = _rows(reports, "$.extracted", "struct<config: struct<family: string>>")
    out = out.unionByName(_finding(family, "triage", F.lit("extracted:config"), F.lit("high"), F.col("e.config.family")))
    dropped = _rows(reports, "$.dropped", "struct<filename: string, kind: string, sha256: string>")
    return out.unionByName(_finding(dropped, "triage", F.lit("dropped:file"), F.lit("medium"), F.col("e.filename")))


def events_a(reports: DataFrame) -> DataFrame:
    """(artifact, source, kind, summary): the processes that ran."""
    rows = _rows(reports, "$.behavior.processes", "struct<process_name: string, pid: long, ppid: long>")
    return _events(rows, "cape", "process", _process("e.process_name", "e.pid"))


def events_b(reports: DataFrame, *, most: int = 50) -> DataFrame:
    """The first `most` system calls of each report."""
    calls = F.slice(F.from_json(F.get_json_object("report", "$.syscalls"), "array<struct<name: string>>"), 1, most)
    return _events(reports.select("artifact", F.explode(calls).alias("e")), "drakvuf", "syscall", F.concat(F.lit("Syscall: "), F.coalesce("e.name", F.lit("unknown"))))


def events_c(reports: DataFrame) -> DataFrame:
    """The processes of all tasks of all targets; targets whose tasks are no object have none."""
    rows = _rows(reports, "$.targets", "struct<tasks: map<string, struct<name: string, pid: long>>>")
    return _events(rows.select("artifact", F.explode(F.map_values("e.tasks")).alias("e")), "triage", "process", _process("e.name", "e.pid"))


def _process(name: str, pid: str) -> Column:
    return F.concat(F.lit("Process: "), F.coalesce(name, F.lit("unknown")), F.lit(" (PID "), F.coalesce(F.col(pid).cast("string"), F.lit("?")), F.lit(")"))


def _events(rows: DataFrame, source: str, kind: str, summary: Column) -> DataFrame:
    return rows.select("artifact", F.lit(source).alias("source"), F.lit(kind).alias("kind"), summary.alias("summary"))


def with_fallback(report_rows: DataFrame, heuristic_rows: DataFrame) -> DataFrame:
    """Findings by report where the artifact has any of the tool's, else the heuristic ones; both (artifact, tool, …)."""
    real = report_rows.select("artifact", "tool").distinct()
    return report_rows.unionByName(heuristic_rows.join(real, ["artifact", "tool"], "left_anti"))
