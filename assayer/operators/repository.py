"""Facts of a repository's files: roles, project type, hooks that lead to droppers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import paths
from assayer.operators import graph
from assayer.operators import patterns as P

# Kinds of project and the words in paths that show them; the first that applies counts.
PROJECT_WORDS = (
    ("SSH/crypto library", ("ssh", "sftp", "transport", "kex_")),
    ("cryptography library", ("cipher", "ecdsa", "ed25519", "rsa", "x509")),
    ("Node.js project", ("node_modules", "webpack", "babel")),
    ("npm package", ("package.json",)),
    ("Python web framework", ("django", "flask", "fastapi")),
    ("Python package", ("setup.py", "pyproject.toml")),
)
OTHER_PROJECT = "software project"
HOOK_SCRIPTS = (".js", ".ts", ".sh", ".py")
RUN_WORDS = ("child_process", "execSync", "subprocess")
DOWNLOAD_WORDS = ("curl", "wget", "fetch(", "https.get", "http.get", "execSync", "spawn(", "bun.sh/install", "downloadAndSetup")


def roles(path: Column) -> Column:
    """Roles of a file: entry_point, manifest, build_file."""
    name = paths.basename(path)
    build = name.isin(*P.BUILD_FILES)
    for part in P.BUILD_PATHS:
        build = build | path.contains(part)
    cells = (
        (name.isin(*P.ENTRY_POINTS) | path.endswith("__init__.py"), "entry_point"),
        (name.isin(*P.MANIFESTS), "manifest"),
        (build, "build_file"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cells]))


def project_types(files: DataFrame, key: str, words=PROJECT_WORDS) -> DataFrame:
    """(key, project): the first kind that any path of the repository shows, OTHER_PROJECT without one."""
    low = F.lower("path")
    shown = []
    for kind, parts in words:
        any_of = F.lit(False)
        for p in parts:
            any_of = any_of | low.contains(p)
        shown.append(F.bool_or(any_of).alias(kind))
    found = files.groupBy(key).agg(*shown)
    project = F.coalesce(*[F.when(F.col(f"`{kind}`"), F.lit(kind)) for kind, _ in words], F.lit(OTHER_PROJECT))
    return found.select(key, project.alias("project"))


def hook_droppers(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, hook, script, severity): install hooks whose script is in the repository and downloads code or has suspicious imports.

    files: path, content; findings: path, category and, if there, values (what was matched): words of RUN_WORDS in them count as well. The manifest
    that declares the hook carries the finding.
    """
    j = files.filter(F.lower("path").endswith("package.json")).select("path", F.from_json("content", "struct<scripts: map<string, string>>").alias("j"))
    h = j.select("path", F.explode("j.scripts").alias("hook", "command")).filter(F.col("hook").isin("preinstall", "postinstall", "preuninstall"))
    script = F.element_at(F.split(F.trim("command"), r"\s+"), -1)
    calls = h.select(F.concat_ws("\u0001", "path", "hook").alias("hook"), script.alias("target")).filter(paths.ends_with_any(F.col("target"), HOOK_SCRIPTS))
    found = graph.hook_targets(calls, files)
    downloads = F.lit(False)
    for word in DOWNLOAD_WORDS:
        downloads = downloads | F.col("content").contains(word)
    runs = F.col("category") == "import:suspicious"
    if "values" in findings.columns:
        runs = runs | F.exists("values", lambda v: v.contains(RUN_WORDS[0]) | v.contains(RUN_WORDS[1]) | v.contains(RUN_WORDS[2]))
    bad = files.filter(downloads).select("path").unionByName(findings.filter(runs).select("path")).distinct()
    k = found.join(bad, "path")
    return k.select(F.split_part("hook", F.lit("\u0001"), F.lit(1)).alias("path"), F.split_part("hook", F.lit("\u0001"), F.lit(2)).alias("hook"), F.col("path").alias("script"), F.lit("high").alias("severity"))


def lead_findings(leads: DataFrame) -> DataFrame:
    """Leads as findings of their execution file, one each."""
    message = F.concat_ws(" ", "data_file", F.lit("is reachable from"), "exec_file", F.lit("at depth"), F.col("depth").cast("string"))
    return leads.select(F.col("exec_file").alias("path"), F.lit("cross-file-analysis").alias("source"), F.lit("cross_file:data_exec_flow").alias("category"), "severity", message.alias("message"))
