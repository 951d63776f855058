"""Findings of binary artifacts: file facts, packers, needles, capabilities, scores, and functions worth a look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import arrays, binary
from assayer.operators import rulefile, rules
from assayer.sources.archive import BUNDLE_MAGIC

HIGH_ENTROPY = 7.2
NEEDLE_LIMIT = 8


def observations(files: DataFrame, *, rule_text: str | None = None) -> DataFrame:
    """(path, source, category, severity, message) of files (path, content binary); empty files have none.

    One projection measures a file, one array of findings is exploded. rule_text: rules of files (see rulefile) instead of the bundled ones.
    """
    c = F.col("content")
    f = files.select("path", "content").filter(F.length("content") > 0)
    # Both functions over bytes are evaluated in one pass of Python.
    m = f.select("path", "content", binary.byte_entropy(c).alias("entropy"), binary.score_components(c).alias("parts"))
    # Capabilities look at the printable runs that an artifact keeps.
    m = m.select(
        "path", F.length(c).alias("size"), binary.file_format(F.col("path"), c).alias("format"), F.round("entropy", 4).alias("entropy"), binary.heuristic_score(F.col("parts"), c).alias("score"),
        binary.latin(c).alias("text"), F.array_join(binary.printable_runs(c), "\n").alias("strings"),
    )
    text = F.col("text")
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    made = lambda source, category, severity, message: F.struct(*[column(x).alias(n) for n, x in (("source", source), ("category", category), ("severity", severity), ("message", message))])
    ruled = [] if rule_text is not None else rules.rule_cells(text)
    held = lambda cells, make: [arrays.let(x, lambda v: F.when(v.isNotNull(), make(v))) for x in cells]
    severity = binary.score_severity(F.col("score"))
    cells = [
        made("ingest", "file", "info", F.concat_ws(" ", "format", F.col("size").cast("string"))),
        made("ingest", "entropy", F.when(F.col("entropy") >= HIGH_ENTROPY, "medium").otherwise("info"), F.col("entropy").cast("string")),
        F.when(text.contains(BUNDLE_MAGIC.decode("latin-1")), made("ingest", "packer:pyinstaller", "medium", "self-extracting bundle")),
        *held(ruled, lambda v: made("yara", F.concat(F.lit("rule:"), v["rule"]), v["severity"], v["category"])),
        *held(rules.capability_cells(F.col("strings")), lambda v: made("capa", F.concat(F.lit("capability:"), v["capability"]), v["severity"], v["capability"])),
        F.when(severity.isNotNull(), made("ember", "ml:classification", severity, F.round("score", 4).cast("string"))),
    ]
    out = m.select("path", F.explode_outer(F.array_compact(F.array(*cells))).alias("o")).select("path", "o.*")
    if rule_text is None:
        return out
    found = rulefile.matches(f, rule_text)
    return out.unionByName(found.select("path", F.lit("yara").alias("source"), "category", "severity", "message"))


def heuristic_functions(files: DataFrame, *, limit: int = NEEDLE_LIMIT) -> DataFrame:
    """(path, ordinal, at, needle, category, start, end, triage_score, region_hash): the first needles of each file, by offset.

    The region hash is over the first 64 bytes of the window around the needle.
    """
    c = F.col("content")
    found = F.transform(rules.needle_list(binary.latin(c)), lambda x: F.struct(x["at"].alias("at"), x["needle"].alias("needle"), x["category"].alias("category")))
    rows = files.select("path", "content", F.slice(F.array_sort(found), 1, limit).alias("m"))
    hashed = lambda x: x.withField("region_hash", F.sha2(F.substring(c, F.greatest(x["at"] - 0x80, F.lit(0)) + 1, F.lit(64)), 256))
    first = rows.select("path", F.posexplode_outer(F.transform("m", hashed)).alias("ordinal", "m")).filter("m IS NOT NULL").select("path", "ordinal", "m.*")
    around = binary.region(F.col("at"))
    score = F.greatest(F.lit(0.1), 0.9 - 0.05 * F.col("ordinal"))
    return first.select("path", "ordinal", "at", "needle", "category", around["start"].alias("start"), around["end"].alias("end"), score.alias("triage_score"), "region_hash")


def baseline_rows(files: DataFrame, product: str, signer: str | None = None) -> DataFrame:
    """What a trusted upload is kept as: artifact, product, signer, format, chunk and function hashes."""
    kept = files.select("path", F.sha2("content", 256).alias("artifact"), binary.file_format(F.col("path"), F.col("content")).alias("format"), binary.chunk_hash_list(F.col("content")).alias("chunk_hashes"))
    hashes = heuristic_functions(files).groupBy("path").agg(F.array_sort(F.collect_set("region_hash")).alias("function_hashes"))
    j = kept.join(hashes, "path", "left").withColumn("function_hashes", F.coalesce("function_hashes", F.array().cast("array<string>")))
    return j.withColumns({"product": F.lit(product), "signer": F.lit(signer).cast("string")})


def trusted(provenance: DataFrame) -> DataFrame:
    """Provenance rows (authenticode boolean, sigstore and in_toto strings, null for unknown) with `trusted`: any of them is there."""
    there = F.coalesce(F.col("authenticode"), F.lit(False))
    for name in ("sigstore", "in_toto"):
        there = there | (F.coalesce(F.col(name), F.lit("")) != "")
    return provenance.withColumn("trusted", there)


def placeholder_events(artifacts: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """(artifact, source, kind, summary): an event for each dynamic tool that is not run here, so that its absence shows."""
    rows = artifacts.select("artifact", F.explode(F.array(*map(F.lit, tools))).alias("source"))
    return rows.select("artifact", "source", F.lit("unavailable").alias("kind"), F.concat(F.lit("No dynamic analysis by "), "source").alias("summary"))


def unavailable(artifacts: DataFrame, tools: dict[str, bool]) -> DataFrame:
    """(artifact, tool, status, enabled): a row for each outside tool that is not run here."""
    cells = [F.struct(F.lit(t).alias("tool"), F.lit("unavailable" if on else "skipped").alias("status"), F.lit(on).alias("enabled")) for t, on in sorted(tools.items())]
    return artifacts.select("artifact", F.explode(F.array(*cells)).alias("t")).select("artifact", "t.*")


