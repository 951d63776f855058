"""Aggregates over findings: verdicts of submissions and repositories, statistics, ranked findings and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.paths import severity_rank
from assayer.operators import patterns as P


#: Buckets of a triage prompt and how many findings each shows.
BUCKETS = (("high", 50), ("behavioral", 20), ("other", 30))


def prefix(category: Column) -> Column:
    return F.substring_index(category, ":", 1)


def severity_counts() -> list[Column]:
    """Aggregates that the ladders need: n_high (high or critical), n_medium, n_vectors, vectors (kinds of attack, sorted), n_findings, coverage_gap."""
    medium = F.col("severity") == "medium"
    vector = F.when(medium & ~prefix(F.col("category")).isin(*P.NON_ATTACK_PREFIXES), prefix(F.col("category")))
    return [
        F.count_if(F.col("severity").isin("high", "critical")).alias("n_high"),
        F.count_if(medium).alias("n_medium"),
        F.size(F.collect_set(vector)).cast("long").alias("n_vectors"),
        F.array_sort(F.collect_set(vector)).alias("vectors"),
        F.count("*").alias("n_findings"),
        F.max(F.when(F.col("category") == "coverage_gap", 1).otherwise(0)).alias("coverage_gap"),
    ]


def is_compound() -> Column:
    """At least three medium findings over three kinds of attack."""
    return (F.col("n_medium") >= 3) & (F.col("n_vectors") >= 3)


def submission_verdicts(findings: DataFrame, roots: DataFrame) -> DataFrame:
    """The ladder for each submission.

    findings: submission, severity, category (of all artifacts); roots: submission, trusted, baseline_id, matched, distance, dynamic_gap
    (of the root artifact; distance 1 where there is no baseline). Submissions without findings have a verdict too. reasons: why the state is what it is;
    summary: what the state means.
    """
    found = findings.groupBy("submission").agg(*severity_counts())
    j = roots.join(found, "submission", "left").fillna(0, ["n_high", "n_medium", "n_vectors", "n_findings", "coverage_gap"])
    gap = F.col("coverage_gap") == 1
    quiet = (F.col("n_high") == 0) & (F.col("n_medium") == 0)
    first = (
        F.when((F.col("n_high") > 0) | is_compound(), "malicious")
        .when((F.col("n_medium") > 0) | (F.col("distance") >= 0.2), "suspicious")
        .otherwise("inconclusive")
    )
    cleared = F.col("trusted") & F.col("matched") & ~gap
    j = j.withColumn("state", first)
    j = j.withColumn("state", F.when(cleared & (quiet | (F.col("state") == "suspicious")), "clean").otherwise(F.col("state")))
    j = j.withColumn("state", F.when(~F.col("trusted") & F.col("baseline_id").isNull() & quiet, "inconclusive").otherwise(F.col("state")))
    pending = F.array_compact(
        F.array(
            F.when(gap, "decompile"),
            F.when(F.col("dynamic_gap") & (F.col("state") != "malicious"), "detonate"),
            F.when(F.col("baseline_id").isNull(), "register_baseline"),
        )
    )
    # Of the steps that set the state the last one that did is the reason.
    known = cleared & (quiet | ((F.col("n_high") == 0) & ~is_compound()))
    reasons = (
        F.when(~F.col("trusted") & F.col("baseline_id").isNull() & quiet, F.array(F.lit("neither trusted provenance nor a baseline")))
        .when(known, F.array(F.lit("trusted provenance and a matching baseline, nothing left open")))
        .when(F.col("n_high") > 0, F.array(F.concat(F.col("n_high").cast("string"), F.lit(" findings of high severity"))))
        .when(is_compound(), F.array(_chain()))
        .when((F.col("n_medium") > 0) | (F.col("distance") >= 0.2), F.array_compact(F.array(F.when(F.col("n_medium") > 0, _mediums()), F.when(F.col("distance") >= 0.2, "far from every baseline"))))
        .otherwise(F.array().cast("array<string>"))
    )
    j = j.withColumns({"reasons": reasons, "summary": summary(F.col("state"))})
    return j.select("submission", "state", "n_high", "n_medium", "n_vectors", "n_findings", pending.alias("pending"), "reasons", "summary")


SUMMARIES = {
    "clean": "meets the conditions of a clean verdict", "suspicious": "to be looked at before release", "malicious": "malicious with high confidence", "inconclusive": "not cleared by the evidence there is",
}


def summary(state: Column) -> Column:
    """What a state means."""
    return F.coalesce(*[F.when(state == s, F.lit(said)) for s, said in SUMMARIES.items()])


def _mediums() -> Column:
    return F.concat(F.col("n_medium").cast("string"), F.lit(" findings of medium severity"))


def _chain() -> Column:
    """An attack in several steps: how many medium findings, over which kinds."""
    return F.concat(_mediums(), F.lit(" over "), F.col("n_vectors").cast("string"), F.lit(" kinds of attack: "), F.array_join("vectors", ", "))


def repository_verdicts(findings: DataFrame, key: str, every: DataFrame | None = None, binaries: DataFrame | None = None) -> DataFrame:
    """The ladder for each repository: of `every` (key), clean where nothing was found, or else of those with findings or binaries.

    binaries: key, state of each binary in the repository; a malicious one makes it malicious, a suspicious one at least suspicious. reasons: why, all that apply to the state.
    """
    none = ["n_high", "n_medium", "n_vectors", "n_findings", "bad_binaries", "odd_binaries"]
    found = findings.groupBy(key).agg(*severity_counts())
    if binaries is not None:
        of = binaries.groupBy(key).agg(F.count_if(F.col("state") == "malicious").alias("bad_binaries"), F.count_if(F.col("state") == "suspicious").alias("odd_binaries"))
        found = found.join(of, key, "full")
    else:
        found = found.withColumns({"bad_binaries": F.lit(0).cast("long"), "odd_binaries": F.lit(0).cast("long")})
    if every is not None:
        found = every.select(key).distinct().join(found, key, "left")
    found = found.fillna(0, none)
    high, bad, chain = F.col("n_high") > 0, F.col("bad_binaries") > 0, is_compound()
    medium, odd = F.col("n_medium") > 0, F.col("odd_binaries") > 0
    state = F.when(high | bad | chain, "malicious").when(medium | odd, "suspicious").when(F.col("n_findings") > 0, "inconclusive").otherwise("clean")
    count = lambda c, said: F.concat(F.col(c).cast("string"), F.lit(said))
    reasons = (
        F.when(high | bad, F.array(F.when(high, count("n_high", " findings of high severity")), F.when(bad, count("bad_binaries", " malicious binaries"))))
        .when(chain, F.array(_chain()))
        .when(medium | odd, F.array(F.when(medium, _mediums()), F.when(odd, count("odd_binaries", " suspicious binaries"))))
        .when(F.col("n_findings") > 0, F.array(F.lit("only weak findings")))
        .otherwise(F.array(F.lit("nothing found")))
    )
    return found.select(key, state.alias("state"), "n_high", "n_medium", "n_vectors", "n_findings", F.array_compact(reasons).alias("reasons"))


def statistics(files: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Files, files with findings and findings by severity of each repository (files: key, path; findings: key, path, severity)."""
    per_file = findings.groupBy(key, "path").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in P.SEVERITIES])
    j = files.select(key, "path").join(per_file, [key, "path"], "left")
    return j.groupBy(key).agg(
        F.count("*").alias("n_files"),
        F.count("high").alias("n_flagged"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"n_{s}") for s in P.SEVERITIES],
    )


def top_findings(findings: DataFrame, key: str, *order: str, limit: int = 20) -> DataFrame:
    """The `limit` most severe findings of each key; of equal severity the first in `order`."""
    w = Window.partitionBy(key).orderBy(severity_rank(F.col("severity")), *order)
    return findings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def triage_buckets(findings: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, bucket, n, shown): findings of a triage prompt, in three buckets with the first of each in `order`.

    high: high and critical ones; behavioral: others with that word in their category; other: medium ones. The rest is in none.
    """
    severe = F.col("severity").isin("high", "critical")
    bucket = F.when(severe, "high").when(F.col("category").contains("behavioral"), "behavioral").when(F.col("severity") == "medium", "other")
    rows = findings.withColumn("bucket", bucket).filter("bucket IS NOT NULL")
    cap = F.coalesce(*[F.when(F.col("bucket") == name, F.lit(most)) for name, most in BUCKETS])
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order))).filter(F.col("_n") <= cap)
    shown = first.groupBy(key, "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "path", "category"))), lambda x: F.concat_ws(" ", x["path"], x["category"])).alias("shown"))
    return rows.groupBy(key, "bucket").agg(F.count("*").alias("n")).join(shown, [key, "bucket"])


def target_candidates(files: DataFrame, findings: DataFrame, leads: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """(key, path, priority, ordinal) of the files that are worth a closer look, 110 for the triage's to 50 for two findings with a medium one; one row a reason.

    files: key, path, ordinal, roles (array), anomaly_score; findings: key, path, severity, category; leads: key, exec_file; picked: key, path (of
    files that a triage answer names; other paths do not count).
    """
    starts = lambda p: F.max(F.col("category").startswith(p))
    facts = findings.groupBy(key, "path").agg(
        F.max(F.col("severity").isin("high", "critical")).alias("high"), F.max(F.col("severity") == "medium").alias("medium"), F.count("*").alias("n"),
        F.count_if(F.col("category").startswith("unresolved:")).alias("unresolved"), starts("behavioral:").alias("behavioral"), starts("behavioral:credential_access").alias("credential"),
    )
    f = files.join(facts, [key, "path"])
    has = lambda role: F.array_contains("roles", role)
    role = F.when(has("entry_point") & F.col("high"), 90).when(has("entry_point"), 80).when(has("manifest"), 70).when(has("build_file"), 60)
    found = (
        F.when(F.col("unresolved") >= 3, 105)
        .when(F.col("unresolved") > 0, 85)
        .when(F.col("high") & F.col("behavioral"), 85)
        .when(F.col("anomaly_score") >= 0.7, 75)
        .when(F.col("path").contains("/migrations/") & F.col("path").endswith(".py") & F.col("medium"), 65)
        .when(F.col("credential"), 55)
        .when(F.col("medium") & (F.col("n") >= 2), 50)
    )
    place = files.select(key, "path", "ordinal")
    given = lambda rows, path, priority: rows.select(key, F.col(path).alias("path")).distinct().join(place, [key, "path"]).select(key, "path", F.lit(priority).alias("priority"), "ordinal")
    own = f.select(key, "path", F.explode(F.array_compact(F.array(role, found))).alias("priority"), "ordinal")
    return own.unionByName(given(leads, "exec_file", 100)).unionByName(given(picked, "path", 110))


def targets(candidates: DataFrame, key: str) -> DataFrame:
    """One row a path: its highest priority; rank within the key by priority, then by the path's first ordinal.

    candidates: key, path, priority, ordinal.
    """
    best = candidates.groupBy(key, "path").agg(F.max("priority").alias("priority"), F.min("ordinal").alias("ordinal"))
    w = Window.partitionBy(key).orderBy(F.desc("priority"), "ordinal", "path")
    return best.withColumn("rank", F.row_number().over(w))


def capped_targets(ranked: DataFrame, files: DataFrame, key: str, *, most: int = 10) -> DataFrame:
    """All targets of priority 105 and more, and others while fewer than max(most, min(files div 30, 25)) are taken.

    files: key, n_files.
    """
    j = ranked.join(files, key)
    room = F.greatest(F.lit(most), F.least(F.expr("n_files div 30"), F.lit(25)))
    return j.filter((F.col("priority") >= 105) | (F.col("rank") <= room)).drop("n_files")
