"""Evaluation: confusion counts and rates of verdicts against labels, contributions of tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 4))


def confusion(results: DataFrame) -> DataFrame:
    """One row of counts and rates. results: label and verdict, both booleans (bad, flagged); rows with a null verdict do not count."""
    r = results.filter("verdict IS NOT NULL")
    c = r.agg(
        F.count_if(F.col("label") & F.col("verdict")).alias("tp"),
        F.count_if(~F.col("label") & F.col("verdict")).alias("fp"),
        F.count_if(~F.col("label") & ~F.col("verdict")).alias("tn"),
        F.count_if(F.col("label") & ~F.col("verdict")).alias("fn"),
    )
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    c = c.withColumns({"accuracy": _rate(tp + tn, tp + fp + tn + fn), "precision": _rate(tp, tp + fp), "recall": _rate(tp, tp + fn)})
    return c.withColumn("f1", _rate(2 * tp, 2 * tp + fp + fn))


def contributions(findings: DataFrame, flagged: DataFrame, *, most: int = 10) -> DataFrame:
    """The sources with most high or critical findings in flagged submissions (findings: submission, source, severity)."""
    bad = findings.filter(F.col("severity").isin("high", "critical")).join(flagged.select("submission").distinct(), "submission", "left_semi")
    return bad.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(most)


def joined(samples: DataFrame, files: DataFrame, on: list[str]) -> DataFrame:
    """All samples with the status of their file, `missing` where there is none."""
    return samples.join(files, on, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def case_results(cases: DataFrame) -> DataFrame:
    """Cases (case, expected, verdict) with passed: malicious only as such, suspicious as that or worse, clean as clean or inconclusive."""
    v = F.coalesce("verdict", F.lit("missing"))
    passed = (
        F.when(F.col("expected") == "suspicious", v.isin("suspicious", "malicious"))
        .when(F.col("expected") == "clean", v.isin("clean", "inconclusive"))
        .otherwise(v == F.col("expected"))
    )
    return cases.withColumn("passed", passed)


def case_rates(results: DataFrame) -> DataFrame:
    """One row: cases, passed, and the shares of malicious and of clean cases that are called malicious."""
    bad, clean, called = F.col("expected") == "malicious", F.col("expected") == "clean", F.coalesce(F.col("verdict") == "malicious", F.lit(False))
    r = results.agg(
        F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"), F.count_if(bad & called).alias("tp"), F.count_if(bad & ~called).alias("fn"),
        F.count_if(clean & called).alias("fp"), F.count_if(clean & ~called).alias("tn"),
    )
    rates = {"detection_rate": _rate(F.col("tp"), F.col("tp") + F.col("fn")), "false_positive_rate": _rate(F.col("fp"), F.col("fp") + F.col("tn"))}
    return r.withColumns(rates)


def selected(cases: DataFrame, *order: str, kind: str | None = None, most: int | None = None) -> DataFrame:
    """Cases (format, …) of one format, if named, and the first `most` of them in `order`."""
    kept = cases.filter(F.col("format") == kind) if kind else cases
    return kept.orderBy(*order).limit(most) if most else kept


def report(counts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(place, value): lines of a report on a row of `confusion` and on verdicts (verdict), in order of place."""
    share = lambda name, c: F.format_string(f"- **{name}**: %.2f%%", F.col(c) * 100)
    cells = F.array(
        F.lit("# Evaluation"), share("Accuracy", "accuracy"), share("Precision", "precision"), share("Recall", "recall"), share("F1 Score", "f1"),
        F.format_string("Actual MAL %5d %5d", "tp", "fn"), F.format_string("Actual BEN %5d %5d", "fp", "tn"), F.lit("## Verdicts"),
    )
    head = counts.select(F.posexplode(cells).alias("place", "value")).select(F.col("place").cast("long"), "value")
    each = verdicts.groupBy("verdict").agg(F.count("*").alias("n")).select((F.lit(100).cast("long") + F.dense_rank().over(Window.orderBy("verdict"))).alias("place"), F.format_string("- %s: %d", "verdict", "n").alias("value"))
    return head.unionByName(each)


def markdown(rows: DataFrame) -> DataFrame:
    """Each row of a small report as a line of a markdown table (value)."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns]), F.lit(" |")).alias("value"))
