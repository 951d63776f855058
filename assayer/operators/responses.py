"""Recorded answers of a language model as findings; prompts as text. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "struct<verdict: string, confidence: double, summary: string, findings: array<struct<severity: string, category: string, message: string>>, iocs: array<string>>"
CONFIRMED, REVIEWED = 0.7, 0.85
#: Severities that an answer may give to a finding.
GIVEN = ("medium", "high", "critical")


def fenced(text: Column) -> Column:
    """The JSON block of an answer; empty where there is none."""
    return F.regexp_extract(text, r"(?s)```json\s*\n(.*?)\n\s*```", 1)


def parsed(answers: DataFrame) -> DataFrame:
    """answers (key, text, …) with a (ANSWER) and confidence (0.5 where the answer has none); a is null where an answer holds no JSON."""
    block = fenced(F.col("text"))
    a = F.when(F.try_parse_json(F.nullif(block, F.lit(""))).isNotNull(), F.from_json(block, ANSWER))
    return answers.withColumn("a", a).withColumn("confidence", F.coalesce("a.confidence", F.lit(0.5)))


def _rows(p: DataFrame, source: str, category: Column, severity: Column, message: Column) -> DataFrame:
    return p.select("key", F.lit(source).alias("source"), category.alias("category"), severity.alias("severity"), message.alias("message"), (F.col("confidence") < CONFIRMED).alias("advisory"))


def findings(answers: DataFrame) -> DataFrame:
    """(key, source, category, severity, message, advisory) of answers (key, text) about files.

    A malicious verdict is high from the confidence CONFIRMED and none below; a benign one is info. Findings keep their severity, others
    than GIVEN count as medium; below that confidence they are advisory.
    """
    p = parsed(answers).filter("a IS NOT NULL")
    said = F.coalesce("a.verdict", F.lit("suspicious"))
    bad = p.filter((said == "malicious") & (F.col("confidence") >= CONFIRMED))
    out = _rows(bad, "llm-analysis", F.lit("llm:malicious_confirmed"), F.lit("high"), F.col("a.summary"))
    out = out.unionByName(_rows(p.filter(said == "benign"), "llm-analysis", F.lit("llm:benign_confirmed"), F.lit("info"), F.col("a.summary")))
    each = p.select("key", "confidence", F.explode("a.findings").alias("f"))
    level = F.when(F.col("f.severity").isin(*GIVEN), F.col("f.severity")).otherwise("medium")
    return out.unionByName(_rows(each, "llm-analysis", F.coalesce("f.category", F.lit("llm:finding")), level, F.coalesce("f.message", F.lit("LLM finding"))))


def function_findings(answers: DataFrame) -> DataFrame:
    """The same for answers (key, text, triage_score) about functions.

    Malicious below CONFIRMED and suspicious are medium; benign is info, but medium for a function whose triage score reaches REVIEWED.
    Findings of another severity than GIVEN are left out.
    """
    p = parsed(answers).filter("a IS NOT NULL")
    said, sure = F.coalesce("a.verdict", F.lit("suspicious")), F.col("confidence") >= CONFIRMED
    doubted = (said == "malicious") & ~sure | (said == "suspicious") | (said == "benign") & (F.col("triage_score") >= REVIEWED)
    category = F.when((said == "malicious") & sure, "llm:function_malicious").when(doubted, "llm:function_suspicious").when(said == "benign", "llm:function_benign")
    level = F.when((said == "malicious") & sure, "high").when(doubted, "medium").otherwise("info")
    out = _rows(p.withColumn("_c", category).filter("_c IS NOT NULL"), "llm-function", category, level, F.col("a.summary"))
    each = p.select("key", "confidence", F.explode("a.findings").alias("f")).withColumn("_s", F.coalesce("f.severity", F.lit("medium"))).filter(F.col("_s").isin(*GIVEN))
    return out.unionByName(_rows(each, "llm-function", F.concat(F.lit("llm:"), F.coalesce("f.category", F.lit("finding"))), F.col("_s"), F.coalesce("f.message", F.lit("LLM finding"))))


def overridden(verdicts: DataFrame, answers: DataFrame) -> DataFrame:
    """Verdicts (key, state) with the state of a usable answer in place of the rules'."""
    p = parsed(answers).select("key", F.lower("a.verdict").alias("said")).filter(F.col("said").isin("clean", "suspicious", "malicious", "inconclusive"))
    return verdicts.join(p, "key", "left").withColumn("state", F.coalesce("said", "state")).drop("said")


def prompts(files: DataFrame, *, most_chars: int = 50_000, most_findings: int = 15) -> DataFrame:
    """(path, prompt, prompt_key) of files (path, content, findings as array of strings)."""
    text = F.concat_ws("\n", F.concat(F.lit("File: "), "path"), F.array_join(F.slice("findings", 1, most_findings), "\n"), F.left("content", F.lit(most_chars)))
    return files.select("path", text.alias("prompt")).withColumn("prompt_key", F.sha2("prompt", 256))


def within_budget(answers: DataFrame, key: str, *, budget: int) -> DataFrame:
    """Recorded answers (key, ordinal, in_tokens, out_tokens) that a budget of tokens allows, in order."""
    from assayer.operators.rank import budgeted

    used = answers.withColumn("tokens", F.col("in_tokens") + F.col("out_tokens"))
    return budgeted(used, key, "ordinal", budget=budget).filter(F.col("used") - F.col("tokens") < budget)


def rule_texts(answers: DataFrame) -> DataFrame:
    """(key, rule, text) of the scan rules that answers (key, text) hold: those with strings, a condition and balanced braces."""
    found = F.regexp_extract_all("text", F.lit(r"(?s)(rule\s+\w+[^{]*\{.*?\n\})"), 1)
    rows = answers.select("key", F.explode(found).alias("text"))
    whole = F.regexp_count("text", F.lit(r"\{")) == F.regexp_count("text", F.lit(r"\}"))
    kept = rows.filter(F.col("text").contains("condition:") & F.col("text").contains("strings:") & whole)
    return kept.select("key", F.regexp_extract("text", r"rule\s+(\w+)", 1).alias("rule"), "text")
