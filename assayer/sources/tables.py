"""Table layouts, and how stored state is read and kept: JSON documents of records, Parquet tables by key, task payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each table, as DDL.
LAYOUTS = {
    "artifacts": "sha256 string, sha1 string, md5 string, filename string, size long, format string, kind string, parent_sha256 string, strings array<string>, chunk_hashes array<string>, entropy double, metadata map<string, string>",
    "observations": "submission string, path string, ordinal int, source string, category string, severity string, message string, evidence map<string, string>, addresses array<string>, tags array<string>, created_at timestamp",
    "functions": "artifact string, ordinal int, symbol string, start string, end string, triage_score double, normalized_hash string, decompiled boolean, code string",
    "behavior_events": "artifact string, source string, kind string, ts timestamp, summary string, details map<string, string>",
    "tool_runs": "artifact string, tool string, status string, summary string, enabled boolean",
    "baselines": "id string, ordinal long, product string, version string, signer string, sha256 string, format string, chunk_hashes array<string>, function_hashes array<string>",
    "submissions": "id string, status string, root_sha256 string, artifact_shas array<string>, claimed_product string, claimed_signer string",
    "verdicts": "sha256 string, state string, summary string, reasons array<string>, pending_actions array<string>",
    "api_keys": "id string, key_hash string, name string, scopes array<string>, rate_limit int, revoked_at timestamp",
}
KEYS = {"artifacts": ["sha256"], "baselines": ["id"], "submissions": ["id"], "verdicts": ["sha256"], "api_keys": ["id"]}


def create(spark: SparkSession, database: str = "default") -> None:
    """Creates the tables that do not exist yet."""
    for name, columns in LAYOUTS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def drop(spark: SparkSession, database: str = "default") -> None:
    for name in LAYOUTS:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """Rows with one key; the comparison reaches the source."""
    return rows.filter(F.col(key) == F.lit(value))


def read_state(spark: SparkSession, path: str, section: str, layout: str) -> DataFrame:
    """The records of one section of JSON documents that map ids to records: id and the columns of `layout`."""
    parsed = spark.read.schema(f"`{section}` map<string, struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in _columns(layout))}>>").option("multiLine", "true").json(path)
    return parsed.select(F.explode(F.col(f"`{section}`")).alias("_id", "_r")).select(F.col("_id").alias("record_id"), "_r.*")


def _columns(layout: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(layout):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(layout[last:i])
            last = i + 1
    return [*out, layout[last:]]


def write_state(rows: DataFrame, key: str, section: str, path: str) -> None:
    """Records as JSON lines, each a document with one record of the section under its key; `read_state` reads them back."""
    record = F.create_map(F.col(key).cast("string"), F.struct(*[c for c in rows.columns]))
    rows.select(F.to_json(F.struct(record.alias(section))).alias("value")).write.mode("overwrite").text(path)


def payload(task: Column) -> Column:
    """Bytes of a queued task, which come as hexadecimal digits; null where they are not."""
    return F.when(task.rlike(r"^(?:[0-9a-fA-F]{2})*$"), F.unhex(task))


def write_rules(rules: DataFrame, path: str) -> None:
    """Generated rules (sha256, text), a folder for each artifact they came from."""
    rules.select("sha256", F.col("text").alias("value")).write.mode("overwrite").partitionBy("sha256").text(path)
