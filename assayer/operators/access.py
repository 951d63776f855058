"""Access keys as a table: look-up by hash, scopes, and urls without passwords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verified(keys: DataFrame, raw: DataFrame) -> DataFrame:
    """Keys (key_hash, scopes, revoked_at, …) that match a raw key (raw) and are not revoked; joined on the hash."""
    return keys.filter("revoked_at IS NULL").join(raw.select(F.sha2("raw", 256).alias("key_hash")).distinct(), "key_hash")


def issued(requests: DataFrame) -> DataFrame:
    """Rows of the table of keys for requests (raw, name, scopes, rate_limit): the hash is kept, never the key; to be appended. Defaults where scopes or rate are null."""
    key = F.sha2("raw", 256)
    return requests.select(F.substring(F.sha2(F.concat_ws("\u0001", "name", key), 256), 1, 32).alias("id"), key.alias("key_hash"), "name", F.coalesce("scopes", F.array(F.lit("submit"), F.lit("read"))).alias("scopes"), F.coalesce("rate_limit", F.lit(60)).alias("rate_limit"), F.lit(None).cast("timestamp").alias("revoked_at"))


def allowed(scopes: Column, scope: str) -> Column:
    return F.array_contains(scopes, scope)


def redacted_url(url: Column) -> Column:
    """The url with its password replaced."""
    return F.regexp_replace(url, r"(://[^:/@\s]*):[^@/\s]+@", "$1:***@")


def healthy(checks: DataFrame) -> DataFrame:
    """One row: whether every check (name, ok) holds."""
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))
