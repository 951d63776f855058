"""First matches and running budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_match(rows: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Rows whose column contains one of `names`, with the first of them, in the order given, as `match`."""
    found = F.coalesce(*[F.when(F.col(column).contains(n), F.lit(n)) for n in names])
    return rows.withColumn("match", found).filter("match IS NOT NULL")


def budgeted(rows: DataFrame, key: str, *order: str, budget: int) -> DataFrame:
    """Running sum of `tokens` within a key as `used`, and whether it is within the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("tokens").over(w)).withColumn("within", F.col("used") <= budget)


def top_functions(functions: DataFrame, key: str, *, limit: int, least: float = 0.0) -> DataFrame:
    """The functions with the highest triage score of each key; of equal scores the first by ordinal."""
    w = Window.partitionBy(key).orderBy(F.desc("triage_score"), "ordinal")
    return functions.filter(F.col("triage_score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def grouped(rows: DataFrame, key: str, group: str, message: str, *order: str, cap: int = 10) -> DataFrame:
    """(key, group, messages, overflow): the first `cap` messages of each group of a key, in order, and how many more there are."""
    w = Window.partitionBy(key, group).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    shown = first.groupBy(key, group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(message).alias("m")))), lambda x: x["m"]).alias("messages"))
    counts = rows.groupBy(key, group).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("overflow"))
    return shown.join(counts, [key, group])


def triage_mode(findings: DataFrame, key: str, *, more_than: int = 20) -> DataFrame:
    """(key, n, triage): whether a repository has so many findings that they are triaged before a closer look."""
    return findings.groupBy(key).agg(F.count("*").alias("n")).withColumn("triage", F.col("n") > more_than)
