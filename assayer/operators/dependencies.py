"""Risks in package manifests: names that resemble popular packages, and lifecycle hooks that run interpreters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators import patterns as P

HOOKS = ("preinstall", "postinstall", "preuninstall", "postuninstall")


def resembles(name: str, popular: tuple[str, ...]) -> str | None:
    """The first popular name whose similarity (share of matching blocks) is over 0.75 but not whole; None if an equal one comes first."""
    from difflib import SequenceMatcher

    for known in popular:
        if name == known:
            return None
        # Lengths alone bound the similarity from above.
        if 2 * min(len(name), len(known)) / (len(name) + len(known) or 1) > 0.75 and 0.75 < SequenceMatcher(None, name.lower(), known.lower()).ratio() < 1.0:
            return known
    return None


def _may_resemble(name, known: str):
    """An upper bound of the similarity reaches 0.75, by lengths, by letters that occur in the known name, by how often they do: the cheapest first, and never false where the similarity does."""
    low, letters = F.lower(name), sorted(set(known))
    enough = lambda shared: 2 * shared > 0.75 * (F.length(low) + len(known))
    counted = sum(F.least(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))), F.lit(known.count(c))) for c in letters)
    return enough(F.least(F.length(low), F.lit(len(known)))) & enough(F.length(low) - F.length(F.translate(low, "".join(letters), ""))) & enough(counted)


def typosquats(names: DataFrame, popular: tuple[str, ...]) -> DataFrame:
    """Rows of `names` (name, …) with the popular package that the name resembles."""

    @F.pandas_udf(T.StringType())
    def similar(s: pd.Series) -> pd.Series:
        return s.map(lambda n: resembles(n, popular) if n else None)

    near = F.lit(False)
    for known in popular:
        near = near | _may_resemble(F.col("name"), known)
    return names.filter(near).withColumn("resembles", similar("name")).filter("resembles IS NOT NULL")


def _grams(low):
    """Different pairs of neighbouring letters; of short names different letters too."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2)))
    pairs = F.when(F.length(low) >= 2, pairs).otherwise(F.array().cast("array<string>"))
    letters = F.when(F.length(low) <= 6, F.split(low, "")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(pairs, letters))


def _shared_letters(a, b):
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))


def lookalikes(names: DataFrame, popular: DataFrame) -> DataFrame:
    """(ecosystem, name, resembles) of the names that resemble a popular one of their ecosystem, by the rule of `resembles`: the first by rank counts, and an equal one before it clears.

    names: ecosystem, name; popular: ecosystem, known, rank. Each as large as it likes: candidates come from an equi-join, none is lost. A similarity over 0.75 needs M
    matching letters of L together, M > 0.375 * L, in at most L - 2 * M + 1 blocks, so at least 3 * M - L - 1 > L / 8 - 1 common pairs of neighbours: one, where L is 8 or more;
    shorter ones share a letter. Lengths (in the join's key) and letters in common bound it further; only what is left is compared. Nulls and empty names resemble nothing.
    """

    @F.pandas_udf(T.BooleanType())
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([0.75 < SequenceMatcher(None, x, y).ratio() < 1.0 for x, y in zip(a, b, strict=True)], dtype=bool)

    n = names.filter("name <> ''").select("ecosystem", "name").distinct().withColumn("low", F.lower("name")).withColumn("size", F.length("low"))
    p = popular.filter("known <> ''").groupBy("ecosystem", "known").agg(F.min("rank").alias("rank")).withColumn("known_low", F.lower("known"))
    index = p.select("ecosystem", "known", "known_low", "rank", F.length("known_low").alias("other"), F.explode(_grams(F.col("known_low"))).alias("gram"))
    # Lengths with 2 * min > 0.75 * (sum): over 3/5 and under 5/3 of the name's.
    lengths = F.sequence((3 * F.col("size") / 5).cast("int") + 1, F.ceil(5 * F.col("size") / 3).cast("int") - 1)
    asked = n.withColumn("gram", F.explode(_grams(F.col("low")))).withColumn("other", F.explode(F.when(F.col("size") > 1, lengths).otherwise(F.array("size"))))
    met = asked.join(index, ["ecosystem", "gram", "other"]).filter((F.length("gram") == 2) | (F.col("size") + F.col("other") < 8))
    pairs = met.select("ecosystem", "name", "low", "known", "known_low", "rank").distinct()
    pairs = pairs.filter(2 * _shared_letters(F.col("low"), F.col("known_low")) > 0.75 * (F.length("low") + F.length("known_low")))
    found = pairs.filter(near("low", "known_low")).groupBy("ecosystem", "name").agg(F.min(F.struct("rank", "known")).alias("first"))
    equal = p.select("ecosystem", F.col("known").alias("name"), F.col("rank").alias("own"))
    clear = found.join(equal, ["ecosystem", "name"], "left").filter("own IS NULL OR own > first.rank")
    return clear.select("ecosystem", "name", F.col("first.known").alias("resembles"))


def manifest_names(files: DataFrame) -> DataFrame:
    """(path, name, ecosystem) from package.json and requirements.txt files (path, content); malformed manifests have none."""
    low = F.lower("path")
    parsed = F.from_json("content", "struct<dependencies: map<string, string>, devDependencies: map<string, string>>")
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    node = files.filter(low.endswith("package.json")).select("path", parsed.alias("j"))
    node = node.select("path", F.explode(F.concat(keys(F.col("j.dependencies")), keys(F.col("j.devDependencies")))).alias("name"), F.lit("node").alias("ecosystem"))
    lines = files.filter(low.endswith("requirements.txt")).select("path", F.explode(F.split("content", r"\r\n|\r|\n")).alias("line"))
    python = lines.select("path", F.trim(F.get(F.split(F.trim("line"), r"[>=<!\[]"), F.lit(0))).alias("name"), F.lit("python").alias("ecosystem"))
    return node.unionByName(python.filter("name <> '' AND NOT startswith(name, '#')"))


def hooks(files: DataFrame) -> DataFrame:
    """(path, hook, command) of package.json lifecycle scripts that call an interpreter or downloader."""
    j = files.filter(F.lower("path").endswith("package.json")).select("path", F.from_json("content", "struct<scripts: map<string, string>>").alias("j"))
    rows = j.select("path", F.explode("j.scripts").alias("hook", "command"))
    return rows.filter(F.col("hook").isin(*HOOKS) & F.col("command").rlike(P.POSTINSTALL_EXEC))
