"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, in DataFrame functions only.

Words and word pairs of every document are hashed into a fixed number of buckets. Two multinomials over the
buckets are counted: one of all documents, one of all documents marked as trusted. The score of
a document is the mean over its n-grams of log(p_trusted / p_raw); it is kept if it passes the base rules and the
score reaches the threshold. How far scores spread depends on how full the buckets are, so the threshold is read off them: a fifth
of the trusted documents is left out of the fit, and QUANTILE of them, where they pass the base rules, score below the threshold.
The model is one array of `buckets` doubles, so it has the same size for any corpus.

Defined results: a null text is as an empty one: no words, score 0, base_failed (too few words), not kept. Repeated rows are
scored row by row. Without trusted documents the ratio is 0 everywhere, and the base rules alone decide; so they do where none is left out of the fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, held_out, let, quantile, table, text_or_empty

BUCKETS = 1 << 18
#: Up to so many trusted ids go to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Share of unseen good documents that the threshold may cost.
QUANTILE = 0.01
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Low bits of a sort key that hold a window's place; longer texts take the sort by struct.
PLACE_BITS = 24


def _n_repeat_words(windows: Column) -> Column:
    """Words inside three-word windows (their hashes) that occur twice or more; windows are only sorted where some are equal."""
    key = lambda x: F.shiftright(x, PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    equal = lambda a, b: F.coalesce(a == b, F.lit(False))

    def from_keys(keys):
        beside = lambda x, k: equal(key(F.get(keys, k - 1)), key(x)) | equal(key(F.get(keys, k + 1)), key(x))
        return F.sort_array(F.transform(F.filter(keys, beside), place))

    def clash(keys, full):  # different windows with equal short keys: the sort by whole hashes decides instead
        differ = lambda x, k: equal(key(F.get(keys, k - 1)), key(x)) & ~equal(F.get(full, place(x)), F.get(full, place(F.get(keys, k - 1))))
        return F.exists(F.transform(keys, differ), lambda b: b)

    def from_whole(full):
        pairs = F.array_sort(F.transform(full, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        beside = lambda s: F.filter(s, lambda x, k: equal(F.get(s, k - 1)["h"], x["h"]) | equal(F.get(s, k + 1)["h"], x["h"]))
        return F.sort_array(F.transform(let(pairs, beside), lambda x: x["i"]))

    def places(keys, full):
        return F.when((F.size(full) >= 1 << PLACE_BITS) | clash(keys, full), from_whole(full)).otherwise(from_keys(keys))

    def covered(p):
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    packed = lambda full: F.sort_array(F.transform(full, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long"))))
    found = lambda full: let(packed(full), lambda keys: let(places(keys, full), covered))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(windows, found))


def hashed_words(docs: DataFrame) -> DataFrame:
    """`docs` with _words and _hashes (of the words)."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    inner = docs.select(*kept, F.trim(text_or_empty(), F.lit(" \t\n\x0b\f\r")).alias("_inner"))
    words = F.when(F.col("_inner") == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split("_inner", SPACES))
    split = inner.withColumn("_words", words).drop("_inner")
    return split.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _pair(h: Column, after: Column) -> Column:
    """Hash of a word and the next one; after the last word comes none."""
    return F.xxhash64(h, F.coalesce(after, F.lit(0).cast("long")))


def base_rules(words: DataFrame) -> DataFrame:
    """The counts of the base rules beside what `hashed_words` gives; of its columns _hashes stays."""
    triples = lambda hs: F.transform(
        F.slice(hs, 1, F.greatest(F.size(hs) - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hs, i + 1), F.get(hs, i + 2))
    )
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text_or_empty(), F.lit(r"[#*$%&|<>]")).cast("long"),
            "_lines": lines,
            "_windows": let(F.col("_hashes"), triples),
        }
    ).drop("_words")
    counted = counted.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    counted = counted.withColumn("n_repeat_words", _n_repeat_words(F.col("_windows"))).drop("_windows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled as good, each once."""
    return cut(labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct())


def _marked(docs: DataFrame, ids: DataFrame, among: Column | None = None) -> DataFrame:
    """`docs` with _trusted, 1 for those in `ids`, else 0. Only rows `among` (all, if none is given) can be; beyond BROADCAST_IDS only they are shuffled."""
    flags = ids.withColumn("_trusted", F.lit(1))
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(flags), "doc_id", "left").fillna(0, ["_trusted"])
    can = F.col("doc_id").isNotNull() & (F.lit(True) if among is None else F.coalesce(among, F.lit(False)))
    joined = docs.filter(can).join(flags.hint("shuffle_hash"), "doc_id", "left").fillna(0, ["_trusted"])
    return joined.unionByName(docs.filter(~can).withColumn("_trusted", F.lit(0)))


def fit(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, among: Column | None = None) -> DataFrame:
    """One row, one column `weights`: log(p_trusted / p_raw) of each bucket.

    The raw multinomial counts all documents; the one of `trusted` (doc_id; all of them rows `among`) is smoothed towards it with one pseudo-count a bucket.
    """
    marked = _marked(docs.select("doc_id", "text"), trusted, among)
    pairs = F.arrays_zip(F.col("_hashes").alias("h"), F.slice("_hashes", 2, F.greatest(F.size("_hashes"), F.lit(1))).alias("after"))
    rows = hashed_words(marked).select(F.col("_trusted").alias("t"), F.explode(pairs).alias("x"))
    grams = rows.select("t", F.explode(F.array(_bucket(F.col("x.h"), buckets), _bucket(_pair(F.col("x.h"), F.col("x.after")), buckets))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("trusted"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "trusted"])
    # One task holds `buckets` rows, whatever the corpus.
    packed = every.agg(
        F.sum("raw").alias("all_raw"), F.sum("trusted").alias("all_trusted"), F.array_sort(F.collect_list(F.struct("bucket", "raw", "trusted"))).alias("cells")
    )
    p_raw = lambda c: (c["raw"] + 1) / (F.col("all_raw") + buckets)
    ratio = lambda c: (c["trusted"] / p_raw(c) + buckets) / (F.col("all_trusted") + buckets)
    return packed.select(F.transform("cells", lambda c: F.log(ratio(c))).alias("weights"))


def _scored(docs: DataFrame, weights: DataFrame, buckets: int) -> DataFrame:
    """Every row of `docs` with the base counts, base_failed and llr."""
    scored = base_rules(hashed_words(docs)).withColumn("_weights", weights.scalar())

    def of_words(hs, ws):
        both = lambda h, i: F.get(ws, _bucket(h, buckets)) + F.get(ws, _bucket(_pair(h, F.get(hs, i + 1)), buckets))
        return F.aggregate(F.transform(hs, both), F.lit(0.0), lambda a, x: a + x)

    total = let(F.col("_weights"), lambda ws: let(F.col("_hashes"), lambda hs: of_words(hs, ws)))
    llr = F.when(F.size("_hashes") == 0, F.lit(0.0)).otherwise(total / (2 * F.size("_hashes")))
    return scored.withColumn("llr", llr).drop("_hashes", "_weights")


def score(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """Every row of `docs` with the base counts, base_failed, llr (mean log ratio) and kept; by default the threshold is QUANTILE of unseen good ones."""
    trusted = trusted_ids(labels)
    if threshold is not None:
        scored = _scored(docs, fit(docs, trusted, buckets=buckets), buckets)
        return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    weights = cut(fit(docs, trusted.filter(~held_out()), buckets=buckets, among=~held_out()))
    unseen = _marked(docs.select("doc_id", "text").filter(held_out()), trusted.filter(held_out())).filter("_trusted = 1")
    least = quantile(_scored(unseen, weights, buckets).select(F.when(~F.col("base_failed"), F.col("llr")).alias("value")), QUANTILE)
    enough = F.coalesce(F.col("llr") >= least.scalar(), F.lit(True))
    return _scored(docs, weights, buckets).withColumn("kept", ~F.col("base_failed") & enough)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that pass, with their own columns."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("_row"))  # so that no column of `docs` clashes with a count
    return score(packed, labels, **options).filter("kept").select("_row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")
