"""Secret scans in DataFrame functions only: base patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over characters are trained on all documents but one in four, labelled by the base patterns: random
strings (what the patterns mark as secret) against ordinary identifiers (all other tokens). A token of TOKEN_CHARS or
more outside base spans, of letters only or with dots too, becomes a span of kind `random` if its summed log ratio reaches the threshold: what a share LEFT of the ordinary tokens of
that length of the documents left out of the fit stays below, at most half of what their secrets score over TOKEN_CHARS, and LEAST_RATIO at least.
Both models are smoothed towards equal chances, which is what a random string has, so without anything marked
the scan still works.

Spans are code points, end exclusive. Offsets come from one pass: every match is wrapped in U+0001 (which a text's own are
replaced for; no pattern matches either), the text is split there, and lengths are summed.

Defined results: a null text is as an empty one: no spans. Repeated rows are each scanned. Of equal starts the order of KINDS counts. Only
doc_id and text are read. Empty tables give an empty table, and models without counts. A long text is scanned whole, its spans in an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, quantile, running, table, text_or_empty

# The base patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "random")

TOKEN_CHARS = 12
#: The share of ordinary tokens below the threshold, and the least threshold: a token as often random as not in e ** LEAST_RATIO.
LEFT, LEAST_RATIO = 0.9995, 6.0
#: Characters that tokens are made of, for smoothing.
ALPHABET = 67
_TOKEN = r"[A-Za-z0-9+/_=-]"
#: Tokens do not end in dots.
_LONG = f"{_TOKEN}[A-Za-z0-9+/_=.-]{{{TOKEN_CHARS - 2},}}{_TOKEN}"
_WRAP, _FILL = "\u0001", "\u0002"
_SPAN = "array<struct<start: int, kind: int, end: int>>"


def _parts(text: Column, pattern: str) -> Column:
    """The text split at its matches: every second element is a match."""
    return F.split(F.regexp_replace(text, pattern, f"{_WRAP}$0{_WRAP}"), _WRAP)


def _spans(parts: Column, kind: int, valid) -> Column:
    """Spans of the valid matches; offsets are sums over runs of parts, so that many matches do not cost their square."""

    def found(ps):
        ends = running(F.transform(ps, lambda p: F.length(p)))
        cells = lambda es: F.transform(ps, lambda p, i: F.when((i % 2 == 1) & valid(p), F.struct((F.get(es, i) - F.length(p)).alias("start"), F.lit(kind).alias("kind"), F.get(es, i).alias("end"))))
        return F.filter(let(ends, cells), lambda x: x.isNotNull())

    return let(parts, found)


def _assigned(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_CHARS


_BASE = ((ASSIGN, _assigned), (ACCESS, lambda m: F.lit(True)), (HEX, lambda m: F.lit(True)))


def _guards(text: Column, low: Column) -> list[Column]:
    """Plain searches, in a text and in lower case, for what every match of each base pattern holds; of the third nothing shorter is in each."""
    return [low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api"), text.contains("AKIA"), F.lit(True)]


def _masked(text: Column) -> Column:
    """The text with base matches filled by a character that no pattern matches, at the same length."""
    for pattern, valid in _BASE:
        text = let(text, _cover(pattern, valid))
    return text


def _cover(pattern: str, valid):
    def cover(p, i):
        return F.when((i % 2 == 1) & valid(p), F.repeat(F.lit(_FILL), F.length(p))).otherwise(p)

    return lambda t: F.when(t.rlike(pattern), F.array_join(F.transform(_parts(t, pattern), cover), "")).otherwise(t)


def _cell(before: Column, char: Column) -> Column:
    """Place of a pair of characters in a model; before is empty for a token's first."""
    return F.ascii(before) * 128 + F.ascii(char)


def _cells(token: Column) -> Column:
    chars = F.split(token, "")
    return let(chars, lambda c: F.transform(c, lambda x, i: F.when(i == 0, F.ascii(x)).otherwise(_cell(F.get(c, i - 1), x))))


def score(token: Column, weights: Column) -> Column:
    """The summed log ratio of a token."""
    return F.aggregate(_cells(token), F.lit(0.0), lambda a, c: a + F.get(weights, c))


def labelled(docs: DataFrame) -> DataFrame:
    """(secret, left_out, token, n) of all documents: how often each token is found; one document in four is left out of the fit."""
    text = F.translate(text_or_empty(), _WRAP, _FILL)
    out = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    texts = docs.select(text.alias("t"), out.alias("left_out"))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    none = F.expr("CAST(array() AS array<string>)")
    found = [
        F.filter(F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), 0), value), lambda v: F.length(v) >= ASSIGN_CHARS),
        F.regexp_extract_all("t", F.lit(ACCESS), 0),
        F.regexp_extract_all("t", F.lit(HEX), 0),
    ]
    low = F.lower("t")
    hits = [F.when(g & F.col("t").rlike(p), x).otherwise(none) for x, (p, _), g in zip(found, _BASE, _guards(F.col("t"), low), strict=True)]
    # Words of three characters and more teach; tokens with dots do so too, as they are scored.
    plain = lambda m: F.regexp_extract_all(m, F.lit(f"{_LONG}|{_TOKEN}{{3,}}"), 0)
    kinds = lambda secret: F.array(
        F.struct(F.lit(1).alias("secret"), secret.alias("tokens")),
        F.struct(F.lit(0).alias("secret"), plain(F.when(F.size(secret) == 0, F.col("t")).otherwise(_masked(F.col("t")))).alias("tokens")),
    )
    return (
        texts.select("left_out", F.explode(let(F.concat(*hits), kinds)).alias("x"))
        .select("x.secret", "left_out", F.explode("x.tokens").alias("token"))
        .groupBy("secret", "left_out", "token")
        .agg(F.count("*").alias("n"))
    )


def fit(docs: DataFrame) -> DataFrame:
    """One row: weights, the log of the ratio of both models for each pair of characters, and threshold."""
    tokens = labelled(docs)
    pairs = tokens.filter("NOT left_out").select("secret", "n", F.explode(_cells(F.col("token"))).alias("cell")).groupBy("cell").agg(F.sum(F.col("secret") * F.col("n")).alias("r"), F.sum((1 - F.col("secret")) * F.col("n")).alias("o"))
    every = docs.sparkSession.range(128 * 128).select(F.col("id").cast("int").alias("cell")).join(pairs, "cell", "left").fillna(0, ["r", "o"])
    totals = every.groupBy(F.expr("cell div 128").alias("before")).agg(F.sum("r").alias("all_r"), F.sum("o").alias("all_o"))
    ratio = F.log((F.col("r") + 1) / (F.col("all_r") + ALPHABET)) - F.log((F.col("o") + 1) / (F.col("all_o") + ALPHABET))
    weighted = every.withColumn("before", F.expr("cell div 128")).join(F.broadcast(totals), "before").select("cell", ratio.alias("w"))
    # One task holds the 16,384 cells, whatever the corpus.
    model = cut(weighted.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "w"))), lambda x: x["w"]).alias("weights")))
    left = tokens.filter(F.col("left_out") & ((F.col("secret") == 1) | F.col("token").rlike(f"^{_LONG}$"))).select("secret", "token", "n", model.scalar().alias("w"))
    left = cut(left.select("secret", "n", F.length("token").alias("size"), score(F.col("token"), F.col("w")).alias("value")))
    ordinary = quantile(left.filter("secret = 0").select("value", "n"), LEFT).scalar()
    # Keys among the ordinary tokens must not raise it beyond what a short key reaches.
    most = F.sum(F.col("n") * F.col("value") / F.col("size")) / F.sum("n") * TOKEN_CHARS / 2
    bound = left.filter("secret = 1").agg(F.coalesce(most, F.lit(0.0)).alias("most"))
    bound = bound.select(F.greatest(F.least(F.coalesce(ordinary, F.lit(0.0)), F.col("most")), F.lit(LEAST_RATIO)).alias("threshold"))
    return cut(bound.select(model.scalar().alias("weights"), "threshold"))


def scan(docs: DataFrame, *, threshold: float | None = None) -> DataFrame:
    """doc_id and spans (start, kind, end; kind names a place in KINDS) of every row, by start, then kind."""
    model = fit(docs)
    bound = model.select("threshold").scalar() if threshold is None else F.lit(threshold)
    text = docs.select("doc_id", F.translate(text_or_empty(), _WRAP, _FILL).alias("_t"))
    none = F.expr(f"CAST(array() AS {_SPAN})")
    low = F.lower("_t")
    # What every match holds is looked for first.
    base = [F.when(g & F.col("_t").rlike(p), _spans(_parts(F.col("_t"), p), k, valid)).otherwise(none) for k, ((p, valid), g) in enumerate(zip(_BASE, _guards(F.col("_t"), low), strict=True))]
    found = text.select("doc_id", "_t", F.concat(*base).alias("_base"))
    # Most texts have no base span: nothing is masked in them.
    found = found.select("doc_id", "_base", F.when(F.size("_base") == 0, F.col("_t")).otherwise(_masked(F.col("_t"))).alias("_m"), model.select("weights").scalar().alias("_w"), bound.alias("_b"))
    random = _spans(_parts(F.col("_m"), _LONG), 3, lambda p: score(p, F.col("_w")) >= F.col("_b"))
    more = F.when(F.col("_m").rlike(_LONG), random).otherwise(none)
    return found.select("doc_id", F.array_sort(F.concat("_base", more)).alias("spans"))


def _joined(spans: Column) -> Column:
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
