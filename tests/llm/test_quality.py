import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from assayer.llm import quality
from assayer.llm.common import held_out, quantile
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def h(*values):
    """Spark's xxhash64 of strings or longs, by the xxhash library."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if often[w] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_against_brute_force(spark, sf, documents):
    buckets = 1 << 10
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in quality.score(docs, labels, buckets=buckets, threshold=-0.1).collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    grams, raw, trusted = {}, Counter(), Counter()
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        hs = [h(w) for w in WORD.findall(t)]
        grams[i] = [x % buckets for x in hs] + [h(a, b) % buckets for a, b in zip(hs, [*hs[1:], 0], strict=True)]
        raw.update(grams[i])
        if i in good:
            trusted.update(grams[i])
    n, m = sum(raw.values()), sum(trusted.values())
    weight = []
    for b in range(buckets):
        p = (raw[b] + 1) / (n + buckets)
        weight.append(math.log((trusted[b] / p + buckets) / (m + buckets)))
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        r, (words, chars, symbols, lines, repeated) = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, lines, repeated)
        assert r.base_failed == (words < 50 or 100 * repeated > 50 * words)
        llr = sum(weight[b] for b in grams[i]) / max(1, len(grams[i]))
        assert r.llr == pytest.approx(llr, abs=1e-9) and r.kept == (not r.base_failed and llr >= -0.1)


def test_repeats(spark):
    texts = ["a b c a b c", "a a a a", "a b c d", "x y z q x y z", "", None, "one", "a b c\na b c\n\n \n#|", "a b a b a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    labels = spark.createDataFrame([], "doc_id int, quality int")
    for r in quality.score(docs, labels, buckets=64).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id]), texts[r.doc_id]
        assert r.llr == 0 and not r.kept


def test_edges(spark, edges, empty):
    labels = spark.createDataFrame([(5, 1), (None, 1), (5, 1)], "doc_id long, quality int")
    kept = quality.keep_good(edges, labels, buckets=64, threshold=-99)
    assert kept.columns == edges.columns and [r.ids for r in kept.collect()] == []
    assert quality.score(edges.select("doc_id", "text"), labels, buckets=64).count() == edges.count()
    assert quality.keep_good(empty, labels, buckets=64).count() == 0
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "mine")], "doc_id long, text string, kept string")
    assert quality.keep_good(long, labels, buckets=64, threshold=-99).first().kept == "mine"


def test_threshold_follows_the_scores(spark):
    """Junk of words that good documents use too, and of its own, is dropped although buckets are crowded; good documents stay."""
    random.seed(8)
    good_words, junk_words = [f"g{i}" for i in range(400)], [f"j{i}&&&" for i in range(400)]
    text = lambda words: " ".join(random.choices(words, k=80))
    rows = [(i, text(good_words)) for i in range(400)] + [(i, text(good_words + junk_words)) for i in range(400, 500)]
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(i, 0) for i in range(400, 450)], "doc_id int, quality int")
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id int, text string"), labels, buckets=1 << 11).collect()}
    assert not any(i >= 400 for i in kept) and sum(i in kept for i in range(300, 400)) >= 95


def test_all_trusted_documents_count(spark, monkeypatch):
    """Every document labelled as good is learned from, however many there are; ids joined by a shuffle give what ids sent to all tasks do."""
    labels = spark.range(60_000).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(0).alias("quality")).withColumnRenamed("id", "doc_id")
    assert quality.trusted_ids(labels).count() == 30_000
    rows = [(i, f"good{i % 7} word{i % 5} text") for i in range(300)] + [(None, "good1 word1 text"), (3, "good3 twice"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = ~held_out()
    ids = quality.trusted_ids(labels).filter(learn)
    want = quality.fit(docs, ids, buckets=64).first().weights
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert quality.fit(docs, ids, buckets=64).first().weights == want == quality.fit(docs, ids, buckets=64, among=learn).first().weights
    assert quality.score(docs, labels, buckets=64).count() == len(rows)


@pytest.mark.parametrize("share", [0.0, 0.01, 0.37, 0.9995, 1.0])
def test_quantile(spark, share):
    random.seed(4)
    values = [random.choice([random.gauss(0, 3), -1.5, 2.0, 0.25]) for _ in range(3001)]
    got = quantile(spark.createDataFrame([(v,) for v in [*values, None]], "value double"), share).first().value
    assert got == pytest.approx(np.percentile(values, 100 * share), abs=1e-12)
    assert quantile(spark.createDataFrame([(None,)], "value double"), share).first().value is None
