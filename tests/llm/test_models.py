import random

import numpy as np
import pytest
from assayer.llm import langid, toxicity
from pyspark.sql import functions as F


def test_toxicity_learns_and_generalises():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices(["an", "er", "th", "on", "in", "es"], k=rnd.randint(1, 3)))
    text = lambda n: [word() for _ in range(n)]
    texts, labels = [], []
    for k in range(240):
        t = text(rnd.randint(20, 200))
        if k % 3 == 0:
            t[rnd.randrange(len(t))] = rnd.choice(["grumblok", "vexatious", "snarfling"])
        texts.append(" ".join(t))
        labels.append(int(k % 3 == 0))
    model = toxicity.train(texts, labels, window_rounds=15)
    bad = [" ".join([*text(400), w, *text(400)]) for w in ("grumblok", "GRUMBLOK!", "grumblokk", "snarfl1ng")]
    good = [" ".join(text(800)) for _ in range(20)]
    assert (model.score(bad) >= 0.5).sum() >= 3 and (model.score(good) < 0.5).all()
    assert model.score([None, "", "  "]).shape == (3,) and toxicity.train(["a"], [1]) is None


def test_toxicity_windows_match_plain_bags():
    """The vectorised window means equal those of runs taken word by word."""
    model = toxicity.Model(np.random.default_rng(0).normal(size=(1 << toxicity.BITS, toxicity.DIM)), np.eye(toxicity.DIM, 2), np.array([0.0, 0.5]))
    row, base = model.weights()
    text = "One two, three four5 é"
    logits, ranges, data = model.windows([text, "solo"])
    spaced = data.tobytes()
    best = -1e9
    starts = [i for i in range(len(spaced) - 6) if spaced[i] == 32 and spaced[i + 1] != 32]
    values = {}
    for there, rows in toxicity._rows(data):
        for i in np.flatnonzero(there):
            values.setdefault(i, []).append(row[rows[i]])
    words = [[v for i in range(a, b) for v in values.get(i, [])] for a, b in zip(starts, [*starts[1:], len(spaced)], strict=True)][:5]
    for k in range(len(words) - toxicity.WINDOW + 1):
        bag = [v for w in words[k : k + toxicity.WINDOW] for v in w]
        best = max(best, np.mean(bag) + base)
    assert logits[0] == pytest.approx(best) and len(logits) == 2 and ranges[1][1] > ranges[1][0]


def test_toxicity_on_tables(spark, edges, empty):
    labels = spark.createDataFrame([(1, 0), (4, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.fit(edges, labels)
    out = toxicity.score(edges, model).collect()
    assert len(out) == edges.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in toxicity.score(edges, None).collect()} == {0.0} and toxicity.score(empty, model).count() == 0


def test_language(spark, sf, edges, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    network = langid.fit(docs, rows=120)
    out = langid.predict(docs, network).join(docs.select("doc_id", "lang"), "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.95
    got = {r.doc_id: r for r in langid.predict(edges, network).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and got[5].lang_pred in network.languages
    assert langid.fit(empty) is None and langid.predict(empty, network).count() == 0
    assert {r.lang_pred for r in langid.predict(edges, None).collect()} == {"und"}


def test_toxicity_is_row_local(documents):
    """A score does not depend on the rows beside it, nor on the parts that a long text is cut into."""
    rnd = np.random.default_rng(3)
    model = toxicity.Model(rnd.normal(size=(1 << toxicity.BITS, toxicity.DIM)), rnd.normal(size=(toxicity.DIM, 2)), np.array([0.1, -0.3]), 0.7, -0.2)
    texts = [*documents.text[:60], None, "", "one", " a  b ", "é" * 50]
    together = model.score(texts)
    assert together.tolist() == [float(model.score([t])[0]) for t in texts] == model.score(texts[::-1])[::-1].tolist()


def test_toxicity_in_parts(documents, monkeypatch):
    rnd = np.random.default_rng(4)
    model = toxicity.Model(rnd.normal(size=(1 << toxicity.BITS, toxicity.DIM)), rnd.normal(size=(toxicity.DIM, 2)), np.zeros(2))
    texts = [t for t in documents.text if len(t) > 700] + ["x," * 900, "word" * 400, "a " * 500 + "... --- " + "b " * 500]
    whole = model.score(texts)
    monkeypatch.setattr(toxicity, "PART", 300)
    assert sum(len(list(toxicity.parts(t))) > 1 for t in texts) > 20 and model.score(texts).tolist() == whole.tolist()


def test_toxicity_labels(spark):
    """Long texts and repeated ids are learned from; ids labelled both ways are not; held-out ids are not."""
    rows = [(i, ("lorem ipsum " * 1500) + ("grumblok " if i % 2 else "") + ("dolor sit " * 200)) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, rows=40, chars=2000)
    assert model is not None and toxicity.fit(docs, labels.filter("toxic = 1")) is None
    scores = [r.score for r in toxicity.score(docs.coalesce(1), model).orderBy("doc_id", "score").collect()]
    assert scores == [r.score for r in toxicity.score(docs.repartition(40), model).orderBy("doc_id", "score").collect()]


def plain_forward(net, row):
    """Log-probabilities of one window, filter by filter."""
    pooled = []
    for f in range(net.filters.shape[1]):
        width = langid.WIDTHS[f // langid.FILTERS]
        answers = [sum(float(net.embed[row[p + j], d]) * float(net.filters[j * langid.DIM + d, f]) for j in range(width) for d in range(langid.DIM)) for p in range(len(row) - langid._SPAN + 1)]
        pooled.append(max(0.0, max(answers) + float(net.bias[f])))
    z = np.array(pooled) @ net.out.astype(np.float64) + net.offset
    return z - np.log(np.exp(z - z.max()).sum()) - z.max()


def test_language_network_against_plain_sums():
    rnd = np.random.default_rng(6)
    data = rnd.integers(0, 256, (24, langid.WINDOW)).astype(np.uint8)
    net = langid.train(data, ["de", "en", "fr"] * 8, rounds=1)
    logs = net.forward(data[:3])[0]
    for k in range(3):
        assert np.allclose(logs[k], plain_forward(net, data[k]), atol=1e-4)
    t = np.array([0, 1, 2] * 8)
    loss = lambda: -float(net.forward(data)[0].astype(np.float64)[np.arange(24), t].mean())
    for name in ("embed", "filters", "bias", "out", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    grads = dict(zip(("embed", "filters", "bias", "out", "offset"), net.gradients(data, t), strict=True))
    for name, g in grads.items():
        value = getattr(net, name)
        for at in np.argsort(np.abs(g).ravel())[-6:]:
            old = value.ravel()[at]
            value.ravel()[at] = old + 1e-6
            up = loss()
            value.ravel()[at] = old - 1e-6
            slope = (up - loss()) / 2e-6
            value.ravel()[at] = old
            assert abs(slope - g.ravel()[at]) <= 1e-3 * abs(slope) + 1e-7, name


def test_language_of_long_texts(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    net = langid.train(rnd.integers(97, 122, (12, langid.WINDOW)).astype(np.uint8), ["a", "b"] * 6, rounds=1)
    texts = ["abcdefg hijk " * 900, "xyz é " * 2000, "short", None]
    whole = net.predict(texts)
    monkeypatch.setattr(langid, "PART", 4 * langid.WINDOW)
    names, scores = net.predict(texts)
    assert names == whole[0] and np.allclose(scores, whole[1], atol=1e-5) and net.predict(texts[1:2])[0][0] == names[1]
    docs = spark.createDataFrame([(i, "some words here " * 30, ["x", "y", None][i % 3]) for i in range(90)] * 2 + [(1, "other", "x")], "doc_id long, text string, lang string")
    assert langid.fit(docs, rows=10).languages == ["x", "y"]
