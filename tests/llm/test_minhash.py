import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from assayer.llm import components, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, percent):
    """doc_id -> (set size, component), by comparing every two texts that share a shingle."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    owners, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in owners[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df, width, percent=80):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=width, percent=percent).collect()}


def test_documents(spark, sf, documents):
    want = brute(list(zip(documents.doc_id, documents.text, strict=True)), 4, 80)
    assert got(spark.read.parquet(f"{sf}/documents.parquet"), 4) == want


@pytest.mark.parametrize("block", [8, 1024])
def test_hub_and_copies(spark, monkeypatch, block):
    """Copies that are linked through one text only, exact copies, texts at the limit; also when clusters are dealt in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    random.seed(4)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    rows, base = [], [word() for _ in range(120)]
    rows.append(" ".join(base))
    for _ in range(40):
        copy = list(base)
        for k in random.sample(range(120), 2):
            copy[k] = word()
        rows.append(" ".join(copy))
    rows += [rows[3]] * 20 + ["A B c", "a b C", "a b", ""] + [" ".join(word() for _ in range(50)) for _ in range(20)]
    limit = [word() for _ in range(23)]  # 20 shingles of 4; one more word at each end: 20 of 22; two replaced at the end: at the limit or not
    rows += [" ".join(limit), " ".join([word(), *limit, word()]), " ".join([*limit[:-2], word(), word()])]
    rows = list(enumerate(rows))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 4) == brute(rows, 4, 80)


def test_deeper_regions(spark, monkeypatch):
    monkeypatch.setattr(minhash, "REGION", 4)
    random.seed(5)
    base = [f"w{i}" for i in range(200)]
    rows = [" ".join(base)]
    for i in range(30):
        copy = list(base)
        copy[i * 6] = f"x{i}"
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 5) == brute(rows, 5, 80)


def test_crowded_region(spark, monkeypatch):
    """Thousands of texts that share half their words in one region of one tree, and planted pairs just above the limit."""
    for name, value in (("TREES", 1), ("DEPTH", 0), ("REGION", 64), ("BLOCK", 64)):
        monkeypatch.setattr(minhash, name, value)
    random.seed(7)
    rows, passage = [], [f"c{k}" for k in range(20)]
    for i in range(2000):
        own = [f"o{i}w{k}" for k in range(20)]
        rows.append(" ".join([*passage, *own]))
        if i % 40 == 0:  # 37 shingles of 4 in each, 33 in common of 41
            rows.append(" ".join([*passage, *own[:-4], *(f"p{i}w{k}" for k in range(4))]))
    random.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute(rows, 4, 80)
    assert sum(i != c for i, (_, c) in want.items()) == 50
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 4) == want


def test_components(spark):
    random.seed(6)
    pairs = [(i, i + 1) for i in range(300, 340)] + [(random.randrange(100), random.randrange(100)) for _ in range(60)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_edges(spark, edges, empty):
    out = minhash.near_duplicates(edges).collect()
    assert len(out) == edges.count() and {r.doc_id: r.component_id for r in out if r.doc_id} == {i: i for i in range(1, 8)}
    kept = minhash.keep_one(edges)
    assert kept.columns == edges.columns and kept.count() == edges.count()
    assert minhash.near_duplicates(empty).count() == 0


def test_pipeline_against_brute_force(spark, sf, documents):
    """Stages on their own inputs, by plain Python where the rules are plain."""
    import zlib

    import numpy as np
    import sentencepiece
    from assayer.llm import decontam, pii, sptok

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.good(spark, docs, sf).select("doc_id", "text")
    start = {r.doc_id: r.text for r in kept.collect()}
    assert 0 < len(start) < len(documents)
    groups = brute(sorted(start.items()), 5, 80)
    items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    library, finder = sentencepiece.SentencePieceProcessor(model_file=sptok.model_path()), pii.Finder()
    want = {}
    for i, t in start.items():
        if groups[i][1] == i and not any(x in decontam.normalise(t) for x in items):
            ids = library.encode(pii.redacted(t, finder.spans(t)))
            want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_sketches_tell_strangers_apart():
    """Of texts that share half of their elements no two are alike, of pairs at the limit all are."""
    import numpy as np
    from assayer.llm import shingles

    rnd = np.random.default_rng(9)
    new = lambda n: rnd.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
    sketch = lambda *parts: shingles.sketch(np.unique(np.concatenate(parts)), minhash.BINS)
    passage = new(400)
    strangers = np.array([sketch(passage, new(200)) for _ in range(1500)])
    assert sum(shingles.alike(strangers, s, minhash.ESTIMATE).sum() for s in strangers) == len(strangers)
    for size in (5, 40, 200, 3000):
        for _ in range(300):
            common, a, b = new(8 * size // 10), new(size // 10), new(size - 8 * size // 10 - size // 10)
            assert shingles.alike(sketch(common, a), sketch(common, b), minhash.ESTIMATE)
    assert sketch(np.zeros(0, np.uint64)).sum() == 0


def test_many_strangers_with_a_common_passage(spark):
    """Thousands of texts with a Jaccard index of 0.45 to each other: planted pairs are linked, strangers are not, even coarsely."""
    random.seed(10)
    passage, rows, pairs = " ".join(f"c{k}" for k in range(64)), [], []
    for i in range(5000):
        own = [f"o{i}w{k}" for k in range(38)]
        rows.append((2 * i, f"{passage} {' '.join(own)}"))
        if i % 50 == 0:
            rows.append((2 * i + 1, f"{passage} {' '.join(own[:-4])} x{i} y{i} z{i} q{i}"))
            pairs.append((2 * i, 2 * i + 1))
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert found == {i: (i - 1 if i % 2 else i) for i, _ in rows} and len(pairs) == 100
