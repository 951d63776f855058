import hashlib
import math
import random
import re
import string
import time

import numpy as np
import pyarrow as pa
import pytest
from assayer.llm import chat, decontam, pii, secret_scan, sptok
from pyspark.sql import functions as F

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, pii.KINDS[k], b) for a, k, b in sorted(out)]


def test_pii_base(documents):
    finder, rnd = pii.Finder(), random.Random(1)
    texts = list(documents.text)
    for letters in ("ab@.-+1 ", "0123456789 -+.", "1.2 5@a-", "+1 ()-.234"):
        texts += ["".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(5000)]
    texts += ["1" * 5000 + ".2.3.4", "a" * 5000 + "@", "4111 1111 1111 1111", "a@b@c.d", "user@" * 300 + "x.y"]
    for t in texts:
        assert [s for s in finder.spans(t) if s[1] in pii.BASE] == personal(t), t[:80]


def test_pii_method_and_redaction(spark, edges, empty):
    finder = pii.Finder()
    text = "see https://joe:pw@host.example/x, IBAN: GB82 WEST 1234 5698 7654 32, account no: 12345678, user id: ab. Plain https://host.example/x"
    assert [text[a:b] for a, k, b in finder.spans(text) if k in ("login", "account")] == ["https://joe:pw@host.example", "GB82 WEST 1234 5698 7654 32", "12345678"]
    out = pii.redact(spark.createDataFrame([(1, "a@b.c and 1.2.3.4", "x"), (2, None, "y")], "doc_id int, text string, spans string"))
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "<EMAIL> and <IP>", "x"), (2, None, "y")]
    assert pii.find(edges).count() == edges.count() and pii.redact(edges).columns == edges.columns and pii.find(empty).count() == 0


def secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, sf, documents, edges, empty):
    rnd = random.Random(2)
    pieces = ["token", "=", ":", '"', "abc", "secret", " ", "AKIA", "ABCDEFGHIJ012345", "0123456789abcdef", "\u0001", "é", "Api_Key", "x", "\n"]
    texts = list(documents.text) + ["".join(rnd.choices(pieces, k=rnd.randint(0, 14))) for _ in range(600)]
    texts += ['token=token":abcdefgh', "key 9fQ2xLr7Tz0PwVb8KsYd3HcN", "word thisisanordinarylongidentifier2 word"]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 3] == secrets(t), t[:80]
    assert (4, 3, 28) in got[len(texts) - 2] and got[len(texts) - 1] == []
    assert secret_scan.scan(edges).count() == edges.count() and secret_scan.scan(empty).count() == 0


def test_secrets_of_many_matches(spark):
    """Some thousand matches in one text, at their places."""
    text = "0123456789abcdef01234567 ok " * 4000
    r = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in r.spans if s.kind == 2] == [(28 * k, 28 * k + 24) for k in range(4000)]


def test_random_secrets_against_plain_models(spark):
    """Spans of kind random equal those of models counted and compared token by token."""
    rnd = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    token = lambda n: "".join(rnd.choices(letters, k=n))
    word = lambda: "".join(rnd.choices(["get", "set", "Item", "value", "_of", "list", "count2", "index"], k=rnd.randint(1, 6)))
    texts = [" ".join([word(), word(), f"token={token(24)}", word(), token(rnd.randint(10, 40)) if k % 6 == 0 else word(), word() + word() + word() + "7"]) for k in range(240)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in secret_scan.scan(frame, threshold=0.0).collect()}
    left_out = {r[0] for r in frame.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).select("doc_id").collect()}
    long = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{%d,}[A-Za-z0-9+/_=-]" % (secret_scan.TOKEN_CHARS - 2))
    base = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""", re.A)
    count = [{}, {}]

    def cells(t):
        return list(zip(["", *t], t, strict=False))

    masked, ordinary, secrets = [], [], []
    for i, t in enumerate(texts):
        masked.append(base.sub(lambda m: "\x02" * len(m[0]), t))
        plain = [m[0] for m in re.finditer(long.pattern + r"|[A-Za-z0-9+/_=-]{3,}", masked[-1])]
        if i in left_out:
            ordinary += [w for w in plain if long.fullmatch(w)]
            secrets += [m[1] or m[0] for m in base.finditer(t)]
            continue
        for k, tokens in ((0, [m[1] or m[0] for m in base.finditer(t)]), (1, plain)):
            for c in (c for w in tokens for c in cells(w)):
                count[k][c] = count[k].get(c, 0) + 1
    totals = [{}, {}]
    for k in (0, 1):
        for (a, _), n in count[k].items():
            totals[k][a] = totals[k].get(a, 0) + n
    chance = lambda k, c: math.log((count[k].get(c, 0) + 1) / (totals[k].get(c[0], 0) + secret_scan.ALPHABET))
    for i, t in enumerate(masked):
        want = []
        for m in long.finditer(t):
            ratio = sum(chance(0, c) - chance(1, c) for c in cells(m[0]))
            assert abs(ratio) > 1e-9
            if ratio >= 0:
                want.append((m.start(), m.end()))
        assert got[i] == want, t
    assert 5 < sum(map(len, got.values())) < len(texts)
    score = lambda w: sum(chance(0, c) - chance(1, c) for c in cells(w))
    most = np.mean([score(w) / len(w) for w in secrets]) * secret_scan.TOKEN_CHARS / 2
    want = max(min(np.percentile([score(w) for w in ordinary], 100 * secret_scan.LEFT), most), secret_scan.LEAST_RATIO)
    assert abs(secret_scan.fit(frame).first()["threshold"] - want) < 1e-6


def test_all_documents_teach_the_models(spark):
    """Every token of every document is counted, however many documents there are, those without an id too."""
    docs = spark.range(12_000).select("id", F.concat(F.lit("plainword and token=abcDEF"), F.col("id") % 10).alias("text")).withColumnRenamed("id", "doc_id")
    docs = docs.unionByName(spark.createDataFrame([(None, "plainword without")], "doc_id long, text string"))
    got = {(r.secret, r.token): r.n for r in secret_scan.labelled(docs).groupBy("secret", "token").agg(F.sum("n").alias("n")).collect()}
    assert got == {(1, f"abcDEF{k}"): 1200 for k in range(10)} | {(0, "plainword"): 12_001, (0, "and"): 12_000, (0, "without"): 1}


def test_short_keys_of_any_kind_are_found(spark, documents):
    """Keys of 12 characters, of letters only, and with dots, one in every second document."""
    rnd = random.Random(13)
    letters = string.ascii_letters
    keys = {
        "of 12": lambda: "".join(rnd.choices(letters + string.digits, k=12)), "of letters": lambda: "".join(rnd.choices(letters, k=14)), "with dots": lambda: ".".join("".join(rnd.choices(letters + string.digits, k=6)) for _ in range(3)),
    }
    texts, at = [], {}
    for n, (i, text) in enumerate(documents.itertuples(index=False, name=None)):
        text = text or ""
        if n % 2:
            name = list(keys)[n // 2 % 3]
            key = keys[name]()
            at[int(i)] = name, (len(text) + 1, len(text) + 1 + len(key))
            text = f"{text} {key} end"
        texts.append((int(i), text))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for name in keys:
        mine = [i for i in at if at[i][0] == name]
        assert sum(at[i][1] in got[i] for i in mine) >= (0.8 if name == "of 12" else 0.9) * len(mine) > 0, name
    assert sum(i not in at or s != at[i][1] for i in got for s in got[i]) <= 10


@pytest.fixture(scope="module")
def pieces():
    return sptok.Pieces(sptok.model_path())


def test_a_place_with_its_piece_is_not_judged_again(documents):
    """Of the pieces that end at a place, longest first, none is held against merging after the one that fits."""
    mine, judged = sptok.Pieces(sptok.model_path()), []
    fit = mine._fit
    mine._fit = lambda a, b: judged.append((a, b)) or fit(a, b)
    for word in sorted({w for t in documents.text[:40] for w in (t or "").split()})[:1500]:
        text, last, want = sptok.SPACE + word, [""], set()
        for end in range(1, len(text) + 1):
            last.append(text[end - 1])  # a character without a piece
            for start in range(end):
                if text[start:end] in mine.score and (last[start] or not start):
                    want.add((last[start], text[start:end]))
                    if fit(last[start], text[start:end]):
                        last[end] = text[start:end]
                        break
        judged.clear()
        mine.fits.clear()
        mine.best(text)
        assert set(judged) == want and len(judged) == len(want), text


def test_sentencepiece_equals_library(pieces, documents):
    import sentencepiece

    sp, rnd = sentencepiece.SentencePieceProcessor(model_file=sptok.model_path()), random.Random(3)
    parts = ["the", " ", "a", " of", "ing", "é", "ß", "\n", "x", "er", "  ", "日", "T", "ion", "=", "==", "...", "12", "②"]
    texts = [*documents.text[:100], "", " ", "   x ", "\n\n\n a", "x" * 300, "\0 ab", *("".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(3000))]
    for t, found in zip(texts, pieces.encode(pa.array(texts)), strict=True):
        ids = np.frombuffer(found, "<u4").tolist()
        assert ids == sp.encode(t), t[:60]
        assert pieces.decode(ids) == t


def segmentations(pieces, text):
    """All ways to cut a text into pieces, characters without one as themselves."""
    if not text:
        yield []
    for end in range(1, len(text) + 1):
        if text[:end] in pieces.score or (end == 1 and text[0] not in pieces.single):
            for rest in segmentations(pieces, text[end:]):
                yield [text[:end], *rest]


@pytest.mark.parametrize("order", ["scores", "merges"])
def test_best_against_all_segmentations(order):
    pieces, rnd = sptok.Pieces(sptok.model_path(), order), random.Random(4)
    for _ in range(300):
        t = "".join(rnd.choices(["▁", "the", "a", "of", "in", "er", "日", "s"], k=rnd.randint(1, 5)))

        def worth(parts):
            fit = order == "scores" or all(pieces.merged(a + b) == [a, b] for a, b in zip(parts, parts[1:], strict=False)) and pieces.merged(parts[0]) == [parts[0]]
            return sum(pieces.score.get(p, pieces.unknown) for p in parts) if fit else -math.inf

        every = sorted(((worth(p), p) for p in segmentations(pieces, t)), key=lambda x: -x[0])
        ids, parts = pieces.best(t), []
        while ids:
            if ids[0] in pieces.byte_id:  # three bytes of a character
                parts, ids = [*parts, b"".join(pieces.bytes_of[i] for i in ids[:3]).decode()], ids[3:]
            else:
                parts, ids = [*parts, pieces.bytes_of[ids[0]].decode().replace(" ", "▁")], ids[1:]
        assert worth(parts) == every[0][0] and "".join(parts) == t
        assert order == "scores" or len(every) == 1 or every[1][0] == -math.inf


def test_sentencepiece_edges(edges, empty):
    out = sptok.decode(sptok.encode(edges))
    assert set(edges.columns) - {"ids"} <= set(out.columns)
    for r in out.collect():
        assert r.decoded == (r.text or "").replace("▁", " ") and r.n_tokens == len(r.ids)
    assert sptok.encode(empty).count() == 0


def distance(item, text):
    """Least edit distance of item and a substring of text, the plain way."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, edges, empty):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 30)))) for i in range(12)] + [(90, "tiny one"), (91, None), (92, "")]
    docs = []
    for k in range(60):
        text = " ".join(word() for _ in range(60))
        item = list(items[k % 12][1])
        for _ in range(k % 14):
            p = rnd.randrange(len(item))
            item[p : p + 1] = rnd.choice([[], [item[p], "z"], ["q"]])
        docs.append((k, text[:150] + " " + "".join(item).upper() + "!! " + text[150:]))
    docs += [(100, "Tiny, one!"), (101, "a tiny one here"), (102, "a tiny onerous thing")]
    got = {r.doc_id: {m.item_id: m.distance for m in r.matches} for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sure = 0
    for i, t in docs[:60]:
        text, edits = decontam.normalise(t), i % 14
        for item, s in items[:12]:
            pieces = decontam.parts_of(decontam.normalise(s))
            bounds = [decontam.budget(len(p), not n) for n, p in enumerate(pieces)]
            near = [d for p, (k, _) in zip(pieces, bounds, strict=True) if (d := distance(p, text)) <= k]
            assert item not in got[i] or got[i][item] in near
            # As many edits, each taking q q-grams, leave enough of the whole: it must be found.
            m, (k, need) = len(pieces[0]), bounds[0]
            if item == i % 12 and 2 * edits <= k and m + 1 - decontam.Q - 2 * edits * decontam.Q >= need:
                assert got[i][item] == distance(pieces[0], text)
                sure += 1
            assert item == i % 12 or item not in got[i]
    assert sure >= 10
    assert got[100] == {90: 0} and got[101] == {90: 0} and got[102] == {}
    some = spark.createDataFrame(items[:3] + [(9, "same row")], "item_id long, text string")
    assert decontam.matches(edges, some).count() == edges.count() and decontam.keep_clean(edges, some).count() == edges.count() - 2
    assert decontam.matches(empty, some).count() == 0 and decontam.matches(edges, some.filter("false")).filter("size(matches) > 0").count() == 0


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(str, decontam.matches(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    assert sorted(map(str, decontam.matches(docs, items).collect())) == whole
    assert decontam.keep_clean(docs, items).count() == sum("item_id" not in w for w in whole)


def test_decontamination_joined_or_held(spark, edges, empty, monkeypatch):
    """The join of hashes finds what the items in memory find: short items, edited ones, copies, edge rows."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 20)))) for i in range(60)] + [(60, None), (61, ""), (62, "same row"), (62, "same row"), (63, "same row")]
    docs = []
    for k in range(80):
        item = list(items[k % 60][1])
        for _ in range(k % 4):
            item[rnd.randrange(len(item))] = "z"
        docs.append((k, " ".join([word() for _ in range(30)] + ["".join(item)] + [word() for _ in range(30)])))
    docs += [*docs[:5], (None, docs[7][1]), (900, "x"), (901, "")]
    known = spark.createDataFrame(items, "item_id long, text string")
    tables = [spark.createDataFrame(docs, "doc_id long, text string"), edges, empty]
    held = [sorted(map(str, decontam.matches(d, known).collect())) for d in tables]
    clean = [sorted(map(str, decontam.keep_clean(d, known).collect())) for d in tables]
    assert sum("item_id" in h for h in held[0]) > 40 and sum("item_id=63" in h for h in held[1]) == 2
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert [sorted(map(str, decontam.matches(d, known).collect())) for d in tables] == held
    assert [sorted(map(str, decontam.keep_clean(d, known).collect())) for d in tables] == clean
    assert decontam.keep_clean(edges, known).columns == edges.columns


def test_decontamination_of_a_shared_stem():
    """Many items with one stem: each is aligned from where it differs, in time that its own part takes."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 7)))
    stem = " ".join(word() for _ in range(130))
    items = [(i, f"{stem} {word()} {word()} {i}") for i in range(3000)]
    block = decontam.Items(items, decontam.Q, decontam.ERROR, decontam.PART_ERROR)
    text = decontam.normalise(f"well {stem[:300]}x{stem[300:]} and nothing of theirs")
    some = rnd.sample(range(3000), 5)
    start = time.perf_counter()
    got = {item: d for _, item, d, _, _ in block.scan([text])}
    assert time.perf_counter() - start < 10
    for i in some:
        norm = decontam.normalise(items[i][1])
        assert got[i] == distance(norm, text) <= decontam.budget(len(norm), True)[0]


def test_edited_and_partial_items_are_found():
    """Recall of planted items: words replaced, halves, ends cut off; texts without items hold none."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(14, 60)))) for i in range(200)]
    block = decontam.Items(items, decontam.Q, decontam.ERROR, decontam.PART_ERROR)

    def replaced(n):
        def change(words):
            for at in rnd.sample(range(len(words)), n):
                words[at] = word()
            return words

        return change

    changes = {"one word": replaced(1), "two words": replaced(2), "three words": replaced(3), "first half": lambda w: w[: (len(w) + 1) // 2], "last half": lambda w: w[len(w) // 2 :], "cut": lambda w: w[:-2]}
    for name, change in changes.items():
        found = 0
        for i, t in items:
            text = decontam.normalise(" ".join([word() for _ in range(80)] + change(t.split()) + [word() for _ in range(80)]))
            got = {item for _, item, *_ in block.scan([text])}
            assert got <= {i}
            found += i in got
        assert found >= 0.9 * len(items), name
    assert not list(block.scan([decontam.normalise(" ".join(word() for _ in range(20_000)))]))


def test_aligner_against_plain_distances():
    rnd = random.Random(8)
    for _ in range(400):
        text = bytes(rnd.choices(b"ab c", k=rnd.randint(0, 40)))
        low, width = rnd.randint(-12, 30), rnd.randint(1, 30)
        aligner = decontam.Aligner(text, low, low + width)
        base = bytes(rnd.choices(b"ab c", k=12))
        for _ in range(4):
            item = base[: rnd.randint(0, 12)] + bytes(rnd.choices(b"ab c", k=rnd.randint(1, 6)))
            # Cells (row, column) inside the band and the text, plainly.
            cell = {(0, j): 0 for j in range(len(text) + 1) if low <= j <= low + width}
            for i in range(1, len(item) + 1):
                for j in range(max(0, i + low), min(len(text), i + low + width) + 1):
                    options = [cell[p] + 1 for p in ((i - 1, j), (i, j - 1)) if p in cell]
                    if (i - 1, j - 1) in cell:
                        options.append(cell[i - 1, j - 1] + (item[i - 1] != text[j - 1]))
                    if j == 0:
                        options.append(i)
                    cell[i, j] = min(options, default=i)
            ends = [cell[len(item), j] for j in range(len(text) + 1) if (len(item), j) in cell]
            got = aligner.best(item, 99)
            if item in text:
                assert got[0] == 0
            elif ends and got[1] > 0:
                assert got[0] <= min(ends) and got[0] >= distance(item, text)


def test_chat_trees(spark):
    rows = [
        ("t", 1, None, "user", "root", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 3, "user", "more", 0.5),
        ("t", 5, 4, "assistant", "end", 0.0), ("t", 6, 4, "assistant", "tie", 0.0), ("c", 1, 2, "user", "cycle", 0.0), ("c", 2, 1, "user", "cycle", 0.0), ("c", 3, 1, "user", "below a cycle", 0.0),
        (None, 1, 99, None, None, None),
    ]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r["rank"]): (r.leaf, r.formatted) for r in chat.conversations(m, best=2).collect()}
    assert got["t", 1] == (5, "### User: root</turn>\n### Assistant: good</turn>\n### User: more</turn>\n### Assistant: end</turn>\n")
    assert got["t", 2][0] == 6 and got[None, 1] == (1, "### =: </turn>\n") and len(got) == 3
    assert {r.leaf for r in chat.conversations(m, best=None).collect()} == {2, 5, 6, 1}


def test_chat_bushy_tree(spark):
    """Rounds follow the depth: a tree of many replies to one message has two."""
    rows = [("b", 0, None, "user", "root", 0.0)] + [("b", i, 0, "assistant", f"r{i}", i / 7) for i in range(1, 400)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = chat.conversations(m, best=3).orderBy("rank").collect()
    assert [r.leaf for r in got] == [399, 398, 397] and got[0].formatted == "### User: root</turn>\n### Assistant: r399</turn>\n"


def test_chat_deep_tree_with_many_leaves(spark):
    """A leaf at each message of a long way: only the chosen one's ancestors are collected. Repeated rows do not multiply."""
    n = 600
    rows = [("d", i, i - 1 if i else None, "user", f"t{i}", 1.0) for i in range(n)] + [("d", n + i, i, "assistant", f"leaf{i}", 0.5 if i != 300 else 900.0) for i in range(n)]
    rows += [(t, i, i - 1 if i else None, "user", f"r{i}", 1.0) for t in ("r",) for i in range(40) for _ in range(2)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r["rank"]): r for r in chat.conversations(m, best=2).collect()}
    first, second = got["d", 1], got["d", 2]
    assert first.leaf == n + 300 and first.score == 301 + 900 and first.formatted.count("</turn>") == 302 and first.formatted.endswith("### Assistant: leaf300</turn>\n")
    assert second.leaf == 2 * n - 1 and second.score == n + 0.5 and second.formatted.count("</turn>") == n + 1
    assert got["r", 1].formatted.count("</turn>") == 80 and got["r", 1].score == 40


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "\\h\\\\t", "####", "</turn></turn>\n", "", None, "a: b\\", "\\\\###\\"]
    roles = ["user", "assistant", "system", "tool", "Od:d ###", "", None, "=x"]
    rows = [(c, t, roles[(c + t) % 8], texts[(3 * c + t) % 8]) for c in range(8) for t in range(8)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.conversations(chat.from_turns(turns))
    for r in found.select("tree", chat.parsed(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("loss")).collect():
        mine = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.tree]
        assert [tuple(t) for t in r.turns] == mine
        assert r.loss == "".join(t for role, t in mine if role == "assistant")


def test_chat_long_and_empty(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(150)], "conv_id long, turn long, role string, text string")
    r = chat.conversations(chat.from_turns(turns)).select("formatted").first()
    assert r.formatted.count("</turn>\n") == 150 and r.formatted.startswith("### Assistant: t0</turn>\n### User: t1")
    assert chat.conversations(chat.from_turns(turns.filter("false"))).count() == 0
    assert hashlib.sha256(b"").hexdigest()
