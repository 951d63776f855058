"""Toxicity: subword-bag embeddings, averaged, under a linear softmax; both trained jointly in numpy.

A text is lower-cased; other ASCII characters than letters and digits are spaces. Every run of 3 to 5 bytes inside a word or across
one of its ends is hashed to a row of an embedding table, so a misspelt word shares most rows with the right one. The
bag of a window of WINDOW words is the mean of its rows; a linear softmax turns it into two classes. A document's
logit is that of its most toxic window, wherever it is, so a few words count in a text of any length.

Training sees at most TRAIN_ROWS labelled documents of each class, those with the least hashed ids, and of a text over TRAIN_CHARS
characters PIECES parts spread over it, with as many characters together; rows held out (see `held_out`) never. First whole texts as
bags, then the window that scores highest in each text. A scale and offset, fitted on a quarter of the sample, make 0.5 the point
where both labels are equally likely.

Row weights are whole multiples of 2**-FRACTION, so sums are exact: a score does not depend on the rows beside it.

Defined results: null and empty texts have the logit of an empty bag. Without labelled rows of both classes every score is 0, as in
empty tables of labels. Documents labelled both ways are not learned from; of a repeated id the least text is. Repeated rows get equal
scores. Long texts are scored in parts that share a word, so that all their windows count; only doc_id and text are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, table

BITS, DIM = 16, 8
SIZES = (3, 4, 5)
WINDOW = 2
TRAIN_ROWS, TRAIN_CHARS, PIECES = 1_000, 10_000, 10
#: Characters of a text that are scored at a time.
PART = 1 << 18
FRACTION = 24
_KEEP = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _KEEP[_c] = _c


def _bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a space around each, and where each begins (one more than texts)."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = _KEEP[np.frombuffer(b" " + b" ".join(parts) + b"     ", np.uint8)]
    return data, np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))


def _rows(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: which places have a run of that size, and its row of the table."""
    b, space = data.astype(np.uint32), data == 32
    n = len(data) - max(SIZES) + 1
    h, broken = b[:n] + np.uint32(1), np.zeros(n, bool)
    for j in range(1, max(SIZES)):
        h = h * np.uint32(0x01000193) ^ b[j : n + j]
        if j + 1 in SIZES:
            yield ~broken & ~space[1 : n + 1], (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        broken = broken | space[j : n + j]


def _words(data: np.ndarray) -> np.ndarray:
    """First places of words, less one: the place of the run that begins with the space before."""
    space = data == 32
    return np.flatnonzero(space[:-1] & ~space[1:])


def parts(text: str | None) -> Iterator[str]:
    """A text in parts of about PART characters, cut at spaces, each beginning with the last WINDOW - 1 words of the one before or more."""
    text = text or ""
    start = 0
    while len(text) - start > PART:
        cut = text.find(" ", start + PART)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
        for _ in range(WINDOW - 1):
            while start > 0 and not text[start - 1].isalnum():
                start -= 1
            start = text.rfind(" ", 0, start) + 1
    yield text[start:]


@dataclass
class Model:
    table: np.ndarray  # rows x DIM
    softmax: np.ndarray  # DIM x 2
    offset: np.ndarray  # 2
    scale: float = 1.0
    shift: float = 0.0

    def weights(self) -> tuple[np.ndarray, float]:
        """The two-class logit of each row, and of an empty bag: the bag's logit is their mean, plus the latter."""
        return self.table @ (self.softmax[:, 1] - self.softmax[:, 0]), float(self.offset[1] - self.offset[0])

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
        """For each text the logit of its best window and that window's range of places; the bytes that places refer to."""
        row, base = self.weights()
        row = np.round(row * (1 << FRACTION)).astype(np.int64)
        data, at = _bytes(texts)
        total, count = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
        for there, rows in _rows(data):
            total[1 : len(rows) + 1] += np.where(there, row[rows], 0)
            count[1 : len(rows) + 1] += there
        np.cumsum(total, out=total)
        np.cumsum(count, out=count)
        first = _words(data)
        ends = np.append(first[1:], len(data))
        bound = np.searchsorted(first, at)
        logits, ranges = np.full(len(texts), base), [(0, 0)] * len(texts)
        for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)):
            if b > a:
                w = min(WINDOW, b - a)
                begin, end = first[a : b + 1 - w], ends[a + w - 1 : b]
                means = (total[end] - total[begin]) / (np.maximum(count[end] - count[begin], 1) << FRACTION)
                k = int(means.argmax())
                logits[i] = means[k] + base
                ranges[i] = (int(first[a + k]), int(ends[a + k + w - 1]))
        return logits, ranges, data

    def score(self, texts: list[str | None]) -> np.ndarray:
        logits = np.array([max(self.windows([p])[0][0] for p in parts(t)) for t in texts]) if any(len(t or "") > PART for t in texts) else self.windows(texts)[0]
        x = np.clip(self.scale * logits + self.shift, -30, 30)
        return 1 / (1 + np.exp(-x))


def _step(model: Model, memory: list[np.ndarray], bags: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
    """One step of Adagrad on table, softmax and offset over a batch of bags."""
    bags = [b if len(b) else np.zeros(1, np.int64) for b in bags]
    size = np.array([len(b) for b in bags])
    flat, start = np.concatenate(bags), np.concatenate(([0], np.cumsum(size)[:-1]))
    mean = np.add.reduceat(model.table[flat], start, axis=0) / size[:, None]
    z = mean @ model.softmax + model.offset
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(labels)), labels] -= 1
    p /= len(labels)
    to_mean = p @ model.softmax.T / size[:, None]
    names, place = np.unique(flat, return_inverse=True)
    of = np.repeat(np.arange(len(bags)), size)
    to_table = np.stack([np.bincount(place, weights=to_mean[of, d], minlength=len(names)) for d in range(DIM)], axis=1)
    for value, index, grad, sums in ((model.table, names, to_table, memory[0]), (model.softmax, slice(None), mean.T @ p, memory[1]), (model.offset, slice(None), p.sum(axis=0), memory[2])):
        sums[index] += grad**2
        value[index] -= rate * grad / np.sqrt(sums[index] + 1e-12)


def train(texts: list[str], labels: list[int], *, seed: int = 7, whole_rounds: int = 4, window_rounds: int = 12) -> Model | None:
    """A model of labelled texts; None without both labels. The last quarter only sets scale and shift."""
    if len(set(labels)) < 2:
        return None
    random = np.random.default_rng(seed)
    order = random.permutation(len(texts))
    texts, y = [texts[i] for i in order], np.array(labels)[order]
    n = max(2, len(texts) * 3 // 4)
    model = Model(random.normal(0, 0.1, (1 << BITS, DIM)), random.normal(0, 0.5, (DIM, 2)), np.zeros(2))
    memory = [np.zeros_like(model.table), np.zeros_like(model.softmax), np.zeros_like(model.offset)]

    def bag(data: np.ndarray, distinct: bool) -> np.ndarray:
        rows = np.concatenate([r[t] for t, r in _rows(data)]).astype(np.int64)
        return np.unique(rows) if distinct else rows

    whole = [bag(_bytes([t])[0], True).astype(np.int32) for t in texts[:n]]
    for _ in range(whole_rounds):
        for part in np.array_split(random.permutation(n), max(1, n // 32)):
            _step(model, memory, [whole[i] for i in part], y[part], 0.05)
    del whole
    for _ in range(window_rounds):
        for part in np.array_split(random.permutation(n), max(1, n // 128)):
            _, ranges, data = model.windows([texts[i] for i in part])
            _step(model, memory, [bag(np.append(data[a : b + 1], np.full(4, 32, np.uint8)), False) for a, b in ranges], y[part], 0.05)
    rest = slice(n, None) if len(set(y[n:].tolist())) == 2 else slice(None)
    x, t = model.windows([*texts[rest]])[0], y[rest]
    center, spread = x.mean(), x.std() + 1e-9
    u, a, b = (x - center) / spread, 1.0, 0.0
    for _ in range(2000):  # plain gradient descent on the two numbers
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        a -= 0.5 * (((p - t) * u).mean() + 1e-3 * a)
        b -= 0.5 * (p - t).mean()
    model.scale, model.shift = a / spread, b - a * center / spread
    return model


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model | None:
    """A model of at most `rows` documents of each label (doc_id, toxic), none held out."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("_most"))
    known = known.filter("toxic = _most").filter(~held_out()).select("doc_id", "toxic")
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    size = F.lit(chars // PIECES)
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring("text", (k * (F.length("text") - size) / (PIECES - 1)).cast("int") + 1, size))
    text = F.when(F.length("text") <= chars, F.col("text")).otherwise(F.array_join(spread, " "))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # at most 2 * rows ids
    sample = found.filter("text IS NOT NULL").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return train([r.text for r in sample], [r.toxic for r in sample])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256, 1):
            texts = batch.column("text").to_pylist()
            scores = model.score(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
