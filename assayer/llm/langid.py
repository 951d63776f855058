"""Language identification: a byte convolutional network, trained in numpy.

A text is cut into windows of WINDOW bytes, the last one filled with zeros. Bytes are embedded; filters of several widths slide over
a window; the greatest answer of each filter, rectified, goes to a softmax over the languages seen in training. A document's
probabilities are the softmax of its windows' log-probabilities, averaged by the bytes that each window holds.

Training sees at most ROWS_PER_LANGUAGE labelled documents of each language, those with the least hashed ids, and of each at most
WINDOWS_PER_TEXT windows spread over the whole text; rows held out (see `held_out`) never. The network has a class for each language value.

Defined results: `und` with score 0 for a null text, a text without a letter, and where no language was learned (as in empty tables). Of equal
probabilities the first language by name is taken. A repeated id is learned from once, with its least language and text; repeated rows get
equal results. Scores are rounded to six places. Long texts are read PART bytes at a time; only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, small_batches, table

WINDOW, DIM, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 12
ROWS_PER_LANGUAGE, WINDOWS_PER_TEXT = 500, 4
UNKNOWN = "und"
_SPAN = max(WIDTHS)
#: Bytes of a text that are in windows at a time, whole windows.
PART = 1024 * WINDOW


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW) bytes, how many each holds, and for each text where its windows begin (one more than texts)."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    count = -(-size // WINDOW)
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    out[np.arange(len(flat)) + np.repeat(first[:-1] * WINDOW - np.concatenate(([0], np.cumsum(size)[:-1])), size)] = flat
    held = np.full(int(first[-1]), WINDOW)
    held[first[1:][size > 0] - 1] = size[size > 0] - (count[size > 0] - 1) * WINDOW
    return out.reshape(-1, WINDOW), held, first


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows of some bytes, and how many each holds."""
    n = -(-len(data) // WINDOW)
    held = np.full(n, WINDOW)
    held[-1:] = len(data) - (n - 1) * WINDOW
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW), held


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # (_SPAN * DIM) x all filters; rows past a filter's width are 0
    bias: np.ndarray
    out: np.ndarray  # all filters x languages
    offset: np.ndarray

    def forward(self, batch: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Log-probabilities, pooled answers and, if asked for, the place of each."""
        x = self.embed[batch]
        view = np.lib.stride_tricks.sliding_window_view(x, (_SPAN, DIM), axis=(1, 2))[:, :, 0]
        answer = (np.ascontiguousarray(view).reshape(-1, _SPAN * DIM) @ self.filters).reshape(len(batch), view.shape[1], -1)
        at = answer.argmax(axis=1) if places else None
        pooled = np.maximum(answer.max(axis=1) + self.bias, 0)
        z = pooled @ self.out + self.offset
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), pooled, at

    def sums(self, rows: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window times the bytes that it holds."""
        return np.concatenate([self.forward(rows[i : i + 64])[0] * held[i : i + 64, None] for i in range(0, len(rows), 64)]) if len(rows) else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        short = [t if len(t or "") <= PART // 4 else None for t in texts]
        rows, held, first = windows(short)
        logs = self.sums(rows, held)
        names, scores = [], []
        for i, text in enumerate(texts):
            if text is None or not any(map(str.isalpha, text)):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            if short[i] is None:
                data = text.encode("utf-8", "replace")
                total = sum(self.sums(*windows_of(data[k : k + PART])).sum(axis=0) for k in range(0, len(data), PART)) / len(data)
            else:
                a, b = first[i], first[i + 1]
                total = logs[a:b].sum(axis=0) / held[a:b].sum()
            p = np.exp(total - total.max())
            k = int(p.argmax())
            names.append(self.languages[k])
            scores.append(round(float(p[k] / p.sum()), 6))
        return names, scores

    def gradients(self, data: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy of windows `data` with languages `t`, by embed, filters, bias, out and offset."""
        width = self.filters.shape[1]
        logs, pooled, at = self.forward(data, places=True)
        d = np.exp(logs)
        d[np.arange(len(t)), t] -= 1
        d /= len(t)
        to_pool = (d @ self.out.T) * (pooled > 0)
        spots = at[:, :, None] + np.arange(_SPAN)  # the bytes under each greatest answer
        seen = data[np.arange(len(t))[:, None, None], spots]
        patch = self.embed[seen].reshape(len(t), width, _SPAN * DIM)
        to_patch = (to_pool[:, :, None] * self.filters.T[None]).reshape(-1, DIM)
        to_embed = np.stack([np.bincount(seen.ravel(), weights=to_patch[:, k], minlength=256) for k in range(DIM)], axis=1)
        return [to_embed, np.einsum("bf,bfk->kf", to_pool, patch) * _mask(width), to_pool.sum(axis=0), pooled.T @ d, d.sum(axis=0)]


def _mask(filters: int) -> np.ndarray:
    """1 for the rows of each filter that are inside its width."""
    width = np.repeat(WIDTHS, filters // len(WIDTHS))
    return (np.arange(_SPAN * DIM)[:, None] // DIM < width[None, :]).astype(np.float32)


def train(rows: np.ndarray, labels: list[str], *, seed: int = 5, rounds: int = 6, batch: int = 64, rate: float = 0.01) -> Network | None:
    """A network for (windows x WINDOW) bytes and their languages, by Adam on the cross-entropy."""
    languages = sorted(set(labels))
    if not languages:
        return None
    random = np.random.default_rng(seed)
    y = np.array([languages.index(k) for k in labels])
    width = len(WIDTHS) * FILTERS
    f32 = lambda *shape, s: random.normal(0, s, shape).astype(np.float32)
    net = Network(languages, f32(256, DIM, s=0.5), f32(_SPAN * DIM, width, s=0.3) * _mask(width), np.zeros(width, np.float32), f32(width, len(languages), s=0.2), np.zeros(len(languages), np.float32))
    values = [net.embed, net.filters, net.bias, net.out, net.offset]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(rounds):
        order = random.permutation(len(rows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            grads = net.gradients(rows[pick], y[pick])
            step += 1
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, *, rows: int = ROWS_PER_LANGUAGE, per_text: int = WINDOWS_PER_TEXT) -> Network | None:
    """A network of the documents with a language (doc_id, text, lang), none held out."""
    known = docs.select("doc_id", "lang").filter("lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    # Counts are summed before the shuffle; hashes under a bound that lets about twice `rows` through leave few rows to rank.
    counts = known.groupBy("lang").agg(F.count("*").alias("_all"))
    place = (F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5) * F.col("_all")
    few = known.join(F.broadcast(counts), "lang").filter(place <= 2 * rows + 100).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows).select("doc_id", "lang")
    picked = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256, 2):
            data, _, first = windows(batch.column("text").to_pylist())
            ids, langs, out = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                for k in sorted(set(np.linspace(a, b - 1, min(per_text, b - a)).astype(int).tolist())):
                    out.append((ids[i], langs[i], k - a, data[k].tobytes()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["doc_id", "lang", "place", "bytes"])

    found = picked.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, "doc_id long, lang string, place long, bytes binary").collect()
    found = sorted((r.doc_id, r.place, r.lang, bytes(r.bytes)) for r in found)
    data = np.frombuffer(b"".join(r[3] for r in found), np.uint8).reshape(-1, WINDOW)
    return train(data, [r[2] for r in found])


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256, 1):
            texts = batch.column("text").to_pylist()
            names, scores = network.predict(texts) if network else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
