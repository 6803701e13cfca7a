"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams with the spaces around it; grams share hashed vectors, so a
misspelling that was never seen shares most of its bag with the word. The vectors of a window of words are
averaged into a softmax of two classes; vectors and softmax learn together. A text's score is that of its
windows' worst, calibrated on the training rows: a few insults in a long text are not averaged away, and all
windows of whole texts count.

Training gathers at most SAMPLE labelled rows of at most SAMPLE_BYTES bytes, half of each class where there
are enough, drawn by a hash of the id so that reruns agree; of rows with one id it takes one, chosen by its text. Once vectors and softmax are trained only their
product matters for scoring: one number a gram. Null and empty texts, and texts without words, score the
calibrated value of no evidence. Without labelled rows of both classes all score 0. Repeated rows get equal
results, empty tables none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlode.llm.common import batches, chunks, extended, prepared, span_hashes, text_bytes
from medlode.llm.ngram_scores import hashed, joined, sums, within_words

SAMPLE = 2400
SAMPLE_BYTES = 1 << 15
SIZES = (3, 4, 5)
BITS = 18
DIM = 6
#: Words of a window, and words between the beginnings of two.
WINDOW, STRIDE = 12, 6


def _words(blobs: list[bytes]):
    """Buckets of grams by where they begin, which count, ends of words, first words of blobs.

    A word that repeats the one before it counts once, or a window would be one bag over and over.
    """
    arr, begins, ends = joined(blobs)
    space = arr == 32
    first = np.flatnonzero(space[:-1] & ~space[1:])
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    new = np.ones(len(first), bool)
    if len(first) > 1:
        word = span_hashes(arr, first + 1, last)
        new[1:] = (word[1:] != word[:-1]) | np.isin(np.arange(1, len(first)), np.searchsorted(first, begins))
    live = np.zeros(len(arr), np.int8)
    live[first[new]] += 1
    live[last[new]] -= 1
    live = np.cumsum(live, dtype=np.int8) > 0
    first, last = first[new], last[new]
    offsets = np.append(np.searchsorted(first, begins), len(first))
    grams = [(idx, within_words(arr, n) & live[: len(idx)]) for n, idx in hashed(arr, SIZES, BITS)]
    return grams, first, last, offsets


def _windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word and blob of each window; a blob with words has one at least."""
    n = np.diff(offsets)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    blob = np.repeat(np.arange(len(n)), count)
    a = offsets[blob] + STRIDE * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return a, np.minimum(a + WINDOW, offsets[blob + 1]), blob


class Model:
    """z[g] is the log odds that gram g adds; shift and steep turn a text's worst window into a probability."""

    def __init__(self, blobs: list[bytes], labels: list[int], rounds: int = 2, seed: int = 5):
        y = np.array(labels, np.int64)
        self.z = None
        if len(set(labels)) < 2:
            return
        tokens, sizes, blob = [], [], []
        for i, j in chunks(blobs, 1 << 19):
            grams, first, last, offsets = _words(blobs[i:j])
            a, b, own = _windows(offsets)
            for k, (lo, hi) in enumerate(zip(first[a].tolist(), last[b - 1].tolist(), strict=True)):
                bag = np.concatenate([idx[lo:hi][ok[lo:hi]] for idx, ok in grams])
                tokens.append(bag), sizes.append(len(bag)), blob.append(i + own[k])
        blob, sizes = np.array(blob), np.array(sizes)
        self.bias = np.float32(0)
        use, rng = np.arange(len(blob)), np.random.default_rng(seed)
        for turn in range(rounds):
            self._fit([tokens[k] for k in use], y[blob[use]], rng)
            score = np.array([self.z[t].sum() for t in tokens]) / np.maximum(sizes, 1) + self.bias
            # of toxic texts only the worst windows are examples of toxicity; clean texts give all of theirs
            rank = np.lexsort((-score, blob))
            place = np.empty(len(blob), np.int64)
            place[rank] = np.arange(len(blob)) - np.searchsorted(blob[rank], blob[rank])
            most = np.maximum(1, np.bincount(blob, minlength=len(y)) // (4 * (turn + 1)))
            use = np.flatnonzero((y[blob] == 0) | (place < most[blob]))
        worst = np.full(len(y), self.bias)
        np.maximum.at(worst, blob, score)
        self._calibrate(worst, y)

    def _fit(self, bags: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, epochs: int = 3, batch: int = 256) -> None:
        vectors = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
        soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        bias = np.zeros(2, np.float32)
        seen = np.full(1 << BITS, 1e-6, np.float32)
        weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-6), 0.5 / max((y == 0).mean(), 1e-6)).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                n = np.array([max(len(bags[k]), 1) for k in own], np.float32)
                flat = np.concatenate([bags[k] for k in own])
                who = np.repeat(np.arange(len(own)), [len(bags[k]) for k in own])
                mean = np.stack([np.bincount(who, vectors[flat, d], len(own)) for d in range(DIM)], 1).astype(np.float32) / n[:, None]
                logits = mean @ soft + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                g = p
                g[np.arange(len(own)), y[own]] -= 1
                g *= weight[own, None]
                back = (g @ soft.T) / n[:, None]
                soft -= 0.5 * mean.T @ g / len(own)
                bias -= 0.1 * g.mean(0)
                hit, spot = np.unique(flat, return_inverse=True)
                step = np.stack([np.bincount(spot, back[who, d], len(hit)) for d in range(DIM)], 1).astype(np.float32)
                seen[hit] += (step**2).mean(1)
                vectors[hit] -= 0.3 * step / np.sqrt(seen[hit])[:, None]
        self.z = vectors @ (soft[:, 1] - soft[:, 0])
        self.bias = bias[1] - bias[0]

    def _calibrate(self, worst: np.ndarray, y: np.ndarray) -> None:
        """A logistic fit of the label on the worst window, each class with half of the weight."""
        mid, wide = float(np.median(worst)), float(worst.std()) or 1.0
        x, a, b = (worst - mid) / wide, 1.0, 0.0
        weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
        for _ in range(2000):
            g = weight * (1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))) - y)
            a -= 0.5 * ((g * x).mean() + 1e-3 * a)
            b -= 0.5 * g.mean()
        self.steep, self.shift = a / wide, b - a * mid / wide

    def predict(self, blobs: list[bytes]) -> np.ndarray:
        if self.z is None:
            return np.zeros(len(blobs))
        grams, first, last, offsets = _words(blobs)
        worst = np.full(len(blobs), float(self.bias))
        if len(first):
            value, count = np.zeros(len(grams[0][0])), np.zeros(len(grams[0][0]))
            for idx, ok in grams:
                value += np.where(ok, self.z[idx], 0)
                count += ok
            a, b, blob = _windows(offsets)
            total, n = sums(value, first[a], last[b - 1]), sums(count, first[a], last[b - 1])
            worst = np.full(len(blobs), -np.inf)
            np.maximum.at(worst, blob, total / np.maximum(n, 1) + self.bias)
            worst[np.isneginf(worst)] = self.bias
        return 1 / (1 + np.exp(-np.clip(self.steep * worst + self.shift, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows where learn (of the id) holds.

    The ids of the sample are drawn first, each class by hash; only their texts are then read out.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    half = lambda k, n: known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(n)
    own = half(1, sample // 2).unionByName(half(0, sample - sample // 2))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    texts = texts.join(F.broadcast(own), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = texts.select("id", "y", "t.text").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    return Model([bytes(r.text) for r in rows], [r.y for r in rows])


def _predict(model):
    def predict(source):
        known = model.value
        for b, texts in batches(source):
            for i, j in chunks(texts, 1 << 19):
                kept = [n for n in b.schema.names if n != "text"]
                score = pa.array(known.predict(texts[i:j]), pa.float64())
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, j - i) for n in kept), score], names=[*kept, "score"])

    return predict


def scores(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns `keep` and score."""
    spark = prepared(docs.sparkSession)
    own = docs.select(*[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)], text_bytes(text_col).alias("text"))
    schema = extended(own.schema, ("text",), "score double")
    found = own.mapInArrow(_predict(spark.sparkContext.broadcast(model)), schema)
    return found.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], "score")
