"""Language ID by error-correcting output codes.

Each language has a codeword; one binary classifier over byte n-grams predicts each bit, all of them trained
by gradient descent in numpy on at most SAMPLE labelled rows. Decoding takes the codeword with the least loss,
bits weighted by how well they did in training, and flags the row as ambiguous when the next one is close.

The languages are the values of the label column; each contributes an equal share of the sample, or all it
has, drawn from its different texts by a hash so that reruns agree; copies of a text count once. Where there
are more languages than SAMPLE, each has one row. Rows of the sample have at most SAMPLE_BYTES bytes;
predictions read whole texts. Null texts and texts without letters are `und`, score 0. With no labelled row at
all every prediction is `und`; with one language it is that one. Repeated rows get equal results, empty tables
none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlode.llm.common import batches, chunks, extended, prepared, stash, text_bytes
from medlode.llm.ngram_scores import hashed, joined, sums

#: Labelled rows that training gathers at most (but one a language), and their largest size.
SAMPLE = 3000
SAMPLE_BYTES = 1 << 17
SIZES = (1, 2, 3, 4)
BITS = 11
#: Least difference of the two best shares for a row not to be flagged.
MARGIN = 0.02


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """Codewords of k languages in +1 and -1: all distinct splits if k <= 7, else the best of random codes."""
    if k <= 1:
        return np.ones((max(k, 0), 1))
    if k <= 7:
        cols = [[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for i in range(k)] for c in range(2 ** (k - 1) - 1)]
        return np.array(cols, float).T
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(15 * np.log2(k)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, width))
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def features(blobs: list[bytes]) -> np.ndarray:
    """Mean counts of hashed n-grams, each n in its own buckets."""
    out = np.zeros((len(blobs), len(SIZES), 1 << BITS), np.float32)
    for i, j in chunks(blobs, 1 << 18):
        arr, begins, ends = joined(blobs[i:j], digits=False)
        own = np.concatenate([np.arange(a, z) for a, z in zip(begins, ends, strict=True)])
        row = np.repeat(np.arange(j - i), ends - begins) << BITS
        for k, (_, idx) in enumerate(hashed(arr, SIZES, BITS)):
            counts = np.bincount(row + idx[own], minlength=(j - i) << BITS).reshape(j - i, -1)
            out[i:j, k] = counts / (ends - begins)[:, None]
    return out.reshape(len(blobs), -1)


class Model:
    def __init__(self, blobs: list[bytes], labels: list[str], rounds: int = 100):
        self.langs = sorted(set(labels))
        self.code = codewords(len(self.langs))
        if len(self.langs) < 2:
            return
        x = features(blobs)
        y = self.code[np.searchsorted(self.langs, labels)].astype(np.float32)
        self.scale = np.float32(1 / max(float(np.sqrt((x**2).sum(1).mean())), 1e-6))
        x *= self.scale
        w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(y)
            dw = x.T @ g + 1e-6 * w
            m, v = 0.9 * m + 0.1 * dw, 0.99 * v + 0.01 * dw**2
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            b -= 0.5 * g.sum(0)
        self.w, self.b = np.ascontiguousarray((w * self.scale).T.reshape(y.shape[1], len(SIZES), -1)), b
        wrong = ((x @ w + b) * y <= 0).mean(0)
        self.trust = np.clip(1 - 2 * wrong, 0.05, 1)

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword of each row of bit scores, its share, and whether the next one is close."""
        loss = np.stack([(self.trust * np.logaddexp(0, -f * row)).sum(1) for row in self.code], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        top = np.sort(share, 1)
        return best, share.max(1), top[:, -1] - top[:, -2] < MARGIN

    def predict(self, blobs: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        if not self.langs:
            return ["und"] * len(blobs), [0.0] * len(blobs), [True] * len(blobs)
        if len(self.langs) == 1:
            return self.langs * len(blobs), [1.0] * len(blobs), [False] * len(blobs)
        arr, begins, ends = joined(blobs, digits=False)
        f = np.zeros((len(blobs), len(self.b)))
        for k, (_, idx) in enumerate(hashed(arr, SIZES, BITS)):
            for bit in range(len(self.b)):
                f[:, bit] += sums(self.w[bit, k][idx], begins, ends)
        f = f / (ends - begins)[:, None] + self.b
        best, share, close = self.decode(f)
        return [self.langs[k] for k in best], share.tolist(), close.tolist()


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows of docs where learn holds."""
    own = docs.where(learn & F.col(lang_col).isNotNull() & has_letter(text_col)).select(F.col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("text"))
    own = own.where(F.octet_length("text") <= SAMPLE_BYTES).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # a text counts once in a language, however many rows hold it
    texts = stash(own.select("lang", "digest").distinct(), "texts")
    counts = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], [])
    each = max(1, sample // len(counts))
    # so many that fewer than `each` of a language that has them don't occur
    most = each + 8 * each**0.5 + 24
    ceil = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most / n))])[F.col("lang")]
    rank = F.xxhash64("digest")
    near = texts.where(F.pmod(rank, F.lit(1 << 30)) < ceil * (1 << 30))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(rank, F.lit(1 << 30)), "digest"))).where(F.col("place") <= each).drop("place")
    rows = own.join(F.broadcast(near), ["lang", "digest"]).groupBy("lang", "digest").agg(F.first("text").alias("text")).collect()
    rows.sort(key=lambda r: (bytes(r.digest), r.lang))
    return Model([bytes(r.text) for r in rows], [r.lang for r in rows])


def _predict(model):
    def predict(source):
        known = model.value
        for b, texts in batches(source):
            for i, j in chunks(texts, 1 << 19):
                lang, score, close = known.predict(texts[i:j])
                letters = b.column("letters").slice(i, j - i).to_pylist()
                lang = [x if ok else "und" for x, ok in zip(lang, letters, strict=True)]
                score = [x if ok else 0.0 for x, ok in zip(score, letters, strict=True)]
                close = [x and ok for x, ok in zip(close, letters, strict=True)]
                kept = [n for n in b.schema.names if n not in ("text", "letters")]
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, j - i) for n in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=[*kept, "lang_pred", "score", "ambiguous"])

    return predict


def languages(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns `keep`, lang_pred, score, ambiguous."""
    spark = prepared(docs.sparkSession)
    own = docs.select(*[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)], text_bytes(text_col).alias("text"), has_letter(text_col).alias("letters"))
    schema = extended(own.schema, ("text", "letters"), "lang_pred string, score double, ambiguous boolean")
    found = own.mapInArrow(_predict(spark.sparkContext.broadcast(model)), schema)
    return found.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score", "ambiguous")
