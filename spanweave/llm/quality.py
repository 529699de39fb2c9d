"""Quality classifier: supervised subword embeddings, learned by stochastic gradient descent in numpy.

A document's features are hashed n-grams: each word, each run of 3 or 4 characters of a word between word marks, and
each two words in a row; two equal words in a row are also a feature that all such pairs share, as their own is unseen
where the word is rare. Each feature has a learned vector; a document's vector is their average over all occurrences; a
softmax over a linear layer gives the label. Once learned, a feature's vector matters only through its product with that
layer, so a word's share of the score is one number that workers remember.

Learning takes a bounded sample of labelled rows (limit, 4,000 by default, and 64 MB), whole texts; scoring covers every
row and whole text where the row is read, without a shuffle.

Defined cases: null and empty text have no features and the score of the bias alone; without labelled rows of both
kinds every score is the share of label 1 (0.5 without labels); repeated rows score alike; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts, worker_cache
from .samples import labelled_sample

#: Buckets of words and character runs, of word pairs, which come after them, and in all: the last is that of equal words.
BUCKETS, PAIRS = 1 << 16, 1 << 18
ALL = BUCKETS + PAIRS + 1
DIM, EPOCHS, RATE, STEP, SEED = 8, 6, 0.5, 1.0, 17
SAMPLE = 4000
REMEMBERED = 150_000


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its character runs."""
    marked = f"<{word}>".encode("utf-8", "surrogatepass") if word.isascii() else None
    crc = zlib.crc32
    if marked is not None:
        n = len(marked)
        grams = [marked[i : i + 3] for i in range(n - 2)] + [marked[i : i + 4] for i in range(n - 3)]
    else:
        text = f"<{word}>"
        n = len(text)
        grams = [text[i : i + k].encode("utf-8", "surrogatepass") for k in (3, 4) for i in range(n - k + 1)]
    return [crc(b"\x01" + word.encode("utf-8", "surrogatepass")) % BUCKETS, *[crc(g) % BUCKETS for g in grams]]


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"), 0x5A17)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of each two words in a row, from the words' 32-bit hashes; then one for each two equal ones."""
    mixed = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    own = BUCKETS + ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64) % PAIRS
    return np.concatenate([own, np.full(np.count_nonzero(hashes[:-1] == hashes[1:]), ALL - 1)])


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    words = text.split()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    hashes = {w: word_hash(w) for w in counts}
    buckets, times = [], []
    for w, n in counts.items():
        f = word_features(w)
        buckets += f
        times += [n] * len(f)
    pairs = pair_buckets(np.array([hashes[w] for w in words], dtype=np.uint64)) if words else np.empty(0, np.int64)
    found, at = np.unique(np.concatenate([np.array(buckets, dtype=np.int64), pairs]), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate([times, np.ones(len(pairs))]), minlength=len(found))


class Model:
    """weight: each bucket's vector times the difference of the softmax rows of labels 1 and 0; bias: theirs."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight, bias

    def score(self, text: str) -> float:
        found, times = document_features(text)
        z = self.bias + (float(self.weight[found] @ times) / times.sum() if len(found) else 0.0)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def gradients(vectors: np.ndarray, share: np.ndarray, layer: np.ndarray, bias: np.ndarray, y: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The loss (minus the log-probability of label y) and its gradients by the features' vectors, the layer and the bias."""
    hidden = share @ vectors
    z = hidden @ layer + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    loss = -math.log(max(float(p[y]), 1e-300))
    p[y] -= 1.0
    return loss, np.outer(share, layer @ p), np.outer(hidden, p), p


def train(rows: list[tuple[str, int]]) -> Model:
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        p = min(max(ones / len(rows), 1e-3), 1 - 1e-3) if rows else 0.5
        return Model(np.zeros(ALL), math.log(p / (1 - p)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (ALL, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    seen = []
    for text, y in rows:
        found, times = document_features(text)
        seen.append((found.astype(np.int32), (times / max(times.sum(), 1.0)).astype(np.float32), y))
    steps, total = 0, EPOCHS * len(seen)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(seen)):
            found, share, y = seen[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            _, d_vectors, d_layer, d_bias = gradients(vectors[found], share, layer, bias, y)
            layer -= rate * d_layer
            bias -= rate * 0.1 * d_bias
            # A step along the gradient, as long as moves the document's own vector by the rate, however many features.
            vectors[found] -= rate * STEP / max(float(share @ share), 1e-12) * d_vectors
    side = layer[:, 1] - layer[:, 0]
    return Model(vectors @ side, float(bias[1] - bias[0]))


class _Words(dict):
    """Places of words in three tables: a word's summed weight, its number of features and its hash."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight = weight.tolist()
        self.sums, self.counts, self.hashes = np.empty(1 << 12), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.uint64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.sums):
            self.sums, self.counts, self.hashes = (np.concatenate([x, np.empty_like(x)]) for x in (self.sums, self.counts, self.hashes))
        f, w = word_features(word), self.weight
        self.sums[at], self.counts[at], self.hashes[at] = sum([w[i] for i in f]), len(f), word_hash(word)
        return at

    def features(self, text: str) -> tuple[float, int, np.ndarray]:
        """The summed weights of the features of a text's words, their number, and the buckets of its pairs."""
        if len(self) > REMEMBERED:
            self.clear()
        words = text.split()
        if not words:
            return 0.0, 0, np.empty(0, np.int64)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return float(self.sums[at].sum()), int(self.counts[at].sum()), pair_buckets(self.hashes[at])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = SAMPLE, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    return train(labelled_sample(docs, labels, label, learn, limit, id_col, text_col))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, out: str = "score") -> DataFrame:
    """The id (with keep: all columns) of each row and its score in [0, 1], in a column named out. The model has a fixed size."""
    shared, key = df.sparkSession.sparkContext.broadcast((model.weight.astype(np.float64), model.bias)), uuid.uuid4().hex

    def of(batch: pa.RecordBatch) -> dict:
        weight, bias = shared.value
        known, scores = worker_cache(key, lambda: _Words(weight[:BUCKETS])), []
        for text in texts(batch.column(at)):
            total, n, pairs = known.features(text)
            if len(pairs):
                total, n = total + float(weight[pairs].sum()), n + len(pairs)
            z = bias + (total / n if n else 0.0)
            scores.append(1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z)))))
        return {c: batch.column(i) for i, c in enumerate(columns)} | {out: scores}

    columns = df.columns if keep else [id_col]
    read, at = (df, df.columns.index(text_col)) if keep else (df.select(id_col, text_col), 1)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns] + [f"`{out}` double"])
    return map_arrow(read, of, schema, keeps=True)
