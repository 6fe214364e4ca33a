"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are the distinct words and word pairs of a text, and the same of its word shapes (letters folded to a or A, digits to
0, runs shortened), hashed to 2**BITS places, each with the same value, so that together they have length 1. Two more
n-grams, of value 1, tell in eighths which share of the word pairs is new in the text, and which has its word twice. Training
goes over labelled rows one by one in the order of a hash of doc_id, in one task that holds the weights and one batch of
rows; scoring is a sparse dot product in any task.

Bounds, as parameters: at most TRAINED labelled rows are learnt from (those with the smallest hashes), EPOCHS times; the weights are
2**BITS numbers, and so of fixed size when sent to the tasks. Everything else covers all rows.

Defined results: a null or empty text has the bias alone; rows with a null label, a null doc_id or no document teach nothing; of
several labels of a document the mean counts, a half being 1; without any label every score is 0.5; repeated rows are scored
each; other columns are ignored by `score` and kept by `keep_good`; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneldrift.llm.tokens import batches

BITS = 18
TRAINED = 8192
EPOCHS = 4
THRESHOLD = 0.3
# Step and regularisation of the updates.
ALPHA, BETA, L1, L2 = 10.0, 1.0, 1e-4, 1e-4

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans({**{c: "a" for c in "bcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "BCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "123456789"}})
_RUN = re.compile(r"(.)\1+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: N-grams of value 1 at the end of a text's features.
SHARES = 2
#: Distinct words whose hashes a worker keeps.
CACHE = 150_000


def shape(word: str) -> str:
    folded = "".join(c if c < "\x80" else "a" if c.islower() else "A" if c.isupper() else c for c in word.translate(_FOLD))
    return _RUN.sub(r"\1", folded)


class Hasher:
    """Features of texts; words are hashed once."""

    def __init__(self, bits: int = BITS):
        self.words: dict[str, int] = {}
        self.hashes = np.empty((0, 2), np.uint64)
        self.shift = np.uint64(64 - bits)

    def _learn(self, new: list[str]) -> None:
        if len(self.words) > CACHE:
            self.words, self.hashes = {}, np.empty((0, 2), np.uint64)
        start = len(self.words)
        self.words.update(zip(new, range(start, start + len(new))))
        made = [(zlib.crc32(w.encode()), zlib.crc32(b"\0" + shape(w).encode())) for w in new]
        self.hashes = np.concatenate([self.hashes, (np.array(made, np.uint64).reshape(-1, 2) + np.uint64(1)) * _MIX])

    def features(self, text: str) -> np.ndarray:
        words = _WORD.findall(text)
        if not words:
            return np.empty(0, np.int64)
        if new := set(words).difference(self.words):
            if len(self.words) > CACHE:
                new = set(words)
            self._learn(list(new))
        h = self.hashes[np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))]
        pairs = (h[:-1] * np.uint64(3) + (h[1:] ^ (h[1:] >> np.uint64(29)))) * _MIX
        n = max(len(pairs), 1)
        shares = 8 * len(np.unique(pairs[:, 0])) // n, 16 + 8 * int((h[1:, 0] == h[:-1, 0]).sum()) // n
        grams = np.unique(np.concatenate([h.ravel(), pairs.ravel()]) >> self.shift)
        return np.append(grams, ((np.array(shares, np.uint64) + np.uint64(1)) * _MIX) >> self.shift).astype(np.int64)


class Ftrl:
    """Weights by follow-the-regularised-leader: sums of gradients, and of their squares, per place."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, len(self.z) - 1)  # the last place is the bias
        value = np.ones(len(at))
        value[: -SHARES - 1] = 1.0 / np.sqrt(max(len(at) - SHARES - 1, 1))
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        np.add.at(self.z, at, g - sigma * w)  # the last n-grams may share a place
        np.add.at(self.n, at, g * g)


def score_of(weights: np.ndarray, at: np.ndarray) -> float:
    total = weights[-1]
    if len(at):
        total += weights[at[:-SHARES]].sum() / np.sqrt(max(len(at) - SHARES, 1)) + weights[at[-SHARES:]].sum()
    return float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINED, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights from `labels` (doc_id, quality), held-out rows excepted."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality"))

    def featured(frames):
        import pyarrow as pa

        hasher = Hasher(bits)
        for frame in frames:
            for piece in batches(frame):
                at = [hasher.features(t or "").astype("<i4").tobytes() for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), pa.array(at, pa.binary())], ["doc_id", "quality", "at"])

    def learnt(frames):
        import pyarrow as pa

        model = Ftrl(bits)
        for frame in frames:
            for at, label in zip(frame.column("at"), frame.column("quality")):
                model.learn(np.frombuffer(at.as_py(), "<i4"), label.as_py())
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights().astype("<f4").tobytes()], pa.binary())})

    rows = texts.mapInArrow(featured, "doc_id bigint, quality int, at binary")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = rows.repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id"), "doc_id")
    made = ordered.mapInArrow(learnt, "weights binary").collect()  # none where no row is labelled
    return np.frombuffer(made[0]["weights"], "<f4").astype(np.float64) if made else np.zeros((1 << bits) + 1)


def scored(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """docs with the column `score` behind its own."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits + 1 numbers at any size of docs

    def rows(frames):
        import pyarrow as pa

        hasher = Hasher(bits)
        for frame in frames:
            for piece in batches(frame):
                made = [score_of(sent.value, hasher.features(t or "")) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(made, pa.float64())], schema=piece.schema.append(pa.field("score", pa.float64())))

    return docs.mapInArrow(rows, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, score double")


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    only = docs.select(F.col("doc_id").cast("bigint"), "text")
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    slim = scored(only, train(docs, labels)).select("doc_id", held.alias("held_out"), "score")
    return slim.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted good, with their columns."""
    inner = docs.select("text", F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    return scored(inner, train(docs, labels)).where(F.col("score") >= threshold).select("_row.*")
