"""Quality classifier: held-out accuracy, odd rows, and that nothing but the text enters a score."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from paneldrift.llm import quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def result(spark):
    return {r["doc_id"]: r for r in queries.op9_quality(spark, SF).collect()}


def test_held_out_accuracy(spark, result):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(labels[d], r) for d, r in result.items() if d in labels and r["held_out"]]
    good, bad = ([r["score"] for y, r in held if y == k] for k in (1, 0))
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.98
    assert all(r["predicted"] for y, r in held if y == 1)
    assert sum(r["predicted"] for y, r in held if y == 0) <= 0.4 * len(bad)


def test_columns(spark, result):
    assert len(result) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in result.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_only_the_text_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels, most=50, epochs=1)
    other = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("x").alias("lang"), F.lit(None).cast("string").alias("source"))
    plain = {r["doc_id"]: r["score"] for r in quality.scored(docs, weights).collect()}
    assert plain == {r["doc_id"] - 1000: r["score"] for r in quality.scored(other, weights).collect()}


def test_weights_and_scores_of_a_plain_learner(spark):
    """The textbook updates, one coordinate at a time in dictionaries, on the same rows in the same order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bits, most, epochs = 12, 80, 2
    order = labels.where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).join(docs, "doc_id")
    rows = [(r["text"] or "", r["quality"]) for r in order.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    hasher, z, n = quality.Hasher(bits), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    def values(text):
        at = hasher.features(text).tolist()
        scale = 1 / math.sqrt(max(len(at) - quality.SHARES, 1))
        return [(i, 1.0 if k >= len(at) - quality.SHARES else scale) for k, i in enumerate(at)] + [(1 << bits, 1.0)]

    def predicted(text):
        return 1 / (1 + math.exp(-sum(weight(i) * v for i, v in values(text))))

    for _ in range(epochs):
        for text, label in rows:
            wrong = predicted(text) - label
            for i, w, g in [(i, weight(i), wrong * v) for i, v in values(text)]:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w
                n[i] = n.get(i, 0.0) + g * g
    got = quality.train(docs, labels, most=most, epochs=epochs, bits=bits)
    assert len(rows) == most and sum(w != 0 for w in got) > 1000
    assert got == pytest.approx([weight(i) for i in range((1 << bits) + 1)], rel=1e-4, abs=1e-4)
    some = docs.limit(30)
    for r in quality.scored(some, got, bits).collect():
        assert r["score"] == pytest.approx(predicted(r["text"] or ""), abs=1e-3)


def test_odd_rows(spark):
    kinds = "doc_id long, text string, quality string, _row string"
    docs = spark.createDataFrame([(1, None, "q", None), (2, "", "q", "r"), (None, "a b", None, None), (3, "a " * 50000, "q", None), (3, "a " * 50000, "q", None),
                                  (4, "fine words here", "q", "r")], kinds)
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quality.score(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in quality.score(docs, labels.where("false")).collect()} == {0.5}
    kept = quality.keep_good(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == 6


def test_shapes():
    assert quality.shape("HELLO!!!") == "A!" and quality.shape("Éte&&&") == "Aa&" and quality.shape("a1b22") == "a0a0"
