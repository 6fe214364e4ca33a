"""Packing documents in sequences along a space-filling curve.

A document's tokens are hashed to a few projected coordinates, the mean over its tokens is put on a grid, and its place on
the Hilbert curve through that grid is its key. Documents are range-sorted by key and laid end to end; every `length`
tokens a sequence ends, so neighbours on the curve, which share much of their wording, share sequences. What is left at
the end of a partition is cut in sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; null doc_ids are kept; equal keys
are ordered by doc_id, then a hash of the tokens; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneldrift.llm import tokens
from paneldrift.session import stored

DIMENSIONS, BITS = 4, 15
LENGTH = 1024


def projection(ids: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    """Random coordinates of token ids: each is a hash of id and dimension, spread evenly over -1..1."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(dimensions, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * (2.0 / (1 << 53)) - 1.0


def grid(means: np.ndarray, lengths: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Means of coordinates on a grid of 2**bits: the sign-keeping square root spreads values near zero."""
    spread = np.sign(means) * np.sqrt(np.abs(means))
    return np.clip((spread + 1.0) * (1 << (bits - 1)), 0, (1 << bits) - 1).astype(np.uint64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of grid points (rows) on the Hilbert curve; axes are transposed bit by bit, for all points at once."""
    x = [points[:, k].astype(np.uint64) for k in range(points.shape[1])]
    zero = np.uint64(0)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for k in range(len(x)):
            turned = (x[k] & bit) != zero
            swap = np.where(turned, zero, (x[0] ^ x[k]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros(len(points), np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(level)) & np.uint64(1) != zero, np.uint64((1 << level) - 1), zero)
    key = np.zeros(len(points), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << np.uint64(1)) | (((axis ^ flip) >> np.uint64(level)) & np.uint64(1))
    return key.astype(np.int64)


def keyed(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int) -> DataFrame:
    """doc_id, curve key, and the document's ids, compressed, with the end id."""

    def rows(frames):
        import pyarrow as pa
        import zstandard

        enc, end, zip_ = tokens.encoder(tokenizer, spaced), np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=1)
        table = projection(np.arange(1 << 16))
        for frame in frames:
            for piece in tokens.batches(frame):
                ids = [x + end for x in enc.encode([t or "" for t in piece.column("text").to_pylist()])]
                flat = np.frombuffer(b"".join(ids), "<u4")
                lengths = np.array([len(x) // 4 for x in ids])
                known = len(flat) == 0 or int(flat.max()) < len(table)
                sums = np.add.reduceat(table[flat] if known else projection(flat), np.cumsum(lengths) - lengths, axis=0)
                keys = hilbert(grid(sums / lengths[:, None], lengths))
                narrow = flat.astype("<u2") if known else flat
                cuts = np.cumsum(lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "key": pa.array(keys), "n": pa.array(lengths),
                    "ids": pa.array([zip_.compress(narrow[e - n : e].tobytes()) for e, n in zip(cuts, lengths)], pa.binary()),
                })
        tokens.release()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(rows, "doc_id bigint, key bigint, n bigint, ids binary")


def pack(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""

    def packed(frames):
        import pyarrow as pa
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        sequence, used = TaskContext.get().partitionId() << 40, 0
        full, open_ = [], []  # pieces of finished sequences, and of the one being filled

        def batch(pieces):
            names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
            kinds = (*[pa.int64()] * 6, pa.binary())
            return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, zip(*pieces), kinds)})

        for frame in frames:
            for doc, n, zipped in zip(*(frame.column(c) for c in ("doc_id", "n", "ids"))):
                doc, n, raw = doc.as_py(), n.as_py(), unzip.decompress(zipped.as_py())
                ids = (np.frombuffer(raw, "<u2").astype("<u4") if len(raw) == 2 * n else np.frombuffer(raw, "<u4")).tobytes()
                start = 0
                while start < n:
                    take = min(length - used, n - start)
                    open_.append((doc, start, take, n, sequence, used, ids[4 * start : 4 * (start + take)]))
                    start, used = start + take, used + take
                    if used == length:
                        full, open_, sequence, used = full + open_, [], sequence + 1, 0
                if len(full) >= 512:
                    yield batch(full)
                    full = []
        # The rest, in sequences of falling powers of two.
        end, cut = 0, []
        for k in reversed(range(used.bit_length())):
            if used >> k & 1:
                cut.append((end, end + (1 << k)))
                end += 1 << k
        for number, (a, b) in enumerate(cut):
            for doc, start, take, n, _, offset, ids in open_:
                x, y = max(a, offset), min(b, offset + take)
                if x < y:
                    full.append((doc, start + x - offset, y - x, n, sequence + number, x - a, ids[4 * (x - offset) : 4 * (y - offset)]))
        if full:
            yield batch(full)

    # Stored, so that ranging does not tokenize twice.
    rows = stored(keyed(docs, tokenizer, spaced, end_id)).withColumn("tie", F.xxhash64("ids"))
    ordered = rows.repartitionByRange("key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie").drop("tie")
    return ordered.mapInArrow(packed, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
