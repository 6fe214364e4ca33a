"""Token ids in Simple-8b coding: each 64-bit word has a 4-bit selector and as many ids of equal width as fit.

Selector s of 1..14 packs COUNTS[s] ids of 60 // COUNTS[s] bits, lowest bits first. Selector 15 is the escape: the word
after it holds one id of up to 64 bits. Ids are cut in blocks of BLOCK; a block starts a new word, and the offsets of the
blocks' first words let a reader decode all blocks at the same time, or any one alone.

A file is a Parquet row group of chunks: part and place in ascending doc_id order, the documents' ids and lengths, the
words and the block offsets. `write_tokens` writes, `read_tokens` reads.

Defined results: a null or empty text has the end id only; null doc_ids come first; equal doc_ids follow each other,
ordered by a hash of the text; extra columns are ignored; an empty table gives an empty file.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneldrift.llm import tokens

# Ids in a word by selector; 0 is no selector, 15 the escape.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 1024
#: Ids of a chunk, about; documents are not divided.
CHUNK = 1 << 20

CHUNKS = "part int, number int, start bigint, doc_ids array<bigint>, lengths array<int>, words binary, offsets binary"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and the blocks' first words. All blocks advance together, one word at a time."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.zeros(0, np.int64)
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[:n] = ids
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    # How many ids a word takes from each place on: the largest count whose width holds all of them; 0 is an escape.
    bits = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)  # number of binary digits, exact below 2**53
    large = np.flatnonzero(bits > 52)
    bits[large] = [int(x).bit_length() for x in grid[large]]
    narrow = int(bits[:n].min())
    take = (bits <= 60).astype(np.uint8)
    bits[n:] = 255  # no word reaches behind the end
    # Most digits among `count` ids from each place on, made of those of the count before, which is half as large at least.
    most, before = bits.reshape(blocks, BLOCK), 1
    for count in COUNTS[-2:0:-1]:
        if narrow > 60 // count:
            break  # nor does any larger count fit anywhere
        upto = BLOCK - count + 1
        most, before = np.maximum(most[:, :upto], most[:, count - before : count - before + upto]), count
        np.copyto(take.reshape(blocks, BLOCK)[:, :upto], np.uint8(count), where=most <= 60 // count)
    take = take.astype(np.int64)
    at, base = np.zeros(blocks, np.int64), np.arange(blocks) * BLOCK
    selector = np.zeros(61, np.uint64)
    selector[list(COUNTS[1:])] = np.arange(1, len(COUNTS))
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # block, place, count
    open_ = np.arange(blocks)
    while len(open_):
        place = base[open_] + at[open_]
        count = take[place]
        made.append((open_, place, count))
        at[open_] += np.maximum(count, 1)
        open_ = open_[at[open_] < size[open_]]
    block, place, count = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(place)
    block, place, count = block[order], place[order], count[order]
    width = np.where(count == 0, 2, 1)
    first = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[first] = np.where(count == 0, np.uint64(ESCAPE), selector[count]) << np.uint64(60)
    words[first[count == 0] + 1] = grid[place[count == 0]]
    for c in np.unique(count[count > 0]):
        here = count == c
        values = grid[place[here][:, None] + np.arange(c)]
        words[first[here]] |= np.bitwise_or.reduce(values << (np.arange(c) * (60 // c)).astype(np.uint64), axis=1)
    return words, first[np.searchsorted(block, np.arange(blocks))]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """All blocks at once: the escapes are found by walking runs of selector words, the rest is taken by selector."""
    words = np.asarray(words, dtype=np.uint64)
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero(selector == ESCAPE):  # rare: a raw word that looks like an escape follows one
        if not raw[k]:
            raw[k + 1] = True
    head = np.flatnonzero(~raw)
    kind = selector[head]
    if ((kind == 0) | (kind > ESCAPE)).any():
        raise ValueError("not a Simple-8b stream")
    count = np.where(kind == ESCAPE, 1, np.array([*COUNTS, 1])[kind])
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    if len(out) != n or (start[np.searchsorted(head, offsets)] != np.arange(len(offsets)) * BLOCK).any():
        raise ValueError("block offsets do not match the words")
    for s in np.unique(kind):
        here = kind == s
        if s == ESCAPE:
            out[start[here]] = words[head[here] + 1]
            continue
        c = COUNTS[s]
        bits = 60 // c
        values = (words[head[here]][:, None] >> (np.arange(c) * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
        out[start[here][:, None] + np.arange(c)] = values
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """The ids of one block alone."""
    upto = offsets[block + 1] if block + 1 < len(offsets) else len(words)
    return decode(words[offsets[block] : upto], np.zeros(1, np.int64), min(BLOCK, n - block * BLOCK))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, spaced: bool, end_id: int) -> None:
    """Encode every text and write the files in ascending doc_id order. Workers keep their store of pieces from task to task: no later
    stage holds much."""

    def encoded(frames):
        import pyarrow as pa

        enc, end = tokens.encoder(tokenizer, spaced), np.array([end_id], "<u4").tobytes()
        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids, docs_, held = [], [], 0

        def chunk():
            nonlocal number, start, ids, docs_, held
            flat = np.frombuffer(b"".join(ids), "<u4")
            words, offsets = encode(flat)
            row = {"part": part, "number": number, "start": start, "doc_ids": docs_, "lengths": [len(x) // 4 for x in ids],
                   "words": words.astype("<u8").tobytes(), "offsets": offsets.astype("<i8").tobytes()}
            number, start, ids, docs_, held = number + 1, start + len(flat), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                            ("lengths", pa.list_(pa.int32())), ("words", pa.binary()), ("offsets", pa.binary())])
        for frame in frames:
            for piece in tokens.batches(frame):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                for doc, got in zip(piece.column("doc_id").to_pylist(), enc.encode(texts)):
                    ids.append(got + end)
                    docs_.append(doc)
                    held += len(got) // 4 + 1
                    if held >= CHUNK:
                        yield chunk()
        if docs_:
            yield chunk()

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(encoded, CHUNKS).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document in the files."""
    chunks = spark.read.schema(CHUNKS).parquet(folder)

    def decoded(frames):
        import pyarrow as pa

        for frame in frames:
            for row in (r for k in range(frame.num_rows) for r in frame.slice(k, 1).to_pylist()):
                lengths = np.array(row["lengths"], np.int64)
                offsets = np.frombuffer(row["offsets"], "<i8")
                flat = decode(np.frombuffer(row["words"], "<u8"), offsets, int(lengths.sum())).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                for i in range(0, len(lengths), 256):
                    cut = slice(i, i + 256)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([row["part"]] * len(lengths[cut]), pa.int32()), "doc_id": pa.array(row["doc_ids"][cut], pa.int64()),
                        "inner": pa.array(row["start"] + ends[cut] - lengths[cut]), "n_tokens": pa.array(lengths[cut]),
                        "ids": pa.array([flat[4 * (e - n) : 4 * e] for e, n in zip(ends[cut], lengths[cut])], pa.binary()),
                    })

    # One row per written part, as many as there are partitions.
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = chunks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    bases = sizes.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    rows = chunks.mapInArrow(decoded, "part int, doc_id bigint, inner bigint, n_tokens bigint, ids binary")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids")
