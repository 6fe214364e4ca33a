"""Exact top-k by inner product: a Voronoi join.

Vectors are made whole numbers and equal ones are folded to one (its k + 1 smallest ids are enough for any answer).
Pivots are a bounded sample of the vectors. Each vector goes to the cell of the pivot at the least angle, each cell is cut
into up to RINGS rings by that angle, and each ring is summed up by its count, its least and largest angle to the pivot, its largest
norm and its largest distance. The summaries bound every score of a ring from above. A query goes to its most promising ring
first; the k-th score found there, or among the pivots if that is higher, bounds its answer from below, and it then goes
to the rings that may hold better ones only. Rings are cut in blocks, a task holds one block and streams the queries past it,
and the blocks' answers are merged.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; only vectors of
the same length are compared (each length is a search of its own, with jobs of its own). A row is known by its id: rows of the
query's own id are not candidates, an id with several vectors scores the highest product of any vector of the query's id with any
of its own, and every id is listed once. Ties go to the smaller id; fewer candidates give fewer rows; a zero vector scores 0
with all; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneldrift.session import stored

#: Bounded sample that the driver holds; cells do not grow with it but in number.
PIVOTS = 256
#: Rows of a block: the vectors over the number of tasks, within these.
LEAST_BLOCK, MOST_BLOCK = 256, 16384
#: Rings of a cell at most; fewer where a ring would have less than a block.
RINGS = 4
#: Copies of the answers for queries with equal vectors.
SALTS = 16


def whole(df: DataFrame, scale: int) -> DataFrame:
    """vec_id, v (array<bigint>) and key (hash of v) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    rows = rows.select(F.col("vec_id").cast("bigint"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
    return rows.withColumn("key", F.md5(F.array_join(F.col("v").cast("array<string>"), ",")))


class Cells:
    """Pivots and bounds; small, and the same in every task."""

    def __init__(self, pivots: np.ndarray, ids: list[int], rings: int = 1):
        self.rings = rings
        self.pivots = pivots.astype(np.float64)
        self.apart = np.unique(np.array(ids), return_index=True)[1]
        norms = np.linalg.norm(self.pivots, axis=1)
        self.unit = self.pivots / np.where(norms == 0, 1, norms)[:, None]

    def place(self, x: np.ndarray):
        """Cell, angle to its pivot, norm and distance from the pivot of each row."""
        norm = np.linalg.norm(x, axis=1)
        cosine = x @ self.unit.T / np.where(norm == 0, 1, norm)[:, None]
        cell = cosine.argmax(axis=1)
        angle = np.arccos(np.clip(cosine[np.arange(len(x)), cell], -1, 1))
        return cell, angle, norm, np.linalg.norm(x - self.pivots[cell], axis=1)

    def bounds(self, q: np.ndarray, k: int, most: dict) -> tuple[np.ndarray, np.ndarray]:
        """For each query the highest score that each ring may hold, and a score that k + 1 ids reach at least."""
        scores = q @ self.pivots.T
        norm = np.linalg.norm(q, axis=1)
        # Pivots are vectors of the data, one of them perhaps the query's; of those with one first id one counts.
        told = scores[:, self.apart]
        least = np.sort(told, axis=1)[:, -k - 1] if told.shape[1] > k else np.full(len(q), -np.inf)
        cosine = q @ self.unit.T / np.where(norm == 0, 1, norm)[:, None]
        angle = np.repeat(np.arccos(np.clip(cosine, -1, 1)), self.rings, axis=1)
        gap = np.maximum(np.maximum(angle - most["angle"], most["least_angle"] - angle), 0)
        by_angle = np.cos(gap) * norm[:, None] * np.where(np.cos(gap) >= 0, most["norm"], most["least_norm"])
        by_distance = np.repeat(scores, self.rings, axis=1) + norm[:, None] * most["distance"]
        slack = 1e-6 * (1 + norm[:, None] * np.maximum(most["norm"], 1))
        return np.where(most["n"] > 0, np.minimum(by_angle, by_distance) + slack, -np.inf), least


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact: in doubles where no sum can pass 2**53, else in 64-bit whole numbers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _best(score: np.ndarray, ids: list, k: int):
    """The k best (-score, id) of one query in one block, every id once."""
    take = k
    while True:
        keep = np.flatnonzero(score >= np.partition(score, -take)[-take]) if len(score) > take else np.arange(len(score))
        best: dict[int, int] = {}
        for least, id_ in sorted((-int(score[i]), id_) for i in keep for id_ in ids[i]):
            best.setdefault(id_, least)
        if len(best) >= k or len(keep) == len(score):
            return [(least, id_) for id_, least in best.items()][:k]
        take *= 4


def top_k(df: DataFrame, is_query, k: int = 5, scale: int = 256, pivots: int = PIVOTS, least_block: int = LEAST_BLOCK, visits: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for every row of vec_id, embedding where `is_query` holds.

    `visits` adds up how many times a query was sent to a ring, for a look at the pruning.
    """
    spark = df.sparkSession
    vectors = whole(df, scale)
    # Of equal vectors only the smallest ids can be answers; the limit works before the shuffle.
    few = vectors.withColumn("r", F.dense_rank().over(W.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = stored(few.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids")))
    queries = vectors.where(is_query).select("vec_id", "v", "key")
    asked = queries.groupBy("key").agg(F.first("v").alias("v"))
    answers = None
    # Vectors of one length are usual; each length is a search of its own.
    lengths = [r[0] for r in distinct.select(F.size("v")).distinct().collect() if r[0] > 0]
    for length in lengths:
        part = distinct.where(F.size("v") == length)
        found = _search(spark, part, asked.where(F.size("v") == length), k, pivots, least_block, visits)
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    best = W.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    once = answers.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    merged = once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = merged.groupBy("key").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = queries.select(F.col("vec_id").alias("query_id"), "key", F.pmod(F.hash("vec_id"), F.lit(SALTS)).alias("salt")).distinct()
    told = rows.join(lists, ["key", "salt"]).select("query_id", F.explode("found").alias("x")).where(F.col("x.vec_id") != F.col("query_id"))
    pairs = told.groupBy("query_id", F.col("x.vec_id").alias("vec_id")).agg(F.max("x.score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(spark, part: DataFrame, asked: DataFrame, k: int, pivots: int, least_block: int, visits: Accumulator | None) -> DataFrame:
    """key, score, vec_id: the k + 1 best of every asked vector in every block it was sent to."""
    sample = part.select("v", "ids", F.xxhash64("key").alias("h")).orderBy("h").limit(pivots).collect()
    rings = int(min(max(part.count() / (len(sample) * least_block), 1), RINGS))
    cells = Cells(np.array([r["v"] for r in sample], np.float64), [r["ids"][0] for r in sample], rings)

    def placed(frames):
        import pyarrow as pa

        for frame in frames:
            if frame.num_rows:
                x = _matrix(frame.column("v")).astype(np.float64)
                cell, angle, norm, distance = cells.place(x)
                yield pa.RecordBatch.from_arrays(
                    [*frame.columns, pa.array(cell.astype(np.int32)), pa.array(angle), pa.array(norm), pa.array(distance)],
                    [*frame.schema.names, "cell", "angle", "norm", "distance"],
                )

    near = stored(part.select("key", "v", "ids").mapInArrow(
        placed, "key string, v array<bigint>, ids array<bigint>, cell int, angle double, norm double, distance double"))
    # One row per pivot, then one per ring.
    at = near
    if rings > 1:
        cuts = near.groupBy("cell").agg(F.percentile_approx("angle", [i / rings for i in range(1, rings)]).alias("cuts")).collect()
        bounds = {r["cell"]: r["cuts"] for r in cuts}
        listed = F.array(*(F.array(*(F.lit(float(c)) for c in bounds.get(i, [0.0] * (rings - 1)))) for i in range(len(sample))))
        ring = F.size(F.filter(F.element_at(listed, F.col("cell") + 1), lambda c: c < F.col("angle")))
        at = near.withColumn("cell", F.col("cell") * rings + ring)
    sums = at.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.min("angle").alias("least_angle"), F.max("norm").alias("norm"),
                                  F.min("norm").alias("least_norm"), F.max("distance").alias("distance")).collect()
    most = {n: np.zeros(len(sample) * rings) for n in ("n", "angle", "least_angle", "norm", "least_norm", "distance")}
    for row in sums:
        for name, values in most.items():
            values[row["cell"]] = row[name]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = int(min(max(most["n"].sum() / tasks, least_block), MOST_BLOCK))
    blocks = np.maximum(np.ceil(most["n"] / block), 1).astype(np.int64)

    def sent(first: bool):
        def send(frames):
            import pyarrow as pa

            for frame in frames:
                for i in range(0, frame.num_rows, 256):
                    piece = frame.slice(i, 256)
                    above, least = cells.bounds(_matrix(piece.column("v")).astype(np.float64), k, most)
                    start = above.argmax(axis=1)
                    if first:
                        row, cell = np.arange(len(start)), start
                    else:
                        known = piece.column("least").to_numpy(zero_copy_only=False)  # NaN where fewer than k + 1 were found
                        least = np.fmax(least, known)
                        wanted = above >= least[:, None]
                        wanted[np.arange(len(start)), start] = False
                        row, cell = np.nonzero(wanted)
                    if visits is not None:
                        visits.add(len(row))
                    n = blocks[cell]
                    row, cell = np.repeat(row, n), np.repeat(cell, n)
                    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    for j in range(0, len(row), 4096):
                        cut = slice(j, j + 4096)
                        yield pa.RecordBatch.from_arrays(
                            [piece.column("key").take(pa.array(row[cut])), piece.column("v").take(pa.array(row[cut])), pa.array(cell[cut].astype(np.int32)), pa.array(number[cut].astype(np.int32)), pa.array(least[row[cut]])],
                            ["key", "v", "cell", "block", "least"],
                        )

        return send

    def solved(frames):
        import pyarrow as pa

        here, xs, ids, x = None, [], [], None
        for frame in frames:
            cell, block_, asks = (frame.column(c).to_numpy() for c in ("cell", "block", "asks"))
            place = (cell.astype(np.int64) << 32) | block_
            edges = np.flatnonzero(np.diff(place * 2 + asks)) + 1
            for a, b in zip([0, *edges], [*edges, len(place)]):
                piece = frame.slice(a, b - a)
                if here != place[a]:
                    here, xs, ids, x = place[a], [], [], None
                if not asks[a]:
                    xs.append(_matrix(piece.column("v")))
                    ids += piece.column("ids").to_pylist()
                    continue
                if not xs:
                    continue
                x = np.concatenate(xs) if x is None else x
                for i in range(0, b - a, 256):
                    few = piece.slice(i, 256)
                    least = few.column("least").to_numpy()  # what k + 1 ids reach anyhow
                    best = [[y for y in _best(s, ids, k + 1) if -y[0] >= low] for s, low in zip(_scores(_matrix(few.column("v")), x), least)]
                    yield pa.RecordBatch.from_arrays(
                        [few.column("key").take(pa.array(np.repeat(np.arange(len(best)), [len(x_) for x_ in best]))),
                         pa.array([-s for each in best for s, _ in each], pa.int64()), pa.array([i_ for each in best for _, i_ in each], pa.int64())],
                        ["key", "score", "vec_id"],
                    )

    count = F.element_at(F.array(*(F.lit(int(n)) for n in blocks)), F.col("cell") + 1)
    data = at.select("key", "v", "ids", "cell", F.pmod(F.xxhash64("key"), count).cast("int").alias("block"), F.lit(0).alias("asks"))

    def answered(ask: DataFrame) -> DataFrame:
        both = data.unionByName(ask.withColumn("asks", F.lit(1)), allowMissingColumns=True)
        dealt = both.repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block", "asks")
        return dealt.mapInArrow(solved, "key string, score bigint, vec_id bigint")

    place = "key string, v array<bigint>, cell int, block int, least double"
    once = stored(answered(asked.select("key", "v").mapInArrow(sent(True), place)))
    found = once.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    nth = found.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") == k + 1)
    more = asked.select("key", "v").join(nth.select("key", F.col("score").cast("double").alias("least")), "key", "left")
    return once.unionByName(answered(more.mapInArrow(sent(False), place)))
