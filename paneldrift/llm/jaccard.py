"""N-gram Jaccard join with several global token orders, and the components of its links.

A document is the set of its shingles of `rule.shingle` words (64-bit hashes; sets are told apart by 64-bit hashes too). Equal sets are one
class. OWN is the rule of op4, four words and 0.85; callers may give another similarity of at least a half.

* Orders: shingles go by how common they are (counts of a fixed-size sketch over all documents), equally common ones by one of
  ORDERS different hashes. Two sets that are alike enough share a shingle among the first n - ceil(similarity x n) + 1 of each, in every order.
* The first order brings candidates together. A pair must pass by size and by parities (of how many shingles fall in each of 512 groups,
  and of as many groups as shingles for larger sets), which bound the difference of two sets from below.
* The classes of such pairs tell their prefixes in the other orders as 16-bit hashes, and only pairs that share one in every order go
  on: the filters are intersected before any set is moved, and what a pair carries through a shuffle is its sizes and parities.
* Copies are not expanded to pairs. In a first pass each prefix shingle links its sets only to the first and to the neighbouring
  one; links verified there make components. In a second pass all pairs of sets that share a prefix shingle and are not yet in one
  component are tested, in blocks, so no group is held by one task; groups of up to three sets are done by then. Both passes verify on whole sets.

Defined results: nulls, texts without words: no shingles and no links; fewer words than a shingle: the whole sequence is one shingle;
repeated rows are copies; rows without doc_id are linked like others and have the component of their copies, null where these have no id either;
other columns are ignored by `near_duplicates` and kept by `one_of_each`; an empty table gives an empty one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneldrift.llm.words import mix, words_of
from paneldrift.session import stored


class Rule(NamedTuple):
    """Words of a shingle, and the similarity as a fraction."""

    shingle: int
    need: int
    of: int


OWN = Rule(4, 85, 100)
ORDERS = 3
#: The sketch counts shingles in 2**SKETCH_BITS places, whatever the size of the corpus; it is sent to the tasks.
SKETCH_BITS = 20
PLACES = 1 << 10  # counters in a row of the sketch
PARITIES = 512
#: Sets of one shingle that are compared in one go; more are dealt out as pairs of blocks.
BLOCK = 512


def sets_of(texts, rule: Rule = OWN) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    shingle = rule.shingle
    factors = mix(np.arange(901, 901 + shingle, dtype=np.uint64)) | np.uint64(1)
    words = words_of(texts)
    hashes = words.hashes(fold=True)
    out = []
    long_ = np.zeros(0, np.uint64)
    if len(hashes) >= shingle:
        last = len(hashes) - shingle + 1
        long_ = mix(sum((hashes[k : last + k] * factors[k] for k in range(shingle)), np.zeros(last, np.uint64)))
    for a, b in zip(words.firsts, words.firsts[1:]):
        if b - a >= shingle:
            out.append(np.unique(long_[a : b - shingle + 1]))
        elif b > a:
            short = hashes[a:b] * factors[: b - a]
            out.append(mix(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(x: np.ndarray) -> int:
    import xxhash

    return int(np.array(xxhash.xxh3_64_intdigest(x.tobytes()), np.uint64).astype(np.int64))


def parities(x: np.ndarray, groups: int = PARITIES) -> np.ndarray:
    """For each group of shingles, whether their number is odd; as unsigned 64-bit words, because numpy counts the bits of a signed
    number's absolute value. The halves' exclusive or is that of half as many groups."""
    odd = np.bincount((mix(x + np.uint64(77)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def wide(x: np.ndarray) -> np.ndarray:
    """Parities of at least as many groups as shingles: sets of alike sizes differ in this by a factor of two at most."""
    return parities(x, max(PARITIES, 1 << (len(x) - 1).bit_length()))


def places(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix(x: np.ndarray, counts: np.ndarray, order: int, rule: Rule = OWN) -> np.ndarray:
    """First shingles of a set in an order: enough that sets which are alike share one."""
    n = len(x)
    k = n + (-n * rule.need) // rule.of + 1
    return x[np.lexsort((mix(x + np.uint64(order + 1)), counts[places(x)]))[:k]]


def signature(x: np.ndarray, counts: np.ndarray, order: int, rule: Rule = OWN) -> np.ndarray:
    """Distinct 16-bit hashes of the prefix in an order: sets that share a shingle of it share one of these."""
    return np.unique(mix(prefix(x, counts, order, rule) + np.uint64(order)) >> np.uint64(48)).astype(np.uint16).view(np.int16)


def alike(x: np.ndarray, y: np.ndarray, rule: Rule = OWN) -> bool:
    """The exact similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return rule.of * both >= rule.need * (len(x) + len(y) - both)


def _slices(frame, most: int = 1 << 21):
    """Rows of a batch in runs of about `most` bytes of text."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(frame.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < frame.num_rows:
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield frame.slice(at, upto - at)
        at = upto


def _summaries(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows of documents (doc_id, tid, cid, n, wide), and rows of the sketch (place, counts)."""

    def rows(frames):
        import pyarrow as pa
        import zstandard

        schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("wide", pa.list_(pa.int64())),
                            ("place", pa.int32()), ("counts", pa.binary())])
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for frame in frames:
            for piece in _slices(frame):
                sets = sets_of(piece.column("text"), rule)
                np.add.at(counts, places(np.concatenate(sets)), 1)
                none = pa.nulls(len(sets))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("tid"), pa.array([class_of(x) if len(x) else None for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                     pa.array([wide(x).view(np.int64) if len(x) else None for x in sets], pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        zip_ = zstandard.ZstdCompressor(level=1)
        rows_ = [{"place": k, "counts": zip_.compress(c.tobytes())} for k, c in enumerate(counts.reshape(-1, PLACES)) if c.any()]
        if rows_:
            yield pa.RecordBatch.from_pylist(rows_, schema=schema)

    kinds = "doc_id bigint, tid bigint, cid bigint, n bigint, wide array<bigint>, place int, counts binary"
    return stored(docs.mapInArrow(rows, kinds))


def _sketch(summaries: DataFrame) -> np.ndarray:
    """Sums of the tasks' counters: 2**SKETCH_BITS numbers at any size of the corpus."""

    def summed(frames):
        import pyarrow as pa
        import zstandard

        unzip, place, sums = zstandard.ZstdDecompressor(), None, None

        def row():
            return pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "counts": pa.array([np.minimum(sums, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

        for frame in frames:
            for at, counts in zip(frame.column("place").to_pylist(), frame.column("counts")):
                if at != place:
                    if place is not None:
                        yield row()
                    place, sums = at, np.zeros(PLACES, np.uint64)
                sums += np.frombuffer(unzip.decompress(counts.as_py()), "<u4")
        if place is not None:
            yield row()

    rows = summaries.where("place is not null").select("place", "counts").repartition("place").sortWithinPartitions("place")
    out = np.zeros(((1 << SKETCH_BITS) // PLACES, PLACES), np.uint32)
    for r in rows.mapInArrow(summed, "place int, counts binary").collect():
        out[r["place"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def _shared(docs: DataFrame, counts, rule: Rule) -> DataFrame:
    """token, cid, first, before: prefix shingles of the first order that several classes have; `first` and `before` are the
    first class with that shingle and the one before this."""

    def postings(frames):
        import pyarrow as pa

        seen = set()
        for frame in frames:
            for piece in _slices(frame):
                new = {}
                for x in sets_of(piece.column("text"), rule):
                    if len(x) and (c := class_of(x)) not in seen:
                        seen.add(c)
                        new[c] = prefix(x, counts.value, 0, rule)
                if new:
                    owner = np.repeat(np.array(list(new), np.int64), [len(x) for x in new.values()])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(new.values())).astype(np.int64)), pa.array(owner)], ["token", "cid"])

    def grouped(frames):
        import pyarrow as pa

        token = first = last = None  # the group that a batch left open, and whether its first row is still held back
        held = False
        for frame in frames:
            t, c = (frame.column(k).to_numpy() for k in ("token", "cid"))
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            new[0] = not (t[0] == token and c[0] == last)
            t, c = t[new], c[new]
            if not len(t):
                continue
            head = np.ones(len(t), bool)
            head[1:] = t[1:] != t[:-1]
            head[0] = t[0] != token
            at = np.maximum.accumulate(np.where(head, np.arange(len(t)), -1))
            firsts = np.where(at >= 0, c[at], first if first is not None else 0)
            before = np.concatenate(([last if not head[0] else c[0]], c[:-1]))
            before = np.where(head, c, before)
            more = np.concatenate((~head[1:], [False]))  # a head is told only where another row follows it
            keep = ~head | more
            out = [t[keep], c[keep], firsts[keep], before[keep]]
            if held and not head[0]:
                out = [np.concatenate(([x], y)) for x, y in zip((token, first, first, first), out)]
            held = bool(head[-1])
            token, first, last = t[-1], firsts[-1], c[-1]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["token", "cid", "first", "before"])

    rows = docs.mapInArrow(postings, "token bigint, cid bigint").repartition("token").sortWithinPartitions("token", "cid")
    return stored(rows.mapInArrow(grouped, "token bigint, cid bigint, first bigint, before bigint"))


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _fitting(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and parities allow the similarity; only those whose sizes do carry parities."""
    left = classes.select(F.col("cid").alias("a"), "n")
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"))
    sized = pairs.join(left, "a").join(right, "b").where(_sized("n", "m", rule))
    left, right = (classes.select(F.col("cid").alias(c), F.col("wide").alias(w)) for c, w in ("ap", "bq"))
    return sized.join(right, "b").join(left, "a").where(_near("p", "q", "n", "m", rule)).select("a", "b")


def _allowed(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes that share a prefix shingle in all the other orders."""
    orders = [f"order{o}" for o in range(1, ORDERS)]
    left, right = (classes.select(F.col("cid").alias(c), *[F.col(o).alias(f"{c}_{o}") for o in orders]) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    for o in orders:
        both = both.where(F.arrays_overlap(f"a_{o}", f"b_{o}"))
    return both.select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, texts: DataFrame, counts, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes that pass the filters of all orders and are alike. Only texts of the classes asked for are moved."""
    orders = range(1, ORDERS)

    def sets(frames):
        import pyarrow as pa

        seen = set()
        for frame in frames:
            for piece in _slices(frame):
                made = {c: x for x in sets_of(piece.column("text"), rule) if len(x) and (c := class_of(x)) not in seen}
                seen.update(made)
                if made:
                    told = {f"order{o}": pa.array([signature(x, counts.value, o, rule) for x in made.values()], pa.list_(pa.int16())) for o in orders}
                    yield pa.RecordBatch.from_pydict({"cid": pa.array(list(made), pa.int64()), **told, "x": pa.array([x.tobytes() for x in made.values()], pa.binary())})

    def tested(frames):
        import pyarrow as pa

        for frame in frames:
            keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), rule) for x, y in zip(frame.column("x"), frame.column("y"))]
            yield frame.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(texts, "cid").select("tid").distinct()
    kinds = "cid bigint" + "".join(f", order{o} array<smallint>" for o in orders) + ", x binary"
    found = docs.join(stored(asked), "tid", "left_semi").select("text").mapInArrow(sets, kinds)
    found = stored(found)  # one row per class, but for repeated rows
    pairs = stored(_allowed(pairs, found.drop("x"), rule).distinct())
    left = found.select(F.col("cid").alias("a"), "x")
    right = found.select(F.col("cid").alias("b"), F.col("x").alias("y"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tested, "a bigint, b bigint").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with an edge (a, b): roots are the least nodes. Each round joins every node to the least of its
    neighbours, first from the larger side, then from the smaller, until nothing changes."""
    edges = stored(edges.select(_ordered("a", "b")[1].alias("u"), _ordered("a", "b")[0].alias("v")).where("u <> v").distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, now = None, mark(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct())
        before, now = now, mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _folded(x: str):
    """Parities of PARITIES groups from those of more: groups that fall together are added up."""
    words = PARITIES // 64
    place = lambda j: F.aggregate(F.sequence(j, F.size(x) - 1, F.lit(words)), F.lit(0).cast("bigint"), lambda s, k: s.bitwiseXOR(F.col(x)[k]))
    return F.when(F.size(x) == words, F.col(x)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), place))


def _sized(n: str, m: str, rule: Rule):
    """Sizes allow the pair."""
    return F.least(n, m) * rule.of >= F.greatest(n, m) * rule.need


def _near(p: str, q: str, n: str, m: str, rule: Rule):
    """Size and parities allow the pair: the difference of alike sets is at most (of - need) / (of + need) of their sizes."""
    _, need, of = rule
    words = F.least(F.size(p), F.size(q))

    def folded(x):
        return F.when(F.size(x) == words, F.col(x)).otherwise(F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), lambda u, v: u.bitwiseXOR(v)))

    odd = F.aggregate(F.zip_with(folded(p), folded(q), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(_sized(n, m, rule), odd * (of + need) <= (F.col(n) + F.col(m)) * (of - need))


def _cross_pairs(frames, rule: Rule):
    """Pairs of rows with one key but different roots (and different blocks, where two meet) that size and parities allow: each row's
    class with the list of its larger partners."""
    import pyarrow as pa

    _, need, of = rule
    held = None
    for frame in _with_end(frames):
        if frame is not None:
            held = frame if held is None else pa.concat_batches([held, frame])
            if not held.num_rows:
                continue
            key = np.stack([held.column(c).to_numpy() for c in ("token", "low", "high")])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if not len(new):
                continue
            ready, held = held.slice(0, new[-1]), held.slice(new[-1])
        else:
            ready, held = held, None
        if ready is None or not ready.num_rows:
            continue
        token, low, high, block, cid, n, root = (ready.column(c).to_numpy() for c in ("token", "low", "high", "block", "cid", "n", "root"))
        bits = ready.column("parities").flatten().to_numpy().view(np.uint64).reshape(len(cid), -1)
        group = np.cumsum(np.concatenate(([0], ((token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])).astype(np.int64))))
        last = np.searchsorted(group, group, "right")
        made = [], []
        for d in range(1, int((last - np.arange(len(cid))).max())):
            i = np.flatnonzero(np.arange(len(cid)) + d < last)
            j = i + d
            fits = (root[i] != root[j]) & ((low[i] == high[i]) | (block[i] != block[j])) & (np.minimum(n[i], n[j]) * of >= np.maximum(n[i], n[j]) * need)
            i, j = i[fits], j[fits]
            if len(i):
                odd = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1).astype(np.int64)
                fits = odd * (of + need) <= (n[i] + n[j]) * (of - need)
                made[0].append(np.minimum(cid[i[fits]], cid[j[fits]]))
                made[1].append(np.maximum(cid[i[fits]], cid[j[fits]]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in made)
        if len(a):  # a pair that shares several shingles here is told once
            a, b = np.unique(np.stack([a, b]), axis=1)
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)).astype(np.int32)), pa.array(b))
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), lists], ["a", "partners"])


def _with_end(frames):
    yield from frames
    yield None


def near_duplicates(docs: DataFrame, rule: Rule = OWN) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) for every row."""
    if not rule.of <= 2 * rule.need <= 2 * rule.of:
        raise ValueError("the similarity must be from a half to one")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text", "doc_id").alias("tid"))
    summaries = _summaries(texts, rule)
    rows = summaries.where("place is null")
    counts = spark.sparkContext.broadcast(_sketch(summaries))
    classes = stored(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("tid").alias("tid"), F.first("n").alias("n"), F.first("wide").alias("wide")))
    shared = _shared(texts.select("text"), counts, rule)
    stars = shared.select(*_ordered("first", "cid")).unionByName(shared.select(*_ordered("before", "cid"))).where("a <> b").distinct()
    names = classes.select("cid", "tid")
    links = _verified(texts, stored(_fitting(stars, classes, rule)), names, counts, rule)
    roots = stored(components(links))

    # Second pass: what shares a prefix shingle over the components so far.
    known = classes.select("cid", "n", _folded("wide").alias("parities")).join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    # Up to three sets of a shingle are all paired by `first` and `before`, so the first pass has tested these.
    many = stored(shared.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > 3).select("token", F.ceil(F.col("sets") / BLOCK).cast("int").alias("blocks")))
    dealt = shared.select("token", "cid").join(many, "token").join(stored(known), "cid")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "n", "root", "parities")
    dealt = dealt.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    lists = dealt.mapInArrow(lambda frames: _cross_pairs(frames, rule), "a bigint, partners array<bigint>")
    # The lists of a class from all its shingles hold the same partners again and again: joined before they become rows.
    rest = lists.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))
    left, right = (classes.select(F.col("cid").alias(c), F.col("wide").alias(w), F.col("n").alias(n)) for c, w, n in ("apn", "bqm"))
    rest = rest.join(left, "a").withColumn("b", F.explode("partners")).drop("partners").join(right, "b").where(_near("p", "q", "n", "m", rule)).select("a", "b")
    more = _verified(texts, stored(rest), names, counts, rule)
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    final = components(edges).withColumnRenamed("node", "cid")
    grouped = classes.select("cid", "least").join(final, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = stored(grouped.select("cid", "root").join(stored(ids), "root").select("cid", "component_id"))
    return rows.select("doc_id", "cid", F.col("n").alias("n_shingles")).join(by_class, "cid", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = OWN) -> DataFrame:
    """docs without the documents that have a smaller doc_id in their component. Rows without an id or without words stay, and so do
    repeated rows of the kept doc_id."""
    found = near_duplicates(docs, rule)
    drop = found.where((F.col("component_id") < F.col("doc_id")) & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stored(drop), docs["doc_id"].cast("bigint") == F.col("_id"), "left_anti")
