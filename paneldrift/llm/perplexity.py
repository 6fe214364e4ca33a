"""Quality rules: simple counts on words and lines, and bands of perplexity under an n-gram model of each language.

The model is modified Kneser-Ney over characters of order ORDER, of all documents: tasks count the n-grams of their rows, Spark adds
them up, and lower orders, discounts, context sums and interpolated probabilities are aggregates and joins over that table. A
character is one of 4096 classes (the code point itself below 3072), so an n-gram is a whole number; a model is
sorted arrays of these numbers with their log probabilities, in files in the shared folder. A task folds the n-grams of a slice of
its texts and looks them up in one part of these files after another, whatever the size of the model; neither the driver nor any
task holds it whole.

A document's score is its mean -log2 probability per character (the log of its perplexity). For each language, median and median
absolute deviation over all documents that pass the base rules give a lower and an upper band; the bands widen for short texts, whose
means vary more. A document is kept if it passes the base rules and lies within the bands of its language.

Defined results: a null or empty text has no words, fails the base rules and has neither score nor bands; the null language is a language of its own;
repeated rows are counted and returned each; other columns do not matter; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneldrift.llm.jaccard import _slices
from paneldrift.llm.words import mix, words_of
from paneldrift.session import shared_folder, stored

ORDER = 5
BITS = 12
OWN_CLASS = 3072
#: N-grams of a file of the model, and bytes of text that a task folds to distinct n-grams at a time.
ROWS, SLICE = 1 << 19, 1 << 21
#: N-grams with their counts that a task holds; beyond that it passes them on, and Spark adds up what comes again.
HELD = 1 << 21
#: So many slices (twice as many, where they are parts of long texts) look up their n-grams together: what a task holds of each is its
#: distinct n-grams and four bytes a character.
TOGETHER = 8
#: Width of the bands in robust standard deviations, the least deviation in bits, and the length at which the width is 1.4 times that of long texts.
#: Chosen by text planted in every language below its band (tests/llm/test_perplexity.py).
BELOW, ABOVE = 4.5, 4.5
LEAST_SPREAD = 0.01
SHORT = 300
WINDOW = 8

_SPACE = " \t\n\x0b\x0c\r"
_IN_WORD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character of a word
_IN_WORD[list(_SPACE.encode())] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = words_of(texts)
    n_words = np.diff(w.firsts)
    some = np.flatnonzero(np.diff(w.offsets))

    def per_text(marks):
        out = np.zeros(len(texts), np.int64)
        if len(some):
            out[some] = np.add.reduceat(marks, w.offsets[some], dtype=np.int64)
        return out

    word_chars = per_text(_IN_WORD[w.data])
    repeated = np.zeros(len(texts), np.int64)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    if len(w.starts) >= WINDOW:
        h, last = w.hashes(), len(w.starts) - WINDOW + 1
        windows = mix(text_of[:last].astype(np.uint64) + np.uint64(1))
        for k in range(WINDOW):
            windows = mix(windows + h[k : last + k])
        own = np.flatnonzero(text_of[:last] == text_of[WINDOW - 1 :])
        _, number, count = np.unique(windows[own], return_inverse=True, return_counts=True)
        twice = own[count[number] > 1]
        cover = np.zeros(len(text_of) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        repeated = np.bincount(text_of, weights=np.cumsum(cover)[:-1] > 0, minlength=len(texts)).astype(np.int64)
    dup_lines = []
    for t in texts.to_pylist():
        lines = [x for x in (t or "").split("\n") if x.strip(_SPACE)]
        dup_lines.append(len(lines) - len(set(lines)))
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_text(_SYMBOL[w.data]), "n_dup_lines": np.array(dup_lines, np.int64),
            "n_repeat_words": repeated}


def grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of each text, and where the texts begin among them."""
    plain = [t or "" for t in texts.to_pylist()]
    lengths = np.array([len(t) for t in plain], np.int64)
    classes = np.frombuffer("".join(plain).encode("utf-32-le"), "<u4").astype(np.uint64)
    rare = np.flatnonzero(classes >= OWN_CLASS)
    classes[rare] = OWN_CLASS + mix(classes[rare]) % np.uint64((1 << BITS) - OWN_CLASS)
    np.maximum(classes, 1, out=classes)
    begins = np.concatenate(([0], np.cumsum(lengths)))
    keys = classes.copy()
    for back in range(1, ORDER):
        keys[back:] |= classes[:-back] << np.uint64(BITS * back)
    for place in range(ORDER - 1):  # before the first character: class 0
        keys[begins[:-1][lengths > place] + place] &= np.uint64((1 << BITS * (place + 1)) - 1)
    return keys.view(np.int64), begins


def gram_parts(texts, most: int):
    """grams of a slice; of a text alone, which may be of any length, in parts of `most` characters, each with its n-grams of the whole text."""
    import pyarrow as pa

    if len(texts) > 1:
        yield grams(texts)
        return
    text = texts[0].as_py() or ""
    for i in range(0, max(len(text), 1), most):
        known = min(i, ORDER - 1)
        keys = grams(pa.array([text[i - known : i + most]], pa.string()))[0][known:]
        yield keys, np.array([0, len(keys)])


def counted(docs: DataFrame) -> DataFrame:
    """lang, gram, c over all texts; each task adds up its own first, as far as it holds them."""

    def rows(frames):
        import pyarrow as pa

        sums: dict = {}

        def folded(parts):
            keys, counts = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return [(keys[first], np.add.reduceat(counts, first))]

        def told():
            for lang, parts in sums.items():
                keys, counts = folded(parts)[0]
                for i in range(0, len(keys), 65536):
                    k = keys[i : i + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(counts[i : i + 65536].astype(np.int64))], ["lang", "gram", "c"])
            sums.clear()

        def held():
            return sum(len(keys) for parts in sums.values() for keys, _ in parts)

        for frame in frames:
            for piece in _slices(frame, SLICE):
                langs, number = np.unique(np.array([x if x is not None else "" for x in piece.column("lang").to_pylist()], object), return_inverse=True)
                for keys, begins in gram_parts(piece.column("text"), SLICE):
                    owner = np.repeat(number, np.diff(begins))
                    for k, lang in enumerate(langs):
                        own = np.sort(keys[owner == k])
                        if not len(own):
                            continue
                        parts = sums.setdefault(lang, [])
                        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                        parts.append((own[first], np.diff(np.append(first, len(own)))))
                        if len(parts) > 8:
                            sums[lang] = folded(parts)
                    if held() > HELD:
                        sums.update({lang: folded(parts) for lang, parts in sums.items()})
                        if held() > HELD // 2:
                            yield from told()
        yield from told()

    named = docs.select("text", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")).alias("lang"))
    return named.mapInArrow(rows, "lang string, gram bigint, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def model(counts: DataFrame) -> DataFrame:
    """lang, size, gram, logp, logb: every n-gram of every size with its interpolated log2 probability, and the log2 weight that it
    leaves as a context to the next smaller size."""
    levels = {ORDER: stored(counts)}
    for size in range(ORDER - 1, 0, -1):  # how many different characters stand before it
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * size) - 1)).alias("gram")
        levels[size] = stored(levels[size + 1].groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("c")))
    how_many = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    tallies = reduce(DataFrame.unionByName, (levels[s].groupBy("lang").agg(*how_many).withColumn("size", F.lit(s)) for s in levels))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))

    def discount(k):
        raw = k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1))
        return F.when((F.col(f"n{k}") > 0) & (raw > 0) & (raw < k), raw).otherwise(F.lit(0.5 * k)).alias(f"d{k}")

    discounts = stored(tallies.select("lang", "size", *map(discount, (1, 2, 3))))
    lower, out = None, []
    for size in range(1, ORDER + 1):
        rows = levels[size].join(F.broadcast(discounts.where(F.col("size") == size).drop("size")), "lang")  # a row per language
        rows = rows.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = F.shiftright("gram", BITS) if size > 1 else F.lit(0).cast("bigint")
        rows = rows.withColumn("context", context)
        every = W.partitionBy("lang", "context")  # at most 2**BITS rows
        rows = rows.withColumns({"s": F.sum("c").over(every), "left": F.sum("d").over(every)})
        own, back = (F.col("c") - F.col("d")) / F.col("s"), F.col("left") / F.col("s")
        if lower is None:
            rows = rows.withColumn("p", own + back / (1 << BITS))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * (size - 1)) - 1))
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", suffix).join(below, ["lang", "suffix"]).withColumn("p", own + back * F.col("q"))
        lower = stored(rows.select("lang", "gram", "context", "p", back.alias("back")))
        out.append(lower.withColumn("size", F.lit(size)))
    whole = reduce(DataFrame.unionByName, out)
    backs = whole.groupBy("lang", (F.col("size") - 1).alias("size"), F.col("context").alias("gram")).agg(F.log2(F.first("back")).alias("logb"))
    logs = whole.select("lang", "size", "gram", F.log2("p").alias("logp"))
    nothing = discounts.select("lang", F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("gram"), F.lit(-float(BITS)).alias("logp")).distinct()
    return stored(logs.unionByName(nothing).join(backs, ["lang", "size", "gram"], "left"))


def write_model(table: DataFrame) -> str:
    """Sorted files of at most ROWS n-grams each in the shared folder; tasks read them as they need them."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/model-{uuid.uuid4().hex}"
    ordered = table.repartitionByRange("lang", "size", "gram").sortWithinPartitions("lang", "size", "gram")
    ordered.write.option("maxRecordsPerFile", ROWS).parquet(path)
    return path


class Model:
    """A written model: n-grams are looked up in one sorted part of a file after another, so one part is in memory at a time."""

    def __init__(self, path: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.store, folder = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
        self.parts = []  # (file, row group, least and largest (lang, size, gram)), from the files' own statistics
        for info in sorted(self.store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                meta = pq.read_metadata(self.store.open_input_file(info.path))
                names = [meta.schema.column(i).name for i in range(meta.num_columns)]
                for g in range(meta.num_row_groups):
                    told = [meta.row_group(g).column(names.index(n)).statistics for n in ("lang", "size", "gram")]
                    self.parts.append((info.path, g, [(t.min, t.max) for t in told]))

    def find(self, lang: str, size: int, keys: np.ndarray, column: str) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ascending keys the model has in this size, and their values."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        hit, value = np.zeros(len(keys), bool), np.zeros(len(keys))
        for path, group, ((l0, l1), (s0, s1), (g0, g1)) in self.parts:
            one = l0 == l1 and s0 == s1  # only then do the bounds of the n-grams say anything
            if not len(keys) or not l0 <= lang <= l1 or not s0 <= size <= s1 or (one and (keys[0] > g1 or keys[-1] < g0)):
                continue
            with self.store.open_input_file(path) as stream:
                rows = pq.ParquetFile(stream).read_row_group(group, columns=["gram", column, *(() if one else ("lang", "size"))])
            if not one:
                rows = rows.filter(pc.and_(pc.equal(rows.column("lang"), lang), pc.equal(rows.column("size"), size)))
            known = rows.column("gram").to_numpy()
            if len(known):
                some = slice(*np.searchsorted(keys, [known[0], known[-1] + 1]))
                at = np.searchsorted(known, keys[some])
                same = known[at] == keys[some]
                hit[some] |= same
                value[some] = np.where(same, np.nan_to_num(rows.column(column).to_numpy()[at]), value[some])
        return hit, value

    def logs(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """log2 probability of each n-gram; what the model has not seen goes down to smaller sizes."""
        distinct, number = np.unique(keys, return_inverse=True)
        got, todo, weight = np.zeros(len(distinct)), np.arange(len(distinct)), np.zeros(len(distinct))
        for s in range(ORDER, -1, -1):
            if not len(todo):
                break
            key, which = np.unique(distinct[todo] & ((1 << BITS * s) - 1), return_inverse=True)
            hit, value = (x[which] for x in self.find(lang, s, key, "logp"))
            got[todo[hit]] = value[hit] + weight[todo[hit]]
            todo = todo[~hit]
            if s and len(todo):
                contexts, which = np.unique((distinct[todo] & ((1 << BITS * s) - 1)) >> BITS, return_inverse=True)
                weight[todo] += self.find(lang, s - 1, contexts, "logb")[1][which]
        got[todo] = weight[todo] - BITS
        return got[number]


def scored(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, lang, base counts, n_chars and bits (mean -log2 probability per character) of every row of docs."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    named = docs.select(F.col("doc_id").cast("bigint"), "text", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")).alias("lang"))
    kinds = "doc_id bigint, lang string, " + "".join(f"{c} bigint, " for c in counts) + "n_chars bigint, bits double"
    path = write_model(table)

    def rows(frames):
        import pyarrow as pa

        model = Model(path)

        def folded(piece):
            """Rows of a slice by language, their counts, and per language its distinct n-grams, each character's number among these and where texts begin.
            A text longer than a slice comes in parts, the row and its counts with the last."""
            piece = piece.take(pa.array(np.argsort(np.array(piece.column("lang").to_pylist(), object), kind="stable")))
            found = base_counts(piece.column("text"))
            langs, first = np.unique(np.array(piece.column("lang").to_pylist(), object), return_index=True)
            last = None
            for keys, begins in gram_parts(piece.column("text"), SLICE):
                if last:
                    yield None, None, last
                last = []
                for lang, i, j in zip(langs, first, np.append(first[1:], piece.num_rows)):
                    coded = pa.array(keys[begins[i] : begins[j]]).dictionary_encode()
                    last.append((lang, coded.dictionary.to_numpy(), coded.indices.to_numpy(), begins[i : j + 1] - begins[i]))
            yield piece.drop_columns(["text"]), found, last

        before = [0, 0.0]  # characters and bits of the parts of a long text that have been scored

        def scores(held):
            logs = {}
            for lang in sorted({part[0] for _, _, parts in held for part in parts}):
                own = [part[1] for _, _, parts in held for part in parts if part[0] == lang]
                logs[lang] = iter(np.split(model.logs(lang, np.concatenate(own)), np.cumsum([len(x) for x in own])[:-1]))
            for piece, found, parts in held:
                n, bits = [], []
                for lang, _, number, begins in parts:
                    ends = np.concatenate(([0], np.cumsum(next(logs[lang])[number])))
                    n.append(np.diff(begins))
                    bits.append(ends[begins[:-1]] - ends[begins[1:]])
                n, bits = np.concatenate(n) + before[0], np.concatenate(bits) + before[1]
                before[:] = (n[0], bits[0]) if piece is None else (0, 0.0)
                if piece is None:
                    continue
                bits /= np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("lang"), *(pa.array(found[c].astype(np.int64)) for c in counts),
                     pa.array(n.astype(np.int64)), pa.array(np.where(n > 0, bits, np.nan), pa.float64(), from_pandas=True)],
                    ["doc_id", "lang", *counts, "n_chars", "bits"],
                )

        held = []
        for frame in frames:
            for piece in _slices(frame, SLICE):
                for part in folded(piece):
                    held.append(part)
                    if sum(x[0] is not None for x in held) == TOGETHER or len(held) == 2 * TOGETHER:
                        yield from scores(held)
                        held = []
        if held:
            yield from scores(held)

    return named.mapInArrow(rows, kinds)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, bits, the bands of the document's language, base_failed and kept, for every row."""
    rows = stored(scored(docs, model(counted(docs))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    # Medians over a thousandth of a bit: a table of bounded size per language.
    bins = stored(rows.where(~F.col("base_failed") & F.col("bits").isNotNull()).groupBy("lang", F.round(F.col("bits") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    middle = bins.groupBy("lang").agg(F.percentile("bin", 0.5, F.col("n")).alias("middle"))
    off = bins.join(middle, "lang").groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile(F.abs(F.col("bin") - F.col("middle")), 0.5, F.col("n")).alias("off"))
    spread = F.greatest(1.4826 * F.col("off") / 1000, F.lit(LEAST_SPREAD))
    bands = stored(off.select("lang", (F.col("middle") / 1000).alias("median_bits"), spread.alias("spread_bits")))
    wide = F.col("spread_bits") * F.sqrt(1 + F.try_divide(F.lit(SHORT), "n_chars"))
    rows = rows.join(F.broadcast(bands), "lang", "left").withColumns({"least_bits": F.col("median_bits") - BELOW * wide, "most_bits": F.col("median_bits") + ABOVE * wide})
    inside = F.coalesce(F.col("bits").between(F.col("least_bits"), F.col("most_bits")), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside)
