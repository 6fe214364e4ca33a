"""Periodic runs of words: stretches that repeat themselves, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words of smallest period q (words q apart are identical), at least `least` and 2 * q words
long, that no neighbouring word extends keeping q.

The suffixes of a prefix are the path from its state to the root of the automaton's tree of suffix links. When a word is
appended, that path is recoloured with the new end; link-cut access walks it as segments of one colour, the last end of the
segment's substrings until now. A segment with substrings of lengths in (low, high] that last ended at e and now end at i
yields a square of period i - e if that lies in (low, high]: all squares with a primitive root are found, at every place they
end, and the first of a run is extended to the whole run. All accesses of a text take O(n log n) steps.

Two words that are part of a run lie in one of its 6-word windows, and the window comes again one period later or earlier.
So only stretches covered by 6-word windows that come twice within the stretch can hold runs; the others never reach the
automaton. That is exact: nothing is skipped that could hold a run (for `least` below 12, windows are shorter).

A document is worked on by one task, at about 700 bytes a word of its longest repeating stretch.

Defined results: a null or empty text, or one of fewer than `least` words, has no runs; repeated rows are found repeatedly;
null doc_ids stay; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneldrift.llm.words import mix, words_of

RESULT = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
#: Bytes of text that are cut into words at a time; a longer text is one piece.
PIECE = 1 << 22


def automaton(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest length and suffix link of each state, and the states of the prefixes. State 1 is the root, 0 is none."""
    length, link, follow, prefixes, last = [0, 0], [0, 0], [{}, {}], [], 1
    for c in text:
        new = len(length)
        length.append(length[last] + 1)
        link.append(1)
        follow.append({})
        p = last
        while p and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                follow.append(follow[q].copy())
                while p and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        prefixes.append(new)
        last = new
    return length, link, prefixes


def squares(text: list[int]):
    """(end, period) of every square with a primitive root, `end` being its last word, by ascending end."""
    length, parent, prefixes = automaton(text)
    # Preferred paths are splay trees by depth, each of one colour, kept at its root; `parent` of that root leads to the next path.
    left, right, colour = [0] * len(length), [0] * len(length), [-1] * len(length)
    for end, x in enumerate(prefixes):
        below = 0
        while x:
            p = parent[x]
            while p and (left[p] == x or right[p] == x):  # splay x to the root of its path
                g = parent[p]
                if g and (left[g] == p or right[g] == p):
                    z = parent[g]
                    if left[g] == p:
                        if left[p] == x:
                            a = right[x]
                            b = right[p]
                            left[g], right[p], left[p], right[x] = b, g, a, p
                            parent[g], parent[p] = p, x
                            if b:
                                parent[b] = g
                            if a:
                                parent[a] = p
                        else:
                            a = left[x]
                            b = right[x]
                            right[p], left[g], left[x], right[x] = a, b, p, g
                            parent[p] = parent[g] = x
                            if a:
                                parent[a] = p
                            if b:
                                parent[b] = g
                    elif right[p] == x:
                        a = left[x]
                        b = left[p]
                        right[g], left[p], right[p], left[x] = b, g, a, p
                        parent[g], parent[p] = p, x
                        if b:
                            parent[b] = g
                        if a:
                            parent[a] = p
                    else:
                        a = right[x]
                        b = left[x]
                        left[p], right[g], right[x], left[x] = a, b, p, g
                        parent[p] = parent[g] = x
                        if a:
                            parent[a] = p
                        if b:
                            parent[b] = g
                    parent[x] = z
                    if z:
                        if left[z] == g:
                            left[z] = x
                        elif right[z] == g:
                            right[z] = x
                    colour[x] = colour[g]
                    p = z
                else:
                    if left[p] == x:
                        a = right[x]
                        left[p], right[x] = a, p
                    else:
                        a = left[x]
                        right[p], left[x] = a, p
                    if a:
                        parent[a] = p
                    parent[p], parent[x] = x, g
                    colour[x] = colour[p]
                    p = g
            before = colour[x]
            deeper = right[x]
            if deeper:
                colour[deeper] = before
            right[x] = below
            if before >= 0 and length[p] < end - before <= length[x]:
                yield end, end - before
            below, x = x, p
        colour[below] = end


def runs_of(text: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    found, known = [], {}
    for end, period in squares(text):
        if known.get(period, -1) >= end:
            continue
        start, upto = end - 2 * period + 1, end + 1
        while upto < len(text) and text[upto] == text[upto - period]:
            upto += 1
        known[period] = upto - 1
        if upto - start >= least:
            found.append((start, upto - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, firsts: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(text, begin, end) of the stretches of words that windows cover which come at least twice within the stretch.

    `hashes` are those of the words of all texts, `firsts` where each text begins. Equal hashes of unlike windows only make a
    stretch too many.
    """
    n = len(hashes)
    if n < 2 * window:
        return []
    grams = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(grams)])
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    begins, ends, owner = firsts[:-1], firsts[1:], np.arange(len(firsts) - 1)
    while True:
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(b, e - window + 1) for b, e in zip(begins, ends) if e - b > window)])
        piece = np.repeat(np.arange(len(begins)), np.maximum(ends - begins - window + 1, 0) * (ends - begins > window))
        keys = mix(grams[place] ^ mix(piece.astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = keys[order[1:]] == keys[order[:-1]]
        twice = np.sort(place[order[same[1:] | same[:-1]]])
        if not len(twice):
            return []
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + window, -1)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = np.cumsum(cover[:-1]) > 0
        cut = np.zeros(n + 1, bool)  # a stretch neither goes on into the next text nor into the next of the last round
        cut[begins] = True
        now = inside[1:-1] & (~inside[:-2] | cut[:-1])
        over = inside[1:-1] & (~inside[2:] | cut[1:])
        found, closed = np.flatnonzero(now), np.flatnonzero(over) + 1
        if len(found) == len(begins) and np.array_equal(found, begins) and np.array_equal(closed, ends):
            return list(zip(text[found].tolist(), found.tolist(), closed.tolist()))
        begins, ends = found, closed


def _pieces(batch):
    """Slices of a batch of about PIECE bytes of text, one row at least."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (by start and period, words counted from 0) and the text without repetitions of every row.

    `collapsed` has the words, joined by one space, that no run contains after its first period.
    """
    window = max(1, least // 2)

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in _pieces(batch):
                words = words_of(piece.column("text"))
                runs: dict[int, list] = {}
                for row, a, b in stretches(words.hashes(), words.firsts, window):
                    ids: dict[bytes, int] = {}
                    told = [ids.setdefault(words.data[s:e].tobytes(), len(ids)) for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())]
                    base = a - int(words.firsts[row])
                    got = [(base + start, n, p) for start, n, p in runs_of(told, least)]
                    if got:
                        runs.setdefault(row, []).extend(got)
                texts = []
                for row, text in enumerate(piece.column("text").cast(pa.binary()).to_pylist()):
                    kept = (text or b"").split()
                    if row in runs:
                        gone = np.zeros(len(kept) + 1, np.int32)
                        for start, n, p in runs[row]:
                            gone[start + p] += 1
                            gone[start + n] -= 1
                        kept = [w for w, g in zip(kept, np.cumsum(gone).tolist()) if not g]
                    texts.append(b" ".join(kept).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(np.diff(words.firsts)),
                        pa.array(
                            [[dict(zip(("start", "length", "period"), r)) for r in sorted(runs.get(row, []), key=lambda r: (r[0], r[2]))] for row in range(piece.num_rows)],
                            pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])),
                        ),
                        pa.array(texts, pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(found, RESULT)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The rows with a tenth of the texts, by crc32 of doc_id, made periodic from some word on; null ids never."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), g.alias("g")).withColumn("n", F.size("w").cast("bigint"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int")))
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest run (ties: smallest start, then period), and digests of all runs and of the text left."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.withColumns({"top": longest, "lines": F.array_join(lines, "")})
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.col("lines"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
