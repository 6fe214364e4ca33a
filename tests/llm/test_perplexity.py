"""Base counts and the n-gram model against plain Python, odd rows, bands by plain medians."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paneldrift.llm import perplexity, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abé \n#|\x85", max_size=12).map(lambda x: x * 9)), max_size=5))
def test_base_counts(texts):
    got = perplexity.base_counts(pa.array(["x y", *texts], pa.string())[1:])
    assert list(zip(*(x.tolist() for x in got.values()))) == [plain_counts(t) for t in texts]


def plain_model(texts, order):
    """log2 probability of the character after each context, by the textbook formulas."""
    counts = Counter()
    for t in texts:
        padded = "\0" * (order - 1) + t
        counts.update(padded[i : i + order] for i in range(len(t)))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    p = {"": 1 / 4096}
    for k in range(1, order + 1):
        n = [sum(c == j for c in levels[k].values()) for j in (0, 1, 2, 3, 4)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = {}
        for j in (1, 2, 3):
            raw = j - (j + 1) * y * n[j + 1] / max(n[j], 1)
            d[j] = raw if n[j] and 0 < raw < j else 0.5 * j
        total, left = Counter(), defaultdict(float)
        for g, c in levels[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        for g, c in levels[k].items():
            p[g] = (c - d[min(c, 3)]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p[g[1:]]
    return p


@pytest.mark.parametrize("rows_of_file,slice_", [(1 << 19, 1 << 21), (700, 5000)])
def test_model_and_scores(spark, monkeypatch, rows_of_file, slice_):
    """Against the plain model, with few large and many small files and slices."""
    monkeypatch.setattr(perplexity, "ROWS", rows_of_file)
    monkeypatch.setattr(perplexity, "SLICE", slice_)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame([(d, t, lang if d % 7 else None) for d, t, lang in rows], "doc_id long, text string, lang string").repartition(3)
    table = perplexity.model(perplexity.counted(docs))
    got = {r["doc_id"]: r["bits"] for r in perplexity.scored(docs, table).collect()}
    for lang in {r["lang"] for r in docs.collect()}:
        own = {r["doc_id"]: r["text"] for r in docs.collect() if r["lang"] == lang}
        p = plain_model(own.values(), perplexity.ORDER)
        for d, t in own.items():
            padded = "\0" * (perplexity.ORDER - 1) + t
            bits = -sum(math.log2(p[padded[i : i + perplexity.ORDER]]) for i in range(len(t))) / len(t)
            assert got[d] == pytest.approx(bits, rel=1e-9)
    # Probabilities after a seen context add up to one over seen and unseen characters.
    written = perplexity.Model(perplexity.write_model(table))
    assert len(written.parts) > 10 or rows_of_file > 1000
    lang = f"l{rows[1][2]}"
    known = [r["gram"] for r in table.where((table.lang == lang) & (table["size"] == perplexity.ORDER)).orderBy("gram").collect()]
    context = known[len(known) // 2] >> perplexity.BITS
    logs = written.logs(lang, (context << perplexity.BITS) + np.arange(1 << perplexity.BITS))
    assert (2.0**logs).sum() == pytest.approx(1, abs=1e-3)
    assert written.logs("lnone", np.array([5, 5, 7])).tolist() == [-12.0] * 3  # a language that the model lacks


def test_slices_share_a_pass_of_the_model(spark, monkeypatch):
    """Slices look up their n-grams together, a language at a time, and score as each on its own."""
    monkeypatch.setattr(perplexity, "SLICE", 5000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    table = perplexity.model(perplexity.counted(docs))
    want = {r["doc_id"]: r["bits"] for r in perplexity.scored(docs, table).collect()}
    task, asked, find = [], [], perplexity.Model.find
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, kinds: task.append(f))
    monkeypatch.setattr(perplexity.Model, "find", lambda self, lang, size, *more: asked.append((lang, size)) or find(self, lang, size, *more))
    perplexity.scored(docs, table)
    frame = docs.selectExpr("doc_id", "text", "coalesce('l' || lang, '') lang").toArrow().combine_chunks().to_batches()[0]
    slices, langs = len(list(perplexity._slices(frame, 5000))), set(frame.column("lang").to_pylist())
    rows = pa.Table.from_batches(list(task[0](iter([frame])))).to_pylist()
    assert {r["doc_id"]: r["bits"] for r in rows} == {d: pytest.approx(b, rel=1e-9) for d, b in want.items()}
    assert slices > 16 and len([x for x in asked if x[1] == perplexity.ORDER]) <= -(-slices // 8) * len(langs)


def tasks_of(monkeypatch, docs, function, *more):
    """The Python function that each task of counted or scored runs."""
    task = []
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, f, kinds: task.append(f) or docs.selectExpr("'' lang", "0L gram", "0L c"))
        function(docs, *more)
    return task[0]


def test_tasks_pass_on_counts_beyond_what_they_hold(spark, monkeypatch):
    """A task whose n-grams are all new holds a bounded number of them, and the counts of all its rows come out."""
    monkeypatch.setattr(perplexity, "HELD", 20000)
    rng = random.Random(3)
    texts = [["".join(chr(97 + rng.randrange(2000)) for _ in range(600)) for _ in range(10)] + ["again " * 20, None] for _ in range(20)]
    docs = spark.createDataFrame([("x", "en")], "text string, lang string")
    read, seen, got = 0, [], Counter()

    def frames():
        nonlocal read
        for k, some in enumerate(texts):
            read += 1
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([f"l{k % 2}" if i % 2 else None for i in range(len(some))], pa.string())], ["text", "lang"])

    for batch in tasks_of(monkeypatch, docs, perplexity.counted)(frames()):
        seen.append(read)
        for r in batch.to_pylist():
            got[r["lang"], r["gram"]] += r["c"]
    want = Counter()
    for k, some in enumerate(texts):
        for i, t in enumerate(some):
            keys, _ = perplexity.grams(pa.array([t], pa.string()))
            want.update((f"l{k % 2}" if i % 2 else "", x) for x in keys.tolist())
    assert got == want
    assert seen[0] <= 5 and seen[-1] == len(texts)


def test_long_texts_go_in_parts(spark, monkeypatch):
    """N-grams of a text of any length are made in parts of a slice, counted and scored as those of the whole text."""
    rng = random.Random(4)
    words = ["eins", "zwei", "größer", "日本", "\U0001f642", "zqx"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(n)) if n else None, "de" if i % 3 else None) for i, n in enumerate((9, 4000, 0, 30, 9000, 1, 1500))]
    rows.append((7, rows[1][1][:1000], "de"))  # no more than a slice
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1)
    table = perplexity.model(perplexity.counted(docs))
    want = {r["doc_id"]: (r["n_chars"], r["n_words"], r["bits"]) for r in perplexity.scored(docs, table).collect()}
    counts = {(r["lang"], r["gram"]): r["c"] for r in perplexity.counted(docs).collect()}
    monkeypatch.setattr(perplexity, "SLICE", 1000)
    made, grams = [], perplexity.grams
    frame = docs.selectExpr("doc_id", "text", "coalesce('l' || lang, '') lang").toArrow().combine_chunks().to_batches()[0]
    count, score = tasks_of(monkeypatch, docs, perplexity.counted), tasks_of(monkeypatch, docs, perplexity.scored, table)
    monkeypatch.setattr(perplexity, "grams", lambda texts: made.append(sum(len(t or "") for t in texts.to_pylist())) or grams(texts))
    got = Counter()
    for batch in count(iter([frame])):
        for r in batch.to_pylist():
            got[r["lang"], r["gram"]] += r["c"]
    assert got == counts
    found = [r for batch in score(iter([frame])) for r in batch.to_pylist()]
    assert sorted(r["doc_id"] for r in found) == list(range(8))
    assert {r["doc_id"]: (r["n_chars"], r["n_words"], r["bits"]) for r in found} == {d: (n, w, b if b is None else pytest.approx(b, rel=1e-9)) for d, (n, w, b) in want.items()}
    assert max(made) <= 1000 + perplexity.ORDER - 1 and len(made) > 100


def test_kept_by_plain_medians_and_bands(spark):
    rows = [r.asDict() for r in queries.op7_perplexity_rules(spark, SF).collect()]
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bits = defaultdict(list)
    for r in rows:
        if not r["base_failed"] and r["bits"] is not None:
            bits[docs[r["doc_id"]]["lang"]].append(math.floor(r["bits"] * 1000 + 0.5))
    for r in rows:
        values = bits[docs[r["doc_id"]]["lang"]]
        if not values or r["bits"] is None:
            assert r["kept"] == (not r["base_failed"])
            continue
        middle = np.median(values)
        off = np.median(np.abs(np.array(values) - middle))
        wide = max(1.4826 * off / 1000, 0.01) * math.sqrt(1 + 300 / len(docs[r["doc_id"]]["text"]))
        low, high = middle / 1000 - 4.5 * wide, middle / 1000 + 4.5 * wide
        assert (r["least_bits"], r["most_bits"]) == (pytest.approx(low), pytest.approx(high))
        assert r["kept"] == (not r["base_failed"] and low <= r["bits"] <= high)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (None, "some words here", None), (3, "word and more words " * 20000, "en"), (4, "\U0001f642 日本語 テスト " * 30, "ja")] * 2
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, kept string")
    got = perplexity.judged(docs).collect()
    assert len(got) == 10 and all(r["kept"] is not None and not (r["base_failed"] and r["kept"]) for r in got)
    assert all(r["base_failed"] and r["bits"] is None for r in got if r["doc_id"] in (1, 2))
    assert perplexity.judged(docs.where("false")).count() == 0


def test_texts_without_characters_beside_scored_ones(spark):
    """Null and empty texts of a language that has bands: rows without score or bands, not kept; the other rows have theirs."""
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(90)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(30)] + [(30, None, "en"), (31, "", "en"), (None, "", "en"), (33, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = perplexity.judged(docs).collect()
    assert len(got) == 34
    for r in got:
        if r["n_chars"]:
            assert not r["base_failed"] and r["least_bits"] < r["median_bits"] < r["most_bits"] and r["kept"] == (r["least_bits"] <= r["bits"] <= r["most_bits"])
        else:
            assert r["base_failed"] and not r["kept"] and (r["bits"], r["least_bits"], r["most_bits"]) == (None, None, None)
    assert sum(r["n_chars"] == 0 for r in got) == 4


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = []
    for r in queries.op7_perplexity_rules(spark, folder).collect():
        want = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        if not r["base_failed"] and labels.get(r["doc_id"]) == 1:
            good.append(r["kept"])
    assert sum(good) >= 0.99 * len(good)
    odd = spark.createDataFrame([(i, "aeiou lorem ipsum dolor " * 10 if i else "zqxj kvbw pfgh xxqz wvkj " * 8, "en") for i in range(50)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in perplexity.scored(odd, perplexity.model(perplexity.counted(odd))).orderBy("bits").collect()][-1] == 0


def test_lower_band_rejects_planted_text_of_each_language(spark):
    rng = random.Random(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r["text"] or "", r["lang"]) for r in docs.collect()]
    planted, told = [], {}
    for lang in sorted({x for _, x in rows}):
        common = [w for w, _ in Counter(w for t, x in rows if x == lang for w in WORD.findall(t)).most_common(4)]
        for size in (120, 400):
            planted.append((-1 - len(planted), " ".join(rng.choice(common) for _ in range(size)), lang))
            told[planted[-1][0]] = (lang, size)
    got = {r["doc_id"]: r for r in perplexity.judged(docs.unionByName(spark.createDataFrame(planted, docs.schema)).repartition(4)).where("doc_id < 0").collect()}
    assert {x for x, _ in told.values()} >= {"de", "en", "es", "fr"}
    for d, case in told.items():
        assert not got[d]["base_failed"] and got[d]["bits"] < got[d]["least_bits"] and not got[d]["kept"], (case, got[d])
