"""Near duplicates against all pairs of small tables, and the parts that may lose links."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paneldrift.llm import jaccard, queries
from paneldrift.llm.words import words_of

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id, number of shingles and least linked doc_id of every row, by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 85 * (len(x) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(x), least.get(find(i)) if x else d) for i, ((d, _), x) in enumerate(zip(rows, sets))), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x1c\x85", max_size=20)), max_size=6))
def test_words(texts):
    w = words_of(pa.array(["skipped", *texts], pa.string())[1:])
    got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.firsts, w.firsts[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    flat, hashes = [x for each in got for x in each], w.hashes(fold=True).tolist()
    assert len({h for h in hashes}) == len({x.translate(LOWER) for x in flat}) and len(hashes) == len(flat)


def test_hashes_do_not_depend_on_place(monkeypatch):
    from paneldrift.llm import words

    text = "one two " * 3000 + "x" * 5000 + " one"
    whole = words_of(pa.array([text])).hashes()
    monkeypatch.setattr(words, "STRETCH", 100)
    assert (words_of(pa.array([text])).hashes() == whole).all() and len(set(whole.tolist())) == 3 and whole[-1] == whole[0]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.integers(0, 2**32))
def test_filters_lose_no_pair(n, more, other, seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 4, 1 << jaccard.SKETCH_BITS).astype(np.uint32)
    core = rng.integers(0, 2**63, n, dtype=np.uint64)
    x, y = (np.unique(np.concatenate([core, rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in (more, other))
    both = len(np.intersect1d(x, y))
    similar = 100 * both >= 85 * (len(x) + len(y) - both)
    assert jaccard.alike(x, y) == similar
    if similar:
        for order in range(jaccard.ORDERS):
            assert len(np.intersect1d(jaccard.prefix(x, counts, order), jaccard.prefix(y, counts, order)))
            assert len(np.intersect1d(jaccard.signature(x, counts, order), jaccard.signature(y, counts, order)))
        odd = int(np.bitwise_count(jaccard.parities(x) ^ jaccard.parities(y)).sum())
        assert odd * 185 <= (len(x) + len(y)) * 15
    large = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    halves = jaccard.wide(large).reshape(2, -1)
    assert (halves[0] ^ halves[1] == jaccard.parities(large, 1024)).all()


def test_parities_that_differ_in_a_top_bit_lose_no_pair():
    """Words of parities whose highest bit differs: signed, they would count the bits of an absolute value, 63 here."""
    test_filters_lose_no_pair.hypothesis.inner_test(48, 0, 8, 5)
    bits = np.zeros((2, 8), np.int64)
    bits[1, 3] = np.iinfo(np.int64).min + 1
    columns = {c: pa.array([v, v]) for c, v in (("token", 5), ("low", 0), ("high", 0), ("block", 0))}
    columns |= {"cid": pa.array([1, 2]), "n": pa.array([50, 50]), "root": pa.array([1, 2]), "parities": pa.array(list(bits), pa.list_(pa.int64()))}
    assert [f.to_pylist() for f in jaccard._cross_pairs([pa.RecordBatch.from_pydict(columns)], jaccard.OWN)] == [[{"a": 1, "partners": [2]}]]


def test_orders_filter_before_sets_move(spark):
    """Pairs that share a prefix shingle in the first order but not in one of the others go no further, whatever their sizes and parities."""
    same = [5] * 8
    rows = [(1, 10, same, [1, 2], [7]), (2, 10, same, [2, 9], [7, 8]), (3, 10, same, [2], [8]), (4, 10, same, [3], [7])]
    classes = spark.createDataFrame(rows, "cid long, n long, wide array<long>, order1 array<short>, order2 array<short>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3)], "a long, b long")
    assert sorted(tuple(r) for r in jaccard._allowed(pairs, classes, jaccard.OWN).collect()) == [(1, 2), (2, 3)]


def test_only_classes_of_fitting_pairs_tell_signatures(spark, monkeypatch):
    """What is stored of unrelated texts, which share a passage in their prefixes, is their sizes and parities: no postings, no signatures."""
    rng, kept = random.Random(3), []
    store = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df: kept.append(store(df)) or kept[-1])
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(12))
    rows = [(k, passage + " " + " ".join(word() for _ in range(200 + 40 * k))) for k in range(60)]
    rows += [(100, rows[0][1] + " end"), (101, rows[0][1])]
    assert result(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sum(d.count() for d in kept if "order1" in d.columns) == 2  # documents 0 and 100
    assert sum(len(plain_set(t)) for _, t in rows) * 0.15 > 10 * max(d.count() for d in kept if "token" in d.columns)


@pytest.mark.parametrize("n", [5, 600, 5000])
def test_parities_folded_from_wide_ones(spark, n):
    x = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    row = spark.createDataFrame([(jaccard.wide(x).view(np.int64).tolist(),)], "wide array<long>").select(jaccard._folded("wide")).first()[0]
    assert row == jaccard.parities(x).view(np.int64).tolist()


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert result(queries.op4_ngram_jaccard(spark, folder)) == brute(rows)


@pytest.mark.parametrize("block", [512, 4])
def test_planted_groups(spread, monkeypatch, block):
    """Chains of edits, a family that shares a passage, copies, odd rows; with blocks that split the family too."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(120)]
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "Two words"), (5, "two WORDS"), (6, "two wordz"), (None, "two words"), (None, "only here without an id"), (7, "É é a b c"), (7, "É é a b c")]
    for k in range(60):  # near copies: some links, some just not
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((100 + k, " ".join(w)))
    chain = [word() for _ in range(100)]
    for k in range(30):
        chain[3 * k + 1] = word()
        rows.append((200 + k, " ".join(chain)))
    passage = " ".join(word() for _ in range(60))
    rows += [(300 + k, passage + " " + " ".join(word() for _ in range(rng.randint(2, 40)))) for k in range(40)]
    long_ = [word() for _ in range(1026)]  # sets on either side of a power of two
    rows += [(500 + k, " ".join(long_[: 1020 + k] + ["end"] * (k % 2))) for k in range(6)] + [(510, " ".join(word() for _ in range(1026)))]
    rows += [(400 + k, "a copy of which there are many " * 3) for k in range(30)]
    rng.shuffle(rows)
    docs = spread.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, cid string, root int").repartition(5)
    assert result(jaccard.near_duplicates(docs)) == brute(rows)
    if block != 512:
        return
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = sorted([(d, t) for (d, t) in rows if d is None or not plain_set(t) or (d, len(plain_set(t)), d) in brute(rows)], key=repr)
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(docs).count() == 0 and jaccard.one_of_each(docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: r for x, r in parent.items() if r != x or any(x in e and e[0] != e[1] for e in edges)}
