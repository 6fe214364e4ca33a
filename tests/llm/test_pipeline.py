"""The stages one by one against plain readings of what each should do to its own input, and the whole run."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from paneldrift.llm import quality
from tests.llm.test_jaccard import brute, plain_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        out.append((name, docs))
    return [(n, d.columns, d.collect()) for n, d in out]


def test_columns(steps):
    assert [n for n, *_ in steps[1:]] == ["quality classifier", "near duplicates", "secret scans", "mix sources", "pack sequences"]
    assert all(c == steps[0][1] for _, c, _ in steps[1:-1])


def test_quality(spark, steps):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in quality.score(docs, labels).collect() if r["predicted"]}
    assert sorted(steps[1][2], key=lambda r: r["doc_id"]) == sorted((r for r in steps[0][2] if r["doc_id"] in good), key=lambda r: r["doc_id"])
    marked = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert marked <= good


def test_near_duplicates(steps):
    want = {d for d, n, c in brute([(r["doc_id"], r["text"]) for r in steps[1][2]]) if d == c or not n}
    assert {r["doc_id"] for r in steps[2][2]} == want and len(steps[2][2]) == len(want)


def brute_components(rows, k, need, of):
    """doc_id and least linked doc_id, by comparing all pairs of sets of k-word shingles."""
    words = [re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)} - {()} for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and of * both >= need * (len(x) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda r: rows[r][0])
                root[b] = a
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def test_near_duplicates_by_the_rule_of_the_stage(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(1, "four words make one"), (2, "four words make one"), (3, "four words make one more"), (4, "four words make one More")]
    for family in range(12):  # edits that leave similarities on both sides of 0.8
        base = [word() for _ in range(90)]
        rows.append((100 * family + 10, " ".join(base)))
        for k in range(12):
            w = list(base)
            for at in rng.choice(90, k % 4, replace=False):
                w[at] = word()
            rows.append((100 * family + 11 + k, " ".join(w)))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, source string").repartition(4)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    stage = {d for d, c in brute_components(rows, 5, 80, 100).items() if d == c}
    assert kept == stage
    assert stage < {d for d, c in brute_components(rows, 4, 85, 100).items() if d == c}


def test_secrets(steps):
    before = {r["doc_id"]: r for r in steps[2][2]}
    assert len(steps[3][2]) == len(before)
    for r in steps[3][2]:
        assert r["n_chars"] == len(r["text"]) and not re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r["text"])
        old = before[r["doc_id"]]["text"]
        if r["text"] != old:
            assert "[secret]" in r["text"] and plain_set(old) & plain_set(r["text"]) or len(old) < 200


def test_mix(steps):
    copies = Counter(r["doc_id"] for r in steps[4][2])
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert max(copies.values()) <= 3
    rows = {r["doc_id"]: r for r in steps[3][2]}
    assert all(rows[r["doc_id"]] == r for r in steps[4][2])
    total = sum(words(r["text"]) for r in rows.values())
    taken = sum(words(rows[d]["text"]) * k for d, k in copies.items())
    largest = defaultdict(int)
    for r in rows.values():
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    assert abs(taken - total) <= sum(largest.values())


def test_packing(steps):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in steps[3][2]}
    copies = Counter(r["doc_id"] for r in steps[4][2])
    got = Counter()
    for r in steps[5][2]:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        got[r["doc_id"]] += r["length"]
    assert got == {d: k * len(ids[d]) for d, k in copies.items()}


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == len(steps[-1][2])
