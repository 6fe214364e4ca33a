"""Periodic runs against every period tried at every place, and the texts that are left."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks import compare
from paneldrift.llm import periods, queries

SF = "/root/testdata/sf0.001"
NO_RUNS = hashlib.sha256(b"").hexdigest()


def plain(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q):
                if all(any(words[k] != words[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=70), st.integers(1, 14), st.integers(1, 30))
def test_runs_of_any_word_sequence(words, least, period):
    for told in (words, [words[i % min(period, len(words))] for i in range(len(words))]):
        assert periods.runs_of(told, least) == plain(told, least)


def test_every_square_is_met_where_it_ends():
    words = [0, 1, 0, 1, 0, 0, 1, 0, 0]
    found = sorted(periods.squares(words))
    wanted = [
        (i, p)
        for i in range(len(words))
        for p in range(1, (i + 1) // 2 + 1)
        if (u := words[i - p + 1 : i + 1]) == words[i - 2 * p + 1 : i - p + 1] and not any(p % k == 0 and u == u[:k] * (p // k) for k in range(1, p))
    ]
    assert found == sorted(wanted)


def of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in periods.find_runs(rows).collect()}


def test_texts_with_and_without_runs(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "x " + "a b " * 8 + "y"]
    for _ in range(60):
        body = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.6 and body:
            body += body[-rng.randint(1, len(body)) :] * rng.randint(1, 4)
        texts.append(rng.choice([" ", "\n", "\t  "]).join(body))
    texts.append(" é　 " * 15)  # other spaces belong to words
    found = of(spark, texts)
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        runs = plain(words)
        assert [tuple(r) for r in found[i]["runs"]] == runs
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        assert found[i]["collapsed"].encode() == b" ".join(w for k, w in enumerate(words) if k not in gone)
        assert found[i]["n_words"] == len(words)


def test_very_long_text(spark):
    rng = random.Random(6)
    prose = [str(rng.randrange(3000)) for _ in range(40_000)]
    text = " ".join(prose + ["w"] * 30_000 + prose[:20_000] * 3)
    (found,) = of(spark, [text]).values()
    assert [tuple(r) for r in found["runs"]] == [(40_000, 30_000, 1), (70_000, 60_000, 20_000)]


def test_stretches_hold_all_runs(spark):
    """A passage that two documents share, or that comes twice in one without a run, is no stretch of the other."""
    passage = " ".join(f"p{i}" for i in range(40))
    found = of(spark, [passage, passage + " middle " + passage, passage + " " + passage])
    assert [len(found[i]["runs"]) for i in range(3)] == [0, 0, 1]


def test_odd_tables(spark):
    rows = [(None, "a " * 20, 1), (7, "b " * 20, 2), (7, "b " * 20, 2), (8, None, 3)]
    got = periods.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    assert sorted((r["doc_id"] or -1, len(r["runs"])) for r in got) == [(-1, 1), (7, 1), (7, 1), (8, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periods.digests(periods.find_runs(periods.with_planted_runs(empty))).collect() == []


def test_planted_runs_and_digests(spark):
    texts = {i: " ".join(f"w{k}" for k in range(i % 97)) for i in range(300)}
    texts[301] = None
    df = spark.createDataFrame([*texts.items(), (None, "x y")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in periods.digests(periods.find_runs(periods.with_planted_runs(df))).collect()}
    for i, text in texts.items():
        words, h = (text or "").split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = plain(words)
        told = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        row = found[i]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(left.encode()).hexdigest()
    assert found[301]["runs_sha256"] == found[301]["collapsed_sha256"] == NO_RUNS
    assert found[None]["n_runs"] == 0


@pytest.mark.parametrize("name", ["op13_periodic_runs"])
def test_query_against_sql(spark, name):
    con = compare.open_tables(SF)
    result, _ = compare.compare(spark, con, SF, queries.queries()[name], queries.oracle()[name])
    assert result.startswith("ok"), result
