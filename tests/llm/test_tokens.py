"""Cached tokens, Simple-8b coding and packing, against plain encoding of whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paneldrift.llm import packing, queries, simple8b, tokens

SF = "/root/testdata/sf0.001"
CASES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
ODD = ["", " ", "a", "  a  b ", "a\n\nb", "a\n b", "foo.\nBar, baz's don't\t x", "x\x1cy\x1d z", "é́ é ΣΑΣ ς", "<|endoftext|> </s>",
       "a b 　c", "1234 5.6% ²x² x². ab²", "日本語 テスト。 a。", "🙂 🙂🙂", "İstanbul I", "a" * 3000, "_a_ _", "that's 'S", "\r\n x \r\n", "ab.,!? cd??"]


def whole(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def u4(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name,spaced", CASES)
def test_cached_encoding_is_whole_encoding(spark, name, spaced):
    path = public_tokenizers.path(name)
    texts = ODD + [r[0] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    enc = tokens.Encoder(path, spaced)
    for _ in range(2):  # empty and filled cache
        assert enc.encode(texts) == [u4(x) for x in whole(path, texts)]


@pytest.mark.parametrize("name,spaced", CASES)
def test_latin_words_are_told_apart_by_bytes(monkeypatch, name, spaced):
    """Runs of Latin words need no numbers of words, which cost the tokenizer offsets; other letters still do."""
    path = public_tokenizers.path(name)
    letters = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha()]
    rng = np.random.default_rng(3)
    latin = [" " * spaced + "".join(rng.choice([x for x in letters if x not in "ªµº"], n)) for n in rng.integers(1, 20, 3000)] + [" " * spaced + w for w in ("ß", "ÿ", "ÉÉ", "s", "ll")]
    enc = tokens.Encoder(path, spaced)
    flat, counts = enc._encode(latin + [" " * spaced + w for w in ("ªa", "µ", "Σς", "İ", "a1", "Ÿ")])
    want = whole(path, latin + [" " * spaced + w for w in ("ªa", "µ", "Σς", "İ", "a1", "Ÿ")])
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]

    class Fast:
        def encode_batch_fast(self, texts, add_special_tokens):
            return plain.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    plain = enc.tokenizer
    monkeypatch.setattr(enc, "tokenizer", Fast())
    assert enc._encode(latin)[0].tolist() == [i for x in want[: len(latin)] for i in x]
    enc.sizes = enc.sizes * 0  # a vocabulary that is not known by bytes goes the other way
    monkeypatch.setattr(enc, "tokenizer", plain)
    assert enc._encode(latin)[0].tolist() == [i for x in want[: len(latin)] for i in x]


@pytest.mark.parametrize("name,spaced", CASES)
def test_small_store_turns_over(spark, name, spaced):
    """Both generations are dropped many times over, and frequent words still come from the store."""
    path = public_tokenizers.path(name)
    texts = [r[0] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    enc = tokens.Encoder(path, spaced, store=200_000)
    asked = []
    plain = enc._encode
    enc._encode = lambda pieces: asked.append(len(pieces)) or plain(pieces)
    for i in range(0, len(texts), 10):
        assert enc.encode(texts[i : i + 10]) == [u4(x) for x in whole(path, texts[i : i + 10])]
        assert enc.young.size() + enc.old.size() < 1_000_000
    assert enc.old.keys.size and sum(asked) < 0.7 * sum(len(t.split()) for t in texts)


def test_a_piece_with_the_hash_of_another_is_not_taken_for_it():
    store, key = tokens.Store(), np.array([5], np.uint64)
    data = np.frombuffer(b"abcabd", np.uint8)
    at = lambda x: (data, np.array([x]), np.array([x + 3]))
    store.add(key, *at(0), np.array([1, 2], np.uint32), np.array([2]))
    assert store.find(key, *at(0)).tolist() == [0] and store.find(key, *at(3)).tolist() == [-1]
    store.add(key, *at(3), np.array([7], np.uint32), np.array([1]))
    assert store.find(key, *at(0)).tolist() == [0] and [x.tolist() for x in store.get(np.array([0]))] == [[1, 2], [2]]


@pytest.mark.parametrize("name,spaced", CASES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="aB'st re\n\t .,é²1_日\x1c ", max_size=30))
def test_cuts_are_safe(name, spaced, text):
    path = public_tokenizers.path(name)
    assert tokens.encoder(path, spaced).encode([text])[0] == u4(whole(path, [text])[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=2600))
def test_simple8b_round_trip(ids):
    words, offsets = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(words, offsets, len(ids)).tolist() == ids
    for b in range(len(offsets)):
        assert simple8b.decode_block(words, offsets, len(ids), b).tolist() == ids[b * 1024 : (b + 1) * 1024]


def test_simple8b_packs_as_many_as_fit():
    words, _ = simple8b.encode(np.array([1] * 60 + [2**15 - 1] * 8 + [2**20 - 1] * 3, np.uint64))
    assert len(words) == 1 + 2 + 1


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        side = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * d)], axis=1)
        keys = packing.hilbert(side, bits)
        assert sorted(keys.tolist()) == list(range(len(side)))
        steps = np.abs(np.diff(side[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i // 2, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(None, None, None, None, None), (7, "word " * 5000, "x", "s", 2), (7, "word " * 5000, "x", "s", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("n_chars", "key")


def test_tokens_file(spark, odd_docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    simple8b.write_tokens(odd_docs, f"file://{tmp_path}/t", path, False, 2)
    got = sorted(simple8b.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in odd_docs.collect()), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    want = sorted(((r["doc_id"], u4([*whole(path, [r["text"] or ""])[0], 2])) for r in odd_docs.collect()), key=repr)
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=repr) == want


def test_tokens_file_of_an_empty_table(spark, odd_docs, tmp_path):
    simple8b.write_tokens(odd_docs.where("false"), f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), False, 2)
    assert simple8b.read_tokens(spark, f"file://{tmp_path}/t").count() == 0


def check_pieces(rows, want, length):
    """Pieces make up every document once, and sequences without gaps."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)
        lengths.append(at)
    docs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["start"], r["sequence_id"], r["offset"])):
        docs[r["doc_id"]].append(bytes(r["ids"]))
    assert sum(map(len, (b"".join(x) for x in docs.values()))) == sum(len(x) for _, x in want)
    return docs


def test_packing(spark, odd_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    distinct = odd_docs.where("doc_id is null or doc_id <> 7").dropDuplicates(["doc_id"])
    want = [(r["doc_id"], u4([*whole(path, [r["text"] or ""])[0], 0])) for r in distinct.collect()]
    docs = check_pieces(packing.pack(distinct, path, True, 0, 64).collect(), want, 64)
    assert {d: b"".join(x) for d, x in docs.items()} == dict(want)
    every = [(r["doc_id"], u4([*whole(path, [r["text"] or ""])[0], 0])) for r in odd_docs.collect()]
    check_pieces(packing.pack(odd_docs, path, True, 0).collect(), every, 1024)
    assert packing.pack(odd_docs.where("false"), path, True, 0).count() == 0


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of one language come in runs: far fewer changes of language along the curve than by chance."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.keyed(docs, public_tokenizers.path("byte_bpe_50k.json"), True, 0).join(docs, "doc_id").select("key", "lang").collect()
    langs = [r["lang"] for r in sorted(rows, key=lambda r: r["key"])]
    changes = sum(a != b for a, b in zip(langs, langs[1:])) / len(langs)
    shares = [langs.count(x) / len(langs) for x in set(langs)]
    assert changes < 0.6 * (1 - sum(s * s for s in shares))


def test_queries(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    words = {r["doc_id"]: u4([*x, 2]) for r, x in zip(rows, whole(queries.WORDS, [r["text"] or "" for r in rows]))}
    got = sorted(queries.op2_simple8b(spark, SF).collect())
    assert [r["doc_id"] for r in got] == sorted(words)
    assert all(r["ids_crc32"] == zlib.crc32(words[r["doc_id"]]) and r["n_tokens"] * 4 == len(words[r["doc_id"]]) for r in got)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]
    ids = {r["doc_id"]: u4([*x, 0]) for r, x in zip(rows, whole(queries.BYTES, [r["text"] or "" for r in rows]))}
    for r in queries.op3_curve_packing(spark, SF).collect():
        piece = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] * 4 == len(ids[r["doc_id"]])
