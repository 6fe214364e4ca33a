"""Token ids of whole texts by a public tokenizer file, with a bounded store of pieces that the worker has encoded.

Prose repeats its words, and both kinds of tokenizer used here never join characters across the cuts made below, so each
piece between cuts is encoded once per worker (or task, where the store is given back at its end), as long as the store holds it, and looked up afterwards. The result equals encoding the whole text
(tested). Cuts, by `spaced`:

* False: the tokenizer drops white space; a text is cut at ASCII white space.
* True: a word carries the one space before it; a text is cut before a space that a non-space follows, and
  around a lone line feed.

A word of letters and the punctuation behind it are also cut apart: no token pattern joins them.

Texts are cut, hashed and put together as byte arrays, many at once. A store keeps a piece as a hash, its bytes and its ids, about
50 bytes in all. It has two generations: when the younger one is full it becomes the older, and a piece found there moves on
into the new younger one, so frequent words stay and rare ones go. A piece found is compared byte by byte; only among the
distinct pieces of one slice of texts do 64-bit hashes decide.
"""

from __future__ import annotations

import re

import numpy as np

from paneldrift.llm.words import Words, mix, words_of

#: Bytes that the store of a worker may take.
STORE = 64 << 20

_BEFORE_SPACE = re.compile(r" (?=\S)")
#: Words of these letters are one word to every token pattern, and take as many bytes in lower case.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: No token pattern joins a letter and one of these behind it.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,!%&*#$|")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
#: Bytes that a text cut at single spaces and line feeds may not hold: other white space, separators and NUL.
_ODD = np.zeros(256, bool)
_ODD[[0, 9, 11, 12, 13, 28, 29, 30, 31]] = True
# What stands before a piece: nothing, a space or a line feed.
_BEFORE = (b"", b" ", b"\n")

_encoders: dict = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One per worker; the tokenizer is kept between tasks, its store is given back by `release`."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def release() -> None:
    """Empty the worker's stores at the end of a task, where the next stage needs the memory for something else: workers live on."""
    for each in _encoders.values():
        each.young, each.old = Store(), Store()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every range, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Grown:
    """An array that is added to at its end."""

    def __init__(self, kind):
        self.array, self.size = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.array):
            self.array = np.concatenate([self.array[: self.size], np.empty(max(need, 3 * self.size // 2) - self.size, self.array.dtype)])
        self.array[self.size : need] = values
        self.size = need


class Store:
    """Pieces with their ids, found by hash and compared by their bytes."""

    def __init__(self):
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.bytes, self.ids = _Grown(np.uint8), _Grown(np.uint32)
        self.byte_ends, self.id_ends = _Grown(np.int64), _Grown(np.int64)

    def size(self) -> int:
        return sum(g.array.nbytes for g in (self.bytes, self.ids, self.byte_ends, self.id_ends)) + 12 * len(self.keys)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slot of each piece, -1 where the store does not have it."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        slot = self.slots[at[hit]].astype(np.int64)
        upto = self.byte_ends.array[slot]
        begin = np.where(slot > 0, self.byte_ends.array[slot - 1], 0)
        size = ends[hit] - starts[hit]
        same = upto - begin == size
        hit, slot, begin, size = hit[same], slot[same], begin[same], size[same]
        unlike = self.bytes.array[_ranges(begin, size)] != data[_ranges(starts[hit], size)]
        if unlike.any():
            wrong = np.unique(np.repeat(np.arange(len(hit)), size)[unlike])
            hit, slot = np.delete(hit, wrong), np.delete(slot, wrong)
        out[hit] = slot
        return out

    def get(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots, one after another, and how many each has."""
        upto = self.id_ends.array[slots]
        begin = np.where(slots > 0, self.id_ends.array[slots - 1], 0)
        return self.ids.array[_ranges(begin, upto - begin)], upto - begin

    def add(self, keys, data, starts, ends, ids, counts) -> None:
        """Keys ascend. A key that is there already, of other bytes then, is left out."""
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        first, sizes = self.byte_ends.size, ends - starts
        self.bytes.add(data[_ranges(starts, sizes)])
        self.ids.add(ids)
        for grown, each, before in ((self.byte_ends, sizes, self.bytes.size - int(sizes.sum())), (self.id_ends, counts, self.ids.size - int(counts.sum()))):
            grown.add(before + np.cumsum(each))
        self.slots = np.insert(self.slots, at[new], (first + np.flatnonzero(new)).astype(np.int32))
        self.keys = np.insert(self.keys, at[new], keys[new])


class Encoder:
    def __init__(self, path: str, spaced: bool, store: int = STORE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Bytes that each token stands for: both vocabularies write a byte as one character.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token.removesuffix(suffix))
        self.spaced, self.most = spaced, store
        self.young, self.old = Store(), Store()

    def _pieces(self, texts: list[str]):
        """Bytes of the texts, and of each piece start, end, what stands before it, and its text; pieces by place in the bytes."""
        import pyarrow as pa

        words = words_of(pa.array(texts, pa.string()))
        data, starts, ends = words.data, words.starts, words.ends
        row = np.repeat(np.arange(len(texts)), np.diff(words.firsts))
        if not self.spaced:
            return data, starts, ends, np.zeros(len(starts), np.uint8), row
        offsets = words.offsets
        bad = _ODD[data]
        blank = _BLANK[data]
        bad[:-1] |= blank[:-1] & blank[1:]  # at a border of texts too, where the blank at an end is odd anyhow
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        bad[first] |= blank[first]
        bad[last] |= blank[last]
        for lead, second, third in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
            at = np.flatnonzero(data == lead)
            at = at[np.isin(data[at + 1], second)] if len(at) else at
            bad[at if third is None or not len(at) else at[np.isin(data[at + 2], third)]] = True
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1)
        before = np.zeros(len(starts), np.uint8)
        inner = starts > offsets[row]
        before[inner] = np.where(data[starts[inner] - 1] == 32, 1, 2)
        if len(odd):
            keep = ~np.isin(row, odd)
            more = [(i, k > 0, p.encode()) for i in odd.tolist() for k, p in enumerate(_BEFORE_SPACE.split(texts[i])) if p]
            sizes = np.array([len(p) for _, _, p in more])
            begin = len(data) + np.cumsum(sizes) - sizes
            data = np.concatenate([data, np.frombuffer(b"".join(p for _, _, p in more), np.uint8)])
            starts, ends = np.concatenate([starts[keep], begin]), np.concatenate([ends[keep], begin + sizes])
            before = np.concatenate([before[keep], np.array([spaced for _, spaced, _ in more], np.uint8)])
            row = np.concatenate([row[keep], np.array([i for i, _, _ in more])])
        return data, starts, ends, before, row

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces and their counts. Words of letters go to the tokenizer in runs of many, told apart by their bytes
        if the letters are Latin, which is quicker, else by their number."""
        skip = int(self.spaced)
        latin, plain, other = [], [], []
        for i, w in enumerate(pieces):
            if skip and w[0] != " ":
                other.append(i)
            elif _LATIN.fullmatch(w, skip):
                latin.append(i)
            else:
                (plain if w[skip:].isalpha() else other).append(i)
        order, ids, counts = [], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        glue = "" if self.spaced else " "
        for k in range(0, len(latin), 1000):
            run = [pieces[i] for i in latin[k : k + 1000]]
            got = np.array(self.tokenizer.encode_batch_fast([glue.join(run)], add_special_tokens=False)[0].ids, np.uint32)
            ends, told = np.cumsum([len(w.encode()) for w in run]), np.cumsum(self.sizes[got])
            last = np.searchsorted(told, ends)
            if not len(got) or last[-1] != len(got) - 1 or (told[last] != ends).any():
                plain += latin[k : k + 1000]  # some token is not known by its bytes
                continue
            order += latin[k : k + 1000]
            ids.append(got)
            counts.append(np.diff(last, prepend=-1))
        for k in range(0, len(plain), 1000):
            run = plain[k : k + 1000]
            got = self.tokenizer.encode(glue.join([pieces[i] for i in run]), add_special_tokens=False)
            numbers = np.array(got.word_ids, dtype=np.int64)
            if len(numbers) == 0 or numbers[0] != 0 or numbers[-1] != len(run) - 1 or (np.diff(numbers) > 1).any():
                other += run  # some word is more than one word to the tokenizer
                continue
            order += run
            ids.append(np.array(got.ids, np.uint32))
            counts.append(np.bincount(numbers))
        for k in range(0, len(other), 1000):
            run = other[k : k + 1000]
            each = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in run], add_special_tokens=False)]
            order += run
            ids.append(np.array([x for e in each for x in e], np.uint32))
            counts.append(np.array([len(e) for e in each], np.int64))
        flat, sizes = np.concatenate(ids), np.concatenate(counts)
        place = np.argsort(np.array(order, np.int64))
        return flat[_ranges((np.cumsum(sizes) - sizes)[place], sizes[place])], sizes[place]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        data, starts, ends, before, row = self._pieces(texts)
        if not len(starts):
            return [b""] * len(texts)
        # Cut a word of letters from the punctuation behind it; letters are told by byte, of ASCII and Latin-1 alone.
        letter = _LETTER[data]
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        letter[latin] = letter[latin + 1] = True
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(letter, out=letters[1:])
        body = np.maximum.accumulate(np.where(_TAIL[data], -1, np.arange(len(data))))[ends - 1] + 1
        cut = (body > starts) & (body < ends) & (before < 2)
        cut &= letters[np.maximum(body, starts)] - letters[starts] == body - starts
        twice = 1 + cut
        tail = np.zeros(int(twice.sum()), bool)
        tail[np.cumsum(twice)[cut] - 1] = True
        starts, ends, body, before, row = (np.repeat(x, twice) for x in (starts, ends, body, before, row))
        head = np.zeros(len(tail), bool)
        head[:-1] = tail[1:]
        starts, ends, before = np.where(tail, body, starts), np.where(head, body, ends), np.where(tail, 0, before)

        keys = Words(data, np.zeros(1), starts, ends, np.zeros(1)).hashes()
        keys = mix(keys + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys, one, which = np.unique(keys, return_index=True, return_inverse=True)
        begin, upto, kind = starts[one], ends[one], before[one]
        slots = self.young.find(keys, data, begin, upto)
        known, missing = np.flatnonzero(slots >= 0), np.flatnonzero(slots < 0)
        earlier = self.old.find(keys[missing], data, begin[missing], upto[missing])
        moved, new = missing[earlier >= 0], missing[earlier < 0]
        told = [self.young.get(slots[known]), self.old.get(earlier[earlier >= 0])]
        raw = data.tobytes() if len(new) else b""
        told.append(self._encode([(_BEFORE[k] + raw[a:b]).decode() for a, b, k in zip(begin[new].tolist(), upto[new].tolist(), kind[new].tolist())]))
        for places, (ids, counts) in ((moved, told[1]), (new, told[2])):
            self.young.add(keys[places], data, begin[places], upto[places], ids, counts)
        if self.young.size() > self.most // 2:
            self.old, self.young = self.young, Store()

        ids, counts = (np.concatenate(x) for x in zip(*told))
        order = np.concatenate([known, moved, new])
        first, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        first[order], sizes[order] = np.cumsum(counts) - counts, counts
        if (np.diff(row) < 0).any():
            by_text = np.argsort(row, kind="stable")
            which, row = which[by_text], row[by_text]
        size = sizes[which]
        flat = ids[_ranges(first[which], size)].astype("<u4")
        edges = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(row, np.arange(len(texts) + 1))]
        return [flat[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def batches(batch, rows: int = 256):
    """Slices of an Arrow batch, so that a task holds the working data of few documents at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
