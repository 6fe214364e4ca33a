"""Secrets in plain text and under nested encodings.

A worklist of layers starts with the text itself. Each layer is scanned, and each decoder (URL escapes, Unicode escapes,
base64, base64 of compressed data) that changes it adds a layer. A layer seen before is not taken again, so cycles
end, and the list is done when no decoder finds anything new. Every character of a layer knows the span of the text it
came from; a find is reported by that span, with the decoders that led to it.

Defined results: a null or empty text has no finds; spans are in code points, end exclusive, by start, then kind, then end; the
same span found again in a deeper layer is listed once, at the shallowest; repeated rows are scanned each; other columns
do not matter; an empty table gives an empty one.

Bytes under base64 are unpacked until they are no longer compressed, with all members and what follows them. Bytes that are no UTF-8 become one
character each; UTF-16 and UTF-32 of one-byte characters are a layer of their own. Compressed data are known by their first bytes. What one run
holds beyond SPLICED characters is scanned apart from the text around it, but for its ends; beyond MOST_DECODED it is scanned in overlapping
pieces, up to MOST_READ characters, and `complete` is false: an encoded part longer than the overlap may be cut there. `redact` takes such a
run out as a whole. Data can unpack to themselves without end, hence MOST_READ and MOST_LEVELS.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import zlib
from collections import deque
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneldrift.llm.tokens import batches

KINDS = ("assign", "access", "hex")
#: Characters under one run that are put in its place, that are held at once, and that are read; and levels of compression.
SPLICED, MOST_DECODED, MOST_READ = 1 << 22, 1 << 26, 1 << 32
MOST_LEVELS = 64
#: Bytes that are unpacked in one go, and kept in case that they are not compressed after all.
PIECE, KEPT = 1 << 20, 1 << 16

# The patterns of the base rules. Runs of the last two are matched whole, so their least length is in the pattern.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST_VALUE = 12

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_MORE = re.compile(r"[ \t]*(?:\\?\r?\n|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/_-]+={0,2})")
_WIDE = re.compile("(?:[\x01-\xff]\0\0\0){4,}|(?:\0\0\0[\x01-\xff]){4,}|(?:[\x01-\xff]\0){4,}|(?:\0[\x01-\xff]){4,}")
_NOT_TEXT = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffe\uffff]")

FINDS = "doc_id bigint, finds array<struct<kind: string, start: bigint, end: bigint, layers: string>>, complete boolean"


def scan(text: str):
    """kind, start, end of the base rules, leftmost and without overlaps per kind."""
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= _LEAST_VALUE:
            yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(text):
        yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _url(text: str, _):
    for m in _URL.finditer(text):
        data = bytes.fromhex(m[0].replace("%", ""))
        try:
            plain = data.decode()
            ends = 3 * np.cumsum([len(c.encode()) for c in plain])
        except UnicodeDecodeError:
            plain = data.decode("latin-1")
            ends = 3 * np.arange(1, len(plain) + 1)
        yield m.start(), m.end(), plain, np.concatenate(([0], ends[:-1])), ends


def _unicode(text: str, _):
    for m in _UNICODE.finditer(text):
        parts, k = [], 0
        found = list(_ONE.finditer(m[0]))
        codes = [int(x[4]) if x[4] else int(x[1] or x[2] or x[3], 16) for x in found]
        while k < len(codes):
            code, first, last = codes[k], found[k].start(), found[k].end()
            if 0xD800 <= code < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1] < 0xE000:
                code, last, k = 0x10000 + ((code - 0xD800) << 10) + codes[k + 1] - 0xDC00, found[k + 1].end(), k + 1
            if 0xD800 <= code < 0xE000 or code > 0x10FFFF:
                parts += [(c, first + i, first + i + 1) for i, c in enumerate(m[0][first:last])]  # no character: stays
            else:
                parts.append((chr(code), first, last))
            k += 1
        plain, starts, ends = zip(*parts)
        if "".join(plain) != m[0]:
            yield m.start(), m.end(), "".join(plain), np.array(starts), np.array(ends)


def _wide(text: str, _):
    for m in _WIDE.finditer(text):
        plain = m[0].replace("\0", "")
        size = len(m[0]) // len(plain)
        yield m.start(), m.end(), plain, np.arange(len(plain)) * size, np.arange(1, len(plain) + 1) * size


def _kind(data: bytes) -> str | None:
    if data[:3] == b"\x1f\x8b\x08":
        return "gzip"
    if data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0:
        return "zlib"
    return "bzip2" if data[:3] == b"BZh" else "xz" if data[:6] == b"\xfd7zXZ\x00" else "zstandard" if data[:4] == b"\x28\xb5\x2f\xfd" else None


def _opener(kind: str):
    if kind == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]()


def _headed(pieces):
    """The first bytes of a stream, and the stream from its begin."""
    pieces, head = iter(pieces), b""
    for x in pieces:
        head += x
        if len(head) >= 8:
            break
    return head, chain([head], pieces)


def _unpacked(pieces, spoilt):
    """A compressed stream's plain bytes: all members, then whatever follows them; damaged data stay as they are, and are `spoilt` where nothing
    came out before."""
    first = True
    while True:
        head, pieces = _headed(pieces)
        if not (kind := _kind(head)):
            yield from pieces
            return
        opener, kept, made, rest = _opener(kind), b"", False, None
        # A zstandard block of four bytes can make 128 KiB, and its reader knows no limit: small slices.
        slices = (x[k : k + 512] for x in pieces for k in range(0, len(x), 512)) if kind == "zstandard" else pieces
        for data in slices:
            if len(kept) <= KEPT:
                kept += data
            more = True
            while more and rest is None:
                try:
                    if kind == "zstandard":
                        out, data, more = opener.decompress(data), b"", False
                    elif kind in ("gzip", "zlib"):
                        out = opener.decompress(data, PIECE)
                        data = opener.unconsumed_tail
                        more = bool(data) or len(out) == PIECE
                    else:
                        out, data = opener.decompress(data, PIECE), b""
                        more = not opener.eof and not opener.needs_input
                except Exception as error:  # zstandard's own class of errors is not known without the library
                    if not isinstance(error, (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)) and type(error).__name__ != "ZstdError":
                        raise
                    if first and not made:
                        spoilt.append(kind)
                    yield b"\n" * made + (kept if len(kept) <= KEPT else data)
                    yield from slices
                    return
                if out:
                    made = True
                    yield out
                if opener.eof:
                    rest = opener.unused_data
            if rest is not None:
                break
        if rest is None:  # cut off
            if first and not made:
                spoilt.append(kind)
            if len(kept) <= KEPT:
                yield b"\n" * made + kept
            return
        first = False
        after = chain([rest], slices)
        head = next((x for x in after if x.strip(b"\0")), None)  # members may be padded
        if head is None:
            return
        pieces = chain([head.lstrip(b"\0")], after)


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


class Reader:
    """Reads what is under one run of the text; `whole` is false when something was not read in one piece."""

    def __init__(self, depth: int = 0):
        self.left, self.whole, self.depth, self.apart = MOST_READ, True, depth, []

    def unpack(self, data: bytes) -> str | None:
        """Text of compressed bytes, None where they are not. Long texts are scanned here: their ends are returned, their finds put to `apart`."""
        if not _kind(data):
            return None
        pieces, levels = iter([data]), 0
        while True:
            head, pieces = _headed(pieces)
            if not _kind(head):
                break
            if levels == MOST_LEVELS:
                self.whole = False
                break
            spoilt = []
            head, pieces = _headed(_unpacked(pieces, spoilt))
            if spoilt:
                break
            levels += 1
        held, size = [], 0
        for x in pieces:
            held.append(x)
            size += len(x)
            self.left -= len(x)
            if size > MOST_DECODED or self.left < 0:
                break
        first = b"".join(held)
        if first == data:
            return None
        if size <= SPLICED and size <= MOST_DECODED and self.left >= 0:
            return _text(first)
        ends = min(SPLICED, MOST_DECODED) // 16
        begin = _text(first[:ends])
        if size <= MOST_DECODED and self.left >= 0:
            self.scan(_text(first))
            return f"{begin}\n{_text(first[-ends:])}"
        self.whole = False
        step = min(SPLICED, MOST_DECODED)
        window = bytearray(first)
        while True:
            while len(window) >= step:
                self.scan(_text(bytes(window[:step])))
                del window[: step - ends]
            if self.left < 0 or not (x := next(pieces, b"")):
                break
            self.left -= len(x)
            window += x
        self.scan(_text(bytes(window)))
        return f"{begin}\n{_text(bytes(window[-ends:]))}"

    def scan(self, text: str) -> None:
        if self.depth > 20:
            self.whole = False
            self.apart += [(k, "") for k, *_ in scan(text)]
            return
        finds, unread = _unwrap(text, self)
        self.apart += [(k, way) for k, _, _, way in finds]
        self.whole = self.whole and not unread


def _bytes_of(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    return None if len(body) % 4 == 1 else binascii.a2b_base64(body + "=" * (-len(body) % 4))


def _plain(run: str, reader: Reader) -> tuple[str, str] | None:
    """Text under a base64 run, and whether it is "packed", "text" or "bytes"; bytes that no rule or decoder can meet are left out."""
    data = _bytes_of(run)
    if not data:
        return None
    packed = reader.unpack(data)
    if packed is not None:
        return (packed, "packed") if packed else None
    try:
        text = data.decode()
        if not _NOT_TEXT.search(text):
            return text, "text"
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    if any(True for _ in scan(text)) or any(sign.search(text) for _, sign, _ in DECODERS):
        return text, "bytes"
    return None


def _lines(text: str, m):
    """The places of a run's characters when it goes on in the lines below, without them, or None. Lines are equally long but for the last."""
    spans = [m.span()]
    while text[spans[-1][1] - 1] != "=" and (more := _MORE.match(text, spans[-1][1])):
        size = spans[-1][1] - spans[-1][0]
        longest = max(b - a for a, b in spans)
        if len(spans) > 1 and (size < longest or len(more[1].rstrip("=")) > longest):
            break
        spans.append(more.span(1))
    return spans


def _base64(text: str, reader_of):
    upto = 0
    for m in _BASE64.finditer(text):
        if m.start() < upto:
            continue
        spans = _lines(text, m)
        done = False
        for n in range(len(spans), max(len(spans) - 2, 1), -1):  # the last may be a word of the line below
            reader = reader_of()
            joined = "".join(text[a:b] for a, b in spans[:n])
            if (found := _plain(joined, reader)) and found[1] != "bytes" or (found and n == len(spans)):
                at, end = spans[0][0], spans[n - 1][1]
                if found[1] == "packed":
                    starts, ends = np.zeros(len(found[0]), np.int64), np.full(len(found[0]), end - at)
                else:
                    where = np.concatenate([np.arange(a, b) for a, b in spans[:n]]) - at
                    last = np.cumsum([len(c.encode()) for c in found[0]]) if found[1] == "text" else _ends(found[0], joined)
                    first = np.concatenate(([0], last[:-1]))
                    starts, ends = where[first * 4 // 3], where[np.minimum(-(-last * 4 // 3), len(joined)) - 1] + 1
                yield at, end, found[0], starts, ends, reader
                upto, done = end, True
                break
        if done:
            continue
        runs = [(m.start(), m[0])]
        if re.search("[/_-]", m[0]):  # a path or a compound word around the encoded part
            runs += [(m.start() + x.start(), x[0]) for x in re.finditer(r"[A-Za-z0-9+]{16,}={0,2}", m[0])]
        got = []
        for at, run in runs:
            reader = reader_of()
            if found := _plain(run, reader):
                got.append((at, run, *found, reader))
                if len(got) == 1 and at == m.start() and run == m[0] and found[1] != "bytes":
                    break
        if len(got) > 1 and got[0][1] == m[0]:  # bytes of the whole run only where no part of it is text
            got = got[1:] if any(x[3] != "bytes" for x in got[1:]) else got[:1]
        for at, run, plain, kind, reader in got:
            if kind == "packed":
                starts, ends = np.zeros(len(plain), np.int64), np.full(len(plain), len(run))
            else:
                last = np.cumsum([len(c.encode()) for c in plain]) if kind == "text" else _ends(plain, run)
                first = np.concatenate(([0], last[:-1]))
                starts, ends = first * 4 // 3, np.minimum(-(-last * 4 // 3), len(run))
            yield at, at + len(run), plain, starts, ends, reader


def _ends(plain: str, run: str) -> np.ndarray:
    """Where each character's bytes end, for text of either decoding."""
    data = _bytes_of(run)
    return np.arange(1, len(plain) + 1) if len(data) == len(plain) else np.cumsum([len(c.encode()) for c in plain])


DECODERS = (("url", re.compile("%[0-9A-Fa-f]{2}"), _url), ("unicode", re.compile(r"\\[uUx]|&#"), _unicode), ("wide", _WIDE, _wide), ("base64", _BASE64, _base64))


def _unwrap(text: str, above: Reader | None = None) -> tuple[list[tuple[str, int, int, str]], list[tuple[int, int]]]:
    """All finds of a text as (kind, start, end, layers), and the spans that were not read in one piece."""
    finds, unread = {(k, a, b): "" for k, a, b in scan(text)}, set()
    work, seen = deque([(text, None, None, "")]), {text}

    def reader_of():
        reader = Reader(above.depth + 1 if above else 0)
        if above:
            reader.left = above.left
        return reader

    while work:
        layer, starts, ends, way = work.popleft()
        for name, sign, decoder in DECODERS:
            if not sign.search(layer):
                continue
            parts, froms, tos, at = [], [], [], 0
            own = (np.arange(len(layer)), np.arange(1, len(layer) + 1)) if starts is None else (starts, ends)
            path = f"{way}>{name}" if way else name
            for a, b, plain, firsts, lasts, *reader in decoder(layer, reader_of):
                parts += [layer[at:a], plain]
                froms += [own[0][at:a], own[0][a + np.minimum(firsts, b - a - 1)]]
                tos += [own[1][at:a], own[1][a + np.maximum(lasts, 1) - 1]]
                at = b
                if reader:
                    span = int(own[0][a:b].min()), int(own[1][a:b].max())
                    for kind, deeper in reader[0].apart:
                        finds.setdefault((kind, *span), f"{path}>{deeper}" if deeper else path)
                    if not reader[0].whole:
                        unread.add(span)
                    if above:
                        above.left = min(above.left, reader[0].left)
            if not parts:
                continue
            child = "".join([*parts, layer[at:]])
            if child in seen:
                continue
            seen.add(child)
            starts_, ends_ = np.concatenate([*froms, own[0][at:]]), np.concatenate([*tos, own[1][at:]])
            for kind, a, b in scan(child):
                finds.setdefault((kind, int(starts_[a]), int(ends_[a:b].max())), path)
            work.append((child, starts_, ends_, path))
    order = sorted(finds.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
    return [(*span, way) for span, way in order], sorted(unread)


def find(text: str) -> tuple[list[tuple[str, int, int, str]], bool]:
    """All finds of a text as (kind, start, end, layers), and whether all layers were unpacked in one piece."""
    finds, unread = _unwrap(text)
    return finds, not unread


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, finds and complete for every row."""

    def found(frames):
        import pyarrow as pa

        one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())])
        for frame in frames:
            for piece in batches(frame):
                finds, complete = zip(*(find(t or "") for t in piece.column("text").to_pylist()))
                rows = [[dict(zip(("kind", "start", "end", "layers"), x)) for x in each] for each in finds]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(rows, pa.list_(one)), pa.array(complete, pa.bool_())], ["doc_id", "finds", "complete"]
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(found, FINDS)


def cleaned(text: str, mark: str) -> str:
    out, last = [], 0
    finds, unread = _unwrap(text)
    for a, b in sorted([(a, b) for _, a, b, _ in finds] + unread):
        if a > last or not out:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every found span, and every run that was not read in one piece, replaced by `mark`; spans that touch or overlap are
    replaced as one."""

    def redacted(frames):
        import pyarrow as pa

        for frame in frames:
            for piece in batches(frame):
                k = piece.schema.get_field_index("text")
                texts = [t and cleaned(t, mark) for t in piece.column("text").to_pylist()]
                yield piece.set_column(k, piece.schema.field(k), pa.array(texts, piece.schema.field(k).type))

    return docs.mapInArrow(redacted, docs.schema)


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def digests(finds: DataFrame) -> DataFrame:
    """Counts and hash of the finds in the plain text, all spans as one string, and whether all layers were unpacked in one piece."""
    plain = F.filter("finds", lambda x: x["layers"] == F.lit(""))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(F.filter(plain, _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return finds.select("doc_id", *counts, F.sha2(told(plain), 256).alias("base_sha256"), told(F.col("finds")).alias("spans"), "complete")
