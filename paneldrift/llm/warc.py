"""WARC archives: pages to records of one gzip member each, and a sequential reader that checks them.

`write_warc` marks pages of equal payload first: of those of LEAST bytes or more, the one with the largest page_id becomes the
response and the others revisits of it, which carry no payload. Each task writes files of about FILE bytes; the folder's table
`_files` lists the files of the attempts that Spark has taken, so files that a lost or repeated attempt left behind are not read.

`read_warc` reads one file per task from front to back: zlib decompresses a member piece by piece, the record's Content-Length
frames its block, SHA-1 runs along over block and payload, and both are compared with the record's digests. A record that
breaks a rule comes with the reason in `problem`, and reading goes on with the next gzip member that holds a record. At most one
payload and one piece are held, none where payloads are not wanted.

Record ids are <urn:page:ID:DIGEST> of page_id and payload, so what a revisit refers to is read from the record alone.

Defined results: a null html is an empty payload; null page_ids come last among equal payloads and give an empty ID; rows that
repeat the largest page_id of a payload are all responses; a null url gives no WARC-Target-URI, characters that a header cannot
hold are percent-encoded in it; extra columns are ignored; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneldrift.operators.enrich import join_weighted
from paneldrift.session import stored

#: Payloads of fewer bytes are always written out.
LEAST = 1000
#: Bytes of an archive, about, and of a piece that is read or decompressed at a time.
FILE, PIECE = 1 << 28, 1 << 20

# Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_MOST_HEADER = 1 << 20

RECORDS = (
    "file string, offset bigint, record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary, problem string"
)


def _located(uri: str):
    """File system and path of a URI as Spark tells it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


# --- writing


def with_record_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html with payload_digest, payload_bytes, record_type and refers_to.

    Copies are folded to one row per payload before any page moves. Pages then meet that row at as many tasks as the
    payload's number of copies asks for.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    known = pages.select("page_id", "url", "html", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))
    key = ["payload_digest", "payload_bytes"]
    copies = known.where(F.col("payload_bytes") >= least).groupBy(*key).agg(F.max("page_id").alias("head"), F.count("*").alias("copies"))
    copies = stored(copies.where("copies > 1 AND head IS NOT NULL"))
    joined = join_weighted(known, copies, key, "copies", F.xxhash64("page_id", "url"))
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("head")) & F.col("head").isNotNull(), F.lit(False))
    return joined.select(
        "page_id", "url", "html", *key,
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("head")).alias("refers_to"),
    )


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + _END) + squeeze.flush()


def _named(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_record(page_id, url, html, digest, size, kind, refers_to, date: str, level: int) -> bytes:
    """The gzip member of a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + (html or "").encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _named(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        fields += [("WARC-Refers-To", _named(refers_to, digest)), ("WARC-Profile", SAME_PAYLOAD)]
    payload = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    fields += [("WARC-Payload-Digest", payload), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, block, level)


def write_warc(pages: DataFrame, folder: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", level: int = 6, file_bytes: int = FILE) -> DataFrame:
    """Write a record for each row of page_id, url, html; the table of files written: file, records, bytes."""
    folder = folder.rstrip("/")

    def written(batches):
        import pyarrow as pa

        store, path = _located(folder)
        store.create_dir(path, recursive=True)
        out, done, told = None, 0, []
        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                if out is None:
                    name = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, done = store.open_output_stream(f"{path}/{name}", compression=None), 0
                    told.append([f"{folder}/{name}", 0, 0])
                    about = f"software: paneldrift\r\nformat: {VERSION}\r\n".encode()
                    done += out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], about, level))
                done += out.write(page_record(*row.values(), date, level))
                told[-1][1:] = told[-1][1] + 1, done
                if done >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*told) if told else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    typed = with_record_types(pages, least)
    rows = typed.select("page_id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to")
    rows.mapInArrow(written, "file string, records bigint, bytes bigint").write.parquet(f"{folder}/_files")
    return pages.sparkSession.read.parquet(f"{folder}/_files")


# --- reading


class _Bad(Exception):
    pass


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, stream, start: int):
        stream.seek(start)
        self.stream, self.engine, self.raw, self.have = stream, zlib.decompressobj(wbits=31), b"", b""

    def more(self) -> bool:
        """Decompress another piece; False at the end of the member."""
        while not self.engine.eof:
            self.raw = self.raw or self.stream.read(PIECE)
            if not self.raw:
                raise _Bad("truncated")
            try:
                got = self.engine.decompress(self.raw, PIECE)
            except zlib.error as error:
                raise _Bad("broken gzip member") from error
            self.raw = self.engine.unconsumed_tail
            if got:
                self.have += got
                return True
        return False

    def header(self) -> list[str]:
        """Lines up to the first empty one."""
        while (at := self.have.find(_END)) < 0:
            if len(self.have) > _MOST_HEADER or not self.more():
                raise _Bad("no header")
        lines, self.have = self.have[:at].decode("utf-8", "replace").split("\r\n"), self.have[at + 4 :]
        return lines

    def pieces(self, size: int):
        """The next `size` bytes."""
        while size:
            if not self.have and not self.more():
                raise _Bad("shorter than its Content-Length")
            piece, self.have = self.have[:size], self.have[size:]
            size -= len(piece)
            yield piece

    def end(self) -> int:
        """Offset after the member, which must hold nothing more than the end of the record."""
        while len(self.have) <= len(_END) and self.more():
            pass
        if self.have != _END:
            raise _Bad("longer than its Content-Length")
        return self.stream.tell() - len(self.engine.unused_data)


def _fields(lines: list[str]) -> dict[str, str]:
    found, name = {}, None
    for line in lines:
        if line[:1] in " \t" and name:
            found[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _hex(digest: str | None) -> str | None:
    """SHA-1 of a digest header in lower-case hex."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())).hex()
    except ValueError as error:
        raise _Bad("digest of no known form") from error


def _whole_number(text: str | None, what: str) -> int:
    if not re.fullmatch("[0-9]{1,18}", text or ""):
        raise _Bad(f"no {what}")
    return int(text)


def _read(member: _Member, row: dict, payloads: bool) -> int:
    """Fill the row of a record; the offset of the next."""
    first, *lines = member.header()
    if not first.startswith("WARC/"):
        raise _Bad("no header")
    fields = _fields(lines)
    row |= {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri")}
    row |= {"date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"), "payload_digest": _hex(fields.get("warc-payload-digest"))}
    size = _whole_number(fields.get("content-length"), "Content-Length")
    http = fields.get("content-type", "").startswith("application/http")
    block, payload, kept, head = hashlib.sha1(), hashlib.sha1(), [], b""
    at = 0 if not http else None  # bytes of payload so far, from where the HTTP header has ended
    for piece in member.pieces(size):
        block.update(piece)
        if at is None:
            head += piece
            if (cut := head.find(_END)) < 0:
                if len(head) > _MOST_HEADER:
                    raise _Bad("no HTTP header")
                continue
            head, piece, at = head[:cut], head[cut + 4 :], 0
        payload.update(piece)
        at += len(piece)
        if payloads:
            kept.append(piece)
    if at is None:
        raise _Bad("no HTTP header")
    after = member.end()
    claimed = _fields(head.decode("utf-8", "replace").split("\r\n")[1:]).get("content-length") if http else None
    row["payload_bytes"] = at if claimed is None else _whole_number(claimed, "Content-Length of the payload")
    if _hex(fields.get("warc-block-digest")) not in (None, block.hexdigest()):
        row["problem"] = "block digest differs"
    elif row["record_type"] != "revisit":
        if row["payload_digest"] not in (None, payload.hexdigest()):
            row["problem"] = "payload digest differs"
        elif at != row["payload_bytes"]:
            row["problem"] = "payload length differs"
        row["payload_digest"] = payload.hexdigest()
        row["payload"] = b"".join(kept) if payloads else None
    return after


def _next_member(stream, start: int) -> int | None:
    """Offset of the next bytes that may begin a gzip member."""
    stream.seek(start)
    held = b""
    while piece := stream.read(PIECE):
        held += piece
        if (at := held.find(_MAGIC)) >= 0:
            return start + at
        start += max(len(held) - 2, 0)
        held = held[-2:]
    return None


def records(stream, size: int, payloads: bool = True):
    """A dict for every record of an open archive of `size` bytes, front to back."""
    at, lost = 0, False
    while at is not None and at < size:
        row = {"offset": at, "problem": None}
        try:
            after = _read(_Member(stream, at), row, payloads)
            lost = False
        except _Bad as error:
            if lost and "record_type" not in row:
                at = _next_member(stream, at + 1)  # no record began here: these bytes are part of the last one told
                continue
            row["problem"], lost, after = str(error), True, _next_member(stream, at + 1)
        yield row
        at = after


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives named in column `file`, one archive per task at a time."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = RECORDS.replace(",", "").split()[::2]

    def read(batches):
        import pyarrow as pa

        kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

        def told(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, path = _located(name)
                rows, held = [], 0
                with store.open_input_file(path) as stream:
                    for row in records(stream, stream.size(), payloads):
                        rows.append(row | {"file": name})
                        held += len(row.get("payload") or b"")
                        if held > 16 * PIECE or len(rows) == 4096:
                            yield told(rows)
                            rows, held = [], 0
                yield told(rows)

    return files.select("file").repartition(tasks, "file").mapInArrow(read, RECORDS)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The archives that a path or pattern names, for `read_warc`; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))


def digests(read: DataFrame) -> DataFrame:
    """One row per page record, with the page ids of record ids; a record with a problem is an error."""
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:([^:]*):", 1), F.lit("")).cast("bigint")
    sound = F.when(F.col("problem").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat_ws(": ", "file", "offset", "problem")))
    return read.where("record_type IS NULL OR record_type <> 'warcinfo'").select(
        page("record_id").alias("page_id"), "payload_bytes", sound.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    )
