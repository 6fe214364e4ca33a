"""Archives: written and read back, broken in many ways, and the query against SQL."""

import gzip
import hashlib
import io
import zlib

import pytest

from checks import compare
from paneldrift.llm import queries, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def read_back(spark, tmp_path, rows, schema=SCHEMA, **options):
    files = warc.write_warc(spark.createDataFrame(rows, schema), f"file://{tmp_path}/w", **options)
    return files, warc.read_warc(files)


def test_round_trip_with_copies_and_odd_rows(spark, tmp_path):
    long, other = "déjà vu\r\n\r\n" * 200, "x" * 1000
    rows = [(i, f"http://a.b/{i}", long) for i in range(40)] + [(50, "u v\r\nw%20é", other), (51, None, other), (None, "n", other)]
    rows += [(60, "s", "y" * 999), (61, "s", "y" * 999), (62, "e", ""), (63, "e", None), (64, "b", "z" * 3_000_000), (65, "t", other[:-1] + "w"), (39, "again", long)]
    files, read = read_back(spark, tmp_path, [(*r, 1, "a") for r in rows], SCHEMA + ", payload int, record_type string")
    found = read.collect()
    assert all(r["problem"] is None for r in found)
    assert {r["record_type"] for r in found} == {"warcinfo", "response", "revisit"}
    pages = warc.digests(read).collect()
    told = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"]) for r in pages)
    wanted = [(i, "revisit", 39) for i in range(39)] + [(39, "response", None)] * 2 + [(50, "revisit", 51), (51, "response", None), (-1, "revisit", 51)]
    wanted += [(i, "response", None) for i in (60, 61, 62, 63, 64, 65)]
    assert told == sorted(wanted, key=repr) or told == sorted(wanted, key=lambda w: (w[0], w[1]))
    by = {}
    for page, url, html in rows:
        by.setdefault(page, (html or "").encode())
    for r in pages:
        assert (r["payload_bytes"], r["payload_digest"]) == (len(by[r["page_id"]]), hashlib.sha1(by[r["page_id"]]).hexdigest())
    payloads = {r["record_id"]: r["payload"] for r in found if r["record_type"] == "response"}
    assert {p for p in payloads.values()} == {b for i, b in by.items() if i not in set(range(39)) | {50, None}}
    uris = {r["target_uri"] for r in found}
    assert "u%20v%0D%0Aw%20%C3%A9" in uris and None in uris
    assert sum(r["records"] for r in files.collect()) == len(rows)


def test_every_member_is_one_record(spark, tmp_path):
    files, _ = read_back(spark, tmp_path, [(i, "u", "p" * 10 * i) for i in range(30)])
    for (name,) in files.select("file").collect():
        data = open(name.removeprefix("file://"), "rb").read()
        members = 0
        while data:
            engine = zlib.decompressobj(wbits=31)
            record = engine.decompress(data)
            assert engine.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            data, members = engine.unused_data, members + 1
        assert members >= 1


def test_small_files(spark, tmp_path):
    files, read = read_back(spark, tmp_path, [(i, "u", f"{i}" * 300) for i in range(50)], file_bytes=400)
    assert files.count() > 20
    assert sorted(r["page_id"] for r in warc.digests(read).collect()) == list(range(50))
    listed = warc.archives(spark, f"file://{tmp_path}/w/*.warc.gz")
    assert warc.read_warc(listed, payloads=False).where("record_type = 'response' AND payload IS NULL").count() == 50


def test_files_of_other_attempts_are_not_read(spark, tmp_path):
    files, _ = read_back(spark, tmp_path, [(1, "u", "p")])
    (name,) = files.select("file").first()
    data = open(name.removeprefix("file://"), "rb").read()
    (tmp_path / "w" / "pages-00000-lost.warc.gz").write_bytes(data)
    assert warc.digests(warc.read_warc(files)).count() == 1


def test_empty_table(spark, tmp_path):
    _, read = read_back(spark, tmp_path, [])
    assert read.where("record_type <> 'warcinfo'").collect() == []


def record(block=b"abc", length=None, digest=None, kind="resource", extra=(), content="text/plain"):
    fields = [("WARC-Type", kind), ("WARC-Record-ID", "<urn:x:1>"), ("Content-Type", content), *extra]
    if digest:
        fields.append(("WARC-Block-Digest", digest))
    head = "".join(f"{a}: {b}\r\n" for a, b in [*fields, ("Content-Length", len(block) if length is None else length)])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def problems(data, payloads=True):
    return [(r["problem"], r.get("payload")) for r in warc.records(io.BytesIO(data), len(data), payloads)]


GOOD = gzip.compress(record(b"good"))


@pytest.mark.parametrize(
    "bad,reason",
    [
        (gzip.compress(record(length=2)), "longer than its Content-Length"),
        (gzip.compress(record(length=40)), "shorter than its Content-Length"),
        (gzip.compress(record(length="-1")), "no Content-Length"),
        (gzip.compress(record(length="x")), "no Content-Length"),
        (gzip.compress(b"no record\r\n\r\n"), "no header"),
        (gzip.compress(b"WARC/1.0 but no end"), "no header"),
        (gzip.compress(b""), "no header"),
        (gzip.compress(record(digest="sha1:" + "0" * 40)), "block digest differs"),
        (gzip.compress(record(extra=[("WARC-Payload-Digest", "sha1:" + "A" * 32)])), "payload digest differs"),
        (gzip.compress(record(extra=[("WARC-Payload-Digest", "sha1:!")])), "digest of no known form"),
        (gzip.compress(record(b"HTTP/1.1 200 OK\r\n", content="application/http; msgtype=response")), "no HTTP header"),
        (gzip.compress(record(b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc", content="application/http")), "payload length differs"),
        (GOOD[:-6], "broken gzip member"),
        (GOOD[:-8] + bytes([GOOD[-8] ^ 1]) + GOOD[-7:], "broken gzip member"),
        (b"junk between members", "broken gzip member"),
        (b"\0" * 100, "broken gzip member"),
    ],
)
def test_problems_are_told_and_reading_goes_on(bad, reason):
    found = problems(GOOD + bad + GOOD)
    assert [p for p, _ in found if p] == [reason]
    assert [b for p, b in found if not p] == [b"good"] * 2


def test_truncated_end_and_many_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    block = bytes(range(256)) * 40
    told = "sha1:" + hashlib.sha1(block).hexdigest()
    data = gzip.compress(record(block, digest=told)) + gzip.compress(record(block, digest=told))
    assert problems(data) == [(None, block)] * 2
    assert problems(data[:-20]) == [(None, block), ("truncated", None)]
    assert problems(data, payloads=False) == [(None, None)] * 2


def test_a_payload_with_gzip_inside_is_no_member():
    inside = gzip.compress(record(b"not a record of its own"), compresslevel=0)
    stored_member = gzip.compress(record(inside), compresslevel=0)
    assert problems(stored_member + GOOD) == [(None, inside), (None, b"good")]


def test_a_broken_record_is_an_error_in_digests(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(GOOD + gzip.compress(record(length=2)))
    listed = warc.archives(spark, f"file://{tmp_path}/*.warc.gz")
    with pytest.raises(Exception, match="longer than its Content-Length"):
        warc.digests(warc.read_warc(listed)).collect()


def test_query_against_sql(spark):
    con = compare.open_tables(SF)
    result, _ = compare.compare(spark, con, SF, queries.op12_warc, queries.oracle()["op12_warc"])
    assert result.startswith("ok"), result
