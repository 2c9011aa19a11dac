"""Operator 12: archives by hand, and pages there and back."""

import base64
import gzip
import hashlib
import io
from collections import defaultdict
from pathlib import Path

import pytest

from pathloom.llm import warc

PAGES = "page_id long, url string, html string, record_type string, refers_to long"
V2 = "1.2.3.4 20010203040506 text/html 404 - - 99 x.arc"


def converted(spark, folder, pages, volume_bytes=warc.VOLUME_BYTES, versions=(1, 2)):
    df = spark.createDataFrame(pages, PAGES)
    for i, v in enumerate(versions):
        part = df.where(f"coalesce(abs(page_id), 0) % {len(versions)} = {i}")
        warc.write_arc(part, f"{folder}/arc", v, volume_bytes=volume_bytes)
    warc.convert(spark, f"{folder}/arc", f"{folder}/warc")
    return warc.materialize(warc.read_warc(spark, f"{folder}/warc"), "test-warc")


def plain(pages):
    groups = defaultdict(list)
    for i, (page_id, _, html, *_) in enumerate(pages):
        groups[html or ""].append((page_id is not None, page_id or 0, i, page_id))
    out = []
    for html, rows in groups.items():
        body, top = html.encode(), max(rows)
        for r in rows:
            again = len(body) >= 1000 and r is not top
            out.append((r[3], len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top[3] if again else None))
    return sorted(out, key=str)


def rows(records):
    out = warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_nulls_ties_repeats_limits_and_long_texts(spark, tmp_path):
    edge, long = "é" * 500, "\r\n\r\nWARC/1.1\r\nfiledesc://x 1 2 3 4\n" * 60_000
    pages = [
        (1, "http://a/ b\n", edge, "x", 1), (2, None, edge, None, None), (2, "http://a", edge, "x", 1), (3, "http://a", edge[:-1] + "a", "x", 1),
        (4, "http://a", edge[:-1] + "a", "x", 1), (5, "u", None, "x", 1), (6, "u", "", "x", 1), (None, "u", edge, "x", 1), (None, None, None, None, None),
        (7, "u", long, "x", 1), (8, "u", long, "x", 1), (-9, "u", long, "x", 1), (10, "ü ö", "x\0y\r\n\r\n", "x", 1), (None, "u", "n" * 1000, "x", 1), (None, "u", "n" * 1000, "x", 1),
    ]
    assert rows(converted(spark, tmp_path, pages)) == plain(pages)


@pytest.mark.parametrize("hot", [1, 1000])
def test_groups_of_copies_over_volumes(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    pages = [(i, f"http://h/{i}", f"page {i % 7} " * 200 if i % 3 else f"own {i}", None, None) for i in range(400)]
    got = converted(spark, tmp_path, pages, volume_bytes=4000)
    assert got.select("file").distinct().count() > 20
    assert rows(got) == plain(pages)


def test_empty_table(spark, tmp_path):
    assert rows(converted(spark, tmp_path, [])) == []


def test_arc_headers_of_both_versions_by_declared_length():
    one = b"filedesc://a.arc 0.0.0.0 19990101000000 text/plain %d\n" % len(b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n")
    one += b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n\n"
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhttp://x 1 2 3 4\n"
    one += b"http://h/a b c 1.2.3.4 19990102030405 text/html %d\n" % len(body) + body + b"\nnot a header\n\nftp://h/f 1.2.3.4 1999 text/plain 3\nabc\n"
    got = list(warc.arc_records(io.BytesIO(one)))
    assert [(r["number"], r["url"], r["date"], r["status"]) for r in got] == [
        (0, "filedesc://a.arc", "1999-01-01T00:00:00Z", None), (1, "http://h/a b c", "1999-01-02T03:04:05Z", 200), (2, "ftp://h/f", warc.NO_DATE, None),
    ]
    assert got[1]["block"] == body and not got[1]["truncated"]
    about = b"2 0 x\n" + warc.FIELDS[2].encode() + b"\n"
    two = b"filedesc://b.arc 0.0.0.0 19990101 text/plain 200 - - 0 b.arc %d\n" % len(about) + about + b"\n"
    two += f"http://h/a b {V2} 4\n".encode() + b"none\n" + f"dns:h {V2} 90\n".encode() + b"cut"
    for content in (two, gzip.compress(two[:120]) + gzip.compress(two[120:]) + b"\0"):
        got = list(warc.arc_records(warc.opened(content)))[1:]
        assert [(r["version"], r["url"], r["status"], r["block"], r["truncated"]) for r in got] == [(2, "http://h/a b", 404, b"none", False), (2, "dns:h", 404, b"cut", True)]


def test_foreign_archives_become_records_of_every_type(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    body = b"HTTP/1.1 200 OK\nContent-Type: x\n\n" + b"z" * 2000
    content = b"http://a 1.2.3.4 20010203040506 text/html %d\n" % len(body) + body + b"\ndns:a 0.0.0.0 20010203040506 text/dns 2\nok\n" + b"http://b 1.2.3.4 20010203040507 text/html %d\n" % len(body) + body
    (tmp_path / "arc" / "old.arc").write_bytes(content)
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = [list(warc.warc_records(warc.opened(f.read_bytes()))) for f in Path(tmp_path / "warc").glob("part-*")]
    (records,) = got
    types = [f["warc-type"] for f, _ in records]
    assert types == ["revisit", "resource", "response"]
    revisit, resource, response = (f for f, _ in records)
    assert revisit["warc-refers-to"] == response["warc-record-id"] and revisit["warc-refers-to-date"] == "2001-02-03T04:05:07Z"
    assert revisit["warc-payload-digest"] == response["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"z" * 2000).digest()).decode()
    assert resource["content-type"] == "text/dns" and resource["content-length"] == "2" and "warc-ip-address" not in resource
    assert records[0][1] == body[:33] and records[2][1] == body
    assert len({f["warc-record-id"] for f, _ in records}) == 3


def test_every_record_is_a_gzip_member(spark, tmp_path):
    records = converted(spark, tmp_path, [(i, "http://a", f"text {i}", None, None) for i in range(5)], versions=(1,)).collect()
    assert len(records) == 5
    for f in Path(tmp_path / "warc").glob("part-*"):
        content = f.read_bytes()
        assert gzip.decompress(content).count(b"WARC/1.1\r\n") == content.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") - content.endswith(warc.member(b""))


def test_a_changed_payload_is_noticed(spark, tmp_path):
    folder = tmp_path / "warc"
    folder.mkdir()
    record = warc.as_warc("f", {"number": 1, "block": b"HTTP/1.1 200 OK\r\n\r\nabc", "url": "u", "date": "d", "ip": "i", "type": "t", "truncated": False}, None)
    (folder / "x").write_bytes(record.replace(b"\r\nabc", b"\r\nabd"))
    with pytest.raises(Exception, match="another digest"):
        warc.read_warc(spark, str(folder)).collect()
