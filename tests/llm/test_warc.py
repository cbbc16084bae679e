import gzip
import hashlib
import io

import pytest

from codefacts.llm import warc
from codefacts.llm.common import shared_path

BIG = "<p>" + "é" * 600 + "</p>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


ROWS = [(1, "http://a.example/x y", BIG), (2, None, BIG), (3, "http://b.example/\t", "small"), (4, "http://c.example/é", "small"), (5, "", None), (6, "http://d.example/", ""), (2, None, BIG), (None, "http://e.example/", BIG), (8, "http://f.example/", "x\r\n\r\ny" * 50_000)]


def test_archived(spark):
    got = sorted(map(tuple, warc.archived(pages(spark, ROWS).repartition(3)).collect()), key=repr)
    want = []
    seen = False
    for i, _, html in ROWS:
        data = (html or "").encode()
        revisit = html == BIG and (i != 2 or seen)
        seen |= i == 2
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.archived(pages(spark, [])).count() == 0


def test_files_and_payloads(spark):
    path = shared_path(spark, "test")
    arcs = warc.write_arcs(pages(spark, ROWS).repartition(2), path)
    versions = set()
    for p in (r.path.removeprefix("file:") for r in arcs.collect()):
        with open(p, "rb") as f:
            versions.add(next(warc.members(f))[1].split(b"\n")[1][:1])
        with gzip.open(p) as f:
            flat = f.read()
        # the same records without compression
        assert [(h["URL"], b) for _, h, b in warc.arc_records(io.BytesIO(flat), compressed=False)] == [(h["URL"], b) for _, h, b in warc.arc_records(open(p, "rb"))]
    assert versions == {b"1", b"2"}
    read = warc.read_warcs(spark, warc.convert(spark, arcs, path)).collect()
    assert len({r.record_id for r in read}) == len(ROWS) and all(r.captured == "2024-01-01T00:00:00Z" for r in read)
    ids = {r.record_id: r for r in read}
    for r in read:
        if r.record_type == "revisit":
            assert ids[r.refers_to_id].payload.decode() == BIG and r.payload is None
    assert sorted(r.payload.decode() for r in read if r.page_id in (3, 5, 8)) == sorted(["small", "", "x\r\n\r\ny" * 50_000])


def test_heads():
    one = warc.arc_head(b"http://a b/ 1.2.3.4 20240101000000 text/html 12\n", 1)
    assert one["URL"] == "http://a b/" and one["Archive-length"] == "12"
    two = warc.arc_head(b"http://a/ 1.2.3.4 20240101000000 text/html 200 - - 7 f.arc 12\n", 2)
    assert (two["Result-code"], two["Offset"], two["Filename"]) == ("200", "7", "f.arc")
    for bad in (b"http://a/ 12\n", b"http://a/ 1.2.3.4 20240101000000 text/html x\n"):
        with pytest.raises(ValueError):
            warc.arc_head(bad, 1)
    assert warc.iso_date("20240203") == "2024-02-03T00:00:00Z" and warc.iso_date("20240203040506") == "2024-02-03T04:05:06Z"


def test_damage():
    block = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    head = f"filedesc://x 0.0.0.0 20240101000000 text/plain {len(block)}\n".encode()
    with pytest.raises(ValueError, match="truncated"):
        list(warc.arc_records(io.BytesIO(head + block + b"\nhttp://a/ 0.0.0.0 20240101000000 text/html 99\nshort"), compressed=False))
    with pytest.raises(ValueError, match="unknown"):
        list(warc.arc_records(io.BytesIO(head.replace(b"1", b"1") + block.replace(b"1 0", b"7 0")), compressed=False))
    with pytest.raises(ValueError, match="truncated"):
        list(warc.members(io.BytesIO(warc._member(b"x" * 1000)[:-4])))
