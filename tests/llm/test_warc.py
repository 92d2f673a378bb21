import base64
import gzip
import hashlib
import zlib

import pytest

from loomline.llm import warc as w

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    blocks = [b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\nbody\n\n", b"", b"plain \xff bytes"]
    data = w.arc_open(version, "a.arc", "20010203040506")
    for b in blocks:
        data += w.arc_record(version, "http://a/b c", "20010203040506", b, len(data), "a.arc")
    got = list(w.parse_arc(data))
    assert [g.block for g in got] == blocks and {g.version for g in got} == {version} and got[0].url == "http://a/b%20c"
    assert got[0].parts[1] == b"body\n\n" and got[2].parts == (b"", b"plain \xff bytes")
    assert list(w.parse_arc(data[:-5]))[-1].cut_off
    record = dict([next(w.parse_warc(w.warc_record(got[0], None) + w.END))][0][0])
    assert record["warc-date"] == "2001-02-03T04:05:06Z" and record["warc-payload-digest"] == f"sha1:{digest('body' + chr(10) * 2)}"


def test_blanks_in_a_url_of_old_files():
    data = w.arc_open(1, "a.arc", "1999") + b"http://x/a b 0.0.0.0 19990101 text/html 2\nhi\n"
    assert [(r.url, r.block) for r in w.parse_arc(data)] == [("http://x/a b", b"hi")]
    assert w.iso_date("19990101") == "1999-01-01T00:00:00Z"


def test_pages_come_back(spark, monkeypatch):
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 3000)
    html = {1: "<p>same</p>", 2: "<p>same</p>", 3: None, 4: "", 5: "é\r\n\r\nWARC/1.0\r\n\r\n", 6: "x" * 9000, 7: "<p>same</p>"}
    rows = [(k, None if k == 3 else f"http://h/{k} \n", t) for k, t in html.items()]
    got = {r["page_id"]: r for r in w.archive_and_read(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", digest int").repartition(2)).collect()}
    top = {}
    for k, t in html.items():
        top[t or ""] = max(k, top.get(t or "", k))
    for k, t in html.items():
        last = top[t or ""]
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len((t or "").encode()), digest(t or ""))
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if k == last else ("revisit", last))


def test_ties_nulls_small_payloads_and_empty_table(spark):
    rows = [(3, "u", "t"), (3, "u", "t"), (None, "u", "t"), (1, "u", "tiny"), (2, "u", "tiny")]
    got = sorted(map(tuple, w.archive_and_read(spark.createDataFrame(rows, SCHEMA), least_bytes=1).collect()), key=str)
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "revisit", 2), (2, "response", None), (3, "response", None), (3, "response", None), (None, "revisit", 3)]
    assert {r[3] for r in w.archive_and_read(spark.createDataFrame(rows, SCHEMA), least_bytes=9).collect()} == {"response"}
    assert w.archive_and_read(spark.createDataFrame([], SCHEMA)).collect() == []


def test_arc_files_are_converted(spark, tmp_path):
    data = w.arc_open(2, "a.arc", "2001") + w.arc_record(2, "http://a/", "20010203040506", b"HTTP/1.0 200 OK\r\n\r\nhello", 0, "a.arc")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.arc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "in/b.arc").write_bytes(data)
    w.convert_arc(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = w.read_warc(spark, str(tmp_path / "out"), with_payload=True).collect()
    assert [bytes(r["payload"]) for r in got] == [b"hello", b"hello"] and got[0]["target_uri"] == "http://a/"


def test_malformed_headers_are_flagged(spark, tmp_path):
    good = w.arc_record(1, "http://a/", "20010203040506", b"body", 0, "a.arc")
    start = w.arc_open(1, "a.arc", "1999")
    cases = {
        "short": start + good + b"http://b/ 0.0.0.0\nrest of it\n",
        "no number": start + good + b"http://b/ 0.0.0.0 19990101 text/html x1\nrest\n",
        "negative": start + good + b"http://b/ 0.0.0.0 19990101 text/html -5\nrest\n",
        "unfinished": start + good + b"http://b/ 0.0.0.0 19990101 text/html 5",
    }
    for data in cases.values():
        first, last = w.parse_arc(data)
        assert first.block == b"body" and first.problem is None and last.problem and last.url == "http://b/"
    for data in (b"", b"nothing", b"filedesc://a 0 0 text/plain x\n", b"filedesc://a 0.0.0.0 1999 text/plain 4\nabc\n", b"filedesc://a 5"):
        (only,) = w.parse_arc(data)
        assert only.problem
    assert w.iso_date("x") == w.iso_date("") == "0001-01-01T00:00:00Z"
    (tmp_path / "in").mkdir()
    for k, data in enumerate(cases.values()):
        (tmp_path / "in" / f"{k}.arc").write_bytes(data)
    w.convert_arc(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = w.read_warc(spark, str(tmp_path / "out")).collect()
    assert sorted(r["target_uri"] for r in got) == ["http://a/"] * 4 + ["http://b/"] * 4


def five(tmp_path, compress):
    """An ARC file of five records, packed by ``compress`` from its parts."""
    parts = [w.arc_open(1, "a.arc", "2001")] + [w.arc_record(1, f"http://a/{k}", "20010203040506", f"HTTP/1.0 200 OK\r\n\r\nbody {k}".encode(), 0, "a.arc") for k in range(5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.arc.gz").write_bytes(compress(parts))


def converted(spark, tmp_path):
    w.convert_arc(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    return w.read_warc(spark, str(tmp_path / "out"), with_payload=True).collect()


@pytest.mark.parametrize("padding", [b"", b"\0" * 700])
def test_one_gzip_member_a_record(spark, tmp_path, padding):
    five(tmp_path, lambda parts: b"".join(map(gzip.compress, parts)) + padding)
    got = converted(spark, tmp_path)
    assert sorted(bytes(r["payload"]) for r in got) == [f"body {k}".encode() for k in range(5)] and {r["problem"] for r in got} == {None}


@pytest.mark.parametrize("cut, told", [(-9, "the gzip file is cut off"), (-40, "the gzip file is cut off")])
def test_truncated_member_keeps_what_is_before(spark, tmp_path, cut, told):
    five(tmp_path, lambda parts: b"".join(map(gzip.compress, parts))[:cut])
    got = {r["target_uri"]: r for r in converted(spark, tmp_path)}
    assert [bytes(got[f"http://a/{k}"]["payload"]) for k in range(4)] == [f"body {k}".encode() for k in range(4)]
    assert any(told in (r["problem"] or "") for r in got.values())


def test_damaged_and_foreign_bytes_behind_members(spark, tmp_path):
    five(tmp_path, lambda parts: b"".join(map(gzip.compress, parts)) + b"garbage")
    assert [r["problem"] for r in converted(spark, tmp_path) if r["problem"]] == ["bytes behind the last gzip member"]
    broken = bytearray(gzip.compress(b"x" * 100 + bytes(range(256)) * 20))
    broken[60:90] = b"\xff" * 30
    assert w.unpack(bytes(broken))[1] in ("the gzip file is damaged", "the gzip file is cut off")
    assert w.unpack(b"") == (b"", None) and w.unpack(b"plain") == (b"plain", None)
    assert w.unpack(gzip.compress(b"a" * (3 << 20)) + gzip.compress(b"") + gzip.compress(b"b")) == (b"a" * (3 << 20) + b"b", None)


def test_written_archives_have_a_member_a_record(spark, tmp_path):
    big = "".join(hashlib.sha1(str(k).encode()).hexdigest() for k in range(450_000))  # 18 MB: its member doesn't end in a zero
    rows = [(k, f"http://a/{k}", "é" * k) for k in range(6)] + [(7, "u", big)]
    w.pages_to_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "out"))
    (path,) = (tmp_path / "out").glob("part*")
    rest, members = path.read_bytes(), []
    while rest:
        one = zlib.decompressobj(31)
        members.append(one.decompress(rest))
        assert one.eof
        rest = one.unused_data
    records = [m for m in members if m]
    assert len(records) == 7 and all(m.startswith(b"WARC/1.0\r\n") and m.endswith(w.END) and len(list(w.parse_warc(m))) == 1 for m in records)
    assert w.read_warc(spark, str(tmp_path / "out")).filter("page_id = 7").collect()[0]["payload_bytes"] == len(big)


def foreign(spark, tmp_path, data):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(data)
    return w.read_warc(spark, str(tmp_path / "w"), with_payload=True).collect()


def record(block, *lines):
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode("latin-1") + w.END + block + w.END


def test_foreign_headers_never_end_a_job(spark, tmp_path):
    http = b"HTTP/1.1 200 \xff\xfe\r\nX-Page-Id: not-a-number\r\nX-Other\r\n\r\nhi"
    data = record(b"software: x\r\n", "WARC-Type: warcinfo", "WARC-Filename: \xe9", "broken line", "Folded: a", " b")
    data += record(http, "WARC-Type: response", "WARC-Target-URI: http://x/")
    data += record(http.replace(b"not-a-number", b"9" * 30), "WARC-Type: response") + record(http.replace(b"not-a-number", b"-12"), "WARC-Type: response")
    data += record(b"", "WARC-Type: revisit") + b"??? no record\r\n" + record(b"last", "WARC-Type: resource")
    got = foreign(spark, tmp_path, data)
    assert [r["record_type"] for r in got] == ["warcinfo", "response", "response", "response", "revisit", None, "resource"]
    assert [r["page_id"] for r in got] == [None, None, None, -12, None, None, None]
    assert [r["problem"] for r in got] == [None, "X-Page-Id is no number", "X-Page-Id is no number", None, None, "no record begins here", None]
    assert bytes(got[1]["payload"]) == b"hi" and bytes(got[6]["payload"]) == b"last" and got[4]["payload_digest"] is None


@pytest.mark.parametrize("tail, told", [(b"WARC/1.0\r\nWARC-Type: res", "the file ends in a header"), (record(b"whole", "WARC-Type: resource")[:-7], "the file ends in a record"), (b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: many\r\n\r\nrest", "no length in the header")])
def test_a_record_that_is_cut_off(spark, tmp_path, tail, told):
    got = foreign(spark, tmp_path, record(b"first", "WARC-Type: resource") + tail)
    assert bytes(got[0]["payload"]) == b"first" and [r["problem"] for r in got] == [None, told]


def test_foreign_arc_lines(spark, tmp_path):
    for data in (w.arc_open(1, "a", "1").replace(b"\n", b"\r\n", 1), b"filedesc://a 0.0.0.0 1999 text/plain " + b"9" * 5000 + b"\nx"):
        assert len(list(w.parse_arc(data))) <= 1
    data = w.arc_open(1, "a.arc", "1999") + b"http://x/\xff 0.0.0.0 19990101 text/html 2\r\nhi\n\r\nhttp://y/ 0.0.0.0 19990101 text/html 2\nho\n"
    assert [(r.block, r.problem) for r in w.parse_arc(data)] == [(b"hi", None), (b"ho", None)]
    arc = next(w.parse_arc(data))
    arc.block = b"HTTP/1.0 200 OK\r\nX-Page-Id: x\xff\r\n\r\nbody"
    assert next(w.parse_warc(w.warc_record(arc, None) + w.END))[0]["warc-type"] == "response"
