"""ARC files of both versions to WARC files: written by hand, broken, converted, read back."""

import gzip
import hashlib
import tempfile
from collections import Counter

import pytest

from millrace.llm import archives
from millrace.llm.common import scratch

SCHEMA = "page_id long, url string, html string, file string, kind int"


def arc(version, records, end=b"\n"):
    """An ARC file as text in hand: records of (url, mime, content, declared length or None)."""
    more = b"" if version == 1 else b" 200 - - 0 x.arc"
    block = f"{version} 0 hand\n{' '.join(archives.FIELDS[version])}\n".encode()
    out = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain" + more + b" %d\n" % len(block) + block + end
    for url, mime, content, length in records:
        out += url.encode() + b" 10.0.0.1 20010203040506 " + mime.encode() + more + b" %d\n" % (len(content) if length is None else length) + content + end
    return out


def folder(**files):
    path = tempfile.mkdtemp(prefix="arc-")
    for name, data in files.items():
        with gzip.open(f"{path}/{name}.arc.gz", "wb") as f:
            f.write(data)
    return path


HTTP = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"
ODD = [
    ("http://a/", "text/html", HTTP + b"plain", None),
    ("http://b/with blank", "text/html", HTTP + b"http://c/ 1.1.1.1 20010203040506 text/html 5\nfalse\r\n\r\n\r\n\n\n", None),
    ("http://d/", "text/html", b"HTTP/1.0 200 OK\nServer: y\n\n" + bytes(range(256)) * 3, None),
    ("dns:e", "text/dns", b"20010203 e 1.2.3.4", None),
    ("http://f/", "text/html", HTTP, None),
    ("http://g/", "text/html", b"", None),
    ("http://h/", "text/html", HTTP + b"x" * 3_000_000 + b"\r\n\r\n" * 4, None),
]


def bodies(content):
    cut = content.find(b"\r\n\r\n") + 4 if b"\r\n\r\n" in content and content.startswith(b"HTTP/1.0 200 OK\r") else content.find(b"\n\n") + 2 if content.startswith(b"HTTP") else 0
    return content[:cut], content[cut:]


@pytest.mark.parametrize("end", [b"\n", b"\r\n", b"\n\n\n"])
def test_declared_lengths_decide(spark, end):
    path = folder(one=arc(1, ODD, end), two=arc(2, ODD, end), none=b"")
    rows = archives.read_arc(spark, path).collect()
    got = Counter((r.version, r.uri, r.mime, bytes(r.head), bytes(r.payload)) for r in rows if r.kind == "record")
    assert got == Counter((v, u, m, *bodies(c)) for v in (1, 2) for u, m, c, _ in ODD)
    assert Counter(r.kind for r in rows) == {"filedesc": 2, "record": 14}
    assert {r.code for r in rows if r.version == 2} == {"200"} and {r.code for r in rows if r.version == 1} == {None}


def test_broken_records_are_told_and_passed_over(spark):
    good = ("http://a/", "text/html", HTTP + b"good", None)
    short = ("http://s/", "text/html", HTTP + b"declared too short\nrest", len(HTTP) + 3)
    path = folder(short=arc(1, [short, good]), cut=arc(2, [good])[:-20], lost=arc(1, [good]) + b"no header at all\nstill none\n" + arc(1, [good])[len(arc(1, [])) :])
    rows = archives.read_arc(spark, path).collect()
    kinds = {f: Counter(r.kind for r in rows if r.file.startswith(f)) for f in ("short", "cut", "lost")}
    assert kinds == {"short": {"filedesc": 1, "record": 2, "problem": 1}, "cut": {"filedesc": 1, "problem": 1}, "lost": {"filedesc": 1, "record": 2, "problem": 1}}
    warc = scratch(spark, "warc")
    archives.convert(spark, path, warc)
    assert Counter(r.kind for r in archives.read_warc(spark, warc).collect()) == {"warcinfo": 3, "response": 4}


def test_what_converted_records_say(spark):
    big = HTTP + b"z" * 2000
    path = folder(a=arc(1, [("http://a/", "text/html", big, None), ("dns:e", "text/dns", b"1.2.3.4", None)]), b=arc(2, [("http://b/", "text/html", big, None)]))
    warc = scratch(spark, "warc")
    archives.convert(spark, path, warc)
    rows = {r.uri or r.file: r for r in archives.read_warc(spark, warc).collect()}
    assert len(rows) == 5 and len({r.record_id for r in rows.values()}) == 5
    a, b, dns = rows["http://a/"], rows["http://b/"], rows["dns:e"]
    assert (a.kind, b.kind, dns.kind) == ("revisit", "response", "resource") and a.refers_to == b.record_id
    assert bytes(a.payload) == b"" and bytes(a.head) == HTTP and bytes(b.payload) == b"z" * 2000 and bytes(dns.payload) == b"1.2.3.4"
    assert a.digest == b.digest == hashlib.sha1(b"z" * 2000).hexdigest() and dns.mime == "text/dns"
    assert {r.date for r in rows.values()} == {"2001-02-03T04:05:06Z"}
    assert all(r.record_id.startswith("urn:uuid:") and len(r.record_id) == 45 for r in rows.values())
    again = scratch(spark, "warc")
    archives.convert(spark, path, again)
    assert {r.record_id for r in archives.read_warc(spark, again).collect()} == {r.record_id for r in rows.values()}


def trip(spark, rows):
    return sorted((tuple(r) for r in archives.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)


def brute(rows):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == data]
        best = max(same, key=lambda x: (x is not None, x or 0))
        kind = "response" if len(data) < 1000 or page == best else "revisit"
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), kind, best if kind == "revisit" else None))
    return sorted(out, key=str)


def test_round_trip_on_odd_rows(spark, monkeypatch):
    rows = [(k, f"http://x/{k % 3}", ["é" * 499, "é" * 500, "q" * 1500, "q" * 999 + "\r\n\r\n", "", None][k % 6], "f", 1) for k in range(40)]
    rows += [(None, None, "only", "f", 1), (100, "no colon", "HTTP/1.1 in the text\r\n\r\n" * 100, "f", 1), (101, "http://a b\n\tc", "\n\n\r\n" * 600, "f", 1), (102, "http://l", "long " * 600_000, "f", 1), (-7, "http://m", "q" * 1500, "f", 1)]
    assert trip(spark, rows) == brute(rows)
    monkeypatch.setattr(archives, "SMALL_TABLE", 0)  # targets are not broadcast
    assert trip(spark, rows) == brute(rows)


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, "http://x/", "r" * 1200, "f", 1)] * 3
    kinds = Counter((r[0], r[3], r[4]) for r in trip(spark, rows))
    assert kinds == {(1, "response", None): 1, (1, "revisit", 1): 2}
    assert trip(spark, []) == []
