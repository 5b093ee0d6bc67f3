"""Converter of legacy ARC archives to WARC archives.

Archives are gzipped files that Spark's text source reads as one stream each, in pieces
that end at an empty line; a cutter in the task puts the pieces together by the lengths
that headers declare, one record at a time, whatever lines its content has. Header lines
are read by the version block of their file. Identifiers, times, types and digests of
the WARC records are column expressions, and the text sink writes them.

A record whose header cannot be read, or whose declared length goes beyond its file, is
a row with a problem and is not converted; reading goes on at the next header line. Empty
files and folders give nothing. Null payloads are empty ones.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import saved, scratch

# Fixed values of the two formats: what ends a head, the names of a header line's fields by version, base32's letters.
BREAK = "\r\n\r\n"
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads from so many bytes on are written once; later ones refer to them.
LEAST = 1000
#: Bytes of content that a task gathers before it gives them on.
GATHER = 8 << 20
#: Rows of targets up to which they are broadcast; beyond, Spark shuffles both sides.
SMALL_TABLE = 200_000

ARC = "file string, offset long, kind string, version int, uri string, ip string, date string, mime string, code string, head binary, payload binary"
WARC = "file string, offset long, kind string, record_id string, uri string, date string, digest string, refers_to string, mime string, head binary, payload binary"


class Pieces:
    """The bytes of a file that come piece by piece; read ones go. Ends as if the file ended with an empty line."""

    def __init__(self):
        self.bytes, self.at, self.gone, self.need = bytearray(), 0, 0, 0

    def add(self, piece: bytes):
        del self.bytes[: self.at]
        self.gone += self.at
        self.at = 0
        self.bytes += piece
        self.bytes += BREAK.encode()

    @property
    def place(self) -> int:
        return self.gone + self.at

    def enough(self) -> bool:
        return self.gone + len(self.bytes) >= self.need

    def skip_breaks(self):
        while self.at < len(self.bytes) and self.bytes[self.at] in b"\r\n":
            self.at += 1

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before the mark, or None if it is not there yet."""
        end = self.bytes.find(mark, self.at)
        return None if end < 0 else bytes(self.bytes[self.at : end])

    def content(self, after: int, length: int) -> bytes | None:
        """So many bytes that begin `after` bytes on, or None if they are not there yet; that many are then waited for."""
        start = self.at + after
        if len(self.bytes) < start + length:
            self.need = self.gone + start + length
            return None
        self.at = start + length
        return bytes(self.bytes[start : start + length])


def _parted(content: bytes) -> tuple[bytes, bytes]:
    """Head and payload of a response; all is payload where there is no head."""
    if content.startswith(b"HTTP/"):
        cut = re.search(rb"\r?\n\r?\n", content)
        if cut:
            return content[: cut.end()], content[cut.end() :]
    return b"", content


def arc_header(line: bytes, names: list[str]) -> dict[str, str] | None:
    """The fields of a header line, None if it is none. An address may have blanks, the other fields have none."""
    cells = line.rstrip(b"\r").rsplit(b" ", len(names) - 1)
    if len(cells) != len(names) or not cells[-1].isdigit() or b":" not in cells[0]:
        return None
    out = dict(zip(names, (x.decode("utf-8", "replace") for x in cells), strict=True))
    return out if out["Archive-date"].isdigit() else None


def arc_records(p: Pieces, state: dict) -> Iterator[tuple]:
    """Records that are complete by now. state: version and field names once the file's version block is read."""
    while p.enough():
        p.skip_breaks()
        line = p.upto(b"\n")
        if line is None:
            return
        names = state.get("names") or FIELDS[1]
        if line.startswith(b"filedesc:"):  # its own line is of its version, which the block below says
            names = FIELDS[2] if arc_header(line, FIELDS[2]) else FIELDS[1]
        fields, at = arc_header(line, names), p.place
        if fields is None:
            if not state.get("lost"):
                yield at, "problem", None, None, None, None, None, None, None, None
            state["lost"] = True
            p.at += len(line) + 1
            continue
        content = p.content(len(line) + 1, int(fields["Archive-length"]))
        if content is None:
            return
        state["lost"] = False
        kind, head, payload = "record", *_parted(content)
        if line.startswith(b"filedesc:"):
            kind, rows = "filedesc", content.decode("utf-8", "replace").splitlines()
            version = int(rows[0].split()[0]) if rows and rows[0][:1].isdigit() else 1
            named = rows[1].split() if len(rows) > 1 else []
            known = named and named[-1] == "Archive-length" and "Archive-date" in named
            state |= {"version": version, "names": named if known else FIELDS[2 if version == 2 else 1]}
        yield at, kind, state.get("version", 1), fields["URL"], fields.get("IP-address"), fields["Archive-date"], fields.get("Content-type"), fields.get("Result-code"), head, payload


def warc_records(p: Pieces, state: dict) -> Iterator[tuple]:
    while p.enough():
        p.skip_breaks()
        lines = p.upto(BREAK.encode())
        if lines is None:
            return
        at = p.place
        fields = {}
        for x in re.sub(rb"\r\n[ \t]+", b" ", lines).split(b"\r\n")[1:]:
            name, _, value = x.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        if not lines.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
            if not state.get("lost"):
                yield at, "problem", None, None, None, None, None, None, None, None
            state["lost"] = True
            nearest = p.bytes.find(b"WARC/", p.at + 1, p.at + len(lines))
            p.at = nearest if nearest >= 0 else p.at + len(lines) + 4
            continue
        content = p.content(len(lines) + 4, int(fields["content-length"]))
        if content is None:
            return
        state["lost"] = False
        digest = fields.get("warc-payload-digest", "").partition(":")[2]
        try:
            digest = base64.b32decode(digest).hex() or None
        except ValueError:
            digest = None
        bare = lambda x: x.strip("<>") if x else None
        yield at, fields.get("warc-type"), bare(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-date"), digest, bare(fields.get("warc-refers-to")), fields.get("content-type"), *_parted(content)


def _read(spark: SparkSession, path: str, cut: Callable, schema: str) -> DataFrame:
    """Records of all archives below a path. A task reads a file from its beginning to its end, as files that are gzipped are not split."""
    raw = spark.read.option("lineSep", BREAK).option("recursiveFileLookup", True).text(path)
    pieces = raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def sealed():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def ended():
            if p is not None and not p.enough():
                rows.append((file, p.place, "problem", *[None] * (len(names) - 3)))

        file, p, state = None, None, {}
        for b in source:
            for value, name, start in zip(*(b.column(k) for k in range(3)), strict=True):
                if name.as_py() != file:
                    ended()
                    file, p, state = name.as_py(), Pieces(), {}
                    if start.as_py():
                        raise ValueError(f"{file} was split: archives that are not gzipped have to be smaller than spark.sql.files.maxPartitionBytes")
                p.add(value.as_py())
                for x in cut(p, state):
                    rows.append((file, *x))
                    held += len(x[-1] or b"") + 200
                if held > GATHER:
                    yield sealed()
                    rows, held = [], 0
        ended()
        if rows:
            yield sealed()

    return pieces.mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files, their version blocks (kind filedesc) and problems: see ARC. Head is that of a response with its empty line."""
    return _read(spark, path, arc_records, ARC)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: see WARC. digest is that of the payload as bare hex."""
    return _read(spark, path, warc_records, WARC)


def header(head: Column, name: str) -> Column:
    """A field of a response's head, null if it has none."""
    found = F.regexp_extract(head.cast("string"), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def write_arc(pages: DataFrame, path: str, version: int, date: str = "20240101000000") -> None:
    """pages (page_id, url, html) as responses in ARC files of a version, one file for each partition. The id goes into the head as X-Page-Id."""
    url = F.coalesce(F.regexp_replace("url", r"[\s\x00-\x20]", "%20"), F.lit("unknown:"))
    url = F.when(url.contains(":"), url).otherwise(F.concat(F.lit("unknown:"), url))
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    own = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"), own, F.lit("\r\n"))
    more = "" if version == 1 else " 200 - - 0 pages.arc"
    block = f"{version} 0 millrace\n{' '.join(FIELDS[version])}\n".encode()
    first = f"filedesc://pages.arc 0.0.0.0 {date} text/plain{more} {len(block)}\n".encode() + block
    line = F.concat(url, F.lit(f" 0.0.0.0 {date} text/html{more} "), (F.octet_length(head) + F.octet_length(payload)).cast("string"), F.lit("\n"), head)

    def led(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for b in source:
            if b.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary())], names=["value"])
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    rows = pages.select(F.concat(line.cast("binary"), payload).alias("value")).mapInArrow(led, "value binary")
    _write(rows, path, "\n")


def _write(rows: DataFrame, path: str, end: str) -> None:
    """The values one after the other, each with what ends a record."""
    rows.select(F.col("value").cast("string").alias("value")).write.options(**{"lineSep": end, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).text(path)


def base32(digest: Column) -> Column:
    """Base32 of a digest given as hex, whose length is a multiple of five."""
    five = F.transform(F.sequence(F.lit(0), F.floor(F.length(digest) / 5).cast("int") - 1), lambda k: F.conv(F.substring(digest, k * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    four = F.transform(five, lambda v: F.concat(*(F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0))))
    return F.array_join(four, "")


def record_id(file: Column, offset: Column) -> Column:
    """Name of the record that stands at a place, the same in every run."""
    h = F.sha1(F.concat_ws("/", file, offset.cast("string")).cast("binary"))
    cut = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def iso(date: Column) -> Column:
    """An archive's date of up to 14 digits as WARC's; what has no day is the first day of all."""
    whole = F.when(date.rlike(r"^\d{8,14}$"), F.rpad(date, 14, "0")).otherwise("19700101000000")
    return F.regexp_replace(whole, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")


def convert(spark: SparkSession, arc: str, warc: str, rank: Callable[[DataFrame], Column] | None = None, least: int = LEAST) -> None:
    """ARC files below one path as WARC files below another.

    Of records with equal payloads of at least `least` bytes the one of the largest rank is a response, or resource,
    and the others revisit it: they keep their head and lose their payload. rank: a column from the columns of
    read_arc, by default the date; ties go to the last by file and place. The archives are read twice: for the
    digests, which alone are grouped, and to be written.
    """
    records = read_arc(spark, arc).where("kind <> 'problem'")
    keyed = records.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload"), "rank": F.col("date") if rank is None else rank(records)})
    large = keyed.where((F.col("size") >= least) & (F.col("kind") == "record"))
    place = F.struct("rank", "file", "offset", "uri", "date")
    targets = large.groupBy("digest", "size").agg(F.max(place).alias("t"), F.count("*").alias("n")).where("n > 1").drop("n")
    targets = saved(targets, "targets")
    if targets.count() <= SMALL_TABLE:
        targets = F.broadcast(targets)
    _write(keyed.join(targets, ["digest", "size"], "left").select(_warc().alias("value")), warc, BREAK)


def _warc() -> Column:
    """A WARC record from a record of an ARC file, with its digest, size and t, the record that it may refer to."""
    info = F.col("kind") == "filedesc"
    t = F.col("t")
    revisit = t.isNotNull() & ~info & ~((t["file"] == F.col("file")) & (t["offset"] == F.col("offset")))
    has_head = F.octet_length("head") > 0
    kind = F.when(info, "warcinfo").when(revisit, "revisit").when(has_head, "response").otherwise("resource")
    told = F.concat(F.lit("software: millrace\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version "), F.col("version").cast("string"), F.lit("\r\n"))
    block = F.when(info, told.cast("binary")).when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    mime = F.when(info, "application/warc-fields").when(has_head, "application/http; msgtype=response").otherwise(F.coalesce("mime", F.lit("application/octet-stream")))
    lines = [
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("file"), F.col("offset")), F.lit(">"))), line("WARC-Date", iso(F.col("date"))),
        line("WARC-Target-URI", F.when(~info, F.col("uri"))), line("WARC-Filename", F.when(info, F.substring_index("uri", "//", -1))), line("WARC-IP-Address", F.when(F.col("ip") != "0.0.0.0", F.col("ip"))),
        line("WARC-Payload-Digest", F.when(~info, F.concat(F.lit("sha1:"), base32(F.col("digest"))))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), record_id(t["file"], t["offset"]), F.lit(">")))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, t["uri"])), line("WARC-Refers-To-Date", F.when(revisit, iso(t["date"]))),
        line("Content-Type", mime), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    ]
    return F.concat(F.concat(*lines).cast("binary"), block)


def entries(spark: SparkSession, warc: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each response and revisit of WARC files.

    A response's length and digest are those of the payload that was read; a revisit has them from its head and header, and its response by name."""
    found = read_warc(spark, warc).where("kind in ('response', 'revisit', 'resource')")
    here = F.col("kind") != "revisit"
    rows = found.select(
        header(F.col("head"), "X-Page-Id").cast("long").alias("page_id"), F.when(here, F.octet_length("payload")).otherwise(header(F.col("head"), "Content-Length").cast("long")).cast("long").alias("payload_bytes"),
        F.when(here, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"), F.col("kind").alias("record_type"), "record_id", "refers_to",
    )
    rows = saved(rows, "entries")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    target = rows.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("target"))
    revisits = rows.where("record_type = 'revisit'").drop("record_id").join(target, "refers_to", "left").select(*names, F.col("target").alias("refers_to"))
    return rows.where("record_type <> 'revisit'").select(*names, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as ARC files, half of them of version 1 and half of 2, converted to WARC files and read back: see entries."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    half = F.pmod(F.xxhash64("page_id"), F.lit(2))
    for version in (1, 2):
        write_arc(pages.where(half == version - 1), f"{arc}/version{version}", version)
    convert(spark, arc, warc, rank=lambda r: header(r["head"], "X-Page-Id").cast("long"))
    return entries(spark, warc)
