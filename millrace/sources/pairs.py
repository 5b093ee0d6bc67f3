"""Parallel text: translation memories, line-aligned files, sentence exports and pair tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions import text as t
from millrace.operators.records import record

#: Encodings told by a file's first bytes.
MARKS = {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE", b"<\x00": "UTF-16LE", b"\x00<": "UTF-16BE"}
UNITS = "file string, at long, id long, en string, sw string, problem string"


def sniffed(spark: SparkSession, path: str) -> tuple[str, str]:
    """Encoding and prefix of the elements of translation memories, from the first tags of the first file."""
    head = b">".join(bytes(r[0]) for r in spark.read.text(path, lineSep=">").select(F.col("value").cast("binary")).limit(64).collect())
    encoding = MARKS.get(head[:2])
    text = head.decode(encoding or "latin-1", "replace")
    declared = re.search(r"<\?xml[^>]*encoding\s*=\s*[\"']([\w.-]+)[\"']", text)
    prefix = re.search(r"<(\w[\w.-]*:)(?:tmx|body|tu)[\s>/]", text)
    return encoding or (declared[1].upper() if declared else "UTF-8"), prefix[1] if prefix else ""


class _Unit:
    """English and Swahili of one unit, from the events of a parser."""

    def __init__(self, xml: str):
        self.sides, self.path, self.lang, self.held = {}, [], "", None
        p = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.data
        p.Parse(xml.encode(), True)

    def start(self, name, attrs):
        local = name.rpartition(":")[2]
        self.path.append(local)
        if self.path[1:] == ["tuv"]:
            own = attrs.get("xml:lang") or next((v for k, v in attrs.items() if k.rpartition(":")[2] == "lang"), "")
            self.lang, self.held = own.lower(), None
        elif self.path[1:] == ["tuv", "seg"] and self.held is None:
            self.held = []  # later segments of the variant find a list here and are passed over
            self.first = True

    def end(self, name):
        if self.path[1:] == ["tuv", "seg"] and self.held is not None and self.first:
            self.first, text = False, " ".join("".join(self.held).split())
            side = next((s for s in ("en", "sw") if self.lang.startswith(s)), None)
            if text and side:
                self.sides[side] = text
        self.path.pop()

    def data(self, text):
        if self.path[1:3] == ["tuv", "seg"] and self.first:
            self.held.append(text)


def _units(prefix: str):
    begins = re.compile(rf"<{re.escape(prefix)}tu(?=[\s>])[^>]*>")

    def of(chunk: str) -> Iterator[tuple[str | None, str | None, str | None]]:
        """A chunk ends where a unit ends. What cannot be parsed from its first start is tried from the next, as an end may be missing before."""
        starts = [m for m in begins.finditer(chunk) if not m[0].endswith("/>") and chunk.rfind("<!--", 0, m.start()) <= chunk.rfind("-->", 0, m.start())]
        for m in starts:
            try:
                unit = _Unit(f"{chunk[m.start() :]}</{prefix}tu>")
            except (expat.ExpatError, UnicodeError) as e:
                yield None, None, str(e) or "not understood"
                continue
            yield unit.sides.get("en"), unit.sides.get("sw"), None
            return

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows = [(file, at, k, *x) for file, at, k, value in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for x in of(value)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=[x.split()[0] for x in UNITS.split(", ")])

    return run


def tmx_units(spark: SparkSession, path: str, encoding: str | None = None, prefix: str | None = None) -> DataFrame:
    """Every unit of translation memories: see UNITS. en and sw are null where the unit lacks a side, problem says why it could not be parsed.

    Files are read in chunks that end at a unit's end tag, so a file splits over tasks, and each chunk has a parser of its own,
    so a unit that is not well-formed costs itself only. Of several variants of a language the last with text counts, of several
    segments the first; languages are told by the beginning of xml:lang, or lang, in any case. Encoding (by byte order
    mark or declaration) and namespace prefix are those of the first file's first tags unless given: the files of a path agree in them.
    """
    if encoding is None or prefix is None:
        told = sniffed(spark, path)
        encoding, prefix = encoding or told[0], told[1] if prefix is None else prefix
    raw = spark.read.options(lineSep=f"</{prefix}tu>", encoding=encoding).text(path)
    value = F.col("value").cast("binary")
    text = F.decode(value, encoding) if encoding in ("UTF-8", "UTF-16LE", "UTF-16BE", "ISO-8859-1", "US-ASCII") else _decoded(encoding)(value)
    # the last chunk is what stands behind the last unit; it has no end of its own
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), text.alias("value")).where(F.col("value").contains(f"<{prefix}tu")).mapInArrow(_units(prefix), UNITS)


def _decoded(encoding: str):
    """Decoding that Spark has no name for."""

    @F.pandas_udf("string")
    def decode(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else bytes(x).decode(encoding, "replace"))

    return decode


def tmx(spark: SparkSession, path: str, **how) -> DataFrame:
    """seq, en and sw of each unit of translation memories that has both sides, see tmx_units."""
    both = tmx_units(spark, path, **how).where("en is not null and sw is not null")
    return both.select(F.struct("file", "at", "id").alias("seq"), "en", "sw")


def tmx_path(spark: SparkSession, folder: str) -> str:
    """The first *.tmx below a folder, by path; FileNotFoundError if there is none."""
    found = spark.read.format("binaryFile").options(pathGlobFilter="*.tmx", recursiveFileLookup=True).load(folder).select("path")
    first = found.agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(f"no *.tmx below {folder}")
    return first


def lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """seq (from 0) and the lines of text files, taken one after the other by name; cut where Python's splitlines cuts.

    A file is read in blocks by many tasks. A line's number is its place in its block plus the lines of the blocks before it, of
    which there is one count each. Lines are not sorted or sent anywhere for that. A file's end counts as the end of a line, so one
    that ends in another separator than a newline has an empty line more.
    """
    raw = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = None, 0
        for b in source:
            rows = []
            for value, *key in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if key != block:
                    block, n = key, 0
                for line in (value + "\n").splitlines():
                    rows.append((*key, n, line))
                    n += 1
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["file", "at", "k", "line"])

    placed = raw.mapInArrow(cut, "file string, at long, k long, line string")
    blocks = placed.groupBy("file", "at").agg(F.count("*").alias("n"))
    before = blocks.select("file", "at", F.coalesce(F.sum("n").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, ["file", "at"]).select((F.col("before") + F.col("k")).alias("seq"), F.col("line").alias(name))


def zipped(spark: SparkSession, left: str, right: str) -> DataFrame:
    """seq, en, sw: the lines of two files, or folders of files, side by side, as far as the shorter one goes."""
    return lines(spark, left, "en").join(lines(spark, right, "sw"), "seq")


def bench(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """seq, en, sw of the dev or test split of a benchmark: files of lines that belong together, TICO19.{split}.en and .sw."""
    return zipped(spark, *(f"{folder.rstrip('/')}/TICO19.{split}.{lang}" for lang in ("en", "sw")))


def exports(sentences: DataFrame, links: DataFrame) -> DataFrame:
    """English and Swahili texts of linked sentences (id, lang, text, ordinal) and (a, b, ordinal).

    Of several sentences with an id the last counts. A link may stand in either direction; a pair that is
    listed both ways comes twice.
    """
    last = sentences.where(F.col("lang").isin("eng", "swa")).groupBy("id").agg(F.max_by(F.struct("lang", "text"), "ordinal").alias("s")).select("id", "s.*")
    a, b = (last.select(F.col("id").alias(k), F.col("lang").alias(f"lang_{k}"), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = links.join(a, "a").join(b, "b").where("lang_a <> lang_b")
    first = F.col("lang_a") == "eng"
    return both.select(F.col("ordinal").alias("seq"), F.when(first, F.col("text_a")).otherwise(F.col("text_b")).alias("en"), F.when(first, F.col("text_b")).otherwise(F.col("text_a")).alias("sw"))


def read_exports(spark: SparkSession, sentences: str, links: str) -> DataFrame:
    tsv = lambda path, names: spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"{n} string" for n in names)).withColumn("ordinal", F.monotonically_increasing_id())
    s = tsv(sentences, ["id", "lang", "text"]).where("text is not null")
    return exports(s, tsv(links, ["a", "b"]))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated English and Swahili of all files under the path, in the order of their names."""
    raw = spark.read.option("pathGlobFilter", "*.tsv").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"))
    cut = raw.withColumn("f", F.split("value", "\t", -1)).where("size(f) >= 2")
    out = cut.select(F.struct("file", "id").alias("seq"), t.strip(F.col("f")[0]).alias("en"), t.strip(F.col("f")[1]).alias("sw"))
    return out.where("en <> '' and sw <> ''")


def import_memory(pairs: DataFrame, split: str = "tmx_all", max_pairs: int | None = None, date: str | None = None, about: dict = rules.TICO) -> DataFrame:
    """Health records of a translation memory; the limit counts pairs before blank ones go."""
    if max_pairs is not None:
        pairs = pairs.orderBy("seq").limit(max_pairs)
    pairs = pairs.withColumn("en", t.normalize(F.col("en"))).withColumn("sw", t.normalize(F.col("sw"))).where("en <> '' and sw <> ''")
    meta = t.json_object(type="corpus", corpus=about["corpus"], license=about["license"], split=split)
    return pairs.select("seq", *record(F.lit("Health"), F.col("en"), F.col("sw"), F.lit(about["source"]), date, F.lit(about["url"]), meta))


def import_sentences(pairs: DataFrame, date: str | None = None, about: dict = rules.TATOEBA) -> DataFrame:
    """Records of sentence pairs within the word bounds that a domain's keywords find."""
    pairs = t.once(pairs, en=t.normalize(F.col("en")), sw=t.normalize(F.col("sw")))
    found = t.with_domain(pairs.where(t.word_bounds(F.col("en"))), "en").where("domain is not null")
    meta = t.json_object(type="corpus", corpus=about["corpus"], license=about["license"])
    return found.select("seq", *record(F.col("domain"), F.col("en"), F.col("sw"), F.lit(about["source"]), date, F.lit(about["url"]), meta))
