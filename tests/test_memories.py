"""Translation memories and files of lines: odd markup, encodings, splits."""

import random
from collections import Counter

import pytest

from millrace.sources import pairs


def tu(en="one", sw="moja", p="", attrs="", lang="xml:lang"):
    return f'<{p}tu{attrs}><{p}tuv {lang}="en"><{p}seg>{en}</{p}seg></{p}tuv><{p}tuv {lang}="sw"><{p}seg>{sw}</{p}seg></{p}tuv></{p}tu>'


def doc(*units, p="", head='<?xml version="1.0"?><!DOCTYPE tmx SYSTEM "tmx14.dtd">'):
    return f"{head}<{p}tmx xmlns{':' + p[:-1] if p else ''}='u'><{p}header/><{p}body>\n" + "\n".join(units) + f"\n</{p}body></{p}tmx>\n"


def read(spark, path, **how):
    return [(r.en, r.sw) for r in pairs.tmx(spark, str(path), **how).orderBy("seq").collect()]


ODD = {
    "entities": (tu("a &amp; b &#233; &lt;x&gt;"), [("a & b é <x>", "moja")]),
    "inline": (tu("One <bpt i='1'>&lt;b></bpt>two<ept/>  three\n four"), [("One <b>two three four", "moja")]),
    "character data": (tu("<![CDATA[x < y & z]]> tail"), [("x < y & z tail", "moja")]),
    "comment": (tu("a<!-- </seg> -->b"), [("ab", "moja")]),
    "commented out": (f"<!-- {tu('no')} -->" + tu(), [("one", "moja")]),
    "not well-formed": (tu("a & b") + tu(), [("one", "moja")]),
    "crossed": (tu("<b>x</i>") + tu(), [("one", "moja")]),
    "left open": ("<tu><tuv xml:lang='en'><seg>x" + tu(), [("one", "moja")]),
    "unknown entity": (tu("&nbsp;") + tu(), [("one", "moja")]),
    "self closed": ("<tu/><tu tuid='9' />" + tu(), [("one", "moja")]),
    "lang": (tu(lang="lang"), [("one", "moja")]),
    "case and region": ('<tu><tuv xml:lang="EN-us"><seg>x</seg></tuv><tuv xml:lang="SW-ke"><seg>y</seg></tuv></tu>', [("x", "y")]),
    "last variant": ('<tu><tuv xml:lang="en"><seg>x</seg></tuv><tuv xml:lang="en"><seg>z</seg></tuv><tuv xml:lang="sw"><seg>y</seg></tuv><tuv xml:lang="sw"><seg> </seg></tuv></tu>', [("z", "y")]),
    "first segment": ('<tu><tuv xml:lang="en"><prop>p</prop><seg>x</seg><seg>no</seg></tuv><tuv xml:lang="sw"><seg/><seg>no</seg></tuv></tu>' + tu(), [("one", "moja")]),
    "other languages": ('<tu><tuv xml:lang="fr"><seg>f</seg></tuv><tuv xml:lang="en"><seg>x</seg></tuv></tu>', []),
    "nested": ('<tu><note><tuv xml:lang="sw"><seg>no</seg></tuv></note><tuv xml:lang="en"><seg>x</seg></tuv><tuv xml:lang="sw"><seg>y</seg></tuv></tu>', [("x", "y")]),
    "attributes": (tu(attrs=' tuid="1"\n creationdate="2"'), [("one", "moja")]),
    "none": ("", []),
}


@pytest.mark.parametrize("name", sorted(ODD))
def test_odd_units(spark, tmp_path, name):
    xml, want = ODD[name]
    (tmp_path / "x.tmx").write_text(doc(xml))
    assert read(spark, tmp_path / "x.tmx") == want


def test_problems_are_rows(spark, tmp_path):
    (tmp_path / "x.tmx").write_text(doc(tu(), tu("a & b"), tu("<b>"), "<tu>", tu("two"), "<tu><tuv xml:lang='en'><seg>x</seg></tuv></tu>"))
    rows = pairs.tmx_units(spark, str(tmp_path / "x.tmx")).collect()
    assert Counter((r.en is not None, r.sw is not None, r.problem is not None) for r in rows) == {(True, True, False): 2, (True, False, False): 1, (False, False, True): 3}


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE", "ISO-8859-1", "windows-1252"])
@pytest.mark.parametrize("p", ["", "t:"])
def test_encodings_and_prefixes(spark, tmp_path, encoding, p):
    text = doc(tu("café", "kahawa — ñ" if encoding[:3] == "UTF" else "ñ", p), tu(p=p), p=p, head=f'<?xml version="1.0" encoding="{encoding}"?>')
    (tmp_path / "x.tmx").write_bytes(text.encode(encoding))
    assert read(spark, tmp_path / "x.tmx") == [("café", "kahawa — ñ" if encoding[:3] == "UTF" else "ñ"), ("one", "moja")]


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_memory_splits_over_tasks(spark, tmp_path, small_blocks):
    (tmp_path / "x.tmx").write_text(doc(*(tu(f"n{k}", f"m{k}", attrs=f' tuid="{k}"' if k % 2 else "") for k in range(200))))
    df = pairs.tmx(spark, str(tmp_path / "x.tmx"))
    assert [(r.en, r.sw) for r in df.orderBy("seq").collect()] == [(f"n{k}", f"m{k}") for k in range(200)]
    assert df.rdd.getNumPartitions() > 10


def test_first_memory_below_a_folder(spark, tmp_path):
    for name in ("b/x.tmx", "a/z/y.tmx", "a/z/w.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(doc(tu(name)))
    assert pairs.tmx_path(spark, str(tmp_path)).endswith("a/z/y.tmx")
    with pytest.raises(FileNotFoundError):
        pairs.tmx_path(spark, str(tmp_path / "a/z/w.xml"))


CUTS = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]


@pytest.mark.parametrize("seed", range(6))
def test_lines_are_those_of_splitlines(spark, tmp_path, small_blocks, seed):
    r = random.Random(seed)
    text = "".join(r.choice(["", "a", "é word ", "x" * 40]) + r.choice(CUTS) for _ in range(r.choice([0, 1, 300]))) + r.choice(["\n", "last"])
    (tmp_path / "x.txt").write_bytes(text.encode())
    rows = pairs.lines(spark, str(tmp_path / "x.txt")).orderBy("seq").collect()
    assert [(r.seq, r.value) for r in rows] == list(enumerate(text.splitlines()))


def test_two_files_of_many_blocks_side_by_side(spark, tmp_path, small_blocks):
    (tmp_path / "a").write_text("".join(f"a{k}\n" for k in range(900)))
    (tmp_path / "b").write_text("".join(f"{'b' * (k % 50)}{k}\r\n" for k in range(700)))
    df = pairs.zipped(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert [(r.seq, r.en, r.sw) for r in df.orderBy("seq").collect()] == [(k, f"a{k}", f"{'b' * (k % 50)}{k}") for k in range(700)]
    assert pairs.lines(spark, str(tmp_path / "b")).select("seq").distinct().count() == 700
