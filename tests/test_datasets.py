"""Versions of datasets, profiles of parts, whole runs from the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import langid, rules, session
from millrace.operators import records
from millrace.plans import build, profile
from millrace.sources import datasets


def rows(spark, english, source="WHO", start=1, domain="Health", swahili=""):
    cols = records.record(F.lit(domain), F.col("e"), F.lit(swahili), source=F.lit(source), date="2024-01-01")
    df = spark.createDataFrame([(k, e) for k, e in enumerate(english)], "n long, e string")
    return df.select(*cols, F.col("n").alias("_n")).withColumn("PSA_ID", F.format_string("PSA%06d", F.col("_n") + start))


def texts(spark, path, **how):
    return [r.English for r in datasets.read(spark, path, **how).orderBy("PSA_ID").collect()]


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "d")
    first = datasets.write(rows(spark, ["a", "b"]).drop("_n"), path)
    assert texts(spark, path) == ["a", "b"]
    broken = rows(spark, ["c", "d"]).drop("_n").withColumn("English", F.when(F.col("English") == "d", F.raise_error(F.lit("broken row"))).otherwise(F.col("English")))
    with pytest.raises(Exception, match="broken row"):
        datasets.write(broken, path)
    assert datasets.versions(spark, path) == [first] and texts(spark, path) == ["a", "b"]
    draft = datasets.Draft(spark, path)
    draft.rows(rows(spark, ["e"]).drop("_n"))
    draft.text("stats.json", "{}")
    assert texts(spark, path) == ["a", "b"]  # all is written, nothing is published
    draft.publish()
    assert texts(spark, path) == ["e"] and texts(spark, path, version=first) == ["a", "b"]
    assert [v.split("-")[0] for v in datasets.versions(spark, path)] == ["000001", "000002"]


def test_single_file_and_odd_cells(spark, tmp_path):
    path = str(tmp_path / "d")
    odd = ['quote " and, comma', "two\nlines", "", " spaces ", "null", "é\\n"]
    name = datasets.write(rows(spark, odd).drop("_n"), path, single=True)
    assert len([f for f in os.listdir(f"{path}/{name}/data") if f.endswith(".csv")]) == 1
    assert texts(spark, path) == odd
    assert texts(spark, f"{path}/{name}/data") == odd  # plain CSV is read as well


def state(df):
    return {(r.kind, r.key): (r.n, r["first"]) for r in df.collect()}


def test_profiles_of_parts_add_up(spark):
    one = rows(spark, ["a b", "c", "d e f"], "X", swahili="moja mbili")
    two = rows(spark, ["g h", ""], "Y", start=4, domain="Education")
    three = rows(spark, ["i"] * 4, "", start=6)
    place = profile.place(F.col("PSA_ID"))
    whole = state(profile.state(one.unionByName(two).unionByName(three), place))
    assert state(profile.merged(*(profile.state(x, place) for x in (three, one, two)))) == whole
    assert whole[("source", "X")] == (3, 1) and whole[("domain", "Education")] == (2, 4) and whole[("en", "1")] == (5, 2) and whole[("sw", "2")] == (3, 1)
    f = profile.figures(profile.state(one.unionByName(two).unionByName(three), place)).first()
    assert tuple(f) == (9, 3, 2, pytest.approx(12 / 9), 1.0, 2.0, 2.0)
    assert tuple(profile.figures(profile.state(one.limit(0), place)).first()) == (0, 0, 0, None, None, None, None)


def test_append_gives_what_a_whole_write_gives(spark, tmp_path):
    path, stats = str(tmp_path / "d"), {"x": 1}
    old, new = rows(spark, ["one two three four", "five"]).drop("_n"), rows(spark, ["six seven", "eight"], "FAO", domain="Agriculture")
    build.store(old, stats, path, {"today": "2024-01-01"})
    build.append(new, path, {"today": "2024-01-01"})
    assert [(r.PSA_ID, r.English) for r in datasets.read(spark, path).orderBy("PSA_ID").collect()] == [("PSA000001", "one two three four"), ("PSA000002", "five"), ("PSA000003", "six seven"), ("PSA000004", "eight")]
    other = str(tmp_path / "e")
    build.store(datasets.read(spark, path), stats, other, {"today": "2024-01-01"})
    assert state(datasets.table(spark, path, "profile")) == state(datasets.table(spark, other, "profile"))
    assert datasets.text(spark, path, "report.md").replace(path, other) == datasets.text(spark, other, "report.md")
    with pytest.raises(ValueError, match="Space"):
        build.append(rows(spark, ["x"], domain="Space"), path)
    assert len(datasets.versions(spark, path)) == 2


TMX = "<tmx><body>" + "".join(f'<tu><tuv xml:lang="en"><seg>{e}</seg></tuv><tuv xml:lang="sw"><seg>{s}</seg></tuv></tu>' for e, s in (("Wash your hands with soap.", "Osha mikono yako."), ("Keep a distance from other people.", "Kaa mbali na wengine."))) + "</body></tmx>"


def test_build_and_reclean_from_the_command_line(spark, tmp_path, capsys):
    """Dataset, statistics and report come in one version; then the dataset is cleaned again."""
    (tmp_path / "memories").mkdir()
    (tmp_path / "memories" / "a.tmx").write_text(TMX)
    (tmp_path / "hard").write_text("Few sources\n\nLong texts\n")
    (tmp_path / "next").write_text("More sources\n")
    out = str(tmp_path / "out")
    assert build.main(["build", out, "--tmx", str(tmp_path / "memories"), "--challenges", str(tmp_path / "hard"), "--next-steps", str(tmp_path / "next"), "--single-file"]) == 0
    df = datasets.read(spark, out)
    assert df.columns == rules.COLUMNS and [(r.PSA_ID, r.Kiswahili, r.Ekegusii) for r in df.orderBy("PSA_ID").collect()] == [("PSA000001", "Osha mikono yako.", ""), ("PSA000002", "Kaa mbali na wengine.", "")]
    assert json.loads(df.first().Metadata)["split"] == "tmx_all"
    stats, report = json.loads(datasets.text(spark, out, "stats.json")), datasets.text(spark, out, "report.md")
    assert stats["source_counts"] == {"tico19": 2} and stats["output_rows"] == 2
    assert "## Rows per Domain\n\n| Domain | Rows |\n|---|---|\n| Health | 2 |" in report and "- Few sources\n- Long texts\n" in report and "- More sources" in report
    assert build.main(["reclean", out, "--no-report"]) == 0
    assert len(datasets.versions(spark, out)) == 2 and texts(spark, out) == [r.English for r in df.orderBy("PSA_ID").collect()]
    assert json.loads(datasets.text(spark, out, "stats.json"))["rows_per_source"] == {rules.TICO["source"]: 2}


def test_bench_pairs_from_the_command_line(spark, tmp_path):
    (tmp_path / "TICO19.dev.en").write_text("Stay at home if you can.\nCall your doctor by phone first.\nmore than the other\n")
    (tmp_path / "TICO19.dev.sw").write_text("Kaa nyumbani.\nPiga simu.\n")
    out = str(tmp_path / "out")
    assert build.main(["build", out, "--bench", str(tmp_path), "--split", "dev", "--tico-max", "2", "--no-report"]) == 0
    got = datasets.read(spark, out).orderBy("PSA_ID").collect()
    assert [r.Kiswahili for r in got] == ["Kaa nyumbani.", "Piga simu."] and json.loads(got[0].Metadata)["split"] == "dev"


def test_nothing_to_build(spark, tmp_path):
    out = str(tmp_path / "out")
    assert build.main(["build", out]) == 0
    assert datasets.read(spark, out).count() == 0 and "- **Total rows:** 0" in datasets.text(spark, out, "report.md")
    assert build.build(spark, {}, langid.unknown)[0].columns == rules.COLUMNS


def test_what_is_written_elsewhere_is_deleted(spark, tmp_path, monkeypatch):
    """Of the scratch tables of whole records only the last one stays; shuffle files go with the action, and the session is as before."""
    monkeypatch.setattr(session, "_GIVEN", [])
    path, old = str(tmp_path / "d"), spark.conf.get(session.SHUFFLES_GO)
    there = lambda: {g.rsplit("/", 1)[1].split("-")[0] for g in session._GIVEN if os.path.isdir(g.removeprefix("file:"))}
    datasets.write(rows(spark, ["one two three four five", "one two three four five", "six seven eight nine ten"]).drop("_n"), path)
    assert there() == set()
    df, stats = build.reclean(datasets.read(spark, path), langid.unknown)
    build.store(df, stats, path, {}, made=True)
    assert texts(spark, path) == ["one two three four five", "six seven eight nine ten"] and there() - {"state"} == {"numbered"}
    build.store(df, stats, path)
    assert "dataset" not in there() and len(texts(spark, path)) == 2
    built, _ = build.build(spark, {"tico19": rows(spark, ["one two three four five"]).drop("_n").withColumn("seq", F.lit(1))}, langid.unknown)
    assert built.count() == 1 and "merged" not in there() and "cleaned" not in there()
    assert spark.conf.get(session.SHUFFLES_GO) == old


def test_a_version_takes_little_disk(spark, tmp_path):
    """Rows are gzipped, in order over the files, and columns that they lack are added where they are written."""
    size = lambda name, path: sum(os.path.getsize(f"{path}/{name}/data/{f}") for f in os.listdir(f"{path}/{name}/data"))
    df = rows(spark, [f"sentence {k} of words that come again and again" for k in range(5_000)]).select("PSA_ID", "English", "Domain", "_n").repartition(4)
    path, other = str(tmp_path / "d"), str(tmp_path / "e")
    name, plain = datasets.write(df, path, columns=rules.COLUMNS), datasets.write(datasets.taken(df, rules.COLUMNS), other, single=True)
    assert size(name, path) < size(plain, other) / 3
    files = sorted(f for f in os.listdir(f"{path}/{name}/data") if f.startswith("part-"))
    assert files and all(f.endswith(".csv.gz") for f in files)
    ids = [r.PSA_ID for f in files for r in datasets.read(spark, f"{path}/{name}/data/{f}").collect()]
    assert ids == [f"PSA{k:06d}" for k in range(1, 5_001)]
    got = datasets.read(spark, path)
    assert got.columns == rules.COLUMNS and got.orderBy("PSA_ID").collect() == datasets.read(spark, other).orderBy("PSA_ID").collect()
