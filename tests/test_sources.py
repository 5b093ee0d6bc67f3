"""Sources, cleaning and whole runs on small fixtures."""

import json
import math

from pyspark.sql import functions as F

from millrace.functions import langid, rules
from millrace.functions import text as t
from millrace.operators import cleaning, records
from millrace.plans import build, profile
from millrace.sources import datasets, html, pairs

EN = ["Wash your hands with soap and water.", "Stay at home if you have the fever and call your doctor today please."]


def test_tmx(spark, tmp_path):
    unit = '<tu><tuv xml:lang="EN-us"><seg>One &amp; <b>two</b>  three</seg><seg>no</seg></tuv><tuv lang="sw"><seg>moja</seg></tuv><tuv xml:lang="sw-KE"><seg> mbili </seg></tuv></tu>'
    lone = '<tu><tuv xml:lang="en"><seg>alone</seg></tuv></tu>'
    (tmp_path / "x.tmx").write_text(f'<?xml version="1.0"?><tmx><body>{unit}\n{lone}\n<tu tuid="3"><tuv xml:lang="en"><seg><![CDATA[a < b]]></seg></tuv><tuv xml:lang="sw"><seg>c</seg></tuv></tu></body></tmx>')
    rows = pairs.tmx(spark, str(tmp_path / "x.tmx")).orderBy("seq").collect()
    assert [(r.en, r.sw) for r in rows] == [("One & two three", "mbili"), ("a < b", "c")]


def test_zip_and_pairs(spark, tmp_path):
    (tmp_path / "a.en").write_text("one\ntwo\nthree\n")
    (tmp_path / "a.sw").write_text("moja\nmbili\n")
    assert [(r.en, r.sw) for r in pairs.zipped(spark, str(tmp_path / "a.en"), str(tmp_path / "a.sw")).orderBy("seq").collect()] == [("one", "moja"), ("two", "mbili")]
    (tmp_path / "b.tsv").write_text('the "farm \tshamba\textra\nno\n \tx\n')
    (tmp_path / "a.tsv").write_text("school\tshule\n")
    assert [(r.en, r.sw) for r in pairs.read_pairs(spark, str(tmp_path)).orderBy("seq").collect()] == [("school", "shule"), ('the "farm', "shamba")]
    (tmp_path / "s.csv").write_text("1\teng\told\n1\teng\tThe school is open today\n2\tswa\tShule\n3\tfra\tx\n")
    (tmp_path / "l.csv").write_text("1\t2\n2\t1\n1\t3\n")
    got = pairs.read_exports(spark, str(tmp_path / "s.csv"), str(tmp_path / "l.csv"))
    assert [(r.en, r.sw) for r in got.collect()] == [("The school is open today", "Shule")] * 2
    assert {r.Domain for r in pairs.import_sentences(got).collect()} == {"Education"}


def test_site(spark):
    site = {**rules.SITES[0], "name": "s", "domain": "Road Safety", "start_urls": ["http://x.org/list"], "link_patterns": ["/a/"], "min_words": 4, "max_records": 2, "content_selectors": ["!bad", "article p"]}
    listing = '<a href="/a/1">1</a><a href="/b">b</a><a href="/a/2">2</a><a href="/a/1">again</a>'
    page = "<article><p>Drive slowly near all schools. Ⓒ Photo by some person here today.<p>Too short.<p>Wear a <b>seat belt</b> on each trip. Drive slowly near all schools.</article>"
    pages = spark.createDataFrame([("http://x.org/list", listing), ("http://x.org/a/1", page), ("http://x.org/a/2", "<p>Never drink and drive at all.</p>")], "url string, html string")
    rows = html.collect_site(pages, site, "2024-01-01").orderBy(*html.PLACE).collect()
    assert [r.English for r in rows] == ["Wear a seat belt on each trip.", "Drive slowly near all schools."]
    assert rows[0].Domain == "Security" and json.loads(rows[0].Metadata) == {"type": "scraped", "tool": "html.parser", "site": "s"}
    assert html.collect_all(pages, ["who_covid_qna"], date="2024-01-01").count() == 0


def test_robots():
    body = "User-agent: *\nDisallow: /private/"
    assert not html.allowed("http://x.org/private/1", 200, body) and html.allowed("http://x.org/1", 200, body)
    assert not html.allowed("http://x.org/1", 403, None) and html.allowed("http://x.org/1", 404, None) and html.allowed("http://x.org/1", None, None)


def table(spark, english):
    cols = records.record(F.lit("Health"), F.col("e"), source=F.lit("WHO"), date="2024-01-01")
    return spark.createDataFrame(list(enumerate(english)), "seq long, e string").select("seq", *cols)


def test_clean_counts_and_again(spark):
    french = "Les enfants sont dans la maison avec les parents pour une fête ce soir"
    df = table(spark, [EN[0], EN[0].upper(), "Two words", french, "- " + EN[1], None])
    out, counts = cleaning.clean(df, ["seq"], stats=True)
    assert [r.English for r in sorted(out.collect())] == [EN[0], EN[1]]
    assert counts() == {"input": 6, "after_empty": 5, "after_fragments": 5, "after_length": 4, "after_dedupe": 3, "after_lang": 2, "output": 2, "removed_total": 4}
    again = cleaning.clean(out, ["seq"])[0]
    assert sorted(again.collect()) == sorted(out.collect())


def test_build_and_reclean(spark, tmp_path):
    frames = {"tico19": table(spark, EN), "tatoeba": table(spark, ["The farmer has a good harvest of maize.", EN[0]])}
    df, stats = build.build(spark, frames, langid.unknown)
    rows = df.orderBy("PSA_ID").collect()
    assert [r.PSA_ID for r in rows] == ["PSA000001", "PSA000002", "PSA000003"] and df.columns == rules.COLUMNS
    assert stats["source_counts"] == {"tico19": 2, "tatoeba": 2} and stats["output_rows"] == 3
    out = str(tmp_path / "data")
    datasets.write(df, out)
    again, more = build.reclean(datasets.read(spark, out), langid.unknown)
    assert [tuple(r) for r in again.orderBy("PSA_ID").collect()] == [tuple(r) for r in rows]
    assert more["rows_per_source"] == {"WHO": 3}
    text = profile.report(again, "T", "data", today="2024-01-01")
    assert "- **Total rows:** 3" in text and "| Kiswahili | – (no paired rows yet) | – |" in text
    assert build.build(spark, {})[0].count() == 0


def test_validate(spark):
    df = build.build(spark, {"tico19": table(spark, EN)}, langid.unknown)[0]
    assert records.validate(df) == []
    assert records.validate(df.drop("URL")) == ["missing columns: ['URL']"]
    bad = records.validate(df.withColumn("Domain", F.lit("Space")).withColumn("English", F.lit(" ")).withColumn("x", F.lit(1)))
    assert len(bad) == 3 and "Space" in bad[1] and bad[2].startswith("2 rows")


def test_language(spark):
    got = spark.createDataFrame([(EN[1], "en"), ("Les enfants sont dans la maison avec les parents", "fr"), ("abc", None)], "c string, want string").withColumn("lang", langid.detect(F.col("c"))).collect()
    assert all(r.lang == r.want for r in got)


def test_truncate(spark):
    df = spark.createDataFrame([("x" * 118 + "  yy",), ("a|b\nc",)], "c string")
    assert [r[0] for r in df.select(t.escape_markdown(t.truncate(F.col("c")))).collect()] == ["x" * 118 + "…", "a\\|b c"]


def test_profiles_of_letters(spark):
    detect = langid.learned(spark)
    rows = [
        ("Veuillez vous laver les mains régulièrement avec du savon et de l'eau propre chaque jour.", "fr"), (EN[1], "en"), ("Mtoto wangu anaumwa na tumbo tangu jana asubuhi na hataki kula chakula.", "sw"),
        ("Der Bus fährt heute nicht, weil die Straße wegen des Schnees gesperrt ist.", "de"), ("Mañana por la mañana iremos al mercado para comprar pan y fruta.", "es"),
        ("abc", None), ("1234567890 !!", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame(rows, "c string, want string")
    assert all(r.lang == r.want for r in df.withColumn("lang", detect(F.col("c"))).collect())
    other = langid.learned(spark, spark.createDataFrame([("lorem ipsum dolor sit amet consectetur", "la"), (None, "la"), ("x", None)], "text string, lang string"), ["la", "en"])
    got = spark.createDataFrame([("dolor amet ipsum sit",), (EN[1],)], "c string").select(other(F.col("c"))).collect()
    assert [r[0] for r in got] == ["la", "en"]


def test_profile_sums_are_those_of_a_loop(spark):
    texts = spark.createDataFrame([("one two", "a"), ("zwei drei Öl", "b"), ("two x", "a")], "text string, lang string")
    weights = langid.learn(texts, ["a", "b"]).weights
    counts = {k: [0] * langid.SLOTS for k in "ab"}
    for text, lang in (("one two", "a"), ("zwei drei öl", "b"), ("two x", "a")):
        codes = [ord(x) for x in f" {text} "]
        for x, y, z in zip(codes, codes[1:], codes[2:]):
            counts[lang][(x * 7919 + y * 241 + z) % langid.SLOTS] += 1
    for k in "ab":
        assert weights[k] == [round(1000 * math.log((n + 0.5) / (sum(counts[k]) + 0.5 * langid.SLOTS))) for n in counts[k]]


def test_profiles_beat_function_words_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    profile = langid.learn(docs.where("not held"), ["de", "en", "es", "fr"])
    cut = docs.where("held").select("lang", F.explode(t.sentences(t.normalize(F.col("text")))).alias("s")).where(F.length("s") >= 10)
    right = lambda c: F.avg(F.coalesce((c == F.col("lang")).cast("int"), F.lit(0)))
    words, letters = cut.agg(right(langid.detect(F.col("s"))), right(profile.detect(F.col("s")))).first()
    print(words, letters)
    assert letters > words and letters > 0.95
