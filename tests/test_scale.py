"""Work of a query that must not be done more often than once a row."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import langid
from millrace.functions import text as t
from millrace.operators import boundaries, cleaning, records
from millrace.plans import catalogue
from millrace.sources import datasets, html

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lower_case_is_made_once_for_all_markers(spark):
    assert plan(catalogue.QUERIES["site_keep"](spark, SF)).count("lower(") == 1


def test_white_space_is_that_of_the_plain_classes(spark):
    odd = ["", " ", "a b", "  a \t b  ", "a b", " a  b　", "a   b", "\x1c\x1f", "é à", "a\x85", "x  ", None, "- • a *", " ​ a", "– ", "a \n", "€ 5  ", "a ", "  a"]
    df = spark.createDataFrame([(x,) for x in odd], "c string").withColumn("b", t.blank(F.col("c")))
    plain = F.trim(F.regexp_replace("b", f"{t.WS}+", " "))
    bare = F.regexp_replace(F.regexp_replace(plain, rf"^[{t.SPACES}{t.BULLETS}]+", ""), rf"^{t.WS}+|{t.WS}+\z", "")
    both = df.select(t.normalize(F.col("c")).alias("x"), plain.alias("y"), t.strip(F.col("c")), F.regexp_replace("b", rf"^{t.WS}+|{t.WS}+\z", ""), t.tidy(F.col("c")), bare, t.n_words(F.col("b")), F.when(F.col("b") == "", 0).otherwise(F.size(F.split("b", " "))))
    for r in both.collect():
        assert list(r[::2]) == list(r[1::2])
    cut = spark.createDataFrame([("One. Two! \"Three? 4  five.  Six .7 a. b",)], "c string").select(t.sentences(F.col("c")), F.split("c", rf"(?<=[.!?]) +(?=[{t.START}])", -1)).first()
    assert cut[0] == cut[1] and len(cut[0]) == 5


def test_stages_are_counted_in_one_pass(spark):
    df = catalogue.QUERIES["clean_stats"](spark, SF)
    assert plan(df).count("Relation [") == 1
    assert {r.stage: r.n for r in df.collect()} == {r.stage: r.n for r in catalogue.QUERIES["clean_counts"](spark, SF).collect() if r.stage != "removed_total"}


def test_stages_of_an_empty_table(spark):
    rows = catalogue.recs(spark, SF).limit(0)
    assert [tuple(r) for r in cleaning.tally(rows, records.packed("doc_id", "pos"), lambda c: F.col("lang")).collect()] == [(k, 0) for k in cleaning.STAGES]


def test_stretches_of_texts_give_each_its_slots(monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 7)
    texts = [" one ", None, "", "  ", " öl \U00010400x ", " a ", " two three ", None]
    got = {}
    for places, size, slot in langid._runs(pa.array(texts).slice(1)):
        got |= {int(p) + 1: s.tolist() for p, s in zip(places, np.split(slot, np.cumsum(size)[:-1]), strict=True)}
    want = {k: [(ord(a) * 7919 + ord(b) * 241 + ord(c)) % langid.SLOTS for a, b, c in zip(x, x[1:], x[2:])] for k, x in enumerate(texts) if k and x and len(x) > 2}
    assert got == want


def test_profiles_send_no_row_for_a_letter_through_spark(spark):
    df = catalogue.QUERIES["language_profiles"](spark, SF)
    assert "ArrowEvalPython" in plan(df) and "aggregate(" not in plan(df)


def test_profiles_judge_letters_beyond_the_first_plane(spark):
    detect = langid.Profile({"a": [-9] * langid.SLOTS, "b": [-8] * langid.SLOTS}).detect
    df = spark.createDataFrame([("\U00010400" * 12,), ("short",)], "c string")
    assert [r[0] for r in df.select(detect(F.col("c"))).collect()] == ["b", None]


def test_pages_are_parsed_in_pieces(monkeypatch):
    pages = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3, 4], "url": ["http://x.org/"] * 4, "html": ["<p>a</p>" * 4, None, '<p>b</p><a href="/c">', "<p>c" * 9]})
    got = list(html.pieces(pages, "html", 20))
    assert [b.num_rows for b in got] == [2, 1, 1] and pa.Table.from_batches(got).equals(pa.Table.from_batches([pages]))
    assert [b.num_rows for b in html.pieces(pages, "html", 1 << 20)] == [4] and list(html.pieces(pages.slice(0, 0), "html", 9)) == []


def test_tokens_are_counted_before_their_words_are_made(spark):
    texts = spark.createDataFrame([("Dr. A met dr. B. So. Dr",), (None,)], "text string")
    counts = boundaries.counted(texts, "text")
    assert {r.word: (r.n, r.n_stop) for r in counts.collect()} == {"dr": (3, 2), "a": (1, 0), "met": (1, 0), "b": (1, 1), "so": (1, 1)}
    assert plan(counts).index("regexp_replace(lower(token") < plan(counts).index("Aggregate [token")


def test_cleaning_looks_for_white_space_and_words_in_arrow(spark):
    lean = catalogue.QUERIES["clean_per_source"](spark, SF)
    assert "ArrowEvalPython" in plan(lean) and "regexp_replace" not in plan(lean) and "split(" not in plan(lean)
    assert "Kiswahili" not in plan(lean) and plan(lean).count("_tidy(") == 1  # the texts that no count needs are neither made nor sent
    whole = cleaning.steps(catalogue.recs(spark, SF), catalogue.ORDER, lambda c: F.col("lang"))
    assert "regexp_replace" not in plan(whole) and plan(whole).count("replace(") == 3  # words are counted once a row; two kinds of sentences are decorated
    assert sorted(lean.collect()) == sorted(whole.groupBy("Source").count().collect())


def test_stretches_of_texts_are_put_together_again(monkeypatch):
    texts = pa.array(["a" * 5, None, "", "b" * 9, "c", "d"])
    sizes = []
    monkeypatch.setattr(t, "STRETCH", 4)
    assert t.stretches(texts, lambda x: sizes.append(len(x)) or x).equals(texts) and len(sizes) > 2 and sum(sizes) == 6
    assert len(t.stretches(texts.slice(0, 0), lambda x: x)) == 0


def test_rows_that_are_stored_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def own(k):
        made.add(1)
        return f"PSA{k:06d}"

    datasets.write(spark.range(500).select(own("id").alias("PSA_ID")), str(tmp_path))
    assert made.value == 500 == datasets.read(spark, str(tmp_path)).count()


def test_ids_are_padded_to_the_width_or_longer(spark, monkeypatch):
    monkeypatch.setattr(records, "number", lambda df, order, name: df.withColumn(name, F.col("n")))
    df = spark.createDataFrame([(7,), (123,), (1234,)], "n long").select("n", *records.record(F.lit("Health"), F.lit("x")))
    assert sorted(r.PSA_ID for r in records.assign_ids(df, ["n"], width=3).collect()) == ["PSA007", "PSA123", "PSA1234"]
