"""Cleaning of records: tidy, drop, deduplicate, check languages and domains."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions import langid, rules
from millrace.functions import text as t
from millrace.operators.records import digest, first_per

STAGES = ("input", "after_empty", "after_fragments", "after_length", "after_dedupe", "after_lang", "output")


def dedupe(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First row of each near key (first eight words of the lower-case text); English is normalized.

    Equal texts have equal near keys, so the exact pass needs no shuffle of its own.
    """
    return first_per(df, [t.near_key(F.col("English"), normal=True)], order)


def english_gate(text: Column, lang: Column, words: Column | None = None) -> Column:
    """Texts under ten words, of unknown language or English. words: their number, where it is there already."""
    return ((t.n_words(text) if words is None else words) < 10) | lang.isNull() | (lang == "en")


def kiswahili_gate(text: Column, lang: Column) -> Column:
    """The text, blank if it is clearly of another language; the row stays."""
    return F.when((text != "") & lang.isNotNull() & (lang != "sw"), F.lit("")).otherwise(text)


def steps(df: DataFrame, order: Sequence[str], detect: Callable[[Column], Column] = langid.detect, seen: Callable[[str, DataFrame], DataFrame] = lambda name, df: df, detect_sw: Callable[[Column], Column] | None = None) -> DataFrame:
    """The stages in their order; `seen` is called with each stage's name and rows. detect_sw: for Kiswahili, else as detect.

    Language and domain come after deduplication on purpose: a row that they
    drop may already have displaced a near copy.
    """
    en, sw, words = F.col("English"), F.col("Kiswahili"), F.col("__words")
    df = t.once(seen("input", df), English=t.tidy(en), Kiswahili=t.tidy(sw), __words=t.n_words(t.tidy(en)))
    df = seen("after_empty", df.where(en != ""))
    df = seen("after_fragments", df.where(~t.is_dangling(en)))
    df = seen("after_length", df.where(words.between(rules.MIN_WORDS, rules.MAX_WORDS)))
    df = seen("after_dedupe", dedupe(df, order))
    df = df.where(english_gate(en, detect(en), words)).withColumn("Kiswahili", kiswahili_gate(sw, (detect_sw or detect)(sw))).drop("__words")
    df = seen("after_lang", df)
    return seen("output", df.where(F.col("Domain").isin(rules.DOMAINS)))


def kept(df: DataFrame, order: Sequence[str], columns: Sequence[str], detect: Callable[[Column], Column] = langid.detect) -> DataFrame:
    """Some columns, not those of texts, of the rows that steps leaves. Whether a row passes the gates is found before deduplication, so that no text is sorted or sent."""
    en, words = F.col("English"), F.col("__words")
    rows = t.once(df, English=t.tidy(en), __words=t.n_words(t.tidy(en)))
    rows = rows.where((en != "") & words.between(rules.MIN_WORDS, rules.MAX_WORDS) & ~t.is_dangling(en))
    passes = english_gate(en, detect(en), words) & F.col("Domain").isin(rules.DOMAINS)
    rows = rows.select(*digest([t.near_key(en, normal=True)]), F.struct(*columns).alias("__own"), passes.alias("__passes"), F.struct(*order).alias("__at"))
    first = rows.groupBy("__a", "__b").agg(F.min_by(F.struct("__own", "__passes"), "__at").alias("x"))
    return first.where("x.__passes").select("x.__own.*")


def tally(df: DataFrame, order: Column, detect: Callable[[Column], Column] = langid.detect) -> DataFrame:
    """stage and n: the rows of each stage of steps, out of one pass over the rows and one aggregate over numbers.

    A row's digest stands for its text: of a near key, what is kept is how many rows there are and
    whether the first of them passes the gates. Rows that fall out before have one key for each stage. order: a number.
    """
    en = F.col("English")
    rows = t.once(t.once(df.withColumn("__at", order), English=t.tidy(en)), __words=t.n_words(en))
    words = F.col("__words")
    reach = F.when(en == "", 0).when(t.is_dangling(en), 1).when(~words.between(rules.MIN_WORDS, rules.MAX_WORDS), 2).otherwise(3)
    gate = F.when(~((words < 10) | F.coalesce(detect(en) == "en", F.lit(True))), 0).when(~F.coalesce(F.col("Domain").isin(rules.DOMAINS), F.lit(False)), 1).otherwise(2)
    a, b = digest([t.near_key(en, normal=True)])
    rows = t.once(rows, __reach=reach).select("__reach", F.when(F.col("__reach") == 3, a).alias("__a"), F.when(F.col("__reach") == 3, b).alias("__b"), "__at", F.when(F.col("__reach") == 3, gate).alias("__gate"))
    first = rows.groupBy("__reach", "__a", "__b").agg(F.count("*").alias("n"), F.min_by("__gate", "__at").alias("__gate"))
    least = lambda k: F.coalesce(F.sum(F.when(F.col("__reach") >= k, F.col("n"))), F.lit(0))
    passed = lambda k: F.count(F.when(F.col("__gate") >= k, 1))
    row = first.agg(F.array(*(least(k) for k in range(4)), *(passed(k) for k in range(3))).alias("n"))
    return row.select(F.explode(F.arrays_zip(F.array(*map(F.lit, STAGES)).alias("stage"), "n")).alias("x")).select("x.stage", "x.n")


def clean(df: DataFrame, order: Sequence[str], detect: Callable[[Column], Column] = langid.detect, stats: bool = False, detect_sw: Callable[[Column], Column] | None = None) -> tuple[DataFrame, Callable[[], dict[str, int]] | None]:
    """Cleaned rows and, with stats, a function that gives the stage counts once an action has run over them.

    Counting keeps filters from moving past the counted places, so it is off by default. A sort right
    above runs its input twice, to sample it, and doubles the counts: write the rows first.
    """
    if not stats:
        return steps(df, order, detect, detect_sw=detect_sw), None
    observed: dict[str, Observation] = {}

    def seen(name: str, df: DataFrame) -> DataFrame:
        observed[name] = Observation(name)
        return df.observe(observed[name], F.count(F.lit(1)).alias("n"))

    out = steps(df, order, detect, seen, detect_sw)

    def counts() -> dict[str, int]:
        n = {k: v.get["n"] for k, v in observed.items()}
        return n | {"removed_total": n["input"] - n["output"]}

    return out, counts
