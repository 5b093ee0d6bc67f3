"""Statistics of a dataset and the Markdown report that shows them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.functions.session import saved


STATE = "kind string, key string, n long, first long"


def place(c: Column) -> Column:
    """An id's number, which is its place in the dataset."""
    return F.coalesce(F.regexp_extract(c.cast("string"), r"(\d+)$", 1).try_cast("long"), F.lit(0))


def state(df: DataFrame, order: Column) -> DataFrame:
    """What a report needs of a part of a dataset, see STATE: rows and first place of each domain and source, and how many rows have so many
    words. One pass over the rows; states of parts are merged by adding up. order: each row's place, a long."""
    own = F.when(t.is_paired(F.col("Kiswahili")), t.n_words(t.normalize(F.col("Kiswahili"))))
    rows = t.once(df.select("Domain", "Source", "English", "Kiswahili", order.cast("long").alias("at")), en=t.n_words(t.normalize(F.col("English"))), sw=own)
    sets = rows.groupingSets([[F.col("Domain")], [F.col("Source")], [F.col("en")], [F.col("sw")]], F.col("Domain"), F.col("Source"), F.col("en"), F.col("sw"))
    counted = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.min("at").alias("first"))
    g = F.col("g")
    kind = F.when(g == 0b0111, "domain").when(g == 0b1011, "source").when(g == 0b1101, "en").otherwise("sw")
    key = F.when(g == 0b0111, F.col("Domain")).when(g == 0b1011, F.col("Source")).when(g == 0b1101, F.col("en").cast("string")).otherwise(F.col("sw").cast("string"))
    return counted.select(kind.alias("kind"), key.alias("key"), "n", "first").where("kind <> 'sw' or key is not null")


def merged(*states: DataFrame) -> DataFrame:
    """One state from those of parts."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def shifted(state: DataFrame, by: int) -> DataFrame:
    """The state of a part that comes behind so many rows."""
    return state.withColumn("first", F.col("first") + by)


def figures(state: DataFrame) -> DataFrame:
    """One row from a state: rows, paired rows, sources, means and medians of words. Medians come from how many rows have so many words."""
    length = F.when(F.col("kind").isin("en", "sw"), F.col("key").cast("int"))
    w = Window.partitionBy("kind", F.when(~F.col("kind").isin("en", "sw"), F.col("key")))
    rows = state.withColumn("w", length).withColumns({"upto": F.sum("n").over(w.orderBy("w")), "all": F.sum("n").over(w)})
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    at = lambda kind, k: F.max(of(kind, F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col("w"))))
    n = {k: F.coalesce(F.sum(of(k, F.col("n"))), F.lit(0)) for k in ("en", "sw")}
    mean = {k: F.sum(of(k, F.col("w") * F.col("n"))) / F.sum(of(k, F.col("n"))) for k in n}
    median = {k: (at(k, low) + at(k, high)) / 2 for k in n}
    sources = F.count(F.when((F.col("kind") == "source") & (F.col("key") != ""), 1))
    return rows.agg(n["en"].alias("total"), n["sw"].alias("paired"), sources.alias("sources"), mean["en"].alias("en_mean"), median["en"].alias("en_median"), mean["sw"].alias("sw_mean"), median["sw"].alias("sw_median"))


def counts(state: DataFrame, kind: str) -> DataFrame:
    """Rows for each domain or source, most first, ties by the first row."""
    return state.where(F.col("kind") == kind).orderBy(F.desc("n"), "first").select("key", F.col("n").alias("rows"))


def drawn(df: DataFrame, n: int = 20, seed: int | None = None) -> DataFrame:
    """Some rows at random, for a look; with a seed the same ones from the same table."""
    return df.orderBy(F.rand(seed)).limit(n)


def sample(df: DataFrame, n: int = 5) -> DataFrame:
    cut = lambda c: t.escape_markdown(t.truncate(F.col(c))).alias(c)
    return df.orderBy("PSA_ID").limit(n).select("PSA_ID", "Domain", cut("English"), cut("Kiswahili"), t.escape_markdown(F.col("Source")).alias("Source"))


def report(df: DataFrame, title: str, file: str, challenges: Sequence[str] = (), next_steps: Sequence[str] = (), today: str | None = None, state_of: DataFrame | None = None) -> str:
    """Markdown report of a dataset. The driver gets a state, which has a row for each domain, source and number of words, and five rows. state_of: the dataset's state, if it is there already."""
    kept = saved(state(df, place(F.col("PSA_ID"))) if state_of is None else state_of, "state")
    f = figures(kept).first()
    row = lambda *cells: "| " + " | ".join(map(str, cells)) + " |"
    table = lambda head, rows: [row(*head), "|" + "---|" * len(head), *(row(*r) for r in rows), ""]
    words = [("English", f"{f.en_mean:.1f}", f"{f.en_median:.0f}") if f.total else ("English", "–", "–"), ("Kiswahili", f"{f.sw_mean:.1f}", f"{f.sw_median:.0f}") if f.paired else ("Kiswahili", "– (no paired rows yet)", "–")]
    lines = [
        f"# {title}", "", f"_Generated: {today or date.today().isoformat()}_", "", "## Overview", "",
        f"- **Total rows:** {f.total}", f"- **Paired EN–SW rows (Kiswahili filled):** {f.paired}", f"- **Distinct sources:** {f.sources}", f"- **Dataset file:** `{file}`", "",
        "## Rows per Domain", "", *table(("Domain", "Rows"), counts(kept, "domain").collect()),
        "## Rows per Source", "", *table(("Source", "Rows"), counts(kept, "source").withColumn("key", t.escape_markdown(F.col("key"))).collect()),
        "## Sentence length (words)", "", *table(("Language", "Mean", "Median"), words),
        "## Sample rows (first 5)", "", *table(("PSA_ID", "Domain", "English", "Kiswahili", "Source"), sample(df).collect()),
        "## Challenges faced", "", *(f"- {x}" for x in challenges), "", "## Next steps", "", *(f"- {x}" for x in next_steps), "",
    ]
    return "\n".join(lines)
