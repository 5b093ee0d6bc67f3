"""Sentence boundaries with abbreviations that are learned from the texts themselves.

A word that nearly always has a full stop behind it is an abbreviation, and the stop no end of
a sentence. Whether it does is measured by the likelihood ratio of Kiss and Strunk (2006): that the word goes with the
stop against that stops fall behind words by chance, weighed by the word's length, its inner stops and how
often it stands without one. Counts are aggregates over words; what is
learned is a table that stays in Spark and is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.functions.session import saved

#: Score from which a word is an abbreviation, and how surely one has its full stop.
LEAST, SURE = 0.3, 0.99


def word(token: Column) -> Column:
    """A token's word: lower case, without its final full stop and without what stands around it."""
    bare = F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+\z", "")
    return F.regexp_replace(bare, r"\.\z", "")


def has_stop(token: Column) -> Column:
    return token.rlike(r"\.[^\p{L}\p{N}.]*\z")


def counted(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, n and n_stop. Tokens are counted first: a word is made once for each distinct token, not for each time it stands in a text."""
    token = texts.select(F.explode(F.split(t.normalize(F.col(text)), " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    words = token.select(word(F.col("token")).alias("word"), "n", F.when(has_stop(F.col("token")), F.col("n")).otherwise(0).alias("stop"))
    return words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("stop").alias("n_stop"))


def abbreviations(texts: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """word, n, n_stop and score of each word that counts as an abbreviation. Words are those with a letter and no digit."""
    words = saved(counted(texts, text), "words")
    whole = words.agg(F.sum("n").alias("n"), F.sum("n_stop").alias("stops")).first()
    if not whole.n or whole.stops == whole.n:  # no words, or none without a stop: nothing tells abbreviations apart
        return words.limit(0).withColumn("score", F.lit(0.0))
    share = F.lit(whole.stops / whole.n)
    with_stop, without = F.col("n_stop"), F.col("n") - F.col("n_stop")
    chance = with_stop * F.ln(share) + without * F.ln(1 - share)
    bound = with_stop * F.ln(F.lit(SURE)) + without * F.ln(F.lit(1 - SURE))
    letters = F.length(F.regexp_replace("word", r"\.", ""))
    stops_inside = F.length("word") - letters
    score = -2 * (chance - bound) * F.exp(-letters) * (stops_inside + 1) * F.pow(letters.cast("double"), -without)
    known = words.where((F.col("n_stop") > 0) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"\p{N}"))
    return known.withColumn("score", score).where(F.col("score") >= least).select("word", "n", "n_stop", "score")


def sentences(docs: DataFrame, keys: Sequence[str], known: DataFrame, text: str = "text") -> DataFrame:
    """keys, pos and text of the sentences of normalized texts: cut as t.sentences does, but not behind an abbreviation.

    Pieces meet again by document, which is as much as one task gets."""
    pieces = docs.select(*keys, F.posexplode(t.sentences(t.normalize(F.col(text)))).alias("piece", "text"))
    last = F.substring_index("text", " ", -1)
    ended = pieces.withColumn("last", F.when(has_stop(last), word(last)))
    flagged = ended.join(known.select(F.col("word").alias("last"), F.lit(True).alias("short")), "last", "left")
    w = Window.partitionBy(*keys).orderBy("piece")
    begins = F.when(F.coalesce(F.lag("short").over(w), F.lit(False)), 0).otherwise(1)
    placed = flagged.withColumn("begins", begins).withColumn("pos", (F.sum("begins").over(w) - 1).cast("int"))
    whole = placed.groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("parts"))
    return whole.select(*keys, "pos", F.array_join("parts.text", " ").alias("text"))
