"""Records: construction, ids, validation, first rows by key, caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions.session import held
from millrace.functions.text import blank, is_paired

#: Parts that a key is dealt to before its first rows are taken.
SALT = 64
SCHEMA = ", ".join(f"{c} string" for c in rules.COLUMNS)


def record(domain: Column, english: Column, kiswahili: Column | None = None, source: Column | None = None, date: str | None = None, url: Column | None = None, metadata: Column | None = None, ekegusii: Column | None = None, status: str = "Pending") -> list[Column]:
    """The ten columns in order, with their defaults; the id is empty until it is assigned."""
    today = F.lit(date) if date else F.date_format(F.current_date(), "yyyy-MM-dd")
    none = F.lit("")
    values = [none, domain, english, kiswahili, ekegusii, source, today, url, F.lit("{}") if metadata is None else metadata, F.lit(status)]
    return [blank(none if v is None else v).alias(c) for c, v in zip(rules.COLUMNS, values, strict=True)]


def digest(keys: Sequence[str | Column]) -> list[Column]:
    """128 bits of hashes in place of keys: two longs, which sort and compare faster than texts and do not grow with them. That two
    different keys of a table share them is less likely than 1 in 10^14 at 10^12 keys."""
    cells = [x for k in keys for c in [F.col(k) if isinstance(k, str) else k] for x in (c, c.isNull())]  # hashes pass over nulls
    return [F.xxhash64(F.lit(seed), *cells).alias(name) for seed, name in ((1, "__a"), (2, "__b"))]


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key by the given order. Keys are columns or expressions, and are not in the result unless they are columns of it.

    An aggregate rather than a window: each task keeps one row for a key before
    the shuffle, so a key that holds a third of all rows costs no more than others. Keys are grouped by their digest.
    """
    columns = df.columns
    picked = df.groupBy(*digest(keys)).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return picked.select("row.*")


def packed(high: str, low: str) -> Column:
    """A long and an int as one decimal of the same order: aggregates over it hash instead of sorting."""
    return (F.col(high).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + (F.col(low).cast("long") + (1 << 31)).cast("decimal(10,0)")).cast("decimal(38,0)")


def first_places(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The order columns, a long and an int, of the first row of each key.

    The key becomes its digest and the order one decimal, so the aggregate is one over
    numbers: it hashes instead of sorting, and what is shuffled does not grow with the key's length.
    """
    high, low = order
    rows = df.select(*digest(keys), packed(high, low).alias("__p"))
    first = rows.groupBy("__a", "__b").agg(F.min("__p").alias("__p"))
    rest = F.pmod(F.col("__p"), F.lit(1 << 32).cast("decimal(10,0)"))
    kinds = dict(df.dtypes)
    return first.select(
        ((F.col("__p") - rest) / F.lit(1 << 32).cast("decimal(10,0)")).cast(kinds[high]).alias(high), (rest.cast("long") - (1 << 31)).cast(kinds[low]).alias(low)
    )


def cap_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | Column) -> DataFrame:
    """The first rows of each key, as many as the limit says; a null limit keeps all.

    With one number for all, Spark keeps as many rows of a key in each task before the
    shuffle. A limit that differs from row to row is applied twice, first in
    SALT parts of each key, so that what meets in one task is SALT times the limit at
    most; keys without a limit stay in parts.
    """
    if isinstance(limit, int):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")
    df = df.withColumns({"__salt": F.pmod(F.xxhash64(*order), F.lit(SALT)), "__most": limit})
    for part in (F.col("__salt"), F.when(F.col("__most").isNull(), F.col("__salt"))):
        w = Window.partitionBy(*keys, part).orderBy(*order)
        df = df.withColumn("__n", F.row_number().over(w)).where(F.col("__most").isNull() | (F.col("__n") <= F.col("__most")))
    return df.drop("__n", "__salt", "__most")


def number(df: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Consecutive numbers from 1 in the given order, without sending all rows to one task.

    Rows are dealt by range and written to the shared folder, so that both uses
    below see the same partitions; a row's number is its place in its partition
    plus the rows of the partitions before it, of which there is one count each.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    placed, _ = held(dealt.withColumn("__r", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1), "numbered")
    counts = placed.groupBy("__p").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    return placed.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__r")).drop("__p", "__r", "__b")


def assign_ids(df: DataFrame, order: Sequence[str], prefix: str = "PSA", width: int = 6) -> DataFrame:
    """Records with ids prefix + number, padded to the width or longer; other columns go."""
    numbered = number(df, order, "__id")
    digits = F.col("__id").cast("string")
    return numbered.withColumn("PSA_ID", F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))).select(*rules.COLUMNS)


def validate(df: DataFrame) -> list[str]:
    """Problems of a table of records; none if it is valid. One aggregate over the rows."""
    missing = [c for c in rules.COLUMNS if c not in df.columns]
    if missing:
        return [f"missing columns: {missing}"]
    extra = [c for c in df.columns if c not in rules.COLUMNS]
    problems = [f"unexpected columns: {extra}"] if extra else []
    row = validation(df).first()
    if row.invalid_domains:
        problems.append(f"invalid domains: {row.invalid_domains.split('|')} (allowed: {rules.DOMAINS})")
    if row.n_empty_english:
        problems.append(f"{row.n_empty_english} rows with empty English text")
    return problems


def validation(df: DataFrame) -> DataFrame:
    """One row: invalid domains in order, joined by |, and the number of rows without English."""
    bad = F.when(~F.col("Domain").isin(rules.DOMAINS), F.col("Domain"))
    return df.agg(F.array_join(F.array_sort(F.collect_set(bad)), "|").alias("invalid_domains"), F.count(F.when(~is_paired(F.col("English")), 1)).alias("n_empty_english"))
