"""Text functions, Column to Column. Those that look for white space or words of a list in whole texts run as Arrow kernels, which take a
tenth of what a regex of the JVM takes for a letter; the others are Spark's own expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions import rules

#: Unicode white space and U+001C to U+001F, as a regex class body; plain \s is narrower in Java.
SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACES}]"
BULLETS = "•‣◦\\-–—*+"
#: A run of white space that is not one plain space already, for Arrow's kernels. Most texts have none.
_RUN = " [{0}]+|[{1}][{0}]*".format(SPACES, SPACES.replace(r"\x1c-\x20", r"\x1c-\x1f"))
#: What a text may not begin with once it is tidy.
_LEAD = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + BULLETS.replace("\\", "")
START = "A-Z0-9\"“'"
#: Bytes of texts that a task works on at a time.
STRETCH = 1 << 22


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row: filters and projections above do not repeat their expressions."""
    own = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(own)))


def blank(c: Column) -> Column:
    """The empty string for null: records have no nulls."""
    return F.coalesce(c, F.lit(""))


def stretches(texts: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """What work makes of the texts, a stretch of them at a time, so that copies in between are small even where texts are long."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // STRETCH
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([work(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])


def _normal(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(texts, _RUN, " "), " ")


@F.arrow_udf(StringType())
def _normalize(texts: pa.Array) -> pa.Array:
    return stretches(texts, _normal)


@F.arrow_udf(StringType())
def _tidy(texts: pa.Array) -> pa.Array:
    return stretches(texts, lambda x: pc.utf8_ltrim(_normal(x), _LEAD))


@F.arrow_udf(ArrayType(StringType()))
def _sentences(texts: pa.Array) -> pa.Array:
    # a normalized text has no line feed, so that one can mark where it is cut
    return stretches(texts, lambda x: pc.split_pattern(pc.replace_substring_regex(_normal(x), f"([.!?]) +([{START}])", "\\1\n\\2"), "\n"))


def normalize(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return _normalize(blank(c))


def strip(c: Column) -> Column:
    ws = f"[[^!-~]&&[{SPACES}]]"  # a letter costs one test and not one for each range
    return F.regexp_replace(blank(c), rf"(?![!-~])(?:^{ws}++|(?<!{ws}){ws}++\z)", "")


def strip_bullet(c: Column) -> Column:
    return strip(F.regexp_replace(blank(c), rf"^[{SPACES}{BULLETS}]+", ""))


def tidy(c: Column) -> Column:
    """Normalized, then without a leading bullet; what is left has no white space at its ends."""
    return _tidy(blank(c))


def is_dangling(c: Column) -> Column:
    """Ends in a colon, but for one run of dashes or bullets: announces a list that was cut off."""
    return blank(c).contains(":") & blank(c).rlike(rf":{WS}*[-–—•*]*{WS}*\z")


def n_words(c: Column) -> Column:
    """Words of a normalized text."""
    spaces = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(c == "", F.lit(0)).otherwise(spaces + 1).cast("int")


def sentences(c: Column) -> Column:
    """Array of the sentences of a normalized text: cut after . ! ? before an upper-case letter, digit or quote."""
    return F.split(c, rf" (?<=[.!?] ) *(?=[{START}])", -1)


def normal_sentences(c: Column) -> Column:
    """Array of the sentences of the text, normalized."""
    return _sentences(blank(c))


def exact_key(c: Column) -> Column:
    return F.lower(normalize(c))


def near_key(c: Column, words: int = 8, normal: bool = False) -> Column:
    """The first words of the lower-case text. normal: the text is normalized already."""
    return F.lower(F.substring_index(c if normal else normalize(c), " ", words))


def word_bounds(c: Column, low: int = rules.MIN_WORDS, high: int = rules.MAX_WORDS) -> Column:
    return n_words(c).between(low, high)


def is_boilerplate(c: Column, lower: bool = False) -> Column:
    """lower: the text is in lower case already; where it is not, a filter makes it so once for each marker, see within."""
    low = c if lower else F.lower(blank(c))
    out = F.lit(False)
    for marker in rules.BOILERPLATE:
        out = out | low.contains(marker)
    return out


def within(df: DataFrame, text: str, low: int | Column = rules.MIN_WORDS, high: int = rules.MAX_WORDS, normal: bool = True) -> DataFrame:
    """Rows whose text has so many words and no boilerplate. Words and lower case are made once for each row. normal: the text is normalized already."""
    own = {"__low": F.lower(blank(F.col(text)))} | ({} if normal else {"__normal": normalize(F.col(text))})
    rows = once(once(df, **own), __n=n_words(F.col(text if normal else "__normal")))
    return rows.where((F.col("__n") >= low) & (F.col("__n") <= high) & ~is_boilerplate(F.col("__low"), lower=True)).drop("__n", *own)


def is_paired(c: Column) -> Column:
    return blank(c).rlike(f"[^{SPACES}]")


def alias_domain(c: Column) -> Column:
    out = c
    for name, domain in rules.DOMAIN_ALIAS.items():
        out = F.when(c == name, F.lit(domain)).otherwise(out)
    return out


def with_domain(df: DataFrame, text: str, name: str = "domain", keywords: dict[str, list[str]] = rules.KEYWORDS) -> DataFrame:
    """df with the first domain that has a keyword inside the text in lower case, null if none."""
    patterns = {domain: "|".join(map(re.escape, words)) for domain, words in keywords.items() if words}

    @F.arrow_udf(StringType())
    def first(low: pa.Array) -> pa.Array:
        found = pa.nulls(len(low), low.type)
        for domain, pattern in reversed(patterns.items()):
            found = pc.if_else(pc.match_substring_regex(low, pattern), pa.scalar(domain, low.type), found)
        return found

    return once(df, **{name: first(F.lower(blank(F.col(text))))})


def truncate(c: Column, width: int = 120) -> Column:
    cut = F.regexp_replace(F.substring(c, 1, width - 1), rf"{WS}+\z", "")
    return F.when(F.length(c) <= width, c).otherwise(F.concat(cut, F.lit("…")))


def escape_markdown(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def json_object(**fields: Column | str) -> Column:
    """JSON text with a space after colon and comma; strings are escaped by Spark's own writer."""
    parts = []
    for name, value in fields.items():
        c = F.lit(value) if isinstance(value, str) else value
        text = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        parts.append(F.concat(F.lit(f'"{name}": '), text))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
