"""Pages: blocks by CSS selectors, links, sentences by site. Python runs once, to parse."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions import text as t
from millrace.operators.records import cap_per, first_per, record

# Fixed values of HTML: elements without content, elements whose text is not shown, and start tags that end an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "template"}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


#: A step of a selector: a tag or None, and classes.
Step = tuple[str | None, frozenset[str]]


@lru_cache(maxsize=1024)
def chains(selector: str) -> tuple[tuple[Step, ...], ...]:
    """Tag, .class and tag.class steps, descendants, comma lists; ValueError for anything else."""
    out = []
    for one in selector.split(","):
        steps = []
        for part in one.split():
            m = re.fullmatch(r"([a-zA-Z][\w-]*|\*)?((?:\.[\w-]+)*)", part)
            if not m or not part:
                raise ValueError(f"selector {part!r} is not understood")
            steps.append((None if m[1] in (None, "*") else m[1].lower(), frozenset(filter(None, m[2].split(".")))))
        if not steps:
            raise ValueError("empty selector")
        out.append(tuple(steps))
    return tuple(out)


@lru_cache(maxsize=1024)
def automaton(selectors: tuple[str, ...]) -> tuple[tuple[int, tuple[Step, ...]], ...]:
    """Chains of the selectors that are understood, each with its selector's number; "p" comes last by itself."""
    out = []
    for k, s in enumerate([*selectors, *([] if "p" in selectors else ["p"])]):
        try:
            out += [(k, c) for c in chains(s)]
        except ValueError:
            continue
    return tuple(out)


class Extractor(HTMLParser):
    """Blocks and links of a page in one pass over the parser's events, without a tree.

    An open element holds, for each chain, how many of its steps the way down to it has passed. It matches
    a chain if it fits the last step and what stands above it has passed all others. Strings are kept in one list;
    the text of an element is the stretch of it between the element's start and end, so that elements
    inside one another share their strings. Paragraphs and list items end where the next one begins.
    """

    def __init__(self, chains: tuple[tuple[int, tuple[Step, ...]], ...]):
        super().__init__(convert_charrefs=True)
        self.chains = chains
        self.open = [("", (0,) * len(chains), 0, ())]  # tag, steps passed, how many elements of hidden text are around, blocks that end with it
        self.opened = Counter()
        self.strings: list[str] = []
        self.hidden: list[int] = []
        self.blocks: list[list[int]] = []  # selector, hidden, from, to
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end("p", stop=("td", "th", "button"))
        elif tag == "li":
            self._end("li", stop=("ul", "ol"))
        attrs = dict(attrs)
        if tag == "a" and attrs.get("href") is not None:
            self.hrefs.append(attrs["href"])
        classes = set((attrs.get("class") or "").split())
        _, passed, depth, _ = self.open[-1]
        depth += tag in HIDDEN
        after, found = list(passed), {}
        for k, (selector, steps) in enumerate(self.chains):
            n = passed[k]
            if n < len(steps) and (steps[n][0] is None or steps[n][0] == tag) and steps[n][1] <= classes:
                after[k] = n + 1
            last = steps[-1]
            if n >= len(steps) - 1 and (last[0] is None or last[0] == tag) and last[1] <= classes:
                found[selector] = True
        mine = []
        for selector in found:
            mine.append(len(self.blocks))
            self.blocks.append([selector, depth, len(self.strings), len(self.strings)])
        if tag not in VOID:
            self.open.append((tag, tuple(after), depth, mine))
            self.opened[tag] += 1

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        data = data.strip()
        if data:
            self.strings.append(data)
            self.hidden.append(self.open[-1][2])

    def close(self):
        super().close()
        self._leave(1)

    def _end(self, tag, stop=()):
        if not self.opened[tag]:
            return None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                return self._leave(k)
            if self.open[k][0] in stop:
                return None
        return None

    def _leave(self, k: int):
        for tag, _, _, mine in self.open[k:]:
            self.opened[tag] -= 1
            for b in mine:
                self.blocks[b][3] = len(self.strings)
        del self.open[k:]

    def texts(self) -> list[str]:
        """Texts of the first selector that matches anything, in the order of the elements."""
        first = min((b[0] for b in self.blocks), default=None)
        return [" ".join(s for s, h in zip(self.strings[f:t], self.hidden[f:t], strict=True) if h <= d) for k, d, f, t in self.blocks if k == first]


def extract(html: str | None, base: str | None, selectors: Sequence[str]) -> tuple[list[str], list[str]]:
    """Blocks and absolute links of a page."""
    page = Extractor(automaton(tuple(selectors)))
    page.feed(html or "")
    page.close()
    links = []
    for href in page.hrefs:
        try:
            links.append(urljoin(base or "", href))
        except ValueError:
            continue  # an address that cannot be read
    return page.texts(), links


#: Bytes of pages that a task parses at a time.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about so many bytes of the column, or of one row: what Python makes of them is gone before the next."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64") + 1
    stretch = np.cumsum(size) // most
    starts = [*np.unique(stretch, return_index=True)[1].tolist(), batch.num_rows]
    for first, last in zip(starts, starts[1:]):  # noqa: B905
        yield batch.slice(first, last - first)


def parsed(pages: DataFrame, selectors: Sequence[str] | str) -> DataFrame:
    """The pages' columns but html, with blocks and absolute links as arrays; one pass of Python over the pages, which parses each once.

    selectors: those of all pages, or the name of a column that has each page's own. A page that cannot be parsed gives empty arrays.
    """
    own = isinstance(selectors, str)
    keep = [c for c in pages.columns if c != "html"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)

    def run(batches):
        def one(html, url, these):
            try:
                return extract(html, url, these or ())
            except Exception:  # noqa: BLE001  a page that cannot be parsed has no content
                return [], []

        for b in (piece for batch in batches for piece in pieces(batch, "html")):
            html, url = b.column("html").to_pylist(), b.column("url").to_pylist()
            these = b.column(selectors).to_pylist() if own else [selectors] * len(html)
            both = [one(*x) for x in zip(html, url, these, strict=True)]
            arrays = [pa.array([x[k] for x in both], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *arrays], names=[*keep, "blocks", "links"])

    return pages.select(*keep, "html").mapInArrow(run, schema + ", blocks array<string>, links array<string>")


def blocks(pages: DataFrame, selectors: list[str]) -> DataFrame:
    return parsed(pages, selectors).select(*(c for c in pages.columns if c != "html"), F.posexplode("blocks").alias("block", "text"))


def units(blocks: DataFrame, split: bool = True) -> DataFrame:
    """Normalized sentences of blocks, numbered within the block."""
    clean = t.normalize(F.col("text"))
    array = t.sentences(clean) if split else F.array(clean)
    return blocks.select(*(c for c in blocks.columns if c != "text"), F.posexplode(array).alias("unit", "text"))


def keep(c: Column, min_words: int | Column = rules.MIN_WORDS) -> Column:
    n = t.n_words(c)
    return (n >= min_words) & (n <= rules.MAX_WORDS) & ~t.is_boilerplate(c)


def start_urls(sites: DataFrame) -> DataFrame:
    """name, ordinal and url: a site's own, then those of its pagination."""
    p = F.col("pagination")
    more = F.when(p.isNotNull(), F.transform(F.sequence(F.coalesce(p["start"], F.lit(1)), F.coalesce(p["start"], F.lit(1)) + F.coalesce(p["pages"], F.lit(3)) - 1), lambda n: F.replace(p["template"], F.lit("{n}"), n.cast("string")))).otherwise(F.array().cast("array<string>"))
    more = F.when(p["pages"] <= 0, F.array().cast("array<string>")).otherwise(more)
    return sites.select("name", F.posexplode(F.concat("start_urls", more)).alias("ordinal", "url"))


def discover(links: DataFrame, patterns: list[str], max_pages: int, key: str = "site") -> DataFrame:
    """Links (key, ordinal..., href) that any pattern finds, first of each address, at most max_pages for each key, in order."""
    order = [c for c in links.columns if c not in (key, "href")]
    hit = links.where(F.col("href").rlike(either(patterns)) if patterns else F.lit(False))
    return cap_per(first_per(hit, [key, "href"], order), [key], order, max_pages)


def either(patterns: list[str]) -> str:
    """One pattern that finds what any of several finds."""
    return "|".join(f"(?:{p})" for p in patterns)


SITE_SCHEMA = "name string, domain string, source string, start_urls array<string>, link_patterns array<string>, content_selectors array<string>, max_pages int, split_sentences boolean, verify_ssl boolean, min_words int, max_records int, pagination struct<template: string, start: int, pages: int>"


def site_table(spark, sites=rules.SITES) -> DataFrame:
    return spark.createDataFrame([tuple(s[f.split()[0]] if f.split()[0] != "pagination" else (s["pagination"] and tuple(s["pagination"].values())) for f in SITE_SCHEMA.replace("struct<template: string, start: int, pages: int>", "x").split(", ")) for s in sites], SITE_SCHEMA)


def pick_sites(names=None, max_pages: int | None = None, sites=rules.SITES) -> list[dict]:
    """Sites by name, all if none is named; KeyError for a name that is not there. max_pages replaces that of each."""
    by = {s["name"]: s for s in sites}
    chosen = [by[n] for n in names] if names else list(sites)
    return [s | ({"max_pages": max_pages} if max_pages is not None else {}) for s in chosen]


def usable(spark, names=None, max_pages: int | None = None, sites=rules.SITES) -> tuple[list[dict], list[tuple[str, str]]]:
    """The named sites, or all, that can be collected, and (name, problem) of the others: unknown names, incomplete sites, link patterns that are none."""
    by, good, bad = {s["name"]: s for s in sites}, [], []
    for name in names or by:
        if name not in by:
            bad.append((name, "unknown site"))
            continue
        site = rules.SITE_DEFAULTS | by[name] | ({"max_pages": max_pages} if max_pages is not None else {})
        missing = [k for k in ("domain", "source", "start_urls", "content_selectors") if site.get(k) is None]
        if missing:
            bad.append((name, f"without {', '.join(missing)}"))
            continue
        try:
            for p in site["link_patterns"]:
                spark.range(1).select(F.lit("").rlike(p)).collect()
        except Exception:  # noqa: BLE001  the engine's own patterns decide what is one
            bad.append((name, f"link pattern {p!r} is not understood"))
            continue
        good.append(site)
    return good, bad


#: Where a record comes from, in order: the site's start page, the link's place on it, block and unit of the page.
PLACE = ["_page", "_link", "_block", "_unit"]


def collect(pages: DataFrame, sites: DataFrame, starts: DataFrame | None = None, date: str | None = None, policies: DataFrame | None = None) -> DataFrame:
    """Records of all sites out of one table of fetched pages (url, html), with _site (the site's name) and their PLACE.

    sites: SITE_SCHEMA. starts: (name, ordinal, url), by default the sites' own start addresses and pagination; a site with
    link patterns has its start pages searched for links, one without gives its start pages' contents. Patterns,
    selectors and limits are columns, so the plan does not grow with the sites: pages are scanned
    once for listings and once for contents. Pages that robots rules (policies) or errors kept away give nothing.
    """
    own = sites.select(
        F.col("name").alias("_site"), F.array_join(F.transform("link_patterns", lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|").alias("pattern"), "content_selectors",
        F.coalesce("max_pages", F.lit(rules.SITE_DEFAULTS["max_pages"])).alias("max_pages"), F.coalesce("split_sentences", F.lit(True)).alias("split"), F.coalesce("min_words", F.lit(rules.MIN_WORDS)).alias("min_words"), "max_records", "domain", "source",
    )
    starts = (start_urls(sites) if starts is None else starts).select(F.col("name").alias("_site"), F.col("ordinal").cast("long").alias("_page"), "url")
    fetched = pages.select("url", "html")
    if policies is not None:
        fetched = robots(fetched, policies).where("allowed").drop("allowed")
    begun = starts.join(own.select("_site", "pattern", "max_pages"), "_site")
    listing = parsed(begun.where("pattern <> ''").join(fetched, "url"), ()).select("_site", "pattern", "max_pages", "_page", F.posexplode("links").alias("_link", "href")).where("href rlike pattern").drop("pattern")
    first = first_per(listing, ["_site", "href"], ["_page", "_link"])
    linked = cap_per(first, ["_site"], ["_page", "_link"], F.col("max_pages")).select("_site", "_page", "_link", F.col("href").alias("url"))
    urls = begun.where("pattern = ''").select("_site", "_page", F.lit(-1).alias("_link"), "url").unionByName(linked)
    found = parsed(urls.join(own.drop("pattern", "max_pages"), "_site").join(fetched, "url"), "content_selectors")
    block = t.normalize(F.col("block"))
    unit = found.drop("links", "content_selectors").select("*", F.posexplode("blocks").alias("_block", "block")).drop("blocks")
    unit = unit.select(*(c for c in unit.columns if c != "block"), F.posexplode(F.when(F.col("split"), t.sentences(block)).otherwise(F.array(block))).alias("_unit", "text"))
    kept = t.within(unit, "text", F.col("min_words"))
    out = cap_per(first_per(kept, ["_site", F.lower("text")], PLACE), ["_site"], PLACE, F.col("max_records"))
    meta = t.json_object(type="scraped", tool="html.parser", site=F.col("_site"))
    return out.select("_site", *PLACE, *record(t.alias_domain(F.col("domain")), F.col("text"), source=F.col("source"), date=date, url=F.col("url"), metadata=meta))


def collect_site(pages: DataFrame, site: dict, date: str | None = None) -> DataFrame:
    """Records of one site, see collect."""
    return collect(pages, site_table(pages.sparkSession, [rules.SITE_DEFAULTS | site]), date=date)


def collect_all(pages: DataFrame, names=None, max_pages: int | None = None, date: str | None = None, sites=rules.SITES, policies: DataFrame | None = None) -> DataFrame:
    """Records of the named sites, or all, with _site as the site's place among them. Sites that cannot be collected are warned about and passed over."""
    spark = pages.sparkSession
    good, bad = usable(spark, names, max_pages, sites)
    for name, problem in bad:
        warnings.warn(f"site {name}: {problem}", stacklevel=2)
    at = spark.createDataFrame([(s["name"], k) for k, s in enumerate(good)], "_site string, __at int")
    return collect(pages, site_table(spark, good), date=date, policies=policies).join(at, "_site").withColumn("_site", F.col("__at")).drop("__at")


def outcome(pages: DataFrame, names=None, max_pages: int | None = None, sites=rules.SITES) -> DataFrame:
    """A row for each site asked for: name, start pages that are there, records, and the problem if it has one."""
    spark = pages.sparkSession
    good, bad = usable(spark, names, max_pages, sites)
    table = site_table(spark, good)
    there = start_urls(table).join(pages.select("url").distinct(), "url").groupBy("name").agg(F.count("*").alias("start_pages"))
    records = collect(pages, table).groupBy(F.col("_site").alias("name")).agg(F.count("*").alias("records"))
    told = spark.createDataFrame(bad, "name string, problem string")
    rows = table.select("name").join(there, "name", "left").join(records, "name", "left").select("name", F.coalesce("start_pages", F.lit(0)).alias("start_pages"), F.coalesce("records", F.lit(0)).alias("records"))
    problem = F.when(F.col("start_pages") == 0, "no start page was fetched").when(F.col("records") == 0, "no records")
    return rows.withColumn("problem", problem).unionByName(told.select("name", F.lit(0).cast("long").alias("start_pages"), F.lit(0).cast("long").alias("records"), "problem"))


@lru_cache(maxsize=1024)
def _policy(status: int | None, body: str | None) -> RobotFileParser:
    rp = RobotFileParser()
    if status == 200:
        rp.parse((body or "").splitlines())
    elif status in (401, 403):
        rp.disallow_all = True
    else:
        rp.allow_all = True
    return rp


def allowed(url: str, status: int | None, body: str | None, agent: str = rules.USER_AGENT) -> bool:
    """What an origin's robots.txt says of an address; no answer or one that cannot be read allows."""
    try:
        return _policy(status, body).can_fetch(agent, url)
    except Exception:  # noqa: BLE001  the rules decide: what cannot be judged is allowed
        return True


def robots(urls: DataFrame, policies: DataFrame, agent: str = rules.USER_AGENT) -> DataFrame:
    """urls with a column allowed, by the table of policies (origin, status, body); of several policies of an origin the smallest counts. A body is parsed once in a process."""
    origin = F.regexp_extract("url", r"^([^/:]+://[^/?#]*)", 1)

    @F.pandas_udf("boolean")
    def may(url, status, body):
        import pandas as pd

        return pd.Series([allowed(u, None if s != s or s is None else int(s), b, agent) for u, s, b in zip(url, status, body, strict=True)])

    joined = urls.withColumn("origin", origin).join(first_per(policies.select("origin", "status", "body"), ["origin"], ["status", "body"]), "origin", "left")
    return joined.select(*urls.columns, may("url", "status", "body").alias("allowed"))
