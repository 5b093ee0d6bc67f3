"""Pages: one pass over the parser's events gives what a tree of elements gives; all sites in one plan."""

import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.sources import html
from millrace.sources.html import ENDS_P, VOID


class Element:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def strings(self):
        """Descendant strings in document order; no recursion, for deep markup."""
        stack = [iter(self.parts)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    yield x
                elif x.tag not in ("script", "style", "template"):
                    stack.append(iter(x.parts))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        return " ".join(s for x in self.strings() if (s := x.strip()))


class Tree(HTMLParser):
    """A document's elements in order. Paragraphs and list items end where the next one begins."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.all: list[Element] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end("p", stop=("td", "th", "button"))
        elif tag == "li":
            self._end("li", stop=("ul", "ol"))
        e = Element(tag, dict(attrs), self.at)
        self.at.parts.append(e)
        self.all.append(e)
        if tag not in VOID:
            self.at = e

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        self.at.parts.append(data)

    def _end(self, tag, stop=()):
        e = self.at
        while e.parent and e.tag != tag:
            if e.tag in stop:
                return
            e = e.parent
        if e.parent:
            self.at = e.parent


def _matcher(selector: str):
    """Tag, .class and tag.class steps, descendants, comma lists; ValueError for anything else."""
    lists = []
    for one in selector.split(","):
        steps = []
        for part in one.split():
            m = re.fullmatch(r"([a-zA-Z][\w-]*|\*)?((?:\.[\w-]+)*)", part)
            if not m or not part:
                raise ValueError(f"selector {part!r} is not understood")
            steps.append((None if m[1] in (None, "*") else m[1].lower(), set(filter(None, m[2].split(".")))))
        if not steps:
            raise ValueError("empty selector")
        lists.append(steps)

    def fits(e, step):
        return (step[0] is None or e.tag == step[0]) and step[1] <= set((e.attrs.get("class") or "").split())

    def matches(e):
        for steps in lists:
            if not fits(e, steps[-1]):
                continue
            up, k = e.parent, len(steps) - 2
            while up is not None and k >= 0:
                k -= fits(up, steps[k])
                up = up.parent
            if k < 0:
                return True
        return False

    return matches


def tree_blocks(html: str | None, selectors: list[str]) -> list[str]:
    """Texts of the first selector that matches anything; "p" comes last by itself."""
    tree = Tree(html or "")
    for s in [*selectors, *([] if "p" in selectors else ["p"])]:
        try:
            matches = _matcher(s)
        except ValueError:
            continue
        found = [e for e in tree.all if matches(e)]
        if found:
            return [e.text() for e in found]
    return []


def tree_links(html: str | None, base: str | None) -> list[str]:
    out = []
    for e in Tree(html or "").all:
        if e.tag == "a" and e.attrs.get("href") is not None:
            try:
                out.append(urljoin(base or "", e.attrs["href"]))
            except ValueError:
                continue  # an address that cannot be read
    return out


TAGS = "div p p p ul li li article section table td span b a br img script style template h1 button form".split()
SELECTORS = ["article p", "div.x", ".y p.x", "li", "*", "div div div", "section .x, ul li, td", "script", "template", "!bad", "", "p", "body > p", "article.x .y span", ".z", "b", "a.y"]


def markup(r: random.Random) -> str:
    """Tags opened, closed, crossed and left open at random."""
    out, names = [], []
    for _ in range(r.randint(0, 60)):
        x = r.random()
        if x < 0.4:
            tag = r.choice(TAGS)
            attrs = "".join(f' {a}="{v}"' for a, v in (("class", " ".join(r.sample("xyzw", r.randint(0, 3)))), ("href", r.choice(["/a", "b?c", "http://h/i", "#", "http://[bad"]))) if r.random() < 0.6)
            out.append(f"<{tag}{attrs}{'/' if r.random() < 0.1 else ''}>")
            names.append(tag)
        elif x < 0.6 and names:
            out.append(f"</{r.choice(names) if r.random() < 0.4 else names.pop()}>")
        else:
            out.append(r.choice(["word ", " two words ", "&amp;", "\n", "&nbsp;x", "<!-- c -->", "<", "é", "&copy;"]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_one_pass_gives_what_the_tree_gives(seed):
    r = random.Random(seed)
    some = 0
    for _ in range(60):
        text, these = markup(r), r.sample(SELECTORS, r.randint(0, 4))
        blocks, links = html.extract(text, "http://x/y/", these)
        assert blocks == tree_blocks(text, these) and links == tree_links(text, "http://x/y/")
        some += len(blocks)
    assert some > 50


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 20_000 + "<p>down here</p>"
    rows = [(1, "http://x/", deep), (2, None, None), (3, "http://x/", ""), (4, "http://x/", "<p"), (5, "http://x/", "<p>a<b>c</b>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.blocks for r in html.parsed(pages, ["article p"]).collect()}
    assert got == {1: ["down here"], 2: [], 3: [], 4: [], 5: ["a c"]}
    own = pages.withColumn("these", F.when(F.col("page_id") == 5, F.array(F.lit("b"))))
    assert {r.page_id: r.blocks for r in html.parsed(own, "these").collect()}[5] == ["c"]


def site(name, **more):
    return {"name": name, "domain": "Health", "source": name.upper(), "start_urls": [f"http://{name}/"], "content_selectors": ["article p"]} | more


def sentence(k, name):
    return f"Sentence number {k} of the site {name}."


@pytest.fixture(scope="module")
def world(spark):
    """Four sites: with links, with pagination, with a limit on records, with nothing fetched."""
    listing = "".join(f'<a href="/{kind}/{k}">x</a>' for k in range(6) for kind in ("a", "b", "a"))
    rows = [("http://one/", listing)]
    rows += [(f"http://one/a/{k}", f"<article><p>{sentence(k, 'one')} {sentence(0, 'one')}</article>") for k in range(6)]
    rows += [("http://two/", "<p>" + sentence(0, "two")), *((f"http://two/p{k}", f"<article><p>{sentence(k, 'two')}</article><p>not this text at all here") for k in (1, 2, 3))]
    rows += [("http://three/", "<article>" + "".join(f"<p>{sentence(k, 'three')}</p>" for k in range(9)) + "</article>")]
    sites = [
        site("one", link_patterns=["/a/", "nothing"], max_pages=3), site("two", pagination={"template": "http://two/p{n}", "start": 1, "pages": 2}),
        site("three", domain="Road Safety", max_records=4, split_sentences=False), site("gone"), site("bad", link_patterns=["(unclosed"]), {"name": "half", "domain": "Health"},
    ]
    return spark.createDataFrame(rows, "url string, html string"), sites


def test_all_sites_in_one_plan(spark, world):
    pages, sites = world
    with pytest.warns(UserWarning) as told:
        df = html.collect_all(pages, ["one", "two", "three", "gone", "bad", "half", "who?"], date="2024-01-01", sites=sites)
    assert {str(w.message).split(":")[0] for w in told if str(w.message).startswith("site ")} == {"site bad", "site half", "site who?"}
    got = [(r._site, r.English, r.Domain) for r in df.orderBy("_site", *html.PLACE).collect()]
    want = [(0, sentence(k, "one"), "Health") for k in range(3)] + [(1, sentence(k, "two"), "Health") for k in range(3)] + [(2, sentence(k, "three"), "Security") for k in range(4)]
    assert got == want
    alone = html.collect_site(pages, sites[1], "2024-01-01")
    assert alone.drop("_site").orderBy(*html.PLACE).collect() == df.where("_site = 1").drop("_site").orderBy(*html.PLACE).collect()


def test_pages_are_read_once_for_listings_and_once_for_contents(spark, world, tmp_path):
    pages, sites = world
    pages.write.parquet(str(tmp_path / "pages"))
    df = html.collect(spark.read.parquet(str(tmp_path / "pages")), html.site_table(spark, [rules.SITE_DEFAULTS | s for s in sites[:4]]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_outcome_of_each_site(spark, world):
    pages, sites = world
    rows = {r.name: (r.start_pages, r.records, r.problem) for r in html.outcome(pages, sites=sites).collect()}
    assert rows == {
        "one": (1, 3, None), "two": (3, 3, None), "three": (1, 4, None), "gone": (0, 0, "no start page was fetched"),
        "bad": (0, 0, "link pattern '(unclosed' is not understood"), "half": (0, 0, "without source, start_urls, content_selectors"),
    }


def test_robots_keep_pages_away(spark, world):
    pages, sites = world
    policies = spark.createDataFrame([("http://one", 200, "User-agent: *\nDisallow: /a/1"), ("http://three", 403, None), ("http://two", 404, "")], "origin string, status int, body string")
    df = html.collect(pages, html.site_table(spark, [rules.SITE_DEFAULTS | s for s in sites[:3]]), policies=policies)
    assert {(r._site, r.English) for r in df.collect()} == {("one", sentence(0, "one")), ("one", sentence(2, "one")), *(("two", sentence(k, "two")) for k in range(3))}


def test_a_link_counts_where_it_stands_first(spark):
    """Two start pages with the same links: pages come in the order of first sight, whatever the number of links."""
    rows = [(f"http://s/{k}", "".join(f'<a href="/a/{j}">x</a>' for j in (range(3, 0, -1) if k else (5, 1)))) for k in (0, 1)]
    rows += [(f"http://s/a/{j}", f"<article><p>{sentence(j, 's')}</article>") for j in range(9)]
    one = site("s", start_urls=["http://s/0", "http://s/1"], link_patterns=["/a/"])
    got = html.collect_site(spark.createDataFrame(rows, "url string, html string"), one).orderBy(*html.PLACE).collect()
    assert [r.English for r in got] == [sentence(j, "s") for j in (5, 1, 3, 2)]
