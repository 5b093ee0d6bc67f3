"""Fetching of pages: addresses are dealt by origin, so that an origin's pages are fetched one after the other with a pause between."""

from __future__ import annotations

import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.sources import html

#: What a fetcher gives for an address: status and body.
Fetcher = Callable[[str], tuple[int, str | None]]
PAGES = "url string, status int, html string, problem string"
ORIGIN = r"^([^/:]+://[^/?#]*)"


def web(timeout: float = 30, agent: str = rules.USER_AGENT, verify: bool = True) -> Fetcher:
    """A fetcher over the network."""

    def fetch(url: str) -> tuple[int, str | None]:
        context = None if verify else ssl._create_unverified_context()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout, context=context) as answer:
                body = answer.read()
                return answer.status, body.decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, None

    return fetch


def pages(urls: DataFrame, fetch: Fetcher, delay: float = 2.0, origins: int | None = None, policies: DataFrame | None = None) -> DataFrame:
    """A row of PAGES for each row of urls (url): html where the answer is a good one, else the problem, and nothing else fails for it.

    All addresses of an origin are in one partition, in order, and `delay` seconds lie between two of its requests: that
    an origin is served by one task is the point. origins: partitions, by default as many as the
    session has. policies: robots rules, see html.robots; what they forbid is not asked for. Rows are written by the caller before they are used
    twice, as they would be fetched twice.
    """
    if policies is None:
        asked = urls.select("url", F.lit(True).alias("allowed"))
    else:
        asked = html.robots(urls.select("url"), policies)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}

        def one(url: str | None, origin: str, allowed: bool):
            if url is None:
                return None, None, None, "no address"
            if not allowed:
                return url, None, None, "robots rules forbid it"
            pause = last.get(origin, 0) + delay - time.monotonic() if origin in last else 0
            if pause > 0:
                time.sleep(pause)
            try:
                status, body = fetch(url)
            except Exception as e:  # noqa: BLE001  a page that cannot be fetched is a row, whatever the reason
                return url, None, None, f"{type(e).__name__}: {e}"
            finally:
                last.clear()  # one origin after the other: only the present one's time is kept
                last[origin] = time.monotonic()
            good = 200 <= status < 300
            return url, status, body if good else None, None if good else f"status {status}"

        for b in source:
            for lo in range(0, b.num_rows, 64):  # pages are given on in small batches
                part = b.slice(lo, 64)
                rows = [one(*x) for x in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["url", "status", "html", "problem"])

    named = asked.select("url", F.coalesce(F.regexp_extract("url", ORIGIN, 1), F.lit("")).alias("origin"), "allowed")
    dealt = named.repartition(origins, "origin") if origins else named.repartition("origin")
    return dealt.sortWithinPartitions("origin", "url").mapInArrow(run, PAGES)
