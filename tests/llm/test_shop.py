"""Interval overlap join: lists against all pairs, sessions across partitions, odd rows."""

import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import intervals

INF = intervals.FOREVER


def relation(s, e, a, b):
    start = 0 if s > a else 1 if s == a else 2
    end = 0 if e < b else 1 if e == b else 2
    return 3 * start + end


@pytest.mark.parametrize("seed", range(30))
def test_lists_give_what_all_pairs_give(seed):
    r = np.random.default_rng(seed)
    n, m, owners, span = r.integers(0, 80), 60, 4, int(r.integers(3, 40))

    def some(k, share):
        s = r.integers(0, span, k)
        e = s + r.integers(0, span // 2 + 1, k)
        return r.integers(0, owners, k), s, np.where(r.random(k) < share, INF, e)

    o, s, e = some(n, 0.2)
    count, crc = r.integers(1, 5, n), r.integers(0, 1 << 32, n)
    oq, sq, eq = some(m, 0.2)
    got = intervals.Lists(o, s, e, count, crc, owners).search(oq, sq, eq)
    want = np.zeros_like(got)
    for q in range(m):
        for k in range(n):
            if o[k] == oq[q] and s[k] <= eq[q] and sq[q] <= e[k]:
                x = relation(sq[q], eq[q], s[k], e[k])
                want[0, q, x] += count[k]
                want[2, q, x] += crc[k]
                if min(e[k], eq[q]) < INF:
                    want[1, q, x] += count[k] * (min(e[k], eq[q]) - max(s[k], sq[q]) + 1)
    equal_ends = np.arange(9) % 3 == 1
    assert (got[0] == want[0]).all() and (got[2] == want[2]).all()
    closed = (eq < INF)[:, None] | ~equal_ends
    assert (got[1][closed] == want[1][closed]).all()


def test_lists_hold_no_interval_inside_another():
    r = np.random.default_rng(5)
    s = r.integers(0, 50, 300)
    e = s + r.integers(0, 30, 300)
    lists = intervals.Lists(np.zeros(300, dtype=np.int64), s, e, np.ones(300, dtype=np.int64), np.ones(300, dtype=np.int64), 1)
    spans = [(0, lists.inner_at[1]), *zip(lists.kids_from, lists.kids_to, strict=True)]
    assert sum(hi - lo for lo, hi in spans) == 300 and len(lists.parents) > 20
    for lo, hi in spans:
        assert (np.diff(lists.inner.s[lo:hi]) >= 0).all() and (np.diff(lists.inner.e[lo:hi]) >= 0).all()
    for k in lists.parents:
        lo, hi = lists.kids_from[k], lists.kids_to[k]
        assert (lists.inner.s[lo:hi] >= lists.inner.s[k]).all() and (lists.inner.e[lo:hi] <= lists.inner.e[k]).all()


CLICKS = "ts timestamp_ntz, client_id long, kind string, x int"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, x int"
LINES = "sale_id long, shipped_at timestamp_ntz, x int"
T = datetime(2024, 3, 31)


def brute(sales, lines, clicks):
    """Every pair, row by row."""
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    slot = lambda t: us(t) // 3_600_000_000
    sessions = []
    for c in sorted({c for _, c, _, _ in clicks if c is not None}):
        run = []
        for t in [*sorted(t for t, o, _, _ in clicks if o == c and t is not None), None]:
            if run and (t is None or t - run[-1] > timedelta(minutes=10)):
                bought = any(k == "purchase" for x, o, k, _ in clicks if o == c and x == run[-1])
                sessions.append((c, slot(run[0]), INF if bought else slot(run[-1]), zlib.crc32(str(us(run[0])).encode())))
                run = []
            run.append(t)
    out = Counter()
    for sale, c, sold, _ in sales:
        if c is None or sold is None:
            continue
        mine = [x for s, x, _ in lines if s == sale and s is not None]
        s, e = slot(sold), INF if None in mine else slot(max([sold, *mine]))
        for o, a, b, crc in sessions:
            if o == c and s <= b and a <= e:
                k = sale, intervals.RELATIONS[relation(s, e, a, b)]
                out[k, 0] += 1
                out[k, 2] += crc
                out[k, 1] = None if min(e, b) == INF else out[k, 1] + min(e, b) - max(s, a) + 1
    return {k: tuple(out[k, x] for x in range(3)) for k, _ in out}


def made(seed, clients=4, n=300):
    r = np.random.default_rng(seed)
    at = lambda hours: T + timedelta(microseconds=int(r.integers(0, hours * 3_600_000_000)))
    maybe = lambda x, p=0.05: None if r.random() < p else x
    client = lambda: 0 if r.random() < 0.4 else int(r.integers(0, clients))
    clicks = [(maybe(at(60)), maybe(client()), maybe(str(r.choice(["view", "click", "purchase"]))), 1) for _ in range(n)]
    clicks += clicks[:20] + [(t, c, "purchase", 1) for t, c, _, _ in clicks[20:30]]
    sales = [(k, maybe(client()), maybe(at(70)), 1) for k in range(80)] + [(None, 1, T, 1), (None, 0, T + timedelta(hours=3), 1)]
    lines = [(maybe(int(r.integers(0, 90))), maybe(at(90), 0.2), 1) for _ in range(120)]
    return sales, lines, clicks


def joined(spark, sales, lines, clicks):
    df = intervals.join(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), spark.createDataFrame(clicks, CLICKS))
    return {(r.sale_id, r.relation): (r.n_pairs, r.overlap_slots, r.sessions_crc) for r in df.collect()}


def test_join_gives_what_all_pairs_give(spark, monkeypatch):
    tables = made(3)
    monkeypatch.setattr(intervals, "ROWS", 40)  # many range partitions: sessions are cut and joined again
    got, want = joined(spark, *tables), brute(*tables)
    assert got == want and len(want) > 100


def test_rounds_of_a_task():
    """Rows gathered in small rounds give the same as in one."""
    r = np.random.default_rng(0)
    rows = []
    for shard, client, m, q in ((0, 1, 40, 50), (0, 2, 0, 5), (1, 1, 30, 30), (1, 3, 9, 0)):
        for kind, k in ((0, m), (1, q)):
            for _ in range(k):
                s = int(r.integers(0, 30))
                rows.append((shard, client, kind, s, INF if r.random() < 0.2 else s + int(r.integers(0, 9)), 1 - kind, (1 - kind) * 7, len(rows) if kind else None))
    names = ["shard", "client_id", "kind", "s", "e", "n", "crc", "sale_id"]
    cut = lambda size: [pa.RecordBatch.from_pydict({x: pa.array([row[k] for row in rows[i : i + size]], pa.int64()) for k, x in enumerate(names)}) for i in range(0, len(rows), size)]
    whole = [tuple(x.values()) for b in intervals._search(iter(cut(10_000))) for x in b.to_pylist()]
    before, intervals.FLUSH = intervals.FLUSH, 11
    try:
        small = [tuple(x.values()) for b in intervals._search(iter(cut(4))) for x in b.to_pylist()]
    finally:
        intervals.FLUSH = before
    assert sorted(whole, key=str) == sorted(small, key=str) and len(whole) > 100


def test_empty_tables_and_names_that_clash(spark):
    sales, lines, clicks = made(4)
    assert joined(spark, [], lines, clicks) == {} and joined(spark, sales, lines, []) == {}
    some = joined(spark, sales, [], clicks)
    assert some == brute(sales, [], clicks) and not any(v[1] is None for k, v in some.items() if k[1] == "during")
    frame = spark.createDataFrame(sales, SALES).withColumnsRenamed({"x": "shard"})
    other = spark.createDataFrame(clicks, CLICKS).withColumnsRenamed({"x": "edge"})
    n = intervals.join(frame, spark.createDataFrame(lines, LINES).withColumnRenamed("x", "sent"), other).count()
    assert n == len(brute(sales, lines, clicks))


def test_time_zone_of_the_session_does_not_count(spark):
    sales, lines, clicks = made(6, n=80)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert joined(spark, sales, lines, clicks) == brute(sales, lines, clicks)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
