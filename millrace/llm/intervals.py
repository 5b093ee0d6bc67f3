"""Interval overlap join: sales with the click sessions of their client, by the relation of the two intervals.

Clicks become sessions, sessions become slot intervals with a count and a sum, sales
are dealt to shards by range, and every shard gets the intervals of its clients that
can meet its sales. In a shard, intervals stand in nested containment lists: in one
list no interval lies inside another, so starts and ends both ascend, and what meets a
sale is one stretch found by binary search. Prefix sums over a list give what a stretch
adds up to, so no pair is ever laid out.

Rows without a client or a time are ignored, as are lines without a sale. Times may
repeat. A sale_id that stands in several rows has them added up; a null one counts as a
value. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import saved

#: Relation of a sale to a session, by where the sale starts (later, equally, earlier) and ends (earlier, equally, later).
RELATIONS = ["during", "finishes", "overlapped_by", "starts", "equals", "started_by", "overlaps", "finished_by", "contains"]
#: End of an open interval.
FOREVER = 1 << 60
#: Rows for each range partition, where the table is so large that the session's number of partitions gives more.
ROWS = 1_000_000
#: Rows that a task gathers before it searches.
FLUSH = 200_000


def micros(c: Column, kind: str) -> Column:
    """Whole microseconds since 1970, whatever the session's time zone does to times without a zone."""
    if kind == "timestamp":
        return F.unix_micros(c)
    seconds = F.unix_date(c.cast("date")) * F.lit(86_400).cast("long") + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def floor_slot(us: Column, width: int) -> Column:
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))


def _ranges(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def _cutter(gap: int):
    """Sessions of one range partition, in the order of client and time. The first and the last may go on in a neighbour and are marked as edges."""

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(client, first, last, buy, edge):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (client, first, last, buy, edge)], names=["client_id", "first", "last", "bought", "edge"])

        held, lead = None, True
        for b in source:
            if not b.num_rows:
                continue
            client, us = (b.column(k).to_numpy() for k in (0, 1))
            buy = b.column(2).to_numpy(zero_copy_only=False)
            since = us
            if held is not None:  # the unfinished session goes first, as one click at its last time
                client, since, us, buy = (np.concatenate(([x], y)) for x, y in zip(held, (client, us, us, buy), strict=True))
            new = np.flatnonzero((client[1:] != client[:-1]) | (us[1:] - us[:-1] > gap)) + 1
            starts = np.concatenate(([0], new))
            ends = np.concatenate((new, [len(us)])) - 1
            last = us[ends]
            at_last = np.logical_or.reduceat(buy & (us == np.repeat(last, ends - starts + 1)), starts)
            if len(starts) > 1:
                edge = np.zeros(len(starts) - 1, dtype=bool)
                edge[0], lead = lead, False
                yield batch(client[starts[:-1]], since[starts[:-1]], last[:-1], at_last[:-1], edge)
            held = client[starts[-1]], since[starts[-1]], last[-1], at_last[-1]
        if held is not None:
            yield batch(*([x] for x in held), [True])

    return cut


def sessions(clicks: DataFrame, gap: int = 600_000_000) -> DataFrame:
    """client_id, first and last (microseconds) and open of each session: open if a click at its last time is a purchase.

    Clicks are dealt by range of client and time, so a client with many clicks lies in
    many partitions. What a partition cuts inside is final; only its first and last
    session can go on elsewhere, and these, two for each partition, are joined after.
    """
    kind = dict(clicks.dtypes)["ts"]
    known = clicks.where("client_id is not null and ts is not null").select(F.col("client_id").cast("long").alias("client_id"), micros(F.col("ts"), kind).alias("us"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).alias("buy"))
    dealt = known.repartitionByRange(_ranges(known), "client_id", "us").sortWithinPartitions("client_id", "us")
    cut = saved(dealt.mapInArrow(_cutter(gap), "client_id long, first long, last long, bought boolean, edge boolean"), "sessions")
    w = Window.partitionBy("client_id").orderBy("first")
    edges = cut.where("edge").withColumn("new", F.coalesce(F.col("first") - F.lag("last").over(w) > gap, F.lit(True)).cast("int"))
    joined = edges.withColumn("k", F.sum("new").over(w)).groupBy("client_id", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("bought", "last").alias("bought"))
    names = ["client_id", "first", "last", F.col("bought").alias("open")]
    return cut.where("not edge").select(names).unionByName(joined.select(names))


def session_slots(sessions: DataFrame, width: int = 3_600_000_000) -> DataFrame:
    """client_id, s, e, n, crc: the slot intervals of sessions, equal ones as one with their number and the sum of their checksums."""
    e = F.when(F.col("open"), F.lit(FOREVER)).otherwise(floor_slot(F.col("last"), width))
    crc = F.crc32(F.col("first").cast("string").cast("binary"))
    return sessions.select("client_id", floor_slot(F.col("first"), width).alias("s"), e.alias("e"), crc.alias("crc")).groupBy("client_id", "s", "e").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))


def sale_slots(sales: DataFrame, lines: DataFrame, width: int = 3_600_000_000) -> DataFrame:
    """sale_id, client_id, s and e of each sale: from its time to the last of it and its lines' shipping; without end if a line is not shipped."""
    sold, shipped = dict(sales.dtypes)["sold_at"], dict(lines.dtypes)["shipped_at"]
    sent = lines.where("sale_id is not null").groupBy("sale_id").agg(F.max(micros(F.col("shipped_at"), shipped)).alias("sent"), F.max(F.col("shipped_at").isNull()).alias("unsent"))
    known = sales.where("client_id is not null and sold_at is not null").select("sale_id", F.col("client_id").cast("long").alias("client_id"), micros(F.col("sold_at"), sold).alias("us"))
    e = F.when(F.col("unsent"), F.lit(FOREVER)).otherwise(floor_slot(F.greatest("us", F.coalesce("sent", "us")), width))
    return known.join(sent.hint("merge"), "sale_id", "left").select(F.col("sale_id").cast("long").alias("sale_id"), "client_id", floor_slot(F.col("us"), width).alias("s"), e.alias("e"))


def bisect(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, right: bool = False) -> np.ndarray:
    """In each ascending stretch values[lo:hi], the first place whose value is not below x (right: is above x)."""
    lo, hi = lo.copy(), hi.copy()
    while (busy := lo < hi).any():
        mid = (lo + hi) >> 1
        v = values[np.where(busy, mid, 0)]
        up = busy & ((v <= x) if right else (v < x))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(busy & ~up, mid, hi)
    return lo


class Lists:
    """Nested containment lists of the closed intervals of several owners, and for each owner the list of its open ones.

    Open intervals all reach without end: each lies around all that start later, so that nested one in
    another they would make a chain as long as their number. They stand side by side in the outer list of
    their owner instead, where starts ascend and ends are equal, and the closed ones are the list below it.
    """

    def __init__(self, owner: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray, crc: np.ndarray, owners: int):
        is_open = e >= FOREVER
        o = np.flatnonzero(is_open)
        o = o[np.lexsort((s[o], owner[o]))]
        self.outer = _Flat(s[o], e[o], n[o], crc[o])
        self.outer_at = np.searchsorted(owner[o], np.arange(owners + 1))
        c = np.flatnonzero(~is_open)
        c = c[np.lexsort((-e[c], s[c], owner[c]))]
        up = _parents(owner[c].tolist(), s[c].tolist(), e[c].tolist())
        # lists one after the other: those of owners first, then those below each interval; inside a list the order of starts stays
        at = np.argsort(np.where(up < 0, owner[c], owners + up), kind="stable")
        self.inner = _Flat(s[c][at], e[c][at], n[c][at], crc[c][at])
        name = np.where(up < 0, owner[c], owners + up)[at]
        self.inner_at = np.searchsorted(name, np.arange(owners + 1))
        # the list below each interval, by its place
        self.kids_from = np.searchsorted(name, owners + at)
        self.kids_to = np.searchsorted(name, owners + at, side="right")
        parents = np.flatnonzero(self.kids_from < self.kids_to)
        self.parents = parents
        self.deep = _Flat.sums(self.inner.raw + self._below(at, up))

    def _below(self, at: np.ndarray, up: np.ndarray) -> np.ndarray:
        """What lies below each interval, added up, by its place."""
        place = np.empty(len(at), dtype=np.int64)
        place[at] = np.arange(len(at))
        own = self.inner.raw[:, place].T.tolist()
        below = np.zeros((len(at), 4), dtype=np.int64).tolist()
        above = up.tolist()
        for k in range(len(above) - 1, -1, -1):  # an interval comes after the one around it
            p = above[k]
            if p >= 0:
                mine, theirs, it = below[k], own[k], below[p]
                for x in range(4):
                    it[x] += mine[x] + theirs[x]
        return np.array(below, dtype=np.int64).reshape(-1, 4)[at].T

    def search(self, owner: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """For each sale and relation the number of sessions, their shared slots and checksums added up: an array (3, sales, 9)."""
        out = np.zeros((3, len(s), 9), dtype=np.int64)
        who = np.arange(len(s))
        self.outer.meet(who, self.outer_at[owner], self.outer_at[owner + 1], s, e, out)
        lo, hi = self.inner_at[owner], self.inner_at[owner + 1]
        while len(who):
            left, right = self.inner.meet(who, lo, hi, s[who], e[who], out, self.deep)
            # what lies inside the sale has been counted with all below it; the others that meet it are entered
            a, d, b, c = left[0], left[1], right[0], right[1]
            first = np.searchsorted(self.parents, np.concatenate((a, np.maximum(d, b))))
            count = np.maximum(np.searchsorted(self.parents, np.concatenate((np.minimum(d, c), c))) - first, 0)
            total = int(count.sum())
            into = self.parents[np.repeat(first, count) + np.arange(total) - np.repeat(np.cumsum(count) - count, count)]
            who = np.repeat(np.concatenate((who, who)), count)
            lo, hi = self.kids_from[into], self.kids_to[into]
        return out


class _Flat:
    """Lists laid one after the other, with prefix sums of numbers, starts, ends and checksums."""

    def __init__(self, s, e, n, crc):
        self.s, self.e = s, e
        self.raw = np.stack((n, n * s, np.where(e < FOREVER, n * e, 0), crc)) if len(s) else np.zeros((4, 0), dtype=np.int64)
        self.own = self.sums(self.raw)

    @staticmethod
    def sums(raw: np.ndarray) -> np.ndarray:
        return np.concatenate((np.zeros((4, 1), dtype=np.int64), np.cumsum(raw, axis=1)), axis=1)

    def meet(self, who, lo, hi, s, e, out, deep=None):
        """Add to out what the sales `who` meet in values[lo:hi] of each. deep: sums with all below, for what lies inside a sale.

        Returns ((first met, first that starts later than the sale), (first that does not end before the sale ends, end of those met))."""
        a = bisect(self.e, lo, hi, s)  # ends ascend: the first that is not over
        z = np.maximum(bisect(self.s, lo, hi, e, right=True), a)
        start = [a, bisect(self.s, a, z, s), bisect(self.s, a, z, s, right=True), z]
        end = [a, bisect(self.e, a, z, e), bisect(self.e, a, z, e, right=True), z]
        for x in range(3):  # the sale starts later, equally, earlier
            for y in range(3):  # the session ends earlier, equally, later
                f, t = np.maximum(start[x], end[y]), np.minimum(start[x + 1], end[y + 1])
                hit = np.flatnonzero(f < t)
                if not len(hit):
                    continue
                f, t, mine = f[hit], t[hit], who[hit]
                sums = deep if deep is not None and (x, y) == (2, 0) else self.own
                n, ss, ee, crc = sums[:, t] - sums[:, f]
                shared = (ee if y < 2 else n * e[hit]) - (n * s[hit] if x == 0 else ss) + n
                k = 3 * x + 2 - y
                for row, add in enumerate((n, shared, crc)):
                    np.add.at(out[row, :, k], mine, add)
        return (a, start[2]), (end[1], z)


def _parents(owner: list[int], s: list[int], e: list[int]) -> np.ndarray:
    """For intervals by owner, start and falling end: the innermost earlier one that contains each and is not equal to it, or -1."""
    up, stack, mine = [], [], None
    for k, (o, a, b) in enumerate(zip(owner, s, e, strict=True)):
        if o != mine:
            stack, mine = [], o
        while stack and not (e[stack[-1]] > b or e[stack[-1]] == b and s[stack[-1]] < a):
            stack.pop()
        up.append(stack[-1] if stack else -1)
        stack.append(k)
    return np.array(up, dtype=np.int64)


OUT = "sale_id long, relation string, n_pairs long, overlap_slots long, sessions_crc long"


def _found(rows: list[np.ndarray], ids: pa.Array) -> pa.RecordBatch:
    """rows: shard, client, kind, s, e, n, crc of what was gathered, in order. ids: the sales' ids."""
    shard, client, kind, s, e, n, crc = rows
    new = np.concatenate(([0], (shard[1:] != shard[:-1]) | (client[1:] != client[:-1]))).cumsum()
    is_sale = kind == 1
    held = ~is_sale
    lists = Lists(new[held], s[held], e[held], n[held], crc[held], int(new[-1]) + 1)
    end = e[is_sale]
    found = lists.search(new[is_sale], s[is_sale], end)
    row, relation = np.nonzero(found[0])
    both_open = (end[row] >= FOREVER) & (relation % 3 == 1)
    n, shared, crc = (found[k][row, relation] for k in range(3))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(RELATIONS).take(pa.array(relation)), pa.array(n), pa.array(shared, mask=both_open), pa.array(crc)], names=["sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc"])


def _search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, client and kind, sessions (0) before sales (1). Once enough are gathered the sales are searched and go; of the sessions only those of the last client stay."""

    def done(batches):
        ids = pa.concat_arrays([b.column(7) for b in batches])
        rows = [np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(7)]
        sales = np.flatnonzero(rows[2] == 1)
        out = _found(rows, ids.take(pa.array(sales))) if len(sales) else None
        last = np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == 0))
        kept = pa.RecordBatch.from_arrays([*(pa.array(x[last]) for x in rows), ids.take(pa.array(last))], names=batches[0].schema.names)
        return out, kept

    held, n = [], 0
    for b in source:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n > FLUSH:
            out, kept = done(held)
            held, n = [kept] if kept.num_rows else [], 0
            if out is not None:
                yield out
    if held and n:
        out, _ = done(held)
        if out is not None:
            yield out


def related(sales: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sales (sale_id, client_id, s, e) against slot intervals (client_id, s, e, n, crc): one row for each sale and relation.

    Sales are dealt by range of client, start and id, so that a client with many lies in many shards; a
    shard's sessions are those of its clients that start before its last sale ends and end after its first begins.
    """
    spark = sales.sparkSession
    sales = saved(sales, "sales")
    parts = _ranges(sales)
    dealt = saved(sales.repartitionByRange(parts, "client_id", "s", "sale_id").withColumn("shard", F.spark_partition_id()), "dealt")
    reach = dealt.groupBy("shard", "client_id").agg(F.min("s").alias("from_s"), F.max("e").alias("to_e"))
    lists = sessions.join(reach.hint("merge"), "client_id").where("s <= to_e and e >= from_s")
    names = ["shard", F.col("client_id"), "kind", "s", "e", "n", "crc", "sale_id"]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    both = lists.withColumns({"kind": F.lit(0), "sale_id": none}).select(names).unionByName(dealt.withColumns({"kind": F.lit(1), "n": zero, "crc": zero}).select(names))
    near = both.repartition(parts, "shard", "client_id").sortWithinPartitions("shard", "client_id", "kind")
    found = near.mapInArrow(_search, OUT)
    return found.groupBy("sale_id", "relation").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("overlap_slots").alias("overlap_slots"), F.sum("sessions_crc").alias("sessions_crc"))


def join(sales: DataFrame, lines: DataFrame, clicks: DataFrame, gap: int = 600_000_000, width: int = 3_600_000_000) -> DataFrame:
    """sale_id, relation, n_pairs, overlap_slots and sessions_crc: how sales lie to their clients' sessions, in slots of `width` microseconds."""
    return related(sale_slots(sales, lines, width), session_slots(sessions(clicks, gap), width))
