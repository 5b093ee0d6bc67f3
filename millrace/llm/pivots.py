"""Near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the distinct vectors, thinned so
that a dense group has one, and numbered from the rarest to the most frequent among the
nearest of the sample. Each vector is described by its nearest pivots, in order. How many, and how many of
them candidates must share, is taken from LADDER: other vectors of the sample get partners whose cosine is just the bound and
that differ from them as the sample's vectors do from one another, and the first rung that makes enough of these
pairs candidates is used. Two kinds of inverted lists hold the vectors:

* the list of a pivot has the vectors that are close to it, so close that they include
  every vector which may link with a core one, a vector at `CORE` or more from that pivot.
  Members of a dense group meet there; their cosines are computed in blocks.
* other vectors stand in lists of pairs of pivots. To share s of their p
  nearest pivots two vectors must share the two rarest of these, which are then among
  the first p - s + 2 of each: so many pivots make a vector's pairs. A list has ids
  and descriptions alone. Shared pivots are counted there, and only pairs with
  s or more, once each, get their vectors fetched and their cosine computed.

With the number of pivots following the square root of the number of vectors, a list of
pairs has a few vectors however many there are. Equal vectors are one class from
the start. A long list of either kind is dealt to blocks, and each pair of blocks is a task of its own; a
task of close vectors gives one row for each class with the number of vectors linked and
one neighbour, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, saved

#: Pivots of a description and how many of them candidates share, cheapest first; the first that finds so large a part of pairs at the bound is taken.
LADDER = ((12, 5), (16, 6), (24, 8), (24, 6))
AIM = 0.97
#: Vectors of the sample that are no pivots and have a partner made for each, to measure that part.
CHECKED = 1000
#: Vectors of a block of a pivot's list, of a block of a long list of a pair, and entries of a task of short ones.
BLOCK, LONG, TASK = 1024, 4096, 200_000
#: Bounds on the number of pivots, which in between follows the square root of the number of vectors.
PIVOTS = (32, 65_536)
COSINE = 0.95
#: Cosine that no two pivots reach, and cosine to a pivot from which a vector is its core.
APART, CORE = 0.85, 0.9


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors with the digest of their content (null if not comparable), and the distinct ones: rep, n, embedding."""
    e = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    v = vectors.select("vec_id", F.when(sound, F.col("embedding")).alias("embedding"))
    own = F.col("embedding").cast("array<double>")
    v = v.select("vec_id", "embedding", F.when(F.col("embedding").isNotNull(), F.xxhash64(own)).alias("h1"), F.when(F.col("embedding").isNotNull(), F.hash(own)).alias("h2"))
    distinct = v.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    return v, distinct


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, pivots: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivots of each row, nearest first, and their cosines."""
    cos = x @ pivots.T
    k = min(prefix, cos.shape[1])
    top = np.argpartition(-cos, k - 1, 1)[:, :k]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, 1), 1, "stable"), 1)
    return top, np.take_along_axis(cos, top, 1)


def choose(distinct: DataFrame, bounds: tuple[int, int] = PIVOTS, cosine: float = COSINE, rung: tuple[int, int] | None = None) -> tuple[dict[int, np.ndarray], int, int]:
    """Pivots for each number of dimensions, those that are rarely among the nearest first, and the rung of the ladder, unless it is given."""
    n = distinct.count()
    most = int(min(bounds[1], max(bounds[0], 1.5 * n**0.5)))
    rows = distinct.orderBy(F.xxhash64("rep", F.lit(7)), "rep").limit(most + CHECKED).select("embedding").collect()
    by: dict[int, list] = {}
    for k, r in enumerate(rows):
        by.setdefault(len(r.embedding), ([], []))[k >= most].append(r.embedding)
    pivots = {d: thin(unit(found)) for d, (found, _) in by.items() if found}
    steps = [rung or settled(pivots[d], unit(others), cosine) for d, (_, others) in by.items() if d in pivots and others]
    prefix, shared = max(steps, key=lambda x: LADDER.index(x) if x in LADDER else -1, default=rung or LADDER[0])
    out = {}
    for d, p in pivots.items():
        x = unit(by[d][0])
        often = sum(np.bincount(nearest(x[k : k + 1024], p, prefix)[0].ravel(), minlength=len(p)) for k in range(0, len(x), 1024))
        out[d] = p[np.argsort(often, kind="stable")]
    return out, prefix, shared


def partners(x: np.ndarray, cosine: float) -> np.ndarray:
    """A vector at the cosine from each, off in the direction in which two others differ."""
    off = np.roll(x, 1, 0) - np.roll(x, 2, 0) if len(x) > 2 else np.zeros_like(x)
    off -= (off * x).sum(1, keepdims=True) * x
    length = np.linalg.norm(off, axis=1, keepdims=True)
    return cosine * x + (1 - cosine**2) ** 0.5 * np.divide(off, length, out=np.zeros_like(off), where=length > 1e-6)


def settled(pivots: np.ndarray, x: np.ndarray, cosine: float) -> tuple[int, int]:
    """The first rung under which enough of the vectors and their partners are candidates. Those close to a pivot do not count: they meet in its list."""
    x = x[(x @ pivots.T).max(1) < CORE]
    if not len(x):
        return LADDER[0]
    y = partners(x, cosine)
    for prefix, shared in LADDER:
        if len(pivots) <= prefix:
            break  # all are compared
        a, b = (nearest(v, pivots, prefix)[0] for v in (x, y))
        if ((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= shared).mean() >= AIM:
            break
    return prefix, shared


def thin(x: np.ndarray, apart: float = APART) -> np.ndarray:
    """The rows that are not near an earlier one of them."""
    kept = np.empty_like(x)
    n = 0
    for row in x:
        if not n or (kept[:n] @ row).max() < apart:
            kept[n] = row
            n += 1
    return kept[:n].copy()


def describe(distinct: DataFrame, pivots: dict[int, np.ndarray], prefix: int, close: float) -> DataFrame:
    """Each distinct vector with the pivots it is close to (close), and unless it is a core one its nearest pivots, nearest first (near).

    Where there are no more pivots than a description holds, or none of a vector's dimensions, all such vectors are close to one."""
    first = {d: sum(len(pivots[x]) for x in pivots if x < d) for d in pivots}

    def run(source):
        for b in source:
            vectors = b.column("embedding").to_pylist()
            by, at_hand = [[]] * len(vectors), [[]] * len(vectors)
            for d in {len(v) for v in vectors}:
                at = [k for k, v in enumerate(vectors) if len(v) == d]
                if d not in pivots or len(pivots[d]) <= prefix:
                    for k in at:
                        at_hand[k] = [-d]
                    continue
                top, cos = nearest(unit([vectors[k] for k in at]), pivots[d], prefix)
                top += first[d]
                for i, row, c in zip(at, top.tolist(), cos.tolist(), strict=True):
                    at_hand[i] = sorted(p for p, x in zip(row, c, strict=True) if x >= close)
                    by[i] = row if c[0] < CORE else []
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), b.column("embedding"), pa.array(at_hand, ints), pa.array(by, ints)], names=["rep", "n", "embedding", "close", "near"])

    kind = dict(distinct.dtypes)["embedding"]
    return distinct.select("rep", "n", "embedding").mapInArrow(run, f"rep long, n long, embedding {kind}, close array<int>, near array<int>")


NOTHING = -(1 << 40)


def _padded(lists: list[list[int]]) -> np.ndarray:
    """Lists of numbers as rows of a matrix, filled up with NOTHING."""
    out = np.full((len(lists), max(1, max(map(len, lists), default=1))), NOTHING, np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows: which of the first's numbers the second has."""
    return ((a[:, :, None] == b[:, None, :]) & (a != NOTHING)[:, :, None]).any(2)


def _links(cosine: float):
    def run(key: tuple[pa.Scalar, ...], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, one, two = (x.as_py() for x in key)
        t = pa.Table.from_batches(list(source))
        rep, n, block = (t.column(c).to_numpy() for c in ("rep", "n", "block"))
        x = unit(t.column("embedding").to_pylist())
        close = _padded(t.column("close").to_pylist())
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        total, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        found = []
        for k in range(0, len(left), 256):
            rows = left[k : k + 256]
            i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
            i, j = rows[i], right[j]
            if one == two:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 100_000):
                a, b = i[s : s + 100_000], j[s : s + 100_000]
                # the pair counts in the list of the first pivot that both are close to
                good = np.where(_common(close[a], close[b]), close[a], 1 << 40).min(1) == pivot
                a, b = a[good], b[good]
                total += np.bincount(a, n[b], len(rep)).astype(np.int64) + np.bincount(b, n[a], len(rep)).astype(np.int64)
                found.append((a, b))
        if found:
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            label = place.copy()
            while True:  # smallest place reachable inside this task
                low = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                if (new == label).all():
                    break
                label = new
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(total[on]), pa.array(rep[order[label[on]]])], names=["rep", "links", "least"])

    return run


def _counted(shared: int):
    def run(key: tuple[pa.Scalar, ...], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the task's lists that share enough pivots and are close to no common one, in the list of the first two they share."""
        _, one, two = (x.as_py() for x in key)
        t = pa.Table.from_batches(list(source))
        order = np.lexsort((t.column("rep").to_numpy(), t.column("key").to_numpy()))
        names, rep, block = (t.column(c).to_numpy()[order] for c in ("key", "rep", "block"))
        near, close = (_padded([x for x in t.column(c).to_pylist()])[order] for c in ("near", "close"))
        near = np.where(near == NOTHING, 1 << 40, near)
        near.sort(1)  # rarest first
        near[near == 1 << 40] = NOTHING
        ends = np.append(np.flatnonzero(names[1:] != names[:-1]) + 1, len(names)) if len(names) else np.zeros(0, np.int64)
        end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
        at, gap = np.arange(len(names)), 0
        while True:
            gap += 1
            at = at[at + gap < end[at]]
            if not len(at):
                break
            for k in range(0, len(at), 100_000):
                i = at[k : k + 100_000]
                j = i + gap
                if one != two:
                    apart = block[i] != block[j]
                    i, j = i[apart], j[apart]
                both = _common(near[i], near[j])
                enough = both.sum(1) >= shared
                i, j, both = i[enough], j[enough], both[enough]
                if len(i):
                    low = np.sort(np.where(both, near[i], 1 << 40), 1)[:, :2]
                    good = (low[:, 0] * (1 << 32) + low[:, 1] == names[i]) & ~_common(close[i], close[j]).any(1)
                    if good.any():
                        yield pa.RecordBatch.from_arrays([pa.array(rep[i[good]]), pa.array(rep[j[good]])], names=["a", "b"])

    return run


def _pairs(listed: DataFrame, shared: int, long: int) -> DataFrame:
    """Candidates (a, b) from the lists of pairs of pivots."""
    size = F.least(F.size("near") - shared + 2, F.size("near"))
    loose = listed.where("size(near) > 1").select("rep", "near", "close", F.slice(F.array_sort("near"), 1, size).alias("first"))
    keys = F.expr("flatten(transform(sequence(0, size(first) - 2), i -> transform(sequence(i + 1, size(first) - 1), j -> first[i] * 4294967296L + first[j])))")
    entries = loose.select(F.explode(keys).alias("key"), "rep", "near", "close")
    # one row for each list that no task takes whole
    lengths = saved(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > long).select("key", F.ceil(F.col("n") / long).cast("int").alias("blocks")), "pivot-long")
    n = listed.where("size(near) > 1").count()
    keys_each = F.max(F.size("near")).alias("p")
    most = (listed.agg(keys_each).first().p or 0) - shared + 2
    tasks = max(1, n * (most * (most - 1) // 2) // TASK)
    bucket = F.pmod(F.xxhash64("key"), F.lit(tasks))
    columns = ["key", "rep", "near", "close"]
    if lengths.isEmpty():
        dealt = entries.select(bucket.alias("task"), F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("block"), *columns)
    else:
        whole = entries.join(lengths, "key", "left").withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).otherwise(0))
        other = whole.withColumn("with", F.explode(F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
        task = F.when(F.col("blocks").isNotNull(), -1 - F.col("key")).otherwise(bucket)
        dealt = other.select(task.alias("task"), F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", *columns)
    return dealt.groupBy("task", "one", "two").applyInArrow(_counted(shared), "a long, b long")


def _verified(pairs: DataFrame, listed: DataFrame, cosine: float) -> DataFrame:
    """Pairs whose cosine in double precision reaches the bound, with the numbers of rows of both."""
    for x in "ab":
        pairs = pairs.join(listed.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("embedding").alias(f"e_{x}")), x)

    def matrix(vectors: pa.Array, at: np.ndarray) -> np.ndarray:
        """Rows of vectors of one length, as unit vectors; no number becomes an object of its own."""
        taken = vectors.take(pa.array(at)).flatten()
        return unit(taken.to_numpy(zero_copy_only=False).reshape(len(at), -1))

    def run(source):
        for b in source:
            left, right = b.column("e_a"), b.column("e_b")
            size, other = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (left, right))
            good = np.zeros(b.num_rows, bool)
            for d in np.unique(size[size == other]):
                at = np.flatnonzero((size == d) & (other == d))
                good[at] = (matrix(left, at) * matrix(right, at)).sum(1) >= cosine
            yield b.select(["a", "b", "n_a", "n_b"]).filter(pa.array(good))

    return pairs.select("a", "b", "n_a", "n_b", "e_a", "e_b").mapInArrow(run, "a long, b long, n_a long, n_b long")


def near(vectors: DataFrame, cosine: float = COSINE, rung: tuple[int, int] | None = None, bounds: tuple[int, int] = PIVOTS, block: int = BLOCK, long: int = LONG) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row of vectors.

    Null and zero vectors and those with a null or non-finite component link with
    nothing, nor do vectors of different dimensions. Equal vectors link. Repeated
    rows count as vectors of their own. rung: pivots of a description and how many candidates share, in place of what the sample says. A row with a null vec_id links with nothing and
    has no component. Extra columns are ignored.
    """
    v, distinct = classes(vectors)
    distinct = saved(distinct, "pivot-classes")
    pivots, prefix, shared = choose(distinct, bounds, cosine, rung)
    # a vector that links with one at CORE from a pivot is at least so near to that pivot
    close = CORE * cosine - ((1 - CORE**2) * (1 - cosine**2)) ** 0.5 - 1e-9
    listed = saved(describe(distinct, pivots, prefix, close), "pivot-lists")
    at_hand = listed.select("rep", "n", "embedding", "close", F.explode("close").alias("pivot"))
    # one row for each pivot, so at most PIVOTS rows and one for each other number of dimensions
    blocks = at_hand.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = at_hand.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = own.select("*", other.alias("with")).select("pivot", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "rep", "n", "embedding", "close")
    links = saved(tasks.groupBy("pivot", "one", "two").applyInArrow(_links(cosine), "rep long, links long, least long"), "pivot-links")
    pairs = saved(_verified(_pairs(listed, shared, long), listed, cosine), "pivot-pairs")
    label = components(links.select(F.col("rep").alias("src"), F.col("least").alias("dst")).union(pairs.select("a", "b")))
    each = links.select("rep", "links").union(pairs.select("a", "n_b")).union(pairs.select("b", "n_a"))
    total = each.groupBy("rep").agg(F.sum("links").alias("links"))
    named = distinct.select("h1", "h2", "rep", "n").join(total, "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = v.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
