"""What the operators share: tables, shared scratch folders, splits, and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.session import saved, scratch

__all__ = ["components", "fold", "kept", "parts", "saved", "scratch", "smallest", "table"]

#: Edges that a task shrinks at a time.
STRETCH = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The one thing that this worker process keeps from task to task, and its name.
_KEPT: list[tuple[str, object]] = []


def kept(name: str, make: Callable[[], object]):
    """What make gave in this process under the name. Another name takes its place, and what that frees goes back to the system."""
    if not _KEPT or _KEPT[0][0] != name:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)
        _KEPT.append((name, make()))
    return _KEPT[0][1]


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def smallest(df: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The `most` rows with the smallest hashes of their key.

    Hashes spread evenly, so a bound on them keeps half as many again before rows
    are sorted: tasks send little more than `most` rows in all, however many there are."""
    h, n = F.xxhash64(key), df.count()
    if n > 2 * most + 1000:
        df = df.where(h < F.lit(-(1 << 63) + int((1.5 * most + 500) / n * (1 << 64))))
    return df.orderBy(h, key).limit(most)


def parts(df: DataFrame, keys: Sequence[str], target: int) -> Column:
    """Bucket of the keys so that a bucket holds about `target` rows, at least one bucket."""
    n = max(1, -(-df.count() // target))
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _stars(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a stretch of edges with the smallest id that it is tied to there, itself among them."""

    def sealed(held):
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for x in (a, b, label[a], label[b]):
                np.minimum.at(new, x, low)
            new = new[new]
            if (new == label).all():
                return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["id", "root"])
            label = new

    held, n = [], 0
    for b in source:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n > STRETCH:
            yield sealed(held)
            held, n = [], 0
    if held:
        yield sealed(held)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Smallest id reachable from each id that has an edge: (id, component).

    edges has two long columns, src and dst. Each task shrinks its own edges to stars,
    before anything is shuffled; a node then meets the roots it has in different
    tasks, at most one for each stretch of edges, and these roots are tied by the
    next round's edges. A round leaves only edges between roots, so rounds grow
    with the logarithm of the longest chain and tables shrink from round to round.
    """
    now = edges.select("src", "dst").where("src <> dst")
    levels = []
    while True:
        stars = now.mapInArrow(_stars, "id long, root long")
        level = saved(stars.groupBy("id").agg(F.array_sort(F.collect_set("root")).alias("roots")), tag)
        levels.append(level)
        now = level.where("size(roots) > 1").select(F.explode(F.slice("roots", 2, F.size("roots"))).alias("src"), F.get("roots", F.lit(0)).alias("dst"))
        if now.isEmpty():
            break
    label = None
    for level in reversed(levels):
        own = level.select("id", F.get("roots", F.lit(0)).alias("root"))
        if label is not None:
            own = own.join(label.withColumnsRenamed({"id": "root", "component": "far"}), "root", "left").select("id", F.coalesce("far", "root").alias("root"))
        label = own.withColumnRenamed("root", "component")
    return label
