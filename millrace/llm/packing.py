"""Conflict-constrained best-fit packing.

Sequences go into bins of a fixed capacity; no bin holds two pieces of one source or
of one cluster of duplicates. Bins stand in order of what is left in them. A
sequence looks from the first bin that it fits upwards, and takes the first whose
bitmaps have neither its source nor its cluster: the tightest compatible one.
Where there is none, it opens a bin.

A sequence longer than a bin is cut into whole bins and a rest; nothing is
dropped. Sequences are dealt by a hash of their id to groups of about `GROUP`
sequences, each packed in one task; a source or cluster that holds a third of all
rows spreads over all groups. A group's task holds numbers only, no texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import kept, parts

CAPACITY = 2048
#: Sequences of a group.
GROUP = 4096
#: Bits of a bin's cluster bitmap, to which clusters are hashed; a hit is looked up exactly.
BITS = 256


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Bin and offset of each (length, source, cluster), and what is left in each bin. Longest first; None never conflicts."""
    source_bit: dict = {}
    left: list[int] = []
    sources: list[int] = []
    clusters: list[int] = []
    members: list[set] = []
    open_bins: list[tuple[int, int]] = []  # (left, bin)
    out: list[tuple[int, int]] = [(0, 0)] * len(items)
    for k in sorted(range(len(items)), key=lambda k: (-items[k][0], k)):
        length, source, cluster = items[k]
        bit = 0 if source is None else source_bit.setdefault(source, 1 << len(source_bit))
        mark = 0 if cluster is None else 1 << hash(cluster) % BITS
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not sources[b] & bit and not (clusters[b] & mark and cluster in members[b]):
                del open_bins[at]
                break
            at += 1
        else:
            b = len(left)
            left.append(capacity)
            sources.append(0)
            clusters.append(0)
            members.append(set())
        out[k] = (b, capacity - left[b])
        left[b] -= length
        sources[b] |= bit
        clusters[b] |= mark
        members[b].add(cluster)
        if left[b] > 0:
            insort(open_bins, (left[b], b))
    return out, left


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pack a table of doc_id, length, source and cluster.

    Gives, for each piece of each row, doc_id, piece (from 0), start (within the
    document), n_tokens, bin_id, offset (within the bin) and bin_left. Null
    lengths count as 0; a row of length 0 is a piece of no tokens in a bin. A null
    source or cluster conflicts with none. Repeated rows are packed each on
    its own. Extra columns are ignored. Ties are taken in the order of doc_id.
    """
    rows = items.select("doc_id", F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0)).alias("length"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    # dealt by all that a row is packed by, so that rows without an id are spread as well
    dealt = rows.withColumn("part", parts(items, rows.columns, group))

    def run(key: tuple[pa.Scalar, ...], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("packing", dict)  # frees what other operators kept
        part = key[0].as_py()
        whole = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["length"], r["source"], r["cluster"]) for b in source for r in b.to_pylist()), key=lambda r: tuple((x is not None, x) for x in r))
        pieces = []
        for there, doc_id, length, src, cluster in whole:
            for piece, start in enumerate(range(0, max(length, 1), capacity)):
                pieces.append((doc_id if there else None, piece, start, min(capacity, length - start), src, cluster))
        place, left = best_fit([(p[3], p[4], p[5]) for p in pieces], capacity)
        out = [(*p[:4], part << 32 | b, offset, left[b]) for p, (b, offset) in zip(pieces, place, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "piece", "start", "n_tokens", "bin_id", "offset", "bin_left"])

    return dealt.groupBy("part").applyInArrow(run, "doc_id long, piece long, start long, n_tokens long, bin_id long, offset long, bin_left long")


def documents(docs: DataFrame) -> DataFrame:
    """Lengths in words and an end mark, the source, and texts that are equal but for the case of letters as clusters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", (words + 1).alias("length"), "source", F.when(text != "", F.md5(F.lower(text).cast("binary"))).alias("cluster"))
