"""Merkle manifest of a dataset: leaves, a root for each source, one root for all, and the proof of each leaf.

Leaves are dealt by range of source and id and numbered, blocks of a fixed number of
leaves become arrays, and higher-order functions collapse the levels inside a block. A
block's root is a node of the level above, so the same step over the roots of blocks
goes on until a source has one node, and then over the sources' roots until one is left.
Nothing is grouped by more than one block, however many rows a source has.

Only the five columns of a leaf are read. A null source is a source of its own and
comes first. Rows of one source and one doc_id, or with null ids (which come first), are
ordered by their leaf; equal rows have the same leaf, and whichever of them comes first
makes no difference. A row without an id is not tampered with. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import saved
from millrace.operators.records import number

#: Nodes that are hashed into one.
RUN = 3
#: Levels that a block collapses at a time, and its leaves.
LEVELS = 6
BLOCK = RUN**LEVELS
#: Rows for each range partition, where the table is so large that the session's number of partitions gives more.
ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(c: Column) -> Column:
    """Lower-case hex SHA-256 of the text in UTF-8."""
    return F.sha2(c.cast("binary"), 256)


def leaf(text: Column | None = None) -> Column:
    """Hash of the five columns: each as its length in bytes, a colon and its value, or a dash if null. text: in place of the column."""

    def field(name: str) -> Column:
        c = F.col(name).cast("string") if name != "text" or text is None else text
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return digest(F.concat(*map(field, FIELDS)))


def leaves(docs: DataFrame) -> DataFrame:
    """grp (source), doc_id, leaf, and tampered: the leaf of what tampering made of the row, null where it is not tampered with."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shorn = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return docs.select(F.col("source").alias("grp"), "doc_id", leaf().alias("leaf"), F.when(even, leaf(shorn)).alias("tampered"))


def placed(rows: DataFrame) -> DataFrame:
    """rows (grp, doc_id, leaf, ...) with n, the place in the group from 0, and size, the group's number of rows.

    Range partitions are written to the shared folder. A place is the one in the
    partition's stretch of the group plus what partitions before it have of the group:
    one count for each partition and group.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    order = [F.asc_nulls_first(c) for c in ("grp", "doc_id", "leaf")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = saved(dealt.withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "leaves")
    counts = dealt.groupBy("p", "grp").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    w = Window.partitionBy("grp")
    before = F.coalesce(F.sum("c").over(w.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("p", F.col("grp").alias("own"), (before - F.col("first")).alias("shift"), F.sum("c").over(w).alias("size"))
    both = dealt.join(counts, (dealt.p == counts.p) & dealt.grp.eqNullSafe(counts.own))
    return both.select(*rows.columns, (F.col("at") + F.col("shift")).alias("n"), "size")


def above(nodes: Column) -> Column:
    """The next level: every run of nodes as its hash."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(nodes, r * RUN + 1, RUN), "")))


def levels(nodes: Column, whole: Column) -> Column:
    """All levels of a block, its nodes first and its root last. whole: the block is all of its group, and ends where one node is left; others go through all levels."""

    def step(seen: Column, _: Column) -> Column:
        last = F.element_at(seen, -1)
        return F.when(whole & (F.size(last) == 1), seen).otherwise(F.concat(seen, F.array(above(last))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(nodes), step)


def path(levels: Column, at: Column) -> Column:
    """What stands left and right of a node in its run and of the runs above it, level by level up to the block's root."""
    below = F.slice(levels, F.lit(1), F.size(levels) - 1)

    def beside(level: Column, k: Column) -> Column:
        here = F.floor(at / F.pow(F.lit(RUN), k)).cast("int")
        start = here - here % RUN
        left = F.array_join(F.slice(level, start + 1, here - start), "")
        right = F.array_join(F.slice(level, here + 2, start + RUN - 1 - here), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(below, beside)


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda x, side: digest(F.concat(side["left"], x, side["right"])))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), "")


def climb(nodes: DataFrame) -> DataFrame:
    """nodes (grp, n, node, size) to (grp, n, path, root): the path of each node up to its group's root, block by block.

    A round leaves one node in BLOCK, so there are as many rounds as the largest group
    has powers of it; then the paths are put together from the top down.
    """
    rounds, now = [], nodes
    while True:
        grouped = now.groupBy("grp", F.floor(F.col("n") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "node"))).alias("nodes"), F.first("size").alias("size"))
        own = grouped.withColumn("levels", levels(F.col("nodes.node"), F.col("size") <= BLOCK)).withColumn("root", F.element_at("levels", -1)[0])
        rounds.append(saved(own, "blocks"))
        if rounds[-1].where(F.col("size") > BLOCK).isEmpty():
            break
        now = rounds[-1].select("grp", F.col("block").alias("n"), F.col("root").alias("node"), F.ceil(F.col("size") / BLOCK).alias("size"))
    upper = None
    for blocks in reversed(rounds):
        if upper is None:
            blocks = blocks.withColumn("up", F.array().cast("array<struct<left:string,right:string>>"))
        else:
            far = upper.select(F.col("grp").alias("own"), F.col("n").alias("at"), F.col("path").alias("up"), F.col("root").alias("top"))
            blocks = blocks.join(far, blocks.grp.eqNullSafe(far.own) & (blocks.block == far.at)).withColumn("root", F.col("top"))
        each = F.transform("nodes", lambda x, k: F.struct(x["n"].alias("n"), F.concat(path(F.col("levels"), k), F.col("up")).alias("path")))
        upper = blocks.select("grp", F.explode(each).alias("x"), "root").select("grp", "x.*", "root")
    return upper


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    A block keeps its leaves until its own path is known; then proofs and folds are made
    inside the block, so that no leaf carries its siblings through a shuffle."""
    rows = saved(leaves(docs), "hashed")
    if rows.isEmpty():
        return rows.select("doc_id", "leaf", *(F.lit(None).cast("string").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")), F.lit(None).cast("boolean").alias("verified"))
    own = placed(rows).groupBy("grp", F.floor(F.col("n") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "leaf", "doc_id", "tampered"))).alias("rows"), F.first("size").alias("size"))
    own = saved(own.withColumn("top", F.element_at(levels(F.col("rows.leaf"), F.col("size") <= BLOCK), -1)[0]), "blocks")
    # blocks are the nodes of each source, and sources those of the whole
    in_source = saved(climb(own.select("grp", F.col("block").alias("n"), F.col("top").alias("node"), F.ceil(F.col("size") / BLOCK).alias("size"))), "paths")
    sources = saved(number(in_source.where("n = 0").select("grp", F.col("root").alias("node")), [F.asc_nulls_first("grp")], "k").withColumn("n", F.col("k") - 1), "sources")
    everything = climb(sources.select(F.lit(0).alias("grp"), "n", "node", F.lit(sources.count()).alias("size")))
    roots = everything.join(sources.select("n", F.col("grp").alias("source"), F.col("node").alias("subroot")), "n").select("source", "subroot", F.col("path").alias("top_path"), F.col("root").alias("whole"))
    far = in_source.select(F.col("grp").alias("far"), F.col("n").alias("at"), F.col("path").alias("mid"))
    up = far.join(roots, far.far.eqNullSafe(roots.source)).select("far", "at", "subroot", "whole", F.concat("mid", "top_path").alias("up"))
    blocks = own.join(up, own.grp.eqNullSafe(up.far) & (own.block == up["at"])).withColumn("levels", levels(F.col("rows.leaf"), F.col("size") <= BLOCK))

    def proven(x: Column, k: Column) -> Column:
        way = F.concat(path(F.col("levels"), k), F.col("up"))
        return F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), digest(siblings(way)).alias("proof_sha256"), folded(F.coalesce(x["tampered"], x["leaf"]), way).alias("folded_root"))

    out = blocks.select(F.explode(F.transform("rows", proven)).alias("x"), "subroot", F.col("whole").alias("root"))
    return out.select("x.doc_id", "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified"))
