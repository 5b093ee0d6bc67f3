"""Merkle manifest against a tree built node by node, with small blocks and odd rows."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp int, n string"
H = lambda x: sha256(x.encode()).hexdigest()


def hashed(doc_id, source, lang, n_chars, text):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """All levels up to one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def sides(levels, k):
    out = []
    for level in levels[:-1]:
        at = k - k % 3
        out.append(("".join(level[at:k]), "".join(level[k + 1 : at + 3])))
        k //= 3
    return out


def brute(rows):
    first = lambda x: (x is not None, x if not isinstance(x, str) else x.encode())
    sources = sorted({r[1] for r in rows}, key=first)
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: ((r[0] is not None, r[0] or 0), hashed(*r[:5]))) for s in sources}
    trees = {s: tree([hashed(*r[:5]) for r in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for k, r in enumerate(own[s]):
            way = sides(trees[s], k) + sides(top, j)
            x = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 or r[4] is None else (*r[:4], r[4].replace("\n", ""))
            node = hashed(*x[:5])
            for a, b in way:
                node = H(a + node + b)
            leaf = hashed(*r[:5])
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in way)), node, node == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def made(n):
    rows = [(k, ["hot", "é", "a", "z", None][min(k % 9, 4)] if k % 2 else "hot", None if k % 7 == 0 else "en", None if k % 11 == 0 else k, [None, "", f"one\ntwo {k}", f"flat {k}", "\n\n", "ü\n" * 50][k % 6], 1, "x") for k in range(n)]
    return rows + [(5, "hot", "en", 5, "other\n", 1, "x")] * 2 + [(None, None, None, None, None, 1, "x"), (None, "hot", None, None, "a\nb", 1, "x"), (None, "hot", None, None, "a\nc", 1, "x"), (999, "lone", "en", 1, "x" * 100_000 + "\n", 1, "x"), (-4, "𝄞", "en", 1, "u", 1, "x"), (-5, "￿", "en", 1, "u", 1, "x")]


@pytest.mark.parametrize(("depth", "n"), [(6, 60), (1, 60), (2, 100), (1, 3)])
def test_manifest_gives_what_the_tree_gives(spark, monkeypatch, depth, n):
    monkeypatch.setattr(merkle, "LEVELS", depth)
    monkeypatch.setattr(merkle, "BLOCK", merkle.RUN**depth)
    monkeypatch.setattr(merkle, "ROWS", 40)
    rows = made(n)
    out, want = got(spark, rows), brute(rows)
    assert out == want
    assert {True, False} == {r[-1] for r in out}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_small_tables(spark, n):
    rows = [(k, "s", "en", 1, f"t{k}\n", 1, "x") for k in range(n)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    df = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0 and df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_changed_row_changes_its_leaf_and_the_root_alone(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}", "en", 1, f"t{k}", 1, "x") for k in range(30)], SCHEMA)
    other = docs.withColumn("text", F.when(F.col("doc_id") == 7, "changed").otherwise(F.col("text")))
    a, b = ({r.doc_id: r for r in merkle.manifest(x).collect()} for x in (docs, other))
    assert [k for k in a if a[k].leaf != b[k].leaf] == [7] and a[0].root != b[0].root
    assert {k for k in a if a[k].subroot != b[k].subroot} == {k for k in a if k % 3 == 1}
