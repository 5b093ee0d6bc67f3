"""The Jaccard join against brute force."""

import itertools
import random

import numpy as np
import pytest

from millrace.llm import jaccard
from millrace.llm.jaccard import Deal


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 3 * max(len(a), len(b)) <= 4 * min(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def made(seed):
    """Chains of edits, a large group of near copies, a passage in many texts, short and odd texts."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(400))
    texts = [None, "", " \t ", "one", "One", "two three four", "a b c d e", "a b c d e f"]
    for _ in range(12):
        w = [word() for _ in range(r.choice((6, 12, 40, 150)))]
        for _ in range(6):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = word()
    base = [word() for _ in range(120)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(r.choice((5, 14, 16, 18, 60)))]) for _ in range(60)]
    texts += ["long " + " ".join(word() for _ in range(3000))] * 2
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_made(spark, seed):
    rows = made(seed)
    want = brute(rows)
    got = jaccard.join(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, key string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == want
    assert jaccard.join(docs.limit(0)).collect() == []


def test_rounds_of_a_large_component(spark, monkeypatch):
    """Components that no task holds, dealt to blocks, and buckets dealt twice."""
    rows = made(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("LIMIT", 1_000), ("HUBS", 2), ("AT_ONCE", 4)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "Deal", lambda n: type("Few", (Deal,), {})(n, 500, 16))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == brute(rows)


def test_odd_rows(spark):
    """Null and repeated ids, rows twice, clashing names, one passage in every text."""
    same = " ".join(f"w{k}" for k in range(60))
    rows = [(None, same), (None, "alone here"), (7, same), (7, same), (8, same + " x"), (9, "own text"), (9, same + " y z"), (None, None), (10, None)]
    got = jaccard.join(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, component_id int, k1 int, n int")).collect()
    assert len(got) == len(rows)
    seen = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert seen == sorted([(None, 56, 7), (None, 1, None), (7, 56, 7), (7, 56, 7), (8, 57, 7), (9, 1, 7), (9, 58, 7), (None, 0, None), (10, 0, 10)], key=str)


@pytest.mark.parametrize("hot", [0, 0.5, 0.95, 1])
def test_signatures_guarantee(hot):
    """Linked sets share more signatures than either can spare, whichever shingles are frequent."""
    r = np.random.default_rng(5)
    for n in [*range(1, 40), 75, 99, 100, 133, 260, 700] * 3:
        a = np.unique(r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        n = len(a)
        names = np.sort(r.permutation(a)[: int(hot * n)])
        frequent = names, r.integers(1, jaccard.LEVELS, len(names))
        for _ in range(6):
            lose = int(r.integers(0, n // 4 + 1))
            kept = r.permutation(a)[: n - lose]
            gain = int(r.integers(0, max(0, len(kept) * 4 // 3 - n) + 1))
            b = np.unique(np.concatenate((kept, r.integers(0, 1 << 63, gain, np.uint64))))
            common = len(np.intersect1d(a, b))
            if 100 * common < 75 * (len(a) + len(b) - common):
                continue
            (x, spare_x), (y, spare_y) = (jaccard.signatures(s, frequent) for s in (a, b))
            assert len(np.intersect1d(x, y)) > max(spare_x, spare_y)


def test_neighbourhoods_are_laid():
    """A set with too few rare segments has the neighbourhoods of these, before its frequent segments or single shingles."""
    r = np.random.default_rng(6)
    a = np.unique(r.integers(0, 1 << 63, 300, np.uint64) * np.uint64(2))
    whole = len(jaccard.signatures(a, (a[:0], np.zeros(0, np.int64)))[0])
    names = np.sort(r.permutation(a)[: len(a) * 6 // 10])
    found, spare = jaccard.signatures(a, (names, np.ones(len(names), np.int64)))
    assert spare == 0 and len(found) > whole
    k, m, most = jaccard.schemes(len(a))[0]
    segment = ((a >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    name = next(x for x in np.unique(segment) if (rare := ~np.isin(a[segment == x], names)).sum() > 1)
    less = a[segment == name][1:]
    sign = jaccard.mix(np.add.reduce(jaccard.mix(less ^ jaccard._MULT)) ^ (name * jaccard._MULT + np.uint64(k)))
    assert sign in found


def test_settle():
    r = random.Random(4)
    for _ in range(30):
        words = list(range(40))
        sets = []
        for _ in range(r.randrange(2, 40)):
            r.shuffle(words)
            sets.append(np.array(sorted(r.sample(range(r.choice((8, 14, 30))), r.randrange(1, 8))), np.uint64))
        root = list(range(len(sets)))
        for _ in sets:
            for i, j in itertools.combinations(range(len(sets)), 2):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    root[i] = root[j] = min(root[i], root[j])
        assert jaccard.settle(sets).tolist() == root


def test_bands_guarantee():
    """Sets of sizes that a link allows meet in the smaller one's scheme and differ there in no more than it says."""
    for n in range(1, 3000):
        k, _, most = jaccard.schemes(n)[0]
        for s in {n, n + 1, n * 7 // 6, n * 4 // 3}:
            if 3 * s <= 4 * n:
                union = 4 * (n + s) // 7
                apart = n + s - 2 * -(-3 * union // 4)
                there = {x: bound for x, _, bound in jaccard.schemes(s)}
                assert k in there and apart <= min(most, there[k]) + 1 and (n + s) // 7 <= min(most, there[k])


def test_bytes_of_a_signature_at_many_buckets(spark):
    """At as many buckets as a large table has, a block holds a set once or twice: a signature is sent with its set's key and little more."""
    r = random.Random(7)
    rows = [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(300))) for k in range(400)]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    deal = Deal(10**10, 8_000_000, 4096)
    blocks = jaccard._records(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), none, deal, 5).where("bucket >= 0").collect()
    sent = sum(len(jaccard.signatures(jaccard.Shingler()(t), none)[0]) for _, t in rows)
    assert len(blocks) > 1_000 and sum(len(b.block) for b in blocks) < 17 * sent


def test_texts_of_a_long_list(spark, monkeypatch):
    """Only texts that may be wanted are dealt out, told by bits of a fixed number; rows and components are the same."""
    docs = spark.range(5_000).selectExpr("if(id % 100 = 7, null, id - 50) AS doc_id", "repeat(cast(id AS string), 20) AS text")
    wanted = spark.range(-60, 5_000, 37).selectExpr("id AS doc_id", "id AS k1", "id + 1 AS k2")
    want = {(w, str(w + 50) * 20, w, w + 1) for w in range(-60, 5_000, 37) if 0 <= w + 50 < 5_000 and (w + 50) % 100 != 7}
    for name, value in (("SMALL_TABLE", 0), ("FILTER", 1 << 20)):
        monkeypatch.setattr(jaccard, name, value)
    long = jaccard._texts(docs, wanted)
    assert {tuple(r) for r in long.select("doc_id", "text", "k1", "k2").collect()} == want
    assert "bitmap_construct_agg" in long._jdf.queryExecution().toString()
    rows = made(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()} == brute(rows)


def test_many_sets_at_once(monkeypatch):
    """Sets of odd texts side by side, cut anywhere, are those of each text alone, and so are their signatures."""
    monkeypatch.setattr(jaccard, "SLICE", 100)
    r = random.Random(8)
    texts = [None, "", " \t ", "a", " A", "a b c d e", "A B\x0bC\x0cd\re", "x" * 64, "x" * 65 + " X", "é É \x1f\x85 b"] + [" ".join(r.choice("abcdefg") * r.choice((1, 2, 70)) for _ in range(r.randrange(40))) for _ in range(150)]
    many = jaccard.Shingler().many(texts)
    monkeypatch.undo()
    one = jaccard.Shingler()
    own = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").encode().lower().split() for t in texts)]
    for i, (x, t) in enumerate(zip(many, texts, strict=True)):
        assert x.tolist() == one(t).tolist()
        assert [len(np.intersect1d(x, y)) for y in many[:i]] == [len(own[i] & s) for s in own[:i]]
    sets = [x for x in many if len(x)]
    for frequent in ((sets[0][:0], np.zeros(0, np.int64)), (np.unique(np.concatenate(sets))[::2], np.ones(len(np.unique(np.concatenate(sets))[::2]), np.int64))):
        sig, of, spare = jaccard.laid(sets, frequent)
        for k, s in enumerate(sets):
            want = jaccard.signatures(s, frequent)
            assert np.sort(sig[of == k]).tolist() == np.sort(want[0]).tolist() and spare[k] == want[1]
