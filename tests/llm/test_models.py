"""Quality, toxicity, codec and lattice against the library, brute force and held-out labels."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from test_tokens import HARD
from tokenizers import Tokenizer

from millrace.llm import codec, lattice, quality, toxicity, words, wordtable

SF = "/root/testdata/sf0.01"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def hard(spark):
    return spark.createDataFrame([(k, t, 0, "x") for k, t in enumerate(HARD)] + [(3, HARD[3], 0, "y"), (None, "x y", None, None)], "doc_id long, text string, n_words int, score string").repartition(3)


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    hit = set()
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    for k, g in enumerate(grams):
        if grams.count(g) > 1 if len(grams) < 500 else len(set(grams)) == 1:
            hit |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(hit)]


def test_quality(spark):
    for text in [*HARD, "a b c a b c", "a\n\na\n \na b", "a a a a", "x y\nx y\nz # $"]:
        assert quality.statistics(text)[0] == brute_counts(text), text
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == docs.count()
    right = [got[r.doc_id].kept == bool(r.quality) for r in labels.collect() if not got[r.doc_id].base_failed]
    assert np.mean(right) > 0.97
    assert len(quality.judge(hard(spark), None).collect()) == len(HARD) + 2
    assert quality.judge(docs.limit(0), labels).collect() == []


def test_monotonic_trees():
    r = np.random.default_rng(0)
    x = r.random((800, 2))
    y = ((x[:, 0] > 0.5) ^ (r.random(800) < 0.2)).astype(float)
    trees = quality.fit(x, y, [1, -1])
    grid = np.linspace(0, 1, 50)
    for other in (0.1, 0.5, 0.9):
        assert (np.diff(trees.probability(np.stack([grid, np.full(50, other)], 1))) >= -1e-12).all()
        assert (np.diff(trees.probability(np.stack([np.full(50, other), grid], 1))) <= 1e-12).all()


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels).start()
    for disguised, plain in (("1d10t", "idiot"), ("m0r0n", "moron"), ("idiiiot", "idiot"), ("$tup1d", "stupid"), ("l.o.s.e.r", "loser")):
        assert toxicity.decode(disguised, model.logp) == plain
    assert {"idiot", "moron"} <= model.restore.words("what an i d i o t, (m0ron)")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [got[k].predicted == v for k, v in truth.items() if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in truth)
    assert np.mean(held) > 0.95
    assert len(toxicity.score(hard(spark), None).collect()) == len(HARD) + 2
    assert toxicity.score(docs.limit(0), labels.limit(0)).collect() == []


def test_viterbi_finds_the_best_of_all_paths():
    r = np.random.default_rng(8)
    logp = toxicity.log_model(r.integers(0, 40, toxicity.SIZE**3).astype(float))

    def score(outs, costs):
        a = b = 0
        total = sum(costs)
        for c in "".join(outs):
            z = toxicity.RANK.get(c, 0)
            total += logp[a, b, z]
            a, b = b, z
        return total + logp[a, b, 0]

    for token, loose, split in (("1d10t", 0, False), ("$tu**pid", 1, False), ("looo5er", 0, False), ("abba", 0, True), ("st1aa", 0, True), ("|(|", 0, False), ("...", 0, False)):
        paths = [tuple(zip(*p, strict=True)) for p in itertools.product(*toxicity.lattice(token, loose, split))]
        best = max(paths, key=lambda p: score(*p))
        got = toxicity.decode(token, logp, loose, split)
        assert abs(max(score(*p) for p in paths if "".join(p[0]) == got) - score(*best)) < 1e-4, (token, got, best)


def test_trees_score_as_walked_one_by_one():
    r = np.random.default_rng(3)
    x = r.random((500, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)).astype(float)
    trees = quality.fit(x, y, [1, -1, 0], rounds=10)

    def walk(row):
        raw = trees.base
        for k in trees.roots:
            while trees.left[k] != k:
                k = trees.left[k] if row[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
            raw += trees.value[k]
        return 1 / (1 + math.exp(-raw))

    got = trees.probability(x)
    assert np.allclose(got, [walk(row) for row in x])
    assert np.mean((got > 0.5) == y) > 0.98


def text_probability(p, words, end, kappa):
    """p: word to probability, in one class."""
    total, seen = math.log(end) + math.log(kappa / (kappa + len(words))), {}
    for t, w in enumerate(words):
        total += math.log((kappa * p[w] + seen.get(w, 0)) / (kappa + t))
        seen[w] = seen.get(w, 0) + 1
    return total


def test_text_probability_word_by_word():
    r = np.random.default_rng(4)
    p, end, share, kappa = r.dirichlet(np.ones(12), 3), np.array([0.01, 0.2, 0.05]), np.array([0.5, 0.3, 0.2]), 7.0
    for n in (0, 1, 5, 60):
        words = r.integers(0, 12, n)
        each = [math.log(a) + text_probability(b, words.tolist(), c, kappa) for a, b, c in zip(share, p, end, strict=True)]
        got = lattice.text_log10(np.log10(p), words, np.log10(end), np.log10(share), kappa)
        assert abs(got - math.log(sum(map(math.exp, each))) / math.log(10)) < 1e-9
    rare = np.array([[-4000.0, -1.0]])  # its power underflows
    assert abs(lattice.text_log10(rare, np.array([0, 1]), np.zeros(1), np.zeros(1), 10.0) - (-4001 + 3 - math.log10(10 * 11 * 12))) < 1e-9


def test_disguises_of_any_length_and_place(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    words = toxicity.learn(docs, labels).start().restore.words
    for text, plain in (
        ("st" + "u" * 40 + "pid", "stupid"), ("stuupid", "stupid"), ("$tup1d", "stupid"), ("!d10t", "idiot"), ('"$tupid', "stupid"), ("($tup1d)", "stupid"),
        ("(stupid)", "stupid"), ("what a s t u p i d thing", "stupid"), (" ".join("stupid" + "i" * 100), "stupid"),
    ):
        assert any(w.startswith(plain) for w in words(text)), (text, words(text))
    assert {"stupid", "idiot"} <= words("s t u p i d i d i o t")
    assert words("hello, (reed)") >= {"hello", "reed"}
    assert words("x1" * 20_000)


def test_codec(spark):
    library = Tokenizer.from_file(BYTES)
    df = hard(spark)
    text = {r.doc_id: r.text or "" for r in df.collect()}
    rows = codec.digests(df, BYTES).collect()
    assert len(rows) == len(HARD) + 2
    for r in rows:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want, text[r.doc_id]
    back = {r.doc_id: r.text for r in codec.decode(codec.encode(df, BYTES), BYTES).collect()}
    assert back == text
    assert {r.doc_id: r.text for r in codec.decode_joined(codec.encode(df, BYTES), BYTES).collect()} == text
    broken = spark.createDataFrame([(1, np.array([220, 162, 0], "<u4").tobytes()), (2, b"")], "doc_id long, ids binary")
    assert sorted(codec.decode_joined(broken, BYTES).collect()) == sorted(codec.decode(broken, BYTES).collect())
    assert codec.digests(df.limit(0), BYTES).collect() == []


def repeated(spark):
    """Rows whose partitions have the same ids and distinct words: a table twice, and texts that differ in order or counts alone."""
    df = hard(spark)
    alone = [spark.createDataFrame([(None, t, 0, "x")], "doc_id long, text string, n_words int, score string").coalesce(1) for t in ("a b", "a b a", "a b", "", "")]
    for x in [df, *alone]:
        df = df.unionByName(x)
    return df


def test_equal_batches_keep_their_rows(spark):
    df, library = repeated(spark), Tokenizer.from_file(BYTES)
    want = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect())
    rows = codec.digests(df, BYTES).collect()
    assert sorted(r.n_tokens for r in rows) == want
    assert {r.n_tokens for r in rows if r.doc_id is None} >= {len(library.encode(t, add_special_tokens=False).ids) for t in ("a b", "a b a")}
    scored = lattice.score(df, PIECES).collect()
    assert sorted(r.n_tokens for r in scored) == sorted(len((r.text or "").encode().split()) + 1 for r in df.collect())


def test_shuffled_input_is_written_first(spark):
    """Rows that come in another order each time give every row its result; rows straight from files are not written."""
    docs, library = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), Tokenizer.from_file(BYTES)
    assert wordtable.steady(docs.select("doc_id", "text").where("doc_id > 3")).inputFiles() == docs.inputFiles()
    mixed = docs.union(docs).orderBy(F.rand())
    rows = codec.digests(mixed, BYTES).collect()
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted([*want.items()] * 2)
    assert lattice.score(mixed, PIECES).count() == 2 * docs.count()


def test_lattice_sums_all_segmentations():
    pieces, logp = lattice.vocabulary(PIECES)
    p = dict(zip(pieces, np.exp(logp), strict=True))
    assert abs(sum(p.values()) - 1) < 1e-9
    words = [b"a", b"the", b"then", "été".encode(), b"xyzzy"]
    got = lattice.Lattice(PIECES).log_probability(words)
    for w, x in zip(words, got, strict=True):
        raw, total = lattice.OPEN + w, 0.0
        for cuts in itertools.product((0, 1), repeat=len(raw) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(raw)]
            total += math.prod(p.get(raw[a:b], 0.0) for a, b in itertools.pairwise(at))
        assert abs(x - math.log(total)) < 1e-9


def test_lattice_scores(spark):
    df = hard(spark).where("doc_id is not null")
    rows = lattice.score(df, PIECES).collect()
    tokens = {k: (t or "").encode().lower().split() for k, t in enumerate(HARD)}
    counts: dict = {}
    for r in rows:
        if not r.held_out:
            for w in [*tokens[r.doc_id], None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        mine = [*tokens[r.doc_id], None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine), sum(w in counts for w in mine), n)
        assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in mine), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert lattice.score(df.limit(0), PIECES).collect() == []


TALES = [("de", "die maus die katze"), ("de", "die maus lief"), ("de", "eine katze lief"), ("fr", "le chat noir"), ("fr", "la souris noire le chat"), (None, "a cat ran"), ("xx", "a mouse ran a"), ("fr", ""), ("de", None)]


def segmentations(word):
    raw = lattice.OPEN + word.encode()
    for cuts in itertools.product((0, 1), repeat=len(raw) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(raw)]
        yield [raw[a:b] for a, b in itertools.pairwise(at)]


def plain_fit(words, rounds):
    """Expectation maximisation over every segmentation of every word."""
    pieces, logp = lattice.vocabulary(PIECES)
    p = dict(zip(pieces, np.exp(logp).tolist(), strict=True))
    for _ in range(rounds):
        n = dict.fromkeys(p, 0.01)
        for w in words:
            ways = [(s, math.prod(p.get(x, 0.0) for x in s)) for s in segmentations(w)]
            whole = sum(x for _, x in ways)
            for s, x in ways:
                for piece in s if x else ():
                    n[piece] += x / whole
        total = sum(n.values())
        p = {x: y / total for x, y in n.items()}
    return p


def plain_discount(count):
    n1, n2 = (sum(c == k for c in count.values()) for k in (1, 2))
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5


def test_lattice_model_recomputed(spark, monkeypatch):
    """Fit, discounting, classes and scores against loops; held-out rows' classes have no say."""
    monkeypatch.setattr(lattice, "CLASSES", 3)
    docs = [(k, lang, text) for k, (lang, text) in enumerate(TALES * 3)]
    schema = "doc_id long, lang string, text string"
    got = {r.doc_id: r for r in lattice.score(spark.createDataFrame(docs, schema).repartition(3), PIECES, kappa=50.0).collect()}
    held = {k for k, *_ in docs if zlib.crc32(str(k).encode()) % 5 == 1}
    named = collections.Counter(lang for k, lang, _ in docs if k not in held and lang)
    common = sorted(named, key=lambda x: (-named[x], x))[:2]
    classes = [[(text or "").split() for k, lang, text in docs if k not in held and (lang if lang in common else None) == z] for z in [*common, None]]
    assert all(classes)
    counts = [collections.Counter(w for words in c for w in words) for c in classes]
    everything = sum(counts, collections.Counter())
    names = {w for _, _, text in docs for w in (text or "").split()}
    fits = [plain_fit(c, lattice.ROUNDS) for c in counts]
    lat = [{w: sum(math.prod(p.get(x, 0.0) for x in s) for s in segmentations(w)) for w in names} for p in fits]
    tokens = sum(everything.values())

    def seen(count, w):
        n, d = sum(count.values()), plain_discount(count)
        return max(count[w] - d, 0) / n, d * len(count) / n

    def general(w):
        own, free = seen(everything, w)
        return own + free * sum(sum(c.values()) / tokens * x[w] for c, x in zip(counts, lat, strict=True))

    models, ends = [], []
    for words, count, x in zip(classes, counts, lat, strict=True):
        end = (len(words) + 0.5) / (sum(count.values()) + len(words) + 1)
        ends.append(end)
        models.append({w: (1 - end) * (seen(count, w)[0] + seen(count, w)[1] * ((1 - lattice.BACK) * x[w] + lattice.BACK * general(w))) for w in names})
    learned = sum(map(len, classes))
    for k, _, text in docs:
        each = [len(c) / learned * math.exp(text_probability(p, (text or "").split(), end, 50.0)) for c, p, end in zip(classes, models, ends, strict=True)]
        assert math.isclose(got[k].score, math.log10(sum(each)), rel_tol=1e-5), (k, text)
    other = [(k, "fr" if k in held else lang, text) for k, lang, text in docs]
    again = {r.doc_id: r.score for r in lattice.score(spark.createDataFrame(other, schema), PIECES, kappa=50.0).collect()}
    assert all(math.isclose(again[k], r.score, rel_tol=1e-9) for k, r in got.items())


def test_lattice_beats_the_base_on_held_out_documents(spark):
    rows = lattice.score(spark.read.parquet(f"{SF}/documents.parquet"), PIECES).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_words_of_batches(monkeypatch):
    """Batches hold each text's words in order, however the texts are cut into record batches and slices."""
    odd = ["", None, " ", "  a", "a  b", "a   b\n c \n\n d", "x<|endoftext|> y.", "a　 b", "tab\t b", "end. ", "..", " ..", "a .. b", "\x1c a", "a\x85 b", "İ. क़. É,", "The end, the End."]
    texts = pa.array(odd * 3 + HARD, pa.string())
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["doc_id", "text"])

    def lumps(text):
        if "<|endoftext|>" in text:
            return [text]
        return [w for lump in words.spaced(text) for w in (words.stem(lump), lump[len(words.stem(lump)) :]) if w]

    for most in (1, 40, wordtable.BATCH):
        monkeypatch.setattr(wordtable, "BATCH", most)
        for step in (1, 7, 1000):
            source = [rows.slice(k, step) for k in range(0, len(texts), step)]
            for split, want in ((codec.splitter(BYTES), lumps), (lattice.WORDS, lambda x: x.encode().lower().split())):
                got, ids = [], []
                for b in wordtable.batches(iter(source), split, 8):
                    ids += [r[0] for r in b.rows]
                    cut = np.cumsum([0, *b.sizes])
                    got += [[b.words[i] for i in b.flat[x:y]] for x, y in itertools.pairwise(cut)]
                assert ids == list(range(len(texts)))
                assert got == [want(x or "") for x in texts.to_pylist()]


def test_letters_go_to_the_model_alone():
    library = Tokenizer.from_file(BYTES)
    asked = ["a", " a", "the", " THE", " endoftext", "é", " é", "a1", " .", "x's", "'s", " ", "\n", "w" * 300]
    assert codec.word_ids(asked, BYTES) == [library.encode(w, add_special_tokens=False).ids for w in asked]
