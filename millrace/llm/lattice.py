"""Language-model scores by subword lattice likelihood.

The vocabulary is that of a given sentencepiece model; its scores are the starting
point of the pieces' probabilities, which a few rounds of expectation maximisation
over the table of distinct training words then fit to the corpus. Every word weighs
alike there, for the lattice has to tell how words look that were not seen. A word's probability is
the sum over all its segmentations, by forward recursion in logarithms, vectorised
over words of one length. A piece that opens a word ends the one before it, so
the pieces' probabilities make a proper distribution over words.

Training documents fall into a few classes, their languages, with a lattice and word counts each. A word seen
in a class has, besides, its own share there by absolute discounting; what that frees goes to
the lattice, and a part of it to the general model G of all classes:
    P_z(w) = max(c_z - D_z, 0) / N_z + D_z V_z / N_z * ((1 - BACK) * lattice_z(w) + BACK * G(w))
with D = n1 / (n1 + 2 n2) from the numbers of words seen once and twice. The class of a scored document is
never looked at: its probability is the sum over all classes, each weighed by its share of the training documents.
Within a text the words before each place speak too: after t tokens, n of them
this word, it has (KAPPA P(w) + n) / (KAPPA + t), the predictive rule of a
Dirichlet prior, so that the product stays the text's marginal probability.
The end of a text is a token of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import wordtable
from millrace.llm.common import fold, saved

ROUNDS = 3
#: Tokens that the corpus weighs against those of the text so far.
KAPPA = 2000.0
#: Classes at most: the commonest values, and one class of all others and of rows without a value.
CLASSES = 8
#: Share of what discounting frees that goes to the general model.
BACK = 0.1
#: Opens a word; no byte of UTF-8.
OPEN = b"\xff"
#: Cells of the lattice worked on at a time.
CELLS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a word's opening as OPEN, and starting log probabilities from the model's scores.

    The scores of a byte-pair vocabulary are ranks, which by Zipf's law stand
    for probabilities of 1 / rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k):
            continue
        name = model.id_to_piece(k)
        raw = bytes([int(name[3:5], 16)]) if model.is_byte(k) else name.replace("▁", "\0").encode().replace(b"\0", OPEN)
        if OPEN in raw[1:] or model.is_byte(k) and raw == OPEN:
            continue
        weight[raw] = weight.get(raw, 0.0) + 1 / (10 + abs(model.get_score(k)))
    for k in range(255):  # any bytes can be spelled
        weight.setdefault(bytes([k]), 1e-6)
    weight.setdefault(OPEN, 1e-3)
    p = np.array(list(weight.values()))
    return list(weight), np.log(p / p.sum())


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = BASE
    return np.multiply.accumulate(out)


class Lattice:
    def __init__(self, path: str, logp: np.ndarray | None = None):
        pieces, start = vocabulary(path)
        self.logp = start if logp is None else logp
        lengths = np.array([len(x) for x in pieces])
        self.longest = int(lengths.max())
        self.lengths = set(lengths.tolist())
        h = np.empty(len(pieces), np.uint64)
        for n in self.lengths:
            at = np.flatnonzero(lengths == n)
            b = np.frombuffer(b"".join(pieces[k] for k in at), np.uint8).reshape(-1, n).astype(np.uint64) + np.uint64(1)
            h[at] = (b * _powers(n)[n - 1 :: -1][:n]).sum(1, dtype=np.uint64)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.may = np.zeros(1 << 20, bool)
        self.may[(h >> np.uint64(44)).astype(np.int64)] = True

    def arcs(self, b: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For spans (i, j): the rows that have a piece there, and which."""
        n, length = b.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * BASE + b[:, j] + np.uint64(1)
        power = _powers(self.longest)
        out = {}
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                if j - i in self.lengths:
                    h = prefix[j] - prefix[i] * power[j - i]
                    rows = np.flatnonzero(self.may[(h >> np.uint64(44)).astype(np.int64)])
                    if len(rows):
                        k = np.searchsorted(self.sorted, h[rows])
                        k[k == len(self.sorted)] = 0
                        hit = self.sorted[k] == h[rows]
                        if hit.any():
                            out[i, j] = rows[hit], self.order[k[hit]]
        return out

    def forward(self, n: int, length: int, arcs, logp: np.ndarray) -> np.ndarray:
        """log sum over segmentations of each prefix, (length + 1) by n."""
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                if (i, j) in arcs:
                    rows, k = arcs[i, j]
                    alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logp[k])
        return alpha

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length at a time as a matrix of bytes, with their places."""
        length = np.array([len(w) + 1 for w in words])
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            step = max(1, CELLS // (n * min(n, self.longest)))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                yield part, np.frombuffer(b"".join(OPEN + words[i] for i in part), np.uint8).reshape(-1, n).astype(np.uint64)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Of each word; a row for each class if the pieces' probabilities are in rows."""
        many = np.atleast_2d(self.logp)
        out = np.empty((len(many), len(words)))
        for at, b in self.groups(words):
            arcs = self.arcs(b)
            for row, logp in zip(out, many, strict=True):
                row[at] = self.forward(*b.shape, arcs, logp)[-1]
        return out.reshape(*self.logp.shape[:-1], len(words))

    def expected(self, words: list[bytes], count: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words' segmentations, times the words' counts."""
        total = np.zeros(len(logp))
        for at, b in self.groups(words):
            n, length = b.shape
            arcs = self.arcs(b)
            alpha = self.forward(n, length, arcs, logp)
            beta = np.full((length + 1, n), -np.inf)
            beta[length] = 0
            weight = count[at]
            for i in range(length - 1, -1, -1):
                for j in range(i + 1, min(length, i + self.longest) + 1):
                    if (i, j) in arcs:
                        rows, k = arcs[i, j]
                        on = logp[k] + beta[j, rows]
                        beta[i, rows] = np.logaddexp(beta[i, rows], on)
                        total += np.bincount(k, np.exp(alpha[i, rows] + on - alpha[length, rows]) * weight[rows], len(total)) if len(k) > 2000 else 0
                        if len(k) <= 2000:
                            np.add.at(total, k, np.exp(alpha[i, rows] + on - alpha[length, rows]) * weight[rows])
        return total


def _cut(texts: pa.Array) -> pa.Array:
    """Words of each text with A-Z lowered; a text without any gives an empty one."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))


def _words(keys: pa.Array, opens: np.ndarray) -> pa.Array:
    there = pc.greater(pc.binary_length(keys), 0).to_numpy(zero_copy_only=False)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(there)))), keys.filter(pa.array(there)))


WORDS = wordtable.Splitter(_cut, _words, raw=True)


def _train_counts(n_classes: int):
    """How often training documents of each class have each word of a batch."""

    def tell(batch: wordtable.Batch) -> np.ndarray:
        of = np.repeat(np.array([k for *_, k in batch.rows]), batch.sizes)
        learn = of >= 0
        return np.bincount(batch.flat[learn].astype(np.int64) * n_classes + of[learn], minlength=len(batch.words) * n_classes).reshape(-1, n_classes).astype(np.uint32)

    return tell


def _tally(blocks, n_classes: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers of the distinct words, and their counts by class."""
    number: dict[bytes, int] = {}
    told = []
    for words, count in blocks:
        told.append((np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), count))
    total = np.zeros((len(number), n_classes), np.int64)
    for at, count in told:
        total[at] += count
    return number, total


def fit(table: DataFrame, path: str, n_classes: int = 1, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces in each class after expectation maximisation over the blocks of (words, counts by class)."""
    logp = np.tile(vocabulary(path)[1], (n_classes, 1))
    for _ in range(rounds):

        def run(source, logp=logp):
            lattice, total = Lattice(path), np.zeros(logp.shape)
            for b in source:
                for block in b.column(0).to_pylist():
                    words, count = wordtable.unpack(block)
                    for z in range(n_classes):
                        there = np.flatnonzero(count[:, z])
                        if len(there):
                            total[z] += lattice.expected([words[k] for k in there.tolist()], np.ones(len(there)), logp[z])
            z, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(at), pa.array(total[z, at])], names=["class", "piece", "n"])

        # one row for each class and piece of the vocabulary at most
        rows = table.select("block").mapInArrow(run, "class long, piece long, n double").groupBy("class", "piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(logp.shape, 0.01)
        n[rows["class"].to_numpy(np.int64), rows.piece.to_numpy(np.int64)] += rows.n.to_numpy(float)
        logp = np.log(n / n.sum(1, keepdims=True))
    return logp


def text_log10(logp: np.ndarray, words: np.ndarray, log_end: np.ndarray, log_class: np.ndarray, kappa: float) -> float:
    """log10 probability of a text, over all classes, from that of words on their own: each word's share grows as the text uses it.

    logp: a row for each class with log10 probabilities of words, words: the text's, as places in it."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    same = words[order]
    first = np.concatenate(([True], same[1:] != same[:-1])) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else first
    again = ~first
    before, distinct, repeated = (np.arange(n) - start)[again], same[first], same[again]
    # a word's first place needs no power, which may underflow
    total = logp[:, distinct].sum(1) + len(distinct) * np.log10(kappa)
    if len(repeated):
        total += np.log10(kappa * 10.0 ** logp[:, repeated] + before).sum(1)
    total += log_class + log_end + np.log10(kappa) - np.log10(kappa + np.arange(n + 1)).sum()
    best = total.max()
    return float(best + np.log10((10.0 ** (total - best)).sum()))


@dataclass(frozen=True)
class Model:
    """What the corpus tells beside the words' counts. Rows of stats: each class, then all; columns: distinct words, tokens, words seen once, words seen twice."""

    logp: np.ndarray
    stats: np.ndarray
    docs: np.ndarray

    @property
    def discount(self) -> np.ndarray:
        n1, n2 = self.stats[:, 2], self.stats[:, 3]
        return np.where(n1 + n2 > 0, np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.95), 0.5)

    @property
    def end(self) -> np.ndarray:
        """Probability of the end token in each class."""
        return (self.docs + 0.5) / (self.stats[:-1, 1] + self.docs + 1)

    @property
    def share(self) -> np.ndarray:
        return self.docs / self.docs.sum() if self.docs.any() else np.full(len(self.docs), 1 / len(self.docs))

    def log10(self, lattice: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P_z(w) by class from the words' lattice log probabilities and counts by class."""
        tokens, discount = self.stats[:, 1], self.discount
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(np.column_stack((count, count.sum(1))).T - discount[:, None], 0) / np.maximum(tokens, 1)[:, None])
            free = np.log(np.where(tokens > 0, np.minimum(1.0, discount * self.stats[:, 0] / np.maximum(tokens, 1)), 1.0))
            by = np.log(tokens[:-1] / tokens[-1] if tokens[-1] else self.share)
        general = np.logaddexp(own[-1], free[-1] + np.logaddexp.reduce(lattice + by[:, None], axis=0))
        out = np.logaddexp(own[:-1], free[:-1, None] + np.logaddexp(np.log(1 - BACK) + lattice, np.log(BACK) + general))
        return (out + np.log1p(-self.end)[:, None]) / np.log(10)


def score(docs: DataFrame, path: str, kappa: float = KAPPA, by: str | None = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row for each row of docs.

    by: the column whose values are the training documents' classes; without such a column they are one class. Held-out rows'
    values are never read. Null and empty texts are the end token alone. If no document is left to
    learn from, counts are zero and the lattice keeps the vocabulary's scores. Words of
    any length are scored whole; repeated rows get equal scores and each count in
    training; extra columns are ignored.
    """
    held_out = F.coalesce(fold() == 1, F.lit(False))
    value = F.col(by).cast("string") if by in docs.columns else F.lit(None).cast("string")
    held = wordtable.steady(docs.select("doc_id", held_out.alias("held_out"), F.when(~held_out, value).alias("class"), "text"))
    common = [r["class"] for r in held.where("class is not null").groupBy("class").count().orderBy(F.desc("count"), "class").limit(CLASSES - 1).collect()]
    n_classes = len(common) + 1
    number = F.lit(len(common))
    for k, name in enumerate(common):
        number = F.when(F.col("class") == name, k).otherwise(number)
    held = held.withColumn("class", F.when(F.col("held_out"), -1).otherwise(number))
    docs_of = np.zeros(n_classes)
    for r in held.where("not held_out").groupBy("class").count().collect():
        docs_of[r["class"]] = r["count"]
    if common and not docs_of[-1]:  # no others
        n_classes, docs_of = n_classes - 1, docs_of[:-1]
    ends = int(docs_of.sum())
    n_buckets = wordtable.buckets(docs)
    extra = ("held_out", "class")
    asked = saved(wordtable.requests(held, WORDS, n_buckets, extra, _train_counts(n_classes)), "lm-asked")

    names = [f"{c}{z}" for z in range(n_classes + 1) for c in "vnab"]

    def table(key: tuple[pa.Scalar, ...], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, count = _tally((wordtable.unpack(r) for b in source for r in b.column("block").to_pylist()), n_classes)
        seen = np.flatnonzero(count.any(1))
        words = list(number)
        for k in range(0, max(1, len(seen)), 50_000):
            at = seen[k : k + 50_000]
            c = np.column_stack((count[at], count[at].sum(1)))
            stats = np.array([(c > 0).sum(0), c.sum(0), (c == 1).sum(0), (c == 2).sum(0)]).T.ravel()
            block = wordtable.pack(([words[i] for i in at.tolist()], count[at]))
            yield pa.RecordBatch.from_pydict({"block": [block]} | {x: [int(y)] for x, y in zip(names, stats, strict=True)})

    seen = saved(asked.groupBy("bucket").applyInArrow(table, "block binary, " + ", ".join(f"{x} long" for x in names)), "lm-words")
    stats = np.array([x or 0 for x in seen.agg(*map(F.sum, names)).first()], float).reshape(-1, 4)
    model = Model(fit(seen, path, n_classes), stats, docs_of)
    types, tokens = (int(x) for x in stats[-1, :2])
    n_train, v_train = tokens + ends, types + (ends > 0)
    scale = np.log10(n_train + 0.5 * (v_train + 1))

    def reply(blocks):
        number, count = _tally(blocks, n_classes)
        log10 = model.log10(Lattice(path, model.logp).log_probability(list(number)), count).T.astype(np.float32)
        c = count.sum(1)

        def value(asked_words):
            at = np.fromiter(map(number.__getitem__, asked_words), np.int64, len(asked_words))
            return c[at], log10[at]

        return value

    def assemble(rows, sizes, places, bucket, values):
        order = wordtable.order_of(bucket)
        count, log10 = np.zeros(len(bucket), np.int64), np.empty((len(bucket), n_classes))
        if len(order):
            told = [v for _, v in sorted(values.items(), key=lambda x: x[0])]
            count[order], log10[order] = (np.concatenate([v[k] for v in told]) for k in (0, 1))
        base, known, log10 = np.log10(count + 0.5), count > 0, np.ascontiguousarray(log10.T)
        log_end, log_class = np.log10(model.end), np.log10(model.share)
        cut = np.concatenate(([0], np.cumsum(sizes)))
        out = []
        for (doc_id, held_out, _), a, b in zip(rows, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            at = places[a:b]
            n = len(at) + 1
            out.append((doc_id, held_out, n, int(known[at].sum()) + (ends > 0), n_train, float(base[at].sum() + np.log10(ends + 0.5) - n * scale), text_log10(log10, at, log_end, log_class, kappa)))
        types = (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    body = wordtable.bodies(held, WORDS, n_buckets, extra)
    return wordtable.assemble(body, wordtable.answers(asked, reply), assemble, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
