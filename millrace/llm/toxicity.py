"""Toxicity with noisy-channel deobfuscation.

Three models, each bounded in size:

* a character language model: letter trigram counts over all given texts,
* word evidence: for words and word openings of the restored text, how many toxic
  and clean labelled documents hold them; the labelled rows are a bounded sample
  (`MAX_FIT` rows of either label, those with the smallest hash of their id),
* a logistic curve over the strongest evidence of a document, fitted on that
  sample with each document's own share of the evidence taken out.

A token that may be disguised (digits or signs inside letters or at their edges, a
letter twice or more in a row, letters spelled out one by one), however long, is
decoded first: a lattice holds for each sign the letters it may stand for, for each
run of a letter one or two of it, and in spelled-out runs the edges of words;
Viterbi search finds the likeliest path under the trigram model. Where a sign may
be punctuation, a doubled letter plain or a spelled-out run one word, that reading
is kept beside the decoded one. Plain tokens stay as they are.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, kept, saved, smallest
from millrace.llm.words import Cache

#: Bound on the labelled rows of either label that the evidence is counted on.
MAX_FIT = 10_000
#: Documents of a label that must hold a word before it counts as evidence.
LEAST_DOCS = 4
#: What signs may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e",
}
#: Signs between letters that may stand for nothing.
FILL = "*.-_~^'`#%&"
EDGE = "\"'.,;:?)]}>([{<#%&*|_-~`^!$=/\\"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
RANK = {c: i + 1 for i, c in enumerate(LETTERS)}
SIZE = len(LETTERS) + 1  # 0: anything else, and the edge of a word
SPELLED = re.compile(r"(?<![^\s\"'(\[])\S(?:([ ._*\-])\S)(?:\1\S){2,}(?=[\"'.,;:?!)\]]*(?!\S))")
DOUBT = re.compile(r"(.)\1\1|[^\W\d_][0-9@$!|+(<€*.\-_~^'`#%&]+[^\W\d_]|^[0-9@$!|+(<€]+[^\W\d_]|[^\W\d_][0-9@$|+(<€]+$")
#: Tokens whose evidence a worker keeps, and rows that it unpacks at a time.
CACHE, ROWS = 150_000, 512
TWICE = re.compile(r"(.)\1")
THRICE = re.compile(r"(.)\1\1")
#: Runs that the lattice takes alike whatever their length.
RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
#: Signs of EDGE that may stand for a word's first or last letters.
FIRST, LAST = "".join(c for c in EDGE if c in LEET), "$|(<"


def trigrams(docs: DataFrame) -> np.ndarray:
    """Letter trigram counts over all texts, SIZE cubed; each task adds up its own before the shuffle."""

    def run(batches):
        code = np.zeros(0x100, np.int64)
        for c, i in RANK.items():
            code[ord(c)] = i
            if len(c.upper()) == 1 and ord(c.upper()) < 0x100:
                code[ord(c.upper())] = i
        total = np.zeros(SIZE**3, np.int64)

        def add(text: str) -> None:
            x = code[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]  # others count as no letter
            if len(x) > 2:
                y = x[:-2] * SIZE
                y += x[1:-1]
                y *= SIZE
                y += x[2:]
                np.add(total, np.bincount(y, minlength=SIZE**3), out=total)

        for b in batches:
            held, size = [], 0
            for text in b.column(0).to_pylist():
                for k in range(0, len(text or ""), 1 << 18):  # the whole text, a stretch at a time
                    held.append(text[k : k + (1 << 18)])
                    size += len(held[-1])
                    if size > 1 << 18:
                        add("\n".join(held))
                        held, size = [], 0
            add("\n".join(held))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3)
    out[rows.gram.to_numpy(np.int64)] = rows.n.to_numpy(float)
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), each trigram backed by its bigram and letter frequencies."""
    c3 = counts.reshape(SIZE, SIZE, SIZE)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIZE)
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def lattice(token: str, loose: int = 0, split: bool = False) -> list[list[tuple[str, float]]]:
    """What each sign or run of a disguised token may stand for, and its log weight.

    Of the first `loose` signs any may stand for nothing; split: there may be spaces between letters."""
    steps: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(token):
        c, r = token[k], 1
        while k + r < len(token) and token[k + r] == c:
            r += 1
        if c in RANK:
            options = [(c, 0.0 if r == 1 else -0.5), (c + c, -0.2 if r == 2 else -1.0)] if r > 1 else [(c, 0.0)]
            if split and r > 1:
                options.append((f"{c} {c}", -0.2 if r == 2 else -1.0))
        elif c in LEET:
            options = [(x * y, -1.5 - 0.5 * (y > 1)) for x in LEET[c] for y in ((1, 2) if r > 1 else (1,))]
            if k < loose:
                options.append(("", -0.5))
        else:
            options = [("", -0.5 if c in FILL else -6.0)]
        if split and k:
            options += [(" " + x, cost) for x, cost in options if x]
        steps.append(options)
        k += r
    return steps


def decode(token: str, logp: np.ndarray, loose: int = 0, split: bool = False) -> str:
    """Likeliest word behind a disguised token: Viterbi search through its lattice."""
    steps = lattice(token, loose, split)
    value = logp.item
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # the text as a chain of (before, part)
    for options in steps:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, text) in best.items():
            for out, cost in options:
                x, y, s = a, b, score + cost
                for c in out:
                    z = RANK.get(c, 0)
                    s += value(x, y, z)
                    x, y = y, z
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, (text, out) if out else text)
        best = new
    _, text = max(((s + value(a, b, 0), t) for (a, b), (s, t) in best.items()), key=lambda x: x[0])
    parts = []
    while text:
        text, out = text
        parts.append(out)
    return "".join(reversed(parts))


class Restorer:
    """Restored forms of a text's words."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp

    def forms(self, token: str) -> list[str]:
        """The word behind a token, and what else it may be."""
        core = token.strip(EDGE)
        if core == token and token.isalpha() and not TWICE.search(token):
            return [token]
        if not core:
            return [""]
        start = token.index(core)
        lead, tail = token[:start], token[start + len(core) :]
        lead = RUN.sub(r"\1\1\1", lead[len(lead.rstrip(FIRST)) :])
        tail = RUN.sub(r"\1\1\1", tail[: len(tail) - len(tail.lstrip(LAST))])
        short = RUN.sub(r"\1\1\1", core)
        if short.isalpha() and not THRICE.search(short):
            out = [core]
            if TWICE.search(short):
                out.append(decode(short, self.logp))
        else:
            out = [decode(short, self.logp) if self.doubtful(short) else core]
        for a, b in {(lead, ""), ("", tail), (lead, tail)} - {("", "")}:
            if self.doubtful(a + short + b):
                out.append(decode(a + short + b, self.logp, len(a.rstrip(a[-1])) if a else 0))
        return out

    @staticmethod
    def doubtful(token: str) -> bool:
        return bool(DOUBT.search(token)) and sum(map(str.isalpha, token)) * 3 >= len(token)

    def spelled(self, text: str) -> set[str]:
        """Words whose letters stand one by one, such as b a d w o r d: the run as one word, without a one-letter word before it, and cut."""
        out: set[str] = set()
        for m in SPELLED.finditer(text):
            run = RUN.sub(r"\1\1\1", m[0].replace(m[1], ""))
            out.update((decode(run, self.logp), decode(run[1:], self.logp)))
            out.update(decode(run, self.logp, split=True).split())
        return out

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a whole text."""
        text = text.lower()
        return {w for t in set(text.split()) for w in self.forms(t)}.union(self.spelled(text)) - {""}


def marks(word: str) -> list[str]:
    """A word and its openings; a word's own mark starts with a sign that no restored word starts with."""
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) > k)]


def strength(pos, neg, n_pos: int, n_neg: int):
    """Lower bound of the log odds that a document holding the mark is toxic."""
    return np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)) - np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


class Model:
    def __init__(self, logp: np.ndarray, n_pos: int, n_neg: int, evidence: dict[str, tuple[int, int]]):
        self.logp, self.n_pos, self.n_neg, self.evidence = logp, n_pos, n_neg, evidence
        self.curve, self.name = np.array([-3.0, 0, 0, 0]), f"toxicity-{uuid.uuid4().hex}"

    def _strength(self, pos: int, neg: int) -> float:
        """Kept by this model alone, so that it goes with its task; as many entries as a count has values in a bounded sample."""
        if (pos, neg) not in self.strengths:
            self.strengths[pos, neg] = float(strength(pos, neg, self.n_pos, self.n_neg))
        return self.strengths[pos, neg]

    def start(self):
        self.restore, self.strengths = Restorer(self.logp), {}
        self.found = Cache(lambda token: tuple((w, x) for w in self.restore.forms(token) if (x := self.weigh(w))), CACHE)
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("restore", "found", "strengths")}

    def features(self, text: str | None, own: int | None = None) -> list[float]:
        """1, and the strongest, second and third evidence. own: the label that this document added to the evidence itself."""
        text = (text or "").lower()
        if own is None:
            hits = dict(x for pairs in filter(None, map(self.found.__getitem__, set(text.split()))) for x in pairs)
            hits.update((w, self.weigh(w)) for w in self.restore.spelled(text))
        else:
            hits = {w: self.weigh(w, own, 1 - own) for w in self.restore.words(text)}
        return [1.0, *sorted((*hits.values(), 0.0, 0.0, 0.0), reverse=True)[:3]]

    def weigh(self, word: str, less_pos: int = 0, less_neg: int = 0) -> float:
        """Strongest evidence of a word and its openings; 0 if weak."""
        x = max((self._strength(max(0, e[0] - less_pos), max(0, e[1] - less_neg)) for m in marks(word) if (e := self.evidence.get(m))), default=0.0)
        return x if x > 0.5 and word else 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame | None, max_fit: int = MAX_FIT) -> Model:
    """Learn from labelled documents outside the held-out fold; without labels of both kinds every score is low."""
    logp = log_model(trigrams(docs))
    if labels is None:
        return Model(logp, 0, 0, {}).start()
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(fold() != 0)
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for k in (1, 0) for r in smallest(known.where(f"toxic = {k}"), max_fit).collect()], "doc_id long, toxic int")
    # at most 2 * max_fit small rows to broadcast; one text for each, however many rows have its id
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = saved(sample.select("text", "toxic"), "toxic-sample")

    def count(batches):
        restore, total, n = Restorer(logp), {}, [0, 0]
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                n[toxic] += 1
                for m in {m for w in restore.words(text or "") for m in marks(w)}:
                    total.setdefault(m, [0, 0])[toxic] += 1
        total[""] = n  # the documents themselves
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([x[k] for x in total.values()], pa.int64()) for k in (1, 0))], names=["mark", "pos", "neg"])

    counts = sample.mapInArrow(count, "mark string, pos long, neg long").groupBy("mark").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where((F.col("pos") >= LEAST_DOCS) | (F.col("mark") == "")).persist()
    whole = counts.where("mark = ''").first()
    n_pos, n_neg = (whole.pos, whole.neg) if whole else (0, 0)
    if not n_pos or not n_neg:
        return Model(logp, n_pos, n_neg, {}).start()
    c = lambda x: F.col(x) + 0.5
    bound = F.log(c("pos") / (n_pos + 1)) - F.log(c("neg") / (n_neg + 1)) - F.sqrt(1 / c("pos") + 1 / c("neg"))
    rows = counts.where("mark <> ''").withColumn("bound", bound).where("bound > 0.3").collect()  # of 2 * max_fit documents, a share of their words
    counts.unpersist()
    model = Model(logp, n_pos, n_neg, {r.mark: (r.pos, r.neg) for r in rows})

    def weigh(batches):
        m = model.start()
        for b in batches:
            x = [m.features(t, own) for t, own in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(weigh, "toxic int, x array<double>").collect()
    model.curve = _logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float))
    return model


def score(docs: DataFrame, labels: DataFrame | None, max_fit: int = MAX_FIT) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of docs.

    Null and empty texts have no evidence and get the score of such texts. Null
    labels teach nothing; of several labels of a document the highest holds.
    Repeated rows get the same score; extra columns are ignored.
    """
    model = learn(docs, labels, max_fit)

    def run(batches):
        m = kept(model.name, model.start)  # its cache serves the process's later tasks
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            x = np.array([m.features(t) for t in b.column(1).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x))], names=["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
