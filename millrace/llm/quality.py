"""Quality rules: boosted trees over document statistics.

The trees are fitted on the driver on a bounded sample of labelled documents
(`MAX_FIT` rows, those with the smallest hash of their id) and flattened into
numpy node arrays, which score whole batches at a time. Chosen features carry a
monotonic constraint: more repetition or more symbols never raises the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import kept, saved, smallest

#: Bound on the labelled rows that the trees are fitted on.
MAX_FIT = 20_000
#: Probability of good quality from which a document is kept.
KEEP_FROM = 0.3
#: Rows that a worker unpacks at a time.
ROWS = 512
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature and the direction in which it may move the score: 1 up, -1 down, 0 either.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0,
    "digit_share": 0, "mark_share": -1, "distinct_share": 0, "mean_line": 0, "top_word_share": 0, "alpha_share": 0,
}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the features of one whole text; a null text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    held = lambda these: len(raw) - len(raw.translate(None, these))  # noqa: E731  how many of these ASCII characters
    words = raw.split()  # at ASCII space and \x09-\x0D, nothing else
    n = len(words)
    word_chars = len(text) - held(b" \t\n\r\x0b\x0c")
    symbols = held(SYMBOLS.encode())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    for w in words:
        number.setdefault(w, len(number))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    repeated = 0
    if n > 2:
        k = len(number)
        if k < 2_000_000:
            windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        else:  # three numbers no longer fit into 63 bits: number the pairs first
            pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * k + ids[2:]
        _, back, seen = np.unique(windows, return_inverse=True, return_counts=True)
        if (hit := seen[back] > 1).any():
            at = np.zeros(n, bool)
            for shift in range(3):
                at[shift : n - 2 + shift] |= hit
            repeated = int(at.sum())
    size = max(1, len(text))
    upper, digits, marks = held(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), held(b"0123456789"), held(b"!?|")
    top = int(np.bincount(ids).max()) if n else 0
    features = [
        float(np.log1p(n)), word_chars / max(1, n), symbols / size, dup / max(1, len(lines)), repeated / max(1, n), upper / size,
        digits / size, marks / size, len(number) / max(1, n), n / max(1, len(lines)), top / max(1, n),
        1 - (symbols + digits + marks) / max(1, word_chars),
    ]
    return [n, word_chars, symbols, dup, repeated], features


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts and an array of features for every document."""

    def run(batches):
        kept("quality", dict)  # frees what other operators kept
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            found = [statistics(x) for x in b.column(1).to_pylist()]
            counts = np.array([x[0] for x in found], np.int64).reshape(-1, len(COUNTS))
            features = pa.array([x[1] for x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts.T), features], names=["doc_id", *COUNTS, "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


class Trees:
    """Flat node arrays: a node holds feature, threshold, children and value; leaves point to themselves."""

    def __init__(self, base: float):
        self.base, self.depth, self.roots = base, 0, []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def node(self, value: float) -> int:
        k = len(self.value)
        for column, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, k), (self.right, k), (self.value, value)):
            column.append(x)
        return k

    def probability(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = map(np.asarray, (self.feature, self.threshold, self.left, self.right, self.value))
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            raw += value[at]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Newton boosting of log loss on binned features, with monotonic constraints.

    A split on a constrained feature must order its children's values by the
    sign; the midpoint then bounds the values of everything below either child.
    """
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    trees = Trees(float(np.log(share / (1 - share))))
    trees.depth = depth
    if len(set(y.tolist())) < 2:
        return trees
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    raw = np.full(len(y), trees.base)

    def grow(rows, g, h, level, low, high):
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + ridge), low, high))
        k = trees.node(value * rate)
        best = None
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl = (np.bincount(b, v[rows], len(e) + 1).cumsum()[:-1] for v in (g, h))
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                n = np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
                gain[(n < least) | (len(rows) - n < least) | (signs[j] * (vr - vl) < 0)] = 0
                c = int(gain.argmax())
                if gain[c] > 1e-6 and (best is None or gain[c] > best[0]):
                    best = (gain[c], j, c, vl[c], vr[c])
        if best is None:
            at.append((rows, value * rate))
            return k
        _, j, c, vl, vr = best
        mid, go = (vl + vr) / 2, binned[rows, j] <= c
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[j]]
        trees.feature[k], trees.threshold[k] = j, float(edges[j][c])
        trees.left[k] = grow(rows[go], g, h, level + 1, *bounds[0])
        trees.right[k] = grow(rows[~go], g, h, level + 1, *bounds[1])
        return k

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        at: list = []
        trees.roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        for rows, value in at:
            raw[rows] += value
    return trees


def judge(docs: DataFrame, labels: DataFrame | None, max_fit: int = MAX_FIT, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the five counts, base_failed, quality (probability) and kept, one row for each row of docs.

    A null or empty text has zero counts and fails the base rules. Labels that
    are null, or of documents that are not there, teach nothing; without labels
    of both kinds the verdict is that of the base rules. Of several texts of one
    doc_id the one whose statistics come first in order teaches. Extra columns of either
    table are ignored. A repeated row is judged as often as it stands there.
    """
    stats = saved(measure(docs), "quality")
    trees = Trees(float("inf"))
    if labels is not None:
        known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        rows = smallest(known.join(stats.groupBy("doc_id").agg(F.min("features").alias("features")), "doc_id"), max_fit).select("quality", "features").collect()
        y = np.array([r.quality > 0 for r in rows], float)
        if len(set(y.tolist())) == 2:
            trees = fit(np.array([r.features for r in rows]), y, list(FEATURES.values()))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    columns = [c for c in stats.columns if c != "features"]

    def run(batches):
        for b in batches:
            x = np.array(b.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(trees.probability(x))], names=[*columns, "quality"])

    scored = stats.mapInArrow(run, ", ".join(f"{c} long" for c in columns) + ", quality double")
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= keep_from))
