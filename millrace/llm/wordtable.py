"""Join texts with a table of their distinct words, by position, without a row for each word.

A batch is a run of documents of one partition, at most `BATCH` characters and at
least one document. It gives

* requests: its distinct words, dealt to buckets by hash, one compressed block
  for each bucket;
* a body: for each document the numbers of its words within the batch, in order.

Bucket tasks see the blocks of all batches, treat each distinct word once, and
answer each block with one value for each of its words, in the block's order.
Batch tasks then put body and answers together. A bucket holds a share of the
distinct words of each batch, however often a word occurs, so a frequent word
weighs as much as a rare one. The number of buckets follows the input's size.

Requests and bodies come from two runs over the same documents, which `steady` has
written first unless they come straight from files; a batch's id is
a digest of its documents' ids and its distinct words in their order. Batches with
the same id ask for the same words, so that any of their answers serves all of
them, and each body is put together on its own. A batch with fewer or more answers
than bodies raises an error.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import saved

#: Characters of a batch.
BATCH = 12_000_000
#: Characters of input for each bucket.
BUCKET = 16_000_000


def pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def unpack(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def steady(docs: DataFrame) -> DataFrame:
    """docs such that a second run, or a task run again, meets the same rows in the same order: written first, unless
    all that stands between the files and them are projections and filters that give the same each time."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    nodes = [x.lstrip(" :+-").split(" ")[0].split("[")[0] for x in plan.toString().splitlines()]
    if plan.deterministic() and set(nodes) <= {"Project", "Filter", "Relation"}:
        return docs
    return saved(docs, "word-docs")


def buckets(docs: DataFrame, least: int = 64, share: int = BUCKET) -> int:
    n = docs.select(F.sum(F.length("text")).alias("n")).first().n or 0
    return max(least, -(-n // share))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass(frozen=True)
class Splitter:
    """How texts fall apart: cut gives the keys of each text of an array as a list array, parts the words of distinct keys.

    parts takes keys and which of them open a text, and gives a list array of words. raw: words are bytes."""

    cut: Callable[[pa.Array], pa.Array]
    parts: Callable[[pa.Array, np.ndarray], pa.Array]
    raw: bool = False


class Batch:
    """Rows and the keys of their texts, as Arrow arrays until `seal`, which sets

    words: the distinct words in the order of first use, key: the batch's id, bucket: each word's bucket,
    sizes: how many words each document has, flat: the numbers of all of them."""

    def __init__(self, split: Splitter):
        self.split = split
        self.rows, self.keys, self.size = [], [], 0

    def add(self, rows: list[tuple], texts: pa.Array, size: int) -> None:
        self.rows += rows
        self.keys.append(self.split.cut(texts))
        self.size += size

    def seal(self, n_buckets: int) -> Batch:
        lists = pa.concat_arrays(self.keys)
        self.keys = []
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        flat, keys = coded.indices.to_numpy().copy(), coded.dictionary
        at = (np.cumsum(sizes) - sizes)[sizes > 0]
        first, inverse = np.unique(flat[at], return_inverse=True)
        flat[at] = -1
        inside = np.flatnonzero(np.bincount(flat + 1, minlength=len(keys) + 1)[1:])  # keys that do not open texts alone
        number = np.zeros(len(keys) + 1, np.int64)
        number[inside] = np.arange(len(inside))
        flat = number[flat]
        flat[at] = len(inside) + inverse
        chosen = np.concatenate((inside, first))
        lists = self.split.parts(keys.take(pa.array(chosen)), np.arange(len(chosen)) >= len(inside))
        coded = lists.flatten().dictionary_encode()
        flat, sizes = spread(flat, sizes, coded.indices.to_numpy(), lists.value_lengths().to_numpy().astype(np.int64))
        raw = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        self.words = raw if self.split.raw else coded.dictionary.to_numpy(zero_copy_only=False)
        self.sizes, self.flat = sizes.tolist(), flat.astype(np.int32)
        h = hashes(raw.tolist())
        name = xxhash.xxh3_128(h.tobytes())
        name.update(repr(self.rows).encode())
        self.key, self.bucket = name.hexdigest(), (h % np.uint64(n_buckets)).astype(np.int64)
        return self


def spread(flat: np.ndarray, sizes: np.ndarray, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What numbers stand for, in their places: number k for n[k] entries of `of`, which has those of 0 first. And how many there are for each document."""
    length, start = n[flat], np.cumsum(n) - n
    end = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(end[-1]) + np.repeat(start[flat] - end[:-1], length)
    return of[at], np.diff(end[np.concatenate(([0], np.cumsum(sizes)))])


def batches(source: Iterator[pa.RecordBatch], split: Splitter, n_buckets: int) -> Iterator[Batch]:
    """Sealed batches over (doc_id, extra..., text)."""
    now = Batch(split)
    for b in source:
        texts = b.column(b.num_columns - 1)
        texts = pc.if_else(texts.is_valid(), texts, "").cast(pa.large_string())  # an array of its own: some kernels misread a cast slice
        size = (pc.utf8_length(texts).to_numpy(zero_copy_only=False) + 1).tolist()
        rows = list(zip(*(c.to_pylist() for c in b.columns[:-1]), strict=True))
        start, held = 0, now.size
        for k, n in enumerate(size):
            if (now.rows or k > start) and held + n > BATCH:
                if k > start:
                    now.add(rows[start:k], texts.slice(start, k - start), sum(size[start:k]))
                yield now.seal(n_buckets)
                now, start, held = Batch(split), k, 0
            held += n
        if len(size) > start:
            now.add(rows[start:], texts.slice(start), sum(size[start:]))
    if now.rows:
        yield now.seal(n_buckets)


BLOCK = "batch string, bucket long, block binary"


def _block(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["batch", "bucket", "block"])


def requests(docs: DataFrame, split: Splitter, n_buckets: int, extra: tuple[str, ...] = (), tell: Callable[[Batch], np.ndarray] | None = None) -> DataFrame:
    """A block of (words, what `tell` says of each) for each batch and bucket that has words."""

    def run(source):
        for b in batches(source, split, n_buckets):
            told = tell(b) if tell else None
            order = order_of(b.bucket)
            there, start = np.unique(b.bucket[order], return_index=True)
            out = []
            for k, at in zip(there.tolist(), np.split(order, start[1:]) if len(order) else (), strict=True):
                out.append((b.key, k, pack((b.words[at].tolist(), None if told is None else told[at]))))
            yield _block(out)

    return docs.select("doc_id", *extra, "text").mapInArrow(run, BLOCK)


def bodies(docs: DataFrame, split: Splitter, n_buckets: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """The documents of each batch, under bucket -1."""

    def run(source):
        for b in batches(source, split, n_buckets):
            small = len(b.words) <= 1 << 16
            yield _block([(b.key, -1, pack((b.rows, b.sizes, b.flat.astype(np.uint16) if small else b.flat, b.bucket.astype(np.int32))))])

    return docs.select("doc_id", *extra, "text").mapInArrow(run, BLOCK)


def answers(asked: DataFrame, reply: Callable[[Iterator], Callable[[list], object]]) -> DataFrame:
    """For each bucket: reply(its blocks, as words and what was told of them) makes a function of one
    block's words that gives their values, in order."""

    def run(key: tuple[pa.Scalar, ...], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(r["batch"], r["block"]) for b in source for r in b.to_pylist()]
        bucket = key[0].as_py()
        value = reply(unpack(block) for _, block in held)
        for batch, block in held:
            yield _block([(batch, bucket, pack(value(unpack(block)[0])))])

    return asked.groupBy("bucket").applyInArrow(run, BLOCK)


def assemble(body: DataFrame, answered: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(rows, sizes, places, bucket of each word, {bucket: values}) gives a record batch for each body."""

    def run(key: tuple[pa.Scalar, ...], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values, times = [], {}, Counter()
        for b in source:
            for r in b.to_pylist():
                if r["bucket"] < 0:
                    held.append(r["block"])
                else:
                    times[r["bucket"]] += 1
                    if r["bucket"] not in values:
                        values[r["bucket"]] = unpack(r["block"])
        if not held:
            raise RuntimeError(f"batch {key[0]} came back without its documents: they were read differently the second time")
        for block in held:
            whole = unpack(block)
            if times != dict.fromkeys(np.unique(whole[3]).tolist(), len(held)):
                raise RuntimeError(f"batch {key[0]} came back incomplete: its documents were read differently the second time")
            yield finish(*whole, values)

    return body.unionByName(answered).groupBy("batch").applyInArrow(run, schema)


def order_of(bucket: np.ndarray) -> np.ndarray:
    """Word numbers in the order of buckets and, within a bucket, of its block."""
    return np.argsort(bucket, kind="stable")
