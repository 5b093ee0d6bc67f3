"""N-gram Jaccard join by a partition of the shingle universe, exact.

Sets of distinct word shingles link if 100 |A & B| >= 75 |A | B|, so that linked sets
of a and b shingles differ in at most (a + b) / 7. Sets are banded by size; in the
scheme of a band, hashing deals the universe to segments. A set takes part in the
scheme of its own band and, where a partner may stand there, of the band below.

What is indexed of a set in a scheme is allotted by cost. A segment has the level of
its rarest shingle, estimated on a bounded sample of texts; 0 is not known to be
frequent. The rungs of a ladder, cheapest first, are

* the segments of level 0, each as a whole: its subset's signature;
* their one-deletion neighbourhoods besides: for a segment with two or more shingles
  of that level, the signature of each subset with one shingle left out;
* the same for level 1, 2 and so on.

On a rung a segment counts 1, or 2 with its neighbourhood. A set climbs until its
segments count more than it may differ in from a partner, and indexes all rungs up
to there. Of a linked pair the set that stops first has a segment that differs less
than it counts: by nothing, so that both have it whole, or by one shingle, so that
one's whole segment is in the other's neighbourhood. The other set has that
rung too, for levels depend on the segments alone. Where even the last rung falls short
the set goes to the finest partition, where each shingle is a segment: it can
spare |A| - ceil(0.75 |A|) of them and indexes one more, rarest first; two
such sets share one.

The sample steers cost only; the guarantee holds for any. Copies are one set from the
start. Small groups of a signature give pairs, which stay candidates if they met as
often as a link implies. In a large group only the sets count that have more
signatures in large groups than they can spare; each is tied to the group's first
set. The candidates' connected components are then settled exactly: a task has the
shingles of whole components, makes one index of them, and looks sets up in it, each
with all overlaps at once, until all sets not looked up belong together. A component too large for a
task is dealt to several; there, rounds of more and more sets are looked up in all of its
blocks, with the same end. So n near copies of one text cost one look-up of n
overlaps and not n squared pairs, and no pair is left unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, kept, saved

WORDS = 5
#: Groups of a signature up to this size give all their pairs.
SMALL = 12
#: Texts of the frequency estimate, about, and bound on the shingles it gives.
SAMPLE, FREQUENT = 4_000, 20_000
#: A shingle has level 1 from this many texts of the sample, a level more from each four times as many.
OFTEN, LEVELS = 3, 4
#: Characters of input for each bucket of signatures, and the most buckets that are dealt out at once.
BUCKET, FAN = 8_000_000, 4096
#: Sets and signatures, about, of one batch, and rows of text that a worker unpacks at a time.
BATCH, MOST, ROWS = 8_000, 800_000, 256
#: Shingles of the components that one task settles; a component of more is dealt to several.
LIMIT = 2_000_000
#: Rows that may be broadcast: ids and numbers, some 50 bytes each.
SMALL_TABLE = 100_000
#: Sets of a large component looked up in its first round, and in one task.
HUBS, AT_ONCE = 16, 256
#: Bytes of text whose words are hashed at a time, and the longest word that is hashed with others.
SLICE, WORD = 1 << 18, 64
#: Bits of the filter that tells most documents without a candidate before texts are joined.
FILTER = 1 << 26
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _powers(x: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))))


class Shingler:
    """Sorted distinct shingle hashes of texts, many texts at a time.

    A word's hash is the sum of its bytes' numbers times powers of an odd number, so that sums over a whole
    stretch of text give those of all its words; words over WORD bytes, where such sums are weaker, have one of their own."""

    def __init__(self, words: int = WORDS):
        self.words = words
        letters = np.arange(256, dtype=np.uint64)
        letters[65:91] += np.uint64(32)
        self.number = mix(mix((letters + np.uint64(1)) * _MULT) ^ _ODD)
        self.power, self.inverse = _powers(int(_ODD), SLICE + WORD), _powers(pow(int(_ODD), -1, 1 << 64), SLICE + WORD)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first places of the words of data, which has white space at both ends."""
        letters = np.frombuffer(data, np.uint8)
        blank = self.space[letters]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        stop = np.minimum(end, start + WORD)
        h = np.empty(len(start), np.uint64)
        cuts = np.searchsorted(start, np.arange(0, len(letters) + SLICE, SLICE))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                low, high = start[a], stop[b - 1]
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(self.number[letters[low:high]] * self.power[: high - low], out=sums[1:])
                h[a:b] = (sums[stop[a:b] - low] - sums[start[a:b] - low]) * self.inverse[start[a:b] - low]
        h = mix(h + (end - start).astype(np.uint64) * _MULT)
        for k in np.flatnonzero(end - start > WORD):
            h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].lower())
        return h, start

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sets of texts, in their order."""
        out, own, n = [], [], 0
        for t in texts:
            own.append((t or "").encode("utf-8", "surrogatepass"))
            n += len(own[-1])
            if n > 4 * SLICE:
                out += self._sets(own)
                own, n = [], 0
        return out + self._sets(own)

    def _sets(self, own: list[bytes]) -> list[np.ndarray]:
        h, start = self._words(b" ".join([b"", *own, b""]))
        ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in own]) + 1)
        begins = np.concatenate(([0], ends[:-1]))
        s = self._mixed(h, self.words)
        out = []
        for a, b in zip(begins.tolist(), ends.tolist()):
            x = s[a : b - self.words + 1] if b - a >= self.words else self._mixed(h[a:b], b - a)
            if len(x) > 1:
                x = np.sort(x)
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            out.append(x)
        return out

    @staticmethod
    def _mixed(h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k words."""
        if not k:
            return h[:0]
        n = max(0, len(h) - k + 1)
        s = np.full(n, k, np.uint64)
        for j in range(k):
            s = (s ^ h[j : j + n]) * _MULT
            s ^= s >> np.uint64(31)
        return mix(s)


def shingler(words: int) -> Shingler:
    """Kept in a process, so that its tasks share the tables."""
    return kept(f"shingler-{words}", lambda: Shingler(words))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set as two signed numbers."""
    x = xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else bytes(16)
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


@lru_cache(maxsize=None)  # some 40 bands up to sets of a million
def band(k: int) -> tuple[int, int, int]:
    """Sizes from lo up to, not including, hi; number of segments of the band's scheme."""
    lo = 1 if k == 0 else band(k - 1)[1]
    hi = max(lo + 1, lo * 4 // 3)
    m = (hi - 1) // 3 + 1
    while m < 4 * lo and any(m * (1 - np.exp(-n / m)) < 1.15 * (n // 3 + 1) + 1 for n in (lo, hi - 1)):
        m += max(1, m // 20)
    return lo, hi, m


@lru_cache(maxsize=1 << 14)
def schemes(n: int) -> list[tuple[int, int, int]]:
    """Schemes of a set of n shingles: its own band's and that of the band below if a partner may be there.

    Each with its number of segments and the most in which the set may differ from a partner there."""
    k = 0
    while band(k)[1] <= n:
        k += 1
    out = [(k, band(k)[2], (n + n * 4 // 3) // 7)]
    if k and 3 * n <= 4 * (band(k)[0] - 1):
        out.append((k - 1, band(k - 1)[2], (n + band(k)[0] - 1) // 7))
    return out


def _level(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    names, levels = frequent
    out = np.zeros(len(shingles), np.int64)
    if len(names):
        near = np.arange(len(shingles))
        if len(shingles) > len(names):  # most are told from all names by their first bits
            there = np.zeros(1 << 20, bool)
            there[names >> np.uint64(44)] = True
            near = np.flatnonzero(there[shingles >> np.uint64(44)])
        at = np.searchsorted(names, shingles[near])
        at[at == len(names)] = 0
        hit = names[at] == shingles[near]
        out[near[hit]] = levels[at[hit]]
    return out


def signatures(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """All signatures of one set, and how many of them it can spare: as long as no more than so many
    stand in large groups, each linked partner shares one that does not."""
    n = len(shingles)
    level = _level(shingles, frequent)
    mixed = mix(shingles ^ _MULT)
    out, spare, short = [], 1 << 30, False
    for k, m, most in schemes(n):
        segment = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        # shingles are sorted, so that segments, taken from the high bits, are runs
        start = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        rarest = np.minimum.reduceat(level, start)
        salt = segment[start] * _MULT + np.uint64(k)
        whole = np.add.reduceat(mixed, start)
        free = rarest == 0
        out.append(mix(whole[free] ^ salt[free]))
        left = int(free.sum()) - most - 1
        if left >= 0:
            spare = min(spare, left)
            continue
        spare = 0
        owner = np.repeat(np.arange(len(start)), np.diff(np.concatenate((start, [n]))))
        for now in range(LEVELS):
            if now:
                more = rarest == now
                out.append(mix(whole[more] ^ salt[more]))
                count = int((rarest <= now).sum()) + int(rich.sum())
                if count > most:
                    break
            rich = np.add.reduceat((level <= now).astype(np.int64), start) > 1  # whatever is left out, the rest has this level
            own = owner[rich[owner]]
            out.append(mix((whole[own] - mixed[rich[owner]]) ^ salt[own]))
            if int((rarest <= now).sum()) + int(rich.sum()) > most:
                break
        else:
            short = True
    if short:
        need = n - -(-3 * n // 4) + 1
        order = np.lexsort((mix(shingles), level))[:need]
        out.append(mix(shingles[order] ^ _ODD))
    return np.concatenate(out), spare


def laid(sets: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets, none of them empty, the number of the set that each is of, and how many each set can spare: see `signatures`.

    The first rung, which suffices for most, is found for all sets at once."""
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    mixed, often = mix(flat ^ _MULT), _level(flat, frequent) > 0
    high = flat >> np.uint64(32)
    own = [schemes(n) for n in size.tolist()]
    spare = np.full(len(sets), 1 << 30)
    sig, of = [], []
    for x in (0, 1):
        k, m, most = np.array([s[x] if len(s) > x else (0, 1, -1) for s in own]).T
        segment = (high * m.astype(np.uint64)[owner]) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1]))))
        free = ~np.logical_and.reduceat(often, start) & (most[owner[start]] >= 0)
        at = start[free]
        whole = np.add.reduceat(mixed, start)[free]
        o = owner[at]
        sig.append(mix(whole ^ (segment[at] * _MULT + k.astype(np.uint64)[o])))
        of.append(o)
        spare = np.minimum(spare, np.where(most >= 0, np.bincount(o, minlength=len(sets)) - most - 1, 1 << 30))
    sig, of = np.concatenate(sig), np.concatenate(of)
    short = np.flatnonzero(spare < 0)
    if len(short):
        stays = spare[of] >= 0
        more = [signatures(sets[x], frequent) for x in short.tolist()]
        sig = np.concatenate((sig[stays], *(x for x, _ in more)))
        of = np.concatenate((of[stays], np.repeat(short, [len(x) for x, _ in more])))
        spare[short] = [x for _, x in more]
    return sig, of, spare


def _frequent(docs: DataFrame, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and their levels. Copies count as one text."""
    h = F.xxhash64("text")
    sample = docs.where("text is not null")
    if n > SAMPLE:
        sample = sample.where(h < F.lit(-(1 << 63) + int(SAMPLE / n * (1 << 64))))
    sample = sample.groupBy(h.alias("h")).agg(F.first("text").alias("text")).select("text")

    def run(source):
        shingle = shingler(words)
        for b in source:
            for k in range(0, b.num_rows, ROWS):
                for s in shingle.many(b.column(0).slice(k, ROWS).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["s"])

    rows = sample.mapInArrow(run, "s long").groupBy("s").count().where(f"count >= {OFTEN}").orderBy(F.desc("count"), "s").limit(FREQUENT).toPandas()
    names = rows["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    levels = np.minimum(LEVELS - 1, 1 + np.log(rows["count"].to_numpy(float) / OFTEN) // np.log(4)).astype(np.int64)
    return names[order], levels[order]


#: Signatures of a batch in a bucket; rows of docs and sets of large groups under numbers below 0.
RECORD = "bucket long, block binary"
#: A row of docs (doc_id, n, the set's digest as k1, k2, and its spare number, -1 where it isn't told), a pair (k1 of a and b), or a set of a large group (a, in sig).
FOUND = "doc_id long, n long, k1 long, k2 long, spare long, sig long, a long, b long, met long"
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _found(length: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(length, pa.int64())) for x in NAMES], names=NAMES)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def _blocks(sig: np.ndarray, bucket: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Signatures by bucket, in whose order they come, 48 bits of each, with the keys of their sets. Sizes and spare numbers
    stay with the rows, since at many buckets a block has each set once or twice, and what stands beside a signature is what is sent."""
    start = _starts(bucket)
    seen = np.zeros(len(keys), "<u4")
    for k, a, b in zip(bucket[start].tolist(), start.tolist(), [*start[1:].tolist(), len(sig)]):
        low, own = sig[a:b], owner[a:b]
        seen[own] = 1
        there = np.flatnonzero(seen) if 8 * len(own) > len(seen) else np.unique(own)
        seen[there] = np.arange(len(there))
        back = seen[own]
        seen[there] = 0
        wide = "<u2" if len(there) <= 1 << 16 else "<u4"
        yield k, b"".join((np.array([len(there), len(low), int(wide[2])], "<u4").tobytes(), keys[there].tobytes(), back.astype(wide).tobytes(), (low >> np.uint64(32)).astype("<u2").tobytes(), low.astype("<u4").tobytes()))


def _open(block: bytes) -> tuple[np.ndarray, ...]:
    """Keys of a block, and of each record the signature and the place of its key."""
    n, m, wide = np.frombuffer(block, "<u4", 3).tolist()
    at = 12
    parts = []
    for count, kind in ((n, "<i8"), (m, f"<u{wide}"), (m, "<u2"), (m, "<u4")):
        parts.append(np.frombuffer(block, kind, count, at))
        at += count * np.dtype(kind).itemsize
    keys, back, high, low = parts
    return keys, high.astype(np.uint64) << np.uint64(32) | low, back


def _ordered(sig: np.ndarray, top: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order of signatures by as many of their bits, the top or the lowest, as fit beside a place, and these bits in it. One sort of
    numbers, which takes a quarter of the time of one for places."""
    bits = np.uint64(max(1, len(sig)).bit_length())
    both = np.sort((sig >> bits << bits if top else sig << bits) | np.arange(len(sig), dtype=np.uint64))
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits


def _gathered(blocks: list[bytes], alone: bool = False) -> tuple[np.ndarray, ...]:
    """Records of blocks by signature and key, copies of a set once, and where each signature's group starts. alone: also those of one record."""
    keys, sig, own = [], [], []
    n = 0
    for block in blocks:
        key, s, back = _open(block)
        keys.append(key)
        sig.append(s)
        own.append(back + np.uint32(n))
        n += len(key)
    keys, sig, own = np.concatenate(keys), np.concatenate(sig), np.concatenate(own)
    if not alone:  # most signatures are of one set only
        order, bits = _ordered(sig, top=False)
        same = np.concatenate(([False], bits[1:] == bits[:-1], [False]))
        order = order[same[1:] | same[:-1]]
        sig, own = sig[order], own[order]
    own = keys[own]
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    fresh = np.concatenate((np.ones(min(1, len(sig)), bool), (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])))
    sig, own = sig[fresh], own[fresh]
    return sig, own, _starts(sig)


class Deal:
    """Buckets of signatures: FAN at most at once, each of which is dealt to `fine` ones if there are to be more."""

    def __init__(self, characters: int, share: int = BUCKET, fan: int = FAN):
        wanted = max(64, -(-characters // share))
        self.coarse = min(wanted, fan)
        self.fine = -(-wanted // self.coarse)

    def first(self, sig: np.ndarray) -> np.ndarray:
        """Bucket of each signature, in the order of the signatures."""
        return ((sig >> np.uint64(32)) * np.uint64(self.coarse) >> np.uint64(32)).astype(np.int64)

    def then(self, bucket: int, low: np.ndarray) -> np.ndarray:
        return bucket * self.fine + (low % np.uint64(self.fine)).astype(np.int64)

    def name(self, sig: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
        """Name of a signature's group: the bits that blocks keep, and the coarse bucket."""
        return (sig & np.uint64((1 << 48) - 1) ^ np.asarray(bucket).astype(np.uint64) << np.uint64(48)).view(np.int64)


def _records(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], deal: Deal, words: int) -> DataFrame:
    """The rows of docs, and the signatures of their sets, in blocks for each batch and bucket.

    A signature that many sets of a batch have is that of a large group: SMALL + 1 of them go to its bucket, which tell so
    there, and the others straight to the group's sets, so that a bucket gets few of a group from each batch."""
    def run(source):
        shingle = shingler(words)
        held: dict[tuple[int, int], int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        rows: list[tuple[int | None, int, int, int, int]] = []
        total = 0

        def sealed():
            blocks = []
            spare = np.full(1, -1)
            if held:
                keys = np.array([k for k, _ in held], np.int64)
                sig, owner, spare = (np.concatenate([x[k] for x in parts]) for k in range(3))
                held.clear()
                parts.clear()
                order, _ = _ordered(sig, top=True)
                sig, owner = sig[order], owner[order]
                start = _starts(sig)
                few = np.arange(len(sig)) - np.repeat(start, np.diff(np.concatenate((start, [len(sig)])))) <= SMALL
                bucket = deal.first(sig)
                blocks += _blocks(sig[few], bucket[few], owner[few], keys)
                many = ~few
                if many.any():
                    part = np.stack((deal.name(sig[many], bucket[many]), keys[owner[many]]))
                    blocks.append((-1 - int(keys[0]) % deal.coarse, b"m" + part.astype("<i8").tobytes()))
            ids = np.array([(0 if i is None else i, i is None, n, -1 if at < 0 else spare[at], a, b) for i, n, at, a, b in rows], "<i8")
            blocks.append((-1 - int(ids[0, 4]) % deal.coarse, b"r" + ids.T.tobytes()))
            rows.clear()
            k, block = zip(*blocks, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(block, pa.binary())], names=["bucket", "block"])

        for part in (b.slice(k, ROWS) for b in source for k in range(0, b.num_rows, ROWS)):
            sets, new = shingle.many(part.column(1).to_pylist()), []
            first = len(held)
            for doc_id, s in zip(part.column(0).to_pylist(), sets, strict=True):
                key, at = set_key(s), -1
                if len(s) and doc_id is not None:
                    at = held.setdefault(key, len(held))
                    if at == first + len(new):
                        new.append(s)
                rows.append((doc_id, len(s), at, *key))
            if new:
                sig, owner, spare = laid(new, frequent)
                parts.append((sig, (owner + first).astype(np.int32), spare))
                total += len(sig)
            if total >= MOST or len(held) >= BATCH or len(rows) >= 50 * BATCH:
                yield sealed()
                total = 0
        if rows:
            yield sealed()

    out = docs.select("doc_id", "text").mapInArrow(run, RECORD)
    if deal.fine == 1:
        return out

    def finer(source):
        """Blocks of some coarse buckets, dealt to their fine ones, a stretch at a time."""
        for b in source:
            blocks, by = [], {}
            for k, x in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
                if k < 0:
                    blocks.append((k, x))
                else:
                    by.setdefault(k, []).append(x)
            for k, opened in by.items():
                sig, own, _ = _gathered(opened, alone=True)
                keys, owner = np.unique(own, return_inverse=True)
                bucket = deal.then(k, sig)
                order = np.argsort(bucket, kind="stable")
                blocks += _blocks(sig[order], bucket[order], owner[order], keys)
            k, block = zip(*blocks, strict=True) if blocks else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(block, pa.binary())], names=["bucket", "block"])

    return out.repartition(deal.coarse, "bucket").mapInArrow(finer, RECORD)


def _grouped(deal: Deal):
    def run(key: tuple[pa.Scalar, ...], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the bucket's small groups, with how often they met, and the sets of its large ones; rows as they are."""
        long = lambda x: pa.array(x.astype(np.int64))
        bucket = key[0].as_py()
        if bucket < 0:
            for b in source:
                for x in b.column("block").to_pylist():
                    if x[:1] == b"m":
                        sig, own = np.frombuffer(x, "<i8", offset=1).reshape(2, -1)
                        yield _found(len(sig), sig=long(sig), a=long(own))
                    else:
                        ids, none, n, spare, k1, k2 = np.frombuffer(x, "<i8", offset=1).reshape(6, -1)
                        yield _found(len(ids), doc_id=pa.array(ids.astype(np.int64), mask=none.astype(bool)), n=long(n), k1=long(k1), k2=long(k2), spare=long(spare))
            return
        sig, own, start = _gathered([x for b in source for x in b.column("block").to_pylist()])
        n = np.diff(np.concatenate((start, [len(sig)])))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for gap in range(1, SMALL):
            first = start[(n > gap) & (n <= SMALL)]
            count = n[(n > gap) & (n <= SMALL)] - gap
            i = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            a.append(i)
            b.append(i + gap)
        i, j = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((own[j], own[i]))
        i, j = i[order], j[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(i)), bool), (own[i][1:] != own[i][:-1]) | (own[j][1:] != own[j][:-1]))))
        met = np.diff(np.concatenate((new, [len(i)])))
        i, j = i[new], j[new]
        yield _found(len(i), a=long(own[i]), b=long(own[j]), met=long(met))
        big = np.repeat(n > SMALL, n)
        whole = deal.name(sig[big], bucket // deal.fine)
        yield _found(len(whole), sig=long(whole), a=long(own[big]))

    return run


def _candidates(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Ties (src, dst) of k1 whose components hold every linked pair. classes: k1, n and spare of each set."""
    large = found.where("sig is not null").select("sig", F.col("a").alias("key")).distinct()
    own = classes.select(F.col("k1").alias("key"), "n", "spare")
    held = large.groupBy("key").agg(F.count("*").alias("held"))
    own = saved(own.join(held, "key", "left").select("key", "n", (F.col("spare") - F.coalesce("held", F.lit(0))).alias("left"), F.col("held").isNotNull().alias("large")), "jaccard-held")
    bound = own.where("large and left < 0").select("key").distinct()
    members = large.select("sig", "key").join(bound, "key")
    first = members.groupBy("sig").agg(F.min("key").alias("src"))
    # a set's ties to the first sets of its groups: one to the first of these, and these to that one, which most sets have in common
    firsts = members.join(first, "sig").groupBy("key").agg(F.array_sort(F.collect_set("src")).alias("firsts"))
    least = F.get("firsts", F.lit(0)).alias("src")
    among = firsts.where("size(firsts) > 1").select(least, F.explode(F.slice("firsts", 2, F.size("firsts"))).alias("dst")).distinct()
    ties = firsts.select(least, F.col("key").alias("dst")).union(among)
    # a pair shares a signature more than either set can spare; those of large groups may be among them
    met = found.where("met is not null").groupBy("a", "b").agg(F.sum("met").alias("met"))
    for x in "ab":
        met = met.join(own.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), "left"), x).where("met > left").drop("left")
    met = met.where("3 * greatest(n_a, n_b) <= 4 * least(n_a, n_b)")
    return met.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(ties)


def _overlaps(flat: np.ndarray, owner: np.ndarray, k: int, shingles: np.ndarray) -> np.ndarray:
    """How many of the shingles each of k sets has; flat holds all sets' shingles in order, owner whose they are."""
    left, right = np.searchsorted(flat, shingles, "left"), np.searchsorted(flat, shingles, "right")
    n = right - left
    at = np.arange(n.sum()) + np.repeat(left - np.cumsum(n) + n, n)
    return np.bincount(owner[at], minlength=k)


def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat, size = np.concatenate(sets), np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    return flat[order], owner[order], size


def settle(sets: list[np.ndarray], percent: int = 75) -> np.ndarray:
    """Number of the first set of each set's component, by exact overlaps."""
    k = len(sets)
    label = np.arange(k)
    if k == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return label * 0 if 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common) else label
    flat, owner, size = _index(sets)
    open_, n_open = np.ones(k, bool), np.ones(k, np.int64)  # not looked up yet, and how many of them each label has
    left = k
    x = 0
    while left and n_open[label[x]] < left:
        common = _overlaps(flat, owner, k, sets[x])
        hit = np.unique(label[100 * common >= percent * (size + size[x] - common)])
        open_[x] = False
        n_open[label[x]] -= 1
        left -= 1
        if len(hit) > 1:
            n_open[hit[0]] = n_open[hit].sum()
            n_open[hit[1:]] = 0
            name = np.arange(k)
            name[hit] = hit[0]
            label = name[label]
        if left:
            most = n_open.argmax()  # next, one that is not with the most of those left
            rest = np.flatnonzero(open_ & (label != most))
            x = int(rest[0]) if len(rest) else int(np.flatnonzero(open_)[0])
    return label


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, k1, k2, ...) with the texts of its documents. A short list is broadcast behind a count of its rows. Of a longer one
    bits of its ids are, FILTER in all, so that of the texts that are not wanted only a few are sorted and sent."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    if wanted.count() <= SMALL_TABLE:
        return docs.join(F.broadcast(wanted), "doc_id")
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    bits = wanted.groupBy(F.bitmap_bucket_number(bit).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = docs.withColumn("__bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "__bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1)
    return near.select("doc_id", "text").join(wanted, "doc_id")


def _meant(rows: list[dict], shingle: Shingler) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """doc_id and shingles by digest: rows of one doc_id may differ or repeat, and only the texts meant count, once each."""
    out = {}
    for k in range(0, len(rows), ROWS):
        for r, s in zip(rows[k : k + ROWS], shingle.many([r["text"] for r in rows[k : k + ROWS]])):
            key = (r["k1"], r["k2"])
            if key not in out and set_key(s) == key:
                out[key] = (r["doc_id"], s)
    return out


def _settled(percent: int, words: int):
    def run(key: tuple[pa.Scalar, ...], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, by = shingler(words), {}
        for b in source:
            rows = b.to_pylist()
            component = {(r["k1"], r["k2"]): r["component"] for r in rows}
            for key, x in _meant(rows, shingle).items():
                by.setdefault(component[key], {})[key] = x
        src, dst = [], []
        for sets in by.values():
            ids = [i for i, _ in sets.values()]
            if len(ids) > 1:
                label = settle([s for _, s in sets.values()], percent)
                at = np.flatnonzero(label != np.arange(len(ids)))
                src += [ids[k] for k in at]
                dst += [ids[k] for k in label[at]]
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _looked_up(percent: int, words: int):
    def run(key: tuple[pa.Scalar, ...], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between the hubs and the sets of a block."""
        rows = [r for b in source for r in b.to_pylist()]
        shingle = shingler(words)
        hubs, sets = ([*_meant([r for r in rows if r["hub"] == x], shingle).values()] for x in (True, False))
        src, dst = [], []
        if sets:
            flat, owner, size = _index([s for _, s in sets])
            ids = np.array([i for i, _ in sets])
            for i, s in hubs:
                common = _overlaps(flat, owner, len(ids), s)
                to = ids[100 * common >= percent * (size + len(s) - common)].tolist()
                src += [i] * len(to)
                dst += to
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _large(docs: DataFrame, sets: DataFrame, percent: int, words: int) -> DataFrame | None:
    """Links that tie together what belongs together in the components of `sets` (component, blocks, doc_id, k1, k2)."""
    sets = saved(sets, "jaccard-large")
    if sets.isEmpty():
        return None
    texts = saved(_texts(docs, sets), "jaccard-large-texts").withColumn("block", F.pmod(F.xxhash64("k2", "k1"), F.col("blocks")))
    names = sets.select("component", "doc_id").distinct()
    edges, done, most = None, None, HUBS
    while True:
        own = names
        if edges is not None:
            own = own.join(components(edges).select(F.col("id").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left")
            own = own.select("component", "doc_id", F.coalesce("label", "doc_id").alias("label"))
        else:
            own = own.withColumn("label", F.col("doc_id"))
        if done is not None:
            own = own.join(done, "doc_id", "left_anti")
        own = saved(own, "jaccard-open")
        counts = own.groupBy("component", "label").agg(F.count("*").alias("n"))
        main = counts.groupBy("component").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1").select("component", F.col("top.label").alias("main"))
        # of the sets not looked up yet, those that are not with the most of them
        free = own.join(main, "component").where("label <> main")
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(most))
        hubs = saved(free.groupBy("component", slot.alias("slot")).agg(F.min("doc_id").alias("doc_id")), "jaccard-hubs")
        if hubs.isEmpty():
            return edges
        chunks = max(1, most // AT_ONCE)
        hub_texts = texts.join(hubs, ["component", "doc_id"])
        hub_texts = hub_texts.select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), (F.col("slot") % chunks).alias("chunk"), F.lit(True).alias("hub"), "doc_id", "k1", "k2", "text")
        block_texts = texts.join(hubs.select("component").distinct(), "component").select("component", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(False).alias("hub"), "doc_id", "k1", "k2", "text")
        new = saved(hub_texts.union(block_texts).groupBy("component", "block", "chunk").applyInArrow(_looked_up(percent, words), "src long, dst long"), "jaccard-edges").where("src <> dst")
        edges = new if edges is None else edges.union(new)
        used = hubs.select("doc_id")
        done = used if done is None else done.union(used)
        most *= 4


def join(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (smallest doc_id with the same set), one row for each row of docs.

    Null and empty texts, and texts of white space alone, have no shingles and
    are components of their own. Texts of fewer words than a shingle have one
    shingle. Repeated rows are copies; rows of one doc_id with different texts tie
    these texts together, as a component is named by ids. A row with a null
    doc_id ties nothing and has the component of its copies, null without any.
    Extra columns are ignored.
    """
    if percent != 75:
        raise ValueError("bands and deletions are laid out for a similarity of 0.75")
    whole = docs.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("n")).first()
    deal = Deal(whole.n or 0)
    records = _records(docs, _frequent(docs, whole.rows, words), deal, words)
    found = saved(records.groupBy("bucket").applyInArrow(_grouped(deal), FOUND), "jaccard-found")
    rows = found.where("k1 is not null").select("doc_id", "n", "k1", "k2", "spare")
    classes = saved(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("spare").alias("spare")), "jaccard-classes")
    tied = components(_candidates(found, classes)).select(F.col("id").alias("k1"), "component")
    wanted = tied.join(classes.where("rep is not null"), "k1").select("component", F.col("rep").alias("doc_id"), "k1", "k2", "n")
    wanted = saved(wanted.join(wanted.groupBy("component").agg(F.sum("n").alias("shingles")), "component"), "jaccard-tied")
    fits = wanted.where(F.col("shingles") <= LIMIT)
    tasks = -(-4 * (fits.agg(F.sum("n")).first()[0] or 1) // LIMIT)
    small = fits.select("component", "doc_id", "k1", "k2", F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"))
    edges = saved(_texts(docs, small).groupBy("task").applyInArrow(_settled(percent, words), "src long, dst long"), "jaccard-edges")
    more = _large(docs, wanted.where(F.col("shingles") > LIMIT).select("component", F.ceil(F.col("shingles") / LIMIT).cast("long").alias("blocks"), "doc_id", "k1", "k2"), percent, words)
    label = components(edges if more is None else edges.union(more)).withColumnRenamed("id", "rep")
    named = classes.join(label, "rep", "left").select("k1", "k2", "rep", F.coalesce("component", "rep").alias("component"))
    out = rows.join(named.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep", "component"), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))
