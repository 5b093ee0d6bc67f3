"""Token counts without tokens: byte-pair merging over a heap and a linked list.

The symbols of a word stand in a linked list; a heap holds the adjacent pairs
that have a merge, lowest rank first and leftmost first among equals. Popping a
pair joins its symbols and pushes the two pairs that arise. Each merge takes one
symbol away, so the count is the number of first symbols less the merges.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import Cache, bare, lowered, stem

#: Words whose counts a worker keeps.
CACHE = 600_000


class Counter:
    """Counts as the tokenizer in a .json file gives them: a byte-level BPE with word ends, lower case, space dropped."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.end = model.get("end_of_word_suffix") or ""
        number = {s: k for k, s in enumerate(model["vocab"])}
        self.number = number
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[number[a], number[b]] = (k, number[a + b])
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: The character that stands for each byte, asked of the library for what occurs in UTF-8.
        self.sign = {}
        for c in map(chr, [*range(0x100), *range(0x100, 0x800, 0x3F), *range(0x800, 0x110000, 0xFFF)]):
            if not 0xD800 <= ord(c) < 0xE000:
                out = "".join(x for x, _ in level.pre_tokenize_str(c))
                self.sign.update(zip(c.encode(), out, strict=True))
        self.words = Cache(self.lump, CACHE)

    def lump(self, lump: str) -> int:
        core = stem(lump)
        if core is not lump:
            return self.words[core] + self.words[lump[len(core) :]]
        if lump.isascii():
            lump = lump.lower()
        else:
            lump = "".join(c.lower() for c in unicodedata.normalize("NFC", lump))  # letter by letter: no final sigma
        return sum(map(self.pretoken, self.pattern.findall(lump)))

    def _sign(self, byte: int) -> str:
        return self.sign[byte]

    def pretoken(self, word: str) -> int:
        chars = [self._sign(b) for b in word.encode()]
        chars[-1] += self.end
        symbols = [self.number[c] for c in chars if c in self.number]
        return len(symbols) - self.merges(symbols)

    def merges(self, symbols: list[int]) -> int:
        n, rank = len(symbols), self.rank
        if n < 2:
            return 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k, symbols[k], symbols[k + 1], r[1]) for k in range(n - 1) if (r := rank.get((symbols[k], symbols[k + 1])))]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != a or j >= n or symbols[j] != b:
                continue  # one of the two has gone into another merge
            symbols[k], symbols[j] = new, -1
            done += 1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if r := rank.get((new, symbols[after[k]])):
                    heapq.heappush(heap, (r[0], k, new, symbols[after[k]], r[1]))
            if (i := before[k]) >= 0 and (r := rank.get((symbols[i], new))):
                heapq.heappush(heap, (r[0], i, symbols[i], new, r[1]))
        return done

    def text(self, text: str) -> int:
        """Tokens of a whole text; a special string inside it is one token, as the library has it."""
        if "<" in text and self.specials.search(text):
            parts = self.specials.split(text)
            return len(parts) // 2 + sum(map(self.text, parts[::2]))
        low = lowered(text)
        return sum(map(self.words.__getitem__, bare(text if low is None else low)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, one row for each row of docs.

    Null and empty texts have no tokens. Texts are counted whole whatever their
    length. Repeated rows count alike; extra columns are ignored.
    """

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = pa.array([c.text(t) for t in texts], pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
