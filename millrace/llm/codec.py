"""Byte-pair encoding and decoding through a table of distinct words.

Texts are split into lumps (see words.py); each distinct lump is encoded once
in its bucket by the tokenizers library, and the ids are joined back by position.
Decoding joins ids with the vocabulary's pieces. A text that holds one of the
tokenizer's special strings is one lump as a whole, as the library treats it.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from millrace.llm import wordtable
from millrace.llm.common import saved
from millrace.llm.words import APART, DOUBLE, EMPTY_OR_ANY, ENDS, spaced, stem, tokenizer


@lru_cache(maxsize=4)
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of pieces: all their bytes, and by id where a piece starts and its length. Byte signs are undone as the library does it."""
    library = tokenizer(path)
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    byte: dict[str, int] = {}
    for c in map(chr, [*range(0x100), *range(0x100, 0x800, 0x3F), *range(0x800, 0x110000, 0xFFF)]):
        if not 0xD800 <= ord(c) < 0xE000:
            byte.update(zip("".join(x for x, _ in level.pre_tokenize_str(c)), c.encode(), strict=True))
    added = library.get_added_tokens_decoder()
    spare = iter(sorted(set(range(256)) - set(byte.values())))
    for sign in sorted({c for t, i in library.get_vocab().items() if i not in added for c in t} - set(byte)):
        byte[sign] = next(spare)  # bytes that UTF-8 never has; their signs follow the bytes' order
    by = {i: t.encode() if i in added else bytes(byte[c] for c in t) for t, i in library.get_vocab().items()}
    size = np.zeros(max(by) + 1, np.int64)
    size[list(by)] = [len(x) for x in by.values()]
    return np.frombuffer(b"".join(by[i] for i in sorted(by)), np.uint8), np.cumsum(size) - size, size


def splitter(path: str) -> wordtable.Splitter:
    """Texts are cut at spaces after a character that is none, which always open a lump: a key has that space before
    it, unless it opens a text. A text with special strings is one key."""

    def whole(text: str) -> bool:
        return any(s in text for s in _specials(path))

    def cut(texts: pa.Array) -> pa.ListArray:
        odd = pc.match_substring_regex(texts, DOUBLE)
        for s in _specials(path):
            odd = pc.or_(odd, pc.match_substring(texts, s))
        if not pc.any(odd).as_py():
            return pc.split_pattern(texts, " ")
        keys = ([x] if whole(x) else APART.split(x) for x in texts.to_pylist())
        return pa.array(list(keys), pa.list_(pa.large_string()))

    def words(key: str, opens: bool) -> list[str]:
        if opens and whole(key):
            return [key]
        out = []
        for lump in spaced(key if opens else " " + key):
            core = stem(lump)
            out += (lump,) if core is lump else (core, lump[len(core) :])
        return out

    def parts(keys: pa.Array, opens: np.ndarray) -> pa.Array:
        """As `words` of each key; those without white space inside a text, nearly all, as arrays."""
        rare = opens | pc.match_substring_regex(keys, EMPTY_OR_ANY).to_numpy(zero_copy_only=False)
        plain, rest = keys.filter(pa.array(~rare)), keys.filter(pa.array(rare)).to_pylist()
        ends = pc.extract_regex(plain, ENDS)
        tails = ends.is_valid().to_numpy(zero_copy_only=False)
        core = pc.if_else(ends.is_valid(), pc.struct_field(ends, "core"), plain)
        odd = [words(k, o) for k, o in zip(rest, opens[rare].tolist(), strict=True)]
        held = pa.concat_arrays([
            pc.replace_substring_regex(core, r"^", " ", max_replacements=1).cast(pa.large_string()),
            pc.struct_field(ends, "tail").filter(pa.array(tails)).cast(pa.large_string()),
            pa.array([w for x in odd for w in x], pa.large_string()),
        ])
        n = np.zeros(len(keys), np.int64)
        n[~rare], n[rare] = 1 + tails, [len(x) for x in odd]
        start = np.cumsum(n) - n
        at = np.empty(n.sum(), np.int64)
        first = start[~rare]
        at[first] = np.arange(len(plain))
        at[first[tails] + 1] = len(plain) + np.arange(tails.sum())
        left = np.ones(len(at), bool)
        left[first] = left[first[tails] + 1] = False
        at[left] = len(plain) + tails.sum() + np.arange(left.sum())
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate((start, [len(at)]))), held.take(pa.array(at)))

    return wordtable.Splitter(cut, parts)


@lru_cache(maxsize=4)
def _alone(path: str) -> bool:
    """Whether the model takes a space and ASCII letters as one pre-token and as they are, the space as its sign: byte level with
    the library's own pattern, no normal form, and no special string that is letters."""
    library = tokenizer(path)
    before = library.pre_tokenizer
    level = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
    return level and library.normalizer is None and isinstance(library.model, BPE) and not any(s.strip().isalpha() for s in _specials(path))


def word_ids(words: list[str], path: str) -> list[list[int]]:
    """Ids of each word; those of ASCII letters go to the library's model directly."""
    library = tokenizer(path)
    direct = [w.isascii() and w.removeprefix(" ").isalpha() and _alone(path) for w in words]
    others = iter(library.encode_batch_fast([w for w, d in zip(words, direct, strict=True) if not d], add_special_tokens=False))
    model = library.model
    return [[x.id for x in model.tokenize(w.replace(" ", "Ġ"))] if d else next(others).ids for w, d in zip(words, direct, strict=True)]


def encoded(docs: DataFrame, path: str, finish, schema: str) -> DataFrame:
    """finish(doc_id, ids as uint32) gives a row of `schema`, for each row of docs."""
    docs = wordtable.steady(docs.select("doc_id", "text"))
    n = wordtable.buckets(docs)
    split = splitter(path)

    def reply(blocks):
        library = tokenizer(path)
        words = list({w for held, _ in blocks for w in held})
        ids: dict[str, bytes] = {}
        for k in range(0, len(words), 20_000):
            part, found = words[k : k + 20_000], word_ids(words[k : k + 20_000], path)
            raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            at = np.cumsum([0, *map(len, found)]) * 4
            ids.update((w, raw[i:j]) for w, (i, j) in zip(part, pairwise(at.tolist()), strict=True))
        wide = library.get_vocab_size() > 1 << 16

        def value(asked):
            blob = [ids[w] for w in asked]
            flat = np.frombuffer(b"".join(blob), "<u4")
            return np.array([len(x) // 4 for x in blob], np.int32), flat if wide else flat.astype("<u2")

        return value

    def assemble(rows, sizes, places, bucket, values):
        held = [v for _, v in sorted(values.items(), key=lambda x: x[0])]
        n_ids = np.concatenate([np.zeros(0, np.int32), *(n for n, _ in held)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint16), *(ids for _, ids in held)])
        order = wordtable.order_of(bucket)
        n, start = np.empty(len(bucket), np.int64), np.empty(len(bucket), np.int64)
        n[order], start[order] = n_ids, np.cumsum(n_ids) - n_ids
        out, a = [], 0
        for row, size in zip(rows, sizes, strict=True):
            at = places[a : a + size]
            a += size
            length = n[at]
            end = np.cumsum(length)
            raw = flat[np.arange(end[-1] if size else 0) + np.repeat(start[at] - end + length, length)].astype("<u4").tobytes()
            out.append(finish(row[0], raw))
        return pa.RecordBatch.from_pylist(out, schema=schema)

    return wordtable.assemble(wordtable.bodies(docs, split, n), wordtable.answers(wordtable.requests(docs, split, n), reply), assemble, _ddl(schema))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit), one row for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return encoded(docs, path, lambda doc_id, raw: {"doc_id": doc_id, "n_tokens": len(raw) // 4, "ids": raw}, schema)


def decoded(raw: bytes, path: str) -> str:
    """Text of ids: each joined with its piece in the table, bytes that are no UTF-8 replaced."""
    flat, start, size = pieces(path)
    ids = np.frombuffer(raw, "<u4")
    n = size[ids]
    at = np.arange(n.sum()) + np.repeat(start[ids] - np.cumsum(n) + n, n)
    return flat[at].tobytes().decode("utf-8", "replace")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of a table of doc_id and ids."""

    def run(source):
        for b in source:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decoded(x, path) for x in b.column(1).to_pylist()])], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def decode_joined(ids: DataFrame, path: str) -> DataFrame:
    """As decode, by rows: every id is a row that meets its piece in a join and comes back by its position.

    The table of pieces has a row for each entry of the vocabulary, which bounds what is broadcast; what
    is shuffled is a row for each token. Ids that the vocabulary lacks have no piece."""
    flat, start, size = pieces(path)
    raw = flat.tobytes()
    table = [(k, raw[a : a + n]) for k, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True))]
    known = ids.sparkSession.createDataFrame(pa.table({"id": pa.array([k for k, _ in table], pa.int32()), "piece": pa.array([x for _, x in table], pa.binary())}))

    def listed(source):
        for b in source:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["row", "ids"])

    lists = saved(ids.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids"), "ids")
    tokens = lists.select("row", "ids").mapInArrow(listed, "row long, ids array<int>").select("row", F.posexplode("ids").alias("pos", "id"))
    met = tokens.join(F.broadcast(known), "id").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("p"))
    text = F.make_valid_utf8(F.unhex(F.array_join("p.piece", "")).cast("string"))
    return lists.select("row", "doc_id").join(met, "row", "left").select("doc_id", F.coalesce(text, F.lit("")).alias("text"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, one row for each row of docs.

    Null and empty texts have no ids and the digests of nothing. Texts are taken
    whole whatever their length; repeated rows get equal results; extra columns
    are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def finish(doc_id, raw):
        return {"doc_id": doc_id, "n_tokens": len(raw) // 4, "ids_sha256": hashlib.sha256(raw).hexdigest(), "decoded_sha256": hashlib.sha256(decoded(raw, path).encode()).hexdigest()}

    return encoded(docs, path, finish, schema)



