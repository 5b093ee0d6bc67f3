"""Token ids in length-delimited binary records, with an offset index beside them.

A shard file is an 8-byte head (magic, version, bytes per id) and then records:
length (u64), masked checksum of the length (u32), body, masked checksum of the
body (u32). A body is doc_id (i64, least value for null) and the ids. Checksums
are CRC-32, rotated and offset so that a checksum of data that holds checksums
stays sound. The index file has doc_id (i64), offset (u64) and number of ids (u64)
of each record, for reading records in any order. All numbers are little-endian.

Writers put a shard under a name of their own in the shared folder and rename it
when it is whole, so a repeated task does no harm.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import saved, scratch
from millrace.llm.words import Cache, bare, lowered, stem, tokenizer

MAGIC, VERSION = b"MRRC", 1
HEAD, LENGTH, CHECK = struct.Struct("<4sHH"), struct.Struct("<Q"), struct.Struct("<I")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
NULL = -(1 << 63)
#: Letters that the Unicode normal form leaves alone and whose lower case is one letter.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The endings that the tokenizer cuts off.
SHORT = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
#: Its pre-tokens of ASCII in lower case.
ASCII = re.compile("|".join((*SHORT, "[a-z]+|[0-9]|[^a-z0-9]+")))
#: Words whose ids a worker keeps.
CACHE = 600_000

#: Documents of a shard, whose index a task holds; there are more shards than the session has partitions once the table is so large.
SHARD = 100_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    length = LENGTH.pack(len(body))
    return b"".join((length, CHECK.pack(masked(length)), body, CHECK.pack(masked(body))))


def unframe(data: memoryview, at: int) -> tuple[bytes, int]:
    """The body at an offset and where the next record begins; ValueError if a checksum is wrong."""
    length = bytes(data[at : at + 8])
    (size,) = LENGTH.unpack(length)
    if CHECK.unpack(data[at + 8 : at + 12])[0] != masked(length):
        raise ValueError(f"length at {at} is damaged")
    body = bytes(data[at + 12 : at + 12 + size])
    if CHECK.unpack(data[at + 12 + size : at + 16 + size])[0] != masked(body):
        raise ValueError(f"record at {at} is damaged")
    return body, at + 16 + size


def signs(path: str) -> dict[int, str] | None:
    """For a tokenizer that lower-cases, cuts runs of letters, digits and runs of signs, and signs their bytes: the signs of Latin letters.

    None for any other; its words all go through its whole chain."""
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", ())]
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cut] != ["Split", "ByteLevel"] or cut[1]["add_prefix_space"]:
        return None
    if not cut[0]["invert"] or cut[0]["pattern"].get("Regex") != "|".join((*SHORT, r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")):
        return None
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    return {k: "".join(x for x, _ in level.pre_tokenize_str(chr(k))) for k in range(0xC0, 0x100)}


class Encoder:
    """Ids of whole texts as bytes, two or four for each id, by way of a cache of lumps.

    Words of Latin letters and lumps of printable ASCII, most of what occurs, go to the library's
    model without the steps before it, which are done here; other lumps to the whole chain."""

    def __init__(self, path: str, end: int):
        self.library = tokenizer(path)
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.kind == "H" else "<u4")
        self.end = self._bytes([end])
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.signs, self.model = signs(path), self.library.model
        self.lumps = Cache(self.ids, CACHE)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def ids(self, lump: str) -> bytes:
        if self.signs is not None:
            if LATIN.fullmatch(lump):
                low = lump.lower()
                if low != lump:
                    return self.lumps[low]
                return self._bytes([t.id for t in self.model.tokenize(low if low.isascii() else low.translate(self.signs))])
            if lump.isascii() and lump.isprintable():
                parts = ASCII.findall(lump.lower())
                if len(parts) > 1:
                    return b"".join(map(self.lumps.__getitem__, parts))
                return self._bytes([t.id for t in self.model.tokenize(parts[0])])
        core = stem(lump)
        if core is not lump:
            return self.lumps[core] + self.lumps[lump[len(core) :]]
        return self._bytes(self.library.encode(lump, add_special_tokens=False).ids)

    def text(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self._bytes(self.library.encode(text, add_special_tokens=False).ids) + self.end
        low = lowered(text) if self.signs is not None else None
        return b"".join(map(self.lumps.__getitem__, bare(text if low is None else low))) + self.end


@lru_cache(maxsize=2)
def encoder(path: str, end: int) -> Encoder:
    """Kept in a process, so that its tasks share the cache."""
    return Encoder(path, end)


def write_shard(uri: str, shard: int, dtype: np.dtype, bodies: Iterable[tuple[int | None, bytes]]) -> tuple[str, int, int]:
    """Write one shard and its index; its path, records and ids."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(uri)
    store.create_dir(top, recursive=True)
    name, own = f"{top}/shard-{shard:06d}", f"{top}/.{uuid.uuid4().hex}"
    at, total, index = HEAD.size, 0, []
    with store.open_output_stream(own + ".rec") as out:
        out.write(HEAD.pack(MAGIC, VERSION, dtype.itemsize))
        for doc_id, ids in bodies:
            n, key = len(ids) // dtype.itemsize, NULL if doc_id is None else doc_id
            out.write(data := frame(struct.pack("<q", key) + ids))
            index.append((key, at, n))
            at, total = at + len(data), total + n
    with store.open_output_stream(own + ".idx") as out:
        out.write(np.array(index, INDEX).tobytes())
    for kind in (".idx", ".rec"):
        store.move(own + kind, name + kind)
    return name, len(index), total


def read_shard(uri: str, name: str, order: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of a shard's records, all in file order or those at the given places of the index."""
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(uri)
    with store.open_input_file(name + ".idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    with store.open_input_file(name + ".rec") as f:
        magic, version, width = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{name} is no record file")
        for k in range(len(index)) if order is None else order:
            at = int(index["offset"][k])
            size = 16 + 8 + int(index["n"][k]) * width
            f.seek(at)
            body, _ = unframe(memoryview(f.read(size)), 0)
            (key,) = struct.unpack_from("<q", body)
            yield None if key == NULL else key, np.frombuffer(body, f"<u{width}", offset=8)


def write(docs: DataFrame, path: str, end: int, uri: str) -> DataFrame:
    """Encode and write all texts in ascending doc_id order; the shards: shard, name, n_docs, n_ids."""

    def run(batches):
        held, shard = encoder(path, end), TaskContext.get().partitionId()

        def bodies():
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield doc_id, held.text(text or "")

        name, n, total = write_shard(uri, shard, held.dtype, bodies())
        if n:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [n], "n_ids": [total]})

    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD))
    rows = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return saved(rows.mapInArrow(run, "shard long, name string, n_docs long, n_ids long"), "manifest")


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record in the files."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                out, start = [], row["before"]
                for doc_id, ids in read_shard(uri, row["name"]):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each shard: a running sum over them is small whatever the data
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("before", before).select("shard", "name", "before")
    return shards.repartition(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(docs: DataFrame, path: str, end: int = 2, uri: str | None = None) -> DataFrame:
    """Write all of docs to record files, then read them back.

    Null and empty texts give a record of the end id alone. Rows with a null
    doc_id come first and keep it; rows with one doc_id follow each other in the
    order of their texts. An empty table gives no shard and no rows.
    """
    uri = uri or scratch(docs.sparkSession, "records")
    return read(write(docs, path, end, uri), uri)
