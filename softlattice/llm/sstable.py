"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order:

    block*   entries; every `BLOCK` ids a new block starts
    index    one record a block: first key, offset, length, ids before it
    bloom    bits of the doc_ids, 10 a key, 7 probes
    footer   64 bytes: offsets and lengths of index and bloom, entries, ids, magic

An entry is varint(shared), varint(unshared), varint(2 * ids + wide), the key's
unshared bytes and the ids, little-endian unsigned: of 16 bits each, or of 32
where one needs them (wide).  A key is 17 bytes
big-endian: 1 for a missing doc_id, else 0, the doc_id with its sign bit flipped, and the occurrence of that doc_id
within the shard; the first entry of a block shares nothing, so a block can be
read alone.  A lookup tests the Bloom filter, bisects the index and scans one
block.

Documents are dealt to tasks by ranges of (doc_id, text hash); each task sorts,
encodes and writes shards of `SHARD_IDS` ids, so a task holds one shard and one
batch whatever its share.  Files are written under a task's own name and then
moved into place; a lost executor's task writes the same bytes again.  Texts are
whole, of any length; null counts as empty and, like every document, ends with
id 2.  Rows that repeat a doc_id follow each other, by text hash.  Rows without a
doc_id come last, as if they repeated one.  Other columns are not read, whatever
their names.  An empty table gives no shard and no row.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import span_hash, splitmix, utf8
from .workspace import Workspace, small_batches

END = 2
BLOCK = 16_384
SHARD_IDS = 8_000_000
MAGIC = b"SLSSTv01"
_FOOTER = struct.Struct("<6Q8x8s")
_INDEX = struct.Struct("<17sQQQ")
_PROBES, _BITS = 7, 10


def key_bytes(doc_id: int | None, nth: int) -> bytes:
    return struct.pack(">BQQ", doc_id is None, ((doc_id or 0) + (1 << 63)) & ((1 << 64) - 1), nth)


def key_id(key: bytes) -> int | None:
    return None if key[0] else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(doc_ids: np.ndarray, size: int) -> np.ndarray:
    h = splitmix(doc_ids.astype(np.int64).view(np.uint64))  # a missing doc_id stands as 0, which adds a false positive at most
    step = splitmix(h) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(_PROBES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


class ShardWriter:
    """Collects ascending documents; `finish` gives the file's bytes."""

    def __init__(self):
        self.parts, self.length, self.index, self.ids, self.n = [], 0, [], 0, 0
        self.doc_ids: list[int | None] = []
        self.block: list[bytes] = []
        self.block_ids, self.last, self.nth = 0, b"", 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A document's ids, as unsigned 32-bit integers."""
        self.nth = self.nth + 1 if self.doc_ids and self.doc_ids[-1] == doc_id else 0
        key, shared = key_bytes(doc_id, self.nth), 0
        if not self.block:
            self.first = (key, self.ids)
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        count = len(ids)
        wide = bool(count and ids.max() > 0xFFFF)
        data = ids.astype("<u4" if wide else "<u2").tobytes()
        self.block.append(_varint(shared) + _varint(len(key) - shared) + _varint(2 * count + wide) + key[shared:] + data)
        self.last, self.ids, self.n, self.block_ids = key, self.ids + count, self.n + 1, self.block_ids + count
        self.doc_ids.append(doc_id)
        if self.block_ids >= BLOCK:
            self._close()

    def _close(self) -> None:
        if self.block:
            data = b"".join(self.block)
            self.index.append(_INDEX.pack(self.first[0], self.length, len(data), self.first[1]))
            self.parts.append(data)
            self.length += len(data)
            self.block, self.block_ids = [], 0

    def finish(self) -> bytes:
        self._close()
        size = max(64, -(-len(self.doc_ids) * _BITS // 8) * 8)
        bits = np.zeros(size, bool)
        bits[_bloom_bits(np.array([i or 0 for i in self.doc_ids], np.int64), size).ravel()] = True
        index, bloom = b"".join(self.index), np.packbits(bits, bitorder="little").tobytes()
        footer = _FOOTER.pack(self.length, len(index), self.length + len(index), len(bloom), self.n, self.ids, MAGIC)
        return b"".join([*self.parts, index, bloom, footer])


class ShardReader:
    """Scans a shard, or finds documents in it by bisection; raises ValueError on a file that is none or is cut off."""

    def __init__(self, data):
        self.data = memoryview(data)
        if len(self.data) < _FOOTER.size:
            raise ValueError("not a shard: too short")
        i, il, b, bl, self.n, self.ids, magic = _FOOTER.unpack(self.data[-_FOOTER.size :])
        if magic != MAGIC or b + bl + _FOOTER.size != len(self.data) or i + il != b:
            raise ValueError("not a shard, or cut off")
        self.index = [_INDEX.unpack_from(self.data, i + k) for k in range(0, il, _INDEX.size)]
        self.bloom = np.unpackbits(np.frombuffer(self.data[b : b + bl], np.uint8), bitorder="little")

    def _block(self, k: int):
        _, at, length, before = self.index[k]
        end, key = at + length, b""
        while at < end:
            shared, at = _read_varint(self.data, at)
            unshared, at = _read_varint(self.data, at)
            count, at = _read_varint(self.data, at)
            count, width = count >> 1, 4 if count & 1 else 2
            key = key[:shared] + bytes(self.data[at : at + unshared])
            at += unshared
            ids = self.data[at : at + width * count]
            yield key, before, ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            at, before = at + width * count, before + count

    def scan(self):
        """(doc_id, ids before it in the shard, its ids as bytes), in order."""
        for k in range(len(self.index)):
            for key, before, ids in self._block(k):
                yield key_id(key), before, ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of the first document of that doc_id, or None."""
        if not self.bloom[_bloom_bits(np.array([doc_id or 0], np.int64), len(self.bloom))[0]].all():
            return None
        want = key_bytes(doc_id, 0)
        k = bisect_right(self.index, want, key=lambda x: x[0]) - 1
        if k < 0:
            return None
        return next((np.frombuffer(ids, "<u4") for key, _, ids in self._block(k) if key == want), None)


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: ASCII whitespace, and the first bytes of whitespace beyond ASCII (two bytes long, three bytes long).
_BLANK, _TWO, _THREE = _bytes(b"\x20\t\n\x0b\x0c\r"), _bytes(b"\xc2"), _bytes(b"\xe1\xe2\xe3")
_WORD = _bytes(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = _bytes(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")  # an apostrophe can begin a contraction


def pieces(raw: np.ndarray, offs: np.ndarray, uncut: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of a batch of texts; each text begins one.

    The byte-level split always starts a new pre-token at a single space between
    two characters that are not whitespace, before and after any other single
    whitespace between such, and at a mark after a letter or digit; so pieces
    encode alone as they do in the text.  No cut is made where a byte could belong
    to whitespace beyond ASCII, nor at the marks `uncut`, which occur within tokens
    that the tokenizer takes whole.
    """
    n = len(raw)
    blank = _BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = edge.copy()
    at = np.flatnonzero(blank[1:-1] & ~blank[:-2] & ~blank[2:]) + 1 if n > 2 else np.zeros(0, np.int64)
    before, after = raw[at - 1], raw[at + 1]
    wide = _TWO[after] | _THREE[after] | ((before >= 0x80) & (_TWO[raw[np.maximum(at - 2, 0)]] | _THREE[raw[np.maximum(at - 3, 0)]]))
    at = at[~wide & ~edge[at] & ~edge[at + 1]]
    first[at] = True
    first[at[raw[at] != 0x20] + 1] = True
    first[1:n] |= _WORD[raw[:-1]] & (_MARK & ~uncut)[raw[1:]]
    return np.flatnonzero(first[:n])


class _Pool:
    """Ids of known pieces, found by a 128-bit hash of their bytes: a sorted table, and a smaller one that new pieces enter."""

    def __init__(self):
        none = np.zeros(0, np.uint64)
        self.levels = [(none, none, np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2  # one, two, first and length in ids
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and length in `ids` of each piece; length -1 where it is not known."""
        first, many = np.zeros(len(one), np.int64), np.full(len(one), -1)
        for a, b, f, n in self.levels:
            if len(a):
                at = np.minimum(np.searchsorted(a, one), len(a) - 1)
                hit = (a[at] == one) & (b[at] == two)
                first[hit], many[hit] = f[at[hit]], n[at[hit]]
        return first, many

    def add(self, one: np.ndarray, two: np.ndarray, ids: list[list[int]]) -> None:
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, many.sum())
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        rows = (one, two, self.used + np.cumsum(many) - many, many)
        self.used += len(flat)
        large, small = self.levels
        small = _merged(small, rows)
        self.levels = [large, small] if len(small[0]) < 20_000 + len(large[0]) // 8 else [_merged(large, small), tuple(x[:0] for x in small)]


def _merged(a: tuple, b: tuple) -> tuple:
    both = [np.concatenate(x) for x in zip(a, b, strict=True)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


class Encoder:
    """The tokenizers library over the pieces of a text, each distinct piece encoded once while it is remembered.

    Python meets new pieces only; the ids of a batch are gathered by numpy from
    what is known.
    """

    def __init__(self, path: str, remember: int = 2_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.uncut = _bytes(b"".join(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.remember, self.known = remember, _Pool()

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a list or an Arrow array), each with the end id, and the n+1 offsets of the texts in them."""
        raw, offs = utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if not len(raw):
            return np.full(len(offs) - 1, END, np.uint32), np.arange(len(offs), dtype=np.int64)
        starts = pieces(raw, offs, self.uncut)
        ends = np.append(starts[1:], len(raw))
        one, at, code = np.unique(span_hash(raw, starts, ends, fold=False), return_index=True, return_inverse=True)
        two = span_hash(raw, starts, ends, fold=False, seed=1)[at]
        if len(self.known) > self.remember:
            self.known = _Pool()
        first, many = self.known.find(one, two)
        if len(new := np.flatnonzero(many < 0)):
            whole = raw.tobytes()
            strings = [whole[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            self.known.add(one[new], two[new], [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)])
            first[new], many[new] = self.known.find(one[new], two[new])
        first, many = first[code], many[code]
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = self.known.ids[np.repeat(first - upto[:-1], many) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(starts, offs)]  # of the texts, without end ids
        return np.insert(ids, bounds[1:], np.uint32(END)), bounds + np.arange(len(bounds))


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _put(uri: str, data: bytes) -> None:
    fs, path = _filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
        out.write(data)
    fs.move(part, path)


def _get(uri: str) -> bytes:
    fs, path = _filesystem(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass(frozen=True)
class Shards:
    """A written set: `manifest` has a row a shard (part, turn, uri, n_docs, n_ids, first and last doc_id)."""

    manifest: DataFrame
    folder: str


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, shard_ids: int = SHARD_IDS) -> Shards:
    """Encode docs (doc_id, text) and write their shards to a shared folder, in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "sstable")
    folder = folder or f"{ws.path}/shards"

    def run(batches):
        from pyspark import TaskContext

        part, turn, w, enc = TaskContext.get().partitionId(), 0, ShardWriter(), encoder(tokenizer)

        def close():
            uri = f"{folder}/part-{part:06d}-{turn:05d}.sst"
            _put(uri, w.finish())
            row = [part, turn, uri, w.n, w.ids, w.doc_ids[0], w.doc_ids[-1]]
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=schema)

        for batch in batches:
            ids, at = enc(batch.column("text"))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                w.add(doc_id, ids[at[i] : at[i + 1]])
                if w.ids >= shard_ids:
                    yield close()
                    w, turn = ShardWriter(), turn + 1
        if w.n:
            yield close()

    names = ["part", "turn", "uri", "n_docs", "n_ids", "first_id", "last_id"]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], strict=True)))
    ddl = "part int, turn int, uri string, n_docs long, n_ids long, first_id long, last_id long"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_h")]
    dealt = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return Shards(ws.save(dealt.select("doc_id", "text").mapInArrow(run, ddl), "manifest"), folder)


def read(shards: Shards) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    spark = shards.manifest.sparkSession
    before = Window.orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)
    listed = shards.manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = [(d, base + b, len(ids) // 4, zlib.crc32(ids)) for d, b, ids in ShardReader(_get(uri)).scan()]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.select("uri", "base").repartition(n, "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
