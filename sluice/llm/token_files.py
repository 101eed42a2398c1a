"""Token ids in binary files with a minimal perfect hash index.

A shard is two files. `.bin` holds ids only: unsigned little-endian integers of
2 bytes (4 if the vocabulary needs them), documents one after the other in
ascending key order. `.idx` holds, after the magic SLTOKEN1,

    u4 item size, u4 levels, u8 documents, u8 keys outside of the levels,
    u8 bits of each level, u8 words of all levels, u4 rank before each word,
    u8 hashes of the keys outside of the levels (ascending),
    u4 fingerprint, u8 first id and u8 number of ids by hash slot,
    i8 document id, u1 null mark and u4 copy number in file order.

A document key's slot comes from the first level that has its bit set and the
number of bits before; the stored fingerprint tells keys that are not there.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PIECES
from .common import SLICE, PieceCache, mix64, only, shared_dir, table, text_slices, whole_text

MAGIC = b"SLTOKEN1"
_WHITE = set("\t\n\x0b\x0c\r ")
#: Bits of a level for each key that is left; levels at most.
GAMMA, LEVELS = 2.0, 24
_STEP = np.uint64(0x9E3779B97F4A7C15)


def key_hash(ids: np.ndarray, null: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """64 bits of (document id or null, number of the copy with that id)."""
    h = mix64(ids.astype(np.int64).view(np.uint64) + _STEP)
    h = np.where(null, mix64(np.full(len(h), 0x5EED, np.uint64)), h)
    return np.where(copy > 0, mix64(h + copy.astype(np.uint64) * _STEP), h)


class PerfectHash:
    """Distinct 64-bit keys -> 0..n-1, by a cascade of bit arrays."""

    def __init__(self, bits: np.ndarray, words: np.ndarray, ranks: np.ndarray, rest: np.ndarray):
        self.bits, self.words, self.ranks, self.rest = bits, words, ranks, rest
        self.first = np.append(0, np.cumsum(bits))[:-1].astype(np.uint64)
        self.in_levels = int(ranks[-1]) + int(words[-1]).bit_count() if len(words) else 0

    @staticmethod
    def place(keys: np.ndarray, level: int, bits) -> np.ndarray:
        return mix64(keys ^ np.uint64((level + 1) * int(_STEP) % 2**64)) % np.uint64(bits)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys = np.asarray(keys, np.uint64)
        bits, marks = [], []
        left = keys
        while len(left) and len(bits) < LEVELS:
            size = -(-int(GAMMA * len(left) + 1) // 64) * 64
            at = cls.place(left, len(bits), size)
            hits = np.bincount(at.astype(np.int64), minlength=size)
            alone = hits == 1
            bits.append(size)
            marks.append(alone)
            left = left[~alone[at.astype(np.int64)]]
        flags = np.concatenate(marks) if marks else np.zeros(0, bool)
        words = np.packbits(flags, bitorder="little").view("<u8") if len(flags) else np.zeros(0, np.uint64)
        counts = flags.reshape(-1, 64).sum(1) if len(flags) else np.zeros(0, np.int64)
        return cls(np.array(bits, np.uint64), words.astype(np.uint64), (np.cumsum(counts) - counts).astype(np.uint32), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that were not built in (others get any slot)."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.bits.tolist()):
            if not len(todo):
                break
            at = self.place(keys[todo], level, size) + self.first[level]
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            there = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[there]] = self.ranks[word[there]] + np.bitwise_count(below[there])
            todo = todo[~there]
        if len(todo) and len(self.rest):
            at = np.searchsorted(self.rest, keys[todo])
            hit = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[todo])
            out[todo[hit]] = self.in_levels + at[hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys + np.uint64(0xF1)) >> np.uint64(32)).astype(np.uint32)


def index_bytes(ids: np.ndarray, null: np.ndarray, copy: np.ndarray, lengths: np.ndarray, item: int) -> bytes:
    keys = key_hash(ids, null, copy)
    table_ = PerfectHash.build(keys)
    slot = table_.slots(keys)
    n = len(keys)
    prints, first, count = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    prints[slot], first[slot], count[slot] = fingerprint(keys), np.cumsum(lengths) - lengths, lengths
    head = MAGIC + struct.pack("<IIQQ", item, len(table_.bits), n, len(table_.rest))
    parts = [table_.bits.astype("<u8"), table_.words.astype("<u8"), table_.ranks.astype("<u4"), table_.rest.astype("<u8"), prints, first, count, ids.astype("<i8"), null.astype("u1"), copy.astype("<u4")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard's index, and its ids by document key."""

    def __init__(self, filesystem, base: str):
        self.fs, self.base = filesystem, base
        with filesystem.open_input_file(base + ".idx") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{base}.idx is no token index")
        self.item, levels, n, rest = struct.unpack_from("<IIQQ", data, 8)
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        bits = take("<u8", levels)
        words = take("<u8", int(bits.sum()) // 64)
        self.hash = PerfectHash(bits, words, take("<u4", len(words)), take("<u8", rest))
        self.prints, self.first, self.count = take("<u4", n), take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
        self.ids, self.null, self.copy = take("<i8", n), take("u1", n).astype(bool), take("<u4", n)

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; (-1, 0) for keys that are not there."""
        slot = self.hash.slots(keys)
        ok = (slot >= 0) & (slot < len(self.prints))
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok])
        first, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[ok], count[ok] = self.first[slot[ok]], self.count[slot[ok]]
        return first, count

    def documents(self, first: np.ndarray, count: np.ndarray, limit: int = SLICE):
        """The ids of documents that stand at first, one array each; about `limit` bytes are read at a time."""
        with self.fs.open_input_file(self.base + ".bin") as f:
            lo = 0
            while lo < len(first):
                hi = lo + 1
                while hi < len(first) and first[hi] == first[hi - 1] + count[hi - 1] and (first[hi] + count[hi] - first[lo]) * self.item <= limit:
                    hi += 1
                part = np.frombuffer(f.read_at(int(first[hi - 1] + count[hi - 1] - first[lo]) * self.item, int(first[lo]) * self.item), f"<u{self.item}")
                for a, n in zip((first[lo:hi] - first[lo]).tolist(), count[lo:hi].tolist(), strict=True):
                    yield part[a : a + n]
                lo = hi

    def read(self, first: int, count: int) -> np.ndarray:
        with self.fs.open_input_file(self.base + ".bin") as f:
            return np.frombuffer(f.read_at(count * self.item, first * self.item), f"<u{self.item}")


def first_copies(rows: list) -> list[int]:
    """For each shard, in order, how many copies of its first id the shards before it hold."""
    out, before = [], None
    for r in rows:
        first, last = ((r["first_null"], r["first_id"]), (r["last_null"], r["last_id"]))
        out.append(before[1] if before and before[0] == first else 0)
        before = (last, r["last_copy"] + 1 + (out[-1] if first == last else 0))
    return out


class TokenStore:
    """Keyed access to a written folder: get(doc_id, copy) reads one document's ids, or None.

    An index counts copies within its shard; copy is the number among all shards.
    """

    def __init__(self, manifest: list):
        self.rows = sorted(manifest, key=lambda r: r["shard"])
        self.before = first_copies(self.rows)
        one = [(r["first_null"], r["first_id"]) == (r["last_null"], r["last_id"]) for r in self.rows]
        self.last = [(r["last_null"] == 0, r["last_id"], r["last_copy"] + n * o) for r, n, o in zip(self.rows, self.before, one, strict=True)]
        self.open = lru_cache(maxsize=64)(lambda i: Shard(*pafs.FileSystem.from_uri(self.rows[i]["base"])))

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        i = bisect.bisect_left(self.last, (doc_id is not None, doc_id or 0, copy))
        if i == len(self.rows):
            return None
        shard = self.open(i)
        if (self.rows[i]["first_null"] == 1, self.rows[i]["first_id"]) == (doc_id is None, doc_id or 0):
            copy -= self.before[i]
        key = key_hash(np.array([doc_id or 0], np.int64), np.array([doc_id is None]), np.array([copy], np.uint32))
        first, count = shard.locate(key)
        return shard.read(int(first[0]), int(count[0])) if first[0] >= 0 else None


def byte_level_encoder(path: str) -> tuple[PieceCache, int]:
    """Cached ids of text pieces, and the vocabulary's size."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    vocabulary = tokenizer.get_vocab()
    size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token: a character of its name stands for each
    for name, i in vocabulary.items():
        size[i] = len(name)

    def ids(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # pieces that begin with white space and do not end with it are encoded in a row, and cut apart by their bytes
        flat: list = [None] * len(pieces)
        alone = [i for i, p in enumerate(pieces) if p[0] not in _WHITE or p[-1] in _WHITE]
        apart = set(alone)
        row = [i for i in range(len(pieces)) if i not in apart]
        for lo in range(0, len(row), 2048):
            some = row[lo : lo + 2048]
            found = np.array(ids(["".join([pieces[i] for i in some])])[0], np.int32)
            ends = np.cumsum(size[found])
            want = np.cumsum([len(pieces[i].encode("utf-8", "replace")) for i in some])
            at = np.searchsorted(ends, want)
            if len(at) and at[-1] < len(ends) and (ends[at] == want).all():
                cuts = (at + 1).tolist()
                for i, a, b in zip(some, [0, *cuts[:-1]], cuts, strict=True):
                    flat[i] = found[a:b]
            else:
                alone += some
        for i, x in zip(alone, ids([pieces[i] for i in alone]), strict=True):
            flat[i] = np.array(x, np.int32)
        return np.concatenate(flat), np.fromiter(map(len, flat), np.int64, len(flat))

    return PieceCache(encode, limit=224 << 20), tokenizer.get_vocab_size()


MANIFEST = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("base", T.StringType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("first_null", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("last_null", T.LongType()),
        T.StructField("last_copy", T.LongType()),
    ]
)


#: Bytes of text in a shard, as far as equal (id, text) rows can be parted: bounds its index in memory.
SHARD_BYTES = 256 << 20


def shard_count(docs: DataFrame) -> int:
    """Shards for docs (text), by their bytes: one aggregation over lengths; spark.sql.shuffle.partitions at least."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))


def write_tokens(df: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write all documents to folder and return the manifest, one row per shard.

    Order: id_col ascending, null first, then text; rows that repeat an id are
    its copies 0, 1, ... in that order. Null and empty texts are end_id alone.
    Other columns are left out. An empty table gives an empty manifest.

    One range shuffle of the texts; a task then streams one shard. Copies of
    one id are dealt to shards by their text's hash, so a repeated id cannot
    fill a single shard with different texts; rows that repeat both are told
    apart by a number of their own (none of them differs from the others in the
    output). Shards follow the bytes of text (SHARD_BYTES) unless given. Every
    attempt of a task writes files of its own name; the manifest, committed by
    Spark, tells which count.
    """
    spark = df.sparkSession
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), "h", "n"]
    shards = shards or shard_count(source)
    source = source.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(shards, *order).sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "text").select("id", "text", "h")

    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        cache, vocabulary = only(("byte level", path), lambda: byte_level_encoder(path))
        item = 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        filesystem, root = pafs.FileSystem.from_uri(folder)
        name = f"shard-{shard:08d}-{uuid.uuid4().hex[:12]}"
        ids, nulls, lengths = [], [], []
        out = None
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            if out is None:
                filesystem.create_dir(root, recursive=True)
                out = filesystem.open_output_stream(f"{root}/{name}.bin")
            flat, counts = cache.lookup_texts(batch.column(1).to_pylist(), PIECES.findall)
            lengths.append(counts + 1)
            out.write(np.insert(flat, np.cumsum(counts), end_id).astype(f"<u{item}").tobytes())
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        if out is None:
            return
        out.close()
        ids, nulls, lengths = np.concatenate(ids), np.concatenate(nulls), np.concatenate(lengths)
        new = np.append(True, (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1]))
        at = np.arange(len(ids))
        copy = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint32)
        with filesystem.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(index_bytes(ids, nulls, copy, lengths, item))
        row = [shard, f"{folder}/{name}", len(ids), int(lengths.sum()), int(ids[0]), int(nulls[0]), int(ids[-1]), int(nulls[-1]), int(copy[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=MANIFEST.names)

    manifest = f"{folder}/manifest"
    source.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of a written folder, found through the index and read from its place.

    doc_id, copy, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as unsigned little-endian 32-bit integers). copy counts among all shards.
    """
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: r["shard"])  # one small row per shard
    starts = np.cumsum([0, *[r["n_ids"] for r in rows]]).tolist()
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "copy", "start", "n_tokens", "ids_crc32")])
    todo = spark.createDataFrame([(r["base"], s, n) for r, s, n in zip(rows, starts, first_copies(rows), strict=False)], "base string, start long, before long")
    if rows:
        todo = todo.repartition(len(rows))

    def run(batches):
        for batch in batches:
            for base, start, before in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard = Shard(*pafs.FileSystem.from_uri(base))
                first, count = shard.locate(key_hash(shard.ids, shard.null, shard.copy))
                if (first < 0).any():
                    raise ValueError(f"{base}: a document is not in its index")
                crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.documents(first, count)]
                copy = shard.copy + before * ((shard.ids == shard.ids[0]) & (shard.null == shard.null[0]))
                columns = [pa.array(shard.ids, mask=shard.null), *[pa.array(np.asarray(x, np.int64)) for x in (copy, start + first, count, crc)]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return todo.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, shared_dir(spark, "tokens"))
    return read_tokens(manifest).drop("copy")
