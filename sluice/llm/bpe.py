"""Byte-level BPE with a rank file, encoded in numpy matrices.

Pieces (matches of the split pattern) are sorted into buckets by length; a
bucket is a padded matrix with a piece in each row. In each round every row
merges its leftmost pair of minimum rank, pairs being looked up in a hash
table; rows that cannot merge leave and the matrix is compacted.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PieceCache, map_texts, mix64, only, table

#: Characters with the property White_Space (fixed values of Unicode).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space and what follows it up to the next one. No match of a
#: GPT-2 style pattern goes on from other characters into white space, so a
#: text may be cut before each such run.
PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
NONE = np.int32(2**31 - 1)
#: Longer pieces get a matrix of one row each, so that padding stays small and a round can merge many places.
MATRIX_COLUMNS = 256


class PairTable:
    """Open addressing: (left id, right id) -> rank of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(rank), 1) * 2.5))))
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        keys = self.key(left, right)
        at, todo = mix64(keys) & self.mask, np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.values[slot[won]] = rank[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self.key(left, right)
        out = np.full(len(keys), NONE, dtype=np.int32)
        at, todo = mix64(keys) & self.mask, np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo = todo[~hit & (there != 0)]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
        return out


class Bpe:
    """ranks: token bytes -> id, the id being its merge rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no ids for single bytes {missing[:5]}")
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                b = ranks.get(token[cut:]) if a is not None else None
                if b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > MATRIX_COLUMNS:
                out[i] = self._in_one_row(p)
            elif p:
                buckets.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
            else:
                out[i] = np.empty(0, np.int32)
        for width, rows in buckets.items():
            step = max(1, (1 << 21) // width)
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                for i, ids in zip(some, self._by_matrix([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.zeros((n, width), np.int32)
        ids[np.arange(width) < size[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), NONE, np.int32)  # of the pair that begins at each column
        pair = np.arange(width) < (size - 1)[:, None]
        ranks[pair] = self.pairs.find(ids[pair], ids[:, 1:][pair[:, :-1]])
        out: list = [None] * n
        rows, columns = np.arange(n), np.arange(width)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                for r, row, n in zip(np.flatnonzero(done).tolist(), rows[done].tolist(), size[done].tolist(), strict=True):
                    out[row] = ids[r, :n].copy()
                keep = ~done
                rows, ids, ranks, size, at, best = rows[keep], ids[keep], ranks[keep], size[keep], at[keep], best[keep]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = best
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            size = size - 1
            if (m := int(size.max())) <= width // 2:
                width = m
                ids, ranks, columns = ids[:, :m].copy(), ranks[:, :m].copy(), columns[:m]
            # the pairs to the left and right of the merged one have changed
            for where, ok in ((at, at + 1 < size), (at - 1, at > 0)):
                new = np.full(len(rows), NONE, np.int32)
                r = each[ok]
                new[ok] = self.pairs.find(ids[r, where[ok]], ids[r, where[ok] + 1])
                if where is at:
                    inside = at < ids.shape[1]
                    ranks[each[inside], at[inside]] = new[inside]
                else:
                    ranks[r, where[ok]] = new[ok]
            ranks[each, size - 1] = NONE
        return out

    def _in_one_row(self, piece: bytes) -> np.ndarray:
        """The rounds of a matrix of one row; a round merges all places of the least rank that do not affect each other."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            each = np.arange(len(at))
            # places in a row overlap: every other one of them merges, from the left
            begin = np.maximum.accumulate(np.where(np.append(True, np.diff(at) > 1), each, 0))
            at = at[(each - begin) % 2 == 0]
            token = np.full(len(at), best, np.int32)
            right, left = at + 2 < len(ids), at > 0
            beside = (self.pairs.find(token[right], ids[at[right] + 2]), self.pairs.find(ids[at[left] - 1], token[left]), self.pairs.find(token[:1], token[:1]))
            if min(x.min(initial=NONE) for x in beside) <= best:
                at = at[:1]  # what a merge makes would come before the next place
            ids[at] = best
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids = ids[stays]
            now = at - np.arange(len(at))
            ranks = ranks[stays[1:]]  # a pair goes with its right id; pairs beside merged ones are looked up again
            for where in (now, now - 1):
                where = where[(where >= 0) & (where < len(ranks))]
                ranks[where] = self.pairs.find(ids[where], ids[where + 1])
        return ids


def load_ranks(path: str) -> Bpe:
    """A rank file: a line for each token, base64 of its bytes and its rank."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return Bpe({base64.b64decode(a): int(b) for a, b in pairs})


def piece_encoder(path: str, pattern: str) -> tuple:
    """Cached ids of pieces, the function that splits a text into them, and the bytes of each id."""
    import regex

    bpe = load_ranks(path)
    cache = PieceCache(lambda pieces: bpe.encode_pieces([p.encode("utf-8", "replace") for p in pieces]), limit=100 << 20)
    return cache, regex.compile(pattern).findall, bpe.tokens


def list_array(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, ids_col: str = "ids") -> DataFrame:
    """Add the ids of each whole text: every match of pattern is encoded on its own, no special tokens.

    Characters that pattern does not match are left out. Null and empty texts
    give an empty array; repeated rows get equal ids; an empty table gives an
    empty table. path is read on every executor. No shuffle; columns of keep
    (default: all) stay unless named like ids_col.
    """

    def make():
        cache, split, _ = only(("pieces", path, pattern), lambda: piece_encoder(path, pattern))

        def compute(texts: list[str]) -> list:
            return [list_array(*cache.lookup_texts(texts, split))]

        return compute

    keep = df.columns if keep is None else keep
    return map_texts(df, text_col, keep, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for. Null ids give null; an id outside of the vocabulary raises."""
    names = [c for c in df.columns if c != bytes_col]
    source = df.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*source.schema.fields, T.StructField(bytes_col, T.BinaryType())])
    at = names.index(ids_col)

    def run(batches):
        tokens = only(("tokens", path), lambda: load_ranks(path).tokens)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            ids = batch.column(at)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(tokens)):
                raise ValueError("id outside of the vocabulary")
            data = b"".join(map(tokens.__getitem__, flat.tolist()))
            ends = np.append(0, np.cumsum(lengths[flat])) if len(flat) else np.zeros(1, np.int64)
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            places = ends[np.append(0, np.cumsum(sizes))].tolist()
            made = [data[a:b] if ok else None for a, b, ok in zip(places[:-1], places[1:], ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, type=pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


ROUND_TRIP = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ROUND_TRIP's columns: encode's ids counted and hashed (in decimal, between commas), and the hash of what they decode to.

    Ids do not leave Python, in which they are encoded and decoded in one pass
    without a shuffle. Null and empty texts have no ids. Columns of keep
    (default: all) stay unless named like a new one.
    """

    def make():
        cache, split, tokens = only(("pieces", path, pattern), lambda: piece_encoder(path, pattern))

        def compute(texts: list[str]) -> list:
            flat, counts = cache.lookup_texts(texts, split)
            ids, ends = flat.tolist(), np.cumsum(counts).tolist()
            of_text = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            named = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in of_text]
            return [counts, named, [hashlib.sha256(b"".join(map(tokens.__getitem__, x))).hexdigest() for x in of_text]]

        return compute

    return map_texts(df, text_col, df.columns if keep is None else keep, ROUND_TRIP, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])
