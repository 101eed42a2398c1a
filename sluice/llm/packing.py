"""Sequence packing by best-fit decreasing.

Documents longer than a sequence are first cut into full windows; what is left
of each is placed, largest first, into the open window with the least room
that still holds it. A segment tree over remaining capacities finds it.
"""

from __future__ import annotations

import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PieceCache, only, table, text_slices, whole_text

#: Sequence ids of a task begin at its partition number times this.
TASK_IDS = 1 << 32


class CapacityTree:
    """Counts of open windows by remaining capacity 0..size-1, with the least
    occupied capacity at or above a value found by going up and down the tree."""

    def __init__(self, size: int):
        self.width = 1 << max(1, (size - 1).bit_length())
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity >= need of an open window, or -1."""
        count, i = self.count, need + self.width
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.width:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.width


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each length (1..size), and the number of windows.

    Longest first, ties in the given order; of windows with equal room the one
    opened last takes the piece.
    """
    tree = CapacityTree(size + 1)
    open_at: dict[int, list[int]] = {}
    window, offset = [0] * len(lengths), [0] * len(lengths)
    n = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = tree.tightest(need)
        if room < 0:
            w, room, n = n, size, n + 1
        else:
            w = open_at[room].pop()
            tree.add(room, -1)
        window[i], offset[i] = w, size - room
        left = room - need
        if left:
            open_at.setdefault(left, []).append(w)
            tree.add(left, 1)
    return window, offset, n


def chunks(text: str) -> list[bytes]:
    """The text's chunks between ASCII white space. Their ASCII letters are lowered,
    which the tokenizer does too, unless composing characters could tell the difference."""
    data = text.encode("utf-8", "replace")
    if data.isascii() or (is_normalized("NFC", text) and is_normalized("NFC", data.lower().decode("utf-8"))):
        data = data.lower()
    return data.split()


def word_encoder(path: str) -> PieceCache:
    """Ids of chunks by a tokenizer that composes and lowers letters and drops white space."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(some: list[bytes]) -> list[np.ndarray]:
        found = tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in some], add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    return PieceCache(encode, limit=200 << 20)


PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(df: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col and PIECE's columns.

    path names a tokenizers file that composes (NFC) and lowers letters and
    drops white space, so that chunks between ASCII white space are encoded
    independently.
    A document is its ids and end_id; null and empty texts are end_id alone.
    Repeated rows and null ids are documents of their own. Other columns are
    left out. An empty table gives no pieces.

    Every task packs the documents of its own partition: no shuffle, and a
    task holds a few numbers per document until its input ends. At most one
    window of a task is typically left much below full, so that the padding
    falls with the partition's size. Sequence ids are the partition's number
    times 2^32 and up: a task that is run again makes the same ones.
    """
    source = df.select(F.col(f"`{id_col}`").alias(id_col), whole_text(text_col).alias("__text"))
    schema = T.StructType([source.schema[id_col], *PIECE.fields])

    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        cache = only(("words", path), lambda: word_encoder(path))
        end = np.array([end_id], np.int32)
        first = TaskContext.get().partitionId() * TASK_IDS
        keys: list = []  # Arrow columns of the documents with a rest
        rest: list[np.ndarray] = []
        sequences = 0

        def rows(ids: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *[pa.array(numbers[:, i]) for i in range(numbers.shape[1])]], names=schema.names)

        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            windows, window_of, tails = [], [], []
            flat, counts = cache.lookup_texts(batch.column(1).to_pylist(), chunks)
            for row, ids in enumerate(np.split(flat, np.cumsum(counts)[:-1])):
                ids = np.concatenate([ids, end]).astype("<u4")
                n = len(ids)
                full = n // size
                for w in range(full):
                    windows.append((w * size, size, zlib.crc32(ids[w * size : (w + 1) * size].tobytes()), n, first + sequences, 0))
                    window_of.append(row)
                    sequences += 1
                at = full * size
                tails.append((at, n - at, zlib.crc32(ids[at:].tobytes()), n))
            if windows:
                yield rows(batch.column(0).take(pa.array(window_of)), np.array(windows, np.int64))
            tail = np.array(tails, np.int64)
            left = np.flatnonzero(tail[:, 1])
            keys.append(batch.column(0).take(pa.array(left)))
            rest.append(tail[left])
        if not rest:
            return
        pieces = np.concatenate(rest)
        ids = pa.concat_arrays(keys)
        window, offset, _ = best_fit(pieces[:, 1].tolist(), size)
        placed = np.column_stack([pieces, first + sequences + np.array(window, np.int64).reshape(-1), np.array(offset, np.int64).reshape(-1)])
        for lo in range(0, len(placed), 10_000):
            yield rows(ids.slice(lo, 10_000), placed[lo : lo + 10_000])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
