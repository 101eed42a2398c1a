"""Helpers the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split of text at ASCII white space that the contracts call words.
WORD_GAP = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str) -> Column:
    """The text of a document; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared one (spark.checkpoint.dir).

    Only a session on one machine (master local) that names none, as in tests,
    gets a folder of its own; on a cluster that is an error, for no other
    folder is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation. by: a column of few values, each of
    which gets a folder of its own.

    The shuffle files behind df are then of no use. Spark deletes them once the
    driver's JVM has collected the plan as garbage, which a driver with little
    to do puts off; so it is asked to.
    """
    spark = df.sparkSession
    path, schema = shared_dir(spark, purpose), df.schema
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path).select(*schema.names)
    out._sluice_path = path
    return out


def forget(*tables: DataFrame, part: str = "") -> None:
    """Delete tables of materialize() that no later plan reads, or the part ("column=value") of them."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{t._sluice_path}/{part}")
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Bytes of text that a task works on at a time, at least one row.
SLICE = 2 << 20


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batch in parts whose texts (or binary values) have about `limit` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str]], list]],
) -> DataFrame:
    """keep's columns and new ones that Python computes from whole texts.

    make() runs once per task on the executor and returns the function from a
    batch of texts to one sequence (list, numpy or Arrow array) per field. An
    existing column named like a new one is replaced; other columns of df do
    not travel to Python.
    """
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in keep], whole_text(text_col).alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + fields)
    kinds = [arrow_type(f.dataType) for f in fields]
    labels = [*keep, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in (part for whole in batches for part in text_slices(whole, len(keep))):
            made = compute(batch.column(len(keep)).to_pylist())
            arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *arrays], names=labels)

    return source.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: a bijection on unsigned 64-bit integers."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours of unsigned 64-bit integers."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.uint64(2**64 - 1))
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def ragged_positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, dtype=np.int64)
    full = lengths > 0
    first = (ends - lengths)[full]
    begin, size = starts[full].astype(np.int64), lengths[full]
    out[first[0]] = begin[0]
    out[first[1:]] = begin[1:] - (begin[:-1] + size[:-1] - 1)
    return np.cumsum(out)


_kept: dict = {}


def only(key: tuple, make: Callable = lambda: None):
    """What make() returns, kept in this Python worker until a task asks for another key.

    Workers are used by one stage after the other: a cache that only its own
    stage would drop would stay in memory beside those of all later stages.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        _kept[key] = make()
    return _kept[key]


class PieceCache:
    """Ids of text pieces, kept until they take about `limit` bytes.

    encode(list of pieces) gives one integer array per piece, or all ids in a
    row and how many each piece has. Text repeats its
    words, so most pieces cost one dictionary lookup. The limit bounds memory
    only: a piece that was dropped is encoded again. What one call asks for may
    exceed it, so that a call should not bring more than a slice of text.
    """

    #: Bytes that a piece takes besides its own: its object, its entry in the dictionary and two numbers.
    EACH = 160

    def __init__(self, encode: Callable[[list], list[np.ndarray]], limit: int = 100 << 20):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict = {}
        self.starts = np.zeros(1024, dtype=np.int64)
        self.lengths = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.int32)
        self.used = self.held = 0

    def lookup_texts(self, texts: list, split: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has. split(text) gives its pieces."""
        pieces: list = []
        ends = [0]
        for t in texts:
            pieces += split(t)
            ends.append(len(pieces))
        ids, lengths = self.lookup(pieces)
        return ids, np.diff(np.append(0, np.cumsum(lengths))[ends])

    def _room(self, rows: int, ids: int) -> None:
        if rows > len(self.starts):
            more = max(rows, 2 * len(self.starts)) - len(self.starts)
            self.starts = np.concatenate([self.starts, np.zeros(more, np.int64)])
            self.lengths = np.concatenate([self.lengths, np.zeros(more, np.int64)])
        if ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(ids, 2 * len(self.flat)) - len(self.flat), np.int32)])

    def lookup(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each piece has."""
        at = list(map(self.rows.get, pieces))
        missing = [i for i, row in enumerate(at) if row is None]
        if missing:
            if self.held + 4 * self.used > self.limit:
                self.clear()
                missing = range(len(pieces))
            new = list(dict.fromkeys([pieces[i] for i in missing]))
            for lo in range(0, len(new), 50_000):
                some = new[lo : lo + 50_000]
                made = self.encode(some)
                if isinstance(made, tuple):
                    flat, sizes = made
                else:
                    flat, sizes = np.concatenate(made), np.fromiter(map(len, made), np.int64, len(made))
                n, total = len(self.rows), len(flat)
                self._room(n + len(some), self.used + total)
                self.starts[n : n + len(some)] = self.used + np.cumsum(sizes) - sizes
                self.lengths[n : n + len(some)] = sizes
                self.flat[self.used : self.used + total] = flat
                self.used += total
                self.held += sum(map(len, some)) + self.EACH * len(some)
                self.rows.update(zip(some, range(n, n + len(some)), strict=True))
            for i, row in zip(missing, map(self.rows.__getitem__, [pieces[i] for i in missing]), strict=True):
                at[i] = row
        rows = np.array(at, dtype=np.int64)
        lengths = self.lengths[rows]
        return self.flat[ragged_positions(self.starts[rows], lengths)], lengths
