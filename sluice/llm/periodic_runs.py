"""Periodic runs of words by seed and extend along diagonals.

A run of smallest period q and length n repeats its words at the lag q over
n - q places, at least max(6, 4 q) - q. Lags are dealt into classes (k / 3, k]
so that k words are a guaranteed overlap of each lag in the class, and no less
than the lag. Grams of k words are indexed, and occurrences of a gram in the
same document are paired with the next one: as k is not less than the lag,
the next occurrence of a gram within a run lies exactly one smallest period
on, so that these pairs seed every run and no other pairs are needed. A seed is
extended along its diagonal in both directions until words differ. A table of
the furthest place covered at each lag suppresses seeds within a run that is
known already.

Grams are named by prefix doubling over the words of a slice of documents at a
time, and places whose gram occurs once in its document are dropped early, so
that a text without repeats costs one pass. Documents are independent: there is
no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, table, text_slices, whole_text
from .ranks import Stretches, name_words, repeated, split_words

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed_text", T.StringType())]


def lag_classes(longest: int) -> Iterator[tuple[int, int]]:
    """(k, smallest lag): grams of k words seed the runs of the lags up to k, in a document of at most `longest` words."""
    low = 1
    while low * TIMES <= longest:
        # what the lags low, low + 1, ... guarantee; the overlap grows with the lag from where TIMES decides on
        k = min(max(LEAST, TIMES * q) - q for q in range(low, low + LEAST))
        yield k, low
        low = k + 1


def _agree(names: np.ndarray, a: int, b: int, way: int) -> int:
    """How many words from a and b on (way 1), or before them (way -1), agree one by one; a < b."""
    done, step = 0, 16
    while True:
        size = min(step, len(names) - b - done if way > 0 else a - done)
        if size <= 0:
            return done
        x, y = (names[a + done : a + done + size], names[b + done : b + done + size]) if way > 0 else (names[a - done - size : a - done][::-1], names[b - done - size : b - done][::-1])
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done += size
        step *= 4


def find_runs(names: np.ndarray, document: np.ndarray, longest: int) -> np.ndarray:
    """Runs (start, length, period) as rows, by start and period.

    names: the words of documents in a row; each document is followed by a
    place with a negative name that occurs nowhere else.
    """
    grams = Stretches(repeated(names, document))
    found = []
    for k, low in lag_classes(longest):
        rank = grams.of(k)
        at = np.flatnonzero(rank >= 0)
        if not len(at):
            if not grams.any():
                break
            continue
        at = at[np.argsort(rank[at], kind="stable")]
        lag = np.diff(at)
        seed = (rank[at[1:]] == rank[at[:-1]]) & (lag >= low) & (lag <= k)
        first, lag = at[:-1][seed], lag[seed]
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        # a stretch of neighbouring seeds of a lag is one diagonal piece: its first is enough
        head = np.append(True, (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + 1)) if len(first) else np.zeros(0, bool)
        covered: dict[int, int] = {}
        for i, q in zip(first[head].tolist(), lag[head].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            begin = i - _agree(names, i, i + q, -1)
            end = i + k + _agree(names, i + k, i + k + q, 1)
            covered[q] = end
            if end - begin + q >= max(LEAST, TIMES * q):
                found.append((begin, end - begin + q, q))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def kept_places(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stay: each run keeps its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def runs_of_texts(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all documents with starts in their own document, and the document of each."""
    counts = np.array([len(w) for w in texts], np.int64)
    starts = np.cumsum(counts + 1) - (counts + 1)
    names = np.empty(int((counts + 1).sum()), np.int64)
    stops = starts + counts
    words = np.ones(len(names), bool)
    words[stops] = False
    names[words] = name_words((w for t in texts for w in t), int(counts.sum()))
    names[stops] = -1 - np.arange(len(stops))
    runs = find_runs(names, np.repeat(np.arange(len(texts)), counts + 1), int(counts.max(initial=0)))
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs[:, 0] -= starts[owner]
    return runs, owner


def collapse(
    df: DataFrame, text_col: str = "text", keep: list[str] | None = None, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id"
) -> DataFrame:
    """Add n_words, runs (array of start, length, period, by start and period) and collapsed_text.

    A run is a stretch of consecutive words with smallest period q, at least
    max(6, 4 q) words long, that no neighbouring word extends. collapsed_text
    has the words that stay, joined by one space: those that no run contains
    after its first q words. Null and empty texts have no words, no runs and an
    empty collapsed_text; rows are judged one by one, so that repeated rows get
    equal results; an empty table gives an empty table. Columns of keep
    (default: all) stay unless named like a new one. prepare(id, words) may
    replace a document's words before they are searched.
    """
    names = {f.name for f in FIELDS}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], (F.col(f"`{id_col}`").cast("long") if prepare else F.lit(None).cast("long")).alias("id"), whole_text(text_col).alias("text"))
    schema = T.StructType([T.StructField(c, source.schema[i].dataType) for i, c in enumerate(keep)] + FIELDS)
    run_type = pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])

    def run(batches):
        only(("runs",))
        n = len(keep)
        for batch in (part for whole in batches for part in text_slices(whole, n + 1)):
            texts = [split_words(t) for t in batch.column(n + 1).to_pylist()]
            if prepare:
                texts = [prepare(i, w) for i, w in zip(batch.column(n).to_pylist(), texts, strict=True)]
            runs, owner = runs_of_texts(texts)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            out = []
            for words, lo, hi in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if lo < hi:
                    words = [words[i] for i in np.flatnonzero(kept_places(runs[lo:hi], len(words))).tolist()]
                out.append(b" ".join(words).decode("utf-8"))
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T], fields=list(run_type))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array([len(w) for w in texts], pa.int64()), lists, pa.array(out, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def damaged(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's damage: in one document of ten all words from some place on repeat with some period. A null id damages nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def longest_exponent(runs: Column) -> Column:
    """The run of the greatest length / period, by whole numbers; of equals the first."""
    better = lambda r, b: r["length"] * b["period"] > b["length"] * r["period"]
    none = F.lit(None).cast(RUN.simpleString())
    return F.aggregate(runs, none, lambda b, r: F.when(b.isNull() | better(r, b), r).otherwise(b))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse(table(spark, sf_dir, "documents"), keep=["doc_id"], prepare=damaged).withColumn("best", longest_exponent(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
