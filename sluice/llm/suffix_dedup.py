"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A string of `length` bytes is removed wherever it starts if it starts anywhere
else too. Arrays over all suffixes would be many times the text, so suffixes
are sampled: each window of `length` bytes takes the k-gram of least hash in it
as anchor, which every copy of the window takes at the same place. An entry is
the suffix at an anchor with the run of windows that share it.

The documents come in batches. The entries of a batch are merge-scanned, in the
order of the hashes of anchors and of whole runs, with the levels
that are there (tables in the shared folder) for long matches; what is new
becomes a level, and levels of like size are merged, so that there are
logarithmically many. Runs equal as a whole are settled by the scan: they have
the same anchor and the same BLAKE2b digest of their bytes, under a key that is
drawn anew for each index, so that texts can't be made to collide and two
different runs of an anchor agree with a probability of 2^-64. Anchors are only
meeting places; texts that share one by chance cost a comparison. Runs that
share only their anchor are compared by their bytes: they are put in suffix order forward and in prefix order backward from
the anchor, with the lengths that neighbours have in common, and a window is
repeated if another run agrees with it on both sides of the anchor.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, mix64, only, ragged_positions, sliding_min, table, text_slices, whole_text

LENGTH, GRAM = 200, 100
#: Bytes that are hashed at a time; positions in a chunk take 20 bits.
CHUNK = 1 << 20
#: Entries a scanning task holds before it sends them on.
HELD = 1_000_000
#: An anchor with more different runs than this has its windows dealt out one by one.
LARGE_GROUP = 1_000
#: Runs whose arrays are built at once, at least; the runs of an anchor stay together.
ARRAY = 4096
#: Batches that dedup() deals documents into.
BATCHES = 3
_POS = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Grams:
    """Meeting places: hashes of all k-grams of a buffer of at most CHUNK bytes. They decide nothing about equality."""

    BASE = 0x9E3779B97F4A7C15
    tables: tuple = ()

    def __init__(self, data: np.ndarray):
        if not Grams.tables:
            Grams.tables = _powers(self.BASE, CHUNK + 1), _powers(pow(self.BASE, -1, 2**64), CHUNK + 1)
        up, self.down = Grams.tables
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:-k]) * self.down[:n])


def digests(data: bytes, lo: np.ndarray, hi: np.ndarray, key: bytes) -> np.ndarray:
    """Keyed digests of data[lo:hi], 64 bits each."""
    whole = memoryview(data)
    made = [hashlib.blake2b(whole[a:b], digest_size=8, key=key).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    return np.frombuffer(b"".join(made), "<u8")


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of whole texts, or parts of long ones: (buffer, [(text, first byte, start in buffer, size)])."""
    part, parts, size = [], [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        step = CHUNK - length + 1
        for lo in range(0, len(t) - length + 1, step):
            piece = t[lo : lo + CHUNK] if len(t) > CHUNK else t
            if size + len(piece) > CHUNK:
                yield b"".join(part), parts
                part, parts, size = [], [], 0
            parts.append((i, lo, size, len(piece)))
            part.append(piece)
            size += len(piece)
            if len(t) <= CHUNK:
                break
    if parts:
        yield b"".join(part), parts


def entries(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, key: bytes = b"") -> tuple:
    """(text, first window, last window, anchor's hash, digest of the run's bytes, anchor less first window) for all texts."""
    out = []
    for data, parts in _chunks(texts, length):
        buffer = np.frombuffer(data, np.uint8)
        cores = Grams(buffer).grams(gram)
        least = sliding_min((cores & ~_POS) | np.arange(len(cores), dtype=np.uint64), length - gram + 1)
        anchor = (least & _POS).astype(np.int64)
        text, first, start, size = (np.array(c, np.int64) for c in zip(*parts, strict=True))
        windows = size - length + 1
        s = ragged_positions(start, windows)
        a = anchor[s]
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)))
        lo, hi = s[new], s[np.append(new[1:] - 1, len(s) - 1)]
        at = np.searchsorted(start, lo, side="right") - 1
        shift = first[at] - start[at]
        out.append((text[at], lo + shift, hi + shift, cores[a[new]], digests(data, lo, hi + length, key), a[new] - lo))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


COVER, ENTRY, PROBE, LARGE = 0, 1, 2, 3
#: A run [lo, hi] of window starts: covered (COVER), an entry of a level (ENTRY), or to be compared with the others of its
#: anchor together (PROBE) or window by window (LARGE). core is the hash of the anchor, run the digest of the bytes, back is the anchor's place after lo;
#: many: it is known to be covered.
ROW = T.StructType(
    [T.StructField(n, k) for n, k in (("kind", T.ByteType()), ("core", T.LongType()), ("run", T.LongType()), ("id", T.LongType()), ("th", T.LongType()), ("lo", T.LongType()), ("hi", T.LongType()), ("back", T.LongType()), ("many", T.BooleanType()))]
)
_NUMBERS = [f.name for f in ROW.fields[1:]]
Rows = dict[str, np.ndarray]


def _some(x: Rows, which) -> Rows:
    return {c: v[which] for c, v in x.items()}


def _batches(kind: int, x: Rows, core: np.ndarray | None = None, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    n = len(x["id"])
    core = x["core"] if core is None else core
    for lo in range(0, n, size):
        p = slice(lo, lo + size)
        numbers = [core[p], *[x[c][p] for c in _NUMBERS[1:-1]]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers[0]), kind, np.int8)), *[pa.array(v.view(np.int64)) for v in numbers], pa.array(x["many"][p])], names=ROW.names)


def _settle(x: Rows) -> tuple[Rows, Rows]:
    """Of entries sorted by core and run: those that are now known to be covered, and the first of each run, marked."""
    new = np.append(True, (x["core"][1:] != x["core"][:-1]) | (x["run"][1:] != x["run"][:-1]))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(new)))
    twice = (size > 1) | np.logical_or.reduceat(x["many"], at)
    first = _some(x, at)
    first["many"] = twice
    if "old" in x:
        first["old"] = np.logical_or.reduceat(x["old"], at)
    return _some(x, np.repeat(twice, size) & ~x["many"]), first


def _scan(length: int, gram: int, key: bytes):
    """Texts to entries; copies within the task are settled here, so that no run is sent in great number."""

    def run(batches):
        only(("suffixes",))
        held, size = [], 0

        def flush():
            x = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            covered, first = _settle(_some(x, np.lexsort((x["run"], x["core"]))))
            # a covered run needs no meeting: it goes anywhere
            yield from _batches(COVER, covered, core=mix64(covered["id"].view(np.uint64) + covered["lo"].astype(np.uint64)))
            yield from _batches(ENTRY, first)
            held.clear()

        for batch in (part for whole in batches for part in text_slices(whole, 2)):
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            text, lo, hi, core, content, back = entries([t.encode("utf-8", "replace") for t in batch.column(2).to_pylist()], length, gram, key)
            if len(text):
                held.append({"core": core, "run": content, "id": ids[text], "th": hashes[text], "lo": lo, "hi": hi, "back": back, "many": np.zeros(len(text), bool)})
                size += len(text)
            if size > HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def _merge_scan(large: int, level: bool):
    """Entries of a batch and of the levels, in the order of core and run, to covered runs, entries of the batch's own
    level if it gets one, and runs to be compared. Holds no more than `large` runs of an anchor."""

    def run(batches):
        carry, hot = None, None

        def leave(x: Rows):
            """Whole anchors, or some runs of a hot one."""
            if level:
                yield from _batches(ENTRY, _some(x, ~x["old"]))
            at = np.flatnonzero(np.append(True, x["core"][1:] != x["core"][:-1]))
            size = np.diff(np.append(at, len(x["core"])))
            asked = np.repeat((size > 1) & np.logical_or.reduceat(~x["old"], at), size)
            many = x["core"] == hot if hot is not None else np.zeros(len(asked), bool)
            yield from _batches(PROBE, _some(x, asked & ~many))
            yield from _batches(LARGE, _some(x, many))

        for batch in batches:
            kind = batch.column(0).to_numpy()
            if (kind == COVER).any():
                yield batch.filter(pa.array(kind == COVER)).select(ROW.names)
            batch = batch.filter(pa.array(kind == ENTRY))
            if not batch.num_rows:
                continue
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in [*_NUMBERS, "old"]}
            x["core"], x["run"] = x["core"].view(np.uint64), x["run"].view(np.uint64)
            if carry is not None:
                x = {c: np.concatenate([carry[c], v]) for c, v in x.items()}
            covered, x = _settle(x)
            yield from _batches(COVER, covered)
            last = x["core"] == x["core"][-1]
            if not last.all():
                yield from leave(_some(x, ~last))
            carry = _some(x, last)
            if len(carry["core"]) > large:
                hot = carry["core"][-1]
                yield from leave(_some(carry, slice(0, -1)))
                carry = _some(carry, slice(-1, None))
        if carry is not None:
            yield from leave(carry)

    return run


def _windows(batch: pa.RecordBatch, length: int, key: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of bytes: run, window in it, and digest of each window, some runs at a time."""
    data = batch.column("bytes").to_pylist()
    lo = 0
    while lo < len(data):
        hi, size = lo, 0
        while hi < len(data) and (hi == lo or size + len(data[hi]) <= CHUNK):
            size += len(data[hi])
            hi += 1
        sizes = np.fromiter(map(len, data[lo:hi]), np.int64, hi - lo)
        start = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        s = ragged_positions(start, count)
        owner = np.repeat(np.arange(lo, hi), count)
        yield owner, s - start[owner - lo], digests(b"".join(data[lo:hi]), s, s + length, key)
        lo = hi


SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "th", "lo", "hi")])


class SuffixArray:
    """Strings in suffix order: `order`, and how many bytes each has in common with the one before it (`common`)."""

    def __init__(self, data: np.ndarray, start: np.ndarray, lengths: np.ndarray, width: int, backward: bool = False):
        """String i is data[start : start + lengths], read from its end if backward, and filled up to width with zeros."""
        rows = np.zeros((len(start), max(width, 1)), np.uint8)
        columns = np.arange(rows.shape[1])
        there = columns >= rows.shape[1] - lengths[:, None] if backward else columns < lengths[:, None]
        rows[there] = data[ragged_positions(start, lengths)]
        if backward:
            rows = np.ascontiguousarray(rows[:, ::-1])
        self.order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
        rows = rows[self.order]
        agrees = rows[1:] == rows[:-1]
        self.common = np.where(agrees.all(1), rows.shape[1], agrees.argmin(1))

    def groups(self, n: int) -> np.ndarray:
        """A number for each string; strings have the same if they agree on n bytes."""
        out = np.zeros(len(self.order), np.int64)
        out[self.order[1:]] = np.cumsum(self.common < n)
        return out


def repeated_windows(data: list[bytes], back: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which windows of runs of bytes with anchors at `back` occur in another run too.

    Column o is the window that begins o bytes before the anchor. It is
    repeated if another run has the same o bytes before and length - o bytes
    from the anchor on. Runs of different anchors may come together.
    """
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    buffer, start = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes
    after, widest = np.minimum(sizes - back, length), length - gram
    forward = SuffixArray(buffer, start + back, after, length)
    backward = SuffixArray(buffer, start, back, widest, backward=True)
    out = np.zeros((len(data), widest + 1), bool)
    for o in range(widest + 1):
        here = np.flatnonzero((back >= o) & (after >= length - o))
        if len(here) > 1:
            _, which, n = np.unique(forward.groups(length - o)[here] * len(data) + backward.groups(o)[here], return_inverse=True, return_counts=True)
            out[here, o] = n[which] > 1
    return out


def _compare(length: int, gram: int):
    """Runs of bytes in the order of their anchors to the runs of windows in them that occur twice or more."""

    def run(batches):
        only(("suffixes",))
        held: list[pa.RecordBatch] = []

        def compared(rows: pa.RecordBatch):
            core, id_, th, lo, back = (rows.column(c).to_numpy() for c in ("core", "id", "th", "lo", "back"))
            found = repeated_windows(rows.column("bytes").to_pylist(), back, length, gram)
            found &= ~rows.column("many").to_numpy(zero_copy_only=False)[:, None]
            # windows in the order of their starts, with a gap between runs
            flags = np.zeros((len(core), found.shape[1] + 2), np.int8)
            flags[:, 1:-1] = found[:, ::-1]
            edge = np.flatnonzero(np.diff(flags.ravel()))
            first, last = edge[::2], edge[1::2] - 1
            owner, width = first // flags.shape[1], flags.shape[1]
            base = lo[owner] + back[owner] - (width - 3)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (id_[owner], th[owner], base + first % width, base + last % width)], names=SPAN.names)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ARRAY:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            core = rows.column("core").to_numpy()
            whole = int(np.flatnonzero(np.append(True, core[1:] != core[:-1]))[-1])  # the last anchor may go on
            if whole:
                yield from compared(rows.slice(0, whole))
            held = [rows.slice(whole)]
        if sum(b.num_rows for b in held):
            yield from compared(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


WINDOW = T.StructType([T.StructField("core", T.LongType()), *SPAN.fields[:3], T.StructField("key", T.LongType()), T.StructField("many", T.BooleanType())])


def _single(length: int, key: bytes):
    """Runs of bytes to their windows, each with its digest."""

    def run(batches):
        only(("suffixes",))
        for batch in batches:
            core, ids, hashes, first, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("core", "id", "th", "lo", "many"))
            for owner, at, found in _windows(batch, length, key):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (core[owner], ids[owner], hashes[owner], first[owner] + at, found.view(np.int64), many[owner])], names=WINDOW.names)

    return run


class SuffixIndex:
    """The family: add() takes in batches of documents, spans() tells what is repeated since it was last asked.

    docs have id, th (64 bits that tell texts of an id apart) and text, and are
    read again when runs are compared: give tables, not unstable plans. Levels
    and matches are tables in the shared folder; forget() deletes them.
    """

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM, large: int = LARGE_GROUP):
        self.spark, self.length, self.gram, self.large = spark, length, gram, large
        self.key = secrets.token_bytes(32)
        self.levels: list[tuple[DataFrame, int, Callable]] = []  # entries, their number, and what deletes them
        self.docs: list[DataFrame] = []
        self.matches: list[DataFrame] = []
        self.tables: list[DataFrame] = []

    def _deal(self, rows: DataFrame) -> DataFrame:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "core").sortWithinPartitions("core", "run")

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Merge-scan docs against all levels and make them a level; not if they are the last to come."""
        rows = docs.select("id", "th", "text").mapInArrow(_scan(self.length, self.gram, self.key), ROW).withColumn("old", F.lit(False))
        for level, _, _ in self.levels:
            rows = rows.unionByName(level.withColumn("old", F.lit(True)))
        found = materialize(self._deal(rows).mapInArrow(_merge_scan(self.large, not last), ROW), "suffix-matches", by="kind")
        self.docs.append(docs)
        self.matches.append(found)
        self.tables.append(found)
        own = found.filter(F.col("kind") == ENTRY)
        self.levels.append((own, own.count(), partial(forget, found, part=f"kind={ENTRY}")))
        while len(self.levels) > 1 and not last and self.levels[-2][1] < 2 * self.levels[-1][1]:
            (b, n, drop_b), (a, m, drop_a) = self.levels.pop(), self.levels.pop()
            merged = materialize(self._deal(a.unionByName(b)), "suffix-level")
            drop_a(), drop_b()
            self.levels.append((merged, n + m, partial(forget, merged)))
        if last:
            self._drop_levels()

    def _drop_levels(self) -> None:
        for _, _, drop in self.levels:
            drop()
        self.levels = []

    def spans(self) -> DataFrame:
        """Runs [lo, hi] of first bytes of repeated strings, as a set of (lo, hi) for each (id, th) that has any."""
        matched = reduce(DataFrame.unionByName, self.matches)
        self.matches = []
        docs = reduce(DataFrame.unionByName, self.docs)
        covered = matched.filter(F.col("kind") == COVER).select("id", "th", "lo", "hi")
        # a run that two batches asked about is asked about once
        unclear = matched.filter(F.col("kind") >= PROBE).dropDuplicates(["kind", "core", "run"])
        taken = F.substring(F.col("text").cast("binary"), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + self.length).cast("int"))
        texts = docs.select("id", "th", "text")
        if docs.groupBy("id", "th").count().filter("count > 1").limit(1).count():  # rows that repeat both bring their bytes once
            texts = texts.dropDuplicates(["id", "th"])
        runs = unclear.join(texts, ["id", "th"]).select("kind", "core", "run", "id", "th", "lo", "back", "many", taken.alias("bytes"))
        small = self._deal(runs.filter(F.col("kind") == PROBE)).mapInArrow(_compare(self.length, self.gram), SPAN)
        out, done = covered.unionByName(small), []
        if matched.filter(F.col("kind") == LARGE).limit(1).count():
            dealt = materialize(runs.filter(F.col("kind") == LARGE).mapInArrow(_single(self.length, self.key), WINDOW), "suffix-windows")
            twice = materialize(dealt.groupBy("core", "key").count().filter("count > 1").select("core", "key"), "suffix-windows")
            done = [dealt, twice]
            out = out.unionByName(dealt.filter(~F.col("many")).join(twice, ["core", "key"]).select("id", "th", "lo", F.col("lo").alias("hi")))
        spans = materialize(out.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
        forget(*done)
        return spans

    def forget(self) -> None:
        self._drop_levels()
        forget(*self.tables)
        self.docs, self.matches, self.tables = [], [], []


RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("clean_text", T.StringType())])


def cut(data: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple:
    """RESULT's values for a text whose repeated strings start in the runs [lo, hi]."""
    if not len(lo):
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace")
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.append(True, lo[1:] > end[:-1])
    begin, stop = lo[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    edges = [0, *np.column_stack([begin, stop]).ravel().tolist(), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    # a character goes only if all its bytes go
    chars = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        while 0 < a < len(data) and a < b and data[a] & 0xC0 == 0x80:
            a -= 1
        while a < b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        chars.append(data[a:b])
    return len(data), int((stop - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest(), b"".join(chars).decode("utf-8", "replace")


def dedup(df: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE_GROUP, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_text: bool = True, batches: int = BATCHES) -> DataFrame:
    """Add RESULT's columns: what goes when every byte covered by a repeated string of `length` bytes goes.

    Strings are judged on the input, within and across rows; overlapping
    occurrences count. n_removed, n_spans and kept_sha256 are to the byte;
    clean_text keeps a character unless all its bytes go. Null and empty
    texts, and texts shorter than `length`, lose nothing. Rows that repeat id
    and text are copies of each other, as are rows that only share the text;
    ids may be null. Columns of keep (default: all) stay unless named like a
    new one. An empty table gives an empty table. Documents are taken in in
    `batches` by their text's hash; the result does not depend on their number.
    """
    names = {f.name for f in RESULT.fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    # an integer key of few bytes: ids may repeat or be null, the text's hash tells such rows apart
    text = whole_text(text_col)
    keyed = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    docs = keyed.select("id", "th", "text")
    index = SuffixIndex(df.sparkSession, length, gram, large)
    for k in range(batches):
        index.add(docs.filter(F.pmod("th", F.lit(batches)) == k), last=k == batches - 1)
    spans = index.spans()
    index.forget()
    joined = keyed.join(spans, ["id", "th"], "left").select(*[f"k{i}" for i in range(len(keep))], "text", "spans")
    fields = RESULT.fields if with_text else RESULT.fields[:-1]
    schema = T.StructType([T.StructField(c, joined.schema[i].dataType) for i, c in enumerate(keep)] + fields)
    none = np.zeros(0, np.int64)

    def run(parts):
        only(("suffixes",))
        n = len(keep)
        for batch in (part for whole in parts for part in text_slices(whole, n)):
            made = []
            for t, found in zip(*[batch.column(n + i) for i in range(2)], strict=True):
                found = tuple(found.values.field(k).to_numpy() for k in ("lo", "hi")) if found.is_valid else (none, none)
                made.append(cut(t.as_py().encode("utf-8", "replace"), *found, length)[: len(fields)])
            columns = [pa.array(list(c), type=k) for c, k in zip(zip(*made, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], *columns], names=schema.names)

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)
