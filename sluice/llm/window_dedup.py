"""Removal of repeated word windows by super-k-mer partitioning.

A window is 20 consecutive words of a document. It is a repeat if the same
words begin earlier: in a document of smaller id, or further up in the same one.

The gram of five words of least hash in a window, the leftmost of equals, is its
minimiser; every copy of the window has it at the same place. Consecutive
windows that share their minimiser travel as one packed string, a super-k-mer,
to the bucket of the minimiser's hash, instead of each with its own 20 words.
In a bucket the windows of a minimiser are sorted by their words, named exactly
by prefix doubling, and by where they begin: the first of equals stays.

All super-k-mers would be several times the text, so a first pass sends their
minimisers and places alone, and only those that meet another of the same
minimiser are packed. Equal super-k-mers of a task are settled before that, so
that of a group of copies each task sends one. A minimiser with more
super-k-mers than a task should hold (the edges of a passage that very many
documents share) has its windows sent on one by one, under a keyed digest of
128 bits, and aggregated.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, mix64, only, ragged_positions, sliding_min, table, text_slices, whole_text
from .ranks import Stretches, name_words, repeated, split_words

WINDOW, GRAM = 20, 5
#: Bytes of super-k-mers that a task gathers before it sends them on.
HELD = 32 << 20
#: A minimiser with more super-k-mers than this has its windows dealt out one by one.
LARGE_GROUP = 20_000
#: Super-k-mers whose windows are sorted at once, at least; those of a minimiser stay together.
SORTED = 20_000

COVER, PACKED, SINGLE = 0, 1, 2
#: Windows lo .. hi of a document: known to be repeats (COVER), a super-k-mer, with its words where they are asked for
#: (PACKED), or one window of a large group with its digest (SINGLE). id and th are the document, core the minimiser's hash.
ROW = T.StructType(
    [T.StructField("kind", T.ByteType()), T.StructField("core", T.LongType()), T.StructField("packed", T.BinaryType())]
    + [T.StructField(c, T.LongType()) for c in ("id", "th", "lo", "hi")]
)


class _Hashes(dict):
    """Words to 64 bits. They choose minimisers and buckets, and decide nothing about equality."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def minimisers(hashes: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, minimiser's hash) of the super-k-mers of documents of `counts` words in a row; places count over all words."""
    starts = np.cumsum(counts) - counts
    long = counts >= window
    if not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = len(hashes) - gram + 1
    cores = np.zeros(size, np.uint64)
    for j in range(gram):
        cores = cores * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + size]
    cores = mix64(cores)
    low = np.uint64(2**32 - 1)
    least = sliding_min((cores & ~low) | np.arange(size, dtype=np.uint64), window - gram + 1)
    s = ragged_positions(starts[long], counts[long] - window + 1)
    anchor = (least[s] & low).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)))
    return s[new], s[np.append(new[1:] - 1, len(s) - 1)], cores[anchor[new]]


def _rows(kind: int, core: list[int], packed: list[bytes] | None, places: list[tuple]) -> Iterator[pa.RecordBatch]:
    for p in (slice(lo, lo + 20_000) for lo in range(0, len(places), 20_000)):
        n = len(places[p])
        columns = [pa.array(c, pa.int64()) for c in zip(*places[p], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(core[p], pa.int64()), pa.array(packed[p], pa.binary()) if packed else pa.nulls(n, pa.binary()), *columns], names=ROW.names)


def _anywhere(places: list[tuple]) -> list[int]:
    """A known repeat needs no meeting: it goes anywhere."""
    x = np.array([(p[0] ^ p[1] ^ p[2]) for p in places], np.int64)
    return mix64(x.view(np.uint64)).view(np.int64).tolist()


class _Held:
    """Super-k-mers of a task by their words; of equal ones the first place stays and the others are covered."""

    def __init__(self, packed: bool):
        self.packed = packed
        self.clear()

    def clear(self) -> None:
        self.first: dict[bytes, tuple] = {}
        self.covered: list[tuple] = []
        self.size = 0

    def add(self, words: bytes, core: int, place: tuple) -> None:
        known = self.first.get(words)
        if known is None:
            self.first[words] = (core, place)
            self.size += len(words)
        elif place > known[1]:
            self.covered.append(place)
        elif place < known[1]:
            self.covered.append(known[1])
            self.first[words] = (core, place)

    def full(self) -> bool:
        return self.size > HELD or len(self.covered) > 200_000

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield from _rows(COVER, _anywhere(self.covered), None, self.covered)
        yield from _rows(PACKED, [x[0] for x in self.first.values()], list(self.first) if self.packed else None, [x[1] for x in self.first.values()])
        self.clear()


class _Line:
    """The words of some documents in one string, to cut super-k-mers from by the places of words."""

    def __init__(self, texts: list[list[bytes]]):
        self.words = [w for t in texts for w in t]
        self.counts = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.line = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)
        self.begin = np.append(0, ends)

    def cut(self, lo: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The words lo .. end - 1 of each."""
        return [self.line[a:b] for a, b in zip(self.begin[lo].tolist(), (self.begin[end] - 1).tolist(), strict=True)]


def _scan(window: int, gram: int):
    """Texts to super-k-mers without their words; equal ones of the task are settled."""

    def run(batches):
        hashes = only(("windows",), _Hashes)
        held = _Held(False)
        for batch in (part for whole in batches for part in text_slices(whole, 2)):
            ids, ths = (batch.column(i).to_pylist() for i in (0, 1))
            x = _Line([split_words(t) for t in batch.column(2).to_pylist()])
            if len(x.words) < window:
                continue
            lo, hi, core = minimisers(np.fromiter(map(hashes.__getitem__, x.words), np.uint64, len(x.words)), x.counts, window, gram)
            owner = np.searchsorted(np.cumsum(x.counts), lo, side="right")
            first = x.starts[owner]
            for words, d, c, a, b in zip(x.cut(lo, hi + window), owner.tolist(), core.view(np.int64).tolist(), (lo - first).tolist(), (hi - first).tolist(), strict=True):
                held.add(words, c, (ids[d], ths[d], a, b))
            if held.full():
                yield from held.rows()
        yield from held.rows()

    return run


def _shared(batches):
    """Rows in the order of their minimisers to those that have company, and what is covered."""
    before, last = None, None  # the last row, and whether it was sent on
    for batch in batches:
        kind = batch.column(0).to_numpy()
        if (kind == COVER).any():
            yield batch.filter(pa.array(kind == COVER))
        batch = batch.filter(pa.array(kind == PACKED))
        if not batch.num_rows:
            continue
        core = batch.column("core").to_numpy()
        same = core[1:] == core[:-1]
        company = np.append(same, False) | np.append(False, same)
        if before is not None and before.column("core")[0].as_py() == core[0]:
            company[0] = True
            if not last:
                yield before
        before, last = batch.slice(batch.num_rows - 1), bool(company[-1])
        if company.any():
            yield batch.filter(pa.array(company))


def _pack(window: int):
    """Documents with the places of super-k-mers (lo, hi, core) to these with their words."""

    def run(batches):
        only(("windows packed",))
        held = _Held(True)
        for batch in (part for whole in batches for part in text_slices(whole, 2)):
            x = _Line([split_words(t) for t in batch.column(2).to_pylist()])
            asked = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            lo, hi, core = (asked.flatten().field(k).to_numpy() for k in ("lo", "hi", "core"))
            ids, ths = (batch.column(i).to_pylist() for i in (0, 1))
            first = x.starts[owner]
            for words, d, c, a, b in zip(x.cut(first + lo, first + hi + window), owner.tolist(), core.tolist(), lo.tolist(), hi.tolist(), strict=True):
                held.add(words, c, (ids[d], ths[d], a, b))
            if held.full():
                yield from held.rows()
        yield from held.rows()

    return run


def later_windows(packed: list[bytes], places: np.ndarray, window: int) -> list[tuple]:
    """Runs (id, th, lo, hi) of windows of super-k-mers that begin earlier too. places: id, th, lo, hi as rows."""
    words = [p.split(b" ") for p in packed]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(counts + 1) - (counts + 1)
    names = np.full(int((counts + 1).sum()), -1, np.int64)
    names[ragged_positions(starts, counts)] = name_words((w for ws in words for w in ws), int(counts.sum()))
    rank = Stretches(repeated(names)).of(window)
    at = np.flatnonzero(rank >= 0)
    if not len(at):
        return []
    owner = np.searchsorted(starts, at, side="right") - 1
    id_, th, lo = places[owner, 0], places[owner, 1], places[owner, 2] + at - starts[owner]
    order = np.lexsort((lo, th, id_, rank[at]))
    rank, id_, th, lo = rank[at][order], id_[order], th[order], lo[order]
    head = np.maximum.accumulate(np.where(np.append(True, rank[1:] != rank[:-1]), np.arange(len(rank)), 0))
    later = (id_ != id_[head]) | (th != th[head]) | (lo != lo[head])
    id_, th, lo = id_[later], th[later], lo[later]
    order = np.lexsort((lo, th, id_))
    id_, th, lo = id_[order], th[order], lo[order]
    new = np.flatnonzero(np.append(True, (id_[1:] != id_[:-1]) | (th[1:] != th[:-1]) | (lo[1:] > lo[:-1] + 1))) if len(lo) else np.zeros(0, np.int64)
    last = np.append(new[1:] - 1, len(lo) - 1)[: len(new)]
    return list(zip(id_[new].tolist(), th[new].tolist(), lo[new].tolist(), lo[last].tolist(), strict=True))


def _count(window: int, large: int, key: bytes):
    """Rows in the order of their minimisers to the windows that are repeats, and single windows of large groups."""

    def singles(rows: pa.RecordBatch):
        digests, places = [], []
        for packed, core, *place in zip(*[rows.column(c).to_pylist() for c in ("packed", "core", "id", "th", "lo", "hi")], strict=True):
            words = packed.split(b" ")
            for i in range(len(words) - window + 1):
                digests.append(hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16, key=key).digest())
                places.append((place[0], place[1], place[2] + i, place[2] + i))
            if len(places) > 100_000:
                yield from _rows(SINGLE, [0] * len(places), digests, places)
                digests, places = [], []
        yield from _rows(SINGLE, [0] * len(places), digests, places)

    def sort(rows: pa.RecordBatch):
        core = rows.column("core").to_numpy()
        same = np.flatnonzero(core[1:] == core[:-1])
        shared = np.unique(np.concatenate([same, same + 1]))
        if len(shared):  # a super-k-mer that is alone with its minimiser holds no repeat
            rows = rows.take(pa.array(shared))
            places = np.column_stack([rows.column(c).to_numpy() for c in ("id", "th", "lo", "hi")])
            found = later_windows(rows.column("packed").to_pylist(), places, window)
            yield from _rows(COVER, [0] * len(found), None, found)

    def run(batches):
        only(("windows counted",))
        held: list[pa.RecordBatch] = []
        hot = None  # the minimiser of a large group that is being dealt out
        for batch in batches:
            kind = batch.column(0).to_numpy()
            if (kind == COVER).any():
                yield batch.filter(pa.array(kind == COVER))
            batch = batch.filter(pa.array(kind == PACKED))
            if hot is not None and batch.num_rows:
                n = int(np.searchsorted(batch.column("core").to_numpy(), hot, side="right"))
                yield from singles(batch.slice(0, n))
                batch = batch.slice(n)
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < SORTED:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            core = rows.column("core").to_numpy()
            whole = int(np.searchsorted(core, core[-1]))  # the last minimiser may go on
            if whole:
                yield from sort(rows.slice(0, whole))
            held, hot = [rows.slice(whole)], None
            if rows.num_rows - whole > large:
                hot = int(core[-1])
                yield from singles(held.pop())
        if held:
            yield from sort(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def later_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, large: int = LARGE_GROUP) -> DataFrame:
    """id, th and spans, a set of (lo, hi): the windows of documents (id, th, text) that begin earlier too.

    docs are read twice: give a table, not an unstable plan. Rows that repeat
    id and th count as one.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda rows: rows.repartition(n, "core").sortWithinPartitions("core")
    places = docs.select("id", "th", "text").mapInArrow(_scan(window, gram), ROW).drop("packed")
    met = materialize(deal(places).mapInArrow(_shared, T.StructType([f for f in ROW if f.name != "packed"])), "windows-met")
    asked = met.filter(F.col("kind") == PACKED).groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi", "core")).alias("asked"))
    packed = docs.join(asked, ["id", "th"]).select("id", "th", "text", "asked").mapInArrow(_pack(window), ROW)
    found = materialize(deal(packed).mapInArrow(_count(window, large, secrets.token_bytes(32)), ROW), "windows")
    out = found.filter(F.col("kind") == COVER).select("id", "th", "lo", "hi").unionByName(met.filter(F.col("kind") == COVER).select("id", "th", "lo", "hi"))
    if found.filter(F.col("kind") == SINGLE).limit(1).count():
        single = found.filter(F.col("kind") == SINGLE).select("packed", F.struct("id", "th", "lo").alias("place"))
        first = single.groupBy("packed").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
        later = single.join(first.select("packed", "first"), "packed").filter("place > first")
        out = out.unionByName(later.select("place.id", "place.th", "place.lo", F.col("place.lo").alias("hi")))
    spans = materialize(out.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "window-spans")
    forget(found, met)
    return spans


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("clean_text", T.StringType())]


def kept_words(n: int, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """Which of n words no window from the runs [lo, hi] covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + window, -1)
    return np.cumsum(edge[:-1]) == 0


def dedup(df: DataFrame, window: int = WINDOW, gram: int = GRAM, large: int = LARGE_GROUP, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words, n_removed and clean_text: the words that no window covers that begins earlier too, joined by one space.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Windows are judged on the input.
    Documents are ordered by an integer id, null being the least integer, and
    rows that share an id by their text's hash; rows that repeat id and text are one document and
    get equal results. Null and empty texts, and texts shorter than a window,
    lose nothing (their clean_text has its white space collapsed too). Columns
    of keep (default: all) stay unless named like a new one. An empty table
    gives an empty table.
    """
    names = {f.name for f in FIELDS}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    text = whole_text(text_col)
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    # the text's hash travels with every super-k-mer: only where ids repeat is it needed to tell documents apart
    repeats = df.select(key.alias("id")).groupBy("id").count().filter("count > 1").limit(1).count()
    keyed = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], key.alias("id"), (F.xxhash64(text) if repeats else F.lit(0).cast("long")).alias("th"), text.alias("text"))
    spans = later_spans(keyed, window, gram, large)
    joined = keyed.join(spans, ["id", "th"], "left").select(*[f"k{i}" for i in range(len(keep))], "text", "spans")
    schema = T.StructType([T.StructField(c, joined.schema[i].dataType) for i, c in enumerate(keep)] + FIELDS)

    def run(batches):
        only(("windows cut",))
        n = len(keep)
        for batch in (part for whole in batches for part in text_slices(whole, n)):
            made = []
            for t, found in zip(batch.column(n).to_pylist(), batch.column(n + 1), strict=True):
                words = split_words(t)
                kept = words
                if found.is_valid:
                    lo, hi = (found.values.field(k).to_numpy() for k in ("lo", "hi"))
                    kept = [words[i] for i in np.flatnonzero(kept_words(len(words), lo, hi, window)).tolist()]
                made.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8")))
            columns = [pa.array(list(c), type=k) for c, k in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], *columns], names=schema.names)

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS lo FROM docs WHERE len(words) >= 20
), windows AS (
  SELECT doc_id, lo, array_to_string(words[lo:lo + 19], ' ') AS win FROM starts
), later AS (
  SELECT doc_id, lo FROM (SELECT doc_id, lo, row_number() OVER (PARTITION BY win ORDER BY doc_id, lo) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, lo + j AS place FROM later, (SELECT unnest(range(20)) AS j)
), words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
