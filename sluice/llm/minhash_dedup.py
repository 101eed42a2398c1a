"""Near-duplicate documents by consistent weighted sampling.

A document is a weighted set of five-word shingles: term frequency times an
inverse document frequency that is capped, so that shingles in fewer than RARE
of the documents, nearly all there are, weigh the same: without the cap, what
many copies share would weigh less than their edits, and large families would
fall apart. Improved
consistent weighted sampling draws from each document shingles that two
documents share with the probability of their weighted Jaccard similarity;
the draws are cut into bands. Documents that share a band are compared with the
one that shares most bands with others, by their exact weighted similarity, and
the links that hold are closed into classes. In a band that holds several
classes then, each node outside of the leader's class is compared with all
nodes of other classes. Where many are outside, this is done in rounds: about LEAD of them lead, then GROWTH times as many, and so on, and those
that have joined the leader's class meanwhile need not. In the end no pair of a band
is unchecked. Work is linear in the size of bands whose nodes join classes, and
quadratic only in the nodes of a band that stay outside: these pairs are compared
within tasks and never become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, mix64, only, ragged_positions, table, text_slices, whole_text

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8^5)^20 = 0.9996.
BANDS, ROWS = 20, 5
#: Shingles in fewer than this share of the documents all have the greatest weight, 1 + ln 20.
RARE = 0.05
#: Documents are first counted in so many hash buckets of shingles: a shingle can only be frequent if its bucket is.
DF_BITS = 18
#: Members that are compared with one copy of their band's leader.
GROUP = 250
#: Draws that a pair must share (of BANDS * ROWS) before texts are compared
#: in the second pass; at similarity 0.8 fewer have a probability below 1e-9.
SHARED_DRAWS = 55
#: Up to so many nodes outside of their band's leader's class become pairs with the rest of the band, if these are
#: no more than PAIRS: a pair that many bands hold is then compared once. Others are compared in rounds, LEAD in the first.
OUTSIDE, PAIRS, LEAD = 16, 1024, 50
#: Places that lead after a round, as a multiple of those before: few rounds, each being many small jobs.
GROWTH = 25
#: Shingles of a round's leaders that a task holds at a time, and nodes that pass by them in a task: an outsider's text is
#: sent once for so many of these. A leader with more than LONG shingles is held alone.
HELD, PASS, LONG = 1 << 20, 1024, 20_000
#: Up to so many links are closed into classes by one task (8 MB of names); more by joins.
LINKS = 1 << 18
#: Elements of held sets that are looked up at a time.
ELEMENTS = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = (np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))
            cls.up[0] = cls.down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(cls.up), np.multiply.accumulate(cls.down)
        return cls.up, cls.down


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word (bytes between ASCII white space)."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    lo, hi = edge[::2], edge[1::2]
    up, down = _Powers.upto(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return lo, mix64((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def word_hashes(texts: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and how many each text has."""
    hashes, counts = [], np.zeros(len(texts), np.int64)

    def many(lo: int, hi: int) -> None:
        starts = np.cumsum([0, *[len(t) + 1 for t in texts[lo:hi]]])
        first, h = _words(b"\n".join(texts[lo:hi]))
        hashes.append(h)
        counts[lo:hi] = np.diff(np.searchsorted(first, starts))

    lo = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > chunk:
            if i > lo:
                many(lo, i)
            lo, size = i, 0
        if len(t) > chunk:  # cut before white space, whatever the length of a word
            at = 0
            while at < len(t):
                end = min(at + chunk, len(t))
                if end < len(t):
                    back = max(t.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r"))
                    ahead = [x for x in (t.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                    end = back if back > at else min(ahead, default=len(t))
                h = _words(t[at:end])[1]
                hashes.append(h)
                counts[i] += len(h)
                at = end
            lo = i + 1
        else:
            size += len(t) + 1
    if lo < len(texts):
        many(lo, len(texts))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def shingles(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in a row, and how many each text has.

    A text with fewer words than a shingle is one shingle; one without words has none.
    """
    c = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    start = np.cumsum(counts) - counts
    first = ragged_positions(start, c)
    width = np.repeat(np.minimum(counts, size), c)
    padded = np.append(words, np.zeros(size, np.uint64))
    h = width.astype(np.uint64)
    for j in range(size):
        h = h * np.uint64(_BASE) + np.where(j < width, padded[first + j], np.uint64(j))
    return mix64(h), c


def weighted_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles sorted within each text, their counts, number per text, and two hashes of each word sequence)."""
    words, counts = word_hashes(texts)
    h, c = shingles(words, counts)
    owner = np.repeat(np.arange(len(texts)), c)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    place = ragged_positions(np.zeros(len(texts), np.int64), counts).astype(np.uint64) + np.uint64(1)
    names = []
    for salt in (1, 2):
        each = mix64(words + place * np.uint64(_BASE * (2 * salt + 1) % 2**64))
        ends = np.append(np.uint64(0), np.cumsum(each, dtype=np.uint64))
        cut = np.append(0, np.cumsum(counts))
        names.append(mix64(ends[cut[1:]] - ends[cut[:-1]] + counts.astype(np.uint64)))
    return h[at], tf, np.bincount(owner[at], minlength=len(texts)) if len(at) else np.zeros(len(texts), np.int64), *names


class Draws:
    """Improved consistent weighted sampling with variates from a table.

    Draw i looks a shingle's variates (r and c from Gamma(2, 1), b from U(0, 1))
    up by a hash of shingle and i. ln a is tabulated for the weight that all
    rare shingles have, and computed for others.
    """

    BITS = 16

    def __init__(self, n: int, usual: float):
        rng = np.random.default_rng(20)
        size = 1 << self.BITS
        self.r, self.ln_c, self.b = rng.gamma(2, 1, size), np.log(rng.gamma(2, 1, size)), rng.random(size)
        self.n, self.usual = n, usual
        self.factors = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
        self.salts = mix64(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))
        a, self.step = self._ln_a(np.full(size, usual), np.arange(size))
        self.usual_keys = self._sortable(a)

    def _ln_a(self, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.r[at]
        t = np.floor(np.log(w) / r + self.b[at])
        return self.ln_c[at] - r * (t - self.b[at]) - r, t

    @staticmethod
    def _sortable(a: np.ndarray) -> np.ndarray:
        """Order-preserving unsigned bits of 32-bit floats, in the upper half of 64 bits."""
        bits = a.astype(np.float32).view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        return bits.astype(np.uint64) << np.uint64(32)

    def draw(self, h: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """n 64-bit draws for each set (row); sets without elements get a row of zeros."""
        out = np.zeros((len(counts), self.n), np.uint64)
        full = np.flatnonzero(counts)
        if not len(full):
            return out
        start = (np.cumsum(counts) - counts)[full]
        odd = np.flatnonzero(np.abs(w - self.usual) > 1e-9)
        place = np.arange(len(h), dtype=np.uint64)
        for i in range(self.n):
            at = ((h ^ self.salts[i]) * self.factors[i]) >> np.uint64(64 - self.BITS)
            keys = self.usual_keys[at] | place
            if len(odd):
                keys[odd] = self._sortable(self._ln_a(w[odd], at[odd])[0]) | place[odd]
            best = (np.minimum.reduceat(keys, start) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            t = np.where(np.abs(w[best] - self.usual) > 1e-9, self._ln_a(w[best], at[best])[1], self.step[at[best]])
            out[full, i] = mix64(h[best] + t.astype(np.int64).view(np.uint64) * np.uint64(_BASE))
        return out


class Weights:
    """Inverse document frequency by shingle: 1 + ln(n / df), at most 1 + ln(1 / RARE).

    Holds only the shingles in RARE of the documents or more, of which there
    are at most 1 / RARE times as many as a document has on average.
    """

    USUAL = 1 + np.log(1 / RARE)

    def __init__(self, shingles_: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(shingles_)
        self.shingles = np.asarray(shingles_, np.uint64)[order]
        self.weights = 1 + np.log(np.maximum(n, 1) / np.maximum(np.asarray(df, np.float64)[order], 1)).clip(0, np.log(1 / RARE))

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.USUAL)
        if len(self.shingles) and len(h):
            at = np.minimum(np.searchsorted(self.shingles, h), len(self.shingles) - 1)
            hit = self.shingles[at] == h
            out[hit] = self.weights[at[hit]]
        return out


_COUNT = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def _counts(keys: np.ndarray, n: np.ndarray):
    for lo in range(0, len(keys), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000].astype(np.int64)) for x in (keys, n)], names=_COUNT.names)


def document_frequencies(texts: DataFrame) -> Weights:
    """Exact numbers of documents (rows) of all shingles that RARE of them have.

    Two passes over all texts: documents by hash bucket, then by shingle in the
    buckets that are frequent. Tasks count before they send; what comes to the
    driver is at most the 2^DF_BITS bucket numbers and the shingles of Weights.
    """
    n = texts.count()
    shift = np.uint64(64 - DF_BITS)

    def sets(batches):
        only(("shingles",))
        for batch in (p for whole in batches for p in text_slices(whole, 0)):
            h, _, c, _, _ = weighted_sets([t.encode("utf-8", "replace") for t in batch.column(0).to_pylist()])
            yield h, np.repeat(np.arange(len(c)), c)

    def by_bucket(batches):
        total = np.zeros(1 << DF_BITS, np.int64)
        for h, owner in sets(batches):
            bucket = (h >> shift).astype(np.int64)
            new = np.append(True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)  # sorted by hash
            total += np.bincount(bucket[new], minlength=1 << DF_BITS)
        used = np.flatnonzero(total)
        yield from _counts(used, total[used])

    def frequent(counted: DataFrame) -> list:
        return counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= RARE * n).collect()

    hot = np.zeros(1 << DF_BITS, bool)
    hot[[r["key"] for r in frequent(texts.mapInArrow(by_bucket, _COUNT))]] = True
    if not hot.any():
        return Weights(np.zeros(0, np.uint64), np.zeros(0), n)
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def by_shingle(batches):
        wanted = np.unpackbits(sent.value).astype(bool)
        for h, _ in sets(batches):
            yield from _counts(*[x.view(np.int64) for x in np.unique(h[wanted[(h >> shift).astype(np.int64)]], return_counts=True)])

    found = frequent(texts.mapInArrow(by_shingle, _COUNT))
    return Weights(np.array([r["key"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found]), n)


DRAWN = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("draws", T.BinaryType())]
)


def draw_all(docs: DataFrame, idf) -> DataFrame:
    """docs (id, th, text) to DRAWN. node names the sequence of words (128 bits)."""

    def run(batches):
        weights = idf.value
        sampler = only(("draws",), lambda: Draws(BANDS * ROWS, Weights.USUAL))
        for batch in (p for whole in batches for p in text_slices(whole, 2)):
            h, tf, c, a, b = weighted_sets([t.encode("utf-8", "replace") for t in batch.column(2).to_pylist()])
            draws = sampler.draw(h, tf * weights.of(h), c)
            short = draws >> np.uint64(32)
            keys = np.zeros((len(c), BANDS), np.uint64)
            for j in range(ROWS):
                keys = mix64(keys + short[:, j::ROWS]) * np.uint64(_BASE)
            keys = mix64(keys + np.arange(BANDS, dtype=np.uint64))
            some = np.where(c > 0, BANDS, 0)
            offsets = np.append(0, np.cumsum(some)).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[c > 0].ravel().view(np.int64)))
            nodes = np.column_stack([a, b]).astype(">u8").tobytes()
            short = short.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([nodes[16 * i : 16 * i + 16] for i in range(len(c))], pa.binary()), pa.array(c.astype(np.int64)), bands, pa.array([r.tobytes() for r in short], pa.binary())],
                names=DRAWN.names,
            )

    return docs.mapInArrow(run, DRAWN)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets (elements, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    least = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


class Held:
    """Sets (elements, weights) and draws of several texts, with which others are compared."""

    def __init__(self, elements: list[np.ndarray], weights: list[np.ndarray], draws: list[bytes]):
        self.elements, self.weights = np.concatenate(elements), np.concatenate(weights)
        self.counts = np.array([len(x) for x in elements])
        self.starts = np.cumsum(self.counts) - self.counts
        self.totals = np.array([x.sum() for x in weights])
        self.draws = np.frombuffer(b"".join(draws), "<u4").reshape(len(draws), -1)

    def alike(self, elements: np.ndarray, weights: np.ndarray, draws: bytes, band: int | None = None) -> list[int]:
        """Places of the held sets that share SHARED_DRAWS draws with this sorted set and have the similarity.

        band: number of a band that all share; of the pairs that share earlier bands too none is told.
        """
        total = weights.sum()
        same = self.draws == np.frombuffer(draws, "<u4")
        enough = np.count_nonzero(same, axis=1) >= SHARED_DRAWS
        if band:
            enough &= ~same[:, : band * ROWS].reshape(len(same), band, ROWS).all(axis=2).any(axis=1)
        # the similarity is at most the ratio of the totals
        enough &= np.minimum(self.totals, total) >= (THRESHOLD - 1e-9) * np.maximum(self.totals, total)
        at = np.flatnonzero(enough & (self.counts > 0))
        if not len(at) or not len(elements):
            return []
        part = np.cumsum(self.counts[at]) // ELEMENTS
        return [k for each in np.split(at, np.flatnonzero(np.diff(part)) + 1) for k in self._near(each, elements, weights, total)]

    def _near(self, at: np.ndarray, elements: np.ndarray, weights: np.ndarray, total: float) -> list[int]:
        theirs = ragged_positions(self.starts[at], self.counts[at])
        place = np.minimum(np.searchsorted(elements, self.elements[theirs]), len(elements) - 1)
        common = np.where(elements[place] == self.elements[theirs], np.minimum(weights[place], self.weights[theirs]), 0.0)
        least = np.add.reduceat(common, np.cumsum(self.counts[at]) - self.counts[at])
        return at[least / (self.totals[at] + total - least) >= THRESHOLD - 1e-12].tolist()


LINK = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
ROOT = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("root", T.BinaryType())])


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity, as a table of materialize().

    Pairs meet by a, in groups of about GROUP members, each with a copy of a's
    text. Sizes are a table too: adaptive execution can then split the join
    with them by a, which may be in very many pairs.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts")), "sizes")
    members = pairs.join(sizes, "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"))
    heads = sizes.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    wanted = members.unionByName(heads).join(nodes.select("node", "id", "th"), "node")
    texts = wanted.join(docs, ["id", "th"]).select("a", "salt", "member", "node", "text")

    def run(batches):
        only(("shingles",))
        weights = idf.value
        head, name = None, None
        for batch in (p for whole in batches for p in text_slices(whole, 4)):
            h, tf, c, _, _ = weighted_sets([t.encode("utf-8", "replace") for t in batch.column(4).to_pylist()])
            w = tf * weights.of(h)
            ends = np.cumsum(c)
            out = []
            for i, (a, salt, member, node) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True)):
                own = (h[ends[i] - c[i] : ends[i]], w[ends[i] - c[i] : ends[i]])
                if not member:
                    head, name = own, (a, salt)
                elif name != (a, salt):
                    raise ValueError("a group without its first document")
                elif similarity(head, own) >= THRESHOLD - 1e-12:
                    out.append((a, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in zip(*out, strict=True)], names=LINK.names)

    links = materialize(texts.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "member", "node").mapInArrow(run, LINK), "links")
    forget(sizes)
    return links


def closed(batches):
    """ROOT of all nodes of links (a, b), a <> b, of which there are few: joined by their least neighbours, then by those of these."""
    links = list(batches)
    n = sum(x.num_rows for x in links)
    if not n:
        return
    names = pa.chunked_array([x.column(i) for i in (0, 1) for x in links]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(names.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    u, v = np.split(place[names.indices.to_numpy()], [n])
    root = np.arange(len(order))
    while (root[u] != root[v]).any():
        least = np.minimum(root[u], root[v])
        for end in (root[u], root[v]):
            np.minimum.at(root, end, least)
        while (root != root[root]).any():
            root = root[root]
    for lo in range(0, len(order), 50_000):
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(order[x])) for x in (np.arange(lo, min(lo + 50_000, len(order))), root[lo : lo + 50_000])], names=ROOT.names)


def components(links: DataFrame) -> DataFrame:
    """node, root (least node of its component) for all nodes of links (a, b).

    Up to LINKS of them are closed by one task, for there each join is many
    times the work. More are by joins, in alternating large and small stars.
    """
    links = links.filter("a <> b").select("a", "b")
    if links.limit(LINKS + 1).count() <= LINKS:
        return links.coalesce(1).mapInArrow(closed, ROOT)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen, before = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct(), "components")
        if before is not None:
            forget(before)
        before = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, th (xxhash64 of the text), class_id, class_size, keep.

    class_id is the least id of the class (null if all are null), class_size
    its number of rows; keep marks all rows of the least (id, th), nulls last.
    Rows with equal sequences of words are copies; texts without words are
    copies of each other and near nothing else. Classes are closed under
    links: they hold chains whose ends may be less alike. Other columns are
    ignored. An empty table gives an empty table.
    """
    spark = df.sparkSession
    text = whole_text(text_col)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    idf = spark.sparkContext.broadcast(document_frequencies(docs.select("text")))
    drawn = materialize(draw_all(docs, idf), "draws")
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "th"))
    same = ["n_shingles", "bands", "draws"]
    nodes = drawn.groupBy("node").agg(first.alias("x"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in same])
    nodes = materialize(nodes.select("node", "x.null", "x.id", "x.th", "n", *same), "nodes")
    joinable = nodes.select("node", F.coalesce("id", F.lit(0)).alias("id"), "th")
    keyed = docs.select(F.coalesce("id", F.lit(0)).alias("id"), "th", "text")
    if drawn.groupBy("id", "th").count().filter("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["id", "th"])
    shared = materialize(shared_bands(nodes.select("node", "n_shingles", F.posexplode("bands").alias("k", "band"))), "bands")
    least = materialize(leaders(shared), "leaders")
    led = materialize(shared.join(least, "band").select("band", "k", "a", "node", "n_shingles"), "led-bands")
    forget(shared, least)
    star = materialize(led.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = verified(star, joinable, keyed, idf)
    roots = materialize(components(links), "roots")
    done = [drawn, nodes, led, star, links, roots]
    split = split_bands(led, roots)
    few = (F.col("of") <= OUTSIDE) & (F.col("of") * F.col("total") <= PAIRS)
    more = materialize(second_pairs(split.filter(few), star, nodes), "second-pairs")
    done += [split, more]
    if more.limit(1).count():
        again = verified(more, joinable, keyed, idf)
        done.append(again)
        if again.limit(1).count():
            roots = materialize(components(links.unionByName(again)), "roots")
            done.append(roots)
    crowded = split.filter(~few)
    if crowded.limit(1).count():
        roots = in_rounds(crowded, roots, nodes, keyed, idf)
        done.append(roots)
    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "null", "id", "th", "n")
    whole = placed.groupBy("root").agg(F.min(F.struct("null", "id", "th")).alias("first"), F.sum("n").alias("class_size"))
    by_node = placed.select("node", "root").join(whole, "root").select("node", "first", "class_size")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    found = drawn.select("id", "th", "node").join(by_node, "node").select("id", "th", F.col("first.id").alias("class_id"), F.col("class_size").cast("long").alias("class_size"), is_first.alias("keep"))
    out = materialize(found, "classes")
    forget(*done)
    return out


def shared_bands(bands: DataFrame) -> DataFrame:
    """The rows of bands (node, n_shingles, k, band), k being the band's number, whose band has two nodes or more, with their number."""
    return bands.join(bands.groupBy("band").agg(F.count("*").alias("number")).filter("number > 1"), "band")


def leaders(shared: DataFrame) -> DataFrame:
    """band, a: for each shared band the node whose bands hold most nodes.

    In a family of edited copies that is the one they were made from, if it is
    there: it is likest to all.
    """
    popular = shared.groupBy("node").agg(F.sum("number").alias("p"))
    best = F.max(F.struct("p", "node"))
    return shared.join(popular, "node").groupBy("band").agg(best.alias("x")).select("band", F.col("x.node").alias("a"))


def split_bands(led: DataFrame, roots: DataFrame) -> DataFrame:
    """band, k, a, node, n_shingles, root, n, of, total, longest: the nodes of the bands that hold several classes,
    total in all, `of` of them outside of the class of the leader a. longest: most shingles of one, of those up to LONG.

    n is the place of a node outside by a hash of band and node, 1 to of, and
    null for others: another order in each band, found without bringing a
    band's nodes together. A place may hold several nodes or none.
    """
    placed = materialize(led.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    up_to_long = F.max(F.when(F.col("n_shingles") <= LONG, F.col("n_shingles"))).alias("longest")
    classes_ = placed.groupBy("band", "root").agg(F.count("*").alias("c"), F.max(F.col("node") == F.col("a")).alias("led"), up_to_long)
    split = classes_.groupBy("band").agg(F.count("*").alias("roots"), F.sum("c").alias("total"), F.max("longest").alias("longest"), F.max(F.struct("led", "root", "c")).alias("x")).filter("roots > 1")
    split = materialize(split.select("band", F.col("x.root").alias("first"), (F.col("total") - F.col("x.c")).alias("of"), "total", "longest"), "split-bands")
    share = F.pmod(F.xxhash64("band", "node"), F.lit(1 << 30)) / (1 << 30)
    place = F.when(F.col("root") != F.col("first"), (F.floor(share * F.col("of")) + 1).cast("long"))
    out = materialize(placed.join(split, "band").select("band", "k", "a", "node", "n_shingles", "root", place.alias("n"), "of", "total", "longest"), "split")
    forget(placed, split)
    return out


def in_rounds(crowded: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, idf) -> DataFrame:
    """roots, after all pairs of the bands of crowded (rows of split_bands()) are checked.

    A class only grows, so a node that is outside of a's class in the end was so
    when its turn came, and was compared with all nodes of other classes. A
    pair that shares several bands is compared in the first of them: all pairs
    of every band get their turn, those of bands with few outsiders before.
    """
    first = roots
    facts = nodes.select("node", F.coalesce("id", F.lit(0)).alias("id"), "th", "draws").join(crowded.select("node").distinct(), "node")
    texts = materialize(facts.join(docs, ["id", "th"]).select("node", "draws", "text"), "crowded-texts")
    # a long text has a block of its own
    block = F.when(F.col("n_shingles") > LONG, -F.col("n")).otherwise(F.floor(F.col("n") * F.col("longest") / HELD))
    rows = crowded.select("band", "k", "a", "node", "n", block.alias("block"), F.ceil(F.col("total") / PASS).cast("int").alias("salts"))
    led, upto = 0, LEAD
    while True:
        of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        now = rows.join(roots, "node", "left").join(of_a, "a", "left").withColumns({"root": F.coalesce("root", "node"), "ra": F.coalesce("ra", "a")})
        now = materialize(now.withColumn("outside", F.col("root") != F.col("ra")), "round")
        if not now.filter(F.col("outside") & (F.col("n") > led)).limit(1).count():
            forget(now, texts)
            return roots if roots is not first else materialize(first, "roots")
        links = led_links(now, led, upto, texts, idf)
        if links.limit(1).count():
            before, found = roots, components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
            roots = materialize(found, "roots")
            forget(*[t for t in (before,) if t is not first])
        forget(now, links)
        led, upto = upto, GROWTH * upto


def led_links(now: DataFrame, led: int, upto: int, texts: DataFrame, idf) -> DataFrame:
    """LINK of the nodes outside at places led + 1 to upto with the nodes of their band in other classes, as a table of materialize().

    A task holds the leaders of a block, draws and texts, and the band's nodes
    pass by in groups of about PASS: pairs that share SHARED_DRAWS draws, and
    no earlier band, are verified where they meet, so that what comes out are
    links and not candidates, and no more than one for a node and a class. A
    block has as many leaders as have HELD shingles if all are as long as the
    band's longest. now: band, k, a, node, n, block, salts, root, outside; texts: node, draws, text.
    """
    n = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leads = F.coalesce(F.col("outside") & (F.col("n") > led) & (F.col("n") <= upto), F.lit(False))
    first = now.filter(leads)
    heads = first.select("band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "block", F.lit(False).alias("member"), F.lit(False).alias("leads"), "node", "root", F.lit(0).alias("k"))
    blocks = materialize(first.select("band", "block").distinct(), "blocks")
    # those that led before have met all others
    here = now.filter((F.col("node") != F.col("a")) & ~F.coalesce(F.col("outside") & (F.col("n") <= led), F.lit(False))).drop("block").join(blocks, "band")
    members = here.select("band", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "block", F.lit(True).alias("member"), leads.alias("leads"), "node", "root", "k")
    cell = ["band", "salt", "block"]
    both = heads.unionByName(members).join(texts, "node").select(*cell, "member", "leads", "node", "root", "draws", "k", "text")

    def run(batches):
        only(("shingles",))
        weights = idf.value
        name, heads, held = None, [], None
        for batch in (p for whole in batches for p in text_slices(whole, 9)):
            h, tf, c, _, _ = weighted_sets([t.encode("utf-8", "replace") for t in batch.column(9).to_pylist()])
            w = tf * weights.of(h)
            ends = np.cumsum(c)
            out = []
            for i, (*at, member, leads, node, root, own, band) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(9)], strict=True)):
                set_ = (h[ends[i] - c[i] : ends[i]], w[ends[i] - c[i] : ends[i]])
                if at != name:
                    name, heads, held = at, [], None
                if not member:
                    heads.append((node, root, set_[0].copy(), set_[1].copy(), own))
                    continue
                if held is None:
                    held = Held(*[[x[k] for x in heads] for k in (2, 3, 4)])
                    heads = [x[:2] for x in heads]
                linked = {root}
                for k in held.alike(*set_, own, band):
                    leader, class_ = heads[k]
                    # two leaders meet once
                    if class_ not in linked and (not leads or leader < node):
                        linked.add(class_)
                        out.append((leader, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in zip(*out, strict=True)], names=LINK.names)

    links = materialize(both.repartition(n, *cell).sortWithinPartitions(*cell, "member", "node").mapInArrow(run, LINK), "links")
    forget(blocks)
    return links


def second_pairs(split: DataFrame, compared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of a node outside with the nodes of its band in other classes (rows of split_bands()), that were not compared and share SHARED_DRAWS draws."""
    x = split.filter("n is not null").select("band", F.col("node").alias("x"), F.col("root").alias("rx"))
    pairs = split.select("band", "node", "root").join(x, "band").filter((F.col("root") != F.col("rx")) & (F.col("node") != F.col("x")))
    pairs = pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    seen = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.join(seen, ["a", "b"], "left_anti")
    draws = nodes.select("node", "draws")
    both = pairs.join(draws.select(F.col("node").alias("a"), F.col("draws").alias("da")), "a").join(draws.select(F.col("node").alias("b"), F.col("draws").alias("db")), "b")

    def alike(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.filter(pa.array((x == y).sum(1) >= SHARED_DRAWS)).select(["a", "b"])

    return both.select("a", "b", "da", "db").mapInArrow(alike, LINK)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay: one of each class. All columns of df, no others.

    Of rows that repeat both id and text one stays, whichever.
    """
    found = classes(df, id_col, text_col).filter("keep")
    kept = found.groupBy("id", "th").agg(F.count("*").alias("n"))
    kept = kept.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("null"), "th", "n")
    own = F.col(f"`{id_col}`").cast("long")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("null"), F.xxhash64(whole_text(text_col)).alias("th"))
    joined = rows.join(kept, ["id", "null", "th"])
    if kept.filter("n > 1").limit(1).count():
        joined = joined.filter("n = 1").unionByName(joined.filter("n > 1").dropDuplicates(["id", "null", "th"]))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", "class_size", "keep")
