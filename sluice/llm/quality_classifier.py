"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Every word has a sparse random index vector, made from hashes of its lower-case
form and of its shape. A word's vector adds what it keeps company with: the
index vectors of its neighbours in the training texts. A document is the mean
of its words' vectors; a two-layer numpy network scores it, and a temperature
fitted on rows it was not trained on calibrates its probabilities.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, only, table, text_slices, whole_text

#: Size of word vectors; entries of an index vector that are not 0.
DIMENSIONS, NONZERO = 64, 6
#: Words of the training texts that get a context vector: the most frequent.
VOCABULARY = 20_000
#: Bounds of the labelled sample that the model is fitted on.
MAX_ROWS, MAX_BYTES = 6_000, 48 << 20
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 80, 256, 0.01, 1e-4
#: Words that a task keeps vectors of; beyond, they are made anew.
CACHED_WORDS = 50_000

_SHAPE = bytes(97 if 97 <= c < 123 or c >= 128 else 65 if 65 <= c < 91 else 48 if 48 <= c < 58 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """Letters as a or A, digits as 0, runs as one: b"Ab12!!" -> b"Aa0!"."""
    return _RUN.sub(rb"\1", word.translate(_SHAPE))


def index_vectors(units: list[bytes], seed: int) -> np.ndarray:
    """Sparse ternary vectors of units, the same on every machine."""
    h = np.fromiter((xxhash.xxh64_intdigest(u, seed) for u in units), np.uint64, len(units))
    out = np.zeros((len(units), DIMENSIONS), np.float32)
    rows = np.arange(len(units))
    for k in range(NONZERO):
        x = mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        np.add.at(out, (rows, (x % np.uint64(DIMENSIONS)).astype(np.int64)), np.where(x >> np.uint64(63), 1.0, -1.0).astype(np.float32))
    return out


def base_vectors(words: list[bytes]) -> np.ndarray:
    return index_vectors([shape(w) for w in words], 1) + 0.5 * index_vectors([w.lower() for w in words], 2)


class WordVectors:
    """Vectors by word: base vectors, plus context vectors for the vocabulary."""

    def __init__(self, vocabulary: list[bytes], context: np.ndarray):
        self.vocabulary, self.context = vocabulary, context
        self._reset()

    def _reset(self) -> None:
        self.rows = {w: i for i, w in enumerate(self.vocabulary)}
        self.matrix = base_vectors(self.vocabulary) + self.context if self.vocabulary else np.zeros((0, DIMENSIONS), np.float32)
        self.used = len(self.vocabulary)

    @classmethod
    def fit(cls, texts: list[bytes]) -> WordVectors:
        counts: dict[bytes, int] = {}
        for t in texts:
            for w in t.split():
                counts[w] = counts.get(w, 0) + 1
        vocabulary = sorted(counts, key=lambda w: (-counts[w], w))[:VOCABULARY]
        del counts
        rows = {w: i for i, w in enumerate(vocabulary)}
        if not vocabulary:
            return cls([], np.zeros((0, DIMENSIONS), np.float32))
        base = base_vectors(vocabulary)
        context = np.zeros((len(vocabulary), DIMENSIONS), np.float32)
        for lo in range(0, len(texts), 500):
            some = [np.fromiter((rows.get(w, -1) for w in t.split()), np.int64) for t in texts[lo : lo + 500]]
            pairs = np.concatenate([np.stack([s[:-1], s[1:]]) for s in some if len(s) > 1] or [np.zeros((2, 0), np.int64)], axis=1)
            pairs = pairs[:, (pairs >= 0).all(0)]
            for a, b in ((pairs[0], pairs[1]), (pairs[1], pairs[0])):
                code, n = np.unique(a * len(vocabulary) + b, return_counts=True)
                a_, b_ = code // len(vocabulary), code % len(vocabulary)
                for at in range(0, len(code), 200_000):
                    part = slice(at, at + 200_000)
                    first = np.flatnonzero(np.append(True, np.diff(a_[part]) > 0))
                    context[a_[part][first]] += np.add.reduceat(base[b_[part]] * n[part, None].astype(np.float32), first, axis=0)
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        return cls(vocabulary, (context / np.maximum(norm, 1e-6)).astype(np.float32))

    def _find(self, words: list[bytes]) -> np.ndarray:
        at = list(map(self.rows.get, words))
        if None in at:
            if self.used > len(self.vocabulary) + CACHED_WORDS:
                self._reset()
            new = [w for w in dict.fromkeys(words) if w not in self.rows]
            if self.used + len(new) > len(self.matrix):
                more = max(self.used + len(new), 2 * len(self.matrix), 1024) - len(self.matrix)
                self.matrix = np.concatenate([self.matrix, np.zeros((more, DIMENSIONS), np.float32)])
            self.matrix[self.used : self.used + len(new)] = base_vectors(new)
            self.rows.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
            at = list(map(self.rows.get, words))
        return np.array(at, np.int64)

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean of its words' vectors, its norm, and the logarithm of their number; zeros without words."""
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        sums = np.zeros((len(texts), DIMENSIONS), np.float64)
        lo = 0
        while lo < len(texts):  # some texts, or a part of a long one, at a time
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(n[lo:]), 65_536, side="right")) + lo)
            if hi > lo + 1 or n[lo] <= 65_536:
                rows = self._find([w for s in split[lo:hi] for w in s])
                full = np.flatnonzero(n[lo:hi])
                if len(full):
                    starts = (np.cumsum(n[lo:hi]) - n[lo:hi])[full]
                    sums[lo + full] = np.add.reduceat(self.matrix[rows], starts, axis=0)
            else:
                for at in range(0, int(n[lo]), 65_536):
                    rows = self._find(split[lo][at : at + 65_536])
                    sums[lo] += self.matrix[rows].sum(0)
            lo = hi
        mean = sums / np.maximum(n, 1)[:, None]
        return np.column_stack([mean, np.linalg.norm(mean, axis=1), np.log1p(n) / 8])


class Network:
    """Two layers (tanh, logistic) with standardized input and a temperature."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.layers = prior, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        mean, scale, w1, b1, w2, b2, temperature = self.layers
        return (np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2)[:, 0] / temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Network:
        """check marks the rows that set the temperature only."""
        net = cls((y.sum() + 1) / (len(y) + 2))
        train, labels = x[~check].astype(np.float64), y[~check].astype(np.float64)
        if len(np.unique(labels)) < 2:
            return net
        rng = np.random.default_rng(0)
        mean, scale = train.mean(0), train.std(0) + 1e-6
        train = (train - mean) / scale
        p = [rng.normal(0, train.shape[1] ** -0.5, (train.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            order = rng.permutation(len(train))
            for lo in range(0, len(order), BATCH):
                rows = order[lo : lo + BATCH]
                h = np.tanh(train[rows] @ p[0] + p[1])
                out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
                d = (out - labels[rows, None]) / len(rows)
                dh = d @ p[2].T * (1 - h * h)
                grads = [train[rows].T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], d.sum(0)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        net.layers = (mean, scale, *p, 1.0)
        held, truth = net.logits(x[check].astype(np.float64)), y[check]
        if len(truth):
            options = np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, np.where(truth == 1, -held, held) / k).mean() for k in options]
            net.layers = (*net.layers[:-1], float(options[int(np.argmin(loss))]))
        return net


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; such rows' labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_PICKED = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("label", pa.int32())])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[WordVectors, Network]:
    """Fit on at most max_rows labelled documents of at most max_bytes in all, whole texts.

    The sample is the rows of the least xxhash64(doc_id), the same at any
    partitioning; one that does not fit in max_bytes any more is left out, or is
    the sample if none fits. Null labels, null ids and held-out rows are left out; if
    labels repeat an id, its greatest label counts. Rows that repeat id and
    text count once, null texts as empty. Without labels of both kinds every
    score is their share (0.5 without any), as with empty tables.

    Ids are chosen first, from columns without texts; then the sizes of the
    chosen rows' texts are looked at, then a task is given the texts that fit.
    Neither they nor what fitting takes come to the driver: only the model does.
    Lists go to Spark as Arrow tables: of a list of rows Python workers of
    another kind would be started, and would stay, beside those in use.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select("doc_id", whole_text("text").alias("text"))
    ids = docs.select("doc_id").join(known, "doc_id").select("doc_id", "label", F.xxhash64("doc_id").alias("h")).distinct()
    ids = docs.sparkSession.createDataFrame(ids.orderBy("h", "doc_id").limit(max_rows).toArrow())
    sized = texts.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("t")).join(F.broadcast(ids), "doc_id")
    rows = sized.orderBy("h", "doc_id", "size", "t").limit(max_rows).collect()
    total, chosen = 0, []
    for r in rows:
        if total + r["size"] > max_bytes:
            continue
        total += r["size"]
        chosen.append((r["doc_id"], r["t"], r["label"]))
    if rows and not chosen:
        chosen = [(rows[0]["doc_id"], rows[0]["t"], rows[0]["label"])]
    if not chosen:
        return WordVectors.fit([]), Network()
    picked = docs.sparkSession.createDataFrame(pa.table(dict(zip(("doc_id", "t", "label"), zip(*dict.fromkeys(chosen), strict=True), strict=True)), _PICKED))
    found = texts.withColumn("t", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "text", "label")
    vocabulary, context, network = pickle.loads(found.coalesce(1).mapInArrow(_fitted, "model binary").first()["model"])
    return WordVectors(vocabulary, context), network


def _fitted(batches):
    """The model, pickled, from all rows (doc_id, t, text, label)."""
    only(("fit",))
    found = [(i, t, text.encode("utf-8", "replace"), label) for batch in batches for i, t, text, label in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
    found.sort(key=lambda r: r[:2])
    raw = [r[2] for r in found]
    ids, known = np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([r[3] for r in found])
    del found
    vectors = WordVectors.fit(raw)
    x = np.concatenate([vectors.pool(raw[lo : lo + 64]) for lo in range(0, len(raw), 64)])  # few texts are held as words at a time
    network = Network.fit(x, known, mix64(ids + np.uint64(77)) % np.uint64(5) == 0)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((vectors.vocabulary, vectors.context, network))], pa.binary())], names=["model"])


def probability(spark: SparkSession, model: tuple[WordVectors, Network], text: Column) -> Column:
    """The score (0..1) of a whole text, which must not be null.

    Only this column travels to Python, and only numbers come back. The model
    that travels to the executors has at most VOCABULARY words.
    """
    fitted, network = model
    sent, name = spark.sparkContext.broadcast((fitted.vocabulary, fitted.context, network)), uuid.uuid4().hex

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, context, network = sent.value
        vectors = only(("word vectors", name), lambda: WordVectors(vocabulary, context))
        for batch in batches:
            made = [np.zeros(0)]
            for part in text_slices(pa.RecordBatch.from_arrays([batch], names=["text"]), 0):
                made.append(np.round(network.scores(vectors.pool([t.encode("utf-8", "replace") for t in part.column(0).to_pylist()])), 9))
            yield pa.array(np.concatenate(made))

    return scores(text)


def score(docs: DataFrame, model: tuple[WordVectors, Network], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score (0..1) and predicted (1 if score >= 0.5) to every row, from its whole text alone.

    Null and empty texts are scored as documents without words. Columns of keep
    (default: all) stay unless named like a new one. No shuffle. Repeated rows
    get equal scores, an empty table stays empty.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    scored = docs.select(*kept, probability(docs.sparkSession, model, whole_text(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
