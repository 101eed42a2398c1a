"""Token files, quality classifier and suffix-array dedup against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import quality_classifier, suffix_dedup, token_files
from sluice.llm.common import shared_dir

from .test_text_ops import DOCS, ODD


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 20_000):
        keys = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        n = len(keys)
        table = token_files.PerfectHash.build(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(n))
    colliding = token_files.PerfectHash(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.sort(keys[:50]))
    assert sorted(colliding.slots(keys[:50]).tolist()) == list(range(50)) and (colliding.slots(keys[50:90]) == -1).all()


def test_token_files(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    rows = [*ODD, (3, "another text with this id", "", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    manifest = token_files.write_tokens(docs, path, 2, shared_dir(spark, "test"), shards=4)
    ids = [(i, theirs.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _, _ in rows]
    got = token_files.read_tokens(manifest).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    rng, (cache, _) = random.Random(6), token_files.byte_level_encoder(path)
    alphabet = "aabc  \n\t\x1c\x85\u2003'sdé你1.,!"
    for _ in range(200):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(20)]
        flat, counts = cache.lookup_texts(texts, token_files.PIECES.findall)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    store = token_files.TokenStore(manifest.collect())
    assert store.get(11).tolist() == dict(ids)[11] and store.get(None).tolist() == dict(ids)[None] and store.get(999) is None and store.get(4) is None
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), path, 2, shared_dir(spark, "test"))).count() == 0


def test_copies_of_an_id_that_spans_shards(spark):
    import public_tokenizers as P

    texts = [f"text {i} " + "word " * (i % 7) for i in range(300)]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(i, "other") for i in (1, 2, 8, 9)] + [(None, f"none {i}") for i in range(100)] + [(5, "the same text")] * 200, "doc_id long, text string")
    manifest = token_files.write_tokens(docs, P.path("byte_bpe_50k.json"), 2, shared_dir(spark, "test"), shards=6)
    store = token_files.TokenStore(manifest.collect())
    read = {(r.doc_id, r.copy): r.ids_crc32 for r in token_files.read_tokens(manifest).collect()}
    assert sorted(c for i, c in read if i == 7) == list(range(300)) and sorted(c for i, c in read if i is None) == list(range(100))
    assert {k: zlib.crc32(store.get(*k).astype("<u4").tobytes()) for k in read} == read
    assert len({store.get(7, c).tobytes() for c in range(300)}) == 300
    assert len({r.base for r in manifest.collect() if r.first_id == 5 or r.last_id == 5}) > 1 and sorted(c for i, c in read if i == 5) == list(range(200))
    assert store.get(7, 300) is None and store.get(None, 100) is None and store.get(8, 1) is None


def test_shards_follow_bytes_and_are_read_in_parts(spark, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(token_files, "SHARD_BYTES", 5000)
    docs = spark.createDataFrame([(i, "some words " * (i % 50)) for i in range(200)], "doc_id long, text string")
    want = -(-sum(len("some words ") * (i % 50) for i in range(200)) // 5000)
    assert token_files.shard_count(docs) == want and token_files.shard_count(docs.limit(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = token_files.write_tokens(docs, P.path("byte_bpe_50k.json"), 2, shared_dir(spark, "test"))
    assert want / 2 < manifest.count() <= want
    row = max(manifest.collect(), key=lambda r: r.n_ids)
    shard = token_files.Shard(*token_files.pafs.FileSystem.from_uri(row.base))
    first, count = shard.locate(token_files.key_hash(shard.ids, shard.null, shard.copy))
    whole = [x.tolist() for x in shard.documents(first, count)]
    assert whole == [x.tolist() for x in shard.documents(first, count, limit=8)] and sum(map(len, whole)) == row.n_ids


def plain_index_vector(unit, seed):
    """The sparse vector of a unit, one entry at a time."""
    import xxhash

    out = np.zeros(quality_classifier.DIMENSIONS)
    for k in range(quality_classifier.NONZERO):
        x = (xxhash.xxh64_intdigest(unit, seed) + k * 0x9E3779B97F4A7C15) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> shift) * factor % 2**64
        out[x % quality_classifier.DIMENSIONS] += 1 if x >> 63 else -1
    return out


def test_vectors_pooling_and_calibration_by_brute_force():
    """Word by word and pair by pair, against what the operator's arrays give; one text is longer than what is pooled at a time."""
    rng = random.Random(12)
    words = ["River", "harbour", "LETTER", "x9", "!!", "naïve", "sun", "sun."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))).encode() for _ in range(40)] + [b"", b"one", (" ".join(rng.choice(words[:3]) for _ in range(70_000))).encode()]
    base = {w: plain_index_vector(quality_classifier.shape(w), 1) + 0.5 * plain_index_vector(w.lower(), 2) for w in {w for t in texts for w in t.split()} | {b"unseen"}}
    context = {w: np.zeros(quality_classifier.DIMENSIONS) for w in base}
    for t in texts:
        s = t.split()
        for a, b in zip(s, s[1:]):
            context[a] += base[b]
            context[b] += base[a]
    vector = {w: base[w] + c / max(np.linalg.norm(c), 1e-6) for w, c in context.items()}
    model = quality_classifier.WordVectors.fit(texts)
    assert sorted(model.vocabulary) == sorted(w for w in base if w != b"unseen")
    got = model.pool([*texts, b"unseen sun"])
    for x, t in zip(got, [*texts, b"unseen sun"], strict=True):
        s = t.split()
        mean = sum((vector[w] for w in s), np.zeros(quality_classifier.DIMENSIONS)) / max(len(s), 1)
        assert np.allclose(x[:-2], mean, atol=2e-3) and np.isclose(x[-2], np.linalg.norm(mean), atol=5e-3) and np.isclose(x[-1], np.log(1 + len(s)) / 8)
    noise = np.random.default_rng(3)
    x, check = noise.normal(0, 1, (3000, 5)), np.arange(3000) % 3 == 0
    y = (noise.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = quality_classifier.Network.fit(x, y, check)
    mean, scale, w1, b1, w2, b2, temperature = net.layers
    plain = [float(sum(np.tanh(sum((r[i] - mean[i]) / scale[i] * w1[i, j] for i in range(5)) + b1[j]) * w2[j, 0] for j in range(len(b1))) + b2[0]) for r in x[check]]
    loss = lambda k: sum(np.log1p(np.exp(-(v if t else -v) / k)) for v, t in zip(plain, y[check]))
    assert np.allclose(net.scores(x[check]), [1 / (1 + np.exp(-v / temperature)) for v in plain])
    assert min(np.geomspace(0.25, 8, 61), key=loss) == pytest.approx(temperature)
    s = net.scores(x[~check])
    for lo in (0, 0.2, 0.4, 0.6, 0.8):  # among rows with a score of about p a share of about p has label 1
        some = (s >= lo) & (s < lo + 0.2)
        assert abs(s[some].mean() - y[~check][some].mean()) < 0.08


def python_traffic(df):
    """Bytes that Python workers got and gave while df was collected."""
    df.collect()
    plan, sent, received = df._jdf.queryExecution().executedPlan(), 0, 0
    while True:
        metrics = plan.metrics()
        if metrics.contains("pythonDataSent"):
            sent += metrics.apply("pythonDataSent").value()
            received += metrics.apply("pythonDataReceived").value()
        if not plan.children().size():
            return sent, received
        plan = plan.children().head()


def test_texts_travel_to_the_classifier_once(spark, tmp_path, monkeypatch):
    """Neither a second time in a row that is kept, nor back; lists do not start workers of another kind."""
    import corpus_pipeline
    from pyspark import SparkContext

    spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, ("good words here " if i % 2 else "bad stuff there ") * 200, 7) for i in range(400)], "doc_id long, text string, score int").write.parquet(str(tmp_path / "documents.parquet"))
    docs, size = spark.read.parquet(str(tmp_path / "documents.parquet")), 400 * 200 * 16
    monkeypatch.setattr(SparkContext, "parallelize", None)
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    sent, received = python_traffic(kept)
    assert size <= sent < 1.2 * size and received < 0.1 * size
    assert {(r.doc_id, r.score) for r in kept.collect()} == {(i, 7) for i in range(1, 400, 2)}
    sent, received = python_traffic(quality_classifier.query(spark, str(tmp_path)))
    assert size <= sent < 1.2 * size and received < 0.1 * size


def test_classifier(spark, sf):
    docs = spark.read.parquet(f"{sf.rpartition(chr(47))[0]}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{sf.rpartition(chr(47))[0]}/sf0.1/labels.parquet")
    model = quality_classifier.fit(docs, labels, max_rows=2000)
    got = quality_classifier.score(docs, model).join(labels, "doc_id").filter(quality_classifier.held_out(F.col("doc_id"))).toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()
    odd = quality_classifier.score(spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("x")), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs.limit(3), none).collect()} == {0.5}


def test_a_long_text_does_not_end_the_sample(spark):
    ids = spark.range(200).filter(~quality_classifier.held_out(F.col("id"))).orderBy(F.xxhash64("id")).toPandas()["id"].tolist()
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    words = ["spam offer click", "river letter harbour"]
    for long in (0, 2):
        docs = spark.createDataFrame([(i, "long " * 9000 if k == long else f"{words[i % 2]} " * 5) for k, i in enumerate(ids)], "doc_id long, text string")
        found = quality_classifier.score(docs, quality_classifier.fit(docs, labels, max_bytes=40_000)).collect()
        assert all(r.predicted == r.doc_id % 2 for r in found if not r.text.startswith("long"))


def test_labels_of_held_out_rows_and_metadata_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.score(d, quality_classifier.fit(d, x)).select("doc_id", "score").orderBy("doc_id").collect() for d, x in ((docs, labels), (docs.repartition(5).withColumns({"lang": F.lit("?"), "source": F.lit("?")}), flipped)))
    assert a == b


def brute(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.append(0, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(rng, n):
    passage = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(5, 90))) for _ in range(12)]
    return ["".join(rng.choice([rng.choice(passage), "".join(rng.choice("ab") for _ in range(30)), "".join(rng.choice("abcdefghij\0") for _ in range(25))]) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_suffix_arrays():
    """Order, common lengths and repeated windows against sorting and comparing strings."""
    rng = random.Random(21)
    for width in (1, 3, 8):
        rows = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(width + 1))) for _ in range(60)]
        data, sizes = np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows])
        for backward in (False, True):
            array = suffix_dedup.SuffixArray(data, np.cumsum(sizes) - sizes, sizes, width, backward)
            full = [(r[::-1] if backward else r).ljust(width, b"\0") for r in rows]
            got = [full[i] for i in array.order]
            assert got == sorted(full)
            assert array.common.tolist() == [next((k for k in range(width) if a[k] != b[k]), width) for a, b in zip(got, got[1:])]
            for n in range(width + 1):
                assert len(set(zip(array.groups(n).tolist(), [f[:n] for f in full]))) == len({f[:n] for f in full}) == len(set(array.groups(n).tolist()))
    length, gram = 6, 3
    for _ in range(50):
        runs, back = [], []
        for _ in range(12):
            a = rng.choice(["abc", "aab"])
            b = rng.randrange(length - gram + 1)
            least = rng.randrange(b + 1)  # windows that begin least .. b bytes before the anchor
            runs.append(("".join(rng.choice("ab") for _ in range(b)) + a + "".join(rng.choice("ab") for _ in range(length - gram - least))).encode())
            back.append(b)
        got = suffix_dedup.repeated_windows(runs, np.array(back), length, gram)
        windows = [{back[i] - s: r[s : s + length] for s in range(len(r) - length + 1) if s <= back[i]} for i, r in enumerate(runs)]
        for i, own in enumerate(windows):
            want = [own.get(o) is not None and any(own[o] == other.get(o) and windows[j] is not own and runs[j][back[j] : back[j] + gram] == runs[i][back[i] : back[i] + gram] for j, other in enumerate(windows) if j != i) for o in range(length - gram + 1)]
            assert got[i].tolist() == want


@pytest.mark.parametrize("length,gram,large,batches", [(20, 10, 20_000, 3), (20, 10, 2, 3), (12, 5, 20_000, 1), (12, 12, 3, 5)])
def test_suffix_dedup_by_brute_force(spark, length, gram, large, batches):
    rng = random.Random(length)
    texts = [None, "", "short", "a" * 300, "ab" * 100 + "c", "x" * (length - 1), "y" * length, "y" * length] + made_texts(rng, 120)
    texts += texts[20:30] + texts[20:22]
    ids = [None if i == 9 else i // 2 for i in range(len(texts))]
    rows = list(zip(ids, texts, ["a"] * len(ids), ["b"] * len(ids), strict=True)) + [(7, texts[15], None, None)] * 2
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit("old") for c in ("n_bytes", "spans", "id", "th", "lo", "k0")})
    got = suffix_dedup.dedup(df, length, gram, large, keep=["doc_id", "text", "n_bytes", "spans", "k0"], batches=batches).collect()
    want = brute([(t or "").encode() for _, t, _, _ in rows], length)
    assert Counter((r.doc_id, r.text, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, t, *w) for (i, t, _, _), w in zip(rows, want, strict=True))
    assert all("�" not in r.clean_text and set(r.clean_text) <= set(r.text or "") and r.spans == "old" and r.k0 == "old" for r in got)
    assert suffix_dedup.dedup(df.limit(0), length, gram, batches=2).count() == 0


def test_new_batches_meet_the_levels_that_are_there(spark):
    """After each batch: what is repeated in all documents so far is what was told until then, and levels shrink twofold."""
    rng, length = random.Random(2), 20
    texts = made_texts(rng, 80)
    index = suffix_dedup.SuffixIndex(spark, length, 10)
    told: dict = {}
    done = 0
    for size in (10, 10, 20, 5, 35):
        rows = list(enumerate(texts))[done : done + size]
        done += size
        index.add(spark.createDataFrame([(i, i * 7, t) for i, t in rows], "id long, th long, text string"))
        for r in index.spans().collect():
            told.setdefault(r.id, set()).update(s for lo, hi in r.spans for s in range(lo, hi + 1))
        raw = [t.encode() for t in texts[:done]]
        starts = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
        assert {i: {s for s in range(len(t) - length + 1) if starts[t[s : s + length]] > 1} for i, t in enumerate(raw)} == {i: told.get(i, set()) for i in range(done)}
        counts = [n for _, n, _ in index.levels]
        assert all(a >= 2 * b for a, b in zip(counts, counts[1:])) and counts[-1] == index.levels[-1][0].count()
    assert len(index.levels) < 5
    index.forget()


def test_suffix_dedup_of_a_table_at_full_length(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.query(spark, sf).collect()}
    want = brute([(t or "").encode() for _, t in rows], 200)
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)} and sum(w[1] for w in want) > 0


def test_long_text_is_cut_into_chunks(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_300_000))
    rows = [(1, long, "", ""), (2, long[1_048_300:1_049_000] + "!", "", ""), (3, "?" + long[500_000:500_199] + "?", "", ""), (4, "?" + long[1_048_476:1_048_676], "", "")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS), keep=["doc_id"]).collect()}
    assert got == {1: (700, 1), 2: (700, 1), 3: (0, 0), 4: (200, 1)}


def test_texts_made_to_collide_are_told_apart(spark):
    """Two texts with equal polynomials modulo 2^64, in any base, over all their bytes and over their first half's."""
    pair = (
        "qtmnusuoxwykspmdqsbrjbyegpercshukreswnmecmjyuchftlifruqlswwkxqzyckdapqudwbdrhylojyrvsmszbtlwfcyshugmaqstlwkvavbwojqsyevonvluqlrbvumwribogpfwctzfvyjbkikkxhkjtcfvcerikvabufjjgstuyvsxjdrfypkpgbfhubgbizii",
        "qtmnusuoxwykspmdqsbrjbyegpercshukreswnmecmjyuchftlifruqlswwkxqzyckdapqudwbdrhylojyrvsmszbtlwfcyshugmaptvjxitfvatmkwvsfqnxsiwlkydtwhrvlenapjvgsrmwqkenijgwmnmjclmglmhoragschglvqyxsvxeetezpkqhaegucgbizii",
    )
    assert len(pair[0]) == len(pair[1]) == 200 and pair[0] != pair[1]
    for large in (suffix_dedup.LARGE_GROUP, 1):
        rows = [(i, t, "", "") for i, t in enumerate(pair)]
        assert {r.n_removed for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS), large=large, keep=["doc_id"]).collect()} == {0}
        rows += [(2, pair[0] + "!", "", "")]
        assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS), large=large, keep=["doc_id"]).collect()} == {0: 200, 1: 0, 2: 200}


def test_classifier_takes_no_texts_to_the_driver(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    came, frame = [], type(docs)
    for name in ("collect", "first", "toPandas"):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name): (came.extend(self.columns), f(self))[1])
    vectors, network = quality_classifier.fit(docs, labels)
    assert "model" in came and "text" not in came
    assert len(vectors.vocabulary) and network.layers is not None
