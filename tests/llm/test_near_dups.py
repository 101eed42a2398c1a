"""Near-duplicate documents and lines against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import minhash_dedup as mh

from .test_text_ops import DOCS, ODD


def plain_sets(texts):
    """Shingle counts by words themselves."""
    out = []
    for t in texts:
        w = (t or "").encode().split()
        out.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    return out


def test_words_and_shingles():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\n\t") for _ in range(rng.randrange(60))).encode() for _ in range(200)]
    texts.insert(7, b"")
    a, ca = mh.word_hashes(texts)
    b, cb = mh.word_hashes(texts, chunk=16)
    assert ca.tolist() == cb.tolist() == [len(t.split()) for t in texts] and (a == b).all()
    words = [w for t in texts for w in t.split()]
    assert len(set(zip(words, a.tolist()))) == len(set(words)) == len(set(a.tolist()))
    h, tf, c, x, y = mh.weighted_sets(texts)
    want = plain_sets([t.decode() for t in texts])
    assert c.tolist() == [len(w) for w in want] and tf.sum() == sum(sum(w.values()) for w in want)
    assert len(set(zip(x, y))) == len({tuple(t.split()) for t in texts})


def test_draws_agree_like_the_similarity():
    rng = np.random.default_rng(4)
    usual = 1 + np.log(20)
    for shared in (300, 700, 900):
        h = rng.integers(0, 2**63, 1000 + 1000 - shared).astype(np.uint64)
        a, b = h[:1000], h[1000 - shared :]
        w = rng.choice([usual, 1.5, 2 * usual], len(h))
        wa, wb = w[:1000], w[1000 - shared :]
        least = w[1000 - shared : 1000].sum()
        want = least / (wa.sum() + wb.sum() - least)
        got = mh.Draws(600, usual)
        x, y = got.draw(a, wa, np.array([1000])), got.draw(b, wb, np.array([len(b)]))
        assert abs((x == y).mean() - want) < 0.07


def brute_classes(rows):
    """Classes by comparing all pairs with the operator's weights."""
    sets = plain_sets([t for _, t in rows])
    words = [tuple((t or "").encode().split()) for _, t in rows]
    df = Counter(g for s in sets for g in s)
    idf = {g: 1 + np.log(min(20, len(rows) / n)) for g, n in df.items()}
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    total = [sum(n * idf[g] for g, n in s.items()) for s in sets]
    having = defaultdict(list)
    for i, s in enumerate(sets):
        least = Counter()
        for g, n in s.items():
            for j, m in having[g]:
                least[j] += min(n, m) * idf[g]
            having[g].append((i, n))
        for j, both in least.items():
            if words[i] == words[j] or both / (total[i] + total[j] - both) >= 0.8 - 1e-12:
                parent[find(i)] = find(j)
    wordless = [i for i, w in enumerate(words) if not w]
    for i in wordless[1:]:
        parent[find(i)] = find(wordless[0])
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups


@pytest.fixture(scope="module")
def family(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            edited = list(base)
            for _ in range(rng.randrange(0, 5)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append(" ".join(edited))
    hot = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(80):
        edited = list(hot)
        edited[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append(" ".join(edited))
    rows += ["", None, "  \n", "two words", "two  words", "one"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


def test_classes_by_brute_force(spark, family):
    df = spark.createDataFrame([(i, t, "k", "x") for i, t in family], DOCS).repartition(5)
    got = {r.id: r for r in mh.classes(df).collect()}
    assert len(got) == len(family)
    for members in brute_classes(family).values():
        ids = sorted(family[m][0] for m in members)
        assert {got[i].class_id for i in ids} == {ids[0]} and {got[i].class_size for i in ids} == {len(ids)}
        assert [i for i in ids if got[i].keep] == [ids[0]]
    kept = mh.dedup(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, r in got.items() if r.keep) and set(kept[0].asDict()) == {"doc_id", "text", "kept", "ids"}


def test_all_links_of_a_table(spark, sf):
    """Every class of the small documents table, found by comparing all pairs that share a shingle: none is split or joined."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf.rpartition(chr(47))[0]}/sf0.01/documents.parquet").collect()]
    got = {r.id: r for r in mh.classes(spark.createDataFrame([(i, t, "k", "x") for i, t in rows], DOCS)).collect()}
    want = brute_classes(rows)
    assert len(want) < len(rows) - 50
    for members in want.values():
        ids = sorted(rows[m][0] for m in members)
        assert {got[i].class_id for i in ids} == {ids[0]} and {got[i].class_size for i in ids} == {len(ids)}


def test_document_frequencies_are_exact(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words[: rng.choice([2, 3, 12])]) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    df = Counter(g for s in plain_sets(texts) for g in s)
    found = mh.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    names = {int(mh.weighted_sets([b" ".join(g)])[0][0]): n for g, n in df.items()}
    want = {h: n for h, n in names.items() if n >= mh.RARE * 300}
    assert 5 < len(want) < len(names) and dict(zip(found.shingles.tolist(), np.round(300 / np.exp(found.weights - 1)).astype(int).tolist())) == want
    assert found.of(np.array([min(set(names) - set(want))], np.uint64)).tolist() == [mh.Weights.USUAL]


def test_odd_rows(spark):
    df = spark.createDataFrame([*ODD, (None, None, None, None), (0, None, None, None)], DOCS)
    got = mh.classes(df).collect()
    assert len(got) == len(ODD) + 2
    assert Counter(r.id for r in mh.dedup(df).select("doc_id").withColumnRenamed("doc_id", "id").collect()) == Counter(dict.fromkeys({r.id for r in got if r.keep}, 1))
    assert mh.classes(df.limit(0)).count() == 0 and mh.dedup(df.limit(0)).count() == 0
    clash = df.select("doc_id", "text", *[F.lit(k).alias(k) for k in ("__id", "__null", "__th", "__n", "id", "th", "node")])
    kept = mh.dedup(clash).collect()
    assert len(kept) == mh.dedup(df).count() and all(r["__n"] == "__n" and r["__id"] == "__id" and r.th == "th" for r in kept)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    parent = {n: n for p in pairs for n in p}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in pairs], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in mh.components(df).collect()}
    assert got == {n: find(n) for n in parent if any(n in p and p[0] != p[1] for p in pairs)}


def test_large_families_around_the_threshold(spark):
    """Texts of a form are 0.79 alike, those of a pair 0.82: bands have many more than OUTSIDE nodes outside of their leader's class."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(1110)]
    rows = []
    for k in range(120):
        both = rng.randrange(110)
        for side in "ab":
            edited = list(base)
            for j, slot in enumerate(rng.sample([x for x in range(110) if x != both], 5)):
                edited[10 * slot + 5] = f"x{k}{side}{j}"
            edited[10 * both + 5] = f"y{k}"
            rows.append(" ".join(edited))
    h, tf, c, _, _ = mh.weighted_sets([t.encode() for t in rows])
    ends = np.cumsum(c)
    w = tf * mh.Weights(*np.unique(h, return_counts=True), len(rows)).of(h)
    sets = [(h[e - n : e], w[e - n : e]) for e, n in zip(ends, c)]
    links = [(j, i) for i in range(len(rows)) for j in range(i) if mh.similarity(sets[i], sets[j]) >= 0.8]
    assert len(links) >= 100
    df = spark.createDataFrame([(i, t, "k", "x") for i, t in enumerate(rows)], DOCS).repartition(3)
    got = {r.id: r.class_id for r in mh.classes(df).collect()}
    assert [x for x in links if got[x[0]] != got[x[1]]] == []


def test_held_sets_agree_with_the_similarity(monkeypatch):
    rng = np.random.default_rng(6)
    base = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [base[np.sort(rng.permutation(300)[: rng.integers(200, 301)])] for _ in range(40)]
    weights = [1 + (s % np.uint64(5)).astype(float) for s in sets]
    draws = np.zeros(100, "<u4").tobytes()
    want = [[k for k in range(40) if mh.similarity((sets[k], weights[k]), (sets[i], weights[i])) >= mh.THRESHOLD - 1e-12] for i in range(40)]
    assert 40 < sum(map(len, want)) < 1600
    for at_a_time in (1 << 18, 500, 1):
        monkeypatch.setattr(mh, "ELEMENTS", at_a_time)
        held = mh.Held(sets, weights, [draws] * 40)
        assert [held.alike(sets[i], weights[i], draws) for i in range(40)] == want
    assert held.alike(sets[0], weights[0], np.ones(100, "<u4").tobytes()) == []


def test_pairs_are_told_in_their_first_shared_band():
    one = (np.arange(5, dtype=np.uint64), np.ones(5))
    draws = np.zeros((3, 100), "<u4")
    draws[1, :5], draws[2, 12] = 7, 7
    held = mh.Held([one[0]] * 3, [one[1]] * 3, [d.tobytes() for d in draws])
    own = np.zeros(100, "<u4").tobytes()
    assert [held.alike(*one, own, band) for band in (None, 0, 1, 2)] == [[0, 1, 2], [0, 1, 2], [1], []]


def test_few_links_are_closed_by_one_task(spark, family, monkeypatch):
    """As by joins; classes() writes no table for a step of it."""
    rng = random.Random(8)
    pairs = [(rng.randrange(600), rng.randrange(600)) for _ in range(300)] + [(i, i + 1) for i in range(700, 790)]
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in pairs], "a binary, b binary").repartition(7)
    few = mh.components(df)
    assert "Exchange" not in few._jdf.queryExecution().optimizedPlan().toString() and few.rdd.getNumPartitions() == 1
    got = {tuple(map(bytes, r)) for r in few.collect()}
    assert mh.components(df.limit(0)).count() == 0
    written, real = [], mh.materialize
    monkeypatch.setattr(mh, "materialize", lambda df, purpose, by=None: (written.append(purpose), real(df, purpose, by))[1])
    mh.classes(spark.createDataFrame([(i, t, "k", "x") for i, t in family], DOCS)).count()
    assert "classes" in written and "components" not in written
    monkeypatch.setattr(mh, "LINKS", 0)
    assert {tuple(map(bytes, r)) for r in mh.components(df).collect()} == got and "components" in written
