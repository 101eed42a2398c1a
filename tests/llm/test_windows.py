"""Repeated word windows against a table of all windows."""

import glob
import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import window_dedup as wd

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("spans", T.StringType())])


def brute(rows, window):
    """(id, th, text) rows to (n_words, n_removed, clean text) of each document, by the first place of every window."""
    docs = {}
    for i, th, text in rows:
        docs[(-(2**63) if i is None else i, th)] = (text or "").encode().split()
    seen, out = set(), {}
    for key in sorted(docs):
        words = docs[key]
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        out[key] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


def made(rng, n):
    passages = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(3)) for _ in range(rng.randrange(4, 70))] for _ in range(8)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 7)):
            words += rng.choice([rng.choice(passages), [rng.choice("xyz") for _ in range(9)], [rng.choice("abcdefghij") for _ in range(25)]])
        out.append(rng.choice([" ", "\n", "  \t"]).join(words))
    return out


ODD = [(1, None), (2, ""), (3, " \t\n "), (3, "a b c"), (None, "one two three " * 30), (None, "one two three " * 30), (5, "one two three " * 31), (5, "é 你 " * 40), (-(2**63), "one two three " * 12), (8, "\x1c \x85 　 x" * 30)]


@pytest.mark.parametrize("window,gram,large,held", [(20, 5, 20_000, None), (6, 2, 20_000, 300), (6, 2, 3, 300), (5, 5, 20_000, None), (1, 1, 2, None)])
def test_windows_by_brute_force(spark, monkeypatch, window, gram, large, held):
    if held:
        monkeypatch.setattr(wd, "HELD", held)
    monkeypatch.setattr(wd, "SORTED", 50)
    rng = random.Random(window)
    texts = made(rng, 150)
    rows = [(i // 2, t, "old", "old") for i, t in enumerate(texts + texts[:20])] + [(i, t, None, None) for i, t in ODD]
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit("old") for c in ("k0", "th", "lo", "n_words")})
    got = wd.dedup(df, window, gram, large, keep=["doc_id", "text", "id", "spans", "k0"]).withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert len(got) == len(rows) and {r.k0 for r in got} == {"old"}
    want = brute([(r.doc_id, r.th, r.text) for r in got], window)
    for r in got:
        assert (r.n_words, r.n_removed, r.clean_text) == want[(-(2**63) if r.doc_id is None else r.doc_id, r.th)]
    assert sum(r.n_removed for r in got) > 0
    assert wd.dedup(df.limit(0), window, gram).count() == 0


def test_super_k_mers_hold_each_window_once():
    rng = np.random.default_rng(4)
    counts = np.array([0, 3, 20, 19, 500, 21])
    hashes = rng.integers(0, 50, counts.sum()).astype(np.uint64)
    lo, hi, core = wd.minimisers(hashes, counts, 20, 5)
    starts = np.cumsum(counts) - counts
    assert [s for a, b in zip(lo, hi) for s in range(a, b + 1)] == [s + i for s, n in zip(starts, counts) for i in range(n - 19)]
    assert (hi - lo < 16).all()
    by_window = {}
    for a, b, c in zip(lo, hi, core):
        for s in range(a, b + 1):
            assert by_window.setdefault(hashes[s : s + 20].tobytes(), c) == c


def test_a_long_text_and_long_words(spark):
    rng = random.Random(9)
    long = [str(rng.randrange(10**6)) for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["?"] + long[1000:1025] + ["?"])), (3, " ".join(long[5:24])), (4, ("w" * 100_000 + " ") * 25), (5, " ".join(long[200_000:]) + " end")]
    df = spark.createDataFrame([(*r, "", "") for r in rows], DOCS)
    assert {r.doc_id: r.n_removed for r in wd.dedup(df, keep=["doc_id"]).collect()} == {1: 0, 2: 25, 3: 0, 4: 24, 5: 100_000}


def test_query_matches_sql(spark, sf, tmp_path):
    def same(folder, files):
        got = wd.query(spark, folder)
        con = duckdb.connect()
        con.sql(f"create view documents as select * from read_parquet({files})")
        want = con.sql(f"select {', '.join(got.columns)} from ({wd.ORACLE_SQL})").fetchall()
        rows = got.collect()
        assert Counter(map(tuple, rows)) == Counter(want) and sum(r.n_removed for r in rows) > 0
        return rows

    rows = same(sf, glob.glob(f"{sf}/documents.parquet/*.parquet") or [f"{sf}/documents.parquet"])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute([(i, 0, t) for i, t in texts.items()], 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, m, t) in want.items()}
    odd = [(i, t) for i, (_, t) in enumerate(ODD)] + [(100 + i, t) for i, t in enumerate(made(random.Random(1), 40))]
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(str(tmp_path), glob.glob(f"{tmp_path}/documents.parquet/*.parquet"))
