"""Periodic runs against all stretches of all periods."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import periodic_runs as pr

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType()), T.StructField("id", T.StringType())])


def brute(words):
    """All (start, length, period): stretches at each lag, whose smallest period is that lag."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                s = words[i : j + q]
                if not any(all(s[x] == s[x + p] for x in range(len(s) - p)) for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def answer(doc_id, text):
    """The registered query's row."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def made(rng):
    """Words over few letters, with powers of short and long stretches put in."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        part = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60]))]
        if rng.random() < 0.6:
            size = int(len(part) * rng.choice([3, 3.5, 4, 4.3, 6]))
            part = [part[i % len(part)] for i in range(size)]
        out += part
    return out


def test_all_runs_are_found():
    rng = random.Random(3)
    docs = [made(rng) for _ in range(400)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 1000, list("ab") * 300 + list("aab") * 200]
    runs, owner = pr.runs_of_texts([[w.encode() for w in d] for d in docs])
    got = [[] for _ in docs]
    for r, o in zip(runs.tolist(), owner.tolist(), strict=True):
        got[o].append(tuple(r))
    want = [brute(d) for d in docs]
    assert got == want
    assert {q for w in want for _, _, q in w} >= {1, 2, 3, 5, 8, 20, 60}


def test_words_whose_grams_repeat_within_a_period():
    """Every short gram of a Thue-Morse word occurs many times within one period: only long grams seed its lag."""
    word = "a"
    while len(word) < 512:
        word += word.translate(str.maketrans("ab", "ba"))
    for size in (8, 16, 57, 58, 128, 300, 512):
        docs = [list(word[:size]) * 4, list(word[:size]) * 3 + list(word[: size - 1]), ["x"] + list(word[:size]) * 5 + ["y"]]
        runs, owner = pr.runs_of_texts([[w.encode() for w in d] for d in docs])
        for i, d in enumerate(docs):
            assert [tuple(r) for r in runs[owner == i].tolist()] == brute(d)


def test_lag_classes_cover_all_lags_within_their_guarantee():
    at = 1
    for k, low in pr.lag_classes(100_000):
        assert low == at and all(k >= q and max(6, 4 * q) - q >= k for q in range(low, k + 1))
        at = k + 1
    assert at * 4 > 100_000


def test_a_seed_in_a_known_run_is_not_extended_again(monkeypatch):
    calls = []
    agree = pr._agree
    monkeypatch.setattr(pr, "_agree", lambda *a: calls.append(1) or agree(*a))
    names = np.append(np.arange(30_000) % 7, -1)
    assert pr.find_runs(names, np.zeros(len(names), int), len(names) - 1).tolist() == [[0, 30_000, 7]]
    assert len(calls) == 2


ODD = [
    (1, None, "a", "b"),
    (2, "", None, None),
    (3, " \t\r\n\x0b\x0c ", "", ""),
    (4, "no  no\tno\nno no no yes", "a", "a"),
    (4, "no  no\tno\nno no no yes", "a", "a"),
    (4, "other text", "a", "a"),
    (None, "la la la la la la", "a", "a"),
    (6, "é 你 é 你 é 你 é 你   \x1c", "a", "a"),
    (7, "word " * 400_000, "a", "a"),
    (8, "x" * 1_200_000 + " y" * 9, "a", "a"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS).repartition(3)
    got = pr.collapse(df, keep=["doc_id", "text", "id"]).collect()
    assert len(got) == len(ODD)
    for r in got:
        words = (r.text or "").encode().split()
        runs = brute(words) if len(words) < 1000 else [(0, 400_000, 1)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), runs)
        assert r.collapsed_text == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    assert Counter(r.id for r in got) == Counter(i for *_, i in ODD)
    assert pr.collapse(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit("old") for c in ("n_words", "collapsed_text", "k0", "start", "best")})
    assert {r.best for r in pr.collapse(clash).collect()} == {"old"} and pr.collapse(clash).columns.count("runs") == 1


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "odd"])
def test_query_matches_brute_force(spark, table, tmp_path):
    if table == "odd":
        table = str(tmp_path)
        rows = [r for r in ODD if r[0] not in (7, 8)] + [(i, " ".join(made(random.Random(i))), None, None) for i in range(100, 160)]
        spark.createDataFrame(rows, DOCS).select("doc_id", "text").write.parquet(f"{table}/documents.parquet")
    rows = spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "text").collect()
    got = pr.query(spark, table)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(answer(r.doc_id, r.text) for r in rows)
