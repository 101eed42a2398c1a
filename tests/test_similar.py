"""Tier 3 over a stored index against all pairs; chains by doubling."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import resolve, similar
from sluice.storage import shared_folder

ROW = "company_slug string, id string, normalized_title string, description string"


def grams(title):
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (title or "").lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def brute(jobs, postings):
    """posting to (job, similarity, confirmed)."""
    words = lambda d: set((d or "").lower().split())
    out = {}
    for slug, p, title, text in postings:
        g, w = grams(title), words(text)
        fits = [(-share(g, grams(t)), -share(w, words(d)), j) for s, j, t, d in jobs if s == slug and slug is not None and g and share(g, grams(t)) >= 0.6 and share(w, words(d)) >= 0.5]
        if fits:
            s, d, j = min(fits)
            out[p] = (j, round(-s, 9), round(-d, 9))
    return out


def found(index, spark, postings):
    best = index.best(spark.createDataFrame(postings, ROW).repartition(3), key="id")
    return {r.id: (r.job_id, round(r.similarity, 9), round(r.confirmed, 9)) for r in best.collect()}


@pytest.mark.parametrize("with_order", [True, False])
def test_best_jobs_by_brute_force(spark, with_order):
    rng = random.Random(1)
    words = ["senior", "data", "base", "cook", "c", "java", "developers", "developer", "of", "ops", "night", "a1"]
    text = ["we", "run", "build", "sea", "team", "code"]

    def some(name, n):
        return [(rng.choice(["x", "y", None, ""]), f"{name}{i}", rng.choice([None, "", "é!"]) if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))), rng.choice([None, "", *[" ".join(rng.sample(text, rng.randrange(1, 6))) for _ in range(6)]])) for i in range(n)]

    jobs, postings = some("j", 150), some("p", 150)
    df = spark.createDataFrame(jobs, ROW)
    index = similar.TitleIndex.create(spark, shared_folder(spark, "titles"), df if with_order else None, buckets=4)
    assert found(index, spark, postings) == {}
    for k in (0, 1, 2):
        index.add(df.filter(F.pmod(F.hash("id"), F.lit(3)) == k), key="id")
    want = brute(jobs, postings)
    assert found(index, spark, postings) == want and len(want) > 20
    assert found(index, spark, postings[:5] * 2) == {p: want[p] for p in want if p in {x[1] for x in postings[:5]}}
    assert index.best(spark.createDataFrame([], ROW), key="id").count() == 0


def test_one_employer_with_many_titles(spark):
    """20,000 titles of one employer, 300 postings, against all pairs; few of the pairs are made."""
    rng = random.Random(2)
    part = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9))) for _ in range(400)]
    jobs = [("big", f"j{i:05d}", " ".join(rng.sample(part, rng.randrange(3, 7))) + " developer", "same words for all") for i in range(20_000)]
    near = [jobs[rng.randrange(20_000)][2].split() for _ in range(300)]
    postings = [("big", f"p{i}", " ".join(w[:-2] + [rng.choice(part)] * (i % 2) + w[-1:] if i % 3 else w), "same words for all") for i, w in enumerate(near)]
    index = similar.TitleIndex.create(spark, shared_folder(spark, "titles"), spark.createDataFrame(jobs, ROW), buckets=4)
    index.add(spark.createDataFrame(jobs, ROW), key="id")
    sets = [[grams(r[2]) for r in rows] for rows in (jobs, postings)]
    names = {g: i for i, g in enumerate(sorted(set().union(*sets[0], *sets[1])))}
    dense = [np.zeros((len(s), len(names)), np.float32) for s in sets]
    for m, s in zip(dense, sets):
        for i, g in enumerate(s):
            m[i, [names[x] for x in g]] = 1
    both = dense[1] @ dense[0].T
    alike = both / (dense[1].sum(1)[:, None] + dense[0].sum(1)[None, :] - both)
    want = {}
    for i, row in enumerate(alike.astype(np.float64)):
        at = int(np.argmax(row))
        if row[at] >= 0.6 - 1e-6:
            want[f"p{i}"] = (jobs[at][1], row[at])
    got = found(index, spark, postings)
    assert set(got) == set(want) and len(want) > 150
    assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-5 for p in want)
    assert index.pairs(similar.described(spark.createDataFrame(postings, ROW), "company_slug", "id", "normalized_title", "description")).count() < 0.01 * 300 * 20_000


def test_prefixes_of_a_stored_order_are_read_from_touched_buckets(spark):
    index = similar.TitleIndex.create(spark, shared_folder(spark, "titles"), buckets=16)
    rows = [(f"employer{i}", f"j{i}", "night cook", "a b c") for i in range(100)]
    index.add(spark.createDataFrame(rows, ROW), key="id")
    one = similar.described(spark.createDataFrame(rows[:1], ROW), "company_slug", "id", "normalized_title", "description")
    touched = index.entries.touched(one)
    assert len(touched) == 1 and len(index.entries.read(only=touched).inputFiles()) == 1 < len(index.entries.read().inputFiles())
    assert [(r.key, r.job_id) for r in index.pairs(one).collect()] == [("j0", "j0")]


def test_chains_take_few_joins(spark):
    jobs = spark.range(100).select(F.col("id").alias("job_id"), F.when(F.col("id") % 10 != 9, F.col("id") + 1).alias("merged_into"))
    for hops, write in ((8, False), (10, True)):
        plan = resolve.resolve_chains(jobs, hops, write)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") <= 2
    assert {r.job_id: r.canonical_id for r in resolve.resolve_chains(jobs).collect()} == {i: i // 10 * 10 + 9 if i % 10 else None for i in range(100)}
    assert resolve.resolve_chains(jobs.limit(0)).count() == 0


def test_equal_titles_are_compared_once(spark, monkeypatch):
    """Pairs of many copies against brute force, with two chunks in a class; what is compared are titles."""
    monkeypatch.setattr(resolve, "CHUNK", 30)
    sizes, settled = {}, resolve.settled

    def counted(df, purpose):
        out = settled(df, purpose)
        sizes[purpose] = out.count()
        return out

    monkeypatch.setattr(resolve, "settled", counted)
    names = ["large ring", "large rings", "hot bolt", "ring large", "!"]
    rows = [(["x", "y", None][k % 7 % 3], k, names[k * k % 5 if k % 4 else k % 3], "red heavy" if k % 2 else "red light new" if k % 3 else "") for k in range(300)]
    made = spark.createDataFrame(rows, "b string, k bigint, t string, d string")
    titles = {(b, k): (grams(t), set(d.split())) for b, k, t, d in rows if b}
    want = {(a[0], a[1], b[1]): (share(x[0], y[0]), share(x[1], y[1])) for a, x in titles.items() for b, y in titles.items() if a[0] == b[0] and a[1] < b[1] and share(x[0], y[0]) >= 0.6}
    got = resolve.fuzzy_pairs(made, "b", "k", "t", 0.6).collect()
    assert len(got) == len(want) > 4000 and {(r.block, r.key_a, r.key_b): round(r.similarity, 9) for r in got} == {k: round(s, 9) for k, (s, _) in want.items()}
    assert sizes["title-classes"] == 6
    sure = resolve.fuzzy_pairs(made, "b", "k", "t", 0.6, "d", 0.5).collect()
    assert sorted((r.block, r.key_a, r.key_b, round(r.confirmed, 9)) for r in sure) == sorted((*k, round(c, 9)) for k, (_, c) in want.items() if c >= 0.5)


def test_equal_titles_ask_once(spark, tmp_path, monkeypatch):
    seen = {}
    pairs = similar.TitleIndex.pairs

    def counted(self, rows, among=None):
        seen.update(asked=rows.count(), stored=among.count())
        return pairs(self, rows, among)

    monkeypatch.setattr(similar.TitleIndex, "pairs", counted)
    index = similar.TitleIndex.create(spark, f"file://{tmp_path}/titles")
    index.add(spark.createDataFrame([("c", f"j{k:03}", ["data engineer", "data engineers"][k % 2], "one two three") for k in range(200)], "company_slug string, job_id string, normalized_title string, description string"))
    best = index.best(spark.createDataFrame([("c", k, "data engineer", "one two three four") for k in range(100)], "company_slug string, posting_id int, normalized_title string, description string")).collect()
    assert seen == {"asked": 1, "stored": 2}
    assert sorted((r.posting_id, r.job_id, r.similarity, r.confirmed) for r in best) == [(k, "j000", 1.0, 0.75) for k in range(100)]
