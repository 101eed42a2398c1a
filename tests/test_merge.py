"""Merges of jobs against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import merge


def parts(pairs):
    """Node to the least node of its component."""
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


@pytest.mark.parametrize("shape", ["path", "star", "random", "loops", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(300)] + [(i, 600) for i in range(290, 320)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(230)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
        "none": [],
    }[shape]
    got = {r.node: r.component for r in merge.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == parts(edges)


JOBS = "job_id string, merged_into string, title string, description string, dedup_hash string, first_seen_at long, last_seen_at long, is_active boolean"
POSTINGS = "source_id string, external_id string, job_id string, title string, description string"
SAVED = "user_id long, job_id string, saved_at long"


def model(jobs, postings, saved, merges):
    """The same with dictionaries, one merge list at a time."""
    into = {j[0]: j[1] for j in jobs}

    def end(x):
        seen = [x]
        for _ in range(10):
            nxt = into[seen[-1]]
            if nxt is None or nxt not in into:
                break
            if nxt in seen:
                return nxt
            seen.append(nxt)
        return seen[-1]

    known = [(end(a), end(b)) for a, b in merges if a in into and b in into]
    group = parts([(a, b) for a, b in known if a != b])
    first = {j[0]: j[5] for j in jobs}
    winner = {g: min((x for x in group if group[x] == g), key=lambda x: (first[x], x)) for g in set(group.values())}
    to = {j: winner[group[end(j)]] for j in into if end(j) in group}
    out = {}
    for j, old, title, text, h, f, last, active in jobs:
        w = to.get(j)
        if w == j:
            mine = [x for x in jobs if to.get(x[0]) == j]
            rich = sorted((-len(p[4] or ""), p[0], p[1], p[3], p[4]) for p in postings if to.get(p[2]) == j)
            title, text = (rich[0][3], rich[0][4]) if rich else (title, text)
            f, last, active, old = min(x[5] for x in mine), max(x[6] for x in mine), any(x[7] for x in mine), None
        elif w:
            old = w
        out[j] = (old, title, text, h, f, last, active)
    kept = {}
    for u, j, at in saved:
        kept[u, to.get(j, j)] = max(at, kept.get((u, to.get(j, j)), at))
    return out, {p[:2]: to.get(p[2], p[2]) for p in postings}, kept


def test_merges_against_a_model(spark):
    rng = random.Random(5)
    name = lambda: f"j{rng.randrange(60):02d}"
    jobs = [(f"j{i:02d}", None if i % 4 else rng.choice([None, name(), f"j{max(i - 1, 0):02d}" if i else None]), f"t{i}", rng.choice([None, "x" * i]), f"h{i}", rng.randrange(10), rng.randrange(10, 20), rng.random() < 0.5) for i in range(60)]
    jobs = [(j, None if m == j else m, *rest) for j, m, *rest in jobs]
    postings = [("s", f"{i:03d}", rng.choice([name(), None]), f"p{i}", rng.choice([None, "", "d" * rng.randrange(30)])) for i in range(150)]
    postings = [p if p[4] is not None else (*p[:4], "") for p in postings]
    saved = [(rng.randrange(5), name(), rng.randrange(100)) for _ in range(80)]
    merges = [(name(), name()) for _ in range(25)] + [("j01", "j01"), ("j02", "gone"), ("gone", "j03")]
    frames = [spark.createDataFrame(rows, ddl).repartition(3) for rows, ddl in ((jobs, JOBS), (postings, POSTINGS), (saved, SAVED), (merges, "job_a string, job_b string"))]
    made = merge.merge_jobs(*frames)
    want_jobs, want_postings, want_saved = model(jobs, postings, saved, merges)
    assert {r.job_id: tuple(r)[1:] for r in made.jobs.collect()} == want_jobs
    assert {(r.source_id, r.external_id): r.job_id for r in made.postings.collect()} == want_postings
    assert {(r.user_id, r.job_id): r.saved_at for r in made.saved.collect()} == want_saved
    # the same list again changes nothing, and redirects are flat
    again = merge.merge_jobs(made.jobs, made.postings, made.saved, frames[3])
    assert {r.job_id: tuple(r)[1:] for r in again.jobs.collect()} == want_jobs
    winners = made.groups.select(F.col("winner").alias("job_id")).distinct()
    assert made.jobs.join(winners, "job_id").filter("merged_into IS NOT NULL").count() == 0
    empty = merge.merge_jobs(*[f.limit(0) for f in frames])
    assert empty.jobs.count() == empty.postings.count() == empty.saved.count() == 0
