"""Line dedup against brute force and SQL, and the pipeline stage by stage."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import line_dedup, quality_classifier

from .test_near_dups import brute_classes
from .test_text_ops import DOCS, ODD


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :] or a == b


def brute(rows):
    """(id, text) rows, ids distinct, to the text that stays."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = [], {}
    for i, text in order:
        kept = []
        for line in (text or "").split("\n"):
            w = line.encode().split()
            if not w:
                kept.append(line)
                continue
            near = any(w == v or (len(w) >= line_dedup.MIN_WORDS <= len(v) and one_edit(w, v)) for v in seen)
            if w not in seen:
                seen.append(w)
            if not near:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


@pytest.fixture(scope="module")
def lines_table():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 9, 10, 11, 25, 70]))] for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    w.insert(at, rng.choice(words))
                elif at < len(w) and kind == 1:
                    w[at] = rng.choice(words)
                elif at < len(w) and len(w) > 1:
                    del w[at]
            lines.append(rng.choice(["", " ", "\t"]) + rng.choice([" ", "  "]).join(w))
        rows.append((None if i == 33 else i, "\n".join(rng.choice([lines, [*lines, "", "  "]])) if i % 13 else None))
    return rows


def test_line_dedup_by_brute_force(spark, lines_table):
    df = spark.createDataFrame([(i, t, "k", "n") for i, t in lines_table], DOCS).withColumn("n_lines", F.lit("old")).repartition(4)
    got = line_dedup.dedup(df, out_col="clean").collect()
    assert {r.doc_id: r.clean for r in got} == brute(lines_table)
    assert all(r.kept == "k" and r.n_lines == sum(bool(x.split()) for x in (r.text or "").split("\n")) for r in got)


def test_line_dedup_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS)
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(ODD)
    twice = [r for r in got if r.doc_id == 3]
    assert twice[0] == twice[1] and twice[0].n_kept == twice[0].n_lines - 1
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_line_dedup_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = line_dedup.query(spark, sf)
    want = con.sql(f"select {', '.join(got.columns)} from ({line_dedup.ORACLE_SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = corpus_pipeline.STAGES
    assert [f.__name__ for _, f in stages] == ["quality", "lines", "near_duplicates", "repeats", "pack"]
    before = docs
    for k, (_, stage) in enumerate(stages):
        out = stage(spark, before, sf)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows, kept = {r.doc_id: r for r in before.collect()}, after.collect()
        if k < 4:
            assert after.columns == columns and all(r.n_chars == len(r.text) for r in kept)
            assert len({r.doc_id for r in kept}) == len(kept) <= len(rows)
        if k in (0, 2):
            assert all(r == rows[r.doc_id] for r in kept)
        if k == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            good = [i for i in rows if labels.get(i) == 1]
            assert sum(i in {r.doc_id for r in kept} for i in good) >= 0.95 * len(good)
            model = quality_classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert {r.doc_id for r in kept} == {r.doc_id for r in quality_classifier.score(docs, model).collect() if r.score >= 0.5}
        if k == 2:
            listed = [(r.doc_id, r.text) for r in rows.values()]
            assert sorted(r.doc_id for r in kept) == sorted(min(listed[m][0] for m in of) for of in brute_classes(listed).values())
        if k == 1:
            want = brute([(r.doc_id, r.text) for r in rows.values()])
            assert {r.doc_id: r.text for r in kept} == {i: t for i, t in want.items() if t.split() or not rows[i].text.split()}
        if k == 3:
            windows = Counter(t[i : i + 200] for t in (r.text.encode() for r in rows.values()) for i in range(len(t) - 199))
            for r in kept:
                t = rows[r.doc_id].text.encode()
                assert (r.text == rows[r.doc_id].text) == all(windows[t[i : i + 200]] == 1 for i in range(len(t) - 199))
        if k == 4:
            assert sum(r.length for r in kept) == sum({r.doc_id: r.doc_tokens for r in kept}.values()) and {r.doc_id for r in kept} == set(rows)
        before = after


def test_stages_take_odd_rows(spark, sf, tmp_path):
    """Nulls, repeats, empty tables and columns named like those that operators add."""
    clash = ["score", "predicted", "__text", "n_lines", "n_kept", "n_bytes", "n_removed", "clean_text", "row", "id", "th", "spans", "n_chars"]
    docs = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(7).cast("bigint") for c in clash})
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) <= len(ODD), name
        assert all(r[c] == 7 for r in rows for c in clash if c != "n_chars"), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.pack(spark, docs, sf).select("doc_id").distinct().count() == len({i for i, *_ in ODD})
    assert corpus_pipeline.pack(spark, docs.limit(0), sf).count() == 0
