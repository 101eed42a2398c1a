"""Seeds: references by natural keys, faults, the second pass of merges, and loads that change nothing."""

from sluice.operators import seed
from sluice.plans import catalogue


def seeds(spark, version="v1"):
    make = spark.createDataFrame
    return {
        "sources": make([("a", "A"), ("b", "B"), (None, "none")], "key string, name string"),
        "users": make([("u@x",), ("u@x",), ("v@x",)], "email string"),
        "profiles": make([("u@x", ["java"])], "user_email string, technologies array<string>"),
        "jobs": make([("h1", "one", None), ("h2", "two", "h1"), ("h3", "three", "h3"), ("h4", "four", "lost")], "dedup_hash string, title string, merged_into_hash string"),
        "postings": make([("a", "1", "h1", "t"), ("a", "1", "h1", "u"), ("b", "1", "h2", "t"), ("c", "1", "h1", "t"), ("a", "2", "h9", "t"), ("a", None, "h1", "t"), (None, "4", "h1", "t")], "source_key string, external_id string, job_hash string, title string"),
        "classifications": make([("h1", version, "i", 5), ("h2", "v1", "i", 7)], "job_hash string, version string, input_hash string, score int"),
        "saved_jobs": make([("u@x", "h2"), ("w@x", "h2")], "user_email string, job_hash string"),
    }


def test_loads(spark, tmp_path):
    root = f"file://{tmp_path}/seeds"
    tables, faults = seed.load(spark, root, seeds(spark))
    assert {n: t.read().count() for n, t in tables.items()} == {"sources": 2, "users": 2, "profiles": 1, "jobs": 4, "postings": 2, "classifications": 2, "saved_jobs": 1}
    jobs = {r.dedup_hash: r for r in tables["jobs"].read().collect()}
    assert {h: r.merged_into for h, r in jobs.items()} == {"h1": None, "h2": jobs["h1"].id, "h3": None, "h4": None}
    assert sorted((r.title, r.job_id) for r in tables["postings"].read().collect()) == sorted([("u", jobs["h1"].id), ("t", jobs["h2"].id)])
    assert sorted((r.entity, r.problem) for r in faults.collect()) == sorted([("sources", "no key"), *[("jobs", "no merged_into")] * 2, ("postings", "no sources"), ("postings", "no jobs"), ("postings", "no external_id"), ("postings", "no sources"), ("saved_jobs", "no users")])
    before = {n: (t.version(), sorted(map(str, t.read().collect()))) for n, t in tables.items()}
    again, _ = seed.load(spark, root, seeds(spark))
    assert {n: (t.version(), sorted(map(str, t.read().collect()))) for n, t in again.items()} == before
    later, _ = seed.load(spark, root, {"classifications": seeds(spark, "v2")["classifications"]})
    assert sorted((r.version, r.score, r.is_current) for r in later["classifications"].read().collect()) == [("v1", 5, False), ("v1", 7, True), ("v2", 5, True)]


def test_a_first_load_sends_and_writes_natural_keys_alone(spark, tmp_path, monkeypatch):
    written = {}
    settled = seed.settled

    def keep(df, purpose):
        written[purpose] = settled(df, purpose)
        return written[purpose]

    monkeypatch.setattr(seed, "settled", keep)
    tables, faults = seed.load(spark, f"file://{tmp_path}/seeds", seeds(spark))
    assert set(written["seed-postings"].columns) == {"source_key", "external_id", "job_hash", "title", "__problem"}
    assert "seed-rows" in written and written["seed-rows"].columns == tables["jobs"].read().columns  # only the table that points to itself
    assert tables["classifications"].version() == tables["postings"].version() == 1
    empty, _ = seed.load(spark, f"file://{tmp_path}/empty", {"users": spark.createDataFrame([], "email string")})
    assert empty["users"].version() == 0


def test_the_query_loads_postings_twice(spark, sf, monkeypatch):
    """The second load compares all of them and changes no table."""
    loads, load = [], seed.load

    def watched(session, root, rows, *more):
        tables, faults = load(session, root, rows, *more)
        loads.append({n: (t.version(), t.read().count()) for n, t in tables.items()})
        return tables, faults

    monkeypatch.setattr(seed, "load", watched)
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    assert catalogue.QUERIES["seeded_postings"](spark, sf).count() == items.count()
    assert len(loads) == 2 and loads[0] == loads[1] and set(loads[0]) == {"sources", "jobs", "postings"}
    assert all(v == 1 and n > 0 for v, n in loads[0].values())


def test_a_later_load_changes_the_buckets_that_differ(spark, tmp_path, monkeypatch):
    root, make = f"file://{tmp_path}/seeds", lambda rows: {**seeds(spark), "postings": spark.createDataFrame(rows, "source_key string, external_id string, job_hash string, title string")}
    rows = [("a", str(i), "h1", f"t{i}") for i in range(200)]
    tables, _ = seed.load(spark, root, make(rows))
    before = tables["postings"].folders()
    written, settled = [], seed.settled
    monkeypatch.setattr(seed, "settled", lambda df, purpose: (written.append((purpose, "job_id" in df.columns)), settled(df, purpose))[1])
    for same in (rows, rows[::-1], [*rows, rows[7]]):
        tables, _ = seed.load(spark, root, make(same))
        assert tables["postings"].version() == 1 and ("seed-rows", True) not in written  # compared without ids being written
    tables, _ = seed.load(spark, root, make(rows[50:]))
    assert tables["postings"].version() == 1 and tables["postings"].read().count() == 200
    tables, _ = seed.load(spark, root, make([*rows[:3], ("a", "3", "h1", None), *rows[4:], ("b", "new", "h2", "n")]))
    after = tables["postings"].folders()
    assert tables["postings"].version() == 2 and 1 <= len([b for b in after if after[b] != before.get(b)]) <= 2
    assert sorted((r.external_id, r.title) for r in tables["postings"].read().collect() if r.title is None or r.external_id == "new") == [("3", None), ("new", "n")] and tables["postings"].read().count() == 201


def test_keys_of_another_type_are_the_same_keys(spark, tmp_path):
    root, postings = f"file://{tmp_path}/seeds", "source_key string, external_id %s, job_hash string, title string"
    load = lambda rows, kind: seed.load(spark, root, {**{k: seeds(spark)[k] for k in ("sources", "jobs")}, "postings": spark.createDataFrame(rows, postings % kind)})[0]["postings"]
    assert load([], "string").version() == 0
    rows = [("a", i, "h1", "t") for i in range(40)]
    first = load(rows, "int")
    assert first.version() == 1 and all(first.touched(first.read(only=[b])) == [b] for b in first.folders())
    assert load([(a, str(i), h, t) for a, i, h, t in rows], "string").version() == 1
    later = load([("a", 7, "h1", "u")], "int")
    assert later.version() == 2 and sorted((r.external_id, r.title) for r in later.read().collect()) == sorted((str(i), "u" if i == 7 else "t") for i in range(40))
