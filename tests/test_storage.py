"""Snapshot tables: versions, copy on write, crashes; and the job store over them."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from sluice import storage
from sluice.operators import flow
from sluice.storage import Conflict, SnapshotTable

SCHEMA = "k long, v string"


def table(spark, tmp_path, buckets=8):
    return SnapshotTable.create(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["k"], buckets)


def rows(t, version=None):
    return {r.k: r.v for r in t.read(version).collect()}


def upsert(t, spark, new):
    batch = spark.createDataFrame(list(new.items()), SCHEMA)
    return t.rewrite(batch, lambda old: old.join(batch.select("k"), "k", "left_anti").unionByName(batch))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.version() == 0 and rows(t) == {}
    first = {i: "a" for i in range(200)}
    assert upsert(t, spark, first) == 1 and rows(t) == first
    before = t.folders()
    assert len(before) == 8
    assert upsert(t, spark, {5: "b", 1000: "c"}) == 2
    after = t.folders()
    touched = t.touched(spark.createDataFrame([(5, ""), (1000, "")], SCHEMA))
    assert {b for b in after if after[b] != before[b]} == set(touched) and len(touched) <= 2
    assert rows(t) == first | {5: "b", 1000: "c"} and rows(t, 1) == first
    other = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert other.version() == 2 and other.schema == t.schema
    # reading some buckets opens their files alone
    assert len(t.read(only=touched).inputFiles()) == len(touched)
    t.append(spark.createDataFrame([(7, "again")], SCHEMA))
    assert t.read().filter("k = 7").count() == 2 and rows(t, 2)[7] == "a"


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    upsert(t, spark, {1: "a", 2: "a"})

    def crash(self, name, text):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(storage._Files, "publish", crash)
        with pytest.raises(OSError):
            upsert(t, spark, {1: "b"})
    assert t.version() == 1 and rows(t) == {1: "a", 2: "a"}
    assert upsert(t, spark, {1: "c"}) == 2 and rows(t) == {1: "c", 2: "a"}
    # what the crash left is deleted with old versions
    assert len(os.listdir(tmp_path / "t" / "data")) == 3
    t.expire(keep=1)
    assert rows(t) == {1: "c", 2: "a"} and len(os.listdir(tmp_path / "t" / "data")) == 2 - (len(t.folders()) == 1)
    assert not [n for n in os.listdir(tmp_path / "t" / "versions") if "draft" in n]


def test_two_writers(spark, tmp_path):
    """The second of two writers that began from one version is refused; the first one's rows stay."""
    t = table(spark, tmp_path)
    upsert(t, spark, {1: "a"})
    other = SnapshotTable(spark, f"file://{tmp_path}/t")

    def late(old):
        upsert(other, spark, {1: "b"})
        return old

    with pytest.raises(Conflict):
        t.rewrite(spark.createDataFrame([(1, "")], SCHEMA), late)
    assert rows(t) == {1: "b"}
    with pytest.raises(ValueError):
        t.rewrite(spark.createDataFrame([(1, "")], SCHEMA), lambda old: spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    with pytest.raises(Conflict):
        SnapshotTable.create(spark, f"file://{tmp_path}/t", t.schema, ["k"], 2)


RAW = "source_id string, external_id string, content_hash string, url string, payload string, fetched_at timestamp_ntz"
WORDS = "we look for people who like to build and run services in a small team near the sea"


def raw(spark, items, day):
    when = dt.datetime(2024, 1, day)
    made = [(s, i, f"{i}{day}", f"https://x/{i}", json.dumps({"title": title, "company": "Aurelia GmbH", "description": text} | more), when) for s, i, title, text, more in items]
    return spark.createDataFrame(made, RAW)


def now(day):
    return F.lit(dt.datetime(2024, 1, day)).cast("timestamp_ntz")


def state(store):
    postings = {r.external_id: r for r in store.postings.read().collect()}
    return postings, {r.job_id: r for r in store.jobs.read().collect()}


def test_texts_of_a_small_batch_are_read_in_many_tasks(spark):
    batch = raw(spark, [("s", str(i), f"Cook {i}", WORDS, {}) for i in range(200)], 1)
    found = flow.candidates(batch.unionByName(raw(spark, [("s", "1", "Baker", WORDS, {})], 2)))
    rows = found.withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert len(rows) == 200 and {r.title for r in rows if r.external_id == "1"} == {"Baker"}


def test_batches_into_stored_tables(spark, tmp_path, monkeypatch):
    store = flow.JobStore.create(spark, f"file://{tmp_path}/jobs", buckets=4)
    one = raw(spark, [("s", "1", "Backend developer", WORDS, {"location": "Galway", "country": " ie", "postedAt": "2023-12-01T00:00:00Z"}), ("s", "2", "Cook", WORDS, {}), ("s", "3", "", WORDS, {})], 1)
    out = store.ingest(one, now(1))
    assert [r.problem for r in out.quarantine.collect()] == ["title"]
    postings, jobs = state(store)
    assert len(postings) == len(jobs) == 2
    job = jobs[postings["1"].job_id]
    assert (job.title, job.company_slug, job.location, job.country_code, job.description, job.posted_at, job.junior_level) == ("Backend developer", "aurelia", "Galway", "IE", WORDS, dt.datetime(2023, 12, 1), None)
    assert job.job_id == "job-" + job.dedup_hash and len(job.dedup_hash) == 64
    assert (postings["1"].url, postings["1"].first_seen_at, jobs[postings["2"].job_id].effective_posted_at) == ("https://x/1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))

    # a similar title and description joins by tier 3; a similar title alone, or another country's hash of an unlike title, does not
    two = raw(spark, [("t", "4", "Backend developers", WORDS + " today", {}), ("t", "5", "Backend developer", "nothing in common here", {"country": "de"}), ("t", "6", "Gardener", WORDS, {}), ("s", "2", "Head cook", WORDS, {})], 2)

    def crash(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(store.postings, "rewrite", crash)
        with pytest.raises(OSError):
            store.ingest(two, now(2))
    assert len(state(store)[0]) == 2
    outcomes = {r.external_id: r.outcome for r in store.ingest(two, now(2)).assigned.collect()}
    assert outcomes == {"4": "SIMILAR", "5": "MATCHED", "6": "MATCHED", "2": "ALREADY_CLUSTERED"}  # jobs of the dead batch are there
    after, jobs = state(store)
    assert after["4"].job_id == postings["1"].job_id and after["2"].job_id == postings["2"].job_id
    assert len({after["5"].job_id, after["6"].job_id, *[p.job_id for p in postings.values()]}) == len(jobs) == 4
    assert jobs[after["4"].job_id].last_seen_at == dt.datetime(2024, 1, 2) and jobs[after["2"].job_id].title == "Cook" and after["2"].title == "Head cook"
    again = store.ingest(two, now(3))
    assert {r.outcome for r in again.assigned.collect()} == {"ALREADY_CLUSTERED"} and len(state(store)[1]) == 4


def test_titles_without_a_job_are_passed_by(spark, tmp_path, monkeypatch):
    store = flow.JobStore.create(spark, f"file://{tmp_path}/jobs", buckets=4)
    batch = raw(spark, [("s", "1", "Backend developer", WORDS, {})], 1)

    def crash(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(store.jobs, "rewrite", crash)
        with pytest.raises(OSError):
            store.ingest(batch, now(1))
    assert [r.outcome for r in store.ingest(batch, now(1)).assigned.collect()] == ["CREATED"]
    postings, jobs = state(store)
    assert set(jobs) == {postings["1"].job_id}


def test_a_merged_job_passes_its_postings_on(spark, tmp_path):
    store = flow.JobStore.create(spark, f"file://{tmp_path}/jobs", buckets=4)
    store.ingest(raw(spark, [("s", "1", "Cook", WORDS, {}), ("s", "2", "Gardener", "Plants", {})], 1), now(1))
    postings, jobs = state(store)
    cook, gardener = postings["1"].job_id, postings["2"].job_id
    store.jobs.rewrite(store.jobs.read(), lambda old: old.withColumn("merged_into", F.when(F.col("job_id") == cook, gardener)))
    store.ingest(raw(spark, [("t", "3", "Cook", "Soup", {})], 2), now(2))
    postings, jobs = state(store)
    assert postings["3"].job_id == gardener and jobs[gardener].last_seen_at == dt.datetime(2024, 1, 2) and jobs[cook].last_seen_at == dt.datetime(2024, 1, 1)


def test_merges_in_stored_tables(spark, tmp_path, monkeypatch):
    store = flow.JobStore.create(spark, f"file://{tmp_path}/jobs", buckets=16)
    store.ingest(raw(spark, [("s", "1", "Cook", "short", {}), ("s", "2", "Gardener", WORDS, {}), ("s", "3", "Pilot", "fly", {}), ("s", "4", "Nurse", "care", {})], 1), now(1))
    postings, jobs = state(store)
    cook, gardener, pilot, nurse = (postings[k].job_id for k in "1234")
    merges = spark.createDataFrame([(cook, gardener), (gardener, pilot)], "job_a string, job_b string")

    def crash(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(store.jobs, "rewrite", crash)
        with pytest.raises(OSError):
            store.merge(merges)
    before = store.jobs.folders()
    winner = min(cook, gardener, pilot)
    assert {r.job_id: r.winner for r in store.merge(merges).collect()} == dict.fromkeys((cook, gardener, pilot), winner)
    postings, jobs = state(store)
    assert {postings[k].job_id for k in "123"} == {winner} and postings["4"].job_id == nurse
    assert (jobs[winner].title, jobs[winner].description, jobs[winner].merged_into) == ("Gardener", WORDS, None)
    assert {jobs[j].merged_into for j in (cook, gardener, pilot) if j != winner} == {winner}
    touched = set(store.jobs.touched(store.jobs.read().filter(F.col("job_id") != nurse)))
    assert {b for b, f in store.jobs.folders().items() if f != before.get(b)} == touched
    store.ingest(raw(spark, [("t", "5", "Cook", "soup", {})], 2), now(2))
    assert state(store)[0]["5"].job_id == winner
    assert store.merge(merges).count() == 0


def test_unlike_buckets(spark, tmp_path):
    """A value of any kind that differs shows, as do rows that lack or repeat; order and files do not."""
    at = dt.datetime(2020, 1, 1, 0, 0, 0, 1)
    rows = [(1, "a", None, at, 0.5, ["x", None]), (2, None, "a", at, None, []), (3, "a, b", "c", None, float("nan"), None)]
    table = SnapshotTable.create(spark, f"file://{tmp_path}/t", spark.createDataFrame(rows, "k long, a string, b string, t timestamp, d double, l array<string>").schema, ["k"], buckets=2)
    told = lambda rows: table.unlike(spark.createDataFrame(rows, table.schema).withColumn("__bucket", table.bucket()))
    assert told(rows) == table.touched(spark.createDataFrame(rows, table.schema))
    table.append(spark.createDataFrame(rows[:2], table.schema))
    table.append(spark.createDataFrame(rows[2:], table.schema))
    assert told(rows) == told(rows[::-1]) == told([]) == []
    for changed in ((1, None, "a", at, 0.5, ["x", None]), (1, "a", None, at.replace(microsecond=2), 0.5, ["x", None]), (1, "a", None, at, 0.5, [None, "x"]), (1, "a", None, at, None, ["x", None])):
        mine = table.touched(spark.createDataFrame([changed], table.schema))
        assert told([changed, *rows[1:]]) == mine
    assert told([*rows, rows[0]]) == table.touched(spark.createDataFrame(rows[:1], table.schema)) and told([*rows[1:], rows[1]]) != []
