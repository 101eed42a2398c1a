"""Boards as columns against the walk over pages; feeds as batches and streams; the raw layer's buckets."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sluice.plans import writes
from sluice.plans.catalogue import QUERIES
from sluice.sources import boards, feed, paginated
from sluice.streaming import incremental

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def entry(rng, i):
    when = rng.choice([None, "soon", 5, (DAY + dt.timedelta(days=rng.randrange(20))).strftime("%Y-%m-%dT%H:%M:%SZ")])
    e = {"id": f"e{i}", "url": "https://x", "postedAt": when, "n": {"a": [1, None, "é"]}}
    return rng.choice([e] * 6 + [e | {"id": i}, e | {"id": ""}, e | {"url": "http://x"}, e | {"url": None}, None, 5, "text", []])


@pytest.mark.parametrize("recent_first,since,limit", [(False, None, 500), (False, 8, 6), (True, 4, 500), (True, None, 3)])
def test_boards_as_columns_equal_the_walk(spark, tmp_path, recent_first, since, limit):
    rng = random.Random(limit)
    made = {f"b{i}": [entry(rng, k) for k in range(rng.randrange(25))] for i in range(40)}
    for name, jobs in made.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"jobs": jobs}, ensure_ascii=False))
    for name, text in {"x1": "{", "x2": " ", "x3": "[]", "x4": '{"jobs": {}}', "x5": "null", "x6": '{"jobs": "a"}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    floor = since and DAY + dt.timedelta(days=since)
    items, faults = boards.scan_boards(boards.read_boards(spark, str(tmp_path)), 3, 5, since and F.lit(floor), recent_first, limit)
    got = {}
    for r in items.orderBy("source", "pos").collect():
        got.setdefault(r.source, []).append((r.external_id, json.loads(r.payload)))
        assert made[r.source][r.pos]["id"] == r.external_id
    for name, jobs in made.items():
        d = paginated.Descriptor(name, name, "MANUAL_IMPORT", "https://x", ordering="RECENT_FIRST" if recent_first else "UNSPECIFIED", page_size=3, max_pages=5)
        want = [(i.external_id, i.payload) for i in paginated.walk(paginated.board_pages(json.dumps({"jobs": jobs}), 3), d, limit, floor)]
        assert got.get(name, []) == want
    told = {(r.source, r.pos): r.problem for r in faults.collect()}
    assert {s: p for (s, k), p in told.items() if k is None} == {"x1": "not JSON", "x2": "not JSON"} | dict.fromkeys(("x3", "x4", "x5", "x6"), "no array of jobs")
    for (s, k), problem in told.items():
        if k is not None:
            e = made[s][k]
            assert problem == ("no object" if not isinstance(e, dict) else "id" if not isinstance(e["id"], str) or not e["id"] else "url")
    assert sum(k is not None for _, k in told) > 10
    odd = spark.createDataFrame([("a", None), ("b", ""), (None, '{"jobs": [{"id": "e", "url": "https://x"}]}')], "source string, text string")
    assert sorted((r.source, r.problem) for r in boards.scan_boards(odd)[1].collect()) == [("a", "not JSON"), ("b", "not JSON")]
    assert all(x.count() == 0 for x in boards.scan_boards(odd.limit(0)))


def test_packed_boards_are_those_of_files(spark, tmp_path):
    rng = random.Random(5)
    made = {f"b{i}": json.dumps({"jobs": [entry(rng, k) for k in range(rng.randrange(25))]}, ensure_ascii=False) for i in range(60)} | {"x1": "{", "x2": " \r\n\x1e\"", "x3": "[]", "x4": '{"jobs": {}}', "x5": '{"jobs": []}'}
    (tmp_path / "files").mkdir()
    for name, text in made.items():
        (tmp_path / "files" / f"{name}.json").write_text(text, newline="")
    given = spark.createDataFrame([*made.items(), ("y1", None), ("y2", "")], boards.PACK).repartition(2, "source")
    boards.pack_boards(given, str(tmp_path / "packs"))
    assert len(list((tmp_path / "packs").glob("*.parquet"))) == 2
    packed = boards.read_packs(spark, str(tmp_path / "packs"))
    assert sorted(packed.collect(), key=str) == sorted(given.collect(), key=str)
    found = [boards.scan_boards(read, 3, 5, F.lit(DAY + dt.timedelta(days=8)), True, 6) for read in (boards.read_boards(spark, str(tmp_path / "files")), packed.filter("source < 'y'"))]
    for a, b in zip(*found, strict=True):
        assert a.count() > 4 and sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
    # texts are parsed before, not by each plan that uses them
    assert not any("Generate" in x._jdf.queryExecution().optimizedPlan().toString() for x in found[0])


def test_files_of_board_scan_do_not_grow_with_its_boards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writes, "shared_folder", lambda _, purpose: f"file://{tmp_path}/{purpose}")
    assert QUERIES["board_scan"](spark, "/root/testdata/sf0.01").count() > 1000
    assert 0 < len(list(tmp_path.glob("boards/**/part-*"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def line(i, day=0):
    return json.dumps({"id": f"e{i}", "url": "https://x", "postedAt": (DAY + dt.timedelta(days=day)).isoformat()}) + "\n"


def test_feeds_are_streamed_without_loss_or_repeat(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "BLOCK", 100)
    box = tmp_path / "feeds"
    box.mkdir()

    def run():
        incremental.ingest_stream(spark, incremental.from_feeds(spark, str(box)), str(tmp_path / "raw"), str(tmp_path / "ck")).awaitTermination()
        rows = incremental.raw_layer(spark, str(tmp_path / "raw")).read().collect()
        return sorted((r.source_id, r.external_id) for r in rows)

    (box / "a.jsonl").write_text("".join(line(i) for i in range(50)) + "broken\n" + '{"id": 5}\n')
    (box / "b.jsonl").write_text(line(0) + line(1)[:20])  # its last line is being written
    first = [("a", f"e{i}") for i in range(50)] + [("b", "e0")]
    assert run() == sorted(first) and run() == sorted(first)
    with (box / "a.jsonl").open("a") as f:
        f.write(line(50))
    (box / "b.jsonl").write_text(line(0) + line(1))
    (box / "c.jsonl").write_text(line(7))
    assert run() == sorted(first + [("a", "e50"), ("b", "e1"), ("c", "e7")])
    offsets = [json.loads(x) for p in sorted((tmp_path / "ck" / "offsets").glob("[0-9]*")) for x in p.read_text().splitlines()[2:]]
    assert offsets[-1] == {p.stem: p.stat().st_size for p in box.glob("*.jsonl")}
    part = feed._Stream(str(box)).partitions(offsets[0], offsets[-1])
    assert {p.source for p in part} == {"a", "b", "c"} and [r[2] for p in part for r in feed.rows_of(str(box), p)] == ["e50", "e1", "e7"]


def test_a_feed_gets_the_filter_on_dates(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(line(i, i) for i in range(10)) + json.dumps({"id": "none", "url": "https://x"}) + "\n")
    feed.register(spark)
    df = spark.read.format("sluice_feed").load(str(tmp_path))
    assert df.count() == 11
    late = df.filter(F.col("posted_at") >= F.lit(DAY + dt.timedelta(days=6)))
    assert sorted(r.external_id for r in late.collect()) == ["e6", "e7", "e8", "e9"]
    # Spark leaves the comparison to the reader: its own filter only says that there is a date
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(posted_at" in plan and ">=" not in plan
    after = df.filter((F.col("posted_at") > F.lit(DAY + dt.timedelta(days=6))) & (F.col("external_id") != "e9"))
    assert sorted(r.external_id for r in after.collect()) == ["e7", "e8"]
    assert spark.read.format("sluice_feed").load(str(tmp_path / "..")).count() == 0


def test_a_batch_opens_its_own_buckets(spark, tmp_path):
    raw = incremental.raw_layer(spark, str(tmp_path / "raw"), buckets=16)
    items = lambda ids, text="{}": spark.createDataFrame([("s", f"e{i}", "https://x", text, DAY) for i in ids], incremental.INPUT)
    incremental.append_new(items(range(500)), raw)
    assert raw.read().count() == 500 and len(raw.folders()) == 16
    opened = []
    real = type(raw).read

    def read(self, version=None, only=None):
        out = real(self, version, only)
        opened.append(len(out.inputFiles()))
        return out

    try:
        type(raw).read = read
        for k in range(12):
            incremental.append_new(items([3], json.dumps({"k": k})), raw)
            incremental.append_new(items([3], json.dumps({"k": k})), raw)
    finally:
        type(raw).read = real
    # one bucket of sixteen, and compaction keeps its files few
    assert max(opened) <= 9 and raw.read().count() == 512
    assert max(len(f) for f in raw.folders().values()) <= 8
