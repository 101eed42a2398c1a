"""Operators, sources and streaming."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import hashing
from sluice.operators import classifiers, classify, flow, ingest, readmodel, resolve
from sluice.sources import contract, http, paginated
from sluice.streaming import incremental


def test_posting_outcomes_in_order(spark):
    old = spark.createDataFrame([("s", "a", "h1", True), ("s", "b", "h1", False)], "source_id string, external_id string, content_hash string, is_active boolean")
    new = spark.createDataFrame([("s", "a", "h1", 1), ("s", "a", "h2", 2), ("s", "b", "h1", 3), ("s", "c", "h1", 4), ("s", "c", "h1", 5), ("s", "c", "h3", 6)], "source_id string, external_id string, content_hash string, ingest_pos int")
    got = [r.outcome for r in resolve.posting_outcomes(old, new.repartition(3)).orderBy("ingest_pos").collect()]
    assert got == ["UNCHANGED", "UPDATED", "UPDATED", "CREATED", "UNCHANGED", "UPDATED"]


def test_cluster_creates_once(spark):
    postings = spark.createDataFrame([(i, None if i else "own", "h" if i < 6 else "k", i) for i in range(8)], "posting_id int, job_id string, dedup_hash string, ingest_pos int")
    got = {r.posting_id: (r.outcome, r.assigned_job_id) for r in resolve.cluster(postings.repartition(4), spark.createDataFrame([("j", "k")], "job_id string, dedup_hash string")).collect()}
    assert got[0] == ("ALREADY_CLUSTERED", "own") and got[1][0] == "CREATED" and {got[i][0] for i in range(2, 8)} == {"MATCHED"} and got[7][1] == "j"


@pytest.mark.parametrize("write,hops", [(False, 8), (True, 10)])
def test_chains_against_a_walk(spark, write, hops):
    rng = random.Random(3)
    nxt = {i: rng.choice([None, rng.randrange(60), i + 1, 999]) if i % 3 else (i + 1 if i < 59 else None) for i in range(60)}

    def walk(i):
        seen, at = [i], nxt[i]
        if at is None:
            return i
        for _ in range(hops):
            if at in seen:
                return at if write else None
            if at not in nxt:
                return seen[-1] if write else None
            seen.append(at)
            if nxt[at] is None:
                return at
            at = nxt[at]
        return seen[-1] if write else None

    df = spark.createDataFrame(list(nxt.items()), "job_id long, merged_into long")
    assert {r.job_id: r.canonical_id for r in resolve.resolve_chains(df, hops, write).collect()} == {i: walk(i) for i in nxt}


def test_hashes(spark):
    row = spark.range(1).select(hashing.dedup_hash(F.lit("aurelia-systems"), F.lit("backend developer java"), F.lit(" ie")).alias("h")).first()
    assert row.h == "471330e265544c7dd53b941cc91fee56664ccb115fc1b4c586ef8749ce4151e1"
    assert [hashing.number_text(x) for x in (1.0, 1e21, 1e-7, 0.1, 123456789012345680000.0, -0.0, 5e-324, 100)] == ["1", "1e+21", "1e-7", "0.1", "123456789012345680000", "0", "5e-324", "100"]
    a, b = {"b": [1, {"t": 1, "x": None}], "a": {"t": 2}}, {"a": {}, "b": [1, {"x": None}]}
    assert hashing.canonical(hashing.strip_paths(a, [["a", "t"], ["b", "t"]])) == hashing.canonical(b) == '{"a":{},"b":[1,{"x":null}]}'
    assert a["a"] == {"t": 2}
    fields = [F.lit(x) for x in ("u", "t", "c", "s")] + [F.lit(None).cast("string"), F.lit("")] + [F.lit("x")] * 4 + [F.array(F.lit("b"), F.lit("a")), F.lit("2024-01-02 03:04:05.678").cast("timestamp")]
    want = "\0".join([json.dumps(x) for x in ("u", "t", "c", "s", None, "", "x", "x", "x", "x", "a,b", "2024-01-02T03:04:05.678Z")])
    assert spark.range(1).select(hashing.posting_hash(*fields).alias("h")).first().h == hashlib.sha256(want.encode()).hexdigest()


def test_read_model_checks(spark):
    for bad in ((0, 20), (1, 51), (1.5, 20), ("1", 20), (True, 20)):
        with pytest.raises(ValueError):
            readmodel.check_page(*bad)
    jobs = spark.createDataFrame([(i, i != 3, "x" if i == 4 else None, dt.datetime(2024, 1, 1)) for i in range(30)], "id int, is_active boolean, merged_into string, effective_posted_at timestamp")
    page = readmodel.list_jobs(jobs, 2, 10)
    assert page.total == 28 and [r.id for r in page.items.collect()] == list(range(19, 9, -1))


def test_signals_and_level(spark):
    json_text = '[{"code": "a", "weight": 1, "evidence": "x", "z": 0}, {"code": 5, "weight": 1, "evidence": "x"}, null, {"code": "b", "weight": 2.5, "evidence": ""}]'
    df = spark.createDataFrame([(json_text,), ("{}",), ("nonsense",), (None,)], "j string")
    got = [[(s.code, s.weight, s.evidence) for s in r.s] for r in df.select(classify.parse_signals(F.col("j")).alias("s")).collect()]
    assert got == [[("a", 1.0, "x"), ("b", 2.5, "")], [], [], []]
    text = "Entry Level role, LEAD A TEAM"
    row = spark.range(1).select(classify.signals(F.lit(text), classify.POSITIVE).alias("p"), classify.signals(F.lit(text), classify.NEGATIVE).alias("n")).first()
    assert all(s.evidence in text for s in row.p + row.n) and [s.code for s in row.p + row.n] == ["entry_level", "lead_team"]
    years = spark.createDataFrame([(x,) for x in ("0-1 years", "0–2 Jahre", "1+ years", "at least 5 years", "mindestens 3 Jahre", "many years")], "t string").select(classify.required_years(F.col("t")).alias("y")).collect()
    assert [(r.y and r.y.min_years, r.y and r.y.max_years) for r in years] == [(0, 1), (0, 2), (1, None), (5, None), (3, None), (None, None)]


def test_walk_and_source(spark):
    d = paginated.Descriptor("board", "Board", "PUBLIC_API", "https://x.org/terms", page_size=3, max_pages=3)
    items = [paginated.Item(str(i), "https://x", {}, dt.datetime(2024, 1, 20 - i, tzinfo=dt.timezone.utc) if i != 2 else None) for i in range(12)]

    def fetch(cursor):
        n = int(cursor or 0)
        return paginated.SourcePage([*items[n : n + 3], None], str(n + 3))

    ids = lambda *a, **k: [i.external_id for i in paginated.walk(fetch, *a, **k)]
    since = dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc)
    assert len(ids(d)) == 9 and len(ids(d, limit=4)) == 4 and ids(d, limit=float("nan")) == [] == ids(d, limit=-1)
    assert ids(paginated.Descriptor("b", "B", "PUBLIC_API", "https://x", ordering="RECENT_FIRST", page_size=3), since=since) == ["0", "1", "2", "3", "4"]
    assert len(list(paginated.walk(lambda c: paginated.SourcePage(items[:1], "same"), d))) == 2
    assert paginated.problems(d) == [] and set(paginated.problems(paginated.Descriptor("A b", " ", "?", "http://x", rate_limit_rps=0, page_size=0))) == {"key", "display_name", "access_method", "terms_url", "rate_limit_rps", "page_size"}
    board = json.dumps({"jobs": [{"id": "a", "url": "https://a", "postedAt": "2024-01-02T00:00:00Z"}, {"id": 5, "url": "https://b"}, {"id": "c", "url": "https://c", "postedAt": "soon"}]})
    paginated.register(spark)
    rows = spark.read.format("sluice_boards").option("boards", json.dumps({"x": board, "y": board})).load().orderBy("source", "pos").collect()
    assert [(r.source, r.external_id, r.posted_at is None) for r in rows] == [("x", "a", False), ("x", "c", True), ("y", "a", False), ("y", "c", True)]
    with pytest.raises(ValueError):
        paginated.Registry([d, d])


def test_http_policy():
    slept, replies = [], []

    def transport(url, timeout):
        r = replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    get = lambda: http.fetch_json("https://x", transport, sleep=slept.append, rng=lambda: 0)
    replies[:] = [http.Reply(503), OSError("net"), http.Reply(200, body='{"a": 1}')]
    assert get() == {"a": 1} and slept == [0.5, 1.0]
    for reply, error in ((http.Reply(401), http.AccessDenied), (http.Reply(429), http.RateLimited), (http.Reply(404), http.ProtocolError), (http.Reply(200, "text/html", "Captcha"), http.Blocked), (http.Reply(200, body="{"), http.ProtocolError)):
        replies[:] = [reply]
        with pytest.raises(error):
            get()
    replies[:] = [http.Reply(500)] * 3
    with pytest.raises(http.Unavailable):
        get()
    with pytest.raises(http.ProtocolError):
        http.fetch_json("http://x", transport)
    at = [0.0]
    limiter = http.RateLimiter(lambda: at[0], slept.append)
    slept.clear()
    limiter.acquire("k", 4), limiter.acquire("k", 4), limiter.acquire("k", 4), limiter.acquire("other", 4)
    assert slept == [0.25, 0.5] and http.interval_ms(3) == 334 and http.interval_ms(0) == 0 and http.backoff_ms(2, 0.5) == 1250


def test_ingest_rows(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    runs = spark.createDataFrame([("a", "RUNNING", dt.datetime(2024, 1, 1, 10)), ("a", "RUNNING", dt.datetime(2024, 1, 1, 11)), ("b", "SUCCESS", dt.datetime(2023, 1, 1))], "source_id string, status string, started_at timestamp").withColumns({"finished_at": F.lit(None).cast("timestamp"), "error_message": F.lit(None).cast("string")})
    assert sorted((r.status, r.reaped) for r in ingest.reap(runs, now).collect()) == [("FAILED", True), ("RUNNING", False), ("SUCCESS", False)]
    assert not ingest.may_open_run(runs, "a") and ingest.may_open_run(runs, "b")


def test_stream_is_idempotent(spark, tmp_path):
    inbox, raw = tmp_path / "in", str(tmp_path / "raw")
    inbox.mkdir()

    def drop(name, rows):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("source_id", "external_id", "url", "payload", "fetched_at"), r, strict=True))) for r in rows))

    def run():
        incremental.ingest_stream(spark, str(inbox), raw, str(tmp_path / "ck"), ("seen",)).awaitTermination()
        return incremental.raw_layer(spark, raw).read().count()

    t = "2024-01-01T00:00:00Z"
    drop("a.json", [("s", "1", "https://x", '{"a": 1, "seen": 1}', t), ("s", "1", "https://x", '{"seen": 2, "a": 1}', t), ("s", "", "https://x", "{}", t)])
    assert run() == 1 and run() == 1
    drop("b.json", [("s", "1", "https://x", '{"a": 1, "seen": 9}', t), ("s", "1", "https://x", '{"a": 2}', t)])
    assert run() == 2


def test_source_contract():
    d = paginated.Descriptor("board", "Board", "PUBLIC_API", "https://x.org/terms", "public board", page_size=2, max_pages=3)
    jobs = [{"id": str(i), "url": f"https://x/{i}"} for i in range(5)]
    fetch = paginated.board_pages(json.dumps({"jobs": jobs}), 2)
    good = lambda: (d, lambda **k: paginated.walk(fetch, d, **k))
    assert contract.violations(good, 5) == [] and contract.violations(good, 6) == ["too few items"]
    calls = []

    def careless(limit, stop=None):
        calls.append(limit)
        return [paginated.Item("a", "http://x", None), paginated.Item("a", "https://x", {}), paginated.Item(str(len(calls)), "https://x", {})]

    bare = paginated.Descriptor("board", "Board", "PUBLIC_API", "https://x.org/terms")
    assert contract.violations(lambda: (bare, careless), 4) == [
        "descriptor: compliance_note", "not a stream", "too few items", "malformed item", "repeated id", "over the limit", "items at limit 0", "goes on after stop", "not the same again",
    ]


def test_pages_end(spark):
    """An empty page ends a scan though it names a next one; so does stop()."""
    d = paginated.Descriptor("b", "B", "PUBLIC_API", "https://x", page_size=1, max_pages=9)
    item = paginated.Item("a", "https://x", {})
    assert len(list(paginated.walk(lambda c: paginated.SourcePage([] if c == "2" else [item], str(int(c or 0) + 1)), d))) == 2
    asked = []
    assert len(list(paginated.walk(lambda c: paginated.SourcePage([item], str(int(c or 0) + 1)), d, stop=lambda: len(asked) >= 3 or asked.append(1)))) == 1


def test_batch_twice_and_quarantine(spark):
    when = dt.datetime(2024, 1, 1)
    payload = lambda title, company="Aurelia GmbH": json.dumps({"title": title, "company": company})
    rows = [("s", "1", "a", "https://x/1", payload("Dev (m/w/d)"), when), ("s", "2", "b", "https://x/2", payload("DEV", "aurelia"), when), ("t", "1", "c", "https://x/3", payload("Ops"), when), ("t", "2", "d", "https://x/4", "{broken", when), ("t", "3", "e", "https://x/5", payload(" "), when)]
    raw = spark.createDataFrame(rows, "source_id string, external_id string, content_hash string, url string, payload string, fetched_at timestamp_ntz")
    empty = [spark.createDataFrame([], s) for s in (flow.POSTING, flow.JOB)]
    now = F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")
    found = flow.candidates(raw)
    one = flow.resolve_batch(found, *empty, now)
    postings = {(r.source_id, r.external_id): r.job_id for r in one.postings.collect()}
    assert len(postings) == 3 and postings["s", "1"] == postings["s", "2"] != postings["t", "1"]
    assert {r.job_id for r in one.jobs.collect()} == set(postings.values())
    assert {(r.external_id, r.problem) for r in one.quarantine.collect()} == {("2", "title"), ("3", "title")}
    two = flow.resolve_batch(found, one.postings, one.jobs, now)
    assert {(r.source_id, r.external_id): r.job_id for r in two.postings.collect()} == postings and two.jobs.count() == 2


def test_stream_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"source_id": "s", "external_id": "a", "url": "https://x", "payload": "{}"}, {"source_id": "s", "external_id": "", "url": "https://x", "payload": "{}"}, {"source_id": "s", "external_id": "b", "url": "http://x", "payload": "{}"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, lines)))
    q = incremental.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "raw"), str(tmp_path / "cp"), quarantine=str(tmp_path / "bad"))
    q.awaitTermination()
    assert incremental.raw_layer(spark, str(tmp_path / "raw")).read().count() == 1
    assert {(r.external_id, r.problem) for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {("", "id"), ("b", "url")}


def test_results_are_kept_and_one_is_current(spark):
    calls = []

    class Other:
        version = "other-1"

        def classify(self, due):
            calls.append(sorted(r.job_id for r in due.collect()))
            none = F.array().cast("array<struct<code:string,weight:int,evidence:string>>")
            return due.select("job_id", F.lit("AMBIGUOUS").alias("level"), F.lit(50).alias("score"), F.lit(None).cast("int").alias("min_years"), F.lit(None).cast("int").alias("max_years"), none.alias("positive"), none.alias("negative"))

    at = lambda d: F.lit(dt.datetime(2024, 1, d)).cast("timestamp_ntz")
    jobs = spark.createDataFrame([("a", "Junior cook", "Entry level. You lead a team.", None), ("b", "Senior cook", "at least 5 years", None), ("c", None, None, "old")], "job_id string, title string, description string, junior_level string")
    history = spark.createDataFrame([], classifiers.RESULT)
    history, judged = classifiers.classify_due(jobs, history, classifiers.RuleClassifier(), at(1))
    got = {r.job_id: (r.junior_level, r.required_min_years, r.classified_at) for r in judged.collect()}
    assert got == {"a": ("LIKELY_ENTRY_LEVEL", None, dt.datetime(2024, 1, 1)), "b": ("EXPERIENCED", 5, dt.datetime(2024, 1, 1)), "c": ("AMBIGUOUS", None, dt.datetime(2024, 1, 1))}
    assert {s.evidence for r in history.collect() for s in r.positive + r.negative} == {"Entry level", "lead a team"}
    changed = judged.withColumn("description", F.when(F.col("job_id") == "b", "2+ years").otherwise(F.col("description")))
    history, judged = classifiers.classify_due(changed, history, classifiers.RuleClassifier(), at(2))
    assert {r.job_id: r.classified_at.day for r in judged.collect()} == {"a": 1, "b": 2, "c": 1} and history.count() == 4
    history, judged = classifiers.classify_due(changed, history, Other(), at(3))
    assert calls == [["a", "b", "c"]] and {r.junior_level for r in judged.collect()} == {"AMBIGUOUS"}
    assert history.count() == 7 and history.filter("is_current").count() == 3
    empty, none = classifiers.classify_due(changed.limit(0), history.limit(0), Other(), at(3))
    assert empty.count() == none.count() == 0
