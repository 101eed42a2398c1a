"""Repairs of conversations against a search over all edits, and the query against its SQL."""

import glob
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import conversation_repair as cr

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("plan", T.StringType()), T.StructField("said", T.StringType())])
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows):
    """(cost, audit, repaired) of the cheapest edits, by growing cost and then audit, without any states but the roles so far."""
    found = faults(rows)
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, audit, at, made = heapq.heappop(heap)
        roles = "".join(r[:1] or "?" for r, _ in made)
        if at == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit, made
        if (at, roles) in done:
            continue
        done.add((at, roles))
        for role in ("user", "assistant"):
            if len(made) <= 2 * len(rows) + 2:
                heapq.heappush(heap, (cost + 2, audit + "I", at, (*made, (role, ""))))
        if at < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, made))
            if found[at] not in ("blank", "duplicate"):
                more = found[at] == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*made, rows[at])))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 2, audit + "R", at + 1, (*made, (role, rows[at][1]))))


def expected(rows):
    """(gaps, ..., repaired digest) of (turn, role, text) rows in order."""
    said = [(r, t) for _, r, t in rows]
    cost, audit, made = searched(said)
    n = Counter(faults(said))
    initials = [r[:1] for r, _ in said]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def test_signatures_are_solved_at_least_cost():
    rng = random.Random(7)
    signatures = {"".join(rng.choice("xsuaoSUAO" if rng.random() < 0.5 else "ua") for _ in range(rng.randrange(7))) for _ in range(700)} | {""}
    solved = {s: (c, a) for s, c, a in cr.solve(sorted(s[::-1] for s in signatures))}
    assert set(solved) == signatures
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for s, got in solved.items():
        rows = [("user", " ") if c == "x" else (names[c.lower()], f"t{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(s)]
        assert searched(rows)[:2] == got, s


def test_endings_are_shared():
    """Nodes do not grow with the number or length of conversations, and a step is computed once for all of them."""
    calls = []
    real = cr.step
    try:
        cr.step = lambda *a: calls.append(a) or real(*a)
        rng = random.Random(1)
        many = sorted("".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(400))) for _ in range(500))
        assert len(list(cr.solve(iter(many)))) == 500
    finally:
        cr.step = real
    assert len(calls) == len(set(calls)) < 300


def odd_rows(rng):
    rows = []
    for c in [None, *range(60)]:
        for k in range(rng.choice([1, 1, 2, 3, 4, 5])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = rng.choice(["Yes.", "No!  \n", "what", "", None, " \t", "é 你。", "Done?"])
            rows.append((c, rng.choice([k, k, None, k + 3, -2]), role, text, "old", "old"))
    return rows + rows[:5]


def ordered(rows):
    """Conversations to their rows (turn, role, text) in the stated order."""
    out: dict = {}
    for c, turn, role, text, *_ in rows:
        out.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    for rows_ in out.values():
        rows_.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    return out


def test_repairs_of_odd_conversations(spark):
    rows = odd_rows(random.Random(2))
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumns({c: F.lit("old") for c in ("conv", "cost", "edit", "position")})
    got = {r.conv_id: tuple(r)[1:] for r in cr.digest(cr.repair(df)).collect()}
    assert got == {c: expected(r) for c, r in ordered(rows).items()}
    assert cr.digest(cr.repair(df.limit(0))).count() == 0
    told = cr.repair(df).collect()
    assert all(r.edit in "KRI" and r.cost is None for r in told if r.position >= 0)
    for c in ordered(rows):
        mine = [r for r in told if r.conv_id == c]
        assert [r.position for r in mine] == list(range(-1, len(mine) - 1))
        assert GRAMMAR.fullmatch("".join(r.role[:1] or "?" for r in mine[1:]))


def test_long_conversations(spark):
    """Thousands of turns, and texts of over a megabyte, in one conversation."""
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"text {k}" + rng.choice([".", ""]), "", "") for k in range(6000)]
    rows += [(2, 0, "user", "x" * 1_500_000 + ".", "", ""), (2, 1, "assistant", "y" * 1_500_000, "", "")]
    got = {r.conv_id: r for r in cr.digest(cr.repair(spark.createDataFrame(rows, TURNS).repartition(4))).collect()}
    letters = "".join(("u" if r[2] == "user" else "a") if r[3].endswith(".") else ("U" if r[2] == "user" else "A") for r in rows[:6000])
    ((_, cost, audit),) = cr.solve([letters[::-1]])
    assert (got[1].cost, got[1].audit, got[1].truncated) == (cost, audit, sum(c.isupper() for c in letters))
    assert (got[2].cost, got[2].audit) == (1, "KK")


def damaged(rows):
    """The contract's damage in plain Python, to conversations in order; all conversations stay known."""
    out = []
    for c, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: [] for c, *_ in rows} | ordered(out)


def test_query_matches_sql_and_search(spark, sf, tmp_path):
    def same(folder):
        got = cr.query(spark, folder)
        con = duckdb.connect()
        files = glob.glob(f"{folder}/conversations.parquet/*.parquet") or [f"{folder}/conversations.parquet"]
        con.sql(f"create view conversations as select * from read_parquet({files})")
        want = con.sql(f"select {', '.join(got.columns)} from ({cr.ORACLE_SQL})").fetchall()
        rows = got.collect()
        assert Counter(map(tuple, rows)) == Counter(want)
        return {r.conv_id: tuple(r)[1:] for r in rows}

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert same(sf) == {c: expected(r) for c, r in damaged(rows).items()}
    rows = odd_rows(random.Random(5))
    spark.createDataFrame(rows, TURNS).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    assert same(str(tmp_path)) == {c: expected(r) for c, r in damaged(rows).items()}
