"""Repair of the structure of conversations with an automaton shared by their ends.

A conversation's rows are read as a signature of one letter a row: the initial
of its role, a capital if its text is truncated, x if it must go (blank, or said
before). What a repair costs from some row on depends on the rest of the
signature and on the state of the grammar (s?(ua)+)? alone, so signatures are
minimised from the end: those of all conversations are sorted backwards, each
distinct ending is one step, and endings whose costs differ by a constant are
one node of a small automaton. A node and a letter before it give, once for all
conversations and for each state of the grammar, the cost to go and the first
edit of the best audit suffix; the rest of that suffix is the next step's. The
edits of a choice differ in their first letters (D, I, K, R), so that these
decide between audits of equal cost.

Long conversations: rows are put in order by Spark's sort and pass by; a task
holds one letter a row. Texts travel once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, only, table

START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits.
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
#: The state after a user or an assistant row that is put in, from each state.
_PUT = (USER, USER, ASSISTANT, USER)
#: The states from which a row of a role may follow, and the state after it.
_MAY = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs to go and edits at the end: nothing may be missing after nothing or an assistant.
END = (0, 2 * INSERT, INSERT, 0), ("", "I", "I", "")

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
WHITE = " \t\n\x0b\x0c\r"


def step(costs: tuple[int, ...], letter: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs to go and first edits in all states before a row, from the costs after it."""
    own = []
    for state in range(4):
        options = [(DELETE + costs[state], "D")]
        if letter != "x":
            cut = CUT if letter.isupper() else 0
            states, after = _MAY.get(letter.lower(), ((), None))
            if state in states:
                options.append((cut + costs[after], "K"))
            options.append((RENAME + cut + costs[_PUT[state]], "R"))
        own.append(min(options))
    # one insertion before the row, or two; a third can't pay
    both = list(own)
    both[USER] = min(own[USER], (INSERT + own[ASSISTANT][0], "I"))
    both[ASSISTANT] = min(own[ASSISTANT], (INSERT + own[USER][0], "I"))
    for state in (START, SYSTEM):
        both[state] = min(own[state], (INSERT + both[USER][0], "I"))
    return tuple(c for c, _ in both), tuple(e for _, e in both)


class Automaton:
    """Nodes by the costs to go of the rest of a signature, above the least of them; node 0 is the end."""

    def __init__(self):
        self.costs = [END[0]]
        self.known = {END[0]: 0}
        self.steps: dict[tuple[int, str], tuple[int, int, tuple[str, ...]]] = {}

    def before(self, node: int, letter: str) -> tuple[int, int, tuple[str, ...]]:
        """The node of a signature that has one letter more in front, what all costs grow by, and the first edits."""
        found = self.steps.get((node, letter))
        if found is None:
            costs, edits = step(self.costs[node], letter)
            least = min(costs)
            costs = tuple(c - least for c in costs)
            if costs not in self.known:
                self.known[costs] = len(self.costs)
                self.costs.append(costs)
            found = self.steps[(node, letter)] = self.known[costs], least, edits
        return found


def follow(edits: str, state: int, letter: str) -> int:
    """The state after an edit of a row."""
    if edits == "D":
        return state
    return _MAY[letter.lower()][1] if edits == "K" else _PUT[state]


def solve(backward: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) for signatures that are given backward and in order, so that neighbours share their endings."""
    automaton = Automaton()
    nodes, bases, edits, last = [0], [0], [END[1]], ""
    for s in backward:
        shared, most = 0, min(len(s), len(last))
        while shared < most and s[shared] == last[shared]:
            shared += 1
        del nodes[shared + 1 :], bases[shared + 1 :], edits[shared + 1 :]
        for letter in s[shared:]:
            node, more, first = automaton.before(nodes[-1], letter)
            nodes.append(node)
            bases.append(bases[-1] + more)
            edits.append(first)
        last = s
        state, depth, audit = START, len(s), []
        while edit := edits[depth][state]:
            audit.append(edit)
            if edit == "I":
                state = _PUT[state]
            else:
                state = follow(edit, state, s[depth - 1])
                depth -= 1
        yield s[::-1], bases[-1] + automaton.costs[nodes[-1]][START], "".join(audit)


def letters(role: Column, text: Column, seen: Column) -> tuple[Column, Column]:
    """(first fault or '', letter) of a row; seen: role and text occurred before."""
    trimmed = F.rtrim(text, F.lit(WHITE))
    fault = F.when(trimmed == "", "blank").when(seen, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring(role, 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return fault, F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(known)).otherwise(known)


REPORT = [*COUNTS, "signature"]


def _read(schema: T.StructType):
    """Rows (conv, turn, there, initial, fault, letter) in order to a row of REPORT for each conversation."""

    def run(batches):
        conv, begun = None, False
        counts: dict = {}
        signature: list[str] = []
        turns: list = []  # least, last, distinct
        before = ""
        done: list[tuple] = []

        def close():
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            done.append((conv, gaps, *[counts.get(c, 0) for c in COUNTS[1:]], "".join(signature)))

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*done, strict=True), kinds)], names=schema.names)
            done.clear()
            return made

        for batch in batches:
            kinds = [batch.schema.field("conv").type, *[pa.int64()] * len(COUNTS), pa.string()]
            for c, turn, there, initial, fault, letter in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if not begun or c != conv:
                    if begun:
                        close()
                    conv, begun, before = c, True, ""
                    counts, signature, turns = {}, [], []
                if not there:
                    continue
                if turn is not None and not turns:
                    turns = [turn, turn, 1]
                elif turn is not None and turn != turns[1]:
                    turns[1], turns[2] = turn, turns[2] + 1
                counts[fault] = counts.get(fault, 0) + 1
                if signature and before + initial not in ("su", "ua", "au"):
                    counts["illegal"] = counts.get("illegal", 0) + 1
                before = initial
                signature.append(letter)
            if len(done) > 5_000:
                yield out()
        if begun:
            close()
            yield out()

    return run


def _solve(batches):
    only(("repairs",))

    def signatures():
        for batch in batches:
            yield from batch.column(0).to_pylist()

    held, size = [], 0
    for row in solve(signatures()):
        held.append(row)
        size += len(row[0])
        if size > 1 << 20 or len(held) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*held, strict=True)], names=["signature", "cost", "audit"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*held, strict=True)], names=["signature", "cost", "audit"])


def plan_repairs(signatures: DataFrame) -> DataFrame:
    """signature, cost and audit of each distinct signature. Those with a common ending go to one task, next to each other."""
    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    backward = signatures.select(F.reverse("signature").alias("backward")).distinct()
    return backward.repartitionByRange(n, "backward").sortWithinPartitions("backward").mapInArrow(_solve, "signature string, cost long, audit string")


def _apply(schema: T.StructType):
    """Plans, each followed by the rows of its conversation in order, to the plan's row and the repaired rows."""
    values = ["position", "turn", "role", "text", "edit"]

    def run(batches):
        conv, audit, at, place, state = None, "", 0, 0, START
        held: list[tuple] = []
        size = 0

        def put(turn, role, text, edit):
            nonlocal place, size
            held.append((conv, place, turn, role, text, edit, *[None] * (len(COUNTS) + 2)))
            place += 1
            size += len(text) + 50

        def insert():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = _PUT[state]
                put(None, _ROLE[state], "", "I")
                at += 1

        def out():
            nonlocal held, size
            made = pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*held, strict=True), kinds)], names=schema.names)
            held, size = [], 0
            return made

        for batch in batches:
            kinds = [batch.schema.field("conv").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * (len(COUNTS) + 1), pa.string()]
            names = ["conv", "plan", "turn", "role", "text", *COUNTS, "cost", "audit"]
            for c, plan, turn, role, text, *report in zip(*[batch.column(x).to_pylist() for x in names], strict=True):
                if plan:
                    insert()
                    conv, audit, at, place, state = c, report[-1], 0, 0, START
                    held.append((conv, -1, *[None] * (len(values) - 1), *report))
                    size += len(audit) + 50
                    continue
                insert()
                edit = audit[at]
                at += 1
                if edit != "D":
                    role = role if edit == "K" else _ROLE[_PUT[state]]
                    state = follow(edit, state, role[:1])
                    put(turn, role, text, edit)
                if size > 1 << 20:
                    yield out()
        insert()
        if held:
            yield out()

    return run


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there_col: str | None = None) -> DataFrame:
    """The repaired rows of conversations, in order within each partition, each conversation after a row that tells of it.

    Columns: conv_id, position, turn, role, text and edit (K kept, R another
    role, I put in) of repaired rows; at position -1 instead gaps, blank,
    duplicate, truncated, illegal, cost and audit of the conversation.

    Rows are ordered by turn (an integer, null first), then role and a digest
    of role and text. Null roles and texts count as one space. A null conv_id is a
    conversation of its own. Empty and unknown roles are kept nowhere. Rows that
    repeat are duplicates. Rows whose there_col is false only make their
    conversation known; one without other rows has an empty audit. Other
    columns are ignored; an empty table gives an empty table.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    there = F.coalesce(F.col(f"`{there_col}`"), F.lit(False)) if there_col else F.lit(True)
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"), there.alias("there"))
    rows = rows.withColumn("said", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # only letters and digests travel here
    trimmed, initial = F.rtrim(F.col("text"), F.lit(WHITE)), F.substring("role", 1, 1)
    told = rows.select("conv", "turn", "there", "role", "said", initial.alias("initial"), trimmed.eqNullSafe("").alias("blank"), F.right(trimmed, F.lit(1)).alias("end"))
    nth = F.expr("row_number() OVER (PARTITION BY conv, there, said ORDER BY turn)")
    fault, letter = letters(F.col("role"), F.when(F.col("blank"), "").otherwise(F.col("end")), F.col("nth") > 1)
    ordered = told.repartition(n, "conv").withColumn("nth", nth).withColumn("fault", fault).withColumn("letter", letter).sortWithinPartitions("conv", "turn", "role", "said")
    report = T.StructType([rows.schema["conv"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("signature", T.StringType())])
    reports = materialize(ordered.select("conv", "turn", "there", "initial", "fault", "letter").mapInArrow(_read(report), report), "conversations")

    planned = reports.join(plan_repairs(reports), "signature").drop("signature")
    kind = {**{c: "long" for c in (*COUNTS, "cost")}, "audit": "string"}
    both = rows.filter("there").drop("there").withColumn("plan", F.lit(False)).withColumns({c: F.lit(None).cast(k) for c, k in kind.items()})
    both = both.unionByName(planned.withColumn("plan", F.lit(True)), allowMissingColumns=True)
    schema = T.StructType(
        [T.StructField("conv_id", rows.schema["conv"].dataType), *[T.StructField(c, T.LongType()) for c in ("position", "turn")], *[T.StructField(c, T.StringType()) for c in ("role", "text", "edit")]]
        + [T.StructField(c, T.LongType()) for c in (*COUNTS, "cost")]
        + [T.StructField("audit", T.StringType())]
    )
    return both.repartition(n, "conv").sortWithinPartitions("conv", F.desc("plan"), "turn", "role", "said").drop("said").mapInArrow(_apply(schema), schema)


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation of repair(): its report, and the digest of `role:text` of the repaired rows. No shuffle."""
    kept = ["conv_id", *COUNTS, "cost", "audit"]
    schema = T.StructType([*[repaired.schema[c] for c in kept], T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        report, state, first = None, None, True
        for batch in batches:
            done = []
            kinds = [batch.schema.field(c).type for c in kept] + [pa.string()]
            for position, role, text, *own in zip(*[batch.column(c).to_pylist() for c in ("position", "role", "text", *kept)], strict=True):
                if position < 0:
                    if report is not None:
                        done.append((*report, state.hexdigest()))
                    report, state, first = own, hashlib.sha256(), True
                else:
                    state.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                    first = False
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*done, strict=True), kinds)], names=schema.names)
        if report is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip((*report, state.hexdigest()), kinds)], names=schema.names)

    return repaired.mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, with a column `there` that is false for dropped rows."""
    full = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = full.withColumn("kind", (F.crc32(key.cast("binary")) % 20).cast("int"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return kind.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), copies.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(repair(damaged(table(spark, sf_dir, "conversations")), there_col="there"))


#: Each row's crc32, by the table of its polynomial (reflected: 0xEDB88320).
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _options(state: int) -> str:
    """The cheapest edit of a row in a state, by whole audits, as a struct (c, a)."""
    delete = f"{{'c': c{state} + {DELETE}, 'a': 'D' || a{state}}}"
    put = _PUT[state]
    keep = "".join(f" WHEN letter = '{k}' THEN {{'c': c{after} + cut, 'a': 'K' || a{after}}}" for k, (states, after) in _MAY.items() if state in states)
    rename = f"{{'c': c{put} + {RENAME} + cut, 'a': 'R' || a{put}}}"
    return f"list_min(CASE WHEN gone THEN [{delete}] WHEN letter IN ({', '.join(repr(k) for k, (states, _) in _MAY.items() if state in states)}) THEN [{delete}, {rename}, CASE{keep} END] ELSE [{delete}, {rename}] END)"


_PUT_IN = "{{'c': {x}.c + 2, 'a': 'I' || {x}.a}}"
ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS crc
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS k FROM damaged
), seen AS (
  SELECT *, rtrim(text, {_WHITE}) AS body, substring(role, 1, 1) AS letter, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
         lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS prev FROM placed
), told AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
), reports AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || letter NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM told GROUP BY conv_id
), back AS (
  SELECT conv_id, n AS k, 0 AS c0, '' AS a0, 4 AS c1, 'II' AS a1, 2 AS c2, 'I' AS a2, 0 AS c3, '' AS a3 FROM reports
  UNION ALL
  SELECT conv_id, k, b0.c, b0.a, b1.c, b1.a, b2.c, b2.a, b3.c, b3.a FROM (
    SELECT conv_id, k, list_min([o0, {_PUT_IN.format(x='b2')}]) AS b0, list_min([o1, {_PUT_IN.format(x='b2')}]) AS b1, b2, b3 FROM (
      SELECT *, list_min([o2, {_PUT_IN.format(x='o3')}]) AS b2, list_min([o3, {_PUT_IN.format(x='o2')}]) AS b3 FROM (
        SELECT conv_id, b.k - 1 AS k, {', '.join(f'{_options(s)} AS o{s}' for s in range(4))}
        FROM (SELECT back.*, t.letter, t.fault IN ('blank', 'duplicate') AS gone, CASE WHEN t.fault = 'truncated' THEN {CUT} ELSE 0 END AS cut
              FROM back JOIN told t ON back.conv_id IS NOT DISTINCT FROM t.conv_id AND back.k = t.k) AS b
      )
    )
  )
), best AS (
  SELECT conv_id, c0 AS cost, a0 AS audit FROM back WHERE k = 0
), edits AS (
  SELECT conv_id, e, edit, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER w AS k, sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER w AS place
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(len(audit))) AS e FROM best WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY e ROWS UNBOUNDED PRECEDING)
), applied AS (
  SELECT x.conv_id, x.e, x.edit, x.place, t.role, CASE WHEN x.edit = 'I' THEN '' ELSE t.text END AS text,
         max(CASE WHEN x.place = 1 AND x.edit = 'K' AND t.letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS led
  FROM edits x LEFT JOIN told t ON x.conv_id IS NOT DISTINCT FROM t.conv_id AND x.k = t.k WHERE x.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY e) AS text FROM applied GROUP BY conv_id
)
SELECT ids.conv_id, {', '.join(f'CAST(coalesce(r.{c}, 0) AS BIGINT) AS {c}' for c in COUNTS)}, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(p.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN reports r ON ids.conv_id IS NOT DISTINCT FROM r.conv_id
LEFT JOIN best b ON ids.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN repaired p ON ids.conv_id IS NOT DISTINCT FROM p.conv_id
"""
