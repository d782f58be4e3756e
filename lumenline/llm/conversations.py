"""Conversation structure repair: the cheapest edits that make a conversation well formed, by A* on the edit lattice.

A well-formed conversation is empty, or one system row at most and then pairs of a user's and an assistant's row; rows are
told by the first character of their role.  A row is kept (free), given the role that is due (1), or deleted (2); an empty row
of the role that is due is inserted (5).  Blank rows and rows seen before have to go; a truncated row that stays costs 5.

A node of the lattice is the number of rows done and the state of the grammar.  What the rest costs at least is the sum of its
mandatory deletions and, for each truncated row, the lesser of its charge and its deletion.  Nodes are taken by cost and that
bound, then by the edits so far as ASCII, so the first end reached is the cheapest and of those the least.

Edits of a long conversation are kept short: the lattice is walked in pieces of ``PIECE`` rows.  At the end of a piece every
state has its best edits; they end with a row's own edit, so none of them begins another and their order is that of all
that follows, and a rank stands for them from there on.  Time and memory are in proportion to the rows.

Rows meet by conversation in one shuffle and stream through tasks in order; a task holds one conversation at a time.  It has
to, as its result is one row that holds the whole repaired conversation.

Defined cases: null roles and texts are one space, and a null conversation id is one conversation; rows of one turn are
ordered by role and text, null turns come first; conversations without rows that take part have zeros, empty edits and no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenline.llm.common import sql_crc32

#: What an edit costs: keep, rerole, delete, insert; and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a piece of the lattice.
PIECE = 256
#: Conversations in a batch that leaves a task.
OUT_ROWS = 256
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: States of the grammar: nothing yet, after the system row, after a user's, after an assistant's; what may follow each.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that an inserted row or one of a wrong role gets, and the state after it.
DUE = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}

OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"

Row = tuple[str, bool, bool]  # the role's initial, has to go, truncated


def _walk(rows: Sequence[Row], begin: int, end: int, last: bool, rest: list[int], entries: dict[int, tuple[int, int]]):
    """Yields (state, cost, rank of its entry, entry, edits) of the ends of a piece in the order of A*, each state once.

    ``entries`` has the cost and rank of each state at ``begin``; ``rest`` the bound from each row on.
    """
    heap = [(g + rest[begin], rank, "", begin, state, state, g) for state, (g, rank) in entries.items()]
    heapq.heapify(heap)
    done = set()
    while heap:
        _, rank, edits, i, state, entry, g = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == end and (not last or state in ENDS):
            yield state, g, rank, entry, edits
        follow: list[tuple[str, int, int, int]] = []
        if i < end or last:
            follow.append(("I", i, DUE[state][1], INSERT))
        if i < end:
            initial, must, truncated = rows[i]
            follow.append(("D", i + 1, state, DELETE))
            if not must:
                charge = TRUNCATED * truncated
                if initial in FOLLOWS[state]:
                    follow.append(("K", i + 1, FOLLOWS[state][initial], charge))
                follow.append(("R", i + 1, DUE[state][1], REROLE + charge))
        for edit, j, to, cost in follow:
            if (j, to) not in done:
                heapq.heappush(heap, (g + cost + rest[j], rank, edits + edit, j, to, entry, g + cost))


def cheapest(rows: Sequence[Row]) -> tuple[int, str]:
    """The least cost and, of the edits that have it, the least as ASCII."""
    rest = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        _, must, truncated = rows[i]
        rest[i] = rest[i + 1] + (DELETE if must else min(DELETE, TRUNCATED) if truncated else 0)
    entries, trail = {START: (0, 0)}, []
    begin = 0
    while len(rows) - begin > PIECE:
        ends = {state: (rank, edits, entry, g) for state, g, rank, entry, edits in _walk(rows, begin, begin + PIECE, False, rest, entries)}
        ranked = sorted(ends, key=lambda s: ends[s][:2])
        entries = {s: (ends[s][3], ranked.index(s)) for s in ranked}
        trail.append({s: (edits, entry) for s, (_, edits, entry, _) in ends.items()})
        begin += PIECE
    _, cost, _, state, edits = next(_walk(rows, begin, len(rows), True, rest, entries))
    parts = [edits]
    for step in reversed(trail):
        edits, state = step[state]
        parts.append(edits)
    return cost, "".join(reversed(parts))


def repaired(rows: Sequence[tuple[str, str]], audit: str) -> list[dict[str, str]]:
    """The rows (role, text) after the edits."""
    out, state, left = [], START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "K":
            state = FOLLOWS[state][role[0]]
        else:
            role, state = DUE[state]
        out.append({"role": role, "text": text})
    return out


def examined(turns: Sequence[int | None], rows: Sequence[tuple[str, str]]) -> dict:
    """Faults and repair of one conversation's rows (role, text) in order."""
    seen: set[tuple[str, str]] = set()
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    judged: list[Row] = []
    for row in rows:
        body = row[1].rstrip(SPACE)
        fault = "blank" if not body else "duplicate" if row in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add(row)
        if fault:
            counts[fault] += 1
        judged.append((row[0][:1], fault in ("blank", "duplicate"), fault == "truncated"))
    known = {t for t in turns if t is not None}
    cost, audit = cheapest(judged)
    return counts | {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "illegal": sum(a[0] + b[0] not in LEGAL for a, b in zip(judged, judged[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired": repaired(rows, audit),
    }


def repair(rows: DataFrame, conversation: str, turn: str, role: str, text: str, taking: Column | None = None) -> DataFrame:
    """One row a conversation: its id and ``OUT``.  Rows for which ``taking`` is not true only name their conversation."""
    kind = rows.schema[conversation].dataType
    taken = F.lit(True) if taking is None else F.coalesce(taking, F.lit(False))
    named = rows.select(
        F.col(conversation).alias("c"), taken.alias("taken"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    ordered = named.repartition("c").sortWithinPartitions("c", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shape = [], None

        def batch() -> pa.RecordBatch:
            columns = [pa.array([x[name] for _, x in held], kind) for name, kind in TYPES.items()]
            return pa.RecordBatch.from_arrays([pa.array([key for key, _ in held], shape), *columns], names=[conversation, *TYPES])

        def stream():
            nonlocal shape
            for b in batches:
                shape = b.schema.field("c").type
                yield from zip(*(b.column(c).to_pylist() for c in ("c", "taken", "turn", "role", "text")), strict=True)

        for key, own in groupby(stream(), key=lambda r: r[0]):
            kept = [r for r in own if r[1]]
            held.append((key, examined([r[2] for r in kept], [r[3:] for r in kept])))
            if len(held) == OUT_ROWS:
                yield batch()
                held = []
        if held:
            yield batch()

    return ordered.mapInArrow(run, f"`{conversation}` {kind.simpleString()}, {OUT}")


#: Arrow types of ``OUT``.
TYPES = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()) | {
    "audit": pa.string(),
    "repaired": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])),
}


def damaged(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """``rows`` with faults that a hash of the conversation and turn picks: ``dropped`` rows, empty, cut or repeated ones, a role."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conversation, turn)))
    pick = F.crc32(F.encode(name, "UTF-8")) % 20
    known_role, known = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        conversation, turn,
        F.when(pick == 4, F.lit("user")).otherwise(known_role).alias(role),
        F.when(pick == 1, F.lit("")).when(pick == 2, F.regexp_replace(known, "[.!?]", "")).otherwise(known).alias(text),
        (pick == 0).alias("dropped"),
        F.explode(F.when(pick == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for :func:`repair` of the damaged ``conversations``: the whole lattice, row by row."""
    steps = [
        (state, "I" * k, to, INSERT * k, "".join(f"\n{r}:" for r in roles))
        for state in range(4)
        for k, to, roles in [(0, state, []), (1, DUE[state][1], [DUE[state][0]]), (2, DUE[DUE[state][1]][1], [DUE[state][0], DUE[DUE[state][1]][0]])]
    ]
    text = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    inserts = ", ".join(f"({s}, '{edits}', {to}, {cost}, {text(lines)})" for s, edits, to, cost, lines in steps)
    keeps = ", ".join(f"({s}, '{initial}', {to})" for s in range(4) for initial, to in FOLLOWS[s].items())
    dues = ", ".join(f"({s}, '{role}', {to})" for s, (role, to) in enumerate(DUE))
    return f"""
WITH RECURSIVE inserts(s, edits, t, cost, lines) AS (VALUES {inserts}),
keeps(s, initial, t) AS (VALUES {keeps}),
dues(s, role, t) AS (VALUES {dues}),
picked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {sql_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS pick FROM conversations),
live AS (
  SELECT conv_id, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN pick = 1 THEN '' WHEN pick = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN pick = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM picked WHERE pick <> 0),
placed AS (
  SELECT *, row_number() OVER w AS pos, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body
  FROM live WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
edits AS (
  SELECT conv_id, pos, s, 'D' AS edit, s AS t, {DELETE} AS cost, '' AS lines FROM judged, (SELECT unnest(range(4)) AS s)
  UNION ALL
  SELECT conv_id, pos, s, 'K', t, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END, chr(10) || role || ':' || text
  FROM judged JOIN keeps ON initial = left(role, 1) WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, pos, s, 'R', t, {REROLE} + CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END, chr(10) || d.role || ':' || text
  FROM judged j, dues d WHERE fault IN ('', 'truncated')),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0::BIGINT AS s, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS best FROM judged
  UNION ALL
  SELECT w.conv_id, w.pos + 1, e.t::BIGINT, min({{'cost': (w.best.cost + i.cost + e.cost)::BIGINT, 'audit': w.best.audit || i.edits || e.edit, 'lines': w.best.lines || i.lines || e.lines}})
  FROM walk w JOIN inserts i ON i.s = w.s JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.pos = w.pos + 1 AND e.s = i.t
  GROUP BY w.conv_id, w.pos, e.t),
ended AS (
  SELECT conv_id, min({{'cost': best.cost + i.cost, 'audit': best.audit || i.edits, 'lines': best.lines || i.lines}}) AS best
  FROM walk w JOIN inserts i USING (s) WHERE i.t IN {ENDS} AND pos = (SELECT max(pos) FROM judged j WHERE j.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
