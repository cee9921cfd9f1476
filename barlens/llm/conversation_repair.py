r"""Conversation structure repair by generalised LR parsing.

The roles of a conversation must read `(s?(ua)+)?`: an optional system turn, then user and
assistant in turn, or nothing. As a grammar

    Dialog -> (empty) | Turns | s Turns        Turns -> u a | Turns u a

its LR automaton has eight states (`SHIFT`, `GOTO`, `REDUCE`). A turn can be kept as its
role's initial, given the role user or assistant, or deleted, and a user or assistant turn
can be inserted anywhere, each for a price; a turn found blank or repeated must go. So a
turn offers several terminals, and the parser follows all stacks at once in a
graph-structured stack. Tops of equal state are merged: of all ways to the same top
the least (cost, audit) stays, where the audit is the actions' initials. That loses
nothing, since the terminals a top accepts from then on don't depend on what lies below it
(states 3 and 5 are reached on different stacks, but those accept the same rest).

Two things make a turn cheap. Costs relative to the least one, the order of the audits, and
the kind of turn decide the step, so steps are kept in a table (`Parser.step`). Comparing
audits never reads them: before a turn's own initial no audit is a prefix of
another, so their order plus the new initials orders the longer ones. A top holds its
audit in linked parts and a running digest of the repaired text, so a conversation is
streamed, whatever its length, and memory grows by its audit alone.

Turns are shuffled once, by conversation. Repeats are found by a window within that
partitioning (spilling to disk if it must), then each task streams its sorted turns. A
conversation's digest is one sequence over its text, so its turns do pass one task, one
batch at a time.

Defined results: null role and text are one space, and null numbers in a damage key too; a
null turn comes first and counts for no gap; turns of equal number go by role, then text;
rows without conv_id are one conversation with a null id; repeated rows are repeated turns; a
conversation without turns left has zeros, an empty audit and the digest of the empty text;
an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.llm.common import table

# The automaton of the grammar above: terminals shifted, symbols a full rule takes off, the state after Turns.
SHIFT = {0: {"s": 1, "u": 3}, 1: {"u": 3}, 2: {"u": 5}, 3: {"a": 6}, 4: {"u": 5}, 5: {"a": 7}}
REDUCE = {6: 2, 7: 3}
GOTO = {0: 2, 1: 4}
ACCEPT = {0, 2, 4}
# Prices.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
# From any top, ten buys what another top of the same turn has over it: two inserted turns and a deleted one.
SLACK = 2 * INSERT + DELETE

BLANK = r"[\x20\x09-\x0D]"
SPACE = " \t\n\v\f\r"


def pushed(stack: tuple[int, ...], terminal: str) -> tuple[int, ...] | None:
    """The stack after a terminal, full rules reduced; None where it is refused."""
    to = SHIFT[stack[-1]].get(terminal)
    if to is None:
        return None
    stack += (to,)
    while stack[-1] in REDUCE:
        stack = stack[:-REDUCE[stack[-1]]]
        stack += (GOTO[stack[-1]],)
    return stack


def inserted(stack: tuple[int, ...]) -> list[tuple[tuple[int, ...], str]]:
    """Stacks after none, one or two inserted terminals; more are never cheapest."""
    out, last = [(stack, "")], [(stack, "")]
    for _ in range(2):
        last = [(to, more + t) for at, more in last for t in ROLES if (to := pushed(at, t))]
        out += last
    return out


class Parser:
    """Steps of the graph-structured stack's frontier, each worked out once.

    A frontier is a tuple of (stack, cost above the least), in the order of the audits.
    """

    def __init__(self):
        self.step = lru_cache(maxsize=100_000)(self._step)
        self.finish = lru_cache(maxsize=100_000)(self._finish)

    def _moves(self, stack, initial: str, truncated: bool, must_go: bool):
        """(cost, initials, inserted terminals, action, stack) of one turn from one top."""
        extra = TRUNCATED if truncated else 0
        for at, more in inserted(stack):
            price, letters = INSERT * len(more), "I" * len(more)
            yield price + DELETE, letters + "D", more, None, at
            if must_go:
                continue
            kept = pushed(at, initial)
            if kept:
                yield price + extra, letters + "K", more, "keep", kept
            for terminal, role in ROLES.items():
                to = pushed(at, terminal)
                if to:
                    yield price + REROLE + extra, letters + "R", more, role, to

    def _step(self, frontier, initial: str, truncated: bool, must_go: bool):
        """(cost added to all, ((parent, initials, inserted terminals, action), ...), next frontier)."""
        best: dict[int, tuple] = {}
        for rank, (stack, cost) in enumerate(frontier):
            for price, letters, more, action, to in self._moves(stack, initial, truncated, must_go):
                found = (cost + price, rank, letters, more, action, to)
                if to[-1] not in best or found[:3] < best[to[-1]][:3]:
                    best[to[-1]] = found
        least = min(b[0] for b in best.values())
        tops = sorted((b for b in best.values() if b[0] <= least + SLACK), key=lambda b: b[1:3])
        return least, tuple(b[1:5] for b in tops), tuple((b[5], b[0] - least) for b in tops)

    def _finish(self, frontier):
        """(cost, parent, initials, inserted terminals) of the cheapest end."""
        return min((cost + INSERT * len(more), rank, "I" * len(more), more)
                   for rank, (stack, cost) in enumerate(frontier)
                   for at, more in inserted(stack) if at[-1] in ACCEPT)


class Repair:
    """One conversation's turns, taken one after the other."""

    PART = 512

    def __init__(self, parser: Parser):
        self.parser = parser
        self.frontier = (((0,), 0),)
        # For each top: its audit (earlier parts linked, last part) and the digest of its repaired text so far.
        self.tops = [(None, "", hashlib.sha256())]
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.turn = None
        self.turns = 0
        self.before = None

    def _grown(self, top, letters: str, lines: list[bytes], started: bool):
        link, part, digest = top
        digest = digest.copy()
        for line in lines:
            digest.update(b"\n" + line if started else line)
            started = True
        part += letters
        return ((link, part), "", digest) if len(part) >= self.PART else (link, part, digest)

    def take(self, turn, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.turn = turn
            self.turns += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        rest = text.rstrip(SPACE)
        blank, cut = not rest, rest[-1:] not in (".", "!", "?")
        truncated = not blank and not repeated and cut
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += truncated
        cost, made, after = self.parser.step(self.frontier, initial if initial in ("s", "u", "a") else "",
                                             truncated, blank or repeated)
        self.cost += cost
        body = b":" + text.encode()
        line = {None: [], "keep": [role.encode() + body], **{r: [r.encode() + body] for r in ROLES.values()}}
        self.tops = [self._grown(self.tops[parent], letters, [f"{ROLES[t]}:".encode() for t in more] + line[action],
                                 self.frontier[parent][0] != (0,)) for parent, letters, more, action in made]
        self.frontier = after

    def result(self) -> tuple:
        cost, parent, letters, more = self.parser.finish(self.frontier)
        link, part, digest = self._grown(self.tops[parent], letters, [f"{ROLES[t]}:".encode() for t in more],
                                         self.frontier[parent][0] != (0,))
        parts = [part]
        while link is not None:
            link, part = link
            parts.append(part)
        gaps = 0 if self.least is None else self.turn - self.least + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost,
                "".join(reversed(parts)), digest.hexdigest())


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _plain(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, lost: Column | None = None) -> DataFrame:
    """The columns needed, named afresh, nulls filled."""
    return turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
                        (F.lit(False) if lost is None else lost).alias("lost"))


def _ordered(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text, lost), each conversation in order in one partition, with repeated."""
    same = Window.partitionBy("conv_id", "role", "text", "lost").orderBy("turn")
    dealt = turns.repartition("conv_id").withColumn("repeated", ~F.col("lost") & (F.row_number().over(same) > 1))
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text", "repeated")


def report(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           lost: Column | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `lost` marks rows that are gone: they only say that their conversation exists.
    """
    plain = _plain(turns, conv_id, turn, role, text, lost)
    schema = T.StructType([plain.schema["conv_id"]] + [T.StructField(c, T.LongType()) for c in COUNTS]
                          + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        parser, key, now, done = Parser(), None, None, []

        def ready():
            made = [list(c) for c in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(made, kinds)], names=schema.names)

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type] + [pa.int64()] * len(COUNTS) + [pa.string()] * 2
            for whose, at, who, said, gone, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or whose != key:
                    if now is not None:
                        done.append((key, *now.result()))
                    key, now = whose, Repair(parser)
                if not gone:
                    now.take(at, who, said, repeated)
            if len(done) >= 1000:
                yield ready()
        if now is not None:
            done.append((key, *now.result()))
            yield ready()

    return _ordered(plain).mapInArrow(run, schema)


def repaired(turns: DataFrame, found: DataFrame | None = None, **names) -> DataFrame:
    """The repaired turns: conv_id, position, action (K, R or I), turn, role, text. `found`: their `report`.

    An audit is cut behind each initial of a turn, so its n-th part is the n-th turn's; the
    output's length fixes whether a system turn opens it, and so every given role.
    """
    found = report(turns, **names) if found is None else found
    parts = found.select("conv_id", F.length(F.replace("audit", F.lit("D"), F.lit(""))).alias("size"),
                         F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]|I+$"), F.lit(0))).alias("nth", "part"))
    before = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    own = F.length(F.replace("part", F.lit("D"), F.lit("")))
    parts = parts.withColumn("first", F.coalesce(F.sum(own).over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    columns = {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text", **names}
    numbered = _plain(turns, *(columns[c] for c in ("conv_id", "turn", "role", "text"))).drop("lost").withColumn("nth", nth)
    both = parts.alias("p").join(numbered.alias("t"), F.col("p.conv_id").eqNullSafe(F.col("t.conv_id"))
                                 & (F.col("p.nth") == F.col("t.nth")), "left")
    letters = F.posexplode(F.split(F.replace("part", F.lit("D"), F.lit("")), "", -1)).alias("k", "action")
    rows = both.select("p.conv_id", "size", "first", "turn", "role", "text", letters).where("action <> ''")
    place = F.col("first") + F.col("k")
    given = F.when((place - F.col("size")) % 2 == 0, "user").otherwise("assistant")
    is_new = F.col("action") == "I"
    return rows.select("conv_id", place.cast("bigint").alias("position"), "action", F.when(~is_new, F.col("turn")).alias("turn"),
                       F.when(F.col("action") == "K", F.col("role")).otherwise(given).alias("role"),
                       F.when(is_new, F.lit("")).otherwise(F.col("text")).alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with planted faults, by a checksum of `conv_id:turn`; lost marks dropped rows."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(written[0], F.lit(":"), written[1]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(
        F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("fault") == 0).alias("lost"), F.explode(copies)).drop("col")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return report(damaged(turns), lost=F.col("lost"))


OP12_SQL = r"""
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
faults AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(
               string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
             lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 20 AS fault
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faults, range(2) r(k) WHERE fault <> 0 AND (k = 0 OR fault = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
turns AS (
  SELECT *, left(role, 1) AS c, blank OR again AS must_go, NOT blank AND NOT again AND cut AS truncated,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         sum(blank::INT) AS blank, sum((again AND NOT blank)::INT) AS duplicate, sum(truncated::INT) AS truncated,
         sum((pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal
  FROM turns GROUP BY conv_id),
-- Places in the pattern: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a.
filled(f, m, letters, added) AS (
  VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']),
         (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
taken(m, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
actions AS (
  SELECT f, letters || 'K' AS letters, 3 * len(letters) AS cost, added, t, c, NULL AS given FROM filled JOIN taken USING (m)
  UNION ALL
  SELECT f, letters || 'R', 3 * len(letters) + 3, added, t, NULL, CASE c WHEN 'u' THEN 'user' ELSE 'assistant' END
  FROM filled JOIN taken USING (m) WHERE c <> 's'
  UNION ALL
  SELECT f, letters || 'D', 3 * len(letters) + 4, added, m, NULL, NULL FROM filled),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best, 0 AS at
  FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT w.conv_id, w.i + 1,
         min({'cost': w.best.cost + a.cost + CASE WHEN r.truncated AND a.letters NOT LIKE '%D' THEN 3 ELSE 0 END,
              'audit': w.best.audit || a.letters,
              'lines': w.best.lines || a.added || CASE WHEN a.letters LIKE '%D' THEN []::VARCHAR[]
                                                       ELSE [coalesce(a.given, r.role) || ':' || r.text] END}), a.t
  FROM ways w JOIN turns r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
  JOIN actions a ON a.f = w.at AND (a.letters LIKE '%D' OR NOT r.must_go) AND (a.c IS NULL OR a.c = r.c)
  GROUP BY w.conv_id, w.i, a.t),
ends AS (
  SELECT w.conv_id, min({'cost': w.best.cost + 3 * len(f.letters), 'audit': w.best.audit || f.letters, 'lines': w.best.lines || f.added}) AS best
  FROM ways w JOIN filled f ON f.f = w.at AND f.m IN (0, 3)
  WHERE w.i = (SELECT count(*) FROM turns r WHERE r.conv_id IS NOT DISTINCT FROM w.conv_id)
  GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
