"""Repair of conversations by Wagner-Fischer alignment to the grammar of turns.

A sound conversation reads ``(s?(ua)+)?`` in the initials of its roles. The rows of one
conversation, in order of turn, are aligned to every target string of that grammar whose
length can still win. A cell of the table is worked out only inside Ukkonen's band: the
cost of the best alignment so far, less what the rows' own faults cost anyway, bounds how
far a path may leave the diagonal. Of equally cheap alignments the backtraced audit
(initials of the edits) that is least in ASCII wins.

The rows of a conversation meet by a shuffle on its id. Conversations of more than
``Settings.long_rows`` rows never come together before their edits are known: they are cut
into segments in order of turn, each becomes a min-plus matrix over the four states of the
grammar's automaton, the matrices give the cost that is left at each cut, and every segment
is then walked by itself. Both ways give the same edits. ``report`` streams the edits of
a conversation through one hash, as a digest of its whole text asks for; it keeps no rows.

Defined results: a NULL role or text counts as one space. A NULL id is an id of its own;
rows without a turn come first. Rows of equal turn follow each other by role, then text,
byte by byte. A role other than user, assistant and system is told by its initial, so it
can be kept only if that is one of theirs. Repeated rows are duplicates. Extra columns
are ignored. An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import durable, stored, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 40
NAMES = {"s": "system", "u": "user", "a": "assistant"}

#: the grammar's automaton: nothing yet, after s, after u, after a
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
ACCEPTED = (0, 3)


@dataclass(frozen=True)
class Settings:
    long_rows: int = 100
    segments: int = 200


# ---------------------------------------------------------------- alignment of one conversation

def targets(n: int, system: bool) -> Iterator[str]:
    """The strings of the grammar, those of length about ``n`` first."""
    lengths = sorted(range(0, 2 * n + 4), key=lambda m: (abs(m - n), m))
    for m in lengths:
        if m % 2 == 0:
            yield "ua" * (m // 2)
        elif system and m > 1:
            yield "s" + "ua" * (m // 2)


def banded(symbols: str, target: str, kept: list[int], slack: int) -> tuple[int, str] | None:
    """The cheapest alignment of the rows to one target and its least audit, if its cost
    beyond the unavoidable is at most ``2 * slack``. ``kept[i]`` counts the rows before
    ``i`` that need not go; a path through (i, j) needs an edit for each step that j is
    away from it, and for each step that is left at the end."""
    n, m = len(symbols), len(target)
    lean = m - kept[n]
    if abs(lean) > slack:
        return None
    low, high = -((slack - lean) // 2), (slack + lean) // 2
    rest: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here, below = rest[i], rest[i + 1] if i < n else {}
        symbol = symbols[i] if i < n else ""
        for j in range(min(m, kept[i] + high), max(0, kept[i] + low) - 1, -1):
            best = 0 if i == n and j == m else FAR
            if i < n:
                best = min(best, below.get(j, FAR) + DELETE)
                if j < m and symbol != "d":
                    best = min(best, below.get(j + 1, FAR) + match(symbol, target[j]))
            if j < m and target[j] != "s":
                best = min(best, here.get(j + 1, FAR) + INSERT)
            here[j] = best
    if rest[0].get(0, FAR) >= FAR:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        left = rest[i][j]
        if i < n and rest[i + 1].get(j, FAR) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and rest[i].get(j + 1, FAR) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if symbols[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return rest[0][0], "".join(audit)


def match(symbol: str, wanted: str) -> int:
    """What it costs that a row stays as one of the wanted initial."""
    late = TRUNCATED if symbol.isupper() else 0
    if symbol.lower() == wanted:
        return KEEP + late
    return FAR if wanted == "s" else REROLE + late


def align(symbols: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair. A row's symbol is its initial (``x`` if it is
    none of the grammar's), upper case if truncated, or ``d`` if it has to go."""
    kept = [0]
    for symbol in symbols:
        kept.append(kept[-1] + (symbol != "d"))
    must = sum(DELETE if x == "d" else TRUNCATED * x.isupper() for x in symbols)
    best = (DELETE * len(symbols), "D" * len(symbols))
    for target in targets(kept[-1], "s" in symbols.lower()):
        slack = (best[0] - must) // 2
        if abs(len(target) - kept[-1]) > slack:  # none of the rest is nearer
            break
        found = banded(symbols, target, kept, slack)
        if found:
            best = min(best, found)
    return best


# ---------------------------------------------------------------- long conversations, by segments

def _closure() -> np.ndarray:
    """Costs of going between states by inserts alone."""
    costs = np.full((4, 4), FAR)
    for state in range(4):
        at, cost = state, 0
        for _ in range(3):
            costs[state, at] = min(costs[state, at], cost)
            at, cost = AFTER[at, NEXT[at]], cost + INSERT
    return costs


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of 4 x 4 matrices."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)


def _moves(symbol: str) -> dict[int, list[tuple[str, int, int]]]:
    """Per state the edits of a row: letter, cost, state after it."""
    moves: dict[int, list[tuple[str, int, int]]] = {}
    for state in range(4):
        moves[state] = [("D", DELETE, state)]
        if symbol != "d":
            for wanted in {symbol.lower(), NEXT[state]}:
                cost = match(symbol, wanted)
                if (state, wanted) in AFTER and cost < FAR:
                    letter = "K" if symbol.lower() == wanted else "R"
                    moves[state].append((letter, cost, AFTER[state, wanted]))
    return moves


CLOSURE = _closure()
MOVES = {x: _moves(x) for x in "dsuaxSUAX"}


def _row_matrix(symbol: str) -> np.ndarray:
    costs = np.full((4, 4), FAR)
    for state, moves in MOVES[symbol].items():
        for _, cost, after in moves:
            costs[state, after] = min(costs[state, after], cost)
    return _times(CLOSURE, costs)


STEPS = {x: _row_matrix(x) for x in MOVES}


def segment_matrix(symbols: str) -> np.ndarray:
    """Cheapest costs between the states before and after a run of rows."""
    mats = np.stack([STEPS[x] for x in symbols])
    while len(mats) > 1:
        half = len(mats) // 2
        paired = _times(mats[0:2 * half:2], mats[1:2 * half:2])
        mats = np.concatenate((paired, mats[2 * half:]))
    return mats[0]


def left_at_the_end() -> np.ndarray:
    """Cost from each state to the end once there are no more rows."""
    return CLOSURE[:, list(ACCEPTED)].min(1)


def walk(symbols: str, state: int, after: list[int], last: bool) -> tuple[str, int]:
    """The least audit among the cheapest ways through a run of rows, and the state behind
    it; ``after`` has what each state behind the run still costs. A letter leads from one
    state to one state only, so the least letter that stays cheapest can be taken."""
    n = len(symbols)
    left = [after] * (n + 1)
    for i in range(n - 1, -1, -1):
        direct = [min(cost + left[i + 1][to] for _, cost, to in MOVES[symbols[i]][s])
                  for s in range(4)]
        left[i] = [min(int(CLOSURE[s, t]) + direct[t] for t in range(4)) for s in range(4)]
    audit, i = [], 0
    while True:
        options = []
        if i < n:
            options = [(letter, cost + left[i + 1][to], to, 1)
                       for letter, cost, to in MOVES[symbols[i]][state]]
        elif not last or (state in ACCEPTED and left[n][state] == 0):
            return "".join(audit), state
        to = AFTER[state, NEXT[state]]
        options.append(("I", INSERT + left[i][to], to, 0))
        letter, _, state, step = min(x for x in options if x[1] == left[i][state])
        audit.append(letter)
        i += step


# ---------------------------------------------------------------- rows

def initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def read(conversations: DataFrame) -> DataFrame:
    """The rows with NULL roles and texts as one space and what tells their faults."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    fault = (F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), "b")
             .when(F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "-").otherwise("t"))
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    return (conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                 present.alias("present"))
            .withColumn("sign", F.concat(initial(F.col("role")), fault)))


def _edits_type(rows: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return (f"conv_id {kinds['conv_id']}, at long, turn {kinds['turn']}, role string, text string,"
            " fault string, edit string, new_role string")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from batch.slice(at, 1024).to_pylist()


def _written(rows: Iterator[dict], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == size:
            yield pa.RecordBatch.from_pylist(chunk, schema)
            chunk = []
    if chunk:
        yield pa.RecordBatch.from_pylist(chunk, schema)


def _arrow(rows: DataFrame, text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = rows.sparkSession.createDataFrame([], text)
    return to_arrow_schema(empty.schema)


FAULTS = {"b": "blank", "d": "duplicate", "t": "truncated", "-": None}


def _symbol(kind: str, fault: str) -> str:
    return "d" if fault in "bd" else kind.upper() if fault == "t" else kind


def _script(rows: Iterator[dict], audit: Iterator[str], at: int, state: int) -> Iterator[dict]:
    """The edits of rows in order, from a state of the grammar on."""
    for letter in audit:
        row = {} if letter == "I" else next(rows)
        new = None
        if letter != "D":
            kind = row["kind"] if letter == "K" else NEXT[state]
            new = row["role"] if letter == "K" else NAMES[kind]
            state = AFTER[state, kind]
        yield {"conv_id": row.get("conv_id"), "at": at, "turn": row.get("turn"),
               "role": row.get("role"), "text": row.get("text", ""),
               "fault": row.get("fault"), "edit": letter, "new_role": new}
        at += 1


def _short(rows: Iterator[dict], known_audits: int = 1 << 16) -> Iterator[dict]:
    """The edits of whole conversations that follow each other. Audits of the same symbols
    are looked up; there are at most ``known_audits`` at a time."""
    known: dict[str, str] = {}
    for conv, group in groupby(rows, key=lambda r: r["conv_id"]):
        seen, here, symbols = set(), [], []
        for row in group:
            if not row["present"]:
                continue
            kind, fault = row["sign"]
            pair = (row["role"], row["text"])
            if fault != "b" and pair in seen:
                fault = "d"
            seen.add(pair)
            here.append(row | {"kind": kind, "fault": FAULTS[fault]})
            symbols.append(_symbol(kind, fault))
        if not here:  # an id without rows still has a line
            yield {"conv_id": conv, "at": 0, "turn": None, "role": None, "text": None,
                   "fault": None, "edit": None, "new_role": None}
            continue
        symbols = "".join(symbols)
        if symbols not in known:
            if len(known) >= known_audits:
                known.clear()
            known[symbols] = align(symbols)[1]
        for edit in _script(iter(here), iter(known[symbols]), 0, 0):
            yield edit | {"conv_id": conv}


def edits(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The edits of every conversation: ``conv_id``, ``at`` (order), ``turn``, ``role``,
    ``text``, ``fault``, ``edit`` (K, R, D, I) and ``new_role`` (NULL if deleted). Rows of
    ``rows`` with a false ``present`` only name their conversation, which then has one
    line without an edit if nothing else is left of it."""
    rows = read(rows)
    text = _edits_type(rows)
    schema = _arrow(rows, text)

    def short(batches):
        return _written(_short(_streamed(batches)), schema)

    def aligned(part: DataFrame) -> DataFrame:
        return (part.repartition("conv_id")
                .sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(short, text))

    count = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    large = stored(count.filter(F.col("n") > settings.long_rows).select(
        F.col("conv_id").alias("large_id")), "long conversations")
    if large.isEmpty():
        return aligned(rows)
    hit = rows["conv_id"].eqNullSafe(large["large_id"])
    return aligned(rows.join(large, hit, "left_anti")).unionByName(
        _by_segments(rows.join(large, hit, "left_semi"), settings, text, schema))


def _by_segments(rows: DataFrame, settings: Settings, text: str, schema: pa.Schema) -> DataFrame:
    """The edits of long conversations, cut into segments in order of turn."""
    order = ["conv_id", "turn", "role", "text"]
    ids = rows.schema["conv_id"].dataType.simpleString()
    turns = rows.schema["turn"].dataType.simpleString()
    ranged = stored(
        rows.repartitionByRange(settings.segments, *order).sortWithinPartitions(*order)
        .select("*", F.monotonically_increasing_id().alias("place"),
                F.spark_partition_id().alias("segment")), "turns in order")
    there = ranged.filter("present")
    absent = ranged.filter(~F.col("present")).select("conv_id").distinct()
    first = there.groupBy("conv_id", "role", "text").agg(F.min("place").alias("first_place"))
    flagged = durable(
        there.join(first.select("first_place"), F.col("place") == F.col("first_place"), "left")
        .withColumn("fault", F.when(F.substring("sign", 2, 1) == "b", "b")
                    .when(F.col("first_place").isNull(), "d").otherwise(F.substring("sign", 2, 1)))
        .select("conv_id", "segment", "place", "turn", "role", "text",
                F.substring("sign", 1, 1).alias("kind"), "fault"))
    letter = (F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper("kind"))
              .otherwise(F.col("kind")))
    # one byte a row: a segment holds the rows of one range partition at most
    runs = durable(flagged.groupBy("conv_id", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", letter.alias("x")))),
                                 lambda r: r["x"]), "").alias("symbols")))

    def per_run(build: Callable[[dict], dict], out: str):
        arrow = _arrow(rows, out)
        return lambda batches: _written(map(build, _streamed(batches)), arrow, 16)

    costs = runs.mapInArrow(
        per_run(lambda r: {"conv_id": r["conv_id"], "segment": r["segment"],
                           "costs": segment_matrix(r["symbols"]).ravel().tolist()},
                out := f"conv_id {ids}, segment int, costs array<long>"), out)

    def chained(frame: DataFrame, columns: list[str], build, out: str) -> DataFrame:
        """One row for each run from all runs of its conversation, which are at most as
        many as there are segments."""
        together = frame.groupBy("conv_id").agg(
            F.array_sort(F.collect_list(F.struct("segment", *columns))).alias("runs"))
        arrow = _arrow(rows, out)

        def each(batches):
            made = (x | {"conv_id": r["conv_id"]} for r in _streamed(batches)
                    for x in build(r["runs"]))
            return _written(made, arrow, 16)
        return together.mapInArrow(each, out)

    def ends(group: list[dict]) -> list[dict]:
        after, found = left_at_the_end(), []
        for i in range(len(group) - 1, -1, -1):
            found.append({"segment": group[i]["segment"], "after": after.tolist(),
                          "last": i == len(group) - 1})
            after = (np.array(group[i]["costs"]).reshape(4, 4) + after).min(1)
        return found

    behind = chained(costs, ["costs"], ends, f"conv_id {ids}, segment int, after array<long>, last boolean")
    alike = lambda a, b: (a["conv_id"].eqNullSafe(b["conv_id"])) & (a["segment"] == b["segment"])
    ready = runs.join(behind, alike(runs, behind)).select(runs["*"], "after", "last")

    def walked(r: dict) -> dict:
        ways = [walk(r["symbols"], s, r["after"], r["last"]) for s in range(4)]
        return {"conv_id": r["conv_id"], "segment": r["segment"],
                "audits": [a for a, _ in ways], "states": [s for _, s in ways]}

    ways = ready.mapInArrow(per_run(
        walked, out := f"conv_id {ids}, segment int, audits array<string>, states array<int>"), out)

    def chosen(group: list[dict]) -> list[dict]:
        state, at, found = 0, 0, []
        for r in group:
            found.append({"segment": r["segment"], "audit": r["audits"][state], "state": state,
                          "at": at})
            at += len(r["audits"][state])
            state = r["states"][state]
        return found

    picked = chained(ways, ["audits", "states"], chosen,
                     f"conv_id {ids}, segment int, audit string, state int, at long")
    void = {"turn": turns, "role": "string", "text": "string", "kind": "string", "fault": "string"}
    lines = flagged.withColumns({"audit": F.lit(None).cast("string"), "state": F.lit(None).cast("int"),
                                 "at": F.lit(None).cast("long")})
    heads = picked.withColumns({c: F.lit(None).cast(t) for c, t in void.items()}).withColumn(
        "place", F.lit(-1).cast("long"))

    def scripts(rows: Iterator[dict]) -> Iterator[dict]:
        for (conv, _), group in groupby(rows, key=lambda r: (r["conv_id"], r["segment"])):
            head = next(group)
            body = (r | {"fault": FAULTS[r["fault"]]} for r in group)
            for edit in _script(body, iter(head["audit"]), head["at"], head["state"]):
                yield edit | {"conv_id": conv}

    made = (lines.unionByName(heads).repartition("conv_id", "segment")
            .sortWithinPartitions("conv_id", "segment", "place")
            .mapInArrow(lambda b: _written(scripts(_streamed(b)), schema), text))
    # a conversation of which every row was dropped still has its line
    bare = absent.join(there.select(F.col("conv_id").alias("some")).distinct(),
                       absent["conv_id"].eqNullSafe(F.col("some")), "left_anti")
    none = bare.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast(turns).alias("turn"),
                       *(F.lit(None).cast("string").alias(c)
                         for c in ("role", "text", "fault", "edit", "new_role")))
    return made.unionByName(none).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def repaired(found: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``at``, ``turn``, ``role``, ``text``."""
    return found.filter(F.col("new_role").isNotNull()).select(
        "conv_id", "at", "turn", F.col("new_role").alias("role"), "text")


def report(found: DataFrame) -> DataFrame:
    """One row per conversation from the result of ``edits``, in the order it has there."""
    ids = found.schema["conv_id"].dataType.simpleString()
    text = (f"conv_id {ids}, gaps long, blank long, duplicate long, truncated long, illegal long,"
            " cost long, audit string, repaired_sha256 string")
    schema = _arrow(found, text)

    def digest(rows: Iterator[dict]) -> Iterator[dict]:
        for conv, group in groupby(rows, key=lambda r: r["conv_id"]):
            faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
            low = high = turn = before = None
            turns = illegal = cost = lines = 0
            audit, digester = [], hashlib.sha256()
            for r in group:
                edit = r["edit"]
                if edit is None:
                    continue
                audit.append(edit)
                if edit == "I":
                    cost += INSERT
                else:
                    cost += {"K": KEEP, "R": REROLE, "D": DELETE}[edit]
                    if r["fault"]:
                        faults[r["fault"]] += 1
                        cost += TRUNCATED * (r["fault"] == "truncated" and edit != "D")
                    here = r["role"][:1]
                    illegal += before is not None and before + here not in ("su", "ua", "au")
                    before = here
                    if r["turn"] is not None:
                        turns += r["turn"] != turn
                        turn = high = r["turn"]
                        low = turn if low is None else low
                if edit != "D":
                    line = f"{r['new_role']}:{r['text']}"
                    digester.update(("\n" * (lines > 0) + line).encode("utf-8", "surrogatepass"))
                    lines += 1
            yield {"conv_id": conv, "gaps": min(high - low + 1 - turns, 2 ** 63 - 1) if turns else 0,
                   **faults, "illegal": illegal, "cost": cost, "audit": "".join(audit),
                   "repaired_sha256": digester.hexdigest()}

    return found.mapInArrow(lambda b: _written(digest(_streamed(b)), schema), text)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by a hash of id and turn; dropped ones stay as rows
    whose ``present`` is false."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mode = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    return (conversations.select("conv_id", "turn", blank("role").alias("role"),
                                 blank("text").alias("text"), mode.alias("mode"))
            .withColumn("copy", F.explode(F.when(F.col("mode") == 3, F.array(F.lit(0), F.lit(1)))
                                          .otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn",
                    F.when(F.col("mode") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("mode") == 1, "").when(
                        F.col("mode") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
                        F.col("text")).alias("text"),
                    (F.col("mode") != 0).alias("present")))


#: The same from the definitions: a table-free CRC, faults by windows, and the cheapest
#: (cost, audit) for each row and state of the grammar by recursion over the rows.
ORACLE = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
moded AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda d, z: xor(d >> 1, CAST(3988292384 AS BIGINT) * (d & 1)))),
      CAST(4294967295 AS BIGINT)) % 20 AS mode
  FROM src),
rows0 AS (
  SELECT conv_id, turn, CASE WHEN mode = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN mode = 1 THEN '' WHEN mode = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
              ELSE text END AS text
  FROM moded, (SELECT unnest([0, 1]) AS copy) WHERE mode <> 0 AND (copy = 0 OR mode = 3)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM rows0),
told AS (
  SELECT *, left(role, 1) AS ini,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
  FROM ordered),
faced AS (
  SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS ini0 FROM told),
ids AS (SELECT DISTINCT conv_id FROM conversations),
counted AS (
  SELECT d.conv_id, count(t.i) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (ini0 IS NOT NULL AND ini0 || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids d LEFT JOIN faced t ON t.conv_id IS NOT DISTINCT FROM d.conv_id GROUP BY d.conv_id),
-- p0..p3: cost and audit before a row; nothing yet, after s, after u, after a
p AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': ''} AS p0,
         {'c': CAST(999999 AS BIGINT), 'a': ''} AS p1, {'c': CAST(2 AS BIGINT), 'a': 'I'} AS p2,
         {'c': CAST(4 AS BIGINT), 'a': 'II'} AS p3
  FROM counted
  UNION ALL
  SELECT conv_id, n, i, q0, q1,
         least(q2, {'c': q0.c + 2, 'a': q0.a || 'I'}, {'c': q1.c + 2, 'a': q1.a || 'I'}, {'c': q3.c + 2, 'a': q3.a || 'I'}),
         least(q3, {'c': q2.c + 2, 'a': q2.a || 'I'}, {'c': q0.c + 4, 'a': q0.a || 'II'}, {'c': q1.c + 4, 'a': q1.a || 'II'})
  FROM (
    SELECT p.conv_id, p.n, p.i + 1 AS i,
      {'c': p0.c + 3, 'a': p0.a || 'D'} AS q0,
      least({'c': p1.c + 3, 'a': p1.a || 'D'},
            {'c': p0.c + s + w, 'a': p0.a || 'K'}) AS q1,
      least({'c': p2.c + 3, 'a': p2.a || 'D'}, {'c': p0.c + u + w, 'a': p0.a || lu},
            {'c': p1.c + u + w, 'a': p1.a || lu}, {'c': p3.c + u + w, 'a': p3.a || lu}) AS q2,
      least({'c': p3.c + 3, 'a': p3.a || 'D'}, {'c': p2.c + a + w, 'a': p2.a || la}) AS q3
    FROM p JOIN (
      SELECT conv_id, i, CASE WHEN fault = 'truncated' THEN 1 WHEN fault IS NULL THEN 0 ELSE 999999 END AS w,
             CASE WHEN ini = 's' THEN 0 ELSE 999999 END AS s,
             CASE WHEN ini = 'u' THEN 0 ELSE 2 END AS u, CASE WHEN ini = 'a' THEN 0 ELSE 2 END AS a,
             CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END AS lu, CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END AS la
      FROM told) r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)),
best AS (
  SELECT conv_id, n, least(p0, p3) AS b FROM p WHERE i = n),
letters AS (
  SELECT conv_id, k, substr(b.a, k, 1) AS letter FROM best, range(1, 1000000) r(k)
  WHERE k <= length(b.a)),
placed AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
kept AS (
  SELECT l.conv_id, l.o, l.letter, t.role, t.ini, CASE WHEN l.letter = 'I' THEN '' ELSE t.text END AS text,
         max(CASE WHEN l.o = 1 AND l.letter = 'K' AND t.ini = 's' THEN 1 ELSE 0 END)
           OVER (PARTITION BY l.conv_id) AS sys
  FROM placed l LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i
  WHERE l.letter <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user'
                                  ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o) AS whole
  FROM kept GROUP BY conv_id)
SELECT c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, b.b.c AS cost,
       b.b.a AS audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM counted c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return report(edits(damaged(table(spark, sf_dir, "conversations"))))
