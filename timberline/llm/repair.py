"""Conversations brought into the order system, user, assistant, user, … by the cheapest edits, found by divide and conquer.

A role automaton has four states: nothing yet, after system, after user, after assistant. For a stretch of rows, its costs from each state
to each state say all that the rest of the conversation has to know of it. Forward costs from the beginning and backward costs
from the end meet in the middle, the best crossing state is chosen, and both halves go on by themselves, so that no table of
all places is kept. Stretches lie in many tasks; only their four by four costs are brought together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import BLANKS, table
from timberline.session import small_side, stored

#: Rows of one conversation that are looked at as one piece, at most.
PIECE_ROWS = 1 << 16
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
_FAR = 1 << 60
_STATES = range(4)
#: Where a kept row of each role (system, user, assistant, any other) leads from each state, and where the role that is wanted next leads.
_KEEPS = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
_NEXT = (2, 2, 3, 2)
_ROLES = {2: "user", 3: "assistant"}
#: What has to be inserted at the end: nothing or whole pairs may end a conversation.
_END = ("", "II", "I", "")
#: Faults of a row: none, truncated, blank, duplicate.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
_CHUNK = 8

#: From each state to each state: the cost, and the rank of the least audit of that cost among those from the same state.
Costs = tuple[tuple[tuple[int, int], ...], ...]


def _edits(code: int) -> list[dict[int, tuple[int, str]]]:
    """Per state, the cheapest edits of one row to every state; of equal ones the ASCII-least. ``code`` is role + 4 * fault."""
    role, fault = code % 4, code // 4
    found: list[dict[int, tuple[int, str]]] = []
    for state in _STATES:
        best: dict[int, tuple[int, str]] = {}
        at, before = state, ""
        for _ in range(3):
            made = [(DELETE, "D", at)]
            if fault in (SOUND, TRUNCATED):
                made.append((REROLE, "R", _NEXT[at]))
                if at in _KEEPS[role]:
                    made.append((0, "K", _KEEPS[role][at]))
            for cost, letter, to in made:
                whole = (cost + INSERT * len(before) + CUT * (fault == TRUNCATED and letter != "D"), before + letter)
                best[to] = min(best.get(to, whole), whole)
            at, before = _NEXT[at], before + "I"
        found.append(best)
    return found


_EDITS = [_edits(code) for code in range(16)]


def _unit(state: int) -> list[tuple[int, int]]:
    return [(0 if s == state else _FAR, 0) for s in _STATES]


def _forward(vector: list[tuple[int, int]], costs: Costs) -> list[tuple[int, int]]:
    """Costs and ranks after a stretch. Two audits that reach different states differ before either ends, so the earlier rank decides."""
    best = [min((vector[m][0] + costs[m][t][0], vector[m][1], costs[m][t][1]) for m in _STATES) for t in _STATES]
    order = sorted(_STATES, key=lambda t: best[t][1:])
    return [(min(best[t][0], _FAR), order.index(t)) for t in _STATES]


def _backward(costs: Costs, vector: list[int]) -> list[int]:
    return [min(min(costs[s][t][0] + vector[t] for t in _STATES), _FAR) for s in _STATES]


@lru_cache(1 << 16)
def chunk_costs(codes: bytes) -> Costs:
    """The costs of a short stretch."""
    if len(codes) > 1:
        half = len(codes) // 2
        left, right = chunk_costs(codes[:half]), chunk_costs(codes[half:])
        return tuple(tuple(_forward(list(left[s]), right)) for s in _STATES)
    rows = []
    for best in _EDITS[codes[0]]:
        order = sorted(best, key=lambda t: best[t][1])
        rows.append(tuple((best[t][0], order.index(t)) if t in best else (_FAR, 4 + t) for t in _STATES))
    return tuple(rows)


def _chunks(codes: bytes) -> list[bytes]:
    return [codes[k : k + _CHUNK] for k in range(0, len(codes), _CHUNK)]


def stretch_costs(codes: bytes) -> Costs:
    found = [list(row) for row in chunk_costs(codes[:_CHUNK])]
    for chunk in _chunks(codes)[1:]:
        costs = chunk_costs(chunk)
        found = [_forward(row, costs) for row in found]
    return tuple(tuple(row) for row in found)


def crossings(stretches: list[Costs], enter: int, leave: int) -> list[int]:
    """The states between the stretches of the least audit among the cheapest from ``enter`` to ``leave``; both are included."""
    states = [enter, *[0] * (len(stretches) - 1), leave]
    todo = [(0, len(stretches))]
    while todo:
        begin, end = todo.pop()
        if end - begin < 2:
            continue
        middle = (begin + end) // 2
        ahead = _unit(states[begin])
        for k in range(begin, middle):
            ahead = _forward(ahead, stretches[k])
        back = [cost for cost, _ in _unit(states[end])]
        for k in range(end - 1, middle - 1, -1):
            back = _backward(stretches[k], back)
        states[middle] = min(_STATES, key=lambda s: (ahead[s][0] + back[s], ahead[s][1]))
        todo += [(begin, middle), (middle, end)]
    return states


@lru_cache(1 << 16)
def _letters(codes: bytes, enter: int, leave: int) -> str:
    if len(codes) == 1:
        return _EDITS[codes[0]][enter][leave][1]
    half = len(codes) // 2
    _, middle, _ = crossings([chunk_costs(codes[:half]), chunk_costs(codes[half:])], enter, leave)
    return _letters(codes[:half], enter, middle) + _letters(codes[half:], middle, leave)


def edits_of(codes: bytes, enter: int, leave: int) -> str:
    """The audit of a stretch between two states."""
    parts = _chunks(codes)
    states = crossings([chunk_costs(p) for p in parts], enter, leave)
    return "".join(_letters(p, a, b) for p, a, b in zip(parts, states, states[1:]))


def best_end(stretches: list[Costs]) -> tuple[int, int]:
    """The least cost of a whole conversation, and the state in which its rows leave it."""
    ahead = _unit(0)
    for costs in stretches:
        ahead = _forward(ahead, costs)
    total = lambda s: ahead[s][0] + INSERT * len(_END[s])
    state = min(_STATES, key=lambda s: (total(s), ahead[s][1]))
    return total(state), state


def solve(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    cost, leave = best_end([stretch_costs(codes)])
    return cost, edits_of(codes, 0, leave) + _END[leave]


# ---- rows -------------------------------------------------------------------------------------------------------

_PIECE = (
    "part int, piece bigint, whole boolean, codes binary, costs array<bigint>, n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first_role int, last_role int, turns bigint, first_turn bigint, last_turn bigint, cost bigint, audit string"
)
_SUMS = ("n_rows", "blank", "duplicate", "truncated", "illegal")


def _initial(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _lawful(before: int, after: int) -> bool:
    return (before, after) in ((0, 1), (1, 2), (2, 1))


def _schema(docs: DataFrame, key: str, rest: str):
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField("conv_id", docs.schema[key].dataType), *StructType.fromDDL(rest).fields])


def _pieces(signed: DataFrame, piece_rows: int) -> DataFrame:
    """Rows in order as pieces: what is in them, their costs and, if a conversation is one piece, its audit."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = ["conv_id", "turn", "role", "sig"]
    # Rows that are equal in everything are one row with a number: none of them can fill a task.
    grouped = signed.groupBy(*keys, "kind", "fault").agg(F.count(F.lit(1)).alias("n"))
    grouped = stored(grouped, "rows")
    told = grouped.filter(F.col("fault") != BLANK).groupBy("conv_id", "role", "sig").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
    again = told.filter("turns > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("sig").alias("_sig"), "first")
    met = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("sig") == F.col("_sig")) & (F.col("fault") != BLANK)
    joined = grouped.join(small_side(again, 64, F.octet_length("_role")), met, "left")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    marked = joined.select(*keys, "kind", "n", F.when(later, DUPLICATE).otherwise(F.col("fault")).alias("fault"))
    placed = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "kind", "fault", "n", F.spark_partition_id().alias("part"))
    schema = _schema(signed, "conv_id", _PIECE)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        conv, part, first_seen, count = None, 0, False, 0
        now: dict | None = None

        def close(border: bool) -> None:
            """End the piece at hand; it is a whole conversation unless it touches a border."""
            nonlocal count, now
            codes = bytes(now.pop("bytes"))
            now["whole"] = not border and now.pop("alone")
            now.pop("alone", None)
            if now["whole"]:
                now["cost"], now["audit"] = solve(codes)
            else:
                costs = stretch_costs(codes)
                now["codes"], now["costs"] = codes, [c for row in costs for pair in row for c in pair]
            out.append(now)
            count += 1
            now = None

        def begin(alone: bool) -> dict:
            return {"conv_id": conv, "part": part, "piece": count, "alone": alone, "bytes": bytearray(), "turns": 0, **dict.fromkeys(_SUMS, 0)}

        for batch in batches:
            for conv_id, turn, kind, fault, n, part in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and conv_id != conv:
                    close(False)
                    first_seen = True
                while n:
                    if now is None or len(now["bytes"]) >= piece_rows:
                        same = now is not None
                        if same:
                            close(True)
                        conv = conv_id
                        # The first conversation of a part may have begun in an earlier one.
                        now = begin(first_seen and not same)
                    some = min(n, piece_rows - len(now["bytes"]))
                    if now["bytes"]:
                        now["illegal"] += not _lawful(now["last_role"], kind)
                    else:
                        now["first_role"] = kind
                    now["illegal"] += some - 1
                    now["last_role"] = kind
                    now["n_rows"] += some
                    if turn is not None:
                        now["turns"] += turn != now.get("last_turn")
                        now.setdefault("first_turn", turn)
                        now["last_turn"] = turn
                    for faults, many in ((fault, 1), (BLANK if fault == BLANK else DUPLICATE, some - 1)):
                        now["bytes"] += bytes([kind + 4 * faults]) * many
                        name = (None, "truncated", "blank", "duplicate")[faults]
                        if name:
                            now[name] += many
                    n -= some
                    # What is left of equal rows stands after a row like it.
                    fault = BLANK if fault == BLANK else DUPLICATE
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if now is not None:
            close(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return stored(placed.mapInArrow(run, schema), "pieces")


def _across(pieces: DataFrame) -> DataFrame:
    """States in which the rows of conversations of several pieces enter and leave each piece; the cost stands with the last piece."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("part int, piece bigint, enter int, leave int, cost bigint")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, []

        def states() -> list[dict]:
            stretches = [tuple(tuple((c[8 * s + 2 * t], c[8 * s + 2 * t + 1]) for t in _STATES) for s in _STATES) for _, _, c in held]
            cost, leave = best_end(stretches)
            between = crossings(stretches, 0, leave)
            costs = [*[None] * (len(held) - 1), cost]
            return [{"part": a, "piece": b, "enter": x, "leave": y, "cost": c} for (a, b, _), x, y, c in zip(held, between, between[1:], costs)]

        for batch in batches:
            for conv_id, part, piece, costs in zip(*(c.to_pylist() for c in batch.columns)):
                if held and conv_id != conv:
                    yield pa.RecordBatch.from_pylist(states(), schema=arrow)
                    held = []
                conv = conv_id
                held.append((part, piece, costs))
        if held:
            yield pa.RecordBatch.from_pylist(states(), schema=arrow)

    some = pieces.filter("not whole").select("conv_id", "part", "piece", "costs")
    return some.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(run, schema)


def audited(signed: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``conv_id`` and ``part, piece`` in order, with the audit of each piece of a conversation and its counts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    pieces = _pieces(signed, piece_rows)
    states = small_side(_across(pieces).withColumnRenamed("cost", "_cost"), 32)
    schema = pieces.drop("codes", "costs", "whole").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes, enter, leave, cost = (row.pop(c) for c in ("codes", "enter", "leave", "_cost"))
                row["audit"] = edits_of(codes, enter, leave) + (_END[leave] if cost is not None else "")
                row["cost"] = cost
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    several = pieces.filter("not whole").join(states, ["part", "piece"]).select(*schema.names, "codes", "enter", "leave", "_cost")
    return pieces.filter("whole").select(*schema.names).unionByName(several.mapInArrow(run, schema))


REPAIRED = (
    "at bigint, edit string, turn bigint, role string, text string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
)


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Conversations with their edits: ``conv_id`` and the columns of ``REPAIRED``.

    ``rows`` is ``conv_id, turn, role, text``. A conversation's row with ``at`` 0 has its counts and the cost of its edits; the
    edits follow from 1 on in order: K keeps, R gives another role, D deletes (``role`` and ``text`` are what goes), I inserts an empty text. What K, R and
    I give is the repaired conversation. A task's rows of one conversation come in that order.

    Rows are taken by turn, null turns first; rows of one turn by role, then by the SHA-1 of their text. A null role or text is one space. A conversation of rows with a
    null ``gone`` column or none at all is repaired whole; rows that are marked ``gone`` only bring their conversation into the
    result. Rows that are equal in everything come one after the other. A null ``conv_id`` is a conversation of its own. ``gaps`` beyond a long are the largest
    long. Other columns are ignored, an empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    here = F.col("gone").isNull() | ~F.col("gone") if "gone" in rows.columns else F.lit(True)
    plain = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), here.alias("here"))
    signed = plain.withColumn("sig", F.unhex(F.sha1(F.col("text").cast("binary"))))
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    narrow = signed.filter("here").select("conv_id", "turn", "role", "sig", _initial(F.col("role")).alias("kind"), fault.alias("fault"))
    found = audited(narrow, piece_rows)
    # Audits first, then the rows they speak of, conversation by conversation: one task reads one, a row at a time.
    none = lambda kind: F.lit(None).cast(kind)
    names = [c for c in found.columns if c not in ("conv_id", "part", "piece")]
    audits = found.select("conv_id", F.lit(0).alias("row"), "part", "piece", none("bigint").alias("turn"), none("string").alias("role"), none("binary").alias("sig"),
                          none("string").alias("text"), F.struct(*names).alias("told"))
    texts = signed.select("conv_id", F.when(F.col("here"), 1).otherwise(2).alias("row"), none("int").alias("part"), none("bigint").alias("piece"), "turn", "role", "sig",
                          F.when(F.col("here"), F.col("text")).alias("text"), none(audits.schema["told"].dataType.simpleString()).alias("told"))
    order = ["conv_id", "row", "part", "piece", "turn", "role", "sig"]
    streams = audits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "row", "turn", "role", "text", "told")
    schema = _schema(rows, "conv_id", REPAIRED)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        conv, begun, told, audit, at, state, step = None, False, [], "", 0, 0, 0

        def put(edit: str | None, turn: int | None, role: str | None, text: str | None, **counts: int) -> None:
            nonlocal at, size
            out.append({"conv_id": conv, "at": at, "edit": edit, "turn": turn, "role": role, "text": text, **counts})
            at, size = at + 1, size + 100 + len(text or "")

        def head() -> None:
            nonlocal audit, at, state, step
            at = state = step = 0
            sums = {c: sum(t[c] for t in told) for c in _SUMS}
            sums["illegal"] += sum(not _lawful(a["last_role"], b["first_role"]) for a, b in zip(told, told[1:]))
            dated = [t for t in told if t["turns"]]
            turns = sum(t["turns"] for t in dated) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:]))
            gaps = dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - turns if dated else 0
            audit = "".join(t["audit"] for t in told)
            sums.pop("n_rows")
            put(None, None, None, None, gaps=min(gaps, (1 << 63) - 1), cost=sum(t["cost"] or 0 for t in told), **sums)

        def inserts() -> None:
            nonlocal state, step
            while step < len(audit) and audit[step] == "I":
                state = _NEXT[state]
                put("I", None, _ROLES[state], "")
                step += 1

        for batch in batches:
            for conv_id, row, turn, role, text, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and conv_id != conv:
                    if told is not None:
                        head()
                    inserts()
                    begun = False
                if not begun:
                    conv, begun, told = conv_id, True, []
                if row == 0:
                    told.append(piece)
                    continue
                if told is not None:
                    head()
                    told = None
                if row == 1:
                    inserts()
                    edit = audit[step]
                    step += 1
                    if edit == "R":
                        state = _NEXT[state]
                        role = _ROLES[state]
                    elif edit == "K":
                        state = _KEEPS["sua".index(role[0])][state]
                    put(edit, turn, role, text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        if begun:
            if told is not None:
                head()
            inserts()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return streams.mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation from :func:`repair`'s rows as they come: its counts, ``cost``, ``audit`` and ``repaired_sha256`` of ``role:text`` lines."""
    from pyspark.sql.pandas.types import to_arrow_schema

    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = _schema(repaired, "conv_id", ", ".join(f"{c} bigint" for c in numbers) + ", audit string, repaired_sha256 string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, sha, some, out = None, [], None, False, []

        def close() -> None:
            out.append({**now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("conv_id", "at", "edit", "role", "text", *numbers)}
            for k, edit in enumerate(columns["edit"]):
                if columns["at"][k] == 0:
                    if now is not None:
                        close()
                    now = {c: columns[c][k] for c in ("conv_id", *numbers)}
                    audit, sha, some = [], hashlib.sha256(), False
                    continue
                audit.append(edit)
                if edit != "D":
                    sha.update(("\n" * some + columns["role"][k] + ":" + columns["text"][k]).encode())
                    some = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return repaired.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """The query's test damage: by the CRC of ``conv_id:turn`` a row is marked ``gone``, emptied, stripped of its ends, repeated, or made the user's."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name) % 20).alias("_h"))
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_h") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(table(spark, sf_dir, "conversations"))))


OP12_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)),
named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS nm FROM conversations),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(nm) + 1), lambda k: CAST(ascii(substr(nm, k, 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM named, tab),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, c FROM hashed, (SELECT unnest([1, 2]) AS c) WHERE h <> 0 AND (c = 1 OR h = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha1(text), c) AS rn,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut, left(role, 1) AS i FROM d),
f AS (SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
  WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(i) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM o),
ins(s, made, via) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)),
edit(letter, via, i, goes, cost) AS (VALUES ('D', 0, NULL, 0, 4), ('D', 1, NULL, 1, 4), ('D', 2, NULL, 2, 4), ('D', 3, NULL, 3, 4),
  ('R', 0, NULL, 2, 3), ('R', 1, NULL, 2, 3), ('R', 2, NULL, 3, 3), ('R', 3, NULL, 2, 3),
  ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('K', 3, 'u', 2, 0)),
st AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, 0 AS s, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS v FROM d
  UNION ALL
  SELECT st.conv_id, f.rn, edit.goes, min({'cost': CAST(st.v.cost + 3 * length(made) + edit.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END AS BIGINT), 'audit': st.v.audit || made || letter})
  FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.rn = st.rn + 1 JOIN ins ON ins.s = st.s
    JOIN edit ON edit.via = ins.via AND (edit.i IS NULL OR edit.i = f.i) AND (letter = 'D' OR fault IN ('', 'truncated'))
  GROUP BY st.conv_id, f.rn, edit.goes),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (rn > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
best AS (SELECT st.conv_id, min({'cost': v.cost + 3 * length(tail), 'audit': v.audit || tail}) AS v
  FROM st JOIN sums ON st.conv_id IS NOT DISTINCT FROM sums.conv_id AND rn = n JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) z(s, tail) ON z.s = st.s GROUP BY st.conv_id),
steps AS (SELECT conv_id, k, substr(v.audit, CAST(k AS INTEGER), 1) AS e, length(replace(left(v.audit, CAST(k AS INTEGER)), 'I', '')) AS rn,
  length(replace(left(v.audit, CAST(k AS INTEGER) - 1), 'D', '')) AS done FROM (SELECT conv_id, v, unnest(range(1, length(v.audit) + 1)) AS k FROM best)),
made AS (SELECT steps.conv_id, k, e, done, f.role, f.text, min(CASE WHEN e <> 'D' THEN k END) OVER (PARTITION BY steps.conv_id) AS first_k,
  max(CASE WHEN e = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY steps.conv_id) AS sys
  FROM steps LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM steps.conv_id AND f.rn = steps.rn AND e <> 'I' WHERE e <> 'D'),
told AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role || ':' || text ELSE CASE WHEN (done - sys) % 2 = 0 THEN 'user:' ELSE 'assistant:' END || coalesce(text, '') END, chr(10) ORDER BY k) AS whole
  FROM made GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.v.cost, 0) AS cost, coalesce(best.v.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id
"""
