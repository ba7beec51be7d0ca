"""Chat formatting around a template that is only ever called: turns in, text out.

The template is rendered over one more turn at a time. What is new at the end of each output is that turn's span, and an
output that does not begin with the one before it shows a template that rewrites history. Where a turn's own text begins
and ends inside its span is found with two probe texts.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns that are rendered together. Longer conversations go on in a new block, with the last turn before it as context.
BLOCK_TURNS = 64

#: What a model would read as control: never left as it is inside a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>")
ESCAPE = "␛"
_RISKY = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))
_BACK = re.compile(ESCAPE + "([01n])")
_TURN = re.compile(r"(?:<s>)?<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """``text`` without control strings; ``unescape`` gives it back. The escape sign goes in after a control's first character."""
    return _RISKY.sub(lambda m: ESCAPE + "0" if m[0] == ESCAPE else m[0][0] + ESCAPE + "1" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: {"0": ESCAPE, "1": "", "n": "\n"}[m[1]], text)


def turn_template(turns: list[Turn]) -> str:
    """The template of the query: every turn is marked, texts are escaped, nothing said is ever changed later."""
    marked = (f"<|turn|>{escape(role).replace(chr(10), ESCAPE + 'n')}\n{escape(text)}<|end|>\n" for role, text in turns)
    return "<s>" + "".join(marked)


#: The template says itself that a turn's span needs no other turn than the one before it; of others nothing is presumed.
turn_template.local = True


def parse_turn(piece: str) -> Turn:
    """Role and text read back from a turn's span."""
    found = _TURN.fullmatch(piece)
    if not found:
        raise ValueError("not a turn: " + piece[:80])
    return unescape(found[1]), unescape(found[2])


def locate(template: Template, history: list[Turn], turn: Turn) -> tuple[str, int, int, bool]:
    """The span of ``turn`` after ``history``, where its text begins and ends in it, and whether history was rewritten."""
    before = template(history) if history else ""
    after = template([*history, turn])
    rewrites = not after.startswith(before)
    start = len(os.path.commonprefix([before, after])) if rewrites else len(before)
    piece = after[start:]
    one, two = (template([*history, (turn[0], probe)]) for probe in ("a", "b"))
    head = max(len(os.path.commonprefix([one, two])) - start, 0)
    tail = len(os.path.commonprefix([one[::-1], two[::-1]]))
    return piece, min(head, len(piece)), max(len(piece) - tail, min(head, len(piece))), rewrites


def spans_of(template: Template, turns: list[Turn], block_turns: int) -> list[tuple[str, int, int, bool]]:
    """``locate`` for every turn of a conversation with all turns before it as history.

    Beyond ``block_turns`` turns this is first tried with a block's history, begun with the turn before it. The spans so made have to be
    the real output at 1, 2, 4, ... blocks and at the end, and at each block's first turn the span with the whole history;
    where they are not, or a turn rewrites or fails, every turn is rendered after its whole history.
    """
    whole = lambda: [locate(template, turns[:k], turn) for k, turn in enumerate(turns)]
    if len(turns) <= block_turns:
        return whole()
    out: list[tuple[str, int, int, bool]] = []
    proof = block_turns
    try:
        for k, turn in enumerate(turns):
            begin = k - k % block_turns
            found = locate(template, turns[max(begin - 1, 0) : k], turn)
            if found[3] or k and k == begin and found != locate(template, turns[:k], turn):
                return whole()
            out.append(found)
            if k + 1 in (proof, len(turns)):
                if template(turns[: k + 1]) != "".join(x[0] for x in out):
                    return whole()
                proof *= 2 if k + 1 == proof else 1
    except Exception:  # a template may refuse a history that does not begin where the conversation does
        return whole()
    return out


def _blocks(turns: DataFrame, block_turns: int) -> DataFrame:
    """``turns`` with their block, and in each later block of a conversation the turn before it as ``context``."""
    rows = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(2**62))).cast("bigint")).withColumn("context", F.lit(False))
    long = rows.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo < hi").select(F.col("conv_id").alias("_conv"))
    last = (
        rows.join(long, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
        .groupBy("conv_id", "block")
        .agg(F.max(F.struct("turn", "role", "text")).alias("last"))
    )
    following = last.withColumn("next", F.lead("block").over(Window.partitionBy("conv_id").orderBy("block"))).filter("next is not null")
    context = following.select("conv_id", "last.turn", "last.role", "last.text", F.col("next").alias("block"), F.lit(True).alias("context"))
    return rows.unionByName(context)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, bool, tuple]]:
    """Rows in order as ``key, whether a new key begins, rest``."""
    current: tuple | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            key = row[:keys]
            yield key, key != current, row[keys:]
            current = key


def format_chats(
    conversations: DataFrame, template: Template = turn_template, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """A row per turn: ``conv_id, block, nth, turn, role, piece, text_begin, text_end, rewrites``.

    ``piece`` is what the turn adds to the conversation's text; in order of ``block, nth`` the pieces are the whole text. ``piece[text_begin:text_end]`` is the
    turn's own text as the template wrote it, which is the loss mask of an assistant's turn. ``rewrites``: the output with this turn does not begin with
    the output before it; ``piece`` is then what follows their common beginning, and the pieces do not make up the final output.

    Turns are taken in order of ``turn`` (null first), then role and text, so ties and repeated rows have one order. Null roles and texts are
    empty; a null id is a conversation of its own. Other columns are ignored. Of a template nothing is presumed: a conversation is one list
    in one task, and ``spans_of`` holds its spans against the real output. Only a template with a true ``local`` attribute, whose spans
    need the turn before them at most, goes through in blocks of ``block_turns``, each in a task of its own.
    """
    local = getattr(template, "local", False)
    kind = conversations.schema[conv_id].dataType.simpleString()
    own = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = ["conv_id", "block", F.desc("context"), "turn", "role", "text"]
    ready = _blocks(own, block_turns)
    ready = ready.repartition("conv_id", "block") if local else ready.filter("not context").repartition("conv_id")
    ready = ready.sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, history, nth = [], 0, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

        for (conv, block), new, (context, at, who, said) in _runs(batches, 2):
            if new:
                history, nth = [], 0
            if not context:
                if len(history) > block_turns:
                    history = history[-1:]
                piece, begin, end, rewrites = locate(template, history, (who, said))
                out.append((conv, block, nth, at, who, piece, begin, end, rewrites))
                nth += 1
                size += len(piece)
            history.append((who, said))
            if size > 4_000_000 or len(out) >= 10_000:
                yield batch()
                out, size = [], 0
        yield batch()

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def conversation() -> Iterator[pa.RecordBatch]:
            out, size, nth, last = [], 0, 0, None
            for (conv, block, at, who, _), found in zip(rows, spans_of(template, [r[3:] for r in rows], block_turns)):
                nth = nth + 1 if block == last else 0
                last = block
                out.append((conv, block, nth, at, who, *found))
                size += len(found[0])
                if size > 4_000_000 or len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

        for (conv,), new, (block, _, at, who, said) in _runs(batches, 1):
            if new and rows:
                yield from conversation()
                rows = []
            rows.append((conv, block, at, who, said))
        if rows:
            yield from conversation()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"conv_id {kind}, block bigint, nth bigint, turn bigint, role string, piece string, text_begin bigint, text_end bigint, rewrites boolean"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow.names
    return ready.select("conv_id", "block", "context", "turn", "role", "text").mapInArrow(run if local else run_whole, schema)


def chat_digests(pieces: DataFrame) -> DataFrame:
    """What can be read back from the pieces of ``turn_template``, per conversation.

    A digest of a text can only be made from its beginning to its end, so one task reads a conversation; it does so in
    a stream, with one piece in memory, after Spark's sort. Pieces that rewrite history do not make up the text: they are an error.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    ready = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: list = []

        def close() -> None:
            conv, n, all_turns, loss_chars, loss, chars = state
            out.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)

        for (conv,), new, (piece, begin, end, rewrites) in _runs(batches, 1):
            if rewrites:
                raise ValueError(f"conversation {conv}: the template rewrites history")
            if new:
                if state:
                    close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if len(out) >= 10_000:
                    yield batch()
                    out.clear()
            who, said = parse_turn(piece)
            state[1] += 1
            state[2].update(f"{who}\n{said}\n".encode())
            if who == "assistant":
                trained = unescape(piece[begin:end])
                state[3] += len(trained)
                state[4].update(trained.encode())
            state[5] += len(piece)
        if state:
            close()
        yield batch()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return ready.select("conv_id", "piece", "text_begin", "text_end", "rewrites").mapInArrow(run, schema)


def _with_sample(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts look like another template's control strings."""
    said = "</s>[INST] ok [/INST]"
    row = lambda k, who: F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(k).cast("bigint").alias("turn"), F.lit(who).alias("role"), F.lit(said).alias("text"))
    sample = conversations.sparkSession.range(1).select(F.inline(F.array(row(0, "user"), row(1, "assistant"))))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(sample)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(format_chats(_with_sample(table(spark, sf_dir, "conversations"))))


def _oracle() -> str:
    def escaped(text: str) -> str:
        text = f"replace({text}, '{ESCAPE}', '{ESCAPE}0')"
        for c in CONTROLS:
            text = f"replace({text}, '{c}', '{c[0]}{ESCAPE}1{c[1:]}')"
        return text

    marks = len("<|turn|>") + len("\n") + len("<|end|>\n")
    said = "'</s>[INST] ok [/INST]'"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}
), ready AS (
  SELECT *, role || chr(10) || text || chr(10) AS line, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    {marks} + length(replace({escaped("role")}, chr(10), '{ESCAPE}n')) + length({escaped("text")}) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) + 3 AS BIGINT) AS formatted_chars
FROM ready GROUP BY conv_id
"""


OP1_SQL = _oracle()
