"""Chat formatting: a template is rendered turn by turn as a black box, and compared to find the spans."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Each of these is preceded by a backslash inside roles and texts, so no control string occurs there.
ESCAPED = "\\#<:"
_ESCAPES = str.maketrans({c: "\\" + c for c in ESCAPED})
_HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
FOOTER = " </turn>\n"


def escape(text: str) -> str:
    return text.translate(_ESCAPES)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class TurnTemplate:
    """``### role: text </turn>`` and a line end for each turn, roles and texts escaped.

    The last few outputs are remembered, so a prefix of one more turn costs the escaping of that turn and a copy.
    """

    REMEMBERED = 4

    def __init__(self):
        self.last: list[tuple[list[Turn], str]] = []

    def __call__(self, turns: list[Turn]) -> str:
        known, output = 0, ""
        for before, made in reversed(self.last):
            n = len(before)
            if known < n <= len(turns) and turns[n - 1] is before[-1] and turns[:n] == before:
                known, output = n, made
                break
        output += "".join(f"### {escape(role)}: {escape(text)}{FOOTER}" for role, text in turns[known:])
        if turns:
            self.last = [*self.last[1 - self.REMEMBERED :], (list(turns), output)]
        return output


turn_template = TurnTemplate()


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """(output, spans, first turn that rewrites history or -1).

    The prefix of one more turn is rendered each time. The last output must begin with the one before: then
    what it adds is the turn's span, otherwise the template rewrites history at this turn. Another rendering,
    with a probe in the place of the turn's text, differs first where that text begins, and shows what follows
    it. A span is (begin, text begin, text end, end) in the output; there are none from the rewriting
    turn on, nor for turns before it, as their places don't hold.
    """
    before, spans = template([]), []
    for k, (role, text) in enumerate(turns):
        after = template(turns[: k + 1])
        if not after.startswith(before):
            return template(turns), [], k
        old = len(before)
        seen = after[old:]
        probe = _unlike(seen, turns[:k], role, text, template, old)
        if probe is None:
            return template(turns), [], k
        at, tail = probe
        spans.append((old, old + at, len(after) - tail, len(after)))
        before = after
    return before, spans, -1


def _unlike(seen: str, known: list[Turn], role: str, text: str, template: Template, old: int) -> tuple[int, int] | None:
    """(where the text begins, how much follows it) in what a turn adds; None if the turn's text isn't the only difference."""
    letters = [c for c in "xyz" if c != text[:1]][:2] if not text else [next(c for c in "xy" if c != text[0])]
    made = [template([*known, (role, c)])[old:] for c in letters]
    one, two = made[0], made[1] if len(made) > 1 else seen
    at = _common(one, two)
    tail = len(one) - at - 1
    if tail < 0 or one[:at] != seen[:at] or (tail and not seen.endswith(one[-tail:])) or len(seen) - tail < at:
        return None
    return at, tail


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


FORMATTED = pa.schema(
    [("id", pa.int64()), ("output", pa.string()), ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("begin", "text_begin", "text_end", "end")] + [("role", pa.string()), ("loss", pa.bool_())]))), ("rewrites_at", pa.int64())]
)


def format_chats(rows: DataFrame, template: Template = turn_template, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Each conversation rendered: id_col, output, spans, rewrites_at.

    spans has begin, text_begin, text_end, end (code points of output), role and loss for each turn; the
    loss mask covers the texts of loss_role. rewrites_at is the first turn at which the template changed what
    it had rendered before (spans is empty then), else -1. Turns are sorted by turn (null first), then role
    and text, so ties and repeated rows have one result; null roles and texts are empty. Nothing says that rows with a
    null id belong together: each is a conversation of its own. Rows are dealt by id and streamed in order: a task
    holds one conversation at a time. A conversation is rendered as often as it has turns, as the method asks, which
    costs a copy of what was rendered before for each turn.
    """

    def finish(key, turns):
        output, spans, rewrites = locate(turns, template)
        marks = [{"begin": b, "text_begin": tb, "text_end": te, "end": e, "role": role, "loss": role == loss_role} for (b, tb, te, e), (role, _) in zip(spans, turns)]
        return {"id": key, "output": output, "spans": marks, "rewrites_at": rewrites}

    def run(batches):
        def each():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

        out, size = [], 0
        for (key, _), group in itertools.groupby(each(), key=lambda r: r[:2]):
            out.append(finish(key, [(role or "", text or "") for _, _, role, text in group]))
            size += len(out[-1]["output"])
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(out, FORMATTED)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, FORMATTED)

    apart = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    dealt = rows.select(F.col(id_col).cast("long").alias("id"), apart.alias("apart"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = dealt.repartition("id", "apart").sortWithinPartitions("id", "apart", "turn", "role", "text").drop("turn")
    schema = "id long, output string, spans array<struct<begin:long,text_begin:long,text_end:long,end:long,role:string,loss:boolean>>, rewrites_at long"
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def read_back(output: str, spans: list[dict]) -> tuple[list[Turn], list[str]]:
    """The turns and the texts under the loss mask, from the output alone and the spans' places."""
    turns, loss = [], []
    for s in spans:
        header = _HEADER.fullmatch(output[s["begin"] : s["text_begin"]])
        text = unescape(output[s["text_begin"] : s["text_end"]])
        turns.append((unescape(header[1]), text))
        if s["loss"]:
            loss.append(text)
    return turns, loss


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what turn_template's outputs hold, read back: see the columns of op5."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns, loss = read_back(r["output"], r["spans"])
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                said = "".join(loss)
                rows.append((r[id_col], len(turns), hashlib.sha256(told.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(r["output"])))
            names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names)

    return formatted.mapInArrow(run, f"`{id_col}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_chats(rows))


_SAID = r"\### Assistant: </turn> ok"
_ESC = r"length(regexp_replace({}, '[\\#<:]', '', 'g'))"
OP5_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER () AS apart FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_SAID}', 0), (-7, 1, 'assistant', '{_SAID}', 0)))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + 2 + 9 + 2 * length(role) - {_ESC.format('role')} + 2 * length(text) - {_ESC.format('text')})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN apart END
"""
