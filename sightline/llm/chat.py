r"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. Nothing of its inside is used: the prefixes of a conversation are
rendered one after the other, and what an output adds to the one before is the span of the new turn. A probe with a
sentinel in place of the turn's text finds where the text itself lies. A template whose output for a longer prefix does
not begin with its output for the shorter one rewrites history; it is reported, and its texts are located in the final
output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Private-use characters that stand for a turn's text in a probe: the first, then the second so often that no text around holds them.
SENTINEL = "\ue000", "\ue001"

#: The default template's marks: control strings are these with no backslash after the bracket.
_TAIL = r"/?(?:s>|INST\]|TURN[ \]])"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAIL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAIL})")
_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[TURN (?P<role>(?:[^\]\\]|\\.)*)\](?P<other>.*?)\[/TURN\]", re.DOTALL)


def escape(text: str) -> str:
    """One more backslash after the bracket of everything that looks like a control string, escaped or not."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def marked_turns(turns: Turns) -> str:
    """The default template: [INST]..[/INST] for user, <s>..</s> for assistant, [TURN role]..[/TURN] for any other role."""
    out = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST]{body}[/INST]")
        elif role == "assistant":
            out.append(f"<s>{body}</s>")
        else:
            name = role.replace("\\", "\\\\").replace("]", "\\]")
            out.append(f"[TURN {name}]{body}[/TURN]")
    return "".join(out)


def parse_marked(text: str) -> Turns:
    """Turns of a text of the default template, each exactly as it went in."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m["user"] is not None:
            turns.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            turns.append(("assistant", unescape(m["assistant"])))
        else:
            turns.append((re.sub(r"\\(.)", r"\1", m["role"], flags=re.DOTALL), unescape(m["other"])))
        at = m.end()
    return turns


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _place(template: Template, turns: Turns, k: int, output: str) -> tuple[int, int] | None:
    """Where turn k's text lies in `output`, the rendering of `turns`."""
    sentinel = "".join(SENTINEL)
    while sentinel in output:
        sentinel += SENTINEL[1]
    probe = template([*turns[:k], (turns[k][0], sentinel), *turns[k + 1 :]])
    if probe.count(sentinel) != 1:
        return None
    start = probe.index(sentinel)
    end = len(output) - (len(probe) - start - len(sentinel))
    return (start, end) if end >= start and output[:start] == probe[:start] and output[end:] == probe[start + len(sentinel) :] else None


def render(template: Template, turns: Turns) -> tuple[str, list[dict], int | None]:
    """The formatted text, a span per turn, and the first turn whose arrival rewrote earlier output (None: none did).

    A span holds turn, role, start, end (of what the turn added) and text_start, text_end (None where the template
    drops or changes the text). All places are code points of the final text.
    """
    before, rewrote, spans = template([]) if turns else "", None, []
    for k, (role, _) in enumerate(turns):
        output = template(turns[: k + 1])
        shared = len(before) if output.startswith(before) else _common(before, output)
        if shared < len(before) and rewrote is None and k:
            rewrote = k
        place = _place(template, turns[: k + 1], k, output)
        spans.append({"turn": k, "role": role, "start": shared, "end": len(output), "text_start": place and place[0], "text_end": place and place[1]})
        before = output
    if rewrote is not None:
        for k, span in enumerate(spans):
            place = _place(template, turns, k, before)
            span |= {"text_start": place and place[0], "text_end": place and place[1]}
            span |= {"start": span["text_start"], "end": span["text_end"]}
    return before, spans, rewrote


_SPANS = "array<struct<turn:long,role:string,start:long,end:long,text_start:long,text_end:long>>"


def format_conversations(rows: DataFrame, template: Template = marked_turns, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, rewrote (turn number or null).

    Turns are ordered by turn (null first), equal ones by role and text; null roles and texts count as empty; repeated
    rows are turns of their own. The result has a conversation in one row, so a task holds one at a time.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([(n, pa.string() if n == "role" else pa.int64()) for n in ("turn", "role", "start", "end", "text_start", "text_end")]))
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                turns = [(t["role"], t["text"]) for t in own["turns"].to_pylist()[0]]
                text, spans, rewrote = render(template, turns)
                yield pa.RecordBatch.from_arrays([own["conv_id"], pa.array([text], pa.string()), pa.array([spans], kind), pa.array([rewrote], pa.int64())], ["conv_id", "formatted", "spans", "rewrote"])

    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = rows.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.mapInArrow(run, f"conv_id long, formatted string, spans {_SPANS}, rewrote long")


def read_back(formatted: DataFrame) -> DataFrame:
    """From the output of the default template alone: its turns, and the assistant texts under the loss mask.

    An assistant turn whose text has no place in the output raises an error: it must not be left out of the mask unseen.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch["formatted"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                turns = parse_marked(text)
                digest = hashlib.sha256()
                for role, body in turns:
                    digest.update(f"{role}\n{body}\n".encode())
                if any(s["role"] == "assistant" and s["text_start"] is None for s in spans):
                    raise ValueError("an assistant text has no place in the output")
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == "assistant")
                for col, v in zip(cols, (len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
