r"""Chat formatting by a template that is only ever called, never looked into.

``render_spans`` renders successive prefixes of a conversation and compares consecutive outputs: what a longer prefix adds
is the new turn's span. A template whose output for the longer prefix does not begin with the shorter one's rewrites
history; its spans are unknown then. Inside a turn's span the text is located by rendering the prefix again with probe
texts in its place.

The template here writes ``<|im_start|>role\ntext<|im_end|>\n`` and escapes: in texts and roles a backslash is doubled and
``<|`` becomes ``<\|``; in roles a line feed becomes ``\n``. So a control string never occurs inside a text, and
``unescape`` restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def chat_template(turns: list[Turn]) -> str:
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


class Prefixes:
    """Successive prefixes of a conversation, rendered, and what each adds to the one before."""

    def __init__(self, render: Template):
        self.render, self.turns, self.begin, self.output = render, [], 0, render([])

    def add(self, turn: Turn) -> str | None:
        """What the next turn adds to the output; None when the output of the turns before it has changed."""
        self.turns.append(turn)
        longer, before = self.render(self.turns), self.output
        self.begin, self.output = len(before), longer
        return longer[self.begin :] if longer.startswith(before) else None

    def instead(self, turn: Turn) -> str:
        """What this turn would add in the place of the last one."""
        return self.render([*self.turns[:-1], turn])[self.begin :]

    def whole(self) -> str:
        return self.output


class TurnByTurn(Prefixes):
    """The same for a template known to write each turn by itself: what a turn adds is rendered alone, compared with nothing."""

    def __init__(self, render: Template):
        self.render, self.parts, self.begin, self.end = render, [render([])], 0, len(render([]))

    def add(self, turn: Turn) -> str:
        self.parts.append(self.render([turn]))
        self.begin, self.end = self.end, self.end + len(self.parts[-1])
        return self.parts[-1]

    def instead(self, turn: Turn) -> str:
        return self.render([turn])

    def whole(self) -> str:
        return "".join(self.parts)


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def render_spans(
    turns: list[Turn], render: Template, wanted: Callable[[str], bool], turn_by_turn: bool = False
) -> tuple[str, list[tuple[int, int, int, int] | None]]:
    """The whole output, and per turn (span start, span end, text start, text end).

    The text places are those of the span's end (an empty text) for turns whose role is not wanted. From the first turn on
    at which the template rewrote history, spans are None for it and all turns before it; those after it are located again.
    ``turn_by_turn`` says that the template writes each turn by itself, which spares rendering the turns before it.
    """
    spans: list[tuple[int, int, int, int] | None] = []
    shown = (TurnByTurn if turn_by_turn else Prefixes)(render)
    for i, (role, text) in enumerate(turns):
        added = shown.add((role, text))
        if added is None:
            spans = [None] * (i + 1)
            continue
        begin, end = shown.begin, shown.begin + len(added)
        place = (end, end)
        if wanted(role):
            a, b, none = (shown.instead((role, probe)) for probe in ("a", "b", ""))
            head = _common(a, b)
            place = (begin + head, end - (len(none) - head))
        spans.append((begin, end, *place))
    return shown.whole(), spans


def parse(output: str) -> Iterator[Turn]:
    """Turns read back from an output of ``chat_template``."""
    at = 0
    while at < len(output):
        head = output.index("\n", at)
        stop = output.index(END, head + 1)
        yield unescape(output[at + len(START) : head]), unescape(output[head + 1 : stop])
        at = stop + len(END) + 1


def format_rows(rows: list[Turn], template: Template | None = None, turn_by_turn: bool = False) -> dict:
    """One conversation: formatted text, loss spans (text of assistant turns), whether history was rewritten."""
    output, spans = render_spans(rows, template or chat_template, lambda role: role == "assistant", turn_by_turn)
    loss = [(s[2], s[3]) for s, (role, _) in zip(spans, rows, strict=True) if s is not None and role == "assistant"]
    return {"formatted": output, "loss": loss, "rewritten": any(s is None for s in spans)}


def digest(output: str, loss: list[tuple[int, int]]) -> dict:
    """What the output says when it is read back."""
    turns_sha, n = hashlib.sha256(), 0
    for role, text in parse(output):
        turns_sha.update(f"{role}\n{text}\n".encode())
        n += 1
    loss_sha, chars = hashlib.sha256(), 0
    for a, b in loss:
        text = unescape(output[a:b])
        loss_sha.update(text.encode())
        chars += len(text)
    return {
        "n_turns": n, "turns_sha256": turns_sha.hexdigest(), "loss_chars": chars, "loss_sha256": loss_sha.hexdigest(),
        "formatted_chars": len(output),
    }


_FORMATTED = "conv_id bigint, formatted string, loss array<struct<begin: bigint, stop: bigint>>, rewritten boolean"
_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _by_conversation(turns: DataFrame, fn: Callable[[list[Turn]], dict], schema: str) -> DataFrame:
    """Streams each partition, sorted by conversation and turn, one conversation in memory at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def flush(done: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(done, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, done, size = None, [], [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if rows and conv != current:
                    done.append({"conv_id": current, **fn(rows)})
                    size += sum(len(t) for _, t in rows)
                    rows = []
                    if size > 4 << 20:
                        yield flush(done)
                        done, size = [], 0
                current = conv
                rows.append((role or "", text or ""))
        if rows:
            done.append({"conv_id": current, **fn(rows)})
        if done:
            yield flush(done)

    ordered = (
        turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)


def format_conversations(turns: DataFrame, template: Template | None = None, turn_by_turn: bool = False) -> DataFrame:
    """conv_id, formatted, loss spans (begin, stop; code points) and whether the template rewrote history.

    Any ``template`` will do: a callable from turns to text, rendered for every prefix of a conversation. Where it rewrites history, the
    turns up to there have no loss span. Without one the template of this module is used, its prefixes are rendered and compared
    like any other's. Work goes with the square of a conversation's turns; ``turn_by_turn`` is for callers who know that
    their template writes each turn by itself and want no prefixes compared.
    Turns stand by (turn, role, text), nulls first; repeated rows are repeated turns; null role or text is empty; rows
    without conv_id form one conversation of their own. A conversation is one unit of work: its digest is sequential.
    """

    def fn(rows: list[Turn]) -> dict:
        got = format_rows(rows, template, turn_by_turn)
        return got | {"loss": [{"begin": a, "stop": b} for a, b in got["loss"]]}

    return _by_conversation(turns, fn, _FORMATTED)


def format_digests(turns: DataFrame) -> DataFrame:
    """The same conversations, every prefix rendered and compared, formatted and read back: counts and digests."""

    def fn(rows: list[Turn]) -> dict:
        got = format_rows(rows)
        return digest(got["formatted"], got["loss"])

    return _by_conversation(turns, fn, _DIGEST)
