"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (a regular language, so one left-to-right pass parses it)::

    conversation = turn*
    turn         = "<|im_start|>" role "\\n" text "<|im_end|>\\n"

Texts may hold anything. A rendered turn is reparsed and compared with its source; where they differ the
conflicting content is escaped and the turn rendered again until both are identical. In texts the escape
puts one backslash after the ``<`` of a control string (``<|im_end|>`` becomes ``<\\|im_end|>``, and
``<\\|im_end|>`` becomes ``<\\\\|im_end|>``), which the parser takes away again, so it is a bijection. Roles
escape ``\\``, line feeds and ``<`` in the same demand-driven way.

Defined cases: a null role or text is the empty string; turns are ordered by (turn, role, text), null turns
first; rows with a null conv_id form one conversation whose id is null; an empty table gives no rows. A
conversation of any length is streamed turn by turn through running digests, never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_ROLE_CODES = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_DECODE = re.compile(r"\\([\\nl])")


class GrammarError(ValueError):
    """Formatted text that the grammar doesn't produce."""


def escape_text(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|\2|>", text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return "".join(_ROLE_CODES.get(c, c) for c in role)


def unescape_role(role: str) -> str:
    return _ROLE_DECODE.sub(lambda m: {"\\": "\\", "n": "\n", "l": "<"}[m[1]], role)


def render_raw(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text as it stands in the formatted string) of each turn."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise GrammarError(f"no turn starts at {at}")
        line = formatted.find("\n", at)
        end = formatted.find(END, line + 1)
        if line < 0 or end < 0 or not formatted.startswith("\n", end + len(END)):
            raise GrammarError(f"the turn at {at} doesn't end")
        role, body = formatted[at + len(START) : line], formatted[line + 1 : end]
        if START in role or START in body or END in role:
            raise GrammarError(f"a control string inside the turn at {at}")
        turns.append((unescape_role(role), unescape_text(body), line + 1, end))
        at = end + len(END) + 1
    return turns


def _reparses(formatted: str, role: str, text: str) -> bool:
    try:
        return [x[:2] for x in parse(formatted)] == [(role, text)]
    except GrammarError:
        return False


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn that parses back to (role, text), and how often content was escaped for it (0 to 2)."""
    shown = [(role, text), (role, escape_text(text)), (escape_role(role), escape_text(text))]
    for rounds, (r, t) in enumerate(shown):
        if _reparses(out := render_raw(r, t), role, text):
            return out, rounds
    raise GrammarError("no escaping makes this turn identical")


def _tell(batches: Iterator[pd.DataFrame], row) -> Iterator[pd.DataFrame]:
    """Streams sorted turns; row(conversation state) makes the result row when a conversation ends."""
    state = None
    for batch in batches:
        done = []
        for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if state is None or state["conv_id"] != conv:
                if state is not None:
                    done.append(row(state))
                state = {"conv_id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "escaped": 0}
            formatted, rounds = render_turn(role or "", text or "")
            for r, t, _, _ in parse(formatted):  # what follows comes from the output alone
                state["n"] += 1
                state["turns"].update(f"{r}\n{t}\n".encode())
                if r == "assistant":
                    state["loss"].update(t.encode())
                    state["loss_chars"] += len(t)
            state["chars"] += len(formatted)
            state["escaped"] += rounds > 0
        if done:
            yield pd.DataFrame(done)
    if state is not None:
        yield pd.DataFrame([row(state)])


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long"


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """Turns dealt by conversation and sorted within it; long conversations stream through one task each."""
    kept = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text."""

    def row(s: dict) -> dict:
        return {"conv_id": s["conv_id"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["loss_chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["chars"], "n_escaped": s["escaped"]}

    return sorted_turns(conversations).mapInPandas(lambda batches: _tell(batches, row), DIGEST_SCHEMA)


def format_turns(conversations: DataFrame) -> DataFrame:
    """The formatted text itself, a row per turn (seq from 0 in its conversation): formatted, and loss_start and
    loss_end, the code points of the turn's formatted text under the loss mask (null unless it is an assistant's).
    Joined in order, a conversation's rows are its formatted text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seq = object(), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                seq = seq + 1 if conv == last else 0
                last = conv
                formatted, rounds = render_turn(role or "", text or "")
                r, _, start, end = parse(formatted)[0]
                under = r == "assistant"
                out.append((conv, seq, formatted, start if under else None, end if under else None, rounds > 0))
            frame = pd.DataFrame(out, columns=["conv_id", "seq", "formatted", "loss_start", "loss_end", "escaped"])
            yield frame.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})

    return sorted_turns(conversations).mapInPandas(run, "conv_id long, seq long, formatted string, loss_start long, loss_end long, escaped boolean")
