"""Operator 9: chat formatting by incremental black-box rendering.

A template is any function of a list of ``{"role", "content"}`` to a string;
nothing is assumed about how it works. Each conversation is rendered once per
prefix of its turns, and consecutive renderings are compared: what turn i added
lies between their common prefix and common suffix. Where the two do not cover
the earlier rendering whole, the template has *rewritten history* at turn i, and
spans that reach beyond the common prefix are void. Spans that survive all later
turns are positions in the final text (training masks need exactly those). A
template may refuse a prefix, say one without a user's turn: comparison goes on
from the last prefix it rendered, and turns that only came in together have no span
of their own.

One shuffle brings the turns of a conversation together; rendering is a map over
conversations. Prefix rendering is quadratic in the turns of one conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[dict[str, str]]], str]


def chatml(messages: list[dict[str, str]]) -> str:
    return "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages)


def inst(messages: list[dict[str, str]]) -> str:
    """Bracketed instructions; a system turn opens the next user turn."""
    out, system = "", ""
    for m in messages:
        if m["role"] == "system":
            system = f"<<SYS>>\n{m['content']}\n<</SYS>>\n\n"
        elif m["role"] == "assistant":
            out += f" {m['content']} </s>"
        else:
            out += f"<s>[INST] {system}{m['content']} [/INST]"
            system = ""
    return out


def system_last(messages: list[dict[str, str]]) -> str:
    """System text moves before the latest user turn: each new user turn rewrites history."""
    system = "\n".join(m["content"] for m in messages if m["role"] == "system")
    users = [i for i, m in enumerate(messages) if m["role"] == "user"]
    out = ""
    for i, m in enumerate(messages):
        if m["role"] != "system":
            lead = f"{system}\n\n" if system and users and i == users[-1] else ""
            out += f"[{m['role']}]{lead}{m['content']}[/{m['role']}]"
    return out


TEMPLATES: dict[str, Template] = {"chatml": chatml, "inst": inst, "system_last": system_last}


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:  # a[:low] is common, a[:high] is not
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def locate(render: Template, messages: list[dict[str, str]]) -> tuple[str, list[tuple[int, int] | None], list[bool]]:
    """(final text, span of each turn or None, whether each turn rewrote history).

    A prefix that ``render`` raises on is passed over; the empty one then counts as
    empty text. Raises what ``render`` does on the whole conversation.
    """

    def tried(n: int) -> str | None:
        try:
            return render(messages[:n])
        except Exception:  # noqa: BLE001 - a template may refuse a conversation that is not over
            if n == len(messages) > 0:
                raise
            return None

    before = tried(0) or ""
    spans: list[tuple[int, int] | None] = []
    rewrote: list[bool] = []
    waiting = 0
    for i in range(len(messages)):
        after = tried(i + 1)
        if after is None:
            waiting += 1
            spans.append(None)
            rewrote.append(False)
            continue
        head = common_prefix(before, after)
        tail = 0
        if head < len(before):
            tail = min(common_prefix(before[::-1], after[::-1]), len(before) - head, len(after) - head)
        rewritten = head + tail < len(before)
        spans = [s if s is not None and s[1] <= head else None for s in spans]
        spans.append(None if rewritten or waiting else (head, len(after) - tail))
        rewrote.append(rewritten)
        before, waiting = after, 0
    return before, spans, rewrote


_SPAN = "array<struct<turn: bigint, role: string, start: int, end: int, rewrites: boolean>>"


def format_chats(turns: DataFrame, templates: Mapping[str, Template] = TEMPLATES) -> DataFrame:
    """(conv_id, template, text, rewrites, spans) of every conversation and template.

    ``spans`` has a row per turn in order: turn, role, start and end in ``text``
    (characters; NULL where the template leaves no stable place for it) and
    whether adding the turn rewrote what was rendered before. Order is by turn,
    NULL turns last, ties by role, then text; repeated rows are turns of their own. A NULL text
    is empty and a NULL role is ``user``. Rows with a NULL conv_id are left out; an
    empty table gives no rows; other columns are ignored. A template that fails
    on a whole conversation gives NULL text and no spans for it; one that fails on a
    part of it only leaves turns without a place, as ``locate`` says.
    """
    templates = dict(templates)
    order = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    chats = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), order.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, ms in zip(pdf["conv_id"], pdf["ms"]):
                messages = [{"role": m["role"], "content": m["content"]} for m in ms]
                for name, render in templates.items():
                    try:
                        text, spans, rewrote = locate(render, messages)
                    except Exception:  # noqa: BLE001 - a template may refuse a conversation
                        out.append((conv, name, None, None, []))
                        continue
                    rows = [{"turn": None if m["turn"] is None or m["turn"] != m["turn"] else int(m["turn"]), "role": m["role"], "start": s[0] if s else None, "end": s[1] if s else None, "rewrites": w} for m, s, w in zip(ms, spans, rewrote)]
                    out.append((conv, name, text, any(rewrote), rows))
            yield pd.DataFrame(out, columns=["conv_id", "template", "text", "rewrites", "spans"])

    return chats.mapInPandas(run, f"conv_id long, template string, text string, rewrites boolean, spans {_SPAN}")
