r"""Chat formatting by columnar byte assembly.

Every turn becomes header + escaped text + footer:

    user       [INST] text [/INST]
    assistant  <s>text</s>
    system     <<SYS>>\ntext\n<</SYS>>
    other      <<ROLE>>role<</ROLE>>text<</TURN>>

Escaping puts a backslash after each ``<`` and ``[`` and doubles backslashes, so that no control string is left
whole inside a text, and ``unescape`` gives the text back. The loss mask is a list of code point spans that cover the
escaped text of assistant turns.

Turns of a conversation are brought together by ``repartition`` on the conversation id and sorted by
(turn, role, text); rows of equal turn are all kept. For a batch of conversations, segment lengths, cumulative offsets
and scatter indices are computed in numpy and the bytes are copied into one preallocated buffer, which becomes the
Arrow string column.

Cases: null text is empty, null role is the empty role (an "other" turn), null conv_id is a conversation of its own,
an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices, string_array, utf8_view
from .workspace import partitions

# The control strings of the template.
HEADERS = {"user": "[INST] ", "assistant": "<s>", "system": "<<SYS>>\n"}
FOOTERS = {"user": " [/INST]", "assistant": "</s>", "system": "\n<</SYS>>"}
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<<ROLE>>", "<</ROLE>>", "<</TURN>>"

_TURN = re.compile(
    r"\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|<<SYS>>\n(.*?)\n<</SYS>>|<<ROLE>>(.*?)<</ROLE>>(.*?)<</TURN>>", re.DOTALL
)
_ESCAPED = re.compile(r"([<\[])\\|\\\\")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "\\", text)


def frame(role: str) -> tuple[str, str]:
    """Header and footer of a role."""
    if role in HEADERS:
        return HEADERS[role], FOOTERS[role]
    return f"{ROLE_OPEN}{escape(role)}{ROLE_CLOSE}", TURN_CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for m in _TURN.finditer(formatted):
        user, assistant, system, role, other = m.groups()
        if user is not None:
            turns.append(("user", unescape(user)))
        elif assistant is not None:
            turns.append(("assistant", unescape(assistant)))
        elif system is not None:
            turns.append(("system", unescape(system)))
        else:
            turns.append((unescape(role), unescape(other)))
    return turns


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Format conversations whose turns lie in a row.

    first: index of the first turn of every conversation. Returns the formatted strings and, for every assistant turn,
    its conversation's position and its loss span in code points of that string.
    """
    raw, at = utf8_view(texts)
    coded = roles.fill_null("").dictionary_encode()
    names, code = coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
    frames = [tuple(x.encode() for x in frame(name)) for name in names]
    head = np.array([len(h) for h, _ in frames], dtype=np.int64)[code]
    foot = np.array([len(f) for _, f in frames], dtype=np.int64)[code]
    # Backslash, < and [ take one byte more.
    special = (raw == 0x5C) | (raw == 0x3C) | (raw == 0x5B)
    before = np.concatenate([[0], np.cumsum(special)])
    body = np.diff(at) + np.diff(before[at])
    ends = np.cumsum(head + body + foot)
    start = ends - (head + body + foot)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    shift = start + head - at[:-1] - before[at[:-1]]
    place = np.arange(len(raw), dtype=np.int64) + before[:-1] + np.repeat(shift, np.diff(at))
    out[place] = raw
    out[place[special] + 1] = 0x5C
    for k, (h, f) in enumerate(frames):
        rows = np.flatnonzero(code == k)
        for piece, where in ((h, start[rows]), (f, ends[rows] - len(f))):
            out[where[:, None] + np.arange(len(piece))] = np.frombuffer(piece, dtype=np.uint8)
    bounds = np.concatenate([start[first], ends[-1:]]).astype(np.int64)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    loss = np.flatnonzero(code == names.index("assistant")) if "assistant" in names else np.zeros(0, np.int64)
    conv = np.searchsorted(first, loss, side="right") - 1
    zero = points[bounds[conv]]
    return (
        string_array(out, bounds),
        conv,
        points[start[loss] + head[loss]] - zero,
        points[ends[loss] - foot[loss]] - zero,
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_start array<long>, loss_end array<long>), one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            conv = table.column(0).combine_chunks()
            first = _starts(conv)
            formatted, of, lo, hi = assemble(table.column(1).combine_chunks(), table.column(2).combine_chunks(), first)
            cut = np.searchsorted(of, np.arange(len(first) + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    conv.take(pa.array(first)),
                    pa.array(np.diff(np.concatenate([first, [len(conv)]])), pa.int64()),
                    formatted,
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(lo, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(hi, pa.int64())),
                ],
                names=["conv_id", "n_turns", "formatted", "loss_start", "loss_end"],
            )

        for batch in slices(batches, 2048):
            # A conversation may go on in the next batch: its turns wait until another one begins.
            begins = int(_starts(batch.column(0))[-1])
            if held and (begins or held[-1].column(0)[-1] != batch.column(0)[0]):
                cut = begins
                if cut:
                    held.append(batch.slice(0, cut))
                yield finish(held)
                held = [batch.slice(cut)]
            elif begins:
                yield finish([batch.slice(0, begins)])
                held = [batch.slice(begins)]
            else:
                held.append(batch)
        if held:
            yield finish(held)

    n = partitions(turns.sparkSession)
    rows = turns.select("conv_id", "role", "text", "turn").repartition(n, "conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"conv_id {kind}, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"
    )


def _starts(conv: pa.Array) -> np.ndarray:
    """Index of the first row of every run of equal ids; null equals null."""
    valid = np.asarray(conv.is_valid())
    ids = np.asarray(conv.fill_null(0) if pa.types.is_integer(conv.type) else conv.fill_null(""))
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])
    return np.flatnonzero(new)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars) parsed from the formatted strings and their loss spans.

    turns: role, newline, text, newline of every turn; loss: the unescaped text under the loss mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows = []
            for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                rows.append((len(turns), "".join(f"{role}\n{said}\n" for role, said in turns), loss, len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["conv_id", "n_turns", "turns", "loss", "formatted_chars"],
            )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "formatted", "loss_start", "loss_end")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns string, loss string, formatted_chars long")


def digests(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
