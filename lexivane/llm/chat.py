"""Chat formatting with a grammar round trip.

    conversation = turn*        turn = "<|im_start|>" role "\n" text "<|im_end|>" "\n"

A turn is rendered, parsed back by the grammar and compared. If the parse is another one, what conflicts is escaped and the turn
is tried again until both agree. Between "<" and "|" the parser takes one backslash away, and in a role it reads
backslash-n as a line end, so every text and role has a rendering that parses to itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import sliced, small_batches

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"
_ESCAPED = re.compile(r"<\\(\\*)\|")
_CONTROL = re.compile(r"<(\\*)\|")
_ROLE = re.compile(r"\\(n|\\)")


def _unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def _read_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else "\\", _unescape(role))


def _write_role(role: str) -> str:
    return _escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, first and last code point of the raw text) of every turn; None if the grammar does not fit."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        stop = rendered.find(END, line + 1)
        inner = rendered.find(START, at + 1)
        if line < 0 or stop < 0 or not rendered.startswith("\n", stop + len(END)) or at < inner < stop:
            return None
        turns.append((_read_role(rendered[at + len(START) : line]), _unescape(rendered[line + 1 : stop]), line + 1, stop))
        at = stop + len(END) + 1
    return turns


def render(role: str, text: str) -> str:
    """The turn as it is, or with its conflicting parts escaped, so that it parses to itself."""
    for r, t in ((role, text), (role, _escape(text)), (_write_role(role), _escape(text))):
        out = f"{START}{r}\n{t}{END}\n"
        found = parse(out)
        if found and len(found) == 1 and found[0][:2] == (role, text):
            return out
    raise ValueError("a turn that can't be rendered")  # the last form always parses to itself


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, rendered, loss_start, loss_end) of every row of (conv_id, turn, role, text).

    The renderings of a conversation, by turn, one after another are its training text; loss_start and loss_end are the
    code points of the rendering that are learnt, from start to before end, both null outside assistant turns. Null role or text
    reads as empty. Rows are formatted where they are.
    """
    small_batches(turns.sparkSession)
    source = turns.select("conv_id", "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out, start, end = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                out.append(render(role or "", text or ""))
                _, _, lo, hi = parse(out[-1])[0]
                start.append(lo if role == LEARNT_ROLE else None)
                end.append(hi if role == LEARNT_ROLE else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(out, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["conv_id", "turn", "rendered", "loss_start", "loss_end"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(
        work, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, rendered string, loss_start bigint, loss_end bigint"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its training text says: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Texts are parsed out of the renderings and unescaped. A task reads its conversations turn by turn in order and holds a batch at
    a time, so a conversation may be of any length. Turns with the same number follow one another by rendering; a null conv_id is a
    conversation of its own.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in sliced(batches):
            yield from zip(*[batch.column(n).to_pylist() for n in ("conv_id", "rendered", "loss_start", "loss_end")])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for conv, turns in groupby(rows(batches), key=lambda r: r[0]):
            every, learnt, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, rendered, start, end in turns:
                total += len(rendered)
                for role, text, _, _ in parse(rendered):
                    every.update(f"{role}\n{text}\n".encode())
                    n += 1
                if start is not None:
                    text = _unescape(rendered[start:end])
                    learnt.update(text.encode())
                    chars += len(text)
            held.append((conv, n, every.hexdigest(), chars, learnt.hexdigest(), total))
            if len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    kinds[0] = pa.int64()
    together = formatted.withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id")
    ordered = together.sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.mapInArrow(
        work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
