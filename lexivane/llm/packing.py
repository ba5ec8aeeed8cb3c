"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. Every window of the output gives each queue a quota: its target share plus the deficit it
carries from the windows before. Quotas are whole tokens and a queue's documents are cut where its quota ends.
A queue's running credit at any window follows in closed form from the shares, so tasks need not take turns: token j of a
queue of weight w is due at (2j + 1) / w, and windows take tokens in that order. A queue that runs dry leaves
its part to the others. A window's cut is bracketed by the sum of all shares, which bends only where a queue runs dry, and the few tokens
between are put in order; so its cost grows with the number of queues and not with its square. All comparisons that decide are in whole
numbers, so every task finds the same cuts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm.common import sliced, small_batches
from lexivane.session import new_path

SEQUENCE = 2048
WINDOW_SEQUENCES = 64
END_ID = 1
WEIGHT = (1 << 31) - 1  # of the largest share
CUTS_BYTES = 32 << 20  # window cuts a task keeps
STARTS_BYTES = 32 << 20  # queue offsets of the tasks up to this size are sent, beyond it they are joined
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50_256  # the added token of byte_bpe_50k.json


class Tokenizer:
    """Ids of the byte-level BPE of 50,257 ids."""

    def __init__(self):
        import public_tokenizers as public
        import tiktoken

        lines = open(public.path("byte_bpe_50k.tiktoken"), "rb")
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end_of_text = np.array([END_OF_TEXT_ID], np.uint16).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 16-bit numbers. The added token is one id wherever it stands, and divides the text."""
        if END_OF_TEXT in text:
            return self.end_of_text.join(map(self._plain, text.split(END_OF_TEXT)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), np.uint16).tobytes()


def tokenised(docs: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Written table (doc_id, queue, n, ids, task, within): each document's ids with end_id, and where it starts in
    its task's part of its queue. Null text gives end_id alone; a null source is a queue like any other."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source"), F.lit("")).alias("queue"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = Tokenizer(), np.array([end_id], np.uint16).tobytes()
        task, filled = TaskContext.get().partitionId(), {}
        for batch in sliced(batches):
            ids = [tokenizer.encode(t or "") + end for t in batch.column("text").to_pylist()]
            within = []
            for queue, data in zip(batch.column("queue").to_pylist(), ids):
                within.append(filled.get(queue, 0))
                filled[queue] = within[-1] + len(data) // 2
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("queue"),
                    pa.array([len(x) // 2 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(np.full(len(ids), task, np.int64)),
                    pa.array(within, pa.int64()),
                ],
                names=["doc_id", "queue", "n", "ids", "task", "within"],
            )

    out = named.mapInArrow(work, "doc_id long, queue string, n long, ids binary, task long, within long")
    path = new_path(docs.sparkSession, "tokens")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


class Schedule:
    """Which tokens of which queue fill which window. Weights are below 2 ** 31."""

    def __init__(self, sizes: list[int], weights: list[int], window: int):
        self.sizes, self.weights, self.window = np.array(sizes, np.int64), np.array(weights, np.int64), window
        self.total = int(self.sizes.sum())
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.most_held = max(8, min(4096, CUTS_BYTES // (16 * max(1, len(sizes)))))
        # Tokens that are due by a time, but for half a token a queue: straight lines between the times at which queues run dry.
        dry = 2 * self.sizes / self.weights
        order = np.argsort(dry)
        speed = np.cumsum(self.weights[order][::-1])[::-1] / 2
        self.times = np.concatenate([[0.0], dry[order]])
        self.filled = np.concatenate([[0.0], np.cumsum(np.diff(self.times) * speed)])
        self.slack = len(sizes) + 2  # more than those halves and the rounding of the lines

    def rank(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many tokens come before the given ones; rows: (queue, place), both may be arrays."""
        mine = self.weights[queue]
        whole, rest = np.divmod(2 * place + 1, mine)
        later = np.arange(len(self.sizes))[None, :] >= queue[:, None]
        whole = np.minimum(whole[:, None], (2 * self.sizes // self.weights + 1)[None, :])  # a queue is dry by then
        before = (whole * self.weights + (rest[:, None] * self.weights - later) // mine[:, None] + 1) // 2
        return np.minimum(before, self.sizes[None, :]).sum(axis=1)

    def window_of(self, queue: int, place: int) -> int:
        """The window of a token."""
        about = float(np.interp((2 * place + 1) / self.weights[queue], self.times, self.filled))
        window = int((about - self.slack) // self.window)
        if window == (about + self.slack) // self.window:
            return window
        return int(self.rank(np.array([queue]), np.array([place]))[0]) // self.window

    def cut(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Per queue the tokens used up before the window, and where its quota starts in the output."""
        if window not in self.held:
            if len(self.held) >= self.most_held:
                self.held.clear()
            self.held[window] = (used := self._used(window)), self._starts(window, used)
        return self.held[window]

    def _used(self, window: int) -> np.ndarray:
        goal = min(window * self.window, self.total)
        early, late = np.interp([goal - self.slack, goal + self.slack], self.filled, self.times)
        used = np.clip((early * self.weights + 1) // 2 - 1, 0, self.sizes).astype(np.int64)
        most = np.clip((late * self.weights + 1) // 2 + 1, 0, self.sizes).astype(np.int64)
        open_ = most - used
        queue = np.repeat(np.arange(len(open_)), open_)
        place = np.arange(len(queue)) + np.repeat(used - np.cumsum(open_) + open_, open_)
        # When each is due: whole part, and the fraction to 62 bits, which tells any two apart.
        weight = self.weights[queue]
        whole, rest = np.divmod(2 * place + 1, weight)
        upper, rest = np.divmod(rest << 31, weight)
        first = np.lexsort((queue, upper << 31 | (rest << 31) // weight, whole))[: goal - int(used.sum())]
        return used + np.bincount(queue[first], minlength=len(used))

    def _starts(self, window: int, used: np.ndarray) -> np.ndarray:
        quota = self._used(window + 1) - used
        return window * self.window + np.cumsum(quota) - quota

    def pieces(self, queue: int, begin: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(start in the document, tokens, place in the output) of tokens begin.. of a queue."""
        at = begin
        while at < begin + length:
            window = self.window_of(queue, at)
            used, starts = self.cut(window)
            stop = min(begin + length, int(self.cut(window + 1)[0][queue]))
            yield at - begin, stop - at, int(starts[queue] + at - used[queue])
            at = stop


class Sequences:
    """Full sequences, then the rest in sequences of powers of two, so that nothing is padded."""

    def __init__(self, total: int, size: int):
        self.size, self.full = size, total // size
        rest, at, self.ends = total % size, self.full * size, []
        for bit in reversed(range(size.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                self.ends.append(at)

    def cut(self, place: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before, tokens, sequence, offset) of a run of the output."""
        done, tail = 0, self.full * self.size
        while done < length:
            at = place + done
            if at < tail:
                sequence, begin, end = at // self.size, at // self.size * self.size, (at // self.size + 1) * self.size
            else:
                k = int(np.searchsorted(self.ends, at, "right"))
                sequence, begin, end = self.full + k, self.ends[k - 1] if k else tail, self.ends[k]
            n = min(length - done, end - at)
            yield done, n, sequence, at - begin
            done += n


def _weights(totals: dict[str, int], targets: dict[str, float] | None) -> list[int]:
    share = totals if targets is None else {q: targets.get(q, 0.0) for q in totals}
    most = max(share.values()) or 1
    return [max(1, round(share[q] / most * WEIGHT)) for q in totals]


def pack(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    size: int = SEQUENCE,
    window_sequences: int = WINDOW_SEQUENCES,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents (doc_id, source, text) in gapless sequences.

    One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    source, window_id. targets gives the queues' proportions, by default their part of all tokens; a queue without one
    gets the least share that can be held. Proportions hold in every window of window_sequences sequences while a queue lasts. Only
    the last, partial sequence is divided, into powers of two. Empty table: no rows. Rows that repeat are
    packed each on their own.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    tokens = tokenised(docs, end_id)
    parts = tokens.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()}
    before = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("queue", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if parts.count() * 64 <= STARTS_BYTES:
        starts = F.broadcast(starts)
    placed = tokens.join(starts, ["queue", "task"]).select(
        "doc_id", "queue", "n", "ids", (F.col("first") + F.col("within")).alias("begin")
    )
    names = list(totals)
    number = {q: i for i, q in enumerate(names)}
    plan = list(totals.values()), _weights(totals, targets) if totals else [], window_sequences * size
    fields = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source", "window_id"]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(*plan)
        sequences = Sequences(schedule.total, size)
        for batch in sliced(batches):
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.uint16).astype("<u4")
                for start, length, place in schedule.pieces(number[r["queue"]], r["begin"], r["n"]):
                    for done, n, sequence, offset in sequences.cut(place, length):
                        at = start + done
                        piece = ids[at : at + n].tobytes()
                        rows.append((r["doc_id"], at, n, piece, r["n"], sequence, offset, r["queue"], place // schedule.window))
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string, window_id long"
    return placed.mapInArrow(work, schema)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, with the crc32 of their ids."""
    return pieces_with_crc(docs)


def pieces_with_crc(docs: DataFrame) -> DataFrame:
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "window_id"
    )
