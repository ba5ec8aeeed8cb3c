"""Helpers shared by the training-data operators: column checks, words and their hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.session import sliced, small_batches  # noqa: F401

SLICE_BYTES = 1 << 20

# Odd 64-bit multipliers of the hashes. Any other odd numbers would do; the same ones must be used everywhere.
_BYTE_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def third(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3: 1 marks held-out rows. A null id counts as 0, so it is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)), F.lit(0))


def partitions_for(df: DataFrame, n_bytes: int, per_task: int) -> int:
    """Tasks so that each gets about per_task bytes, and never fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per_task))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text makes a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Hashes of the words of some texts, one after another; words lie between the six ASCII blanks.

    hashes: one per word; first: where each text's words start, with the total at the end.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        buffer = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        blank = _SPACE[buffer]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        lengths = ends - starts
        at = np.cumsum([0, *map(len, texts)])[: len(texts)] + np.arange(len(texts))
        self.first = np.append(np.searchsorted(starts, at), len(starts))
        if not len(starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        steps = np.cumprod(np.full(int(lengths.max()), _BYTE_STEP, np.uint64), dtype=np.uint64)
        begin = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        value = (buffer[~blank].astype(np.uint64) + np.uint64(1)) * steps[inside]
        self.hashes = mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of size words inside a text, and where each text's runs start."""
        return grams(self.hashes, self.first, size)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size numbers from each place on, by doubling; places too near the end are left out."""
    total, width = None, 0
    power, step, wide = hashes, _WORD_STEP, 1
    while True:
        if size & wide:
            if total is None:
                total = power
            else:
                shift = np.uint64(pow(_WORD_STEP, width, 1 << 64))
                n = max(0, len(hashes) - width - wide + 1)
                total = total[:n] + shift * power[width : width + n]
            width += wide
        if width == size:
            return mix(total)
        n = max(0, len(power) - wide)
        power = power[:n] + np.uint64(step) * power[wide : wide + n]
        step = step * step % (1 << 64)
        wide *= 2


def grams(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    places = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    return run_hashes(hashes, size)[places], begin
