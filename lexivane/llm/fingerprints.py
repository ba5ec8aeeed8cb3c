"""Document fingerprints: one-permutation MinHash with optimal densification, packed to the low bits of each bin.

Every shingle is hashed once; the upper bits choose its bin, and a bin keeps its smallest value. An empty bin takes the value of a
full one, found by probing bins in an order that depends on the bin and the attempt but not on the text. Of each bin only the low
BITS are kept; equal bits by chance are taken out of the likeness again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm import common

BINS = 512
BITS = 4
SHINGLE = 5
BYTES_PER_TASK = 32 << 20
_STEPS = (16, 256, 8192)


_held: dict[tuple[int, int], np.ndarray] = {}


def _probes(bins: int, attempts: int) -> np.ndarray:
    """Which bins an empty one asks in turn; made once per task."""
    if (bins, attempts) in _held:
        return _held[bins, attempts]
    numbers = np.arange(attempts, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)[None, :]
    _held[bins, attempts] = (common.mix(numbers + np.uint64(1)) % np.uint64(bins)).astype(np.int32)
    return _held[bins, attempts]


def _densified(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill the empty bins of one text from its full ones."""
    bins = len(values)
    if full.all() or not full.any():
        return values
    out, empty = values.copy(), np.flatnonzero(~full)
    for attempts in _STEPS:
        probes = _probes(bins, attempts)[:, empty]
        hit = full[probes]
        first = hit.argmax(axis=0)
        found = hit[first, np.arange(len(empty))]
        out[empty[found]] = values[probes[first, np.arange(len(empty))][found]]
        empty = empty[~found]
        if not len(empty):
            return out
    at = np.flatnonzero(full)  # bins that no attempt filled go to the next full one
    out[empty] = values[at[np.searchsorted(at, empty) % len(at)]]
    return out


def signatures(texts: list[bytes], bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> np.ndarray:
    """Low bits of every bin of every text, one row per text. Texts with fewer than size words are one shingle; without words, none."""
    out = np.zeros((len(texts), bins), np.uint8)
    width = int(bins).bit_length() - 1
    if bins != 1 << width:
        raise ValueError("bins must be a power of two")
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    salts = common.mix(np.arange(1, bins + 1, dtype=np.uint64))
    for lo, hi in common.text_slices(texts, 1 << 19):
        words = common.Words(texts[lo:hi])
        hashes, first = words.grams(size)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        short = [i for i, n in enumerate(words.counts()) if 0 < n < size]
        if short:
            single = [common.run_hashes(words.hashes[words.first[i] : words.first[i + 1]], int(words.first[i + 1] - words.first[i])) for i in short]
            hashes, doc = np.concatenate([hashes, *single]), np.concatenate([doc, short])
        table = np.full((hi - lo) * bins, top, np.uint64)
        place = doc * bins + (hashes >> np.uint64(64 - width)).astype(np.int64)
        np.minimum.at(table, place, hashes & np.uint64((1 << (64 - width)) - 1))
        table = table.reshape(-1, bins)
        full = table != top
        for i in range(hi - lo):
            if full[i].any():
                # Scrambled with the bin, so that bins that borrow one value still differ by chance on their own.
                scrambled = common.mix(_densified(table[i], full[i]) ^ salts)
                out[lo + i] = (scrambled & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return out


def packed(rows: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex text of the rows, bits per bin."""
    if not len(rows):
        return []
    flat = np.unpackbits(rows[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(rows), -1)
    data = np.packbits(flat, axis=1)
    return [r.tobytes().hex() for r in data]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of rows of bins: the share of equal bins, less what chance makes equal.

    some_a and some_b say which texts have words; two without are alike, one without is like no other.
    """
    chance = 1 / (1 << bits)
    estimate = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, estimate, (~some_a & ~some_b).astype(float))


def _ranges(docs: DataFrame) -> tuple[list, list]:
    """Cuts of doc_id into ranges of bounded size, and the first doc_id of every range with rows, by range."""
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    parts = common.partitions_for(docs, total or 0, BYTES_PER_TASK)
    marks = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", marks, 10_000)).first()[0] or [])) if rows else []
    return cuts, [tuple(r) for r in docs.groupBy(_range(cuts).alias("r")).agg(F.min(F.struct("doc_id")).alias("f")).select("r", "f.doc_id").orderBy("r").collect()]


def _range(cuts: list):
    """Number of cuts at or below doc_id; null ids come first."""
    if not cuts:
        return F.lit(0)
    held = F.from_json(F.lit(str([int(c) for c in cuts])), "array<bigint>")
    found = F.aggregate(held, F.lit(0), lambda n, c: n + F.when(F.col("doc_id") >= c, 1).otherwise(0))
    return F.coalesce(found, F.lit(0))


def edited_fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of every row of (doc_id, text) and of its edited text, and how like they are.

    (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next). The edited text has its last
    floor(n_chars / 4) code points replaced by the first as many of the next document by (doc_id, text), after the last by those of
    the first. Null reads as empty; an empty text has a fingerprint of zeros, and one row alone follows itself. Rows move once, to
    ranges of doc_id; each range also gets the first document of the next. A task holds a batch and the row before it.
    """
    common.small_batches(docs.sparkSession, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts, firsts = _ranges(docs)
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema)
    # The first document of a range follows the last one of the range before; the very first follows the very last.
    following = [(first, firsts[i - 1][0], 1 if i else 2) for i, (_, first) in enumerate(firsts)]
    # One row for each range: as many as there are tasks.
    heads = F.broadcast(docs.sparkSession.createDataFrame(following, "first long, r int, after int"))
    copies = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "r", "after")
    dealt = docs.select("doc_id", "text", _range(cuts).alias("r"), F.lit(0).alias("after")).unionByName(copies)
    dealt = dealt.repartition(len(firsts), "r").sortWithinPartitions("r", "after", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: list[dict], following: list[str]) -> pa.RecordBatch:
            texts = [r["text"] for r in rows]
            cut = [len(t) // 4 for t in texts]
            edited = [t[: len(t) - k] + n[:k] for t, k, n in zip(texts, cut, following)]
            data = [[t.encode() for t in group] for group in (texts, edited, following)]
            a, b, c = (signatures(d, bins, bits, size) for d in data)
            some = [np.array([bool(t.strip(b" \t\n\v\f\r")) for t in d], bool) for d in data]
            columns = [
                pa.array([r["doc_id"] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(edited, pa.string()),
                pa.array(packed(a, bits), pa.string()),
                pa.array(packed(b, bits), pa.string()),
                pa.array(likeness(a, b, some[0], some[1], bits)),
                pa.array(likeness(a, c, some[0], some[2], bits)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        waiting: dict | None = None  # the last row so far; the one after it is still to come
        for batch in common.sliced(batches, 500):
            rows, following = [], []
            for row in batch.to_pylist():
                if waiting is not None and (waiting["r"] == row["r"]) and not waiting["after"]:
                    rows.append(waiting)
                    following.append(row["text"])
                waiting = row
            if rows:
                yield judged(rows, following)

    return dealt.mapInArrow(work, schema)
