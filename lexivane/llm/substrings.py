"""Substring dedup by relative Lempel-Ziv parsing against hashed reference blocks.

Every slice of a task's documents is a reference block. Its index holds the hash of each run of `window` words that
starts in it. The indexes of all blocks meet by hash range, so a step of the parse (one window) is looked up in every
block at once. A document is then factored greedily: a factor starts at the first window found elsewhere and goes on as
long as the next step is found too. Where one factor ends and another may begin, the windows across the
boundary are steps of their own, so a match that straddles it is not missed. Factors become the duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm import common, recurrence
from lexivane.session import written

WINDOW = 35
SPANS_BYTES = 32 << 20  # spans of all documents up to this size are sent to the texts, beyond it both are shuffled


def _windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, places, counts, at = [], [], [], 0
    for lo, hi in common.text_slices(texts):
        words = common.Words(texts[lo:hi])
        found, first = words.grams(window)
        hashes.append(found)
        places.append(np.arange(len(found)) + np.repeat(words.first[:-1] - first[:-1], np.diff(first)) + at)
        counts.append(words.counts())
        at += int(words.first[-1])
    return np.concatenate(counts), np.concatenate(hashes), np.concatenate(places)


def factors(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy factors (first word, words) from the sorted numbers of words at which a known step starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(run[0]), len(run) + window - 1) for run in np.split(starts, cut)]


def _factored(keys: np.ndarray, counts: np.ndarray, places: np.ndarray, hashes: np.ndarray, window: int) -> pa.RecordBatch:
    """The factors of a block's documents, from the places at which a step known elsewhere starts."""
    places = np.unique(places)
    ends = np.cumsum(counts, dtype=np.int64)
    which, head = np.unique(np.searchsorted(ends, places, "right"), return_index=True)
    begin = (ends - counts)[which]
    spans = [
        np.array(factors(mine.astype(np.int64) - start, window), np.uint32).tobytes()
        for mine, start in zip(np.split(places, head[1:]), begin)
    ]
    return pa.RecordBatch.from_arrays([pa.array(keys[which]), pa.array(spans, pa.binary())], names=["_key", "spans"])


def _mask(n_words: int, spans: list[tuple[int, int]]) -> np.ndarray:
    gone = np.zeros(n_words + 1, np.int64)
    for start, length in spans:
        gone[start] += 1
        gone[min(start + length, n_words)] -= 1
    return np.cumsum(gone[:-1]) > 0


def _spans(docs: DataFrame, window: int) -> DataFrame:
    """Written table (_key, spans) of the documents with factors: pairs of first word and words, as 32-bit numbers."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = common.partitions_for(docs, total, recurrence.BYTES_PER_RANGE)
    index = recurrence.build(docs, parts, lambda texts: _windows(texts, window), named=False)
    return written(recurrence.recurring(index, lambda *found: _factored(*found, window), "_key long, spans binary", named=False), "spans")


def removed(docs: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """The columns in keep with n_words, n_removed, spans and kept of every row of (doc_id, text).

    Words lie between ASCII blanks and are compared unchanged. A word goes if it lies in a run of window words that also
    starts anywhere else, in the same document too; runs are judged on the input. spans are the factors (start, length)
    in words; kept is the rest, joined by one space. Null or blank text: no words, kept is empty. Copies of a document
    are repeats of one another, so all of them go. Rows may repeat in every column.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select(
        *[F.col(k).alias(f"_c{i}") for i, k in enumerate(keep)],
        "text",
        F.xxhash64("doc_id", "text").alias("_key"),
    )
    spans_ = _spans(docs.select("_key", "text"), window).dropDuplicates(["_key"])  # rows that repeat have equal spans
    size = spans_.agg(F.coalesce(F.sum(F.octet_length("spans") + 64), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(spans_) if size <= SPANS_BYTES else spans_, "_key", "left").drop("_key")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    names = [f"_c{i}" for i in range(len(keep))]
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            n_words, n_removed, all_spans, kept = [], [], [], []
            for text, found in zip(common.as_bytes(batch.column("text")), batch.column("spans").to_pylist()):
                words = text.split()
                spans = np.frombuffer(found or b"", np.uint32).reshape(-1, 2).tolist()
                gone = _mask(len(words), spans) if spans else None
                left = words if gone is None else [w for w, g in zip(words, gone) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                all_spans.append([{"start": s, "length": n} for s, n in spans])
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(all_spans, span),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=[*names, "_words", "_removed", "_spans", "_kept"],
            )

    schema = ", ".join([f"{n} {kinds[n]}" for n in names])
    out = joined.mapInArrow(
        work, f"{schema}, _words long, _removed long, _spans array<struct<start:bigint,length:bigint>>, _kept string"
    )
    return out.select(
        *[F.col(n).alias(k) for n, k in zip(names, keep)],
        F.col("_words").alias("n_words"),
        F.col("_removed").alias("n_removed"),
        F.col("_spans").alias("spans"),
        F.col("_kept").alias("kept"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of every text.

    A changed text is what is left, joined by single spaces, and n_chars follows it. A document of which nothing is left
    goes; one that had no words before stays as it is.
    """
    names = docs.columns
    plain = docs.select([F.col(n).alias(f"d{i}") for i, n in enumerate(names)] + ["doc_id", "text"])
    cut = removed(plain, [f"d{i}" for i in range(len(names))])
    cut = cut.filter("n_words = 0 OR n_removed < n_words")
    out = []
    for i, n in enumerate(names):
        was = F.col(f"d{i}")
        if n == "text":
            was = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(was)
        elif n == "n_chars":
            was = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(was)
        out.append(was.alias(n))
    return cut.select(*out)


