"""Benchmark decontamination with spaced seeds.

A seed is the hash of six words at fixed offsets; the words between are not looked at. Seeds of the benchmark
and of the documents meet, and around each hit the two texts are laid side by side and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm import common

# Any 13 words of which at most two differ hold a hit of at least one of these masks.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8), (0, 1, 2, 5, 6, 8))
OVERLAP = 13  # words compared side by side; all words of an item that has fewer
LEAST_WORDS = 5  # a shorter benchmark item can't be told from chance and matches nothing
SLICE_BYTES = 4 << 20  # benchmark text sent to the tasks at a time
_FILTER_BITS = 22
_STEPS = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(OVERLAP)], np.uint64)
_TO_BLANK = bytes(i if chr(i).isalnum() or i >= 128 else 32 for i in range(256))


def _normal(text: str | None) -> bytes:
    """Lower-cased text with every ASCII sign but letters and digits as a blank."""
    return (text or "").lower().encode().translate(_TO_BLANK)


def _spaced(hashes: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    n = max(0, len(hashes) - mask[-1])
    total = np.full(n, salt, np.uint64)
    for step, at in zip(_STEPS, mask):
        total += step * hashes[at : at + n]
    return common.mix(total)


def agreeing(size: int) -> int:
    """How many of size words side by side must agree: all below 7, all but one below OVERLAP, all but two of OVERLAP."""
    return size - 2 * size // OVERLAP


def masks_of(size: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which one at least hits wherever size words side by side agree in enough places."""
    if size == OVERLAP:
        return MASKS
    if agreeing(size) == size:
        return (tuple(range(size)),)
    return tuple(tuple(i for i in range(size) if i != ignored) for ignored in range(size))


class Seeds:
    """The seeds of some benchmark items, sorted, with the place of each; the items' words."""

    def __init__(self, items: list[tuple[int, str]]):
        words = common.Words([_normal(t) for _, t in items])
        self.ids, self.words, self.first = [i for i, _ in items], words.hashes, words.first
        counts = words.counts()
        sizes = np.minimum(counts, OVERLAP)
        self.masks = [(OVERLAP, m) for m in MASKS]
        self.masks += [(int(n), m) for n in np.unique(sizes[(sizes >= LEAST_WORDS) & (sizes < OVERLAP)]) for m in masks_of(int(n))]
        seeds, places = [], []
        for salt, (size, mask) in enumerate(self.masks):
            found = _spaced(self.words, mask, salt)
            item = np.searchsorted(self.first, np.arange(len(found)), "right") - 1
            fits = (np.arange(len(found)) + mask[-1] < self.first[item + 1]) & (sizes[item] == size)
            seeds.append(found[fits])
            places.append(np.flatnonzero(fits))
        seeds, places = np.concatenate(seeds), np.concatenate(places)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.places = seeds[order], places[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first word in the text, first word in the item, words, agreeing words), the best per text and item."""
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        normal = [_normal(t) for t in texts]
        for lo, hi in common.text_slices(normal):
            words = common.Words(normal[lo:hi])
            for doc, item, diagonal in self._meetings(words):
                found = self._compare(words, doc, item, diagonal)
                if found and found[3] > best.get((lo + doc, item), (0, 0, 0, 0))[3]:
                    best[lo + doc, item] = found
        return [(doc, item, *found) for (doc, item), found in sorted(best.items())]

    def _meetings(self, words: common.Words) -> list[tuple[int, int, int]]:
        """Distinct (text, item, place in text less place in item) that share a seed."""
        docs, items, shifts = [], [], []
        for salt, (_, mask) in enumerate(self.masks):
            found = _spaced(words.hashes, mask, salt)
            at = np.flatnonzero(self.filter[found >> np.uint64(64 - _FILTER_BITS)]) if len(self.seeds) else []
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.seeds, found[at], "left"), np.searchsorted(self.seeds, found[at], "right")
            at, lo, width = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            doc = np.searchsorted(words.first, at, "right") - 1
            inside = at + mask[-1] < words.first[doc + 1]
            at, lo, width, doc = at[inside], lo[inside], width[inside], doc[inside]
            place = self.places[np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())]
            item = np.searchsorted(self.first, place, "right") - 1
            doc, at = np.repeat(doc, width), np.repeat(at, width)
            docs.append(doc)
            items.append(item)
            shifts.append((at - words.first[doc]) - (place - self.first[item]))
        if not docs:
            return []
        rows = np.unique(np.stack([np.concatenate(docs), np.concatenate(items), np.concatenate(shifts)], 1), axis=0)
        return [tuple(map(int, r)) for r in rows]

    def _compare(self, words: common.Words, doc: int, item: int, shift: int) -> tuple[int, int, int, int] | None:
        a = words.hashes[words.first[doc] : words.first[doc + 1]]
        b = self.words[self.first[item] : self.first[item + 1]]
        begin, end = max(0, -shift), min(len(b), len(a) - shift)
        size = min(OVERLAP, len(b))
        if end - begin < size:
            return None
        same = np.concatenate([[0], np.cumsum(a[begin + shift : end + shift] == b[begin:end])])
        good = np.flatnonzero(same[size:] - same[:-size] >= agreeing(size))
        if not len(good):
            return None
        lo, hi = int(good[0]), int(good[-1]) + size
        return begin + lo + shift, begin + lo, hi - lo, int(same[hi] - same[lo])


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in slices of bounded size, read one partition at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size > SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_agreeing): the best overlap of each document row and item.

    Words are lower-cased runs between ASCII signs and blanks. A row is given where OVERLAP words side by side agree in
    all but two; a shorter item of at least 7 words must occur whole with all words but one, one of at least LEAST_WORDS
    unchanged. Clean documents give no row; nor do null or empty texts. Every slice of the benchmark meets every whole text; documents aren't shuffled.
    """
    schema = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_agreeing long"
    names = ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_agreeing"]
    common.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for items in _slices(benchmark):
        sent = spark.sparkContext.broadcast(Seeds(items))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = sent.value
            for batch in common.sliced(batches):
                ids, found = batch.column(0).to_pylist(), seeds.hits(batch.column(1).to_pylist())
                columns = [[ids[f[0]] for f in found], [seeds.ids[f[1]] for f in found]]
                columns += [[f[k] for f in found] for k in range(2, 6)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        parts.append(source.mapInArrow(work, schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, that overlap with no benchmark item."""
    common.small_batches(docs.sparkSession)
    names = docs.columns
    for items in _slices(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Seeds(items))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in common.sliced(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in sent.value.hits(batch.column("_text").to_pylist())]] = False
                yield batch.filter(pa.array(keep)).drop_columns(["_text"])

        shadow = docs.select(*[F.col(n).alias(f"_c{i}") for i, n in enumerate(names)], F.col("text").alias("_text"))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shadow.schema.fields[:-1])
        out = shadow.mapInArrow(work, kinds)
        docs = out.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
    return docs


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that overlap with the benchmark."""
    return clean(docs, common.table(spark, sf_dir, "benchmark"))
