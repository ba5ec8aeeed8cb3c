"""Which hashes occur more than once in a whole table: blocks of rows are indexed by hash range and meet range by range.

A row of the index holds, for one block and one range, the sorted hashes with the places they come from, packed into a few bytes
each. A hash that a block holds several times is known to recur: its places stay with the block's own row, and only the hash goes
to the range, once per block, however often it occurs. So no range grows with a frequent hash. Answers go back
to the blocks, where the rows' keys are.

Blocks are named by the keys of their rows, so rows must come in the same order when a task runs again, as those of files do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm import common

BLOCK_BYTES = 6 << 20
BYTES_PER_RANGE = 10 << 20  # text whose hashes one task compares
_BINARY = ("keys", "counts", "hashes", "places", "twice")
_FIELDS = "block long, part int, known boolean, " + ", ".join(f"{n} binary" for n in _BINARY)
_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("known", pa.bool_()), *[(n, pa.binary()) for n in _BINARY]])


def _packed(sorted_hashes: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte planes apart: the upper planes are mostly zero and compress."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _planes(places: np.ndarray) -> bytes:
    return np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _placed(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _block_rows(keys: list, counts: np.ndarray, found: np.ndarray, places: np.ndarray, parts: int, named: bool) -> Iterator[dict]:
    if not len(found):
        return
    order = np.argsort(found, kind="stable")
    found, places = found[order], places[order].astype(np.uint32)
    head = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    size = np.diff(np.append(head, len(found)))
    single = np.repeat(size == 1, size)
    name = np.array([len(found), *keys], np.int64).view(np.uint64)
    block = int(common.mix(common.run_hashes(name, len(name))).view(np.int64)[0])
    many, where = found[~single], places[~single]
    yield {
        "block": block,
        "part": block % parts,
        "known": True,
        "keys": np.array(keys, np.int64).tobytes(),
        "counts": counts.astype(np.uint32).tobytes(),
        "hashes": _packed(many) if named else b"",
        "places": _planes(where),
    }
    once, where, twice = found[single], places[single], found[head[size > 1]]
    width = (1 << 64) // parts + 1
    cuts = np.array([min(i * width, (1 << 64) - 1) for i in range(1, parts)], np.uint64)
    a = [0, *np.searchsorted(once, cuts), len(once)]
    b = [0, *np.searchsorted(twice, cuts), len(twice)]
    for part in range(parts):
        mine, repeated = slice(a[part], a[part + 1]), slice(b[part], b[part + 1])
        if mine.stop > mine.start or repeated.stop > repeated.start:
            yield {
                "block": block,
                "part": part,
                "known": False,
                "hashes": _packed(once[mine]),
                "places": _planes(where[mine]),
                "twice": _packed(twice[repeated]),
            }


def build(docs: DataFrame, parts: int, hashes_of: Callable, named: bool = True) -> DataFrame:
    """Index rows of (key, text): hashes_of(texts) gives places per text, and all hashes with their place among those.

    With named, the answers need the hashes, else only their places.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = _block_rows(keys, *hashes_of(texts), parts, named)
            while some := list(islice(rows, 16)):
                yield pa.RecordBatch.from_pylist(some, _SCHEMA)
            keys.clear(), texts.clear()

        for batch in common.sliced(batches):
            for key, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1))):
                keys.append(key), texts.append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from flush()
                    size = 0
        if texts:
            yield from flush()

    return docs.mapInArrow(work, _FIELDS).repartitionById(parts, F.col("part"))


def recurring(index: DataFrame, answer: Callable, schema: str, named: bool = True) -> DataFrame:
    """What answer(keys, counts, places, hashes) makes of every block's places whose hash occurs again anywhere."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "keys", "counts", "places", "hashes"]
        kinds = [pa.int64()] + 4 * [pa.binary()]
        blocks: list[int] = []
        once: list[np.ndarray] = []
        twice: list[np.ndarray] = []
        places: list[bytes] = []
        for batch in common.sliced(batches, 16):
            for row in batch.to_pylist():
                if row["known"]:
                    yield pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds)], names=names)
                    continue
                blocks.append(row["block"])
                once.append(_unpacked(row["hashes"]))
                twice.append(_unpacked(row["twice"]))
                places.append(row["places"])
        if not blocks:
            return
        every = np.concatenate([*once, *twice, *twice])
        twice.clear()
        every.sort()
        repeated = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        if not len(repeated):
            return
        for block, hashes, where in zip(blocks, once, places):
            at = np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)
            hit = repeated[at] == hashes
            if hit.any():
                told = [block, None, None, _planes(_placed(where)[hit]), _packed(hashes[hit]) if named else b""]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(told, kinds)], names=names)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.sliced(batches, 16):
            yield from batch.to_pylist()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in groupby(rows_of(batches), key=lambda r: r["block"]):
            rows = list(group)
            own = [r for r in rows if r["keys"] is not None]
            if not own:
                raise RuntimeError(f"block {block} came without its keys: its rows changed order when a task was run again")
            places = np.concatenate([_placed(r["places"]) for r in rows])
            hashes = np.concatenate([_unpacked(r["hashes"]) for r in rows])
            # Tasks that read the very same rows give blocks of one name; the answers hold for each of them.
            for r in own:
                if len(places):
                    yield answer(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.uint32), places, hashes)

    answers = index.mapInArrow(compare, "block long, keys binary, counts binary, places binary, hashes binary")
    dealt = answers.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(gather, schema)
