"""Line dedup with two Bloom filters: hashes seen once, and hashes seen twice.

Every line's key becomes a 128-bit digest, once per document. Tasks turn digests into bit positions; the positions of a slice of
the hash space meet in one task, which sets them in a filter of what was seen once and, where they were set already, in a second
filter of what was seen twice. A digest that the second filter doesn't hold is in one document only and goes no further. The few
others are suspects: only they are shuffled by digest, counted exactly, and given the first document that holds them.

Both filters grow with the number of lines (16 bits each), in slices of at most 2 MB. Where all slices of the second filter
fit in `filter_bytes` they are sent to the digests; beyond that the digests are routed to the slices, 32 bytes a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm import common
from lexivane.session import written

LEAST_POINTS = 10
BITS_PER_LINE = 16
SLICE_BITS = 1 << 24
FLUSH = 200_000  # digests that a task turns into positions at once
FILTER_BYTES = 64 << 20
GONE_BYTES = 32 << 20
HOT_SHARE = 1000  # fewer keys than this hold more than a HOT_SHARE-th of all suspects each
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
_ROUTED = pa.schema([("slice", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_SUSPECT = "d1 long, d2 long, _row long, _doc long"


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """The key of every line: stripped of ASCII blanks, A-Z lower-cased; None where it has fewer than least code points."""
    keys: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_BLANK).lower()
        long_enough = len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least
        keys.append(key if long_enough else None)
    return keys


def _digests(docs: DataFrame, least: int) -> DataFrame:
    """(_row, _doc, digests, n): the distinct digests of every row's keys, 16 bytes each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            found = []
            for text in common.as_bytes(batch.column(2)):
                keys = dict.fromkeys(line_keys(text, least))
                keys.pop(None, None)
                found.append(b"".join(map(xxhash.xxh3_128_digest, keys)))
            n = pa.array([len(x) // 16 for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary()), n], names=["_row", "_doc", "digests", "n"]
            )

    return docs.select("_row", "_doc", "text").mapInArrow(work, "_row long, _doc long, digests binary, n long")


class Filter:
    """Where a digest's two bits lie: in one of n slices of a power of two of bits."""

    def __init__(self, n_digests: int, tasks: int):
        bits = BITS_PER_LINE * n_digests
        self.slices = max(1, tasks, -(-bits // SLICE_BITS))
        self.bits = 1 << max(13, (-(-bits // self.slices) - 1).bit_length())

    def slice_of(self, d1: np.ndarray) -> np.ndarray:
        return ((d1 >> np.uint64(32)) * np.uint64(self.slices) >> np.uint64(32)).astype(np.int64)

    def places(self, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.bits - 1)
        return (d2 & mask).astype(np.int64), (d2 >> np.uint64(32) & mask).astype(np.int64)

    def held(self, packed: np.ndarray, d2: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
        """Whether both bits of a digest are set in the packed slices, of which the digest's own starts at byte base."""
        first, second = self.places(d2)
        bit = [packed[base + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8) & 1 for at in (first, second)]
        return (bit[0] & bit[1]).astype(bool)


def _split(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(data, np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _runs(slices: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slice, from, to) of sorted slice numbers."""
    heads = np.flatnonzero(np.diff(slices, prepend=-1))
    for a, b in zip(heads, [*heads[1:], len(slices)]):
        yield int(slices[a]), int(a), int(b)


def _routed(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        columns = zip(*rows[i : i + 256])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROUTED)], schema=_ROUTED)


def _twice_seen(digests: DataFrame, shape: Filter) -> DataFrame:
    """(slice, data): the filter of what was seen twice, packed."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            d1, d2 = _split(b"".join(held))
            order = np.lexsort((d2, d1))
            d1, d2 = d1[order], d2[order]
            again = np.zeros(len(d1), bool)
            again[1:] = (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
            rows = []
            # d1 orders the slices too. A digest that this task has met before goes into both filters.
            for kind, mine in ((0, ~again), (1, again)):
                first, second = shape.places(d2[mine])
                for s, a, b in _runs(shape.slice_of(d1[mine])):
                    rows.append((s, kind, np.unique([first[a:b], second[a:b]]).astype(np.uint32).tobytes()))
            yield from _routed(rows)

        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(data)
                size += len(data)
                if size >= 16 * FLUSH:
                    yield from flush()
                    held.clear()
                    size = 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, part = np.zeros(shape.bits, bool), np.zeros(shape.bits, bool), None
        for batch in batches:
            for part, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(data, np.uint32)
                if kind:
                    twice[at] = True
                else:
                    twice[at[once[at]]] = True
                    once[at] = True
        if part is not None:
            yield from _routed([(part, 0, np.packbits(twice).tobytes())])

    kinds = "slice int, kind int, data binary"
    dealt = digests.select("digests").mapInArrow(positions, kinds).repartitionById(shape.slices, F.col("slice"))
    return dealt.mapInArrow(merge, kinds)


def _suspects_by_sending(digests: DataFrame, twice: DataFrame, shape: Filter) -> DataFrame:
    packed = np.zeros((shape.slices, shape.bits // 8), np.uint8)
    for row in twice.select("slice", "data").toLocalIterator():
        packed[row["slice"]] = np.frombuffer(row["data"], np.uint8)
    sent = digests.sparkSession.sparkContext.broadcast(packed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = sent.value.reshape(-1)
        for batch in batches:
            d1, d2 = _split(b"".join(batch.column(2).to_pylist()))
            hit = np.flatnonzero(shape.held(flat, d2, shape.slice_of(d1) * (shape.bits // 8)))
            row = pa.array(np.repeat(np.arange(batch.num_rows), batch.column(3).to_numpy())[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array(d1[hit].view(np.int64)), pa.array(d2[hit].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row)],
                names=["d1", "d2", "_row", "_doc"],
            )

    return digests.select("_row", "_doc", "digests", "n").mapInArrow(work, _SUSPECT)


def _suspects_by_routing(digests: DataFrame, twice: DataFrame, shape: Filter) -> DataFrame:
    """Digests go to the slice of the filter that they would set, behind the slice itself."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = _split(b"".join(batch.column(2).to_pylist()))
            row = np.repeat(np.arange(batch.num_rows), batch.column(3).to_numpy())
            doc = batch.column(1)
            told = np.empty((len(d1), 5), np.int64)
            told[:, 0], told[:, 1] = d1.view(np.int64), d2.view(np.int64)
            told[:, 2] = batch.column(0).to_numpy()[row]
            told[:, 3] = doc.fill_null(0).to_numpy()[row]
            told[:, 4] = doc.is_null().to_numpy(zero_copy_only=False)[row]
            order = np.argsort(d1, kind="stable")
            told = told[order]
            yield from _routed([(s, 1, told[a:b].tobytes()) for s, a, b in _runs(shape.slice_of(d1[order]))])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(shape.bits // 8, np.uint8)
        for batch in batches:
            for _, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    packed = np.frombuffer(data, np.uint8)
                    continue
                told = np.frombuffer(data, np.int64).reshape(-1, 5)
                told = told[shape.held(packed, told[:, 1].view(np.uint64))]
                if len(told):
                    columns = [pa.array(np.ascontiguousarray(told[:, i])) for i in range(3)]
                    columns.append(pa.array(told[:, 3], mask=told[:, 4] != 0))
                    yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "_row", "_doc"])

    routed = digests.select("_row", "_doc", "digests", "n").mapInArrow(route, "slice int, kind int, data binary")
    both = twice.select("slice", "kind", "data").unionByName(routed)
    return both.repartitionById(shape.slices, F.col("slice")).sortWithinPartitions("kind").mapInArrow(test, _SUSPECT)


def _gone(suspects: DataFrame) -> DataFrame:
    """(_row, d1, d2): what each row has to lose: digests that an earlier document holds as well.

    A null document comes after all others. Keys that hold a large share of the suspects are few and are sent; the
    others are joined.
    """
    suspects = written(suspects, "suspects")
    key = ["d1", "d2"]
    counted = suspects.groupBy(*key).agg(
        F.min("_doc").alias("first"), F.max("_doc").alias("last"), F.max(F.isnull("_doc")).alias("nameless"), F.count(F.lit(1)).alias("held")
    )
    repeated = written(counted.filter("last > first or nameless and first is not null").select(*key, "first", "held"), "repeated")
    often = repeated.filter(F.col("held") * HOT_SHARE > suspects.count())
    rare = repeated.filter(F.col("held") * HOT_SHARE <= suspects.count())
    hot = suspects.join(F.broadcast(often), key)  # fewer than HOT_SHARE keys
    cold = suspects.join(F.broadcast(often.select(*key)), key, "left_anti").join(rare, key)
    return hot.unionByName(cold).filter("_doc is null or _doc > first").select("_row", *key)


def deduped(
    docs: DataFrame,
    keep: list[str],
    least: int = LEAST_POINTS,
    filter_bytes: int = FILTER_BYTES,
    gone_bytes: int = GONE_BYTES,
) -> DataFrame:
    """The columns in keep with n_lines, dropped (numbers of lines from 0) and kept (text) of every row of (doc_id, text).

    A line's key is the line without ASCII blanks at both ends, A-Z lower-cased. A key of at least `least` code points that
    two documents hold stays, with all its lines, in the smallest doc_id that holds it and goes from the others. Rows
    with one doc_id are one document; rows without are one too, behind all others. A null or empty text is one empty
    line. Repeated rows get the same answer; other columns may have any name.
    """
    common.small_batches(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(keep))]
    docs = docs.select(
        *[F.col(k).alias(n) for k, n in zip(keep, names)],
        F.xxhash64("doc_id", "text").alias("_row"),
        F.col("doc_id").cast("long").alias("_doc"),
        "text",
    )
    digests = written(_digests(docs, least), "digests")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = Filter(digests.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], tasks)
    twice = written(_twice_seen(digests, shape), "twice")
    by = _suspects_by_sending if shape.slices * shape.bits // 8 <= filter_bytes else _suspects_by_routing
    found = _gone(by(digests, twice, shape)).distinct()
    lists = found.groupBy("_row").agg(F.collect_list(F.struct("d1", "d2")).alias("_gone"))
    lists = written(lists.select("_row", F.col("_gone.d1").alias("_d1"), F.col("_gone.d2").alias("_d2")), "gone")
    size = lists.agg(F.coalesce(F.sum(16 * F.size("_d1") + 64), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(lists) if size <= gone_bytes else lists, "_row", "left")
    return _cut(joined, names, least).select(*[F.col(n).alias(k) for k, n in zip(keep, names)], "n_lines", "dropped", "kept")


def _cut(joined: DataFrame, names: list[str], least: int) -> DataFrame:
    kinds = dict(joined.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            n_lines, dropped, kept = [], [], []
            for text, d1, d2 in zip(common.as_bytes(batch.column("text")), batch.column("_d1").to_pylist(), batch.column("_d2").to_pylist()):
                n_lines.append(text.count(b"\n") + 1)
                if not d1:
                    dropped.append([])
                    kept.append(text)
                    continue
                pairs = np.array([d1, d2], np.int64).T
                gone = {row.tobytes() for row in pairs}
                keys = line_keys(text, least)
                out = [i for i, k in enumerate(keys) if k is not None and xxhash.xxh3_128_digest(k) in gone]
                lines = text.split(b"\n")
                for i in reversed(out):
                    del lines[i]
                dropped.append(out)
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    pa.array(n_lines, pa.int64()),
                    pa.array(dropped, pa.list_(pa.int32())),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=[*names, "n_lines", "dropped", "kept"],
            )

    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "n_lines long, dropped array<int>, kept string"])
    return joined.select(*names, "text", "_d1", "_d2").mapInArrow(work, schema)
