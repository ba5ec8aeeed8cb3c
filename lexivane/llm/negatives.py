"""Hard negatives by coordinate pruning over length buckets, after LEMP.

Rows are laid in buckets of falling length. A bucket holds its vectors and, for every coordinate, the order of its rows
by that coordinate of the vector at unit length. For an inner product of at least t, a row of a bucket must reach a cosine of
t / (anchor's length x bucket's greatest length); so each of the anchor's largest ("focus") coordinates leaves a range of
feasible values. The narrowest range is cut out of its sorted list, the other ranges thin it, and what is left is verified
exactly. A bucket too short for any anchor's t is passed over whole.

t starts as the score that the anchors themselves offer to one another, and rises as better rows are found. Anchors
go to the tasks in blocks of bounded size; a task sends on at most k rows for each of an anchor's windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm import common, vectors
from lexivane.operators.topk import Best
from lexivane.session import written

BUCKET = 2048
FOCUS = 4
BLOCK_BYTES = 4 << 20  # of anchors that go to every task at once
TASK_BYTES = 8 << 20
LARGEST = 1 << 28
_NO_ID = np.iinfo(np.int64).max
_PARTS = ("ids", "labels", "x", "orders")
_FIELDS = "longest double, n int, " + ", ".join(f"{p} binary" for p in _PARTS)
_HITS = "anchor long, slot int, id long, score long"


def integer_rows(df: DataFrame, scale: int = 256) -> DataFrame:
    """(id, label, x, square) of the rows of (vec_id, embedding, label) that take part, all of the commonest width.

    Rows with a null label, a null or empty vector, or a null or non-finite entry take no part. x is floor(scale * entry),
    held at 2^28 in size so that scores stay exact; square is its squared length. A null id is the largest long.
    """
    held = F.transform("embedding", lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    rows = df.filter(vectors.usable("embedding") & F.col("label").isNotNull()).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), vectors.scaled(held, 1).alias("x")
    )
    rows = rows.filter(F.size("x") == vectors.common_width(rows, "x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    return rows.withColumn("square", square)


def _unit(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    return x / np.maximum(length, 1e-300)[:, None]


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x.astype(float), x.astype(float)))


def buckets(rows: DataFrame, width: int, bucket: int = BUCKET) -> DataFrame:
    """Written rows of (id, label, x, square) as buckets of falling length with their sorted coordinate lists."""
    tasks = common.partitions_for(rows, rows.count() * 12 * max(1, width), TASK_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(size: int) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for at in range(0, table.num_rows, size):
                part = table.slice(at, size)
                x = vectors.matrix(part["x"].combine_chunks(), width, np.int32)
                length = _lengths(x)
                order = np.argsort(_unit(x, length), axis=0, kind="stable").T.astype(np.uint16)
                packed = [part["id"].to_numpy(), part["label"].to_numpy(), x, np.ascontiguousarray(order)]
                columns = [pa.array([float(length.max())]), pa.array([len(x)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in packed)]
                yield pa.RecordBatch.from_arrays(columns, names=["longest", "n", *_PARTS])

        for batch in common.sliced(batches, bucket):
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * bucket:
                yield from flush(bucket)
        if held:
            yield from flush(bucket)

    order = [F.desc("square"), F.asc("id")]
    dealt = rows.select("id", "label", "x", "square").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(pack, _FIELDS), "buckets")


@dataclass
class Block:
    """Anchors with windows of scores: at each of an anchor's slots, k rows with lo <= score <= hi are sought."""

    key: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    same: bool  # seek rows of the anchor's label, or of all others


class _Search:
    def __init__(self, block: Block, k: int, focus: int):
        self.block, self.slots = block, block.lo.shape[1]
        self.best = Best(block.lo.size, k)
        self.length = _lengths(block.x)
        self.unit = _unit(block.x, self.length)
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :focus]
        self.most = int(np.abs(block.x).max(initial=0))

    def least(self) -> np.ndarray:
        """The score that a row must reach to matter to any slot of an anchor."""
        floor = self.best.floor.reshape(self.block.lo.shape)
        lo = np.where(self.block.lo > self.block.hi, np.inf, np.maximum(self.block.lo, floor))
        return lo.min(axis=1)

    def scores(self, a: np.ndarray, x: np.ndarray) -> np.ndarray:
        q = self.block.x[a]
        if vectors.fits_double(max(1, self.most), max(1, int(np.abs(x).max(initial=0))), x.shape[1]):
            return (q.astype(float) @ x.astype(float).T).astype(np.int64)
        return q.astype(np.int64) @ x.astype(np.int64).T

    def offer(self, a: np.ndarray, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        block = self.block
        fits = ((labels[rows] == block.label[a]) == block.same) & (ids[rows] != block.id[a])
        a, rows, score = a[fits], rows[fits], score[fits]
        for slot in range(self.slots):
            inside = (score >= block.lo[a, slot]) & (score <= block.hi[a, slot])
            if inside.any():
                self.best.add(a[inside] * self.slots + slot, ids[rows[inside]], score[inside])

    def bucket(self, longest: float, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, orders: np.ndarray) -> None:
        least = self.least()
        reach = self.length * longest
        alive = np.flatnonzero(least <= reach * (1 + 1e-9) + 1e-9)
        if not len(alive):
            return
        cosine = np.clip(least[alive] / np.maximum(reach[alive], 1e-9), 0.0, 1.0)
        focus = self.focus[alive]
        at = np.take_along_axis(self.unit[alive], focus, axis=1)
        spread = np.sqrt(np.maximum((1 - at**2) * (1 - cosine**2)[:, None], 0.0)) + 1e-9
        low, high = at * cosine[:, None] - spread, at * cosine[:, None] + spread
        # Cosines above the least one are feasible too: an anchor's own value lies between its bounds.
        limit = cosine[:, None]
        low[(at <= -limit) | (limit <= 0)] = -2.0
        high[(at >= limit) | (limit <= 0)] = 2.0
        unit = _unit(x, _lengths(x))
        first, last = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            mine = focus == f
            values = unit[orders[f], f]
            first[mine], last[mine] = np.searchsorted(values, low[mine]), np.searchsorted(values, high[mine], "right")
        narrow = (last - first).argmin(axis=1)
        count = (last - first)[np.arange(len(alive)), narrow]
        # Where no range leaves out much, the whole bucket is verified at once.
        wide = count * 2 > len(ids)
        for part in np.array_split(alive[wide], max(1, -(-int(wide.sum()) * len(ids) // 2_000_000))):
            if len(part):
                score = self.scores(part, x)
                i, rows = np.nonzero(score >= least[part, None])
                self.offer(part[i], rows, score[i, rows], ids, labels)
        for i in np.flatnonzero(~wide & (count > 0)):
            j = narrow[i]
            rows = orders[focus[i, j], first[i, j] : last[i, j]].astype(np.int64)
            values = unit[rows][:, focus[i]]
            rows = rows[((values >= low[i]) & (values <= high[i])).all(axis=1)]
            if len(rows):
                score = self.scores(alive[i : i + 1], x[rows])[0]
                good = score >= least[alive[i]]
                self.offer(np.full(int(good.sum()), alive[i]), rows[good], score[good], ids, labels)

    def hits(self) -> pa.RecordBatch:
        query, ids, score = self.best.compact()
        columns = [self.block.key[query // self.slots], (query % self.slots).astype(np.int32), ids, score.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "slot", "id", "score"])


def search(index: DataFrame, block: Block, k: int, focus: int = FOCUS) -> DataFrame:
    """(anchor, slot, rank, id, score): for each window the first k rows, highest score first, ties by smaller id."""
    sent = index.sparkSession.sparkContext.broadcast(vars(block))  # a plain dict, as executors have no copy of the class
    width = block.x.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Search(Block(**sent.value), k, focus)
        for batch in common.sliced(batches, 1):
            n = batch.column("n")[0].as_py()
            ids, labels, x, orders = (batch.column(p)[0].as_buffer() for p in _PARTS)
            found.bucket(
                batch.column("longest")[0].as_py(),
                np.frombuffer(ids, np.int64),
                np.frombuffer(labels, np.int64),
                np.frombuffer(x, np.int32).reshape(n, width),
                np.frombuffer(orders, np.uint16).reshape(width, n),
            )
        yield found.hits()

    hits = index.mapInArrow(work, _HITS)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _raised(lo: np.ndarray, block: Block, found: DataFrame, k: int) -> np.ndarray:
    """Lower bounds of the windows, raised to the k-th score that some rows offer already."""
    lo = lo.copy()
    place = {int(key): i for i, key in enumerate(block.key)}
    for row in found.filter(F.col("rank") == k).select("anchor", "slot", "score").collect():  # one a window at most
        lo[place[row["anchor"]], row["slot"]] = max(lo[place[row["anchor"]], row["slot"]], row["score"])
    return lo


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    bucket: int = BUCKET,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors among rows.

    rows and anchors come from integer_rows. An anchor's positives are its first rows of the same label, its negatives for a
    positive the first rows of other labels with low * positive <= 100 * score <= high * positive. Rows that carry the
    anchor's id are no partners of it. Anchors that are equal in id, label and vector ask once; other repeated rows are
    found as often as they occur. Scores are exact; ties go to the smaller id, a missing id is the largest and comes back as null.
    """
    common.small_batches(rows.sparkSession)
    rows = written(rows, "rows")
    asked = written(anchors.dropDuplicates(["id", "label", "x"]).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n_anchors = asked.count()
    spark = rows.sparkSession
    if not n_anchors:
        kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], kinds)
    width = asked.select(F.size("x")).first()[0]
    index, own = buckets(rows, width, bucket), buckets(asked, width, bucket)
    n_blocks = -(-n_anchors * (8 * width + 64 * positives * negatives) // block_bytes)
    numbered = written(asked.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks))), "blocks")
    done = [_mined(index, own, numbered.filter(F.col("block") == b), width, positives, negatives, low, high) for b in range(n_blocks)]
    found = reduce(DataFrame.unionByName, [d for d in done if d is not None])
    null = lambda c: F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)
    return found.select(null("anchor_id"), null("positive_id"), "rank", null("negative_id"), "positive_score", "negative_score")


def _mined(index: DataFrame, own: DataFrame, anchors: DataFrame, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame | None:
    table = anchors.select("anchor", "id", "label", "x").toArrow()
    if not table.num_rows:
        return None
    x = vectors.matrix(table["x"].combine_chunks(), width, np.int32)
    end = np.int64(1 << 62)
    n = len(x)
    block = Block(*(table[c].to_numpy() for c in ("anchor", "id", "label")), x, np.full((n, 1), -end), np.full((n, 1), end), True)
    block.lo = _raised(block.lo, block, search(own, block, positives), positives)
    nearest = written(search(index, block, positives), "positives")
    lo, hi = np.full((n, positives), end), np.full((n, positives), -end)
    place = {int(key): i for i, key in enumerate(block.key)}
    for row in nearest.select("anchor", "rank", "score").collect():  # positives of one block of anchors
        at, slot, score = place[row["anchor"]], row["rank"] - 1, row["score"]
        lo[at, slot], hi[at, slot] = -(-low * score // 100), high * score // 100
    block = Block(block.key, block.id, block.label, x, lo, hi, False)
    block.lo = _raised(lo, block, search(own, block, negatives), negatives)
    hard = search(index, block, negatives).select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    nearest = nearest.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return written(hard.join(nearest, ["anchor", "slot"]).join(names, "anchor"), "mined")
