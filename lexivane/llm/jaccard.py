"""Jaccard join on word n-grams with a token-group matrix.

Similar documents share a group, whose tokens are kept as one union. A document is compared with a group only
if its overlap with the union can reach the threshold; then the group is opened and its members are verified.
Which document meets which group comes from a sparse part of the matrix: only the rarest tokens of a set
are joined, as many as the threshold can spare and SPARE_PERCENT more, and partners must share some of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm import common, recurrence
from lexivane.llm.components import components
from lexivane.session import written

GROUP_MEMBERS = 128
QUERIES_PER_TASK = 256
CELLS = 1 << 22  # counters of token frequency over all documents, 8 MB when sent; a power of two
CELLS_PER_ROW = 1 << 16
SENT_BYTES = 32 << 20  # candidates up to this size are sent to the texts, beyond it both are shuffled
STAR_SALTS = (0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F)  # further orders of tokens by which near copies are brought together
_MORE = [f"least{i + 1}" for i in range(len(STAR_SALTS))]
SPARE_PERCENT = 5  # tokens beyond the shortest prefix: more are joined, but partners must share that many


def text_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, lower-cased; a text with fewer words gives one for all of it."""
    out: list[np.ndarray] = []
    for lo, hi in common.text_slices(texts):
        words = common.Words(texts[lo:hi], lower=True)
        hashes, first = words.grams(size)
        for i, n in enumerate(words.counts()):
            if 0 < n < size:
                at = words.first[i]
                out.append(common.run_hashes(words.hashes[at : at + n], int(n)))
            else:
                out.append(np.unique(hashes[first[i] : first[i + 1]]))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def least_overlap(n, percent: int):
    """Smallest overlap with which a set of n tokens can reach the threshold."""
    return -(-n * percent // 100)


def _log(counts: np.ndarray) -> np.ndarray:
    return np.round(1024 * np.log2(1.0 + counts)).astype(np.uint16)


def token_weights(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """How often the tokens of each of CELLS cells occur in all documents, as 1024 * log2(1 + count), and the weight
    above which a token counts as frequent: twice the mean of the cells.

    The table has one size for any input; tokens that share a cell share its weight. It orders tokens and changes no result.
    """
    cell_bits = np.uint64(64 - CELLS.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.uint32)
        for batch in common.sliced(batches):
            for tokens in text_sets(common.as_bytes(batch.column(0)), size):
                np.add.at(table, tokens >> cell_bits, 1)
        table = np.minimum(table, 255).astype(np.uint8)
        for i in np.flatnonzero(table.reshape(-1, CELLS_PER_ROW).any(axis=1)):
            cells = table[i * CELLS_PER_ROW : (i + 1) * CELLS_PER_ROW].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([cells], pa.binary())], names=["part", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in common.sliced(batches, 16):
            for i, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(i, np.zeros(CELLS_PER_ROW, np.int64))[:] += np.frombuffer(cells, np.uint8)
        for i, n in sums.items():
            row = [pa.array([i], pa.int32()), pa.array([int(n.sum())], pa.int64()), pa.array([_log(n).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=["part", "n", "cells"])

    dealt = docs.select("text").mapInArrow(count, "part int, cells binary").repartition("part")
    weights, total = np.zeros(CELLS, np.uint16), 0
    for i, n, cells in dealt.mapInArrow(add, "part int, n long, cells binary").collect():
        weights[i * CELLS_PER_ROW : (i + 1) * CELLS_PER_ROW] = np.frombuffer(cells, np.uint16)
        total += n
    return weights, int(_log(np.array([max(2 * total / CELLS, 1)]))[0])


def _weight(tokens: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[tokens >> np.uint64(64 - len(weights).bit_length() + 1)]


def _rarest_first(tokens: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return tokens[np.argsort(_weight(tokens, weights), kind="stable")]


def signatures(docs: DataFrame, size: int, hot) -> DataFrame:
    """Per row (doc_id, n, k1, k2, least, least1, ..., common, heat): set size, key of the whole set, its smallest token, and
    its smallest ones in other orders, the smallest of its frequent ones (of all where none is), and how many are frequent.
    Empty sets have null keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, frequent = hot.value
        for batch in common.sliced(batches):
            sets = text_sets(common.as_bytes(batch.column(1)), size)
            empty = np.array([not len(s) for s in sets], bool)
            known = [s[_weight(s, weights) > frequent] for s in sets]

            def least(sets: list[np.ndarray]) -> pa.Array:
                return pa.array([int(_signed(s[:1])[0]) if len(s) else None for s in sets], pa.int64())

            def key(salt: int) -> pa.Array:
                found = [common.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets]
                return pa.array(_signed(np.array(found, np.uint64)), mask=empty)

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    key(0x51ED270B),
                    key(0x2545F4914F6CDD1D),
                    least(sets),
                    *(least([common.mix(s ^ np.uint64(salt)).min(keepdims=True) if len(s) else s for s in sets]) for salt in STAR_SALTS),
                    least([k if len(k) else s for k, s in zip(known, sets)]),
                    pa.array([len(k) for k in known], pa.int64()),
                ],
                names=["doc_id", "n", "k1", "k2", "least", *_MORE, "common", "heat"],
            )

    more = "".join(f"{c} long, " for c in _MORE)
    schema = f"doc_id long, n long, k1 long, k2 long, least long, {more}common long, heat long"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _need(n: str, percent: int) -> str:
    """SQL: deciding tokens that a set of n tokens shares at least with any partner."""
    return f"1 + (({n} * {percent} + 99) div 100) * {SPARE_PERCENT} div 100"


def _deciding_tokens(texts: list[bytes], size: int, percent: int, hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kept = []
    for tokens in text_sets(texts, size):
        ordered = _rarest_first(tokens, hot.value[0])
        n = len(ordered)
        kept.append(ordered[: n - least_overlap(n, percent) + 1 + n * SPARE_PERCENT // 100])
    flat = np.concatenate([*kept, np.zeros(0, np.uint64)])
    return np.array([len(k) for k in kept]), flat, np.arange(len(flat))


def _owners(keys: np.ndarray, counts: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    owner = keys[np.searchsorted(np.cumsum(counts, dtype=np.int64), places, "right")]
    return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(_signed(hashes))], names=["node", "token"])


def shared_tokens(docs: DataFrame, size: int, percent: int, hot) -> DataFrame:
    """(node, token): each document's deciding tokens that another row decides by too."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = common.partitions_for(docs, total, 2 * recurrence.BYTES_PER_RANGE)
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    index = recurrence.build(rows, parts, lambda texts: _deciding_tokens(texts, size, percent, hot))
    return recurrence.recurring(index, _owners, "node long, token long")


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, least, tokens) of the documents in nodes; tokens are 64-bit numbers in a binary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            sets = text_sets(common.as_bytes(batch.column(1)), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "least", "tokens"],
            )

    wanted = nodes.select("node", "least")
    if wanted.count() * 64 <= SENT_BYTES:
        wanted = F.broadcast(wanted)
    texts = docs.withColumnRenamed("doc_id", "node").join(wanted, "node")
    return texts.select("node", "text", "least").mapInArrow(work, "node long, least long, tokens binary")


def _joined(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _star_edges(pairs: DataFrame, percent: int) -> DataFrame:
    """Links of (node, tokens, center, center_tokens) that hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            keep = []
            for mine, other in zip(batch.column("tokens").to_pylist(), batch.column("center_tokens").to_pylist()):
                a, b = np.frombuffer(mine, np.uint64), np.frombuffer(other, np.uint64)
                keep.append(_joined(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), percent))
            ends = batch.select(["node", "center"])
            yield ends.filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(work, "node long, center long")


def _root(parent: dict, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _open_group(members: list, queries: list, inside: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join what was apart: of the queries with the members and, if inside, among the members."""
    sets = [np.frombuffer(m["tokens"], np.uint64) for m in members]
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(s) for s in sets])
    parent = {x: x for m in members + queries for x in (m["node"], m["label"])}
    for m in members + queries:
        parent[_root(parent, m["node"])] = _root(parent, m["label"])
    links = []

    def ask(node: int, tokens: np.ndarray, upto: int) -> None:
        lo, hi = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
        if (hi > lo).sum() < least_overlap(len(tokens), percent):
            return  # the union of the group holds too few of its tokens
        width = hi - lo
        places = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())
        both = np.bincount(owner[places], minlength=len(sets))[:upto]
        for i in np.flatnonzero(100 * both >= percent * (len(tokens) + sizes[:upto] - both)):
            a, b = _root(parent, node), _root(parent, members[i]["node"])
            if a != b:
                parent[a] = b
                links.append((node, members[i]["node"]))

    if inside:
        for i, m in enumerate(members):
            ask(m["node"], sets[i], i)
    for q in queries:
        ask(q["node"], np.frombuffer(q["tokens"], np.uint64), len(sets))
    return links


def _verified(rows: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Links found in opened groups. rows: (grp, part, is_query, node, label, tokens)."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.sliced(batches, 256):
            yield from batch.to_pylist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, part), group in groupby(opened(batches), key=lambda r: (r["grp"], r["part"])):
            sides: tuple[list, list] = ([], [])
            for r in group:
                sides[r["is_query"]].append(r)
            links = _open_group(*sides, part == 0, percent)
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())}
            )

    dealt = rows.repartition(tasks, "grp", "part").sortWithinPartitions("grp", "part", "is_query", "node")
    return dealt.mapInArrow(work, "a long, b long")


def _links(docs: DataFrame, reps: DataFrame, size: int, percent: int, hot) -> DataFrame:
    """Enough links (a, b) between different sets that every linked pair is connected."""
    tokens = written(shared_tokens(docs, size, percent, hot), "shared")
    enough = reps.join(tokens.groupBy("node").agg(F.count(F.lit(1)).alias("shared")), "node")
    nodes = written(enough.filter(F.col("shared") >= F.expr(_need("n", percent))).drop("shared"), "nodes")
    sets = written(_sets_of(docs, nodes, size), "sets")

    # Near copies share their smallest token: each is first held against one of them, so that most need nothing more.
    best = F.max(F.struct("heat", (-F.col("node")).alias("minus"))).alias("best")
    centers = nodes.groupBy("least").agg(best, F.count(F.lit(1)).alias("size")).filter("size > 1")
    centers = centers.select("least", (-F.col("best.minus")).alias("center"))
    center_sets = centers.join(sets.select(F.col("node").alias("center"), F.col("tokens").alias("center_tokens")), "center")
    center_sets = written(center_sets, "centers")
    pairs = sets.join(center_sets, "least").filter("node <> center").select("node", "tokens", "center", "center_tokens")
    star = written(_star_edges(pairs, percent).groupBy("node").agg(F.min("center").alias("center")), "star")

    labels = nodes.join(star, "node", "left").select("node", "n", "common", "heat", *_MORE, F.coalesce("center", "node").alias("label"))
    for key in _MORE:
        labels = _starred(written(labels, "labels"), sets, key, percent)

    # Then those that stand for the rest are joined with one another, and at last everything that is still apart.
    labels = labels.select("node", "n", "common", "label")
    labels = written(labels, "labels")
    heads = _joined_groups(tokens, labels.filter("node = label"), sets, percent)
    apart = written(components(heads), "heads").select(F.col("node").alias("label"), "component")
    labels = labels.join(apart, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
    labels = written(labels, "joined-labels")
    rest = _joined_groups(tokens, labels, sets, percent)
    return labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(rest)


def _starred(labels: DataFrame, sets: DataFrame, key: str, percent: int) -> DataFrame:
    """labels with those that stand for others held against one that has the same smallest token in another order, and
    replaced by it, with all that they stand for, where they link."""
    heads = labels.filter("node = label").select("node", key, "heat")
    best = F.max(F.struct("heat", (-F.col("node")).alias("minus"))).alias("best")
    centers = heads.groupBy(key).agg(best, F.count(F.lit(1)).alias("size")).filter("size > 1")
    centers = written(centers.select(key, (-F.col("best.minus")).alias("center")), "centers")
    plain = sets.select("node", "tokens")
    center_sets = centers.join(plain.select(F.col("node").alias("center"), F.col("tokens").alias("center_tokens")), "center")
    mine = heads.join(centers, key).filter("node <> center").select("node", key).join(plain, "node")
    pairs = mine.join(center_sets, key).select("node", "tokens", "center", "center_tokens")
    star = written(_star_edges(pairs, percent), "star").select(F.col("node").alias("label"), "center")
    return labels.join(star, "label", "left").withColumn("label", F.coalesce("center", "label")).drop("center")


def _joined_groups(tokens: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join differently labelled (node, n, common, label), found group by group.

    Those of one label share groups, the others go by their smallest frequent token: near copies keep most of these, whatever
    each has of its own, so that a large family fills few groups.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("same"))
    family = F.when(F.col("same") > 1, F.xxhash64("label", F.lit(1))).otherwise(F.xxhash64("common", F.lit(2)))
    placed = labels.join(sizes, "label").select("node", "n", "label", family.alias("family"))
    placed = written(placed, "placed")
    sizes = written(placed.groupBy("family").agg(F.count(F.lit(1)).alias("size")), "families")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP_MEMBERS))
    groups = placed.join(sizes, "family").select("node", "n", "label", "size", F.xxhash64("family", part).alias("grp"))
    groups = written(groups, "groups")

    mine = written(tokens.join(groups, "node").select("token", "node", "n", "label", "size", "grp"), "placed-tokens")
    matrix = written(
        mine.groupBy("token", "grp", "size").agg(
            F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("one"), F.max("label").alias("other")
        ),
        "matrix",
    )
    other = matrix.select("token", F.col("grp").alias("to"), F.col("size").alias("as_many"), "low", "high", "one", "other")
    # Of two groups the members of the smaller family ask: a large family is asked once by each other document, and not
    # each of its members by every small group.
    asks = (F.col("size") < F.col("as_many")) | (F.col("size") == F.col("as_many")) & (F.col("grp") < F.col("to"))
    reach = (F.col("n") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("n") * percent)
    apart = (F.col("one") != F.col("label")) | (F.col("other") != F.col("label"))
    met = mine.join(other, "token").filter(asks & reach & apart)
    met = met.groupBy("node", "label", "n", F.col("to").alias("grp")).agg(F.count(F.lit(1)).alias("shared"))
    met = written(met.filter(F.col("shared") >= F.expr(_need("n", percent))).select("node", "label", "grp"), "met")

    asked = met.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).alias("parts"))
    # A link inside a group takes as many tokens that differently labelled members share.
    mixed = matrix.filter("one <> other").groupBy("grp").agg(F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"))
    mixed = mixed.filter(F.col("shared") >= F.expr(_need("low", percent))).select("grp")
    opened = asked.join(mixed.withColumn("mixed", F.lit(1)), "grp", "full").select("grp", F.coalesce("parts", F.lit(1)).alias("parts"))
    opened = written(opened, "opened")
    numbers = F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))
    members = groups.join(opened, "grp").select("node", "label", "grp", F.explode(numbers).alias("part"), F.lit(0).alias("is_query"))
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")
    queries = met.join(opened, "grp").select("node", "label", "grp", part.alias("part"), F.lit(1).alias("is_query"))
    rows = members.unionByName(queries).join(sets.select("node", "tokens"), "node")
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(_verified(rows, percent, tasks), "links")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text).

    Words lie between ASCII blanks, A-Z lower-cased. Two documents link when their sets of size-word shingles have
    100 * overlap >= percent * union; component_id is the smallest doc_id reachable by links. All texts count whole.
    Equal sets are joined once and stand for all their copies. Null or blank text: no shingles, linked with nothing. A row
    without doc_id is counted but not linked, and its component is null. Rows that repeat a doc_id count as
    one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common.small_batches(docs.sparkSession)
    hot = docs.sparkSession.sparkContext.broadcast(token_weights(docs, size))
    rows = written(signatures(docs, size, hot), "signatures")
    keyed = rows.filter("doc_id IS NOT NULL AND k1 IS NOT NULL")
    first = written(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "first")
    reps = keyed.join(first.select("k1", "k2", F.col("node").alias("doc_id")), ["doc_id", "k1", "k2"])
    reps = reps.groupBy(F.col("doc_id").alias("node")).agg(*[F.max(c).alias(c) for c in ("n", "least", *_MORE, "common", "heat")])
    found = components(_links(docs, written(reps, "reps"), size, percent, hot))
    classes = first.join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("class"))
    classes = written(classes, "classes")
    return rows.join(classes, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id")
    )


def _told_apart(docs: DataFrame) -> DataFrame:
    """Rows (_node, text, ...) of docs: doc_id where it names one text, else a number for every further text under it.

    Such numbers are hashes above 2^62, so that they are no document's smallest id while one of its own kind is there.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("_low"), F.max(text).alias("_high"))
    several = written(several.filter("_low <> _high").select(F.col("doc_id").alias("_of"), "_low"), "several")
    node = F.col("doc_id").cast("long")
    if several.isEmpty():
        return docs.withColumn("_node", node)
    own = F.shiftrightunsigned(F.xxhash64("doc_id", text), 2).bitwiseOR(F.lit(1 << 62))
    joined = docs.join(several, F.col("doc_id") == F.col("_of"), "left")
    return joined.withColumn("_node", F.when(F.col("_low") != text, own).otherwise(node)).drop("_of", "_low")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near duplicates (5 words, 0.8).

    Rows without doc_id stay. Different texts under one doc_id are different documents; of equal ones one stays.
    Null and blank texts are like nothing and stay.
    """
    names = docs.columns
    plain = docs.select([F.col(n).alias(f"d{i}") for i, n in enumerate(names)] + ["doc_id", "text"])
    apart = _told_apart(plain)
    found = near_duplicates(apart.select(F.col("_node").alias("doc_id"), "text"))
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_node")).distinct()
    chosen = apart.join(kept, "_node", "left_semi").dropDuplicates(["_node"]).drop("_node")
    rows = chosen.unionByName(plain.filter("doc_id IS NULL"))
    return rows.select([F.col(f"d{i}").alias(n) for i, n in enumerate(names)])
