"""Operators against brute force where SQL can't express them."""

import random

import pytest

from lexivane.llm import decontamination, jaccard


def _overlapping(doc, item):
    size = min(decontamination.OVERLAP, len(item))
    if size < decontamination.LEAST_WORDS:
        return False
    least = {5: 5, 6: 6}.get(size, size - 1 if size < decontamination.OVERLAP else size - 2)
    return any(
        sum(a == b for a, b in zip(doc[i : i + size], item[j : j + size])) >= least
        for i in range(len(doc) - size + 1)
        for j in range(len(item) - size + 1)
    )


def test_overlaps_equal_brute_force(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(400)]
    items = [random.choices(words, k=k) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20, 40) for _ in range(3)]
    texts = []
    for item in items:
        for changes in range(4):
            at = random.randrange(max(1, len(item) - 12))
            part = item[at : at + 13]
            for place in random.sample(range(len(part)), min(changes, len(part))):
                part[place] = "changed"
            texts.append(random.choices(words, k=random.randrange(9)) + part + random.choices(words, k=random.randrange(9)))
    texts += [random.choices(words, k=60) for _ in range(20)] + [[]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    wanted = {(d, i) for d, doc in enumerate(texts) for i, item in enumerate(items) if _overlapping(doc, item)}
    rows = decontamination.overlaps(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == wanted and len(rows) == len(wanted)
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in wanted}
    for r in rows:
        side = zip(texts[r["doc_id"]][r["doc_start"] :], items[r["item_id"]][r["item_start"] :])
        assert sum(a == b for a, b in list(side)[: r["n_words"]]) == r["n_agreeing"]


@pytest.mark.parametrize("size", range(5, 14))
def test_a_mask_hits_wherever_enough_words_agree(size):
    spare = size - decontamination.agreeing(size)
    assert spare == (0 if size < 7 else 1 if size < 13 else 2)
    shifted = [{i + s for i in m} for m in decontamination.masks_of(size) for s in range(size - m[-1])]
    for x in range(size):
        for y in range(size):
            changed = {x, y} if spare == 2 else {x} if spare else set()
            assert any(not changed & hit for hit in shifted)


def test_repeated_ids_with_different_texts_stay(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (5, one + " end"), (5, two), (5, two), (7, two), (5, three), (8, None), (8, ""), (9, " "), (None, one), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, _node string, n int")
    kept = jaccard.stage(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept.collect())
    twos = [f for f in found if f[1] == two]
    assert len(twos) == 1 and twos[0][0] in (5, 7)
    assert [f for f in found if f[1] != two] == sorted([(1, one), (5, three), (8, ""), (9, " "), (0, one), (0, "")])


def test_stage_of_unique_ids_keeps_the_smallest(spark):
    text = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text), (2, text + " b"), (4, "other words"), (6, "")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in jaccard.stage(spark, docs, "").collect()) == [2, 4, 6]
    assert jaccard.stage(spark, docs.limit(0), "").count() == 0
