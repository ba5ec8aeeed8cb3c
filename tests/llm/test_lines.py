"""Line dedup against brute force: both ways of testing the filter, nulls, blanks, long lines, repeats and clashing names."""

import random
from collections import defaultdict

import numpy as np
import pytest

from lexivane.llm import lines

SCHEMA = "doc_id bigint, text string, _row string, _doc int, kept int, n_lines string"


def _rows():
    random.seed(5)
    pool = [f"line number {i} of the pool" for i in range(40)] + ["short", "", "  \t", "exactly10!", "ÆØÅæøåÆØÅ", "ÆØÅæøåÆØÅx"]
    texts = ["\n".join(random.choice(pool) for _ in range(random.randrange(1, 30))) for _ in range(40)]
    texts += [None, "", "\n", "only one line here", "ONLY one LINE here \r\nonly one line here", "x" * 2_000_000, "x" * 2_000_000 + "\nextra line at the end"]
    texts += ["a line that very many documents hold"] * 30
    rows = [(i * 3, t, "r", 1, 2, None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[0], (None, texts[0], None, None, None, None), (None, "only one line here\nnameless line alone", None, None, None, None)]
    return rows + [(6, "another text of one id\nline number 1 of the pool", "r", 1, 2, None)]


def _key(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if c.isascii() else c for c in key)


def _expected(rows):
    holders = defaultdict(set)
    order = lambda doc: (doc is None, doc or 0)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= 10:
                holders[_key(line)].add(order(doc))
    out = []
    for doc, text, *_ in rows:
        mine = (text or "").split("\n")
        gone = [i for i, x in enumerate(mine) if len(holders.get(_key(x), ())) > 1 and order(doc) != min(holders[_key(x)])]
        out.append((doc, len(mine), gone, "\n".join(x for i, x in enumerate(mine) if i not in set(gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("filter_bytes,gone_bytes", [(1 << 26, 1 << 25), (0, 0)])
def test_against_brute_force(spark, monkeypatch, filter_bytes, gone_bytes):
    monkeypatch.setattr(lines, "FLUSH", 50)
    docs = spark.createDataFrame(_rows(), SCHEMA).repartition(5)
    got = lines.deduped(docs, ["doc_id"], filter_bytes=filter_bytes, gone_bytes=gone_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _expected(_rows())


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    got = lines.deduped(docs, ["doc_id", "_row", "_doc", "text"])
    assert got.columns == ["doc_id", "_row", "_doc", "text", "n_lines", "dropped", "kept"]
    assert got.filter("_row = 'r' and _doc = 1").count() == len(_rows()) - 2
    empty = lines.deduped(spark.createDataFrame([], SCHEMA), ["doc_id"])
    assert empty.columns == ["doc_id", "n_lines", "dropped", "kept"] and empty.count() == 0


def test_the_filter_holds_what_was_seen_twice():
    random.seed(1)
    shape = lines.Filter(10_000, 7)
    d1 = np.array([random.getrandbits(64) for _ in range(1000)], np.uint64)
    assert shape.slices == 7 and 0 <= shape.slice_of(d1).min() and shape.slice_of(d1).max() < 7
    packed = np.zeros(shape.bits, bool)
    packed[np.concatenate(shape.places(d1))] = True
    assert shape.held(np.packbits(packed), d1).all()
