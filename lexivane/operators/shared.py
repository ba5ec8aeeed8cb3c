"""Scores of many queries and documents by the terms they share, for searches that keep the best k.

Weights and impacts are never negative. Terms that many pairs of query and document share are columns of a matrix; the
others are postings. Documents come in blocks: the greatest impacts in a block bound a query's scores there, and a block is
opened only for queries whose bound reaches the k-th score that they are known to have. There the product of the columns in
single precision and the sum over postings, with a bound of their error, leave most pairs out; the few that can still enter a
top k are added up in double precision.

A first round makes these k-th scores known: in every block it scores the documents that a query's rarest terms have the greatest impact on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lexivane.operators.topk import PLACES, Best

UNIT = 10.0**-PLACES
_COLUMNS = 256
_SHARED = 2000  # one of so many pairs shares a term that is a column
_AT_ONCE = 100_000  # postings in arrays of numbers
_MEASURED = 50_000  # pairs added up in double precision at once
_ROUNDING = 2.0**-24  # of single precision
_LEAST = np.nextafter(0.0, 1.0)


@dataclass
class Asked:
    """Terms of the queries in a task. column is that of a term, or -1.

    narrow holds the columns' weights by query; those of query q that aren't 0 are weight[first[q] : first[q + 1]], of columns place.
    The postings of term t are queries query with weights rest from start[t] to start[t + 1], rare where the first round asks for its documents. least are scores that k documents reach.
    """

    terms: pa.Array
    column: np.ndarray
    narrow: np.ndarray
    first: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    query: np.ndarray
    rest: np.ndarray
    rare: np.ndarray
    least: np.ndarray


@dataclass
class Block:
    """Some documents: impacts by column, and for terms with postings the documents and impacts from first to first + size."""

    ids: np.ndarray
    wide: np.ndarray
    term: np.ndarray
    first: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    most: np.ndarray


def prepare(pairs: pa.Table, dense: int) -> tuple[np.ndarray, Asked]:
    """Ids and terms of queries (query_idx, token, weight, share), share being that of the documents with the token.

    Rare pairs, where told, are postings in any case. dense numbers are held for the matrix at most.
    """
    ids, query = np.unique(pairs["query_idx"].to_numpy(), return_inverse=True)
    coded = pairs["token"].combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    weight, n_terms, n = pairs["weight"].to_numpy(), len(coded.dictionary), max(1, len(ids))
    share = np.zeros(n_terms)
    share[term] = pairs["share"].to_numpy()
    share *= np.bincount(term, minlength=n_terms) / n
    columns = np.argsort(-share, kind="stable")[: min(_COLUMNS, dense // n)]
    columns = columns[share[columns] * _SHARED > 1]
    column = np.full(n_terms, -1)
    column[columns] = np.arange(len(columns))
    rare = pairs["rare"].to_numpy() if "rare" in pairs.column_names else np.zeros(len(term), bool)
    common = (column[term] >= 0) & ~rare
    narrow = np.zeros((len(ids), len(columns)), np.float32)
    narrow[query[common], column[term[common]]] = weight[common]
    by_query = np.flatnonzero(common)[np.argsort(query[common], kind="stable")]
    by_term = np.flatnonzero(~common)[np.argsort(term[~common], kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(query[by_query], minlength=len(ids)))]).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(np.bincount(term[by_term], minlength=n_terms))]).astype(np.int64)
    least = np.full(len(ids), -np.inf)
    if "least" in pairs.column_names:
        np.maximum.at(least, query, pairs["least"].to_numpy())
    return ids, Asked(coded.dictionary, column, narrow, first, column[term[by_query]], weight[by_query], start, query[by_term], weight[by_term], rare[by_term], least)


def block_of(asked: Asked, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> Block:
    """Documents by their terms: entry i says that document doc[i] (a place in ids) holds term[i]. Entries are in order of terms."""
    column = asked.column[term]
    wide = np.zeros((len(ids), asked.narrow.shape[1]))
    common = column >= 0
    wide[doc[common], column[common]] = impact[common]
    posted = asked.start[term + 1] > asked.start[term]
    term, doc, impact = term[posted], doc[posted], impact[posted]
    first = np.flatnonzero(np.diff(term, prepend=-1))
    most = np.maximum.reduceat(impact, first) if len(first) else np.zeros(0)
    return Block(ids, wide, term[first], first, np.diff(np.append(first, len(term))), doc, impact, most)


def spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which span each place belongs to, and the places of all spans one after another."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) + (first - np.cumsum(size) + size)[which]


def _met(block: Block, entry: np.ndarray, cell: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, values): every posting of a block's term entry[i] adds weight[i] times its impact to cell[i] plus its document's place."""
    upto = np.cumsum(block.size[entry])
    at = 0
    while at < len(entry):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _AT_ONCE, "right")))
        part = entry[at:end]
        which, posting = spans(block.first[part], block.size[part])
        yield cell[at:end][which] + block.doc[posting], weight[at:end][which] * block.impact[posting]
        at = end


def _exact(asked: Asked, block: Block, which: np.ndarray, near: np.ndarray, postings: Iterable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in which, document, score) of the pairs marked in near, added up in double precision."""
    found = np.flatnonzero(near)
    score = np.zeros(len(found))
    for cells, values in postings if len(found) else ():
        hit = np.flatnonzero(near[cells])
        score += np.bincount(np.searchsorted(found, cells[hit]), values[hit], len(found))
    for at in range(0, len(found), _MEASURED):
        q, d = np.divmod(found[at : at + _MEASURED], len(block.ids))
        first = asked.first[which[q]]
        of, place = spans(first, asked.first[which[q] + 1] - first)
        yield q, d, score[at : at + _MEASURED] + np.bincount(of, block.wide[d[of], asked.place[place]] * asked.weight[place], len(q))


def first_round(asked: Asked, block: Block, best: Best) -> None:
    """Offer, for every rare term of a query, the document of the block that it has the greatest impact on."""
    n = len(block.ids)
    entry, place = spans(asked.start[block.term], asked.start[block.term + 1] - asked.start[block.term])
    rare = asked.rare[place]
    which = np.unique(asked.query[place[rare]])
    slot = np.full(len(best.floor), -1)
    slot[which] = np.arange(len(which))
    slot = slot[asked.query[place]]
    group = np.repeat(np.arange(len(block.term)), block.size)
    top = np.flatnonzero(block.impact == block.most[group])
    top = block.doc[top[np.unique(group[top], return_index=True)[1]]]
    near = np.zeros(len(which) * n, bool)
    near[slot[rare] * n + top[entry[rare]]] = True
    kept = slot >= 0
    for q, d, score in _exact(asked, block, which, near, _met(block, entry[kept], slot[kept] * n, asked.rest[place[kept]])):
        best.add(which[q], block.ids[d], np.round(score, PLACES))


class Uncounted:
    def add(self, n: int) -> None:
        pass


def bounds(asked: Asked, blocks: list[Block]) -> np.ndarray:
    """What the columns can add in each block (queries x blocks), a little above the greatest sum."""
    most = np.array([b.wide.max(axis=0, initial=0.0) for b in blocks], np.float32).reshape(len(blocks), -1)
    return (asked.narrow @ most.T) * np.float32(1 + _error(asked))


def _error(asked: Asked) -> float:
    return (2 * asked.narrow.shape[1] + 64) * _ROUNDING


def meet(asked: Asked, block: Block, bound: np.ndarray, best: Best, pairs: int, zeros: bool = True, opened=None, met=None) -> None:
    """Offer a block to the queries whose bound reaches their k-th score; bound is that of the columns.

    About so many pairs of query and document are scored at once. A score that rounds to 0 counts with zeros only. opened is raised by
    the queries that were scored, met by those that share a term.
    """
    n, n_queries = len(block.ids), len(best.floor)
    entry, place = spans(asked.start[block.term], asked.start[block.term + 1] - asked.start[block.term])
    query = asked.query[place]
    bound = bound + np.bincount(query, asked.rest[place] * block.most[entry], n_queries)
    wanted = (bound > 0) & (bound >= np.maximum(asked.least, best.floor) - 2 * UNIT)
    which = np.flatnonzero(wanted)
    (met or Uncounted()).add(int((bound > 0).sum()))
    (opened or Uncounted()).add(len(which))
    if not len(which):
        return
    kept = np.flatnonzero(wanted[query])
    entry, place = entry[kept], place[kept]
    slot = np.zeros(n_queries, np.int64)
    slot[which] = np.arange(len(which))
    slot = slot[asked.query[place]]
    step = max(1, pairs // n)
    if len(which) > step:
        order = np.argsort(slot, kind="stable")
        entry, place, slot = entry[order], place[order], slot[order]
    for at in range(0, len(which), step):
        some = slice(*np.searchsorted(slot, [at, at + step])) if len(which) > step else slice(None)
        postings = list(_met(block, entry[some], (slot[some] - at) * n, asked.rest[place[some]]))
        _offer(asked, which[at : at + step], block, postings, best, zeros)


def _offer(asked: Asked, which: np.ndarray, block: Block, postings: list, best: Best, zeros: bool) -> None:
    n = len(block.ids)
    narrow = asked.narrow[which]
    total = narrow @ block.wide.astype(np.float32).T if narrow.shape[1] else np.zeros((len(which), n), np.float32)
    for cells, values in postings:
        np.add.at(total.reshape(-1), cells, values.astype(np.float32))
    floor, error = np.maximum(best.floor[which], asked.least[which]), _error(asked)
    if n > best.k:  # where nothing is known, the k-th of these documents is a bound
        new = np.flatnonzero(np.isinf(floor))
        new = new[np.count_nonzero(total[new], axis=1) > best.k] if len(new) else new
        if len(new):
            kth = np.partition(total[new], n - best.k, axis=1)[:, n - best.k].astype(np.float64)
            best.floor[which[new]] = floor[new] = kth * (1 - error) - UNIT
    cut = np.maximum(floor - UNIT, _LEAST)
    bound = np.maximum(np.nextafter((cut * (1 - error)).astype(np.float32), np.float32(0.0)), np.finfo(np.float32).tiny)
    near = (total >= bound[:, None]).reshape(-1)
    for q, d, exact in _exact(asked, block, which, near, postings):
        keep = np.flatnonzero((exact >= cut[q]) & (zeros | (np.round(exact, PLACES) > 0)))
        best.add(which[q[keep]], block.ids[d[keep]], np.round(exact[keep], PLACES))
