"""Main text of web pages: marked regions, and a host suffix array that finds boilerplate between them.

A page is cut into blocks, each in the article, in a region marked as something else, or in neither. The tokens of all
blocks outside articles are concatenated by chunks of a host; a suffix array finds the runs of a chunk and how many pages have each,
and these numbers are added up over the host to find the runs that several of its pages share. Blocks outside an article stay only as their unique runs, also on
pages that mark an article. Articles themselves are exempt, because a copied article is still the page's main text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm import common
from lexivane.llm.urls import host_of
from lexivane.session import new_path

LEAST_RUN = 6  # tokens of a shared run
LEAST_PAGES = 3  # distinct pages that share it
CHUNK_PAGES = 500  # pages of a host in one suffix array
RUN_ROWS = 50_000  # runs sent at once
_RAW = "script style noscript template svg iframe textarea title math object canvas"
_RAW_START = re.compile(r"<!--|<((?ai:" + _RAW.replace(" ", "|") + r"))\b")
_RAW_END = {name: re.compile(rf"</(?ai:{name})\s*>") for name in _RAW.split()}
_EVENT = re.compile(r"[>\"']")
_NAME_END = re.compile(r"[\s/>]")
_TAG_START = re.compile(r"<(?:/?[a-zA-Z]|[!?/])")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85   -     　]+")
_NAMES = re.compile(r"[a-z]+")
# Elements whose text is never main text, and words in class, id or role that say the same.
_ASIDE = frozenset("nav header footer aside form button select dialog menu head".split())
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo banner cookie cookies consent notice notices nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer header masthead comment comments reply replies disqus related share sharing social newsletter subscribe signup "
    "login popup modal search pagination contentinfo complementary".split()
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u "
    "var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6".split())


class _Ends:
    """Where tags end: at the first > that stands in no quotes, by position. Found for all positions in one pass."""

    def __init__(self, text: str):
        self.places = [m.start() for m in _EVENT.finditer(text)]
        self.ends = [-1] * (len(self.places) + 1)
        ahead: dict[str, int] = {}
        for i in range(len(self.places) - 1, -1, -1):
            kind = text[self.places[i]]
            if kind == ">":
                self.ends[i] = self.places[i]
            else:
                closing = ahead.get(kind, -1)
                self.ends[i] = self.ends[closing + 1] if closing >= 0 else -1
                ahead[kind] = i

    def end(self, at: int) -> int:
        """The end of a tag whose attributes begin at that place, or -1."""
        return self.ends[bisect_left(self.places, at)]


def _without_raw(page: str) -> str:
    """The page with a space for each comment and each element whose content is no text, whatever stands in it."""
    ends = _Ends(page)
    out, at, pos = [], 0, 0
    while m := _RAW_START.search(page, pos):
        if m[1] is None:
            end = page.find("-->", m.end())
            pos = len(page) if end < 0 else end + 3
        else:
            end = ends.end(m.end())
            if end < 0:
                pos = m.end()
                continue
            closing = _RAW_END[m[1].lower()].search(page, end + 1)
            pos = closing.end() if closing else len(page)
        out += [page[at : m.start()], " "]
        at = pos
    return "".join(out) + page[at:]


def _tags(text: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closing, name, attributes) of the tags; no name for declarations and the like. A tag that isn't closed
    to the end of the text is none."""
    ends = _Ends(text)
    stops = [m.start() for m in _NAME_END.finditer(text)]
    last, pos = text.rfind(">"), 0
    while (m := _TAG_START.search(text, pos)) and m.start() < last:
        start, pos = m.start(), m.start() + 1
        if m[0][-1].isalpha():
            cut = stops[bisect_left(stops, m.end())]
            end = ends.end(cut)
            # A quote inside a name belongs to the attributes where the tag is not closed otherwise.
            event = bisect_left(ends.places, cut) - 1
            while end < 0 and event >= 0 and ends.places[event] >= m.end():
                cut, end = ends.places[event], ends.ends[event]
                event -= 1
            if end >= 0:
                closing = text[start + 1] == "/"
                yield start, end + 1, closing, text[start + 1 + closing : cut], text[cut:end]
                pos = end + 1
                continue
        if text[start + 1] in "!?/":
            end = text.find(">", start + 2)
            if end >= 0:
                yield start, end + 1, False, None, ""
                pos = end + 1


def blocks(page: str) -> tuple[list[str], list[str], bool]:
    """Texts of the article's blocks, texts of the unmarked blocks, and whether the page marks an article (or main).

    Character references are decoded; white space inside a block is one space.
    """
    found, marked = in_order(page)
    return [text for inside, text in found if inside], [text for inside, text in found if not inside], marked


def in_order(page: str) -> tuple[list[tuple[bool, str]], bool]:
    """(in the article, text) of the blocks in page order, without those marked as something else, and whether the page marks an article."""
    text = _without_raw(page)
    cut = _TAG_START.search(text, text.rfind(">") + 1)  # a tag that the end of the page cuts off
    text = text[: cut.start()] if cut else text
    found: list[tuple[bool, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # (element, article, aside)
    open_at: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by element
    inside, aside, marked, at, held = False, False, False, 0, []

    def close() -> None:
        block = _BLANKS.sub(" ", html.unescape("".join(held))).strip(" ")
        held.clear()
        if block and not aside:
            found.append((inside, block))

    def cut_to(size: int) -> None:
        while len(stack) > size:
            open_at[stack.pop()[0]].pop()

    for start, end, closing, name, attributes in _tags(text):
        held.append(text[at:start])
        at = end
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "wbr" or name == "img":
                continue
            words = set() if closing else _marks(attributes)
            if not words & _ASIDE_WORDS and not open_at[name]:
                continue
        if name == "br":
            held.append(" ")
            continue
        if name in _VOID:
            close()
            continue
        if closing:
            close()
            if open_at[name]:
                cut_to(open_at[name][-1])
        else:
            close()
            if name in _ENDS_PARAGRAPH and stack and stack[-1][0] in _ENDS_PARAGRAPH:
                cut_to(len(stack) - 1)
            main = name in ("article", "main")
            now = stack[-1] if stack else ("", False, False)
            away = now[2] or (name in _ASIDE and not (name == "header" and now[1])) or bool(_marks(attributes) & _ASIDE_WORDS)
            if main and not away:
                marked = True
            if not attributes.endswith("/"):
                open_at[name].append(len(stack))
                stack.append((name, now[1] or main, away))
        inside, aside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    held.append(text[at:])
    close()
    return found, marked


def _marks(attributes: str) -> set[str]:
    return {w for value in _MARKS.findall(attributes) for w in _NAMES.findall(value.lower())} if attributes else set()


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of the suffixes of tokens, by prefix doubling."""
    rank, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while True:
        second = np.full(len(rank), -1, np.int64)
        second[:-width] = rank[width:]
        order = np.lexsort((second, rank))
        step = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        fresh = np.empty_like(rank)
        fresh[order] = np.concatenate([[0], np.cumsum(step)])
        rank, width = fresh, width * 2
        if rank.max() == len(rank) - 1 or width >= len(rank):
            return order


def _shared_heads(tokens: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """For neighbours in the suffix array whether they agree on their first size tokens."""
    a, b = order[:-1], order[1:]
    same = np.maximum(a, b) + size <= len(tokens)
    for k in range(size):
        at = np.flatnonzero(same)
        same[at] = tokens[a[at] + k] == tokens[b[at] + k]
    return same


def words_of(streams: list[list[str]]) -> common.Words:
    """The tokens of some pages' blocks; a block's tokens lie between single spaces."""
    return common.Words([" ".join(s).encode() for s in streams])


def _run_places(words: common.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of size tokens inside a page, the token each begins at, and its page."""
    runs, begin = words.grams(size)
    counts = np.diff(begin)
    page = np.repeat(np.arange(len(counts)), counts)
    return runs, np.arange(len(runs)) + (words.first[:-1] - begin[:-1])[page], page


def run_counts(words: common.Words, size: int = LEAST_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size tokens that some pages have, and how many of these pages have each."""
    runs, place, of = _run_places(words, size)
    if not len(runs):
        return runs, np.zeros(0, np.int64)
    pages, numbers = np.arange(len(words.first) - 1), np.unique(words.hashes, return_inverse=True)[1]
    tokens = np.insert(numbers, words.first[1:], -1 - pages)  # a sign of its own ends each page
    page = np.insert(np.repeat(pages, words.counts()), words.first[1:], pages)
    order = suffix_array(tokens)
    group = np.concatenate([[0], np.cumsum(~_shared_heads(tokens, order, size))])
    pairs = np.unique(group * len(pages) + page[order]) // len(pages)
    counts = np.bincount(pairs, minlength=group[-1] + 1)
    run_at = np.full(len(tokens), -1)
    run_at[place + of] = np.arange(len(runs))
    head = run_at[order[np.flatnonzero(np.diff(group, prepend=-1))]]
    return runs[head[head >= 0]], counts[head >= 0]


def covered_by(words: common.Words, shared: np.ndarray, size: int = LEAST_RUN) -> list[np.ndarray]:
    """Per page which of its tokens lie in a run whose hash is among the shared ones."""
    runs, place, _ = _run_places(words, size)
    starts = place[np.isin(runs, shared)]
    mark = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + size, -1)
    hit = np.cumsum(mark[:-1]) > 0
    return [hit[b:e] for b, e in zip(words.first, words.first[1:])]


def _unique_runs(texts: list[str], covered: np.ndarray) -> list[str]:
    """Of each text the words that are not covered."""
    out, at = [], 0
    for text in texts:
        words = text.split(" ")
        out.append(" ".join(w for w, c in zip(words, covered[at : at + len(words)]) if not c))
        at += len(words)
    return out


def _joined(inside: list[bool], article: list[str], other: list[str]) -> str:
    """Blocks of both kinds in page order; empty ones are left out."""
    kinds = iter(article), iter(other)
    return "\n".join(text for text in (next(kinds[not i]) for i in inside) if text)


def _parsed(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Written table: the columns in keep, host, the article's blocks, other blocks, which block is the article's, and a key of the content.

    Rows of a host with equal content are one page, so copies don't make each other's text shared.
    """
    source = pages.select(
        *[F.col(k).alias(f"_c{i}") for i, k in enumerate(keep)],
        host_of(F.col("url")).alias("_host"),
        F.col("html").alias("_html"),
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, 500):
            found = [in_order(h or "")[0] for h in batch.column("_html").to_pylist()]
            columns = batch.columns[:-1]
            columns += [
                pa.array([[text for i, text in f if i] for f in found], pa.list_(pa.string())),
                pa.array([[text for i, text in f if not i] for f in found], pa.list_(pa.string())),
                pa.array([[i for i, _ in f] for f in found], pa.list_(pa.bool_())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "_article", "_other", "_inside"])

    out = source.mapInArrow(work, f"{kinds}, _article array<string>, _other array<string>, _inside array<boolean>")
    out = out.withColumn("_page", F.xxhash64("_article", "_other", "_inside"))
    path = new_path(pages.sparkSession, "pages")
    out.write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(out.schema).parquet(path)


def _shared_runs(sent: DataFrame) -> DataFrame:
    """Per chunk (_host, _chunk) the hashes of its runs that at least LEAST_PAGES pages of the whole host have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, chunk), held in _chunks(batches):
            runs, counts = run_counts(words_of([r["_other"] for r in held]))
            if held[0]["chunks"] == 1:  # nothing to add from elsewhere
                runs, counts = runs[counts >= LEAST_PAGES], counts[counts >= LEAST_PAGES]
            for at in range(0, len(runs), RUN_ROWS):
                part, n = runs[at : at + RUN_ROWS].view(np.int64), counts[at : at + RUN_ROWS]
                columns = [pa.array([host] * len(part), pa.string()), pa.array([chunk] * len(part), pa.int64()), pa.array(part), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["_host", "_chunk", "_run", "n"])

    placed = sent.repartition("_host", "_chunk").sortWithinPartitions("_host", "_chunk", "_page")
    runs = placed.mapInArrow(work, "_host string, _chunk long, _run long, n long")
    # One row a chunk and run: even a run on every page is few rows.
    pages = F.sum("n").over(Window.partitionBy("_host", "_run"))
    shared = runs.withColumn("pages", pages).filter(F.col("pages") >= LEAST_PAGES)
    return shared.groupBy("_host", "_chunk").agg(F.collect_list("_run").alias("_runs"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[dict]]]:
    """The first row of each page of each chunk, from rows in order of chunk and page."""
    rows = (r for batch in common.sliced(batches, 256) for r in batch.to_pylist())
    for place, group in groupby(rows, key=lambda r: (r["_host"], r["_chunk"])):
        yield place, [next(copies) for _, copies in groupby(group, key=lambda r: r["_page"])]


def main_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and text of every row of (page_id, url, html): blocks in page order, joined by a line end.

    The text is the blocks of an article or main element without its asides, and of the unmarked blocks around it what fewer than
    LEAST_PAGES pages of its host share. Null html and pages without text give an empty text. Hosts are cut into chunks of about
    CHUNK_PAGES pages, so a large host is many groups; the pages that have a run are added up over all chunks of the host, so the
    result doesn't depend on how it is cut. Rows of a host with equal content count as one page and get the same text.
    """
    common.small_batches(pages.sparkSession, 500)
    parsed = _parsed(pages, keep)
    names = [f"_c{i}" for i in range(len(keep))]
    whole = F.size("_other") == 0  # all of it an article
    outer = parsed.filter(~whole).select("_host", "_page", "_article", "_other", "_inside")
    sizes = outer.groupBy("_host").agg(F.ceil(F.count(F.lit(1)) / CHUNK_PAGES).alias("chunks"))
    dealt = outer.join(sizes, "_host").withColumn("_chunk", F.pmod(F.col("_page"), F.col("chunks")))
    sent = dealt.select("_host", "_chunk", "_page", "_article", "_other", "_inside", "chunks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, _), held in _chunks(batches):
            shared = np.array([h for r in held for h in r["_runs"] or ()], np.int64).view(np.uint64)
            held = [r for r in held if r["_page"] is not None]
            covered = covered_by(words_of([r["_other"] for r in held]), shared)
            left = [_joined(r["_inside"], r["_article"], _unique_runs(r["_other"], c)) for r, c in zip(held, covered)]
            columns = [pa.array([host] * len(held), pa.string()), pa.array([r["_page"] for r in held], pa.int64()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_host", "_page", "_left"])

    both = sent.drop("chunks").unionByName(_shared_runs(sent.drop("_article", "_inside")), allowMissingColumns=True)
    # The runs of a chunk come first.
    both = both.repartition("_host", "_chunk").sortWithinPartitions("_host", "_chunk", "_page")
    left = both.mapInArrow(work, "_host string, _page long, _left string")
    plain = parsed.filter(whole).select(*names, F.array_join("_article", "\n").alias("text"))
    rest = parsed.filter(~whole).join(left, ["_host", "_page"], "left").select(*names, F.coalesce("_left", F.lit("")).alias("text"))
    out = plain.unionByName(rest)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "text")
