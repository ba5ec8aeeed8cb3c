"""What is dropped of a page without an article is the union of its long repeats: the common prefixes of suffixes of several pages."""

import random

import numpy as np

from lexivane.llm import html


def longest_repeats(streams, pages):
    """Per token the length of the longest run from there that so many pages hold."""
    texts = [" " + " ".join(s) + " " for s in streams]
    out = []
    for stream in streams:
        tokens = " ".join(stream).split()
        sizes = []
        for i in range(len(tokens)):
            size = 0
            while i + size < len(tokens) and sum(" " + " ".join(tokens[i : i + size + 1]) + " " in t for t in texts) >= pages:
                size += 1
            sizes.append(size)
        out.append(sizes)
    return out


def test_covered_tokens_are_those_of_long_repeats():
    rng = random.Random(9)
    long = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(4, 30))) for _ in range(6)]
    streams = [[rng.choice(long + [" ".join(rng.choice("xyz") for _ in range(9))]) for _ in range(rng.randrange(5))] for _ in range(25)]
    words = html.words_of(streams)
    runs, counts = html.run_counts(words)
    covered = html.covered_by(words, runs[counts >= html.LEAST_PAGES])
    repeats = longest_repeats(streams, html.LEAST_PAGES)
    assert max(max(sizes, default=0) for sizes in repeats) > 2 * html.LEAST_RUN
    for hit, sizes in zip(covered, repeats):
        wanted = {j for i, size in enumerate(sizes) if size >= html.LEAST_RUN for j in range(i, i + size)}
        assert set(np.flatnonzero(hit)) == wanted


def test_unmarked_blocks_around_an_article_go_through_the_array(spark):
    shared = "all rights reserved by the owner of this site"
    page = "<div>before {0}</div><article><p>text {0}</p><p>{1}</p></article><div>after {0}</div><div>{1}</div><nav>aside</nav>"
    rows = [(i, f"http://a.org/{i}", page.format(i, shared)) for i in range(3)] + [(9, "http://a.org/9", "<article>alone</article>")]
    found = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), ["page_id"]).collect()}
    assert found == {i: f"before {i}\ntext {i}\n{shared}\nafter {i}" for i in range(3)} | {9: "alone"}
