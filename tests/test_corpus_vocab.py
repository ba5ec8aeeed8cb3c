from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexivane import config
from lexivane.operators import corpus, vocab
from lexivane.sources import triplets as sources


def test_create_corpus(spark):
    raw = spark.createDataFrame(
        [(0, "hallo", None, "train"), (1, None, "no", "val"), (2, "hej", "nix", "test")],
        "idx bigint, positive string, negative string, split string",
    )
    long = corpus.create_corpus(raw, ["positive", "negative"], ["split"])
    got = [tuple(r)[:4] for r in long.orderBy("query_idx", "position").collect()]
    assert got == [
        (0, "hallo", "positive", "train"),
        (1, "no", "negative", "val"),
        (2, "hej", "positive", "test"),
        (2, "nix", "negative", "test"),
    ]


def test_gold_mapping_takes_the_last_positive(spark):
    rows = [(0, 1, "positive"), (1, 2, "negative"), (2, 3, "positive"), (3, 3, "positive")]
    long = spark.createDataFrame(rows, "corpus_idx bigint, query_idx bigint, column string")
    assert {r[0]: r[1] for r in corpus.gold_documents(long).collect()} == {1: 0, 3: 3}


def test_corpus_and_queries(triplets):
    flagged = sources.flag_triplets(triplets)
    assert [r[0] for r in flagged.orderBy("idx").select(sources.COMPLETE).collect()] == [False, False, True, True]
    long, queries, gold = corpus.corpus_and_queries(flagged)
    got = [(r["corpus_idx"], r["query_idx"], r["column"]) for r in long.orderBy("corpus_idx").collect()]
    assert got == [(0, 0, "positive"), (1, 1, "negative"), (2, 2, "positive"), (3, 2, "negative"), (4, 3, "negative")]
    assert {r["idx"]: r["corpus_idx"] for r in queries.collect()} == {0: 0, 1: None, 2: 2, 3: None}
    assert gold.count() == 2
    assert sources.complete_pairs(flagged).count() == 2
    assert sources.first_rows(flagged, 3).count() == 3


def test_length_filter(spark):
    rows = [("word " * 1000, "query"), ("kort", "query"), ("kort uden", "positive")]
    df = spark.createDataFrame(rows, "document string, column string")
    checked = corpus.add_lengths(df, 800, 400)
    assert [r[0] for r in checked.select("fits_length").collect()] == [False, True, True]
    report = corpus.length_report(checked).first()
    assert tuple(report) == (2, 1, pytest.approx(2 / 3, abs=1e-6))
    assert tuple(corpus.length_report(checked.limit(0)).first()) == (0, 0, 0.0)


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ord bigint, text string")


def test_vocabulary_order(spark):
    made = vocab.create_vocabulary(texts(spark, ["I like cats", "i LIKE likE CATS caTS CAts", "dogs"]))
    assert [r["token"] for r in made.orderBy("token_id").collect()] == ["cats", "like", "i", "dogs"]


def test_vocabulary_cut_breaks_ties_by_first_sight(spark):
    made = vocab.create_vocabulary(texts(spark, ["b a", "c b a", None]), 2)
    assert [(r["token"], r["n"]) for r in made.orderBy("token_id").collect()] == [("b", 2), ("a", 2)]


def test_stemming_merges_before_counting(spark):
    stems = spark.createDataFrame([("cats", "cat")], "word string, stem string")
    made = vocab.create_vocabulary(texts(spark, ["dog dog cats", "cat cats"]), stems=stems)
    assert [(r["token"], r["n"]) for r in made.orderBy("token_id").collect()] == [("cat", 3), ("dog", 2)]


def words(spark, tokens):
    return spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "token_id bigint, token string")


def test_frequencies_count_unknown_words(spark):
    vocabulary = words(spark, ["a", "b", "z"])
    counts = vocab.token_frequencies(vocabulary, texts(spark, ["a b a", "  q a", " ", None]))
    assert {r["token_id"]: r["n"] for r in counts.collect()} == {0: 3, 1: 1, 3: 1}
    ordered = vocab.sort_by_frequency(vocabulary, counts)
    got = [r["token"] for r in ordered.orderBy("position").collect()]
    assert got == ["a", "b", config.UNKNOWN_TOKEN, "z"]


def test_sif_weights(spark):
    vocabulary = words(spark, ["hello", "world", "rare"])
    counts = spark.createDataFrame([(0, 10), (1, 5)], "token_id bigint, n bigint")
    got = {r["token_id"]: r["weight"] for r in vocab.sif_weights(vocabulary, counts).collect()}
    assert got[2] == got[1] > got[0] > 0
    assert got[0] == pytest.approx(1e-3 / (1e-3 + 10 / 15))
    empty = {r["weight"] for r in vocab.sif_weights(vocabulary, counts.limit(0)).collect()}
    assert list(empty) == [pytest.approx(1e-3 / (1e-3 + 1))]
    assert {r["weight"] for r in vocab.sif_weights(vocabulary, counts, None).collect()} == {1.0}
    assert vocab.sif_weights(vocabulary, counts, [0.1, 0.2]).count() == 6


def test_ranks_and_boundaries(spark):
    tokens = " ".join(w for i in range(40) for w in [f"w{i}"] * (i // 8 + 1))
    counts = vocab.word_counts(texts(spark, [tokens]))
    ranked = vocab.rank_words(counts, rows_per_bucket=3)
    got = ranked.orderBy("rank").collect()
    want = Counter(tokens.split()).most_common()
    assert [(r["word"], r["counts"]) for r in got] == want
    assert [r["rank"] for r in got] == list(range(40))
    assert sum(r["prob"] for r in got) == pytest.approx(1)
    edges = [tuple(r) for r in vocab.count_boundaries(ranked, 3).collect()]
    assert edges == [(1, 32), (2, 24), (3, 16)]
    assert [r["rank"] for r in vocab.decimate_ranks(ranked, 2, 10).orderBy("rank").collect()] == [0, 1, 10, 20, 30]
    zipf = vocab.zipf_weights(ranked).agg(F.sum("zipf_prob")).first()[0]
    assert zipf == pytest.approx(1)


def test_added_tokens(spark):
    external, internal = words(spark, ["a", "b", "b", "c"]), words(spark, ["c", "x"])
    assert sorted(r[0] for r in vocab.added_tokens(external, internal).collect()) == ["a", "b"]
    assert tuple(vocab.added_report(external, internal).first()) == (2, 2)
