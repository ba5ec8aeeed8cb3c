import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lexivane.operators import splits
from lexivane.sources import triplets
from lexivane.sources.ordering import dense_index, source_index, sums_before


@pytest.mark.parametrize("rows_per_bucket", [7, 100_000])
def test_dense_index_follows_the_order(spark, rows_per_bucket):
    # Gaps, a far outlier, and a third of the rows close together.
    keys = [i * i for i in range(200)] + [10**12] + [50_000 + i for i in range(100)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(5)
    got = dense_index(df, ["k"], rows_per_bucket=rows_per_bucket).collect()
    ranks = sorted((r["k"], r["idx"]) for r in got)
    assert [i for _, i in ranks] == list(range(len(keys)))


def test_dense_index_with_one_key_for_a_third_of_the_rows(spark):
    rows = [(7, i) for i in range(300)] + [(i, 0) for i in range(600)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(4)
    key = F.col("a") + F.col("b") / 1024.0
    got = dense_index(df, ["a", "b"], range_key=key, rows_per_bucket=20)
    assert [r["idx"] for r in got.orderBy("a", "b", "idx").collect()] == list(range(900))


def test_dense_index_of_nothing(spark):
    assert dense_index(spark.createDataFrame([], "k bigint"), ["k"]).count() == 0


def flagged(spark, n, every):
    rows = [(i, i % every != 0) for i in range(n)]
    return spark.createDataFrame(rows, "idx bigint, has_positive_and_negative boolean").repartition(3)


def draw(i, seed=51):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def quotas(sizes, share):
    total = sum(sizes.values())
    drawn = math.ceil(total * share)
    base = {s: drawn * n // total for s, n in sizes.items()}
    order = sorted(sizes, key=lambda s: (-(drawn * sizes[s] % total), s))
    for s in order[: drawn - sum(base.values())]:
        base[s] += 1
    return base


@pytest.mark.parametrize("n,every", [(97, 3), (400, 10), (11, 4)])
def test_splits_match_brute_force(spark, n, every):
    strata = {}
    for i in range(n):
        strata.setdefault(str(i % every != 0).lower(), []).append(i)
    test = quotas({s: len(v) for s, v in strata.items()}, 0.1)
    val = quotas({s: len(v) - test[s] for s, v in strata.items()}, 0.1)
    want = {}
    for s, ids in strata.items():
        for place, i in enumerate(sorted(ids, key=draw)):
            want[i] = "test" if place < test[s] else "val" if place < test[s] + val[s] else "train"
    df = flagged(spark, n, every)
    three = {r["idx"]: r["split"] for r in splits.add_splits(df).collect()}
    assert three == want
    two = {r["idx"]: r["split"] for r in splits.stratified_split(df).collect()}
    assert two == {i: "test" if w == "test" else "train" for i, w in want.items()}


@pytest.mark.parametrize("n,every,k", [(97, 3, 10), (50, 7, 5), (23, 2, 4)])
def test_folds_match_brute_force(spark, n, every, k):
    labels = [str(i % every != 0).lower() for i in range(n)]
    order = list(dict.fromkeys(labels))
    placed = sorted(range(n), key=lambda i: order.index(labels[i]))
    share = {s: [0] * k for s in order}
    for position, i in enumerate(placed):
        share[labels[i]][position % k] += 1
    want = {}
    for s in order:
        folds = [f for f in range(k) for _ in range(share[s][f])]
        want |= dict(zip([i for i in range(n) if labels[i] == s], folds))
    folded = splits.stratified_k_fold(flagged(spark, n, every), k)
    assert {r["idx"]: r["fold"] for r in folded.collect()} == want
    sets = splits.fold_sets(folded, k).groupBy("run_fold").pivot("part").count().collect()
    assert all(r["train"] + r["test"] == n for r in sets)


def test_sample_is_exact_and_seeded(spark):
    df = spark.range(500).withColumnRenamed("id", "idx")
    want = set(sorted(range(500), key=draw)[:37])
    assert {r["idx"] for r in splits.sample_rows(df, 37).collect()} == want
    assert {r["idx"] for r in splits.sample_rows(df.repartition(9), 37).collect()} == want
    assert splits.sample_rows(df, 37, seed=1).exceptAll(splits.sample_rows(df, 37)).count() > 0
    assert splits.sample_rows(df, 900).count() == 500
    assert splits.sample_rows(df, 0).count() == 0


def test_split_is_the_same_for_any_partition_count(spark):
    df = flagged(spark, 300, 5)
    first = splits.add_splits(df.coalesce(1)).select("idx", "split")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        other = splits.add_splits(df.repartition(8)).select("idx", "split")
        assert first.exceptAll(other).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("rows_per_bucket", [None, 9])
def test_dense_index_by_text_and_several_columns(spark, rows_per_bucket):
    rows = [(f"k{i % 7}" if i % 5 else None, i // 3, "p", "q") for i in range(200)] + [("k1", 1, "p", "q")] * 90
    df = spark.createDataFrame(rows, "a string, b int, _part string, _place string").repartition(6)
    got = dense_index(df, ["a", F.desc("b")], rows_per_bucket=rows_per_bucket)
    assert got.columns == ["a", "b", "_part", "_place", "idx"]
    ordered = [(r["a"], r["b"], r["_part"], r["_place"]) for r in got.orderBy("idx").collect()]
    assert ordered == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    assert sorted(r["idx"] for r in got.collect()) == list(range(290)) and dict(got.dtypes)["idx"] == "bigint"


def test_a_common_key_is_dealt_to_many_partitions(spark):
    df = spark.range(4000).select(F.lit("same").alias("k"), (F.col("id") % 2).alias("v")).repartition(4)
    got = dense_index(df, ["k"], rows_per_bucket=500)
    assert sorted(r["idx"] for r in got.collect()) == list(range(4000))
    assert got.select(F.input_file_name()).distinct().count() >= 6


def test_dense_index_of_repeated_reads_is_the_same(spark):
    df = spark.createDataFrame([(i % 4, str(i)) for i in range(300)], "k int, v string").repartition(3)
    got = dense_index(df, ["k"], rows_per_bucket=50)
    assert got.collect() == got.collect()
    again = dense_index(df, ["k"], rows_per_bucket=70)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in again.collect()}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("source") / "triplets")
    rows = [("danish" if i % 3 else "english", f"q{(i * 37) % 101}", "p", None if i % 4 else "n", "f") for i in range(500)]
    for at in range(0, 500, 100):
        part = spark.createDataFrame(rows[at : at + 100], "language string, query string, positive string, negative string, _file string")
        part.coalesce(1).write.mode("append").parquet(path)
    order = sorted(spark.read.parquet(path).inputFiles())
    stands = [tuple(r) for f in order for r in spark.read.parquet(f).collect()]
    return path, stands


def test_source_order_needs_no_key(spark, files):
    path, stands = files
    got = triplets.load_triplets(spark, path, "danish").orderBy("idx").collect()
    assert [(r["language"], r["query"], r["positive"], r["negative"], r["_file"]) for r in got] == [s for s in stands if s[0] == "danish"]
    assert [r["idx"] for r in got] == list(range(len(got))) and [r["has_positive_and_negative"] for r in got] == [r["negative"] is not None for r in got]
    small = source_index(spark, path, F.col("language") == "danish", block_rows=7).orderBy("idx")
    assert [r["query"] for r in small.collect()] == [s[1] for s in stands if s[0] == "danish"]
    every = source_index(spark, path, name="n").orderBy("n").collect()
    assert [tuple(r)[:5] for r in every] == stands and [r["n"] for r in every] == list(range(500))
    plan = source_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_load_in_a_given_order(spark, files):
    path, stands = files
    got = triplets.load_triplets(spark, path, "english", ["query"]).orderBy("idx").collect()
    assert [r["query"] for r in got] == sorted(s[1] for s in stands if s[0] == "english")
    assert triplets.load_triplets(spark, path, "none").count() == 0


def many_strata(spark, n, hot):
    """A third of the rows in one stratum, the others in pairs and alone."""
    rows = [(i, "hot" if i < hot else f"s{(i * 7919) % (n // 2)}") for i in range(n)]
    return spark.createDataFrame(rows, "idx bigint, kind string").repartition(4), rows


def test_quotas_of_many_strata_equal_those_of_few(spark, monkeypatch):
    df, rows = many_strata(spark, 900, 300)
    few = [splits.add_splits(df, 0.13, 0.2, "kind").collect(), splits.stratified_k_fold(df, 7, "kind").collect()]
    monkeypatch.setattr(splits, "_FEW_STRATA", 10)
    many = [splits.add_splits(df, 0.13, 0.2, "kind").collect(), splits.stratified_k_fold(df, 7, "kind").collect()]
    for a, b in zip(few, many):
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    sizes = {}
    for _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    got = {}
    for row in many[0]:
        got[row["kind"]] = got.get(row["kind"], 0) + (row["split"] == "test")
    assert {s: n for s, n in got.items() if n} == {s: n for s, n in quotas(sizes, 0.13).items() if n}


def test_a_hundred_thousand_strata(spark, capsys):
    df = spark.range(150_000).select(F.col("id").alias("idx"), (F.col("id") % 100_000).cast("string").alias("kind"))
    split = splits.stratified_split(df, 0.1, "kind")
    assert split.groupBy("split").count().orderBy("split").collect() == [("test", 15_000), ("train", 135_000)]
    split.explain("formatted")
    assert "SinglePartition" not in capsys.readouterr().out


def test_sums_before(spark):
    df = spark.createDataFrame([(f"k{i:03}", i, 1) for i in range(300)], "k string, n bigint, _at int").repartition(3)
    got = sums_before(df, ["k"], "n", "before", block_rows=17).collect()
    assert {r["n"]: r["before"] for r in got} == {i: i * (i - 1) // 2 for i in range(300)}
