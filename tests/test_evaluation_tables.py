import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.operators import compare, evaluation
from lexivane.session import new_path, shared_dir, written
from lexivane.sources import tables


def test_metrics_of_distances(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.1), (0.5, 0.2)], "p double, n double")
    df = df.withColumn("prediction", evaluation.nearer(F.col("p"), F.col("n")))
    assert [r["prediction"] for r in df.collect()] == [1, 1, 0]
    got = evaluation.classification_metrics(df).first()
    assert tuple(got) == (0.666667, 1.0, 0.666667, 0.8)
    assert [r["n"] for r in evaluation.confusion_matrix(df).collect()] == [0, 0, 1, 2]


def test_confusion_keeps_four_cells_when_all_are_right(spark):
    df = spark.createDataFrame([(1,), (1,)], "prediction int")
    assert sorted((r["actual"], r["predicted"], r["n"]) for r in evaluation.confusion_matrix(df).collect()) == [
        (0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 2),
    ]
    report = {r["label"]: r for r in evaluation.class_report(df).collect()}
    assert set(report) == {"1", "accuracy", "macro avg", "weighted avg"} and report["1"]["support"] == 2


def test_undefined_scores_are_zero(spark):
    df = spark.createDataFrame([(0,), (-1,)], "prediction int")
    assert tuple(evaluation.classification_metrics(df).first()) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(evaluation.classification_metrics(df.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)


def test_report_with_a_truth_column(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 0)] * 4 + [(0, 1)]
    df = spark.createDataFrame(rows, "truth int, prediction int")
    got = {r["label"]: r for r in evaluation.class_report(df, truth="truth").collect()}
    assert got["0"]["precision"] == pytest.approx(4 / 6, abs=1e-6) and got["0"]["recall"] == 0.8
    assert got["macro avg"]["recall"] == pytest.approx(0.7) and got["accuracy"]["precision"] == 0.7


def test_ensemble_needs_two_votes(spark):
    rows = [(m, i, p) for i, votes in enumerate([(1, 1, 0), (1, 0, 0), (1, 1, -1)]) for m, p in zip("abc", votes)]
    df = spark.createDataFrame(rows, "model string, idx bigint, prediction int")
    assert [r["prediction"] for r in evaluation.ensemble(df).orderBy("idx").collect()] == [1, 0, 0]


def test_model_evaluation(spark):
    triplets = spark.createDataFrame(
        [(0, "cat", "a cat", "dog"), (1, "dog", "cat", "dog"), (2, "cat", None, "dog")],
        "idx bigint, query string, positive string, negative string",
    )
    tokens = "token_id bigint, token string, vector array<float>"
    model = spark.createDataFrame([(0, "cat", [1.0]), (1, "dog", [0.0])], tokens)
    other = spark.createDataFrame([(0, "cat", [0.0]), (1, "dog", [1.0])], tokens)
    got = [tuple(r) for r in evaluation.evaluate_model(triplets, model, other).orderBy("idx").collect()]
    assert got == [(0, 1, 0), (1, 0, 1)]
    pairs = evaluation.pair_vectors(triplets, model)
    assert evaluation.predict_by_cosine(pairs).count() == 2


def test_comparison(spark):
    schema = "index bigint, text string, projection_x double, projection_y double"
    a = spark.createDataFrame([(0, "x", 1.0, 1.0), (1, "y", 2.0, 2.0)], schema)
    b = spark.createDataFrame([(0, "y", 5.0, 6.0), (1, "z", 3.0, 3.0)], schema)
    got = {r["text"]: r for r in compare.compare_models(a, b).collect()}
    assert got["x"]["is_redundant"] == 1 and got["x"]["diff_projection_x"] is None
    assert got["z"]["only_in_other"] == 1 and got["z"]["index"] is None
    assert (got["y"]["diff_projection_x"], got["y"]["diff_projection_y"]) == (3.0, 4.0)


def test_vocabulary_difference(spark):
    a = spark.createDataFrame([(f"a{i:02d}",) for i in range(15)] + [("s",)], "token string")
    b = spark.createDataFrame([("s",), ("b",)], "token string")
    got = {r["side"]: r for r in compare.vocabulary_difference(a, b).collect()}
    assert got["only_in_first"]["n"] == 15 and len(got["only_in_first"]["tokens"].split()) == 10
    assert got["only_in_other"]["tokens"] == "b" and got["in_both"]["n"] == 1


def test_arrows_chain(spark):
    rows = [(0, p, "t", [float(x), float(y)], n) for p, (x, y, n) in enumerate([(2, 0, 0.5), (0, 4, 5.0), (2, 2, 99.0)])]
    df = spark.createDataFrame(rows, "k bigint, position int, token string, vector array<double>, l2_norm double")
    shares = compare.contributions(df, ["k"])
    flat = shares.withColumn("x", F.col("share")[0]).withColumn("y", F.col("share")[1])
    got = compare.token_arrows(flat, ["k"]).orderBy("position").collect()
    ends = np.cumsum([[2, 0], [0, 4], [2, 2]], axis=0) / 3
    assert [[r["end_x"], r["end_y"]] for r in got] == [pytest.approx(list(e)) for e in ends]
    assert [r["line_width"] for r in got] == [1.0, 5.0, 20.0]
    assert got[0]["start_x"] == 0 and got[1]["start_x"] == pytest.approx(got[0]["end_x"])


def test_contributions_sum_to_the_projected_mean(spark):
    rng = np.random.default_rng(4)
    rows = [(k, p, rng.random(5).tolist()) for k in range(6) for p in range(k + 1)]
    df = spark.createDataFrame(rows, "k bigint, position int, vector array<double>")
    means = {k: np.mean([v for key, _, v in rows if key == k], axis=0) for k in range(6)}
    mean_df = spark.createDataFrame([(k, m.tolist()) for k, m in means.items()], "k bigint, vector array<double>")
    points, projected = compare.project_contributions(compare.contributions(df, ["k"]), mean_df)
    shares = np.array([np.array(v) / (k + 1) for k, _, v in rows])
    centre = shares.mean(axis=0)
    axes = np.linalg.svd(shares - centre, full_matrices=False)[2][:2].T
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    got = {r["k"]: (r["x"], r["y"]) for r in projected.collect()}
    for k, mean in means.items():
        assert got[k] == pytest.approx(tuple((mean - centre) @ axes))
    assert points.agg(F.round(F.sum("x"), 9)).first()[0] == pytest.approx(0.0)


def test_runs(spark):
    rows = [
        ("dim256", None, 1, "256", None, 0.5), ("dim256", None, 0, "256", True, 0.5),
        ("dimNone", None, 2, "None", None, 0.9), ("dim8_sif0.1", "p", 3, "8", None, 0.1),
    ]
    runs = spark.createDataFrame(rows, "run_name string, parent_run string, start_ord int, output_dim string, normalize boolean, accuracy double")
    parents = compare.parent_runs(runs)
    firsts = {r["run_name"]: r for r in compare.first_runs(parents, ["run_name"], "normalize").collect()}
    assert firsts["dim256"]["normalize"] is True and firsts["dim256"]["n_runs"] == 2
    assert firsts["dimNone"]["normalize"] is False
    numeric = parents.withColumn("d", compare.numeric_parameter(F.col("output_dim")))
    assert [r["d"] for r in compare.sort_runs(numeric, "d").collect()] == [256, 256, None]
    assert compare.select_runs(runs, ["dimNone"], containing="sif", also="dim256").count() == 4
    assert compare.select_runs(runs, containing="sif").count() == 1


def test_tables(spark):
    model = spark.createDataFrame([(0, "a", 0.5, [1.0, 2.0])], "token_id bigint, token string, weight double, vector array<double>")
    path = new_path(spark, "t")
    tables.save_model(model, {"model_type": "static"}, path)
    loaded, settings = tables.load_model(spark, path)
    assert loaded.first()["vector"] == [1.0, 2.0] and settings.first()["model_type"] == "static"

    features = spark.createDataFrame([(0, "train"), (1, "val"), (2, "test")], "idx bigint, split string")
    path = new_path(spark, "f")
    tables.save_features(features, path)
    assert tables.load_features(spark, path).count() == 3
    some = tables.load_features(spark, path, ["train", "val"])
    assert some.count() == 2
    assert "PartitionFilters: [isnotnull(split" in some._jdf.queryExecution().toString() or "PartitionFilters: [split" in some._jdf.queryExecution().toString()


def test_metrics_skip_nan(spark):
    path = new_path(spark, "m")
    wide = spark.createDataFrame([("a", 0.5, float("nan"))], "model string, accuracy double, f1 double")
    tables.append_metrics(tables.long_metrics(wide, "raw", ["model"]), path)
    tables.append_metrics(tables.long_metrics(wide.withColumn("model", F.lit("b")), "raw", ["model"]), path)
    got = tables.read_runs(spark, path).orderBy("run").collect()
    assert [tuple(r) for r in got] == [("raw.a", 0.5), ("raw.b", 0.5)]


def test_encoding_resumes_where_it_stopped(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def encode(items):
            calls.add(len(items))
            return [[float(len(t))] for t in items]

        return encode

    rows = spark.createDataFrame([(i, "x" * i) for i in range(20)], "corpus_idx bigint, pair string")
    path = new_path(spark, "e")
    tables.encode_and_save(rows.filter("corpus_idx < 8"), path, factory, chunk_size=5)
    saved = tables.encode_and_save(rows, path, factory, chunk_size=5)
    got = {r["corpus_idx"]: (r["embedding"], r["chunk"]) for r in saved.collect()}
    assert got == {i: ([float(i)], i // 5) for i in range(20)}
    assert calls.value == 20


def test_written_table_keeps_its_rows(spark):
    df = spark.range(10).withColumn("r", F.rand())
    kept = written(df)
    assert kept.collect() == kept.collect() and shared_dir(spark)
