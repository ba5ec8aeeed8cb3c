"""Pair predictions and classification metrics.

Metrics come from four counts per group, so every report is one aggregation.
The truth is all ones unless a truth column is named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.functions import text, vectors
from lexivane.operators.encode import encode_columns
from lexivane.sources.triplets import complete_pairs


def nearer(pos_dist: Column, neg_dist: Column) -> Column:
    """1 if the positive is strictly nearer."""
    return F.coalesce((pos_dist < neg_dist).cast("int"), F.lit(0))


def more_similar(pos: Column, neg: Column) -> Column:
    """1 if the positive is strictly more similar; unknown counts as 0."""
    return F.coalesce((pos > neg).cast("int"), F.lit(0))


def pair_vectors(triplets: DataFrame, model: DataFrame, query_model: DataFrame | None = None, query_col: str = "query", normalize: bool = False) -> DataFrame:
    """(idx, q, p, n): vectors of the complete pairs."""
    rows = complete_pairs(triplets).select("idx", F.col(query_col).alias("query"), "positive", "negative")
    specs = {"q": ("query", query_model or model), "p": ("positive", model), "n": ("negative", model)}
    return encode_columns(rows, specs, normalize=normalize).select("idx", "q", "p", "n")


def predict_by_distance(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "idx",
        F.round(vectors.euclidean(F.col("q"), F.col("p")), 6).alias("pos_dist"),
        F.round(vectors.euclidean(F.col("q"), F.col("n")), 6).alias("neg_dist"),
    ).withColumn("prediction", nearer(F.col("pos_dist"), F.col("neg_dist")))


def predict_by_cosine(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "idx",
        F.round(vectors.cosine(F.col("q"), F.col("p")), 6).alias("pos_sim"),
        F.round(vectors.cosine(F.col("q"), F.col("n")), 6).alias("neg_sim"),
    ).withColumn("prediction", more_similar(F.col("pos_sim"), F.col("neg_sim")))


def instruct_queries(triplets: DataFrame) -> DataFrame:
    """Triplets whose query carries the Danish instruction."""
    return triplets.withColumn("query", text.danish_detailed_instruct(F.col("query")))


def _counts(predictions: DataFrame, by: Sequence[str], prediction: str, truth: str | None) -> DataFrame:
    """A missing prediction counts as the wrong one; a missing truth is an error."""
    actual = F.lit(True)
    if truth is not None:
        actual = F.coalesce(F.col(truth) == 1, F.raise_error(F.lit(f"{truth} is null")).cast("boolean"))
    positive = F.coalesce(F.col(prediction) == 1, ~actual)
    return predictions.groupBy(*by).agg(
        F.count_if(~actual & ~positive).alias("_00"),
        F.count_if(~actual & positive).alias("_01"),
        F.count_if(actual & ~positive).alias("_10"),
        F.count_if(actual & positive).alias("_11"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _scores(hit: Column, predicted: Column, actual: Column) -> dict[str, Column]:
    precision, recall = _share(hit, predicted), _share(hit, actual)
    return {
        "precision": precision,
        "recall": recall,
        "f1_score": _share(2 * hit, predicted + actual),
    }


def classification_metrics(
    predictions: DataFrame, by: Sequence[str] = (), prediction: str = "prediction", truth: str | None = None
) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where undefined."""
    n00, n01, n10, n11 = (F.col(c) for c in ("_00", "_01", "_10", "_11"))
    scores = _scores(n11, n01 + n11, n10 + n11)
    scores = {"accuracy": _share(n00 + n11, n00 + n01 + n10 + n11), **scores}
    return _counts(predictions, by, prediction, truth).select(
        *by, *[F.round(value, 6).alias(name) for name, value in scores.items()]
    )


def confusion_matrix(
    predictions: DataFrame, by: Sequence[str] = (), prediction: str = "prediction", truth: str | None = None
) -> DataFrame:
    """Always four cells: (actual, predicted, n)."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"_{a}{p}").alias("n"))
            for a in (0, 1)
            for p in (0, 1)
        ]
    )
    return _counts(predictions, by, prediction, truth).select(*by, F.inline(cells))


def class_report(
    predictions: DataFrame, by: Sequence[str] = (), prediction: str = "prediction", truth: str | None = None
) -> DataFrame:
    """(label, precision, recall, f1_score, support) per class met, with averages."""
    n00, n01, n10, n11 = (F.col(c) for c in ("_00", "_01", "_10", "_11"))
    names = ("precision", "recall", "f1_score")
    classes = {
        "0": (_scores(n00, n00 + n10, n00 + n01), n00 + n01, n00 + n01 + n10 > 0),
        "1": (_scores(n11, n01 + n11, n10 + n11), n10 + n11, n11 + n01 + n10 > 0),
    }
    support = n00 + n01 + n10 + n11
    met = sum((c[2].cast("int") for c in classes.values()), F.lit(0))

    def row(label: str, values: dict[str, Column], size: Column) -> Column:
        rounded = [F.round(values[n], 6).alias(n) for n in names]
        return F.struct(F.lit(label).alias("label"), *rounded, size.cast("bigint").alias("support"))

    rows = [F.when(c[2], row(label, c[0], c[1])) for label, c in classes.items()]
    accuracy = _share(n00 + n11, support)
    macro = {n: _share(sum((c[0][n] * c[2].cast("int") for c in classes.values()), F.lit(0.0)), met) for n in names}
    weighted = {n: _share(sum((c[0][n] * c[1] for c in classes.values()), F.lit(0.0)), support) for n in names}
    rows += [
        row("accuracy", {n: accuracy for n in names}, support),
        row("macro avg", macro, support),
        row("weighted avg", weighted, support),
    ]
    present = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return _counts(predictions, by, prediction, truth).select(*by, F.inline(present))


def ensemble(predictions: DataFrame, threshold: int = 2) -> DataFrame:
    """(idx, prediction) by vote over long predictions (model, idx, prediction)."""
    votes = predictions.groupBy("idx").agg(F.sum("prediction").alias("_votes"))
    return votes.select("idx", (F.col("_votes") >= threshold).cast("int").alias("prediction"))


def evaluate_model(
    triplets: DataFrame, model: DataFrame, instruction_model: DataFrame, normalize: bool = False
) -> DataFrame:
    """(idx, prediction, prediction_with_instruction) of the complete pairs.

    The second prediction encodes the query with the instruction model.
    """
    rows = complete_pairs(triplets).select("idx", "query", "positive", "negative")
    specs = {
        "q": ("query", model),
        "qi": ("query", instruction_model),
        "p": ("positive", model),
        "n": ("negative", model),
    }
    coded = encode_columns(rows, specs, normalize=normalize)

    def prediction(query: str) -> Column:
        near = [F.round(vectors.euclidean(F.col(query), F.col(side)), 6) for side in ("p", "n")]
        return nearer(*near)

    return coded.select(
        "idx",
        prediction("q").alias("prediction"),
        prediction("qi").alias("prediction_with_instruction"),
    )
