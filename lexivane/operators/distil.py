"""A static model from an encoder, a vocabulary and a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import text, vectors
from lexivane.operators import pca, vocab
from lexivane.operators.encode import Encoder, encode_column
from lexivane.session import written
from lexivane.sources.ordering import dense_index


def token_table(external: DataFrame | None, internal: DataFrame | None, pattern: str | None) -> DataFrame:
    """(token_id, token, is_internal): internal tokens, then the added ones.

    external and internal hold (token_id, token). Duplicates, external tokens
    that are internal already, and tokens the pattern matches are left out.
    """
    given = [(df, kind) for df, kind in ((internal, True), (external, False)) if df is not None]
    if not given:
        raise ValueError("no tokens given")
    rows = None
    for df, kind in given:
        part = df.select("token", F.struct(F.lit(not kind).alias("added"), F.col("token_id").alias("at")).alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    kept = rows if pattern is None else rows.filter(~text.is_removed(F.col("token"), pattern))
    # Internal sorts before added, so a token in both stays internal.
    once = kept.groupBy("token").agg(F.min("place").alias("place")).select("token", "place.added", "place.at")
    key = F.when(F.col("added"), 1.0 + _fraction("at")).otherwise(_fraction("at"))
    ids = dense_index(written(once, "tokens"), ["added", "at", "token"], "token_id", key)
    return ids.select("token_id", "token", (~F.col("added")).alias("is_internal"))


def _fraction(column: str):
    """A number in [0, 1) that grows with a non-negative BIGINT."""
    at = F.col(column).cast("double")
    return at / (at + 1024.0)


def distil(
    texts: DataFrame,
    encoder_factory: Callable[[], Encoder],
    vocabulary: DataFrame | None = None,
    internal: DataFrame | None = None,
    instruction: str | None = None,
    pca_dims: int | str | None = 256,
    focus_pca: bool = False,
    sif_coefficient: float | None = config.SIF_COEFFICIENT,
    apply_zipf: bool | None = None,
    prenormalize: bool = False,
    pre_pca_normalize: bool = False,
    normalize: bool = False,
    token_remove_pattern: str | None = config.DEFAULT_PATTERN,
    batch_size: int = 1000,
) -> tuple[DataFrame, dict]:
    """(model, settings) from texts (ord, text).

    Every token is encoded alone (with the instruction, if given); its vector
    is reduced, weighted by how rare the token is in the texts, and stored in
    single precision. model holds (token_id, token, weight, vector).
    """
    sif, pattern = text.validate_parameters(apply_zipf, sif_coefficient, token_remove_pattern)
    known = written(token_table(vocabulary, internal, pattern), "vocabulary")
    if known.isEmpty():
        raise ValueError("no token is left; check the removal pattern")
    counts = written(vocab.token_frequencies(known, texts), "frequencies")
    tokens = vocab.with_unknown(known)
    asked = tokens.withColumn("_input", text.token_input(F.col("token"), instruction))
    coded = written(encode_column(asked, "_input", "vector", encoder_factory, batch_size), "encoded")
    width = coded.agg(F.max(F.size("vector"))).first()[0] or 0
    full = F.coalesce(vectors.doubles(F.col("vector")), F.array_repeat(F.lit(0.0), width))
    rows = coded.select("token_id", "token", vectors.repair_nan(full).alias("vector"))
    if pre_pca_normalize:
        rows = rows.withColumn("vector", vectors.unit(F.col("vector")))
    rows = pca.reduce_dimensions(rows, "vector", pca_dims, counts if focus_pca else None)
    if prenormalize:
        rows = rows.withColumn("vector", vectors.unit(F.col("vector")))
    weights = vocab.sif_weights(tokens, counts, sif)
    weighted = vectors.scale(F.col("vector"), F.col("weight"))
    model = rows.join(weights, "token_id").select(
        "token_id", "token", "weight", vectors.floats(weighted).alias("vector")
    )
    model = written(model, "model")
    settings = {
        "model_type": "static",
        "apply_pca": pca_dims,
        "apply_zipf": False,
        "sif_coefficient": sif,
        "hidden_dim": model.agg(F.max(F.size("vector"))).first()[0],
        "seq_length": 1_000_000,
        "normalize": normalize,
    }
    return model, settings
