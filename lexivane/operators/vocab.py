"""Word vocabularies, token counts and token weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane import config
from lexivane.functions import text
from lexivane.operators.splits import sample_rows
from lexivane.session import written
from lexivane.sources.ordering import dense_index

# (text order, word position) in one DECIMAL, so that the first sight of a word
# is a plain min of a fixed-width value. It holds every position in a text, and
# an order of any BIGINT or of a decimal up to 2^95.
_POSITIONS = Decimal(1 << 31)
_HEAP = 20_000


def word_counts(
    texts: DataFrame,
    text_col: str = "text",
    ord_col: str = "ord",
    tokenize: Callable[[Column], Column] = text.words,
    stems: DataFrame | None = None,
) -> DataFrame:
    """(token, n, first): count and first sight of every word.

    stems (word, stem) merges words before counting; a word without a stem
    stays. The lookup runs on counted words, one row each, so that no frequent
    word makes a large group.
    """
    exploded = texts.select(F.col(ord_col).alias("_ord"), F.posexplode(tokenize(F.col(text_col))).alias("_pos", "token"))
    counts = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"), _first_sight(exploded).alias("first"))
    if stems is None:
        return counts
    merged = counts.join(stems.withColumnRenamed("word", "token"), "token", "left")
    return merged.groupBy(F.coalesce("stem", "token").alias("token")).agg(
        F.sum("n").alias("n"), F.min("first").alias("first")
    )


def _first_sight(words: DataFrame) -> Column:
    """Least packed (order, position). Orders that leave a BIGINT room for the position are compared as such, which is cheaper a word."""
    packed = F.col("_ord") * F.lit(_POSITIONS) + F.col("_pos")
    kind = words.schema["_ord"].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType)):
        return F.min(packed)
    fits = F.col("_ord").between(0, (1 << 32) - 1)
    near = F.min(F.when(fits, F.shiftleft(F.col("_ord").cast("bigint"), 31) + F.col("_pos")))
    return F.least(F.min(F.when(~fits, packed)), near.cast(words.select(packed).schema[0].dataType))


def create_vocabulary(
    texts: DataFrame,
    vocab_size: int = config.VOCAB_SIZE,
    text_col: str = "text",
    ord_col: str = "ord",
    tokenize: Callable[[Column], Column] = text.words,
    stems: DataFrame | None = None,
) -> DataFrame:
    """(token_id, token, n): the most frequent words, ties by first sight.

    A small cut is one bounded top-n; a large one is ranked in range buckets,
    so that its rows never pass through a single task.
    """
    counts = word_counts(texts, text_col, ord_col, tokenize, stems)
    if vocab_size <= _HEAP:
        top = counts.orderBy(F.desc("n"), "first").limit(vocab_size)
        # At most vocab_size rows reach this window.
        place = F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1
        return top.select(place.cast("bigint").alias("token_id"), "token", "n")
    ranked = _ranked(written(counts, "counts"), "token_id")
    return ranked.filter(F.col("token_id") < vocab_size).select("token_id", "token", "n")


def _by_count() -> Column:
    """A number that never falls from frequent to rare words, first seen ones first."""
    return F.log2(F.greatest(F.col("first").cast("double"), F.lit(0.0)) + 1) / 128 - F.col("n").cast("double")


def _ranked(counts: DataFrame, name: str, rows_per_bucket: int | None = None) -> DataFrame:
    key = _by_count()
    return dense_index(counts, [F.desc("n"), F.asc("first")], name, key, rows_per_bucket)


def rank_words(counts: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """(rank, word, counts, prob) for every word, most frequent first."""
    counts = written(counts, "counts")
    total = counts.agg(F.sum("n")).scalar()
    ranked = _ranked(counts, "rank", rows_per_bucket)
    return ranked.select(
        "rank", F.col("token").alias("word"), F.col("n").alias("counts"), (F.col("n") / total).alias("prob")
    )


def count_boundaries(ranked: DataFrame, rows: int = 100) -> DataFrame:
    """First rank at each count, deepest ranks first."""
    return (
        ranked.groupBy("counts").agg(F.min("rank").alias("rank")).orderBy(F.desc("rank")).limit(rows)
    )


def decimate_ranks(ranked: DataFrame, head: int = 1000, step: int = 1000) -> DataFrame:
    return ranked.filter((F.col("rank") < head) | (F.col("rank") % step == 0))


def added_tokens(external: DataFrame, internal: DataFrame) -> DataFrame:
    """External tokens, once each, that the internal vocabulary lacks."""
    return external.select("token").distinct().join(internal.select("token"), "token", "left_anti")


def added_report(external: DataFrame, internal: DataFrame) -> DataFrame:
    given = external.agg(F.count(F.lit(1)).alias("_n"))
    return added_tokens(external, internal).agg(F.count(F.lit(1)).alias("added")).select(
        "added", (given.scalar() - F.col("added")).alias("removed")
    )


def with_unknown(vocab: DataFrame) -> DataFrame:
    """Vocabulary with the unknown token appended under the next id."""
    extra = vocab.agg(F.coalesce(F.max("token_id") + 1, F.lit(0).cast("bigint")).alias("token_id"))
    return vocab.select("token_id", "token").unionByName(
        extra.select("token_id", F.lit(config.UNKNOWN_TOKEN).alias("token"))
    )


def token_frequencies(
    vocab: DataFrame,
    texts: DataFrame,
    text_col: str = "text",
    ord_col: str = "ord",
    tokenize: Callable[[Column], Column] = text.words,
    sample_size: int | None = None,
    seed: int = config.RANDOM_STATE,
) -> DataFrame:
    """(token_id, n, first) over the texts; a word not in vocab is unknown.

    Words are counted before the lookup, so the join sees each word once. With
    a sample_size the counts are those of so many texts, drawn by seed and ord.
    """
    full = with_unknown(vocab)
    if sample_size is not None:
        texts = sample_rows(texts, sample_size, seed, ord_col)
    kept = texts.filter(text.not_blank(F.col(text_col))).withColumn(text_col, text.strip(F.col(text_col)))
    counts = word_counts(kept, text_col, ord_col, tokenize)
    unknown = full.filter(F.col("token") == config.UNKNOWN_TOKEN).agg(F.max("token_id")).scalar()
    found = counts.join(full, "token", "left")
    return found.groupBy(F.coalesce(F.col("token_id"), unknown).alias("token_id")).agg(
        F.sum("n").alias("n"), F.min("first").alias("first")
    )


def sort_by_frequency(vocab: DataFrame, counts: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """(position, token_id, token, n): seen tokens by count, then the rest by id."""
    joined = with_unknown(vocab).join(counts, "token_id", "left")
    order = [F.col("n").isNull(), F.desc("n"), F.asc("first"), F.asc("token_id")]
    key = F.coalesce(F.when(F.col("n").isNotNull(), _by_count()), F.col("token_id").cast("double") + 1)
    return dense_index(joined, order, "position", key, rows_per_bucket).select(
        "position", "token_id", "token", "n"
    )


def sif_weights(vocab: DataFrame, counts: DataFrame, sifs: float | Sequence[float] | None = config.SIF_COEFFICIENT) -> DataFrame:
    """(token_id, weight), or (sif, token_id, weight) for several coefficients.

    An unseen token weighs as much as the rarest seen one; no coefficient
    means weight 1.
    """
    ids = vocab.select("token_id")
    if sifs is None:
        return ids.withColumn("weight", F.lit(1.0))
    total = F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(1))
    rarest = F.coalesce(counts.agg(F.min("n")).scalar(), F.lit(1))
    several = not isinstance(sifs, (int, float))
    grid = F.explode(F.array(*[F.lit(float(s)) for s in (sifs if several else [sifs])]))
    share = F.coalesce(F.col("n"), rarest).cast("double") / total
    weighted = (
        ids.join(counts.select("token_id", "n"), "token_id", "left")
        .withColumn("sif", grid)
        .withColumn("weight", F.col("sif") / (F.col("sif") + share))
    )
    return weighted.select(*(["sif"] if several else []), "token_id", "weight")


def zipf_weights(ranked: DataFrame, sif: float = config.ZIPF_SIF_COEFFICIENT) -> DataFrame:
    """Weights from ranks alone, beside the measured probabilities.

    estimated_prob keeps its published form, (1 / weight) / sum(weight); the
    probability the weights are built from is zipf_prob.
    """
    inverse = F.lit(1.0) / (F.col("rank") + 2)
    inverse_total = ranked.agg(F.sum(inverse)).scalar()
    weighted = ranked.withColumn("zipf_prob", inverse / inverse_total).withColumn(
        "estimated_weight", F.lit(sif) / (F.lit(sif) + F.col("zipf_prob"))
    )
    weight_total = weighted.agg(F.sum("estimated_weight")).scalar()
    estimated = F.lit(1.0) / F.col("estimated_weight") / weight_total
    return weighted.withColumn("estimated_prob", estimated).withColumn(
        "prob_ratio", F.col("prob") / F.col("estimated_prob")
    )
