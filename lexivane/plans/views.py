"""Views over the driver tables that give the operators' inputs their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import text
from lexivane.operators import corpus as corpora
from lexivane.operators import vocab
from lexivane.session import spread, written
from lexivane.sources.ordering import dense_index
from lexivane.sources.triplets import flag_triplets

TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows


def _next(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Add the column of the next row by dense index: an equi-join, no window."""
    following = rows.select((F.col("idx") - 1).alias("idx"), F.col(column).alias(out))
    return rows.join(following, "idx", "left")


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents as triplets: the first sentence asks, the negative is the next document.

    Written once: most plans read it several times.
    """
    english = table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    rows = dense_index(english.select("doc_id", "lang", "text"), ["doc_id"])
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = _next(rows, "text", "_next").join(labels, "doc_id", "left")
    shaped = joined.select(
        "idx",
        "doc_id",
        F.col("lang").alias("language"),
        F.substring_index("text", ".", 1).alias("query"),
        F.when(F.coalesce(F.col("quality") != 0, F.lit(True)), F.col("text")).alias("positive"),
        F.when(F.coalesce(F.col("toxic") != 1, F.lit(True)), F.col("_next")).alias("negative"),
    )
    return spread(written(flag_triplets(shaped), "triplets", "zstd"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the answer that follows; the negative is the next pair's answer."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    answers = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive")
    )
    pairs = asked.join(answers, ["conv_id", "turn"], "left")
    # Later turns of a conversation share one key and are ordered inside it.
    key = F.col("conv_id") + F.least(F.col("turn"), F.lit((1 << 22) - 1)) / F.lit(float(1 << 22))
    rows = dense_index(pairs, ["conv_id", "turn"], "idx", key)
    return written(flag_triplets(_next(rows, "positive", "negative")), "turns")


def corpus(rows: DataFrame) -> DataFrame:
    return corpora.index_corpus(corpora.create_corpus(rows))


def vocabulary(spark: SparkSession, sf_dir: str, lang: str = "en", size: int = config.VOCAB_SIZE) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") == lang)
    return vocab.create_vocabulary(docs, size, "text", "doc_id")


def token_vectors(spark: SparkSession, sf_dir: str, second: bool = False, words: DataFrame | None = None) -> DataFrame:
    """A static model: the vector of a token is the embedding at its rank, counted round. words: a vocabulary made before."""
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    place = F.col("token_id") if not second else F.col("token_id") * 7 + 3
    at = place % embeddings.agg(F.count(F.lit(1))).scalar()
    tokens = (vocabulary(spark, sf_dir) if words is None else words).withColumn("vec_id", at)
    return written(tokens.join(embeddings, "vec_id").drop("vec_id"), "model")


def internal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark")
    return texts.select(F.explode(text.words(F.col("text"))).alias("token")).distinct()


def raw_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pieces of documents and page addresses between blanks."""
    texts = table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "pages").select("url"))
    pieces = texts.select(F.explode(F.split("text", r"[ \t\n\r\f]+")).alias("token"))
    return pieces.filter(F.col("token") != "").distinct()


def stem_map(words: DataFrame) -> DataFrame:
    """(word, stem): longer words without their final s."""
    token = F.col("token")
    plural = (F.length(token) > 4) & token.endswith("s")
    stem = F.substring(token, F.lit(1), F.length(token) - 1)
    return words.filter(plural).select(token.alias("word"), stem.alias("stem"))
