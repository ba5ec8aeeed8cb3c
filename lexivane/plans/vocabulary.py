"""Registered queries on vocabularies, counts and weights."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import vectors
from lexivane.operators import corpus as corpora
from lexivane.operators import vocab
from lexivane.plans import views
from lexivane.plans.oracle import sql, words
from lexivane.session import written

SAMPLED_TEXTS = 300
SIFS = (0.01, 0.005, 0.001, 0.0005, 0.0001)


def _texts(spark, sf_dir):
    return corpora.stack_texts(views.triplets(spark, sf_dir), corpora.FEATURE_COLUMNS[:1] + corpora.CORPUS_COLUMNS)


def _documents(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")


def _counts(spark, sf_dir):
    """The vocabulary and its counts, each computed once."""
    vocabulary = written(views.vocabulary(spark, sf_dir), "vocabulary")
    return vocabulary, written(vocab.token_frequencies(vocabulary, _documents(spark, sf_dir)), "frequencies")


def _ranked(spark, sf_dir):
    return vocab.rank_words(vocab.word_counts(_texts(spark, sf_dir)))


def vocabulary_top(spark, sf_dir):
    return vocab.create_vocabulary(_texts(spark, sf_dir), config.VOCAB_SIZE)


def vocabulary_stemmed(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    stems = views.stem_map(vocab.word_counts(texts))
    return vocab.create_vocabulary(texts, config.VOCAB_SIZE, stems=stems)


def vocabulary_added(spark, sf_dir):
    return vocab.added_tokens(views.vocabulary(spark, sf_dir), views.internal_tokens(spark, sf_dir))


def vocabulary_report(spark, sf_dir):
    return vocab.added_report(views.vocabulary(spark, sf_dir), views.internal_tokens(spark, sf_dir))


def token_frequencies(spark, sf_dir):
    return _counts(spark, sf_dir)[1].select("token_id", "n")


def token_frequencies_sample(spark, sf_dir):
    """Counts over a seeded sample of the documents."""
    vocabulary = written(views.vocabulary(spark, sf_dir), "vocabulary")
    return vocab.token_frequencies(vocabulary, _documents(spark, sf_dir), sample_size=SAMPLED_TEXTS).select("token_id", "n")


def tokens_by_frequency(spark, sf_dir):
    vocabulary = written(views.vocabulary(spark, sf_dir), "vocabulary")
    counts = vocab.token_frequencies(vocabulary, views.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * F.lit(Decimal(1 << 32)) + F.col("turn")).alias("ord"), "text"))
    return vocab.sort_by_frequency(vocabulary, written(counts, "frequencies"))


def rank_table(spark, sf_dir):
    return _ranked(spark, sf_dir).withColumn("prob", F.round("prob", 9))


def count_boundaries(spark, sf_dir):
    return vocab.count_boundaries(_ranked(spark, sf_dir))


def rank_sample(spark, sf_dir):
    return vocab.decimate_ranks(_ranked(spark, sf_dir)).select("rank", "word", "counts")


def sif_weights(spark, sf_dir):
    vocabulary, counts = _counts(spark, sf_dir)
    weights = vocab.sif_weights(vocab.with_unknown(vocabulary), counts)
    return weights.withColumn("weight", F.round("weight", 9))


def sif_sweep(spark, sf_dir):
    vocabulary, counts = _counts(spark, sf_dir)
    weights = vocab.sif_weights(vocab.with_unknown(vocabulary), counts, SIFS)
    return weights.withColumn("weight", F.round("weight", 9))


def zipf_weights(spark, sf_dir):
    rounded = [F.round(c, 9).alias(c) for c in ("zipf_prob", "estimated_weight", "estimated_prob", "prob")]
    ratio = F.round("prob_ratio", 6).alias("prob_ratio")
    return vocab.zipf_weights(_ranked(spark, sf_dir)).select("rank", "word", "counts", *rounded, ratio)


def _long(df, key, column):
    """(key, dim, value) from an array column."""
    return df.select(key, F.posexplode(vectors.doubles(F.col(column))).alias("dim", "value")).select(
        key, F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value")
    )


def weighted_vectors(spark, sf_dir):
    vocabulary, counts = _counts(spark, sf_dir)
    weights = vocab.sif_weights(vocabulary, counts)
    model = views.token_vectors(spark, sf_dir, words=vocabulary).join(weights, "token_id")
    scaled = vectors.scale(vectors.doubles(F.col("vector")), F.col("weight"))
    return _long(model.select("token_id", scaled.alias("vector")), "token_id", "vector")


def unit_vectors(spark, sf_dir):
    """Embeddings stretched by their label, then brought back to length 1."""
    rows = views.table(spark, sf_dir, "embeddings")
    stretched = vectors.scale(vectors.doubles(F.col("embedding")), F.col("label").cast("double"))
    return _long(rows.select("vec_id", vectors.unit(stretched).alias("v")), "vec_id", "v")


def vector_norms(spark, sf_dir):
    model = views.token_vectors(spark, sf_dir)
    norm = vectors.l2_norm(vectors.doubles(F.col("vector")))
    return model.select("token_id", F.round(norm, 6).alias("l2_norm"))


def vectors_float(spark, sf_dir):
    """Single precision of double arithmetic on the embeddings."""
    rows = views.table(spark, sf_dir, "embeddings")
    third = F.transform(vectors.doubles(F.col("embedding")), lambda x: x / 3)
    return _long(rows.select("vec_id", vectors.floats(third).alias("v")), "vec_id", "v")


def vectors_nan_repaired(spark, sf_dir):
    """Label 0 loses every value, label 1 gets infinities of the value's sign."""
    rows = views.table(spark, sf_dir, "embeddings")

    def broken(x):
        return F.when(F.col("label") == 0, F.lit(float("nan"))).when(
            F.col("label") == 1, F.signum(x) * float("inf")
        ).otherwise(x)

    damaged = rows.select("vec_id", F.transform(vectors.doubles(F.col("embedding")), broken).alias("v"))
    fixed = damaged.select("vec_id", vectors.all_nan(F.col("v")).alias("all_nan"), vectors.repair_nan(F.col("v"), 1e6).alias("v"))
    long = fixed.select("vec_id", "all_nan", F.posexplode("v").alias("dim", "value"))
    return long.select("vec_id", "all_nan", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def nan_report(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings")
    value = F.transform(vectors.doubles(F.col("embedding")), lambda x: F.when(F.col("label") == 0, F.lit(float("nan"))).otherwise(x))
    return rows.select("label", vectors.all_nan(value).alias("bad")).agg(
        F.count_if("bad").alias("nan_rows"), F.count(F.lit(1)).alias("n_rows")
    )


QUERIES = {
    "vocabulary_top": vocabulary_top,
    "vocabulary_stemmed": vocabulary_stemmed,
    "vocabulary_added": vocabulary_added,
    "vocabulary_report": vocabulary_report,
    "token_frequencies": token_frequencies,
    "token_frequencies_sample": token_frequencies_sample,
    "tokens_by_frequency": tokens_by_frequency,
    "rank_table": rank_table,
    "count_boundaries": count_boundaries,
    "rank_sample": rank_sample,
    "sif_weights": sif_weights,
    "sif_sweep": sif_sweep,
    "zipf_weights": zipf_weights,
    "weighted_vectors": weighted_vectors,
    "unit_vectors": unit_vectors,
    "vector_norms": vector_norms,
    "vectors_float": vectors_float,
    "vectors_nan_repaired": vectors_nan_repaired,
    "nan_report": nan_report,
}

_SHARE = """coalesce(c.n, (select min(n) from token_counts))
    / cast((select sum(n) from token_counts) as double)"""
_SIFS = ", ".join(f"{s}::double" for s in SIFS)


def _dims(value: str, source: str, key: str) -> str:
    return f"select {key}, cast(unnest(range(64)) as bigint) as dim, round(unnest({value}), 6) + 0.0e0 as value from {source}"


ORACLES = {
    "vocabulary_top": sql(
        """select row_number() over (order by n desc, first) - 1 as token_id, token, n
        from stacked_words order by n desc, first limit 150000"""
    ),
    "vocabulary_stemmed": sql(
        """select row_number() over (order by n desc, first) - 1 as token_id, token, cast(n as bigint) as n
        from (select case when length(token) > 4 and token like '%s' then substr(token, 1, length(token) - 1)
                     else token end as token, sum(n) as n, min(first) as first
              from stacked_words group by 1) order by n desc, first limit 150000"""
    ),
    "vocabulary_added": sql("select token from vocab_en where token not in (select token from internal_tokens)"),
    "vocabulary_report": sql(
        """select count(*) filter (i.token is null) as added, count(*) filter (i.token is not null) as removed
        from vocab_en v left join internal_tokens i on i.token = v.token"""
    ),
    "token_frequencies": sql("select token_id, n from token_counts"),
    "token_frequencies_sample": sql(
        f"""select coalesce(v.token_id, (select max(token_id) from full_vocab)) as token_id, count(*) as n
        from (select unnest({words('text')}) as token from (select text from documents
              order by md5('{config.RANDOM_STATE}:' || doc_id) limit {SAMPLED_TEXTS})) w
          left join full_vocab v on v.token = w.token group by 1"""
    ),
    "tokens_by_frequency": sql(
        r"""select row_number() over (order by c.n is null, c.n desc, c.first, v.token_id) - 1 as position,
            v.token_id, v.token, c.n
        from full_vocab v left join (
            select coalesce(f.token_id, (select max(token_id) from full_vocab)) as token_id,
                   cast(sum(w.n) as bigint) as n, min(w.first) as first
            from (select token, count(*) as n, min(row(conv_id, turn, pos)) as first
                  from (select conv_id, turn, unnest(w) as token, generate_subscripts(w, 1) as pos
                        from (select conv_id, turn,
                              regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') as w from conversations))
                  group by token) w
            left join full_vocab f on f.token = w.token group by 1) c on c.token_id = v.token_id"""
    ),
    "rank_table": sql("select rank, word, counts, round(prob, 9) as prob from ranked"),
    "count_boundaries": sql(
        "select counts, min(rank) as rank from ranked group by counts order by rank desc limit 100"
    ),
    "rank_sample": sql("select rank, word, counts from ranked where rank < 1000 or rank % 1000 = 0"),
    "sif_weights": sql(
        f"""select v.token_id, round(1e-3::double / (1e-3::double + {_SHARE}), 9) as weight
        from full_vocab v left join token_counts c on c.token_id = v.token_id"""
    ),
    "sif_sweep": sql(
        f"""select s.sif, v.token_id, round(s.sif / (s.sif + {_SHARE}), 9) as weight
        from (select unnest([{_SIFS}]) as sif) s, full_vocab v left join token_counts c on c.token_id = v.token_id"""
    ),
    "zipf_weights": sql(
        """select rank, word, counts, round(zipf_prob, 9) as zipf_prob, round(w, 9) as estimated_weight,
            round(1.0e0 / w / wsum, 9) as estimated_prob, round(prob, 9) as prob,
            round(prob / (1.0e0 / w / wsum), 6) as prob_ratio
        from (select *, sum(w) over () as wsum
              from (select *, 1e-4::double / (1e-4::double + zipf_prob) as w
                    from (select *, (1.0e0 / (rank + 2)) / sum(1.0e0 / (rank + 2)) over () as zipf_prob from ranked)))"""
    ),
    "weighted_vectors": sql(
        _dims(
            "list_transform(cast(vector as double[]), lambda x: x * weight)",
            f"""(select t.token_id, t.vector, 1e-3::double / (1e-3::double + {_SHARE}) as weight
            from token_vectors t left join token_counts c on c.token_id = t.token_id)""",
            "token_id",
        )
    ),
    "unit_vectors": _dims(
        "list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12::double))",
        """(select vec_id, list_transform(cast(embedding as double[]), lambda x: x * label) as v from embeddings)""",
        "vec_id",
    ),
    "vector_norms": sql(
        """select token_id, round(sqrt(list_inner_product(cast(vector as double[]), cast(vector as double[]))), 6)
        as l2_norm from token_vectors"""
    ),
    "vectors_float": _dims(
        "list_transform(cast(embedding as double[]), lambda x: cast(cast(x / 3 as float) as double))",
        "embeddings",
        "vec_id",
    ),
    "vectors_nan_repaired": """select vec_id, label = 0 as all_nan, cast(dim as bigint) as dim,
        round(case when label = 0 then 0.0e0 when label = 1 then sign(value) * 1e6::double else value end, 6) as value
        from (select vec_id, label, unnest(range(64)) as dim, unnest(cast(embedding as double[])) as value
              from embeddings)""",
    "nan_report": "select count(*) filter (label = 0) as nan_rows, count(*) as n_rows from embeddings",
}
