"""Registered queries on encoding, search, fusion and recall."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import text, vectors
from lexivane.operators import bm25, cells, fusion, knn, postings, splits
from lexivane.operators import corpus as corpora
from lexivane.operators.encode import encode_column, encode_columns
from lexivane.plans import views
from lexivane.plans.oracle import mean_vectors, on_test_rows, sql
from lexivane.session import new_path, spread, written
from lexivane.sources import tables


@dataclass
class Retrieval:
    """One retrieval run over triplets: the parts are built when first used.

    The stages read the corpus as its numbering has written it.
    """

    triplets: DataFrame
    model: DataFrame | None = None
    second_model: DataFrame | None = None
    normalize: bool = False

    @cached_property
    def _parts(self):
        corpus = spread(corpora.index_corpus(corpora.create_corpus(self.triplets)))
        gold = corpora.gold_documents(corpus)
        queries = corpora.add_corpus_idx(self.triplets.select("idx", "query", "query_instruct"), gold)
        return corpus, queries.withColumnRenamed("idx", "query_idx")

    @property
    def corpus(self) -> DataFrame:
        return self._parts[0]

    @property
    def queries(self) -> DataFrame:
        return self._parts[1]

    def _encode(self, rows: DataFrame, key: str, source: str, model: DataFrame) -> DataFrame:
        coded = encode_columns(rows.select(key, source), {"vector": (source, model)}, self.normalize)
        return coded.select(key, "vector")

    def dense(self, k: int) -> DataFrame:
        queries = self._encode(self.triplets.withColumnRenamed("idx", "query_idx"), "query_idx", "query", self.model)
        return knn.nearest(queries, self._encode(self.corpus, "corpus_idx", "document", self.model), k)

    def lexical(self, k: int) -> DataFrame:
        queries = bm25.tokenised(self.triplets, "idx", "query", "query_idx")
        return bm25.search(queries, bm25.tokenised(self.corpus, "corpus_idx", "document", "corpus_idx"), k)

    def hybrid(self, k: int, rrf_k: int = config.RRF_K) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(fused, dense, lexical); both lists are written before they meet."""
        dense, lexical = written(self.dense(k), "dense"), written(self.lexical(k), "lexical")
        return fusion.reciprocal_rank_fusion([dense, lexical], rrf_k, k), dense, lexical

    def two_stage(self, stage1_k: int = config.STAGE1_K, final_k: int = config.TOP_K) -> DataFrame:
        """Hybrid candidates, reranked with the second model on prompted queries.

        Only documents that are a candidate of some query are encoded again.
        """
        candidates = written(self.hybrid(stage1_k)[0], "candidates")
        asked = self.triplets.withColumnRenamed("idx", "query_idx")
        queries = self._encode(asked, "query_idx", "query_instruct", self.second_model)
        chosen = candidates.select("corpus_idx").distinct()
        found = self.corpus.join(chosen, "corpus_idx", "left_semi")
        docs = self._encode(found, "corpus_idx", "document", self.second_model)
        return fusion.rerank(candidates, queries, docs, final_k)

    def recall(self, ranked: DataFrame) -> DataFrame:
        return fusion.mean_recall(fusion.recall_by_query(self.queries, ranked))


def _run(spark: SparkSession, sf_dir: str, second: bool = False, held_out: bool = False) -> Retrieval:
    """A run on all triplets, or on the test rows of a stratified split. Both models share one vocabulary."""
    vocabulary = written(views.vocabulary(spark, sf_dir), "vocabulary")
    first, other = (views.token_vectors(spark, sf_dir, s, vocabulary) if s <= second else None for s in (False, True))
    rows = _test_rows(spark, sf_dir) if held_out else views.triplets(spark, sf_dir)
    return Retrieval(rows, first, other)


def _test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.stratified_split(views.triplets(spark, sf_dir))
    return written(split.filter(F.col("split") == "test").drop("split"), "test")


def long_vectors(df: DataFrame, key: str, column: str = "vector") -> DataFrame:
    return df.select(key, F.posexplode(vectors.doubles(F.col(column))).alias("dim", "value")).select(
        key, F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value")
    )


def doc_vectors(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = views.token_vectors(spark, sf_dir)
    return long_vectors(encode_columns(docs, {"vector": ("text", model)}), "doc_id")


def doc_vectors_unit(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = views.token_vectors(spark, sf_dir)
    coded = encode_columns(docs, {"vector": ("text", model)}, normalize=True)
    return long_vectors(coded, "doc_id")


def bm25_topk(spark, sf_dir):
    return Retrieval(views.triplets(spark, sf_dir)).lexical(config.TOP_K)


def bm25_postings(spark, sf_dir):
    """The search of bm25_topk over a written postings table, opening only blocks that can still hold a better document."""
    run = Retrieval(views.triplets(spark, sf_dir))
    made = postings.build(bm25.tokenised(run.corpus, "corpus_idx", "document", "corpus_idx"))
    return postings.search(bm25.tokenised(run.triplets, "idx", "query", "query_idx"), made)


def knn_topk(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("query_idx"), F.col("embedding").alias("vector"))
    return knn.nearest(queries, queries.withColumnRenamed("query_idx", "corpus_idx"))


def knn_docs(spark, sf_dir):
    return _run(spark, sf_dir).dense(config.TOP_K)


def knn_columns(spark, sf_dir):
    """Retrieved documents with the column they came from, per query side."""
    run = _run(spark, sf_dir)
    found = run.dense(config.TOP_K).join(run.corpus.select("corpus_idx", "column"), "corpus_idx")
    return found.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("ranks"))


def knn_cells(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("query_idx"), F.col("embedding").alias("vector"))
    return knn.nearest_by_cells(queries, queries.withColumnRenamed("query_idx", "corpus_idx"))


def knn_cells_all(spark, sf_dir):
    """Every cell probed: must equal the exact search."""
    rows = views.table(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("query_idx"), F.col("embedding").alias("vector"))
    corpus = queries.withColumnRenamed("query_idx", "corpus_idx")
    return knn.nearest_by_cells(queries, corpus, cells=8, probes=8)


def knn_pivots(spark, sf_dir):
    """The dense search of knn_docs, with most pairs left out by the triangle inequality."""
    run = _run(spark, sf_dir)
    queries = run._encode(run.triplets.withColumnRenamed("idx", "query_idx"), "query_idx", "query", run.model)
    return cells.nearest(queries, cells.place(run._encode(run.corpus, "corpus_idx", "document", run.model)))


def knn_cells_quality(spark, sf_dir):
    """Per query of the approximate search: what it found, in which order, and how much of the exact result."""
    rows = views.table(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("query_idx"), F.col("embedding").alias("vector"))
    corpus = queries.withColumnRenamed("query_idx", "corpus_idx")
    found = written(knn.nearest_by_cells(queries, corpus), "found")
    exact = written(knn.nearest(queries, corpus), "exact")
    # A document that both lists hold has one score; one that only the approximate list holds is farther away.
    both = found.join(exact.select("query_idx", "corpus_idx", F.col("score").alias("true")), ["query_idx", "corpus_idx"], "left")
    worst = exact.groupBy("query_idx").agg(F.max("score").alias("worst"))
    both = both.join(worst, "query_idx").withColumn("fits", F.coalesce(F.col("score") == F.col("true"), F.col("score") >= F.col("worst")))
    by = both.groupBy("query_idx").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("rank") == 1, F.col("score"))).alias("nearest"),
        (F.count_if(~F.col("fits")) + F.count(F.lit(1)) - F.max("rank")).alias("faults"),
        F.count("true").alias("true"),
    )
    share = by.agg(F.sum("true") / F.sum("n"))
    return by.select("query_idx", "n", "nearest", "faults", (share.scalar() >= 0.9).alias("recall_reached"))


def rrf(spark, sf_dir):
    fused, _, _ = _run(spark, sf_dir).hybrid(config.TOP_K)
    return fused


def hybrid_overlap(spark, sf_dir):
    run = _run(spark, sf_dir)
    _, dense, lexical = run.hybrid(config.TOP_K)
    overlaps = fusion.overlap(run.queries, dense, lexical)
    return overlaps.select("query_idx", *[F.round(c, 6).alias(c) for c in overlaps.columns[1:]])


def hybrid_overlap_mean(spark, sf_dir):
    run = _run(spark, sf_dir)
    _, dense, lexical = run.hybrid(config.TOP_K)
    return fusion.mean_overlap(fusion.overlap(run.queries, dense, lexical))


def rerank(spark, sf_dir):
    return _run(spark, sf_dir, second=True).two_stage()


def recall_bm25(spark, sf_dir):
    run = Retrieval(views.triplets(spark, sf_dir))
    return run.recall(run.lexical(config.TOP_K))


def recall_by_query(spark, sf_dir):
    run = Retrieval(views.triplets(spark, sf_dir))
    return fusion.recall_by_query(run.queries, run.lexical(config.TOP_K))


def recall_embedding(spark, sf_dir):
    run = _run(spark, sf_dir)
    return run.recall(run.dense(config.TOP_K))


def recall_hybrid(spark, sf_dir):
    run = _run(spark, sf_dir)
    return run.recall(run.hybrid(config.TOP_K)[0])


def recall_rerank(spark, sf_dir):
    run = _run(spark, sf_dir, second=True)
    return run.recall(run.two_stage())


def recall_embedding_test(spark, sf_dir):
    run = _run(spark, sf_dir, held_out=True)
    return run.recall(run.dense(config.TOP_K))


def recall_bm25_test(spark, sf_dir):
    run = Retrieval(_test_rows(spark, sf_dir))
    return run.recall(run.lexical(config.TOP_K))


def recall_hybrid_test(spark, sf_dir):
    run = _run(spark, sf_dir, held_out=True)
    return run.recall(run.hybrid(config.TOP_K)[0])


def recall_rerank_test(spark, sf_dir):
    run = _run(spark, sf_dir, second=True, held_out=True)
    return run.recall(run.two_stage())


def corpus_sizes(spark, sf_dir):
    run = _run(spark, sf_dir)
    coded = run._encode(run.corpus, "corpus_idx", "document", run.model)
    rows = F.count(F.lit(1))
    n_corpus = coded.agg(rows.alias("corpus_size"), F.max(F.size("vector")).cast("bigint").alias("vector_width"))
    n_queries = run.triplets.agg(rows.alias("n"))
    return n_corpus.withColumn("query_size", F.coalesce(n_queries.scalar(), F.lit(0).cast("bigint")))


LETTERS = "aeinrst"


def letter_encoder():
    """A stand-in for a large encoder: letter counts of the text (pairs: of both)."""

    def encode(items):
        whole = ["".join(item) if isinstance(item, list) else item for item in items]
        return [[text.count(letter) for letter in LETTERS] for text in whole]

    return encode


def _pairs(spark, sf_dir):
    rows = corpora.index_corpus(corpora.create_corpus(views.triplets(spark, sf_dir), corpora.FEATURE_COLUMNS))
    pair = text.encoding_pair(F.col("column"), F.col("document"), config.DANISH_INSTRUCTION)
    return rows.select("corpus_idx", pair.alias("pair"))


def encode_batches(spark, sf_dir):
    coded = encode_column(_pairs(spark, sf_dir), "pair", "vector", letter_encoder)
    return long_vectors(coded, "corpus_idx")


def encode_queries(spark, sf_dir):
    rows = views.triplets(spark, sf_dir).select("idx", "query")
    return long_vectors(encode_column(rows, "query", "vector", letter_encoder, 500), "idx")


def features_roundtrip(spark, sf_dir):
    """Encoded in a first and a resumed run, read back as one table."""
    rows = written(_pairs(spark, sf_dir), "pairs")
    path = new_path(spark, "features")
    half = rows.agg(F.max("corpus_idx")).first()[0] // 2
    tables.encode_and_save(rows.filter(F.col("corpus_idx") <= half), path, letter_encoder)
    saved = tables.encode_and_save(rows, path, letter_encoder)
    return saved.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("embedding")[0].cast("bigint")).alias("first_letter")
    )


def model_roundtrip(spark, sf_dir):
    path = new_path(spark, "saved-model")
    model = views.token_vectors(spark, sf_dir).withColumn("weight", F.lit(1.0))
    tables.save_model(model, {"model_type": "static", "normalize": "False"}, path)
    loaded, settings = tables.load_model(spark, path)
    return long_vectors(loaded, "token_id").withColumn("model_type", settings.select("model_type").scalar())


def metrics_long(spark, sf_dir):
    """Recall of two runs, appended as metrics and read back one row per run."""
    path = new_path(spark, "metrics")
    run = _run(spark, sf_dir)
    for name, ranked in (("bm25", run.lexical(config.TOP_K)), ("dense", run.dense(config.TOP_K))):
        tables.append_metrics(run.recall(ranked).withColumn("run", F.lit(name)), path)
    return tables.read_runs(spark, path, [f"recall_at_{t}" for t in config.RECALL_THRESHOLDS])


def run_parameters(spark, sf_dir):
    """Parameters of one run a language, appended and read back; sizes are those of its documents."""
    path = new_path(spark, "parameters")
    docs = views.table(spark, sf_dir, "documents").groupBy("lang")
    for row in docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources")).collect():  # one row a language
        settings = {"top_k": config.TOP_K, "n_documents": row["n"], "n_sources": row["sources"]}
        tables.append_parameters(spark, f"run_{row['lang']}", settings, path)
    return spark.read.parquet(path)


QUERIES = {
    "doc_vectors": doc_vectors,
    "doc_vectors_unit": doc_vectors_unit,
    "bm25_topk": bm25_topk,
    "bm25_postings": bm25_postings,
    "knn_topk": knn_topk,
    "knn_docs": knn_docs,
    "knn_columns": knn_columns,
    "knn_cells": knn_cells,
    "knn_cells_all": knn_cells_all,
    "knn_cells_quality": knn_cells_quality,
    "knn_pivots": knn_pivots,
    "rrf": rrf,
    "hybrid_overlap": hybrid_overlap,
    "hybrid_overlap_mean": hybrid_overlap_mean,
    "rerank": rerank,
    "recall_by_query": recall_by_query,
    "recall_bm25": recall_bm25,
    "recall_embedding": recall_embedding,
    "recall_hybrid": recall_hybrid,
    "recall_rerank": recall_rerank,
    "recall_bm25_test": recall_bm25_test,
    "recall_embedding_test": recall_embedding_test,
    "recall_hybrid_test": recall_hybrid_test,
    "recall_rerank_test": recall_rerank_test,
    "run_parameters": run_parameters,
    "corpus_sizes": corpus_sizes,
    "encode_batches": encode_batches,
    "encode_queries": encode_queries,
    "features_roundtrip": features_roundtrip,
    "model_roundtrip": model_roundtrip,
    "metrics_long": metrics_long,
}


def _recall(ranked: str, top: int = config.TOP_K, where: str = "rank <= 30") -> str:
    """Long recall table of a ranked view."""
    hit = f"""(select q.query_idx, q.corpus_idx as gold, min(r.rank) as rank
        from queries q left join (select * from {ranked} where {where}) r
          on r.query_idx = q.query_idx and r.corpus_idx = q.corpus_idx group by 1, 2)"""
    rows = []
    for t in config.RECALL_THRESHOLDS:
        found = f"cast(coalesce(rank <= {t}, false) as double)"
        rows.append(f"select 'recall_at_{t}' as metric, round(avg({found}), 6) as value from {hit}")
        rows.append(
            f"select 'recall_answerable_at_{t}', round(avg({found}) filter (gold is not null), 6) from {hit}"
        )
    return sql(" union all ".join(rows), top)


def _wide(ranked: str, run: str) -> str:
    values = ", ".join(
        f"avg(cast(coalesce(rank <= {t}, false) as double)) as recall_at_{t}" for t in config.RECALL_THRESHOLDS
    )
    rounded = ", ".join(f"round(recall_at_{t}, 6) as recall_at_{t}" for t in config.RECALL_THRESHOLDS)
    return f"""select '{run}' as run, {rounded} from (select {values} from (
        select q.query_idx, min(r.rank) as rank from queries q left join {ranked} r
          on r.query_idx = q.query_idx and r.corpus_idx = q.corpus_idx group by 1))"""


def _dims(source: str, key: str) -> str:
    return f"""select {key}, cast(unnest(range(64)) as bigint) as dim,
        round(unnest(vector), 6) + 0.0e0 as value from {source}"""


_DOCS = mean_vectors("documents", "doc_id")
_KNN_EMBEDDINGS = """select query_idx, rank, corpus_idx, score from (
    select *, row_number() over (partition by query_idx order by score, corpus_idx) as rank
    from (select a.vec_id as query_idx, b.vec_id as corpus_idx,
                 round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as score
          from embeddings a, embeddings b)) where rank <= 30"""
_OVERLAPS = ", ".join(
    f"count(*) filter (d.rank <= {t} and b.rank <= {t}) / {t}.0e0 as overlap_at_{t}" for t in config.RECALL_THRESHOLDS
)
_OVERLAP = f"""select q.query_idx, {_OVERLAPS} from queries q
    left join (select * from knn_list where rank <= 30) d on d.query_idx = q.query_idx
    left join bm25_list b on b.query_idx = d.query_idx and b.corpus_idx = d.corpus_idx and b.rank <= 30
    group by q.query_idx"""
_ROUNDED = ", ".join(f"round(overlap_at_{t}, 6) as overlap_at_{t}" for t in config.RECALL_THRESHOLDS)
_MEANS = ", ".join(f"round(avg(overlap_at_{t}), 6) as overlap_at_{t}" for t in config.RECALL_THRESHOLDS)


def _letters(text_sql: str) -> str:
    counts = ", ".join(f"cast(length({text_sql}) - length(replace({text_sql}, '{x}', '')) as double)" for x in LETTERS)
    return f"[{counts}]"


_PAIR = f"""(case when "column" = 'query' then '{config.DANISH_INSTRUCTION}' else '' end || document)"""

ORACLES = {
    "doc_vectors": sql(_dims(f"({_DOCS})", "doc_id")),
    "doc_vectors_unit": sql(
        _dims(
            f"""(select doc_id, list_transform(vector,
                lambda x: x / (sqrt(list_inner_product(vector, vector)) + 1e-12::double)) as vector from ({_DOCS}))""",
            "doc_id",
        )
    ),
    "bm25_topk": sql("select query_idx, rank, corpus_idx, score from bm25_list where rank <= 30"),
    "bm25_postings": sql("select query_idx, rank, corpus_idx, score from bm25_list where rank <= 30"),
    "knn_topk": _KNN_EMBEDDINGS,
    "knn_docs": sql("select query_idx, rank, corpus_idx, score from knn_list where rank <= 30"),
    "knn_columns": sql(
        """select c."column", count(*) as n, cast(sum(k.rank) as bigint) as ranks from knn_list k
        join corpus c on c.corpus_idx = k.corpus_idx where k.rank <= 30 group by 1"""
    ),
    "knn_cells_all": _KNN_EMBEDDINGS,
    "knn_cells_quality": f"""select query_idx, count(*) as n, min(score) as nearest,
        cast(0 as bigint) as faults, true as recall_reached from ({_KNN_EMBEDDINGS}) group by 1""",
    "knn_pivots": sql("select query_idx, rank, corpus_idx, score from knn_list where rank <= 30"),
    "rrf": sql("select query_idx, rank, corpus_idx, score from fused where rank <= 30"),
    "hybrid_overlap": sql(f"select query_idx, {_ROUNDED} from ({_OVERLAP})"),
    "hybrid_overlap_mean": sql(f"select {_MEANS} from ({_OVERLAP})"),
    "rerank": sql("select query_idx, rank, corpus_idx, score from reranked where rank <= 30", config.STAGE1_K),
    "recall_by_query": sql(
        "select q.query_idx, q.corpus_idx is not null as answerable, "
        + ", ".join(
            f"cast(coalesce(bool_or(r.rank <= {t}), false) as int) as recall_at_{t}" for t in config.RECALL_THRESHOLDS
        )
        + """ from queries q left join bm25_list r on r.query_idx = q.query_idx and r.corpus_idx = q.corpus_idx
        group by 1, 2"""
    ),
    "recall_bm25": _recall("bm25_list"),
    "recall_embedding": _recall("knn_list"),
    "recall_hybrid": _recall("fused"),
    "recall_rerank": _recall("reranked", config.STAGE1_K),
    "recall_bm25_test": on_test_rows(_recall("bm25_list")),
    "recall_embedding_test": on_test_rows(_recall("knn_list")),
    "recall_hybrid_test": on_test_rows(_recall("fused")),
    "recall_rerank_test": on_test_rows(_recall("reranked", config.STAGE1_K)),
    "run_parameters": f"""select 'run_' || lang as run, unnest(['top_k', 'n_documents', 'n_sources']) as parameter,
        unnest(['{config.TOP_K}', cast(count(*) as varchar), cast(count(distinct source) as varchar)]) as value
        from documents group by lang""",
    "corpus_sizes": sql(
        """select count(*) as corpus_size, cast(64 as bigint) as vector_width,
        (select count(*) from triplets) as query_size from corpus"""
    ),
    "encode_batches": sql(
        f"""select corpus_idx, cast(unnest(range({len(LETTERS)})) as bigint) as dim,
        unnest({_letters(_PAIR)}) as value from features"""
    ),
    "encode_queries": sql(
        f"""select idx, cast(unnest(range({len(LETTERS)})) as bigint) as dim,
        unnest({_letters('query')}) as value from triplets"""
    ),
    "features_roundtrip": sql(
        f"""select corpus_idx // 5000 as chunk, count(*) as n,
        cast(sum(length({_PAIR}) - length(replace({_PAIR}, 'a', ''))) as bigint) as first_letter
        from features group by 1"""
    ),
    "model_roundtrip": sql(
        """select token_id, cast(unnest(range(64)) as bigint) as dim,
        round(unnest(cast(vector as double[])), 6) + 0.0e0 as value, 'static' as model_type from token_vectors"""
    ),
    "metrics_long": sql(_wide("bm25_list", "bm25") + " union all " + _wide("knn_list", "dense")),
}
