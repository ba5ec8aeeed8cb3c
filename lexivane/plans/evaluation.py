"""Registered queries on pair predictions, metrics, sweeps and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import vectors
from lexivane.operators import bm25, evaluation, pca, splits, sweep, vocab
from lexivane.plans import views
from lexivane.plans.oracle import each_once, mean_vectors, on_components, projected, sql, words
from lexivane.plans.vocabulary import SIFS
from lexivane.session import written
from lexivane.sources.triplets import complete_pairs


def _vectors(spark, sf_dir, instruct=False):
    triplets = views.triplets(spark, sf_dir)
    rows = evaluation.instruct_queries(triplets) if instruct else triplets
    return evaluation.pair_vectors(rows, views.token_vectors(spark, sf_dir))


def pair_distance(spark, sf_dir):
    return evaluation.predict_by_distance(_vectors(spark, sf_dir))


def pair_cosine(spark, sf_dir):
    return evaluation.predict_by_cosine(_vectors(spark, sf_dir))


def pair_instruct(spark, sf_dir):
    return evaluation.predict_by_distance(_vectors(spark, sf_dir, instruct=True))


def pair_instruct_model(spark, sf_dir):
    triplets = views.triplets(spark, sf_dir)
    first, second = (views.token_vectors(spark, sf_dir, second=s) for s in (False, True))
    return evaluation.predict_by_distance(evaluation.pair_vectors(triplets, first, second))


def model_predictions(spark, sf_dir):
    triplets = views.triplets(spark, sf_dir)
    first, second = (views.token_vectors(spark, sf_dir, second=s) for s in (False, True))
    return evaluation.evaluate_model(triplets, first, second)


def bm25_pair(spark, sf_dir):
    return bm25.predict_pairs(views.triplets(spark, sf_dir))


def bm25_pair_turns(spark, sf_dir):
    return bm25.predict_pairs(views.turn_pairs(spark, sf_dir))


def bm25_pair_global(spark, sf_dir):
    triplets = views.triplets(spark, sf_dir)
    docs = bm25.tokenised(written(views.corpus(triplets), "corpus"), "corpus_idx", "document", "corpus_idx")
    return bm25.predict_pairs_global(triplets, docs)


def predictions(spark, sf_dir):
    """(model, idx, prediction) of four models on the complete pairs."""
    triplets = views.triplets(spark, sf_dir)
    first, second = (views.token_vectors(spark, sf_dir, second=s) for s in (False, True))
    plain = written(evaluation.pair_vectors(triplets, first), "pairs")
    parts = {
        "raw": evaluation.predict_by_distance(plain),
        "cosine": evaluation.predict_by_cosine(plain),
        "instruct": evaluation.predict_by_distance(evaluation.pair_vectors(triplets, first, second)),
        "bm25": bm25.predict_pairs(triplets).filter(F.col("prediction") >= 0),
    }
    rows = [df.select(F.lit(name).alias("model"), "idx", "prediction") for name, df in parts.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def classification_metrics(spark, sf_dir):
    return evaluation.classification_metrics(predictions(spark, sf_dir), ["model"])


def confusion(spark, sf_dir):
    return evaluation.confusion_matrix(predictions(spark, sf_dir), ["model"])


def class_report(spark, sf_dir):
    return evaluation.class_report(predictions(spark, sf_dir), ["model"])


def _labelled(spark, sf_dir):
    """Okapi on conversation turns against a truth column: is the answer longer?"""
    turns = views.turn_pairs(spark, sf_dir)
    truth = (F.length("positive") > F.length("negative")).cast("int").alias("truth")
    predicted = bm25.predict_pairs(turns).filter(F.col("prediction") >= 0)
    return predicted.join(turns.select("idx", truth), "idx")


def truth_metrics(spark, sf_dir):
    return evaluation.classification_metrics(_labelled(spark, sf_dir), truth="truth")


def truth_confusion(spark, sf_dir):
    return evaluation.confusion_matrix(_labelled(spark, sf_dir), truth="truth")


def truth_report(spark, sf_dir):
    return evaluation.class_report(_labelled(spark, sf_dir), truth="truth")


def ensemble(spark, sf_dir):
    votes = predictions(spark, sf_dir).filter(F.col("model").isin("raw", "instruct", "bm25"))
    return evaluation.ensemble(votes)


def ensemble_metrics(spark, sf_dir):
    return evaluation.classification_metrics(ensemble(spark, sf_dir))


def fold_metrics(spark, sf_dir):
    """Ten folds in one aggregation: every row is tested in its own fold."""
    triplets = views.triplets(spark, sf_dir)
    folded = splits.stratified_k_fold(triplets).select("idx", "fold")
    pairs = evaluation.pair_vectors(triplets, views.token_vectors(spark, sf_dir))
    predicted = evaluation.predict_by_distance(pairs).join(folded, "idx")
    return evaluation.classification_metrics(predicted, ["fold"])


SWEEP_DIMS = (16, 32, 64)
SWEEP_SIZES = (1000, config.VOCAB_SIZE)


def _swept(spark, sf_dir, dims, sizes, normalize):
    pairs = complete_pairs(views.triplets(spark, sf_dir)).select("idx", "query", "positive", "negative")
    model = views.token_vectors(spark, sf_dir)
    vocabulary = model.select("token_id", "token")
    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    counts = written(vocab.token_frequencies(vocabulary, texts), "frequencies")
    weights = vocab.sif_weights(vocabulary, counts, SIFS)
    return sweep.sweep(pairs, model, weights, dims, sizes, normalize)


def sweep_accuracy(spark, sf_dir):
    """Accuracy for every SIF coefficient, weighted and scored in one pass."""
    return evaluation.classification_metrics(_swept(spark, sf_dir, [64], [config.VOCAB_SIZE], [False]), ["sif"])


def sweep_grid(spark, sf_dir):
    """Accuracy for every width, SIF coefficient, vocabulary size and normalisation, in one pass."""
    settings = ["output_dim", "sif", "vocab_size", "normalize"]
    return evaluation.classification_metrics(_swept(spark, sf_dir, SWEEP_DIMS, SWEEP_SIZES, [False, True]), settings)


def _embeddings(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("token_id"), vectors.doubles(F.col("embedding")).alias("vector"))


def _energy(df):
    """Rows and total variance of a vector column; a rotation keeps both."""
    long = df.select(F.posexplode("vector").alias("dim", "value"))
    spread = long.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.var_samp("value").alias("v"))
    return spread.agg(F.max("n").alias("n_rows"), F.round(F.sum("v"), 6).alias("total_variance"))


def pca_all(spark, sf_dir):
    return _energy(pca.reduce_dimensions(_embeddings(spark, sf_dir), "vector", "auto"))


def pca_spectrum(spark, sf_dir):
    """Power sums of the components' variances, which fix all of them, and the greatest covariance of two components."""
    turned = written(pca.reduce_dimensions(_embeddings(spark, sf_dir), "vector", "auto"), "turned")
    axes = turned.select("token_id", F.posexplode("vector").alias("i", "x"))
    spread = axes.groupBy("i").agg(F.var_samp("x").alias("v"))
    value = F.col("vector")
    pairs = [F.covar_samp(value[i], value[i + 1]).alias(f"c{i}") for i in range(63)]
    most = turned.agg(*pairs).select(F.round(F.array_max(F.array(*[F.abs(f"c{i}") for i in range(63)])), 6).alias("coupled"))
    sums = [F.round(F.sum(F.pow("v", F.lit(float(k)))), 8).alias(f"power_{k}") for k in (1, 2, 3)]
    return spread.agg(*sums).crossJoin(most)  # one row each


def pca_focus(spark, sf_dir):
    """Fitted on the tokens seen in conversations, applied to all."""
    vocabulary = written(views.vocabulary(spark, sf_dir), "vocabulary")
    texts = views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ord"), "text")
    counts = vocab.token_frequencies(vocabulary, texts)
    reduced = pca.reduce_dimensions(_embeddings(spark, sf_dir), "vector", 16, counts)
    return _rounded(reduced)


def pca_unit(spark, sf_dir):
    """Unit vectors before and after the projection, full width."""
    rows = _embeddings(spark, sf_dir).withColumn("vector", vectors.unit(F.col("vector")))
    reduced = pca.reduce_dimensions(rows, "vector", "auto")
    scaled = reduced.select("token_id", vectors.unit(F.col("vector")).alias("vector"))
    return scaled.select("token_id", F.round(vectors.l2_norm(F.col("vector")), 6).alias("l2_norm"))


def pca_2d(spark, sf_dir):
    return _rounded(pca.reduce_dimensions(_embeddings(spark, sf_dir), "vector", 2))


def pca_column(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings")
    reduced = pca.reduce_column(rows, 50).select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vector"))
    return _rounded(reduced)


def pca_distances(spark, sf_dir):
    """Distance of every vector to the next one; a full rotation keeps it."""
    rows = pca.reduce_dimensions(_embeddings(spark, sf_dir), "vector", "auto")
    after = rows.select((F.col("token_id") - 1).alias("token_id"), F.col("vector").alias("next"))
    near = F.round(vectors.euclidean(F.col("vector"), F.col("next")), 6)
    return rows.join(after, "token_id").select("token_id", near.alias("distance"))


def pca_variance(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    report = pca.Projection(rows, "vector", 64).variance_report(rows)
    return report.agg(F.count(F.lit(1)).alias("components"), F.round(F.sum("ratio"), 6).alias("ratio"))


def pca_explained(spark, sf_dir):
    """Share of the variance of each of the 16 leading components."""
    rows = _embeddings(spark, sf_dir)
    return pca.Projection(rows, "vector", 16).variance_report(rows).select("component", F.round("ratio", 9).alias("ratio"))


def _rounded(df):
    return df.select("token_id", F.posexplode("vector").alias("dim", "value")).select(
        "token_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value")
    )


QUERIES = {
    "pair_distance": pair_distance,
    "pair_cosine": pair_cosine,
    "pair_instruct": pair_instruct,
    "pair_instruct_model": pair_instruct_model,
    "model_predictions": model_predictions,
    "bm25_pair": bm25_pair,
    "bm25_pair_turns": bm25_pair_turns,
    "bm25_pair_global": bm25_pair_global,
    "predictions": predictions,
    "classification_metrics": classification_metrics,
    "confusion": confusion,
    "class_report": class_report,
    "truth_metrics": truth_metrics,
    "truth_confusion": truth_confusion,
    "truth_report": truth_report,
    "ensemble": ensemble,
    "ensemble_metrics": ensemble_metrics,
    "fold_metrics": fold_metrics,
    "sweep_accuracy": sweep_accuracy,
    "sweep_grid": sweep_grid,
    "pca_all": pca_all,
    "pca_spectrum": pca_spectrum,
    "pca_focus": pca_focus,
    "pca_unit": pca_unit,
    "pca_2d": pca_2d,
    "pca_column": pca_column,
    "pca_distances": pca_distances,
    "pca_variance": pca_variance,
    "pca_explained": pca_explained,
}


def _metrics(source: str, by: str = "") -> str:
    """Metrics where the truth is all ones."""
    head, tail = (f"{by}, ", f" group by {by}") if by else ("", "")
    share = "count(*) filter (prediction = 1) / nullif(count(*), 0)::double"
    return f"""select {head}round(accuracy, 6) as accuracy, round(has, 6) as precision, round(accuracy, 6) as recall,
        round(coalesce(2 * accuracy * has / nullif(accuracy + has, 0), 0), 6) as f1_score
        from (select {head}coalesce({share}, 0) as accuracy,
                     case when count(*) filter (prediction = 1) > 0 then 1.0e0 else 0.0e0 end as has
              from {source}{tail})"""


_TRUTH = f"""(select o.idx, o.prediction, cast(length(t.positive) > length(t.negative) as int) as truth
    from okapi_turns o join turn_pairs t on t.idx = o.idx where o.prediction >= 0)"""
_FOUR = f"""(select count(*) filter (truth = 0 and prediction = 0) as n00,
    count(*) filter (truth = 0 and prediction = 1) as n01, count(*) filter (truth = 1 and prediction = 0) as n10,
    count(*) filter (truth = 1 and prediction = 1) as n11 from {_TRUTH})"""


def _div(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(({b})::double, 0), 0)"


def _report(four: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f"partition by {by}" if by else ""
    inner = f"""(select {head}'0' as label, {_div('n00', 'n00 + n10')} as precision, {_div('n00', 'n00 + n01')} as recall,
              {_div('2 * n00', '2 * n00 + n10 + n01')} as f1_score, n00 + n01 as support, n00 + n11 as right,
              n00 + n01 + n10 + n11 as total from {four} where n00 + n01 + n10 > 0
            union all select {head}'1', {_div('n11', 'n01 + n11')}, {_div('n11', 'n10 + n11')},
              {_div('2 * n11', '2 * n11 + n10 + n01')}, n10 + n11, n00 + n11, n00 + n01 + n10 + n11
              from {four} where n11 + n10 + n01 > 0)"""
    group = f" group by {by}" if by else ""
    accuracy = "any_value(\"right\") / any_value(total)::double"
    inner = inner.replace("as right,", 'as "right",')
    weighted = [f"sum({m} * support) / sum(support)" for m in ("precision", "recall", "f1_score")]
    everything = f"""select {head}label, precision, recall, f1_score, support from {inner}
        union all select {head}'accuracy', {accuracy}, {accuracy}, {accuracy}, any_value(total) from {inner}{group}
        union all select {head}'macro avg', avg(precision), avg(recall), avg(f1_score), any_value(total) from {inner}{group}
        union all select {head}'weighted avg', {', '.join(weighted)}, any_value(total) from {inner}{group}"""
    return f"""select {head}label, round(precision, 6) as precision, round(recall, 6) as recall,
        round(f1_score, 6) as f1_score, cast(support as bigint) as support from ({everything})"""


_ONES = "(select model, 0 as n00, 0 as n01, n10, n11 from counts4)"
_SHARE = "coalesce(c.n, (select min(n) from token_counts)) / cast((select sum(n) from token_counts) as double)"
_SWEEP_MODELS = {
    f"swept_{i}": f"""select t.token, list_transform(cast(t.vector as double[]),
        lambda x: x * weight) as vector
        from (select t.token, t.vector, {s}::double / ({s}::double + {_SHARE}) as weight
              from token_vectors t left join token_counts c on c.token_id = t.token_id) t"""
    for i, s in enumerate(SIFS)
}


def _sweep() -> str:
    heads, runs = [], []
    for i, s in enumerate(SIFS):
        means = mean_vectors("pair_keys", "k", f"swept_{i}")
        heads.append(f"swept_{i} as ({_SWEEP_MODELS[f'swept_{i}']}), means_{i} as ({means})")
        runs.append(
            f"""select {s}::double as sif, idx, cast(round(list_distance(q, p), 6) < round(list_distance(q, n), 6) as int)
            as prediction from (select x.idx, any_value(m.vector) filter (x.side = 'q') as q,
              any_value(m.vector) filter (x.side = 'p') as p, any_value(m.vector) filter (x.side = 'n') as n
              from pair_keys x join means_{i} m on m.k = x.k group by x.idx)"""
        )
    body = _metrics(f"({' union all '.join(runs)})", "sif")
    whole = sql(body + " /* pair_keys token_vectors token_counts */")
    cut = whole.rindex("\nselect sif,")
    return whole[:cut] + ",\n" + ",\n".join(heads) + whole[cut:]


def _grid() -> str:
    dims, sizes, sifs = (", ".join(map(str, x)) for x in (SWEEP_DIMS, SWEEP_SIZES, [f"{s}::double" for s in SIFS]))
    unit = "list_transform({0}, lambda x: x / (sqrt(list_inner_product({0}, {0})) + 1e-12::double))"
    rows = f"""(with counted as (
        select k, token, count(*) as times from (select k, unnest({words('text')}) as token from pair_keys) group by all
      ), weighted as (
        select t.token, t.token_id, s.sif, s.sif / (s.sif + {_SHARE}) as weight, cast(t.vector as double[]) as vector
        from token_vectors t cross join (select unnest([{sifs}]) as sif) s left join token_counts c on c.token_id = t.token_id
      ), summed as (
        select c.k, w.sif, z.vocab_size, unnest(range(64)) as dim, c.times, c.times * w.weight * unnest(w.vector) as value
        from counted c join weighted w on w.token = c.token
          join (select unnest([{sizes}]) as vocab_size) z on w.token_id < z.vocab_size
      ), means as (
        select k, sif, vocab_size, list(value order by dim) as vector from (
          select k, sif, vocab_size, dim, sum(value) / sum(times) as value from summed group by all) group by all
      ), every as (
        select x.idx, x.side, s.sif, z.vocab_size, coalesce(m.vector, list_transform(range(64), lambda i: 0.0::double)) as v
        from pair_keys x cross join (select unnest([{sifs}]) as sif) s cross join (select unnest([{sizes}]) as vocab_size) z
          left join means m on m.k = x.k and m.sif = s.sif and m.vocab_size = z.vocab_size
      ), sides as (
        select idx, sif, vocab_size, any_value(v) filter (side = 'q') as q, any_value(v) filter (side = 'p') as p,
          any_value(v) filter (side = 'n') as n from every group by all
      ), cut as (
        select idx, sif, vocab_size, output_dim, q[1:output_dim] as q, p[1:output_dim] as p, n[1:output_dim] as n
        from sides cross join (select unnest([{dims}]) as output_dim)
      ), either as (
        select idx, sif, vocab_size, output_dim, false as normalize, q, p, n from cut
        union all select idx, sif, vocab_size, output_dim, true, {unit.format("q")}, {unit.format("p")}, {unit.format("n")} from cut)
      select *, cast(round(list_distance(q, p), 6) < round(list_distance(q, n), 6) as int) as prediction from either)"""
    return sql(_metrics(rows, "output_dim, sif, vocab_size, normalize"))


_CONFUSION_ROWS = """select model, 0 as actual, 0 as predicted, cast(0 as bigint) as n from counts4
    union all select model, 0, 1, 0 from counts4 union all select model, 1, 0, n10 from counts4
    union all select model, 1, 1, n11 from counts4"""

_BY_ID = "select vec_id as token_id, embedding as v from embeddings"
_SEEN = f"""select coalesce(f.token_id, (select max(token_id) from full_vocab))
    from (select unnest({words('text')}) as token from conversations) w left join full_vocab f on f.token = w.token"""

ORACLES = {
    "pair_distance": sql("select idx, pos_dist, neg_dist, prediction from pair_distance"),
    "pair_cosine": sql("select idx, pos_sim + 0.0e0 as pos_sim, neg_sim + 0.0e0 as neg_sim, prediction from pair_cosine"),
    "pair_instruct": sql("select idx, pos_dist, neg_dist, prediction from pair_instruct"),
    "pair_instruct_model": sql("select idx, pos_dist, neg_dist, prediction from pair_instruct_model"),
    "model_predictions": sql(
        """select a.idx, a.prediction, b.prediction as prediction_with_instruction
        from pair_distance a join pair_instruct_model b on b.idx = a.idx"""
    ),
    "bm25_pair": sql("select idx, pos_score, neg_score, prediction from okapi"),
    "bm25_pair_turns": sql("select idx, pos_score, neg_score, prediction from okapi_turns"),
    "bm25_pair_global": sql(
        r"""select t.idx, case when c.idx is not null then round(coalesce(s.pos, 0), 6) end as pos_score,
            case when c.idx is not null then round(coalesce(s.neg, 0), 6) end as neg_score,
            case when c.idx is null then -1
              else cast(round(coalesce(s.pos, 0), 6) > round(coalesce(s.neg, 0), 6) as int) end as prediction
        from triplets t left join complete_pairs c on c.idx = t.idx left join (
          select q.idx, sum(q.repeats * i.idf * p.tf / (p.tf + 1.5e0 * (0.25e0 + 0.75e0 * p.dl / (select avgdl from bm25_size))))
                   filter (p.side = 'p') as pos,
                 sum(q.repeats * i.idf * p.tf / (p.tf + 1.5e0 * (0.25e0 + 0.75e0 * p.dl / (select avgdl from bm25_size))))
                   filter (p.side = 'n') as neg
          from (select idx, token, count(*) as repeats from (
                  select idx, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) as token
                  from pair_texts where side = 'q') group by 1, 2) q
          join bm25_idf i on i.token = q.token
          join (select idx, side, token, count(*) as tf, any_value(dl) as dl from (
                  select idx, side, len(w) as dl, unnest(w) as token from (
                    select idx, side, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') as w
                    from pair_texts where side <> 'q')) group by 1, 2, 3) p
            on p.idx = q.idx and p.token = q.token
          group by q.idx) s on s.idx = t.idx"""
    ),
    "predictions": sql("select model, idx, prediction from predictions"),
    "classification_metrics": sql(_metrics("predictions", "model")),
    "confusion": sql(_CONFUSION_ROWS),
    "class_report": sql(_report(_ONES, "model")),
    "truth_metrics": sql(
        f"""select round({_div('n00 + n11', 'n00 + n01 + n10 + n11')}, 6) as accuracy,
        round({_div('n11', 'n01 + n11')}, 6) as precision, round({_div('n11', 'n10 + n11')}, 6) as recall,
        round({_div('2 * n11', '2 * n11 + n10 + n01')}, 6) as f1_score from {_FOUR}"""
    ),
    "truth_confusion": sql(
        f"""select 0 as actual, 0 as predicted, n00 as n from {_FOUR} union all select 0, 1, n01 from {_FOUR}
        union all select 1, 0, n10 from {_FOUR} union all select 1, 1, n11 from {_FOUR}"""
    ),
    "truth_report": sql(_report(_FOUR)),
    "ensemble": sql(
        """select idx, cast(sum(prediction) >= 2 as int) as prediction from predictions
        where model <> 'cosine' group by idx"""
    ),
    "ensemble_metrics": sql(
        _metrics(
            """(select idx, cast(sum(prediction) >= 2 as int) as prediction from predictions
            where model <> 'cosine' group by idx)"""
        )
    ),
    "fold_metrics": sql(_metrics("(select f.fold, p.prediction from pair_distance p join folds f on f.idx = p.idx)", "fold")),
    "sweep_accuracy": _sweep(),
    "sweep_grid": _grid(),
    "pca_spectrum": """with v as (
        select vec_id, unnest(range(64)) as i, unnest(cast(embedding as double[])) as x from embeddings
      ), c as (
        select a.i, b.i as j, covar_samp(a.x, b.x) as c from v a join v b on b.vec_id = a.vec_id group by all
      )
      select round((select sum(c) from c where i = j), 8) as power_1, round((select sum(c * c) from c), 8) as power_2,
        round((select sum(a.c * b.c * d.c) from c a join c b on b.i = a.j join c d on d.i = b.j and d.j = a.i), 8) as power_3,
        0.0e0 as coupled""",
    "pca_all": """select max(n) as n_rows, round(sum(v), 6) as total_variance from (
        select dim, count(*) as n, var_samp(value) as v from (
          select unnest(range(64)) as dim, unnest(cast(embedding as double[])) as value from embeddings)
        group by dim)""",
    "pca_focus": sql(on_components(each_once(f"select embedding as v from embeddings where vec_id in ({_SEEN})"), 16, projected(_BY_ID))),
    "pca_2d": sql(on_components(each_once(_BY_ID), 2, projected(_BY_ID))),
    "pca_column": sql(on_components(each_once(_BY_ID), 50, projected(_BY_ID))),
    "pca_explained": sql(
        on_components(each_once(_BY_ID), 16, """select cast(dim as bigint) as component, round(value / (
          select sum(c[i]) from (select unnest(c) as c, unnest(range(1, 65)) as i from covariance)), 9) as ratio from axes""")
    ),
    "pca_unit": "select vec_id as token_id, 1.0e0 as l2_norm from embeddings",
    "pca_distances": """select a.vec_id as token_id,
        round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as distance
        from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "pca_variance": "select cast(64 as bigint) as components, 1.0e0 as ratio",
}
