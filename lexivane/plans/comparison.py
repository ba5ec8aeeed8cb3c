"""Registered queries that compare models, vocabularies and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivane.functions import text, vectors
from lexivane.operators import compare, pca
from lexivane.operators.encode import encode_columns
from lexivane.plans import views
from lexivane.plans.oracle import each_once, on_components, projected, sql, words
from lexivane.session import new_path
from lexivane.sources import tables


def _other(spark, sf_dir):
    """The French vocabulary with vectors by rank, counted round: the second model's tokens."""
    embeddings = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    tokens = views.vocabulary(spark, sf_dir, "fr").withColumn("vec_id", F.col("token_id") % embeddings.agg(F.count(F.lit(1))).scalar())
    return tokens.join(embeddings, "vec_id").drop("vec_id")


def _rounded(df, columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


_PLACES = [f"{p}projection_{axis}" for p in ("", "other_", "diff_") for axis in "xy"]


def model_compare(spark, sf_dir):
    first = compare.token_map(views.token_vectors(spark, sf_dir))
    return _rounded(compare.compare_models(first, compare.token_map(_other(spark, sf_dir))), _PLACES)


def token_map_saved(spark, sf_dir):
    """The four-column token map, written and read back."""
    path = new_path(spark, "token-map")
    tables.save_token_map(compare.token_map(views.token_vectors(spark, sf_dir)), path)
    return _rounded(spark.read.parquet(path), _PLACES)


def _compared_map(columns):
    def query(spark, sf_dir):
        path = new_path(spark, "token-map")
        first = compare.token_map(views.token_vectors(spark, sf_dir))
        tables.save_token_map(compare.compare_models(first, compare.token_map(_other(spark, sf_dir))), path, columns)
        return _rounded(spark.read.parquet(path), _PLACES)

    return query


def token_map_2d(spark, sf_dir):
    model = views.token_vectors(spark, sf_dir)
    return _rounded(compare.token_map(pca.reduce_dimensions(model, "vector", 2)), _PLACES)


def vocab_diff(spark, sf_dir):
    return compare.vocabulary_difference(views.vocabulary(spark, sf_dir), views.vocabulary(spark, sf_dir, "fr"))


_TURN = ["conv_id", "turn"]


def _turns(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select(*_TURN, "text"), views.token_vectors(spark, sf_dir)


def _arrows(arrows):
    numbers = [c for c in arrows.columns if c.endswith(("_x", "_y"))]
    arrows = arrows.withColumn("position", F.col("position").cast("bigint"))
    return _rounded(arrows, [*numbers, "line_width"])


def token_arrows(spark, sf_dir):
    """Arrows over all conversation turns, in the first two dims."""
    turns, model = _turns(spark, sf_dir)
    return _arrows(compare.chain_arrows(compare.text_points(turns, _TURN, "text", model), _TURN))


def _plane(spark, sf_dir):
    turns, model = _turns(spark, sf_dir)
    weights = compare.point_weights(compare.text_points(turns, _TURN, "text", model), _TURN)
    return turns, model, compare.weighted_plane(model, weights)


def token_arrows_pca(spark, sf_dir):
    """Arrows in the plane of the two largest components of the contributions."""
    turns, model, plane = _plane(spark, sf_dir)
    vector = vectors.doubles(F.col("vector"))
    axes = [vectors.dot(vector, F.array(*[F.lit(float(x)) for x in axis])) for axis in plane.axes.T]
    return _arrows(compare.chain_arrows(compare.text_points(turns, _TURN, "text", model, axes), _TURN, plane.offset))


def mean_points_pca(spark, sf_dir):
    """The mean vector of every turn in that plane."""
    turns, model, plane = _plane(spark, sf_dir)
    means = plane.apply(encode_columns(turns, {"vector": ("text", model)}).drop("text"), "vector")
    return _rounded(means.select(*_TURN, F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y")), ["x", "y"])


def legend_labels(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.legend_label(F.col("text")).alias("label"))


def token_inputs(spark, sf_dir):
    """Encoder input per token, with the internal tokens that resolve to unknown."""
    external = views.vocabulary(spark, sf_dir).select("token")
    internal = views.internal_tokens(spark, sf_dir).withColumn("_i", F.lit(True))
    joined = external.join(internal, "token", "left")
    known = views.vocabulary(spark, sf_dir, "fr").select("token", F.col("token").alias("_resolved"))
    resolved = F.coalesce(F.col("_resolved"), F.lit("[UNK]"))
    pair = text.token_input(F.col("token"), "Token:")
    is_internal = F.coalesce(F.col("_i"), F.lit(False))
    return joined.join(known, "token", "left").select(
        "token",
        pair["instruction"].alias("instruction"),
        pair["text"].alias("text"),
        text.resolved_to_unknown(is_internal, F.col("token"), resolved).alias("resolved_to_unk"),
    )


def _runs(spark, sf_dir):
    """A table of runs measured on the documents: one run per source and language.

    The language sets the parameters, the source number the order; sources
    from 10 on are child runs. Accuracy is the share of good labels.
    """
    docs = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id", "left")
    lang = F.col("lang")
    measured = docs.groupBy("lang", "source").agg(
        F.round(F.coalesce(F.avg(F.col("quality").cast("double")), F.lit(0.0)), 6).alias("accuracy"),
        F.max("toxic").alias("_toxic"),
    )
    number = F.substring("source", 4, 10).cast("int")
    dims = F.when(lang == "en", "256").when(lang == "fr", "512").when(lang == "de", "None").otherwise("auto")
    table = measured.select(
        F.when(number >= 10, F.concat(F.lit("parent_"), lang)).alias("parent_run"),
        number.alias("start_ord"),
        dims.alias("output_dim"),
        F.when(lang == "fr", F.lit(0.005)).otherwise(F.lit(0.001)).alias("sif_coefficient"),
        F.when(number % 2 == 0, 150000).otherwise(200000).alias("vocab_size"),
        F.when(F.col("_toxic") == 1, F.lit(True)).alias("normalize_embeddings"),
        "accuracy",
    )
    return compare.named_runs(table)


def runs_compare(spark, sf_dir):
    parents = compare.parent_runs(_runs(spark, sf_dir))
    firsts = compare.first_runs(parents, ["run_name"], flag="normalize_embeddings")
    numeric = firsts.withColumn("output_dim_numeric", compare.numeric_parameter(F.col("output_dim")))
    return compare.sort_runs(numeric, "output_dim_numeric").select(
        "run_name", "output_dim", "output_dim_numeric", "accuracy", "normalize_embeddings", "start_ord", "n_runs"
    )


def runs_selected(spark, sf_dir):
    chosen = compare.select_runs(compare.parent_runs(_runs(spark, sf_dir)), ["dimNone"], containing="sif", also="dim256")
    return compare.first_runs(chosen, ["output_dim", "accuracy"]).select("output_dim", "accuracy", "run_name", "n_runs")


QUERIES = {
    "model_compare": model_compare,
    "token_map_saved": token_map_saved,
    "token_map_compared": _compared_map(tables.COMPARED_MAP),
    "token_map_differences": _compared_map(tables.DIFFERENCE_MAP),
    "token_map_2d": token_map_2d,
    "vocab_diff": vocab_diff,
    "token_arrows": token_arrows,
    "token_arrows_pca": token_arrows_pca,
    "mean_points_pca": mean_points_pca,
    "legend_labels": legend_labels,
    "token_inputs": token_inputs,
    "runs_compare": runs_compare,
    "runs_selected": runs_selected,
}

_OTHER = "(select v.token, e.embedding as vector from vocab_fr v join embeddings e on e.vec_id = v.token_id % (select count(*) from embeddings))"
_RUNS = """(select *, 'dim' || output_dim || case when vocab_size <> 150000 then '_vocab' || vocab_size else '' end
        || case when sif_coefficient <> 0.001 then '_sif0.005' else '' end
        || case when normalize_embeddings then '_normalize_embeddings' else '' end as run_name
    from (select case when cast(substr(source, 4) as int) >= 10 then 'parent_' || lang end as parent_run,
             cast(substr(source, 4) as int) as start_ord,
             case lang when 'en' then '256' when 'fr' then '512' when 'de' then 'None' else 'auto' end as output_dim,
             case when lang = 'fr' then 0.005 else 0.001 end as sif_coefficient,
             case when cast(substr(source, 4) as int) % 2 = 0 then 150000 else 200000 end as vocab_size,
             case when max(l.toxic) = 1 then true end as normalize_embeddings,
             round(coalesce(avg(l.quality), 0), 6) as accuracy
          from documents d left join labels l on l.doc_id = d.doc_id group by lang, source))"""

_COMPARED = f"""select a.token_id as index, coalesce(a.token, b.token) as text,
            round(ax, 6) + 0.0e0 as projection_x, round(ay, 6) + 0.0e0 as projection_y,
            round(bx, 6) + 0.0e0 as other_projection_x, round(b_y, 6) + 0.0e0 as other_projection_y,
            cast(b.token is null as int) as is_redundant, cast(a.token is null as int) as only_in_other,
            round(bx - ax, 6) + 0.0e0 as diff_projection_x, round(b_y - ay, 6) + 0.0e0 as diff_projection_y
        from (select token_id, token, vector[1]::double as ax, vector[2]::double as ay from token_vectors) a
        full join (select token, vector[1]::double as bx, vector[2]::double as b_y from {_OTHER}) b on b.token = a.token"""

_MAP_TOKENS = "select token_id, token, vector as v from token_vectors"
# The known tokens of every turn, with the number of those of their turn.
_TURN_TOKENS = f"""select t.*, v.vector as v, count(*) over (partition by t.conv_id, t.turn) as held
    from (select conv_id, turn, unnest(w) as token, cast(generate_subscripts(w, 1) - 1 as bigint) as position
          from (select conv_id, turn, {words('text')} as w from conversations)) t
    join token_vectors v on v.token = t.token"""
_WEIGHTED = f"select any_value(v) as v, count(*) as n, sum(1.0e0 / held) as s, sum(1.0e0 / held / held) as q from ({_TURN_TOKENS}) group by token"
_PLANE_ARROWS = f"""select conv_id, turn, position, token, round(end_x - dx, 6) + 0.0e0 as start_x, round(end_y - dy, 6) + 0.0e0 as start_y,
      round(end_x, 6) + 0.0e0 as end_x, round(end_y, 6) + 0.0e0 as end_y, round(end_x - dx / 2, 6) + 0.0e0 as mid_x,
      round(end_y - dy / 2, 6) + 0.0e0 as mid_y, round(greatest(1, least(20, l2_norm)), 6) as line_width
    from (select *, sum(dx) over w as end_x, sum(dy) over w as end_y
          from (select t.conv_id, t.turn, t.position, t.token, sqrt(list_inner_product(t.u, t.u)) as l2_norm,
                       list_inner_product(t.u, x.axis) / held - x.offset_ as dx, list_inner_product(t.u, y.axis) / held - y.offset_ as dy
                from (select *, cast(v as double[]) as u from ({_TURN_TOKENS})) t
                join axes x on x.dim = 0 join axes y on y.dim = 1)
          window w as (partition by conv_id, turn order by position rows between unbounded preceding and current row))"""
_TURN_MEANS = f"""select c.conv_id, c.turn, coalesce(m.v, list_transform(range(64), lambda i: 0.0::double)) as v
    from conversations c left join (
      select conv_id, turn, list(x order by i) as v
      from (select conv_id, turn, i, avg(x) as x
            from (select conv_id, turn, unnest(range(64)) as i, unnest(cast(v as double[])) as x from ({_TURN_TOKENS})) group by all)
      group by conv_id, turn) m on m.conv_id = c.conv_id and m.turn = c.turn"""

ORACLES = {
    "token_map_2d": sql(
        on_components(each_once(_MAP_TOKENS), 2, f"""select token_id as index, token as text, max(value) filter (dim = 0) as projection_x,
          max(value) filter (dim = 1) as projection_y from ({projected(_MAP_TOKENS)}) group by all""")
    ),
    "token_arrows_pca": sql(on_components(_WEIGHTED, 2, _PLANE_ARROWS)),
    "mean_points_pca": sql(
        on_components(_WEIGHTED, 2, f"""select conv_id, turn, max(value) filter (dim = 0) as x, max(value) filter (dim = 1) as y
          from ({projected(_TURN_MEANS)}) group by all""")
    ),
    "model_compare": sql(_COMPARED),
    "token_map_compared": sql(f"select {', '.join(tables.COMPARED_MAP)} from ({_COMPARED})"),
    "token_map_differences": sql(f"select {', '.join(tables.DIFFERENCE_MAP)} from ({_COMPARED})"),
    "token_map_saved": sql(
        """select token_id as index, token as text, round(vector[1]::double, 6) + 0.0e0 as projection_x,
        round(vector[2]::double, 6) + 0.0e0 as projection_y from token_vectors"""
    ),
    "vocab_diff": sql(
        """select side, count(*) as n, string_agg(token, ' ' order by token) filter (r <= 10) as tokens
        from (select *, row_number() over (partition by side order by token) as r from (
            select coalesce(a.token, b.token) as token, case when b.token is null then 'only_in_first'
              when a.token is null then 'only_in_other' else 'in_both' end as side
            from vocab_en a full join vocab_fr b on a.token = b.token)) group by side"""
    ),
    "token_arrows": sql(
        f"""select conv_id, turn, position, token, round(end_x - dx, 6) + 0.0e0 as start_x,
            round(end_y - dy, 6) + 0.0e0 as start_y, round(end_x, 6) + 0.0e0 as end_x, round(end_y, 6) + 0.0e0 as end_y,
            round((end_x - dx + end_x) / 2, 6) + 0.0e0 as mid_x, round((end_y - dy + end_y) / 2, 6) + 0.0e0 as mid_y,
            round(greatest(1, least(20, l2_norm)), 6) as line_width
        from (select *, sum(dx) over w as end_x, sum(dy) over w as end_y
              from (select *, vector[1] / count(*) over (partition by conv_id, turn) as dx,
                           vector[2] / count(*) over (partition by conv_id, turn) as dy,
                           sqrt(list_inner_product(vector, vector)) as l2_norm
                    from (select c.conv_id, c.turn, cast(c.position as bigint) as position, c.token,
                                 cast(v.vector as double[]) as vector
                          from (select conv_id, turn, unnest(w) as token, generate_subscripts(w, 1) - 1 as position
                                from (select conv_id, turn, {words('text')} as w from conversations)) c
                          join token_vectors v on v.token = c.token))
              window w as (partition by conv_id, turn order by position rows between unbounded preceding and current row))"""
    ),
    "legend_labels": """select doc_id, case when length(text) > 30 then substr(text, 1, 30) || '...' else text end as label
        from documents""",
    "token_inputs": sql(
        """select v.token, 'Token:' as instruction, v.token as text,
        i.token is not null and f.token is null and v.token <> '[UNK]' as resolved_to_unk
        from vocab_en v left join internal_tokens i on i.token = v.token left join vocab_fr f on f.token = v.token"""
    ),
    "runs_compare": f"""select run_name, output_dim, try_cast(output_dim as int) as output_dim_numeric, accuracy,
            coalesce(normalize_embeddings, false) as normalize_embeddings, start_ord, n_runs
        from (select *, row_number() over (partition by run_name order by start_ord) as r,
                     count(*) over (partition by run_name) as n_runs from {_RUNS} where parent_run is null) where r = 1""",
    "runs_selected": f"""select output_dim, accuracy, run_name, n_runs
        from (select *, row_number() over (partition by output_dim, accuracy order by start_ord) as r,
                     count(*) over (partition by output_dim, accuracy) as n_runs
              from {_RUNS} where parent_run is null
                and (run_name = 'dimNone' or run_name like '%sif%' or run_name = 'dim256')) where r = 1""",
}
