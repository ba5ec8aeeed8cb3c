"""SQL for the same views, assembled by name into reference queries."""

from __future__ import annotations

import re

from lexivane import config

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"
NOT_BLANK = r"regexp_matches({}, '[^\s\p{{Z}}\x0b\x1c-\x1f\x85]')"


def words(column: str) -> str:
    return WORDS.format(column)


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _quota(rows: str, share: float, out: str) -> str:
    return f"""
        select * exclude (base, rest, total, drawn), base + case when
                 row_number() over (order by rest desc, stratum) <= drawn - sum(base) over ()
                 then 1 else 0 end as {out}
        from (select *, cast((drawn::hugeint * {rows}) // total as bigint) as base,
                     cast((drawn::hugeint * {rows}) % total as bigint) as rest
              from (select *, cast(sum({rows}) over () as bigint) as total,
                           cast(ceil(cast(sum({rows}) over () as double) * {share}) as bigint) as drawn
                    from FROM_HERE))"""


def _model(at: str) -> str:
    return f"""select v.token_id, v.token, v.n, e.embedding as vector
        from vocab_en v join embeddings e on e.vec_id = {at}"""


def _vocabulary(lang: str) -> str:
    return f"""select row_number() over (order by n desc, first) - 1 as token_id, token, n
        from (select token, count(*) as n, min(row(doc_id, pos)) as first
              from (select doc_id, unnest(w) as token, generate_subscripts(w, 1) as pos
                    from (select doc_id, {words('text')} as w from documents where lang = '{lang}'))
              group by token)
        order by n desc, first limit {config.VOCAB_SIZE}"""


def mean_vectors(texts: str, key: str, model: str = "token_vectors") -> str:
    """(key, vector) for a table of (key, text): the mean over known tokens."""
    return f"""select t.{key}, coalesce(m.vector, list_transform(range(64), lambda i: 0.0::double)) as vector
        from {texts} t left join (
            select {key}, list(value order by dim) as vector
            from (select {key}, dim, avg(value) as value
                  from (select w.{key}, unnest(range(64)) as dim,
                               unnest(cast(v.vector as double[])) as value
                        from (select {key}, unnest({words('text')}) as token from {texts}) w
                        join {model} v on w.token = v.token)
                  group by {key}, dim)
            group by {key}) m on t.{key} = m.{key}"""


VIEWS = {
    "triplets": """select row_number() over (order by d.doc_id) - 1 as idx, d.doc_id, d.lang as language,
        split_part(d.text, '.', 1) as query,
        case when l.quality = 0 then null else d.text end as positive,
        case when l.toxic = 1 then null else lead(d.text) over (order by d.doc_id) end as negative
        from documents d left join labels l on d.doc_id = l.doc_id where d.lang = 'en'""",
    "flagged": "select *, positive is not null and negative is not null as complete from triplets",
    "turn_pairs": """select *, lead(positive) over (order by idx) as negative from (
        select row_number() over (order by q.conv_id, q.turn) - 1 as idx, q.conv_id, q.turn,
               q.text as query, a.text as positive
        from conversations q left join conversations a
          on a.conv_id = q.conv_id and a.turn = q.turn + 1 and a.role = 'assistant'
        where q.role = 'user')""",
    "corpus": f"""select row_number() over (order by idx, pos) - 1 as corpus_idx, idx as query_idx, document, "column"
        from (select idx, 0 as pos, positive as document, 'positive' as "column" from triplets
              union all select idx, 1, negative, 'negative' from triplets)
        where document is not null and {NOT_BLANK.format('document')}""",
    "features": f"""select row_number() over (order by idx, pos) - 1 as corpus_idx, idx as query_idx, document, "column"
        from (select idx, 0 as pos, query as document, 'query' as "column" from triplets
              union all select idx, 1, negative, 'negative' from triplets
              union all select idx, 2, positive, 'positive' from triplets)
        where document is not null and {NOT_BLANK.format('document')}""",
    "gold": """select query_idx, max(corpus_idx) as corpus_idx from corpus
        where "column" = 'positive' group by query_idx""",
    "queries": """select t.idx as query_idx, t.query, g.corpus_idx
        from triplets t left join gold g on g.query_idx = t.idx""",
    "vocab_en": _vocabulary("en"),
    "vocab_fr": _vocabulary("fr"),
    "token_vectors": _model("v.token_id % (select count(*) from embeddings)"),
    "token_vectors_2": _model("(v.token_id * 7 + 3) % (select count(*) from embeddings)"),
    "internal_tokens": f"select distinct unnest({words('text')}) as token from benchmark",
    "raw_tokens": r"""select distinct token from (
        select unnest(string_split_regex(text, '[ \t\n\r\f]+')) as token
        from (select text from documents union all select url from pages)) where token <> ''""",
    "stacked": """select place * ((select max(idx) from triplets) + 1) + idx as ord, text from (
        select 0 as place, idx, query as text from triplets
        union all select 1, idx, positive from triplets
        union all select 2, idx, negative from triplets)""",
    "stacked_words": f"""select token, count(*) as n, min(row(ord, pos)) as first
        from (select ord, unnest(w) as token, generate_subscripts(w, 1) as pos
              from (select ord, {words('text')} as w from stacked))
        group by token""",
    "ranked": """select row_number() over (order by n desc, first) - 1 as rank, token as word, n as counts,
        n / cast(sum(n) over () as double) as prob from stacked_words""",
    "full_vocab": "select token_id, token from vocab_en union all select count(*), '[UNK]' from vocab_en",
    "doc_words": f"""select token, count(*) as n, min(row(doc_id, pos)) as first
        from (select doc_id, unnest(w) as token, generate_subscripts(w, 1) as pos
              from (select doc_id, {words('text')} as w from documents))
        group by token""",
    "token_counts": """select coalesce(v.token_id, (select max(token_id) from full_vocab)) as token_id,
        cast(sum(w.n) as bigint) as n, min(w.first) as first
        from doc_words w left join full_vocab v on v.token = w.token group by 1""",
    "draws": f"""select idx, cast(complete as varchar) as stratum,
        md5('{config.RANDOM_STATE}:' || idx) as h from flagged""",
    "strata": "select stratum, count(*) as n, min(idx) as first from draws group by stratum",
    "test_quota": _quota("n", config.TEST_SIZE, "n_test").replace("FROM_HERE", "strata"),
    "val_quota": _quota("n_rest", config.VAL_SIZE, "n_val").replace(
        "FROM_HERE", "(select *, n - n_test as n_rest from test_quota)"
    ),
    "splits": """select d.idx, case when d.place <= q.n_test then 'test'
          when d.place <= q.n_test + q.n_val then 'val' else 'train' end as split
        from (select *, row_number() over (partition by stratum order by h) as place from draws) d
        join val_quota q on q.stratum = d.stratum""",
    "folds": """select d.idx, cast(min(s.fold) as int) as fold
        from (select idx, stratum, row_number() over (partition by stratum order by idx) as place from draws) d
        join (select stratum, fold, sum(share) over (partition by stratum order by fold) as upto
              from (select stratum, fold, count(*) as share
                    from (select stratum, unnest(range(start, start + n)) % 10 as fold
                          from (select stratum, n, coalesce(cast(sum(n) over (order by first rows between
                                  unbounded preceding and 1 preceding) as bigint), 0) as start from strata))
                    group by stratum, fold)) s
          on s.stratum = d.stratum and d.place <= s.upto
        group by d.idx""",
    "bm25_docs": f"select corpus_idx, {words('document')} as tokens from corpus",
    "bm25_tf": """select corpus_idx, token, count(*) as tf, any_value(dl) as dl from (
        select corpus_idx, len(tokens) as dl, unnest(tokens) as token from bm25_docs) group by 1, 2""",
    "bm25_size": "select count(*) as n_docs, avg(len(tokens)) as avgdl from bm25_docs",
    "bm25_idf": """select token, ln(1 + ((select n_docs from bm25_size) - df + 0.5e0) / (df + 0.5e0)) as idf
        from (select token, count(*) as df from bm25_tf group by token)""",
    "bm25_hits": f"""select q.query_idx, t.corpus_idx, round(sum(q.repeats * i.idf * t.tf /
          (t.tf + 1.5e0 * (0.25e0 + 0.75e0 * t.dl / (select avgdl from bm25_size)))), 6) as score
        from (select query_idx, token, count(*) as repeats
              from (select query_idx, unnest({words('query')}) as token from queries) group by 1, 2) q
        join bm25_idf i on i.token = q.token join bm25_tf t on t.token = q.token group by 1, 2""",
    "bm25_list": """select query_idx, row_number() over (partition by query_idx
          order by score desc, corpus_idx) as rank, corpus_idx, score from bm25_hits""",
    "query_texts": "select query_idx, query as text from queries",
    "corpus_texts": "select corpus_idx, document as text from corpus",
    "query_vectors": mean_vectors("query_texts", "query_idx"),
    "corpus_vectors": mean_vectors("corpus_texts", "corpus_idx"),
    "knn_list": """select query_idx, row_number() over (partition by query_idx
          order by score, corpus_idx) as rank, corpus_idx, score
        from (select q.query_idx, d.corpus_idx, round(list_distance(q.vector, d.vector), 6) as score
              from query_vectors q, corpus_vectors d)""",
    "lists": """select query_idx, corpus_idx, rank, 0 as list from knn_list where rank <= TOP
        union all select query_idx, corpus_idx, rank, 1 from bm25_list where rank <= TOP""",
    "fused": """select query_idx, row_number() over (partition by query_idx order by score desc, seen) as rank,
          corpus_idx, score
        from (select query_idx, corpus_idx, round(sum(1.0e0 / (60 + rank)), 9) as score,
                     min(row(list, rank)) as seen from lists group by 1, 2)""",
    "instruct_texts": f"""select idx as query_idx, {literal("'Instruct: " + config.EMBED_INSTRUCTION)} || chr(10)
        || 'Query: ' || query || '''' as text from triplets""",
    "query_vectors_2": mean_vectors("instruct_texts", "query_idx", "token_vectors_2"),
    "corpus_vectors_2": mean_vectors("corpus_texts", "corpus_idx", "token_vectors_2"),
    "reranked": """select query_idx, row_number() over (partition by query_idx
          order by score desc, corpus_idx) as rank, corpus_idx, score
        from (select c.query_idx, c.corpus_idx,
                     round(list_inner_product(q.vector, d.vector), 6) as score
              from (select query_idx, corpus_idx from fused where rank <= 100) c
              join query_vectors_2 q on q.query_idx = c.query_idx
              join corpus_vectors_2 d on d.corpus_idx = c.corpus_idx)""",
    "complete_pairs": "select idx, query, positive, negative from triplets where positive is not null and negative is not null",
    "pair_texts": """select idx, side, text from (
        select idx, 'q' as side, query as text from complete_pairs
        union all select idx, 'p', positive from complete_pairs
        union all select idx, 'n', negative from complete_pairs)""",
    "pair_keys": "select row_number() over (order by idx, side) as k, idx, side, text from pair_texts",
    "pair_means": mean_vectors("pair_keys", "k"),
    "pairs": """select x.idx, any_value(m.vector) filter (x.side = 'q') as q,
        any_value(m.vector) filter (x.side = 'p') as p, any_value(m.vector) filter (x.side = 'n') as n
        from pair_keys x join pair_means m on m.k = x.k group by x.idx""",
    "pair_distance": """select *, cast(pos_dist < neg_dist as int) as prediction from (
        select idx, round(list_distance(q, p), 6) as pos_dist, round(list_distance(q, n), 6) as neg_dist from pairs)""",
    "pair_cosine": """select *, coalesce(cast(pos_sim > neg_sim as int), 0) as prediction from (
        select idx, round(list_inner_product(q, p) / nullif(sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(p, p)), 0), 6) as pos_sim,
               round(list_inner_product(q, n) / nullif(sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(n, n)), 0), 6) as neg_sim from pairs)""",
    "instructed": f"select idx, {literal(config.DANISH_INSTRUCTION + ' ')} || query as text from complete_pairs",
    "instructed_1": mean_vectors("instructed", "idx"),
    "plain_queries": "select idx, query as text from complete_pairs",
    "plain_2": mean_vectors("plain_queries", "idx", "token_vectors_2"),
    "pair_instruct": """select *, cast(pos_dist < neg_dist as int) as prediction from (
        select p.idx, round(list_distance(i.vector, p.p), 6) as pos_dist,
               round(list_distance(i.vector, p.n), 6) as neg_dist from pairs p join instructed_1 i on i.idx = p.idx)""",
    "pair_instruct_model": """select *, cast(pos_dist < neg_dist as int) as prediction from (
        select p.idx, round(list_distance(i.vector, p.p), 6) as pos_dist,
               round(list_distance(i.vector, p.n), 6) as neg_dist from pairs p join plain_2 i on i.idx = p.idx)""",
    "okapi": "OKAPI triplets",
    "okapi_turns": "OKAPI turn_pairs",
    "predictions": """select 'raw' as model, idx, prediction from pair_distance
        union all select 'cosine', idx, prediction from pair_cosine
        union all select 'instruct', idx, prediction from pair_instruct_model
        union all select 'bm25', idx, prediction from okapi where prediction >= 0""",
    "counts4": """select model, count(*) filter (prediction <> 1) as n10, count(*) filter (prediction = 1) as n11
        from predictions group by model""",
}


def _okapi(source: str) -> str:
    """Okapi scores of every row's own three documents."""
    score = "f.q * f.idf * f.{s} * 2.5e0 / (f.{s} + 1.5e0 * (0.25e0 + 0.75e0 * f.{s}l / f.avgdl))"
    return f"""with c as (
            select *, cast(p > 0 as int) + cast(n > 0 as int) as held
            from (select idx, token, count(*) filter (side = 'q') as q, count(*) filter (side = 'p') as p,
                         count(*) filter (side = 'n') as n
                  from (select idx, side, unnest(w) as token
                        from (select idx, 'q' as side, {words('query')} as w from {source}
                              union all select idx, 'p', {words('positive')} from {source}
                              union all select idx, 'n', {words('negative')} from {source}))
                  group by idx, token)),
          b as (
            select idx, sum(p) as pl, sum(n) as nl,
                   ((count(*) filter (held = 1) + 5) * (ln(2.5e0) - ln(1.5e0))
                     + count(*) filter (held = 2) * (ln(1.5e0) - ln(2.5e0)))
                   / (count(*) filter (held > 0) + 5) as mean_idf
            from c group by idx),
          f as (
            select c.*, b.pl, b.nl, (b.pl + b.nl + 5) / 3.0e0 as avgdl,
                   case when held = 2 then 0.25e0 * b.mean_idf else ln(2.5e0) - ln(1.5e0) end as idf
            from c join b on b.idx = c.idx where c.q > 0 and c.held > 0),
          s as (
            select idx, sum({score.format(s='p')}) as pos, sum({score.format(s='n')}) as neg from f group by idx)
        select *, case when pos_score is null then -1 else cast(pos_score > neg_score as int) end as prediction
        from (select t.idx, case when t.positive is not null and t.negative is not null
                then round(coalesce(s.pos, 0), 6) end as pos_score,
              case when t.positive is not null and t.negative is not null
                then round(coalesce(s.neg, 0), 6) end as neg_score
              from {source} t left join s on s.idx = t.idx)"""


VIEWS["okapi"] = _okapi("triplets")
VIEWS["okapi_turns"] = _okapi("turn_pairs")


def sql(body: str, top: int = config.TOP_K) -> str:
    """The query with every view it names, directly or not, in front of it."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        found = set(re.findall(r"\w+", todo.pop())) & set(VIEWS)
        todo += [VIEWS[name] for name in found - needed]
        needed |= found
    heads = [f"{name} as ({VIEWS[name].replace('TOP', str(top))})" for name in VIEWS if name in needed]
    return ("with " + ",\n".join(heads) + "\n" if heads else "") + body


def on_split_rows(statement: str, *chosen_splits: str) -> str:
    """A statement of sql() with the triplets of some splits in place of all."""
    chosen = sql(f"select idx from splits where split in ({', '.join(map(literal, chosen_splits))})")
    return statement.replace(f"triplets as ({VIEWS['triplets']})", f"triplets as (select * from ({VIEWS['triplets']}) where idx in ({chosen}))", 1)


def on_test_rows(statement: str) -> str:
    """A statement of sql() with the held-out triplets in place of all."""
    return on_split_rows(statement, "test")


_SQUARINGS = 30


def each_once(vectors: str) -> str:
    """Points of a table (v) whose rows stand for themselves."""
    return f"select v, 1 as n, 1.0e0 as s, 1.0e0 as q from ({vectors})"


def projected(rows: str) -> str:
    """(the columns of rows (v, ...), dim, value): their coordinates on `axes`."""
    return f"""select r.* exclude (v), cast(a.dim as bigint) as dim,
        round(list_inner_product(cast(r.v as double[]), a.axis) - a.offset_, 6) + 0.0e0 as value from ({rows}) r cross join axes a"""


def on_components(points: str, k: int, body: str, width: int = 64) -> str:
    """A query over `axes` (dim, axis, value, offset_): the k leading components of points (v, n, s, q).

    A row of points stands for n vectors: v times factors that sum to s, whose squares sum to q. The covariance over its trace
    is squared until only its leading component is left. Its largest loading is made positive, and it is taken out of the covariance.
    """
    squared = "list_transform(m, lambda r: list_transform(m, lambda c: list_inner_product(r, c)))"
    norm = "list_sum(list_transform(m, lambda r: list_inner_product(r, r)))"
    over = "list_transform({m}, lambda r: list_transform(r, lambda x: x / {by}))"
    trace = f"list_sum(list_transform(range(1, {width + 1}), lambda i: {{0}}[i][i]))"
    found = f"""with recursive points as (select cast(v as double[]) as v, cast(n as double) as n, s, q from ({points})),
      total as (select sum(n) as n from points),
      long as (select row, s, q, unnest(range({width})) as i, unnest(v) as x from (select *, row_number() over () as row from points)),
      middle as (select i, sum(s * x) / (select n from total) as mean from long group by i),
      moments as (select a.i, b.i as j, sum(a.q * a.x * b.x) as c from long a join long b on a.row = b.row group by all),
      covariance as (
        select list(r order by i) as c from (
          select m.i, list((m.c - (select n from total) * a.mean * b.mean) / ((select n from total) - 1) order by m.j) as r
          from moments m join middle a on a.i = m.i join middle b on b.i = m.j group by m.i)),
      steps as (
        select 0 as dim, 0 as step, c, {over.format(m='c', by=trace.format('c'))} as m, cast(null as double[]) as axis, cast(null as double) as value
        from covariance
        union all
        select case when step = {_SQUARINGS} then dim + 1 else dim end, case when step = {_SQUARINGS} then 0 else step + 1 end, c,
          case when step = {_SQUARINGS} then {over.format(m='c', by=trace.format('c'))}
            else {over.format(m=squared, by='norm')} end, a, l
        from (
          select dim, step, m, norm, a, l,
            case when a is null then c else list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - l * a[i] * a[j])) end as c
          from (
            select *, list_inner_product(list_transform(c, lambda r: list_inner_product(r, a)), a) as l
            from (
              select *, case when step = {_SQUARINGS} then list_transform(m[top], lambda x: x / sqrt(m[top][top])) end as a
              from (
                select dim, step, c, m, {norm} as norm, list_position(diagonal, list_max(diagonal)) as top
                from (select *, list_transform(range(1, {width + 1}), lambda i: m[i][i]) as diagonal from steps where dim < {k})))))),
      axes as (
        select dim - 1 as dim, axis, value, list_inner_product(axis, (select list(mean order by i) from middle)) as offset_
        from steps where step = 0 and dim > 0)
      {body}"""
    return f"select * from ({found})"
