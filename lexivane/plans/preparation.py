"""Registered queries on triplets, prompts, corpora and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import text
from lexivane.operators import corpus as corpora
from lexivane.operators import splits
from lexivane.plans import views
from lexivane.plans.oracle import literal, sql, words
from lexivane.session import new_path
from lexivane.sources import triplets as sources

DOC_MAX_LENGTH = 400
SAMPLE = 200
LIMIT = 100


def triplets_flagged(spark, sf_dir):
    return views.triplets(spark, sf_dir).select("idx", "doc_id", "language", "query", sources.COMPLETE)


def triplets_loaded(spark, sf_dir):
    """Triplets of every language in files without a number, read back in one language by their place in the files."""
    docs = views.table(spark, sf_dir, "documents")
    shaped = docs.select(
        "doc_id",
        F.col("lang").alias("language"),
        F.substring_index("text", ".", 1).alias("query"),
        F.col("text").alias("positive"),
        F.when(F.col("n_chars") > DOC_MAX_LENGTH, F.col("source")).alias("negative"),
    )
    path = new_path(spark, "raw-triplets")
    shaped.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return sources.load_triplets(spark, path, "en").select("idx", "doc_id", "query", "query_instruct", sources.COMPLETE)


def complete_pairs(spark, sf_dir):
    rows = sources.complete_pairs(views.triplets(spark, sf_dir))
    return rows.select("idx", "query", "positive", "negative")


def prompts(spark, sf_dir):
    query = F.col("query")
    normalise = text.compose(
        text.lower_case, text.remove_accents, text.prepend_instruction(config.DANISH_INSTRUCTION)
    )
    return views.triplets(spark, sf_dir).select(
        "idx",
        text.detailed_instruct(query).alias("query_instruct"),
        text.danish_detailed_instruct(query).alias("query_danish"),
        text.detailed_instruct(query, quoted=False).alias("query_plain"),
        normalise(query).alias("query_normalised"),
    )


def _features(spark, sf_dir, add=(), rows=None):
    rows = views.triplets(spark, sf_dir) if rows is None else rows
    return corpora.index_corpus(corpora.create_corpus(rows, corpora.FEATURE_COLUMNS, add))


def corpus_prompts(spark, sf_dir):
    column, document = F.col("column"), F.col("document")
    pair = text.encoding_pair(column, document, config.DANISH_INSTRUCTION)
    return _features(spark, sf_dir).select(
        "corpus_idx",
        text.add_instruction(column, document, config.DANISH_INSTRUCTION).alias("processed_text"),
        pair["instruction"].alias("instruction"),
        pair["text"].alias("text"),
    )


def corpus_long(spark, sf_dir):
    return views.corpus(views.triplets(spark, sf_dir)).select("corpus_idx", "query_idx", "document", "column")


def corpus_features(spark, sf_dir):
    return _features(spark, sf_dir).select("corpus_idx", "query_idx", "document", "column")


def gold_mapping(spark, sf_dir):
    _, queries, _ = corpora.corpus_and_queries(views.triplets(spark, sf_dir))
    return queries.select("idx", "query", "corpus_idx")


def split_two_way(spark, sf_dir):
    return splits.stratified_split(views.triplets(spark, sf_dir)).select("idx", "split")


def split_three_way(spark, sf_dir):
    return splits.add_splits(views.triplets(spark, sf_dir)).select("idx", "split")


def split_counts(spark, sf_dir):
    rows = splits.add_splits(views.triplets(spark, sf_dir))
    long = corpora.create_corpus(rows, corpora.FEATURE_COLUMNS, ["split"])
    return long.groupBy("split", "column").agg(F.count(F.lit(1)).alias("n"))


def kfold(spark, sf_dir):
    return splits.stratified_k_fold(views.triplets(spark, sf_dir)).select("idx", "fold")


def fold_sizes(spark, sf_dir):
    sets = splits.fold_sets(splits.stratified_k_fold(views.triplets(spark, sf_dir)))
    return sets.groupBy("run_fold").agg(
        F.count_if(F.col("part") == "train").alias("n_train"),
        F.count_if(F.col("part") == "test").alias("n_test"),
    )


def sample_seeded(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return splits.sample_rows(docs, SAMPLE, idx="doc_id").select("doc_id", "lang", "n_chars")


def first_rows(spark, sf_dir):
    rows = sources.first_rows(views.triplets(spark, sf_dir), LIMIT)
    return rows.select("idx", "doc_id")


def first_test_rows(spark, sf_dir):
    """A limit after the split filter, which leaves gaps in the index."""
    held_out = splits.add_splits(views.triplets(spark, sf_dir)).filter(F.col("split") == "test")
    return sources.first_rows(held_out, LIMIT).select("idx", "doc_id")


def length_filter(spark, sf_dir):
    checked = corpora.add_lengths(_features(spark, sf_dir), config.MAX_LENGTH, DOC_MAX_LENGTH)
    return checked.select("corpus_idx", "n_tokens", "fits_length")


def length_report(spark, sf_dir):
    return corpora.length_report(corpora.add_lengths(_features(spark, sf_dir), config.MAX_LENGTH, DOC_MAX_LENGTH))


def normalised_text(spark, sf_dir):
    normalise = text.compose(text.lower_case, text.remove_accents, None, text.strip)
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", normalise(F.col("text")).alias("text"))


def _token_filter(**switches):
    pattern = text.removal_pattern(**switches)

    def query(spark, sf_dir):
        _, checked = text.validate_parameters(None, None, pattern)
        tokens = views.raw_tokens(spark, sf_dir)
        return tokens.select("token", text.is_removed(F.col("token"), checked).alias("removed"))

    return query


QUERIES = {
    "triplets_flagged": triplets_flagged,
    "triplets_loaded": triplets_loaded,
    "complete_pairs": complete_pairs,
    "prompts": prompts,
    "corpus_prompts": corpus_prompts,
    "corpus_long": corpus_long,
    "corpus_features": corpus_features,
    "gold_mapping": gold_mapping,
    "split_two_way": split_two_way,
    "split_three_way": split_three_way,
    "split_counts": split_counts,
    "kfold": kfold,
    "fold_sizes": fold_sizes,
    "sample_seeded": sample_seeded,
    "first_rows": first_rows,
    "first_test_rows": first_test_rows,
    "length_filter": length_filter,
    "length_report": length_report,
    "normalised_text": normalised_text,
    "token_filter_default": _token_filter(),
    "token_filter_upper": _token_filter(strip_upper_case=True),
    "token_filter_exotic": _token_filter(strip_exotic=True),
    "token_filter_uncommon": _token_filter(strip_uncommon=True),
    "token_filter_all": _token_filter(strip_upper_case=True, strip_exotic=True, strip_uncommon=True),
}

_INSTRUCT = f"{literal('Instruct: ' + config.EMBED_INSTRUCTION)} || chr(10) || 'Query: ' || query"
_DANISH = literal(config.DANISH_INSTRUCTION + " ")
_ACCENTS = f"translate(lower({{}}), '{config.ACCENTED}', '{config.UNACCENTED}')"
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_LENGTHS = f"""select corpus_idx, cast(least(len({words('document')}), {config.MAX_LENGTH}) as bigint) as n_tokens,
    least(len({words('document')}), {config.MAX_LENGTH}) <= {DOC_MAX_LENGTH} as fits_length from features"""

# The removal rules without look-ahead.
UPPER_RULE = r"regexp_matches(token, '^[\p{L}\p{N}\p{M}_]*[A-Z]')"
_PLAIN = "a-zA-ZæøåÆØÅ0-9.,\\t\\n\\f\\r "
EXOTIC_RULE = f"""(regexp_matches(token, '[^{_PLAIN}]') and not regexp_matches(token, '^Ġ[{_PLAIN}]*$')
    and token <> '<|end_of_text|>')"""
UNCOMMON_RULE = r"""(regexp_matches(token, '^\p{Nd}{2,}$|^Ġ{2,}|^\.|^Ġ.*\p{Nd}.*\p{Nd}')
    or (regexp_matches(token, '[a-zA-Z]') and regexp_matches(token, '\p{Nd}')))"""
DEFAULT_RULE = r"regexp_matches(token, '^\[unused\p{Nd}+\]')"


def _removed(*rules):
    return sql(f"select token, {' or '.join([DEFAULT_RULE, *rules])} as removed from raw_tokens")


ORACLES = {
    "triplets_flagged": sql(
        "select idx, doc_id, language, query, complete as has_positive_and_negative from flagged"
    ),
    "triplets_loaded": f"""select row_number() over (order by doc_id) - 1 as idx, doc_id, query, '''' || {_INSTRUCT} || '''' as query_instruct,
        has_positive and n_chars > {DOC_MAX_LENGTH} and has_source as has_positive_and_negative
        from (select doc_id, n_chars, split_part(text, '.', 1) as query, text is not null as has_positive,
              source is not null as has_source from documents where lang = 'en')""",
    "complete_pairs": sql("select idx, query, positive, negative from complete_pairs"),
    "prompts": sql(
        f"""select idx, '''' || {_INSTRUCT} || '''' as query_instruct, {_DANISH} || query as query_danish,
        {_INSTRUCT} as query_plain, {_DANISH} || {_ACCENTS.format('query')} as query_normalised from triplets"""
    ),
    "corpus_prompts": sql(
        f"""select corpus_idx, case when "column" = 'query'
          then {literal(config.DANISH_INSTRUCTION + ' ' + config.INSTRUCTION_SEPARATOR)}
          else {literal(config.INSTRUCTION_SEPARATOR)} end || document as processed_text,
        case when "column" = 'query' then {literal(config.DANISH_INSTRUCTION)} else '' end as instruction,
        document as text from features"""
    ),
    "corpus_long": sql('select corpus_idx, query_idx, document, "column" from corpus'),
    "corpus_features": sql('select corpus_idx, query_idx, document, "column" from features'),
    "gold_mapping": sql("select query_idx as idx, query, corpus_idx from queries"),
    "split_two_way": sql(
        """select d.idx, case when d.place <= q.n_test then 'test' else 'train' end as split
        from (select *, row_number() over (partition by stratum order by h) as place from draws) d
        join test_quota q on q.stratum = d.stratum"""
    ),
    "split_three_way": sql("select idx, split from splits"),
    "split_counts": sql(
        """select s.split, f."column", count(*) as n from features f join splits s on s.idx = f.query_idx
        group by 1, 2"""
    ),
    "kfold": sql("select idx, fold from folds"),
    "fold_sizes": sql(
        """select cast(r as int) as run_fold, count(*) filter (fold <> r) as n_train,
        count(*) filter (fold = r) as n_test from folds, range(10) t(r) group by r"""
    ),
    "sample_seeded": f"""select doc_id, lang, n_chars from documents
        order by md5('{config.RANDOM_STATE}:' || doc_id) limit {SAMPLE}""",
    "first_test_rows": sql(
        f"""select idx, doc_id from triplets join splits using (idx) where split = 'test' order by idx limit {LIMIT}"""
    ),
    "first_rows": sql(f"select idx, doc_id from triplets order by idx limit {LIMIT}"),
    "length_filter": sql(_LENGTHS),
    "length_report": sql(
        f"""select count(*) filter (fits_length) as kept, count(*) filter (not fits_length) as dropped,
        round(coalesce(count(*) filter (fits_length) / nullif(count(*), 0)::double, 0), 6) as ratio
        from ({_LENGTHS})"""
    ),
    "normalised_text": f"""select doc_id, regexp_replace({_ACCENTS.format('text')},
        '^{_SPACE}+|{_SPACE}+$', '', 'g') as text from documents""",
    "token_filter_default": _removed(),
    "token_filter_upper": _removed(UPPER_RULE),
    "token_filter_exotic": _removed(EXOTIC_RULE),
    "token_filter_uncommon": _removed(UNCOMMON_RULE),
    "token_filter_all": _removed(UPPER_RULE, EXOTIC_RULE, UNCOMMON_RULE),
}
