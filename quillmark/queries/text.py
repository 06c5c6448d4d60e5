"""Queries of tokenisers, vocabularies, corpus statistics and document vectors, over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import vectors, vocab
from quillmark.queries.base import table

#: A fixed list of frequent English words, as a stoplist of the tests.
STOPWORDS = ("a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def _tokens(s: SparkSession, d: str, tokenizer=T.tokens) -> DataFrame:
    return vocab.explode_tokens(_docs(s, d), tokenizer=tokenizer)


def _stats(s: SparkSession, d: str) -> DataFrame:
    return vocab.term_stats(_tokens(s, d))


def _weighted(s: SparkSession, d: str) -> DataFrame:
    n = vocab.corpus_size(_docs(s, d))
    return vocab.tfidf(_stats(s, d).join(F.broadcast(n), F.lit(True)), F.col("n_docs")).drop("n_docs")


def _ids(s: SparkSession, d: str) -> DataFrame:
    return vocab.type_ids(_tokens(s, d))


def _counts(tokenizer):
    return lambda s, d: _tokens(s, d, tokenizer).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("term").alias("n_terms"), F.sum(F.length("term")).alias("n_chars"))


def tok_display(s: SparkSession, d: str) -> DataFrame:
    """S11."""
    return _docs(s, d).select("doc_id", F.array_join(T.tokens("text"), " ").alias("display"))


def tok_stopwords(s: SparkSession, d: str) -> DataFrame:
    stop = s.createDataFrame([(w,) for w in STOPWORDS], "word string")
    return vocab.remove_stopwords(_tokens(s, d), stop).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


def tok_stopwords_inline(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.size(T.drop_stopwords(T.tokens("text"), STOPWORDS)).alias("n_kept"))


def tok_predicate(s: SparkSession, d: str) -> DataFrame:
    """Tokens of at least eight characters."""
    return _docs(s, d).select("doc_id", F.size(T.keep_tokens(T.tokens("text"), lambda x: F.length(x) >= 8)).alias("n_long"))


def tok_max_length(s: SparkSession, d: str) -> DataFrame:
    """T9."""
    return _docs(s, d).select("doc_id", F.size(T.check_token_length(T.tokens("text"))).alias("n_tokens"))


def tf_df(s: SparkSession, d: str) -> DataFrame:
    return _stats(s, d)


def tfidf(s: SparkSession, d: str) -> DataFrame:
    return _weighted(s, d).select("term", F.round("tfidf", 6).alias("tfidf"))


def tfidf_rank(s: SparkSession, d: str) -> DataFrame:
    w = _weighted(s, d).withColumn("tfidf", F.round("tfidf", 6))
    return vocab.rank_by_tfidf(w, _ids(s, d)).select("term", "type_id", "rank")


def keep_topn(s: SparkSession, d: str) -> DataFrame:
    w = _weighted(s, d).withColumn("tfidf", F.round("tfidf", 6)).join(_ids(s, d), "term")
    return vocab.keep_top(w, 200).select("term", "type_id", "tfidf")


def keep_topn_corpus(s: SparkSession, d: str) -> DataFrame:
    return vocab.restrict(_tokens(s, d), keep_topn(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))


def pruned_words(s: SparkSession, d: str) -> DataFrame:
    """V5: the words that pruning to the top 200 turns into stopwords."""
    return _stats(s, d).select("term").join(keep_topn(s, d).select("term"), "term", "left_anti")


def prune_rare(s: SparkSession, d: str) -> DataFrame:
    return vocab.prune_rare(_stats(s, d), 5)


def vocabulary(s: SparkSession, d: str) -> DataFrame:
    return _ids(s, d)


def doc_lengths(s: SparkSession, d: str) -> DataFrame:
    return vocab.doc_lengths(_docs(s, d), _tokens(s, d))


def corpus_arrays(s: SparkSession, d: str) -> DataFrame:
    """The type ids in order as text, and as an svm-light line."""
    a = vocab.corpus_arrays(_tokens(s, d), _ids(s, d))
    return a.select("doc_id", vectors.index_string(F.col("types")).alias("types"), vectors.svmlight(F.col("types")).alias("svmlight"))


def postings(s: SparkSession, d: str) -> DataFrame:
    return vocab.postings(_tokens(s, d))


def corpus_totals(s: SparkSession, d: str) -> DataFrame:
    return vocab.corpus_totals(_docs(s, d), _tokens(s, d)).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


def type_cumsum(s: SparkSession, d: str) -> DataFrame:
    return vocab.cumulative_mass(_stats(s, d), _ids(s, d)).withColumn("mass", F.round("mass", 9))


def topic_mass_report(s: SparkSession, d: str) -> DataFrame:
    """Every 50th type of the cumulative order."""
    return type_cumsum(s, d).where("rank % 50 = 0").select("rank", "mass")


def rare_sweep(s: SparkSession, d: str) -> DataFrame:
    return vocab.rare_sweep(_stats(s, d))


def cooc_adjacent(s: SparkSession, d: str) -> DataFrame:
    return vocab.adjacent_pairs(_docs(s, d))


def cooc_symmetric(s: SparkSession, d: str) -> DataFrame:
    return vocab.symmetric_cooccurrence(vocab.adjacent_pairs(_docs(s, d)))


def cooc_norm(s: SparkSession, d: str) -> DataFrame:
    return vocab.normalised_cooccurrence(vocab.adjacent_pairs(_docs(s, d)), _stats(s, d)).withColumn("score", F.round("score", 9))


def common_words(s: SparkSession, d: str) -> DataFrame:
    """Each document and the next one by id (ids follow each other)."""
    a = _docs(s, d).select("doc_id", T.tokens("text").alias("t"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return a.join(b, "doc_id").select("doc_id", F.array_join(vocab.common_words(F.col("t"), F.col("u")), " ").alias("words"))


def vec_frequency(s: SparkSession, d: str) -> DataFrame:
    """F1, F5."""
    return vectors.frequency_map(_tokens(s, d)).select("doc_id", vectors.annotated(F.col("vector")).alias("vector"))


def vec_occurrence(s: SparkSession, d: str) -> DataFrame:
    return vectors.occurrence_terms(_tokens(s, d))


def vec_tfidf(s: SparkSession, d: str) -> DataFrame:
    return vectors.tfidf_vector(_tokens(s, d), _weighted(s, d)).select("doc_id", "term", F.round("value", 6).alias("value"))


def sort_indices(s: SparkSession, d: str) -> DataFrame:
    """the indices of the first topic vector entries by falling value."""
    return table(s, d, "doc_topics").where("theta IS NOT NULL").select("doc_id", F.array_join(F.transform(vectors.sort_indices(F.col("theta")), lambda i: i.cast("string")), " ").alias("indices"))


def _tok_sql(cls: str, lower: bool = True) -> str:
    base = "lower(text)" if lower else "text"
    return rf"regexp_extract_all(regexp_replace(regexp_replace({base}, '[\r\n\t]+', ' ', 'g'), '[^{cls}\p{{Z}}\p{{P}}]', '', 'g'), '[{cls}]+')"


_LM = r"\p{L}\p{M}"
_CON = r"regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[\r\n\t]+', ' ', 'g'), '[^\p{L}\p{M}\p{Z}\p{P}%s]', '', 'g'), '[\p{L}\p{M}\p{Pc}%s]+')"
_RAW = r"list_filter(regexp_split_to_array(regexp_replace(text, '[\r\n\t]+', ' ', 'g'), '[\p{Zs}\p{Zl}]+'), lambda x: x <> '')"
_DIR = r"list_filter(regexp_extract_all(lower(regexp_replace(text, '[\r\n\t]+', ' ', 'g')), '[\p{L}\p{N}_]+'), lambda x: NOT contains(x, '--') AND NOT contains(x, '__'))"


def with_tokens(expr: str = _tok_sql(_LM)) -> str:
    return f"""WITH arr AS (SELECT doc_id, {expr} AS t FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM arr)"""


_CNT = " SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, sum(length(term))::BIGINT AS n_chars FROM tok GROUP BY 1"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_W = with_tokens()
_STATS = _W + ", st AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1)"
_IDS = _STATS + ", ids AS (SELECT (row_number() OVER (ORDER BY f) - 1)::INT AS type_id, term FROM (SELECT term, min({'d': doc_id, 'p': pos}) AS f FROM tok GROUP BY 1))"
_TFIDF = _IDS + ", w AS (SELECT term, tf, df, round(tf * ln((SELECT count(*) FROM documents) / df), 6) AS tfidf FROM st), rk AS (SELECT term, type_id, tfidf, row_number() OVER (ORDER BY tfidf DESC, type_id DESC)::INT AS rank FROM w JOIN ids USING (term))"
_COOC = _W + ", nx AS (SELECT term AS w1, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tok), co AS (SELECT w1, w2, count(*) AS n FROM nx WHERE w2 IS NOT NULL GROUP BY 1, 2)"
_CUM = _IDS + ", cm AS (SELECT term, type_id, tf, row_number() OVER w::INT AS rank, round(sum(tf) OVER w / sum(tf) OVER (), 9) AS mass FROM st JOIN ids USING (term) WINDOW w AS (ORDER BY tf DESC, type_id ROWS UNBOUNDED PRECEDING))"

QUERIES = {
    "tok_simple": _counts(T.tokens), "tok_numeric": _counts(lambda c: T.tokens(c, keep_numbers=True)), "tok_raw": _counts(T.raw_tokens), "tok_connector": _counts(lambda c: T.tokens(c, keep_connectors=True)),
    "tok_connector_numeric": _counts(lambda c: T.tokens(c, True, True)), "tok_directory": _counts(T.directory_tokens), "tok_display": tok_display, "tok_stopwords": tok_stopwords, "tok_stopwords_inline": tok_stopwords_inline,
    "tok_predicate": tok_predicate, "tok_max_length": tok_max_length, "tf_df": tf_df, "tfidf": tfidf, "tfidf_rank": tfidf_rank, "keep_topn": keep_topn, "keep_topn_corpus": keep_topn_corpus, "pruned_words": pruned_words,
    "prune_rare": prune_rare, "vocabulary": vocabulary, "doc_lengths": doc_lengths, "corpus_arrays": corpus_arrays, "postings": postings, "corpus_totals": corpus_totals, "type_cumsum": type_cumsum,
    "topic_mass_report": topic_mass_report, "rare_sweep": rare_sweep, "cooc_adjacent": cooc_adjacent, "cooc_symmetric": cooc_symmetric, "cooc_norm": cooc_norm, "common_words": common_words,
    "vec_frequency": vec_frequency, "vec_occurrence": vec_occurrence, "vec_tfidf": vec_tfidf, "sort_indices": sort_indices,
}

SQL = {
    "tok_simple": _W + _CNT,
    "tok_numeric": with_tokens(_tok_sql(_LM + r"\p{Nd}")) + _CNT,
    "tok_raw": with_tokens(_RAW) + _CNT,
    "tok_connector": with_tokens(_CON % ("", "")) + _CNT,
    "tok_connector_numeric": with_tokens(_CON % (r"\p{Nd}", r"\p{Nd}")) + _CNT,
    "tok_directory": with_tokens(_DIR) + _CNT,
    "tok_display": _W + " SELECT doc_id, array_to_string(t, ' ') AS display FROM arr",
    "tok_stopwords": _W + f" SELECT term, count(*) AS tf FROM tok WHERE term NOT IN ({_STOP}) GROUP BY 1",
    "tok_stopwords_inline": _W + f" SELECT doc_id, len(list_filter(t, lambda x: x NOT IN ({_STOP})))::INT AS n_kept FROM arr",
    "tok_predicate": _W + " SELECT doc_id, len(list_filter(t, lambda x: length(x) >= 8))::INT AS n_long FROM arr",
    "tok_max_length": _W + " SELECT doc_id, len(t)::INT AS n_tokens FROM arr",
    "tf_df": _STATS + " SELECT * FROM st",
    "tfidf": _TFIDF + " SELECT term, tfidf FROM w",
    "tfidf_rank": _TFIDF + " SELECT term, type_id, rank FROM rk",
    "keep_topn": _TFIDF + " SELECT term, type_id, tfidf FROM rk WHERE rank <= 200",
    "keep_topn_corpus": _TFIDF + " SELECT doc_id, count(*) AS n_tokens FROM tok WHERE term IN (SELECT term FROM rk WHERE rank <= 200) GROUP BY 1",
    "pruned_words": _TFIDF + " SELECT term FROM rk WHERE rank > 200",
    "prune_rare": _STATS + " SELECT * FROM st WHERE tf >= 5",
    "vocabulary": _IDS + " SELECT type_id, term FROM ids",
    "doc_lengths": "SELECT doc_id, coalesce(len(" + _tok_sql(_LM) + "), 0) AS n_tokens FROM documents",
    "corpus_arrays": _IDS + ", ar AS (SELECT doc_id, list(type_id ORDER BY pos) AS a FROM tok JOIN ids USING (term) GROUP BY 1) SELECT doc_id, array_to_string(a, ' ') AS types, len(a) || ' ' || array_to_string(list_transform(a, lambda x: x || ':1'), ' ') AS svmlight FROM ar",
    "postings": _W + " SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2",
    "corpus_totals": _STATS + " SELECT (SELECT count(*) FROM documents) AS n_docs, sum(tf)::BIGINT AS n_tokens, count(*) AS n_types, round(sum(tf) / (SELECT count(*) FROM documents), 6) AS avg_doc_len FROM st",
    "type_cumsum": _CUM + " SELECT * FROM cm",
    "topic_mass_report": _CUM + " SELECT rank, mass FROM cm WHERE rank % 50 = 0",
    "rare_sweep": _STATS + " SELECT x::INT AS threshold, count(*) FILTER (tf >= x) AS vocabulary, coalesce(sum(tf) FILTER (tf >= x), 0)::BIGINT AS corpus_tokens FROM st, (SELECT unnest([0, 10, 100, 200, 500, 1000, 2000]) AS x) GROUP BY x",
    "cooc_adjacent": _COOC + " SELECT * FROM co",
    "cooc_symmetric": _COOC + " SELECT least(w1, w2) AS w1, greatest(w1, w2) AS w2, sum(n)::BIGINT AS n FROM co GROUP BY 1, 2",
    "cooc_norm": _COOC + ", st AS (SELECT term, count(*) AS tf FROM tok GROUP BY 1), bo AS (SELECT w1, w2 FROM co UNION SELECT w2, w1 FROM co) SELECT bo.w1, bo.w2, round(coalesce(a.n, b.n) / tf, 9) AS score FROM bo LEFT JOIN co a ON a.w1 = bo.w1 AND a.w2 = bo.w2 LEFT JOIN co b ON b.w1 = bo.w2 AND b.w2 = bo.w1 JOIN st ON st.term = bo.w1",
    "common_words": _W + " SELECT a.doc_id, array_to_string(list_sort(list_distinct(list_intersect(a.t, b.t))), ' ') AS words FROM arr a JOIN arr b ON b.doc_id = a.doc_id + 1",
    "vec_frequency": _W + ", c AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY 1, 2) SELECT doc_id, string_agg(term || ':' || n, ' ' ORDER BY term) AS vector FROM c GROUP BY 1",
    "vec_occurrence": _W + " SELECT DISTINCT doc_id, term, 1 AS value FROM tok",
    "vec_tfidf": _TFIDF + " SELECT DISTINCT doc_id, term, tfidf AS value FROM tok JOIN w USING (term)",
    "sort_indices": "SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(theta, lambda x, i: {'v': -x, 'i': i - 1})), lambda p: p.i), ' ') AS indices FROM doc_topics WHERE theta IS NOT NULL",
}
