"""Queries of topic tables, diagnostics, classification, splits and batches, over ``topic_assign`` and ``documents``.

The state is the cleaned ``topic_assign`` table (100 topics, alpha and beta 0.01).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import classify as C
from quillmark.operators import diagnostics as G
from quillmark.operators import topics as K
from quillmark.queries import text as TQ
from quillmark.queries.base import table

TOPICS, ALPHA, BETA, TOP = 100, 0.01, 0.01, 10


def _assign(s: SparkSession, d: str) -> DataFrame:
    return K.current_assignment(table(s, d, "topic_assign"))


def _ttc(s: SparkSession, d: str) -> DataFrame:
    return K.type_topic_counts(_assign(s, d))


def _dtc(s: SparkSession, d: str) -> DataFrame:
    return K.doc_topic_counts(_assign(s, d))


def _vocab(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vocab")


def _top(s: SparkSession, d: str) -> DataFrame:
    return K.top_words(_ttc(s, d), TOP)


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scores(score):
    def q(s: SparkSession, d: str) -> DataFrame:
        p = K.probabilities(_ttc(s, d), TOPICS, BETA)
        return K.top_by(p, score(), TOP).select("topic", "rank", "type_id", F.round("score", 6).alias("score"))

    return q


def theta(s: SparkSession, d: str) -> DataFrame:
    return _round(K.theta(_dtc(s, d), TOPICS, ALPHA), 9)


def probabilities(s: SparkSession, d: str) -> DataFrame:
    return _round(K.probabilities(_ttc(s, d), TOPICS, BETA), 9)


def topic_lines(s: SparkSession, d: str) -> DataFrame:
    return K.topic_lines(_top(s, d), _vocab(s, d))


def log_likelihood(s: SparkSession, d: str) -> DataFrame:
    return _round(K.log_likelihood(_assign(s, d), TOPICS, ALPHA, BETA), 2)


def count_delta(s: SparkSession, d: str) -> DataFrame:
    """Against the counts of the deterministic start of the same tokens."""
    a = _assign(s, d)
    before = K.type_topic_counts(a.withColumn("topic", ((F.col("doc_id") * 7 + F.col("pos") * 13) % TOPICS).cast("int")))
    return K.count_delta(before, K.type_topic_counts(a))


def hash_init(s: SparkSession, d: str) -> DataFrame:
    """L20."""
    return K.hash_assignment(TQ._tokens(s, d), 10).groupBy("topic").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("term").alias("terms"))


def type_topic_matrix(s: SparkSession, d: str) -> DataFrame:
    """The whole matrix, one column for each topic."""
    return _ttc(s, d).groupBy("type_id").pivot("topic", list(range(TOPICS))).agg(F.sum("n")).na.fill(0).select("type_id", *[F.col(str(i)).cast("long").alias(f"t{i}") for i in range(TOPICS)])


def theta_join_phi(s: SparkSession, d: str) -> DataFrame:
    """p(w|theta) of every token's type in its document, from unsmoothed estimates."""
    ttc, dtc = _ttc(s, d), _dtc(s, d)
    pw = ttc.join(K.tokens_per_topic(ttc), "topic").select("topic", "type_id", (F.col("n") / F.col("tokens")).alias("p"))
    total = dtc.groupBy("doc_id").agg(F.sum("n").alias("total"))
    th = dtc.join(total, "doc_id").select("doc_id", "topic", (F.col("n") / F.col("total")).alias("t"))
    seen = _assign(s, d).select("doc_id", "type_id").distinct()
    x = seen.join(th, "doc_id").join(pw, ["topic", "type_id"]).groupBy("doc_id", "type_id").agg(F.sum(F.col("t") * F.col("p")).alias("p"))
    return _round(x, 9)


def coherence(s: SparkSession, d: str) -> DataFrame:
    a, top = _assign(s, d), _top(s, d)
    return _round(G.coherence(G.codocuments(a, top), top, BETA))


def token_doc_diff(s: SparkSession, d: str) -> DataFrame:
    a, top = _assign(s, d), _top(s, d)
    return _round(G.token_doc_diff(top, G.codocuments(a, top)))


def word_length(s: SparkSession, d: str) -> DataFrame:
    return _round(G.word_length(_top(s, d), _vocab(s, d)))


def all_diagnostics(s: SparkSession, d: str) -> DataFrame:
    return _round(G.all_diagnostics(_assign(s, d), _vocab(s, d), TOPICS, ALPHA, BETA, TOP))


def empty_topics(s: SparkSession, d: str) -> DataFrame:
    return G.empty_topics(_ttc(s, d), 120)


def topic_priors(s: SparkSession, d: str) -> DataFrame:
    """Words anchored to a topic: the first three of each label's name parts, as a stated list."""
    priors = s.createDataFrame([(0, "harbour"), (0, "keel"), (1, "kernel"), (1, "compiler"), (2, "orbit"), (2, "harbour"), (3, "notaword")], "topic int, term string")
    return K.zero_out_words(priors, _vocab(s, d), 5)


def _labelled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    z = K.theta(_dtc(s, d), TOPICS, ALPHA).select("doc_id", "topic", "zbar")
    labels = table(s, d, "docs").select("doc_id", F.lower(F.trim("label")).alias("label")).where("label IS NOT NULL")
    return z, labels


def centroids(s: SparkSession, d: str) -> DataFrame:
    return _round(C.centroids(*_labelled(s, d), ALPHA), 9)


def _predictions(s: SparkSession, d: str) -> DataFrame:
    z, labels = _labelled(s, d)
    test = C.simple_fold("doc_id", 5) == 0
    centre = C.centroids(z.where(~test), labels, ALPHA)
    return C.classify(z.where(test), centre, ALPHA).join(labels, "doc_id").select("doc_id", F.col("label").alias("truth"), "predicted", "score")


def kl_classifier(s: SparkSession, d: str) -> DataFrame:
    return _round(_predictions(s, d))


def confusion(s: SparkSession, d: str) -> DataFrame:
    return C.confusion(_predictions(s, d)).select("truth", "predicted", "n", F.col("level").cast("long").alias("level"))


def accuracy(s: SparkSession, d: str) -> DataFrame:
    return _round(C.accuracy(_predictions(s, d)), 9)


def _ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id").where("doc_id % 7 = 3")


def split_semi(s: SparkSession, d: str) -> DataFrame:
    return C.split_by_ids(table(s, d, "documents").select("doc_id", "source"), _ids(s, d))[1]


def split_anti(s: SparkSession, d: str) -> DataFrame:
    return C.split_by_ids(table(s, d, "documents").select("doc_id", "source"), _ids(s, d))[0]


def perplexity_split(s: SparkSession, d: str) -> DataFrame:
    p = C.perplexity_split(TQ._tokens(s, d), _ids(s, d))
    return p.groupBy("part", "doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum("pos").alias("positions"))


def fold_sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy(C.simple_fold("doc_id", 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


def batch_even(s: SparkSession, d: str) -> DataFrame:
    return C.even_batches(table(s, d, "documents"), 4)


def batch_percentage(s: SparkSession, d: str) -> DataFrame:
    return C.percentage_batch(table(s, d, "documents"), 0.2, 7)


def batch_fixed(s: SparkSession, d: str) -> DataFrame:
    return C.fixed_batch(table(s, d, "documents"), [0.1, 0.5, 0.25], 4)


_A = """WITH assign AS (SELECT doc_id, pos, type_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY sampled_at DESC, topic DESC, type_id DESC) AS r FROM topic_assign WHERE topic IS NOT NULL) WHERE r = 1),
ttc AS (SELECT type_id, topic, count(*) AS n FROM assign GROUP BY 1, 2), dtc AS (SELECT doc_id, topic, count(*) AS n FROM assign GROUP BY 1, 2),
tp AS (SELECT topic, sum(n)::BIGINT AS tokens FROM ttc GROUP BY 1), dl AS (SELECT doc_id, sum(n) AS dn FROM dtc GROUP BY 1), ks AS (SELECT unnest(range(100))::INT AS topic),
top AS (SELECT * FROM (SELECT topic, type_id, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, type_id DESC)::INT AS rank FROM ttc) WHERE rank <= 10)"""
_P = _A + """, vs AS (SELECT type_id, sum(n) AS nw FROM ttc GROUP BY 1), su AS (SELECT sum(n) AS sn, count(DISTINCT type_id) AS vn FROM ttc),
pr AS (SELECT type_id, topic, coalesce(n, 0) AS n, (coalesce(n, 0) + 0.01::DOUBLE) / (coalesce(tokens, 0) + vn * 0.01::DOUBLE) AS p_w_k, (nw + 1::DOUBLE) / (sn + vn * 1::DOUBLE) AS p_w, coalesce(tokens, 0) / sn AS p_k,
 (coalesce(n, 0) + 0.01::DOUBLE) / (nw + 1::DOUBLE) AS p_k_w, CASE WHEN coalesce(tokens, 0) = 0 THEN 0 ELSE coalesce(n, 0) / tokens END AS u_w_k, nw / sn AS u_w
 FROM vs CROSS JOIN ks LEFT JOIN ttc USING (type_id, topic) LEFT JOIN tp USING (topic) CROSS JOIN su)"""


def _ranked(expr: str) -> str:
    return _P + f", sc AS (SELECT topic, type_id, round({expr}, 12) AS s FROM pr), rk AS (SELECT topic, type_id, s, row_number() OVER (PARTITION BY topic ORDER BY s DESC, type_id DESC)::INT AS rank FROM sc) SELECT topic, rank, type_id, round(s, 6) AS score FROM rk WHERE rank <= 10"


_DIST = "CASE WHEN p_k = 0 THEN 0 ELSE p_k_w * ln(p_k_w / p_k) END"
_CO = _A + ", seen AS (SELECT DISTINCT doc_id, topic, rank FROM assign JOIN top USING (topic, type_id)), co AS (SELECT a.topic, a.rank AS r1, b.rank AS r2, count(*) AS docs FROM seen a JOIN seen b ON a.doc_id = b.doc_id AND a.topic = b.topic AND b.rank <= a.rank GROUP BY 1, 2, 3)"
_PP = _A + ", pp AS (SELECT topic, type_id, n, n / sum(n) OVER (PARTITION BY topic) AS p FROM ttc)"
_LEN = _A + ", wl AS (SELECT topic, length(term) AS l FROM top JOIN vocab USING (type_id)), al AS (SELECT avg(l) AS m, stddev_samp(l) AS sd FROM wl)"
_ENT = "SELECT topic, -sum(n * ln(n)) / sum(n) + ln(sum(n)) AS document_entropy FROM dtc GROUP BY 1"
_COH = "SELECT a.topic, sum(ln((coalesce(c.docs, 0) + 0.01::DOUBLE) / (coalesce(e.docs, 0) + 0.01::DOUBLE))) AS coherence FROM top a JOIN top b ON a.topic = b.topic AND b.rank < a.rank LEFT JOIN co c ON c.topic = a.topic AND c.r1 = a.rank AND c.r2 = b.rank LEFT JOIN co e ON e.topic = a.topic AND e.r1 = b.rank AND e.r2 = b.rank GROUP BY 1"
_ZB = _A + ", z AS (SELECT doc_id, topic, coalesce(n, 0) / dn AS zbar, (coalesce(n, 0) + 0.01::DOUBLE) / (dn + 1::DOUBLE) AS theta FROM dl CROSS JOIN ks LEFT JOIN dtc USING (doc_id, topic)), lb AS (SELECT doc_id, lower(trim(label, ' ')) AS label FROM docs WHERE label IS NOT NULL)"
_CE = ", raw AS (SELECT label, topic, (sum(zbar) + 0.01::DOUBLE) / count(*) AS c FROM z JOIN lb USING (doc_id) {0} GROUP BY 1, 2), ce AS (SELECT label, topic, c / sum(c) OVER (PARTITION BY label) AS p FROM raw)"
_FOLD = "((doc_id * 2654435761) % 4294967296) % 5"
_PRED = _ZB + _CE.format(f"WHERE {_FOLD} <> 0") + f", q AS (SELECT doc_id, topic, (zbar + 0.01::DOUBLE) / sum(zbar + 0.01::DOUBLE) OVER (PARTITION BY doc_id) AS q FROM z WHERE {_FOLD} = 0), di AS (SELECT doc_id, label, round(sum((p * ln(p / q) + q * ln(q / p)) / (2 * ln(2))), 12) AS d FROM q JOIN ce USING (topic) GROUP BY 1, 2), be AS (SELECT doc_id, arg_min(label, {{'d': d, 'l': label}}) AS predicted, 1 / greatest(min(d), 1e-12) AS score FROM di GROUP BY 1), pred AS (SELECT doc_id, label AS truth, predicted, score FROM be JOIN lb USING (doc_id))"

QUERIES = {
    "theta": theta, "topic_probabilities": probabilities, "top_words": _top, "relevance": _scores(K.relevance), "distinctive": _scores(K.distinctiveness), "salient": _scores(K.saliency), "k1_reweighted": _scores(K.reweighted),
    "topic_lines": topic_lines, "log_likelihood": log_likelihood, "count_delta": count_delta, "hash_init": hash_init, "type_topic_counts": _ttc, "doc_topic_counts": _dtc, "type_topic_matrix": type_topic_matrix, "word_given_theta": theta_join_phi,
    "topic_order": lambda s, d: K.reorder_topics(_ttc(s, d)), "phi_density": lambda s, d: _round(K.density(_ttc(s, d), TOPICS), 9), "doc_density": lambda s, d: _round(K.doc_density(_dtc(s, d), TOPICS), 9),
    "batch_top_types": lambda s, d: K.frequent_types(_ttc(s, d), 0.1), "systematic_sample": lambda s, d: K.systematic_types(_ttc(s, d), 50, 17), "topic_tokens": lambda s, d: G.topic_tokens(_ttc(s, d)),
    "doc_entropy": lambda s, d: _round(G.document_entropy(_dtc(s, d))), "word_length": word_length, "coherence": coherence, "uniform_dist": lambda s, d: _round(G.uniform_distance(_ttc(s, d))), "corpus_dist": lambda s, d: _round(G.corpus_distance(_ttc(s, d))),
    "eff_num_words": lambda s, d: _round(G.effective_words(_ttc(s, d))), "token_doc_diff": token_doc_diff, "rank_1_docs": lambda s, d: _round(G.rank1(_dtc(s, d))), "allocation": lambda s, d: _round(G.allocation(_dtc(s, d), TOPICS, ALPHA)),
    "hdp_rev_cumsum": lambda s, d: G.reverse_cumulative(_dtc(s, d)), "hdp_percentile_k": lambda s, d: G.k_at_percentile(_ttc(s, d)), "hdp_empty_topics": empty_topics, "allocation_cdf": lambda s, d: _round(G.allocation_cdf(_ttc(s, d)), 9),
    "all_diagnostics": all_diagnostics, "topic_priors": topic_priors, "centroids": centroids, "kl_classifier": kl_classifier, "confusion_cube": confusion, "accuracy": accuracy, "split_semi": split_semi, "split_anti": split_anti,
    "perplexity_split": perplexity_split, "fold_sizes": fold_sizes, "batch_even": batch_even, "batch_percentage": batch_percentage, "batch_fixed": batch_fixed,
}

SQL = {
    "theta": _ZB + " SELECT doc_id, topic, round(zbar, 9) AS zbar, round(theta, 9) AS theta FROM z",
    "topic_probabilities": _P + " SELECT type_id, topic, n, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("p_w_k", "p_w", "p_k", "p_k_w", "u_w_k", "u_w")) + " FROM pr",
    "top_words": _A + " SELECT topic, rank, type_id, n FROM top",
    "relevance": _ranked("0.6 * ln(p_w_k) + 0.4 * (ln(p_w_k) - ln(p_w))"),
    "distinctive": _ranked(_DIST),
    "salient": _ranked(f"p_w * ({_DIST})"),
    "k1_reweighted": _ranked("p_w_k / sum(p_w_k) OVER (PARTITION BY type_id)"),
    "topic_lines": _A + " SELECT topic, 'Topic ' || (topic + 1) || ': ' || string_agg(term, ', ' ORDER BY rank) AS line FROM top JOIN vocab USING (type_id) GROUP BY topic",
    "log_likelihood": _A + ", v AS (SELECT count(DISTINCT type_id) * 0.01::DOUBLE AS vb FROM ttc) SELECT round((SELECT sum(lgamma(n + 0.01::DOUBLE) - lgamma(0.01::DOUBLE)) FROM dtc) - (SELECT sum(lgamma(dn + 1.0::DOUBLE)) FROM dl) + (SELECT count(*) * lgamma(1.0::DOUBLE) FROM dl) + (SELECT sum(lgamma(n + 0.01::DOUBLE) - lgamma(0.01::DOUBLE)) FROM ttc) - (SELECT sum(lgamma(vb + coalesce(tokens, 0))) FROM ks LEFT JOIN tp USING (topic), v) + 100 * (SELECT lgamma(vb) FROM v), 2) AS log_likelihood",
    "count_delta": _A + ", b AS (SELECT ((doc_id * 7 + pos * 13) % 100)::INT AS topic, type_id, -count(*) AS n FROM assign GROUP BY 1, 2) SELECT topic, type_id, sum(n)::BIGINT AS delta FROM (SELECT topic, type_id, n FROM b UNION ALL SELECT topic, type_id, n FROM ttc) GROUP BY 1, 2 HAVING sum(n) <> 0",
    "hash_init": TQ.with_tokens() + " SELECT ((doc_id * 7 + pos * 13 + length(term) * 31) % 10)::INT AS topic, count(*) AS tokens, count(DISTINCT term) AS terms FROM tok GROUP BY 1",
    "type_topic_counts": _A + " SELECT * FROM ttc",
    "doc_topic_counts": _A + " SELECT * FROM dtc",
    "type_topic_matrix": _A + " SELECT type_id, " + ", ".join(f"coalesce(sum(n) FILTER (topic = {i}), 0)::BIGINT AS t{i}" for i in range(TOPICS)) + " FROM ttc GROUP BY 1",
    "word_given_theta": _A + " SELECT s.doc_id, s.type_id, round(sum(d.n / dn * t.n / tokens), 9) AS p FROM (SELECT DISTINCT doc_id, type_id FROM assign) s JOIN dtc d USING (doc_id) JOIN dl USING (doc_id) JOIN ttc t ON t.topic = d.topic AND t.type_id = s.type_id JOIN tp ON tp.topic = d.topic GROUP BY 1, 2",
    "topic_order": _A + " SELECT topic, (row_number() OVER (ORDER BY tokens DESC, topic) - 1)::INT AS new_topic FROM tp",
    "phi_density": _A + ", x AS (SELECT count(*) / (count(DISTINCT type_id) * 100) AS d FROM ttc) SELECT round(d, 9) AS type_topic_density, round(1 - d, 9) AS phi_zeros FROM x",
    "doc_density": _A + " SELECT round(avg(d), 9) AS doc_density FROM (SELECT count(*) / 100 AS d FROM dtc GROUP BY doc_id)",
    "batch_top_types": _A + ", x AS (SELECT type_id, sum(n)::BIGINT AS n FROM ttc GROUP BY 1), y AS (SELECT type_id, n, row_number() OVER (ORDER BY n DESC, type_id)::INT AS rank, ceil(count(*) OVER () * 0.1::DOUBLE) AS l FROM x) SELECT type_id, n, rank FROM y WHERE rank <= l",
    "systematic_sample": _A + ", x AS (SELECT type_id, sum(n)::BIGINT AS n FROM ttc GROUP BY 1), y AS (SELECT *, sum(n) OVER (ORDER BY type_id ROWS UNBOUNDED PRECEDING) AS c FROM x) SELECT type_id, n FROM y WHERE floor((c - 17) / 50) > floor((c - n - 17) / 50)",
    "topic_tokens": _A + " SELECT topic, tokens FROM tp",
    "doc_entropy": _A + f" SELECT topic, round(document_entropy, 6) AS document_entropy FROM ({_ENT})",
    "word_length": _LEN + " SELECT topic, round(avg(l), 6) AS word_length, round(sum((l - m) / sd), 6) AS word_length_sd FROM wl, al GROUP BY 1",
    "coherence": _CO + f" SELECT topic, round(coherence, 6) AS coherence FROM ({_COH})",
    "uniform_dist": _PP + " SELECT topic, round(sum(p * ln(p * (SELECT count(DISTINCT type_id) FROM ttc))), 6) AS uniform_dist FROM pp GROUP BY 1",
    "corpus_dist": _PP + ", pc AS (SELECT type_id, sum(n) / (SELECT sum(n) FROM ttc) AS pc FROM ttc GROUP BY 1) SELECT topic, round(sum(p * ln(p / pc)), 6) AS corpus_dist FROM pp JOIN pc USING (type_id) GROUP BY 1",
    "eff_num_words": _PP + " SELECT topic, round(1 / sum(p * p), 6) AS eff_num_words FROM pp GROUP BY 1",
    "token_doc_diff": _CO + ", x AS (SELECT top.topic, n / sum(n) OVER w AS p, coalesce(docs, 0) / sum(coalesce(docs, 0)) OVER w AS q FROM top LEFT JOIN co ON co.topic = top.topic AND r1 = rank AND r2 = rank WINDOW w AS (PARTITION BY top.topic)) SELECT topic, round(sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 6) AS token_doc_diff FROM x GROUP BY 1",
    "rank_1_docs": _A + ", b AS (SELECT topic, count(*) AS f FROM (SELECT topic, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, topic) AS r FROM dtc) WHERE r = 1 GROUP BY 1) SELECT topic, round(coalesce(max(f), 0) / count(*), 6) AS rank_1_docs FROM dtc LEFT JOIN b USING (topic) GROUP BY 1",
    "allocation": _A + ", x AS (SELECT topic, (n + 0.01::DOUBLE) / (N + 1::DOUBLE) AS s FROM (SELECT topic, n, sum(n) OVER (PARTITION BY doc_id) AS N FROM dtc)) SELECT topic, CASE WHEN count(*) FILTER (s >= 0.02) > 0 THEN round(count(*) FILTER (s >= 0.5) / count(*) FILTER (s >= 0.02), 6) END AS allocation_ratio, round(count(*) FILTER (s >= 0.3) / count(*), 6) AS allocation_count FROM x GROUP BY 1".replace("n, sum(n) OVER (PARTITION BY doc_id) AS N", "n AS n, sum(n) OVER (PARTITION BY doc_id) AS dn").replace("(N + 1::DOUBLE)", "(dn + 1::DOUBLE)"),
    "hdp_rev_cumsum": _A + ", m AS (SELECT topic, unnest(range(1, max(n) + 1)) AS at_least FROM dtc GROUP BY 1) SELECT m.topic, at_least, count(*) AS docs FROM m JOIN dtc ON dtc.topic = m.topic AND dtc.n >= at_least GROUP BY 1, 2",
    "hdp_percentile_k": _A + ", c AS (SELECT row_number() OVER w - 1 AS i, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) / sum(tokens) OVER () AS s FROM tp WINDOW w AS (ORDER BY tokens DESC, topic)) SELECT coalesce(min(i) FILTER (s > 0.8), count(*)) AS k FROM c",
    "hdp_empty_topics": _A + " SELECT x::INT AS topic FROM (SELECT unnest(range(120)) AS x) WHERE x NOT IN (SELECT topic FROM tp)",
    "allocation_cdf": _A + " SELECT topic, tokens, round(tokens / sum(tokens) OVER (), 9) AS percent, round(sum(tokens) OVER (ORDER BY topic ROWS UNBOUNDED PRECEDING) / sum(tokens) OVER (), 9) AS cdf FROM tp",
    "topic_priors": "WITH p AS (SELECT * FROM (VALUES (0, 'harbour'), (0, 'keel'), (1, 'kernel'), (1, 'compiler'), (2, 'orbit'), (2, 'harbour'), (3, 'notaword')) t(topic, term)), n AS (SELECT DISTINCT type_id, topic FROM p JOIN vocab USING (term)) SELECT k::INT AS topic, type_id FROM (SELECT DISTINCT type_id FROM n), (SELECT unnest(range(5)) AS k) WHERE (type_id, k) NOT IN (SELECT (type_id, topic) FROM n)",
    "centroids": _ZB + _CE.format("") + " SELECT label, topic, round(p, 9) AS p FROM ce",
    "kl_classifier": _PRED + " SELECT doc_id, truth, predicted, round(score, 6) AS score FROM pred",
    "confusion_cube": _PRED + " SELECT truth, predicted, count(*) AS n, grouping(truth, predicted) AS level FROM pred GROUP BY CUBE (truth, predicted)",
    "accuracy": _PRED + " SELECT count(*) AS n, round(avg((truth = predicted)::INT), 9) AS accuracy FROM pred",
    "split_semi": "SELECT doc_id, source FROM documents WHERE doc_id % 7 = 3",
    "split_anti": "SELECT doc_id, source FROM documents WHERE doc_id % 7 <> 3",
    "perplexity_split": TQ.with_tokens() + ", x AS (SELECT *, CASE WHEN doc_id % 7 = 3 AND row_number() OVER (PARTITION BY doc_id ORDER BY (pos * 31 + doc_id * 17) % 1009, pos) <= floor(count(*) OVER (PARTITION BY doc_id) / 2) THEN 'test' ELSE 'train' END AS part FROM tok) SELECT part, doc_id, count(*) AS tokens, sum(pos)::BIGINT AS positions FROM x GROUP BY 1, 2",
    "fold_sizes": f"SELECT ({_FOLD})::INT AS fold, count(*) AS n FROM documents GROUP BY 1",
    "batch_even": "SELECT doc_id, ntile(4) OVER (ORDER BY doc_id)::INT AS batch FROM documents",
    "batch_percentage": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= ceil(0.2::DOUBLE * n)",
    "batch_fixed": "WITH n AS (SELECT count(*) AS n FROM documents), st AS (SELECT n, 1 + floor(0.1 * n) + floor(0.5 * n) + floor(0.25 * n) + floor(0.1 * n) AS s, floor(0.5 * n) AS z FROM n), x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id FROM x, st WHERE (i - s + 4 * n) % n < z",
}
_PARTS = ("doc_entropy", "word_length", "coherence", "uniform_dist", "corpus_dist", "eff_num_words", "token_doc_diff", "rank_1_docs", "allocation")
SQL["all_diagnostics"] = f"SELECT * FROM ({SQL['topic_tokens']}) " + " ".join(f"LEFT JOIN ({SQL[x]}) USING (topic)" for x in _PARTS)
