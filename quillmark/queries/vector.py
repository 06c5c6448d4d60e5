"""Queries of distances and similarity search.

Queries are all rows whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import distances as D
from quillmark.operators import search, vocab
from quillmark.queries import text as TQ
from quillmark.queries.base import table

_PROBABILITY = ("continuous_jaccard", "hellinger", "kl", "symmetric_kl", "jensen_shannon", "uber", "canberra")


def _vectors(s: SparkSession, d: str, positive: bool) -> DataFrame:
    v = table(s, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    if not positive:
        return v
    w = F.transform("vec", lambda x: F.when(x > 0, x).otherwise(0.0) + 0.001)
    return v.select("id", w.alias("w")).select("id", F.transform("w", lambda x: x / D.total(F.col("w"))).alias("vec"))


def _distance(name: str):
    def q(s: SparkSession, d: str) -> DataFrame:
        v = _vectors(s, d, name in _PROBABILITY)
        return search.distance_to_all(v.where("id % 50 = 0"), v, name).select("q", "id", F.round("d", 6).alias("d"))

    return q


def moments(s: SparkSession, d: str) -> DataFrame:
    """F12."""
    v = _vectors(s, d, False)
    c = F.col("vec")
    return v.select("id", F.round(D.mean(c), 9).alias("mean"), F.round(D.variance(c), 9).alias("variance"), F.round(D.std(c), 9).alias("sd"))


def intervals(s: SparkSession, d: str) -> DataFrame:
    """F8."""
    v = _vectors(s, d, False)
    return v.select("id", F.size(F.filter("vec", lambda x: D.in_intervals(x, [-2.0, -1.0, 1.0, 2.0]))).alias("inside"))


def nearest_neighbour(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d, False)
    return search.nearest_neighbour(v.where("id % 50 = 0"), v, "euclidean").select("q", "nearest", F.round("d", 6).alias("d"))


def theta_nearest(s: SparkSession, d: str) -> DataFrame:
    """Q, nearest, d: the closest document by Jensen-Shannon distance of topic distributions; d is rounded first, so that ties go to the smaller id."""
    t = table(s, d, "doc_topics").where("theta IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("theta").alias("vec")).where(F.exists("vec", lambda x: x > 0))
    return search.nearest_by_jensen_shannon(t.where("id % 50 = 0"), t).select("q", F.col("id").alias("nearest"), "d")


def theta_nearest_kl(s: SparkSession, d: str) -> DataFrame:
    """Q, nearest, d: the closest document by KL of topic distributions; d is rounded first, so that ties go to the smaller id."""
    t = table(s, d, "doc_topics").where("theta IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("theta").alias("vec")).where(F.exists("vec", lambda x: x > 0))
    return search.nearest_by_kl(t.where("id % 50 = 0"), t).select("q", F.col("id").alias("nearest"), "d")


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tokens = TQ._tokens(s, d)
    postings = vocab.postings(tokens)
    lengths = vocab.doc_lengths(TQ._docs(s, d), tokens)
    q = vocab.postings(vocab.explode_tokens(table(s, d, "eval_items").select(F.col("item_id").alias("doc_id"), "text"))).select(F.col("doc_id").alias("q"), "term", F.col("tf").alias("qtf"))
    return q, postings, lengths


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    b = search.bm25(*_parts(s, d)).select("q", "id", F.round("score", 6).alias("d"))
    return search.top_k(b, 10, largest=True).select("q", "id", "rank", F.col("d").alias("score"))


def bm25_scores(s: SparkSession, d: str) -> DataFrame:
    return search.bm25(*_parts(s, d)).select("q", "id", F.round("score", 6).alias("score"))


def bm25_variant(s: SparkSession, d: str) -> DataFrame:
    return search.bm25_squared_idf(*_parts(s, d)).select("q", "id", F.round("score", 5).alias("score"))


def qlik_topk(s: SparkSession, d: str) -> DataFrame:
    r = search.query_likelihood(*_parts(s, d)).select("q", "id", F.round("d", 6).alias("d"))
    return search.top_k(r, 10)


def qlik_scores(s: SparkSession, d: str) -> DataFrame:
    return search.query_likelihood(*_parts(s, d)).select("q", "id", F.round("d", 6).alias("d"))


def ml_estimates(s: SparkSession, d: str) -> DataFrame:
    _, postings, lengths = _parts(s, d)
    return search.ml_estimates(postings, lengths).select("term", "doc_id", F.round("p_doc", 9).alias("p_doc"), F.round("p_corpus", 12).alias("p_corpus"))


def _list(expr: str) -> str:
    return f"list_sum([{expr} for i in range(1, len(a) + 1)])"


_E = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), "
_PLAIN = _E + "p AS (SELECT id, v FROM v), "
_PROB = _E + "x AS (SELECT id, [greatest(e, 0) + 0.001 for e in v] AS w FROM v), p AS (SELECT id, [e / list_sum(w) for e in w] AS v FROM x), "
_PAIR = "pr AS (SELECT x.id AS q, y.id AS id, x.v AS a, y.v AS b, list_sum(x.v) / len(x.v) AS ma, list_sum(y.v) / len(y.v) AS mb FROM p x JOIN p y ON x.id % 50 = 0), mo AS (SELECT *, list_sum([(e - ma) ^ 2 for e in a]) / len(a) AS va, list_sum([(e - mb) ^ 2 for e in b]) / len(b) AS vb FROM pr) "
_NORM = "sqrt(list_sum([e * e for e in {0}]))"
_COS = f"1 - {_list('a[i] * b[i]')} / ({_NORM.format('a')} * {_NORM.format('b')})"
_CAN = _list("CASE WHEN abs(a[i]) + abs(b[i]) = 0 THEN 0 ELSE abs(a[i] - b[i]) / (abs(a[i]) + abs(b[i])) END")
_KL = "list_sum([CASE WHEN {0}[i] = 0 THEN 0 ELSE {0}[i] * ln({0}[i] / ({1})) END for i in range(1, len(a) + 1)]) / ln(2)"
_CJ = f"1 - {_list('least(a[i], b[i])')} / {_list('greatest(a[i], b[i])')}"
_CHE = "list_max([abs(a[i] - b[i]) for i in range(1, len(a) + 1)])"
_EUC, _MAN = f"sqrt({_list('(a[i] - b[i]) ^ 2')})", _list("abs(a[i] - b[i])")
_COV = f"{_list('(a[i] - ma) * (b[i] - mb)')} / len(a)"
_FORMULAS = {
    "cosine": _COS, "euclidean": _EUC, "manhattan": _MAN, "chebyshev": _CHE, "canberra": _CAN,
    "jaccard": f"1 - {_list('CASE WHEN a[i] > 0 AND b[i] > 0 THEN 1.0 ELSE 0 END')} / {_list('CASE WHEN a[i] > 0 OR b[i] > 0 THEN 1.0 ELSE 0 END')}",
    "continuous_jaccard": _CJ, "hellinger": _list("(sqrt(a[i]) - sqrt(b[i])) ^ 2"),
    "bhattacharyya": "0.25 * ln(0.25 * (va / vb + 3)) + 0.25 * ((ma - mb) ^ 2 / (va + vb))",
    "kl": _KL.format("a", "b[i]"), "symmetric_kl": f"({_KL.format('a', 'b[i]')} + {_KL.format('b', 'a[i]')}) / 2",
    "jensen_shannon": f"({_KL.format('a', '(a[i] + b[i]) / 2')} + {_KL.format('b', '(a[i] + b[i]) / 2')}) / 2",
    "kolmogorov_smirnov": "list_max([abs(len([y for y in a if y <= e]) / len(a) - len([y for y in b if y <= e]) / len(b)) for e in list_concat(a, b)])",
    "statistical": f"1 - {_COV} / (sqrt(va) * sqrt(vb))", "student_t": "(ma - mb) / sqrt(va / (len(a) - 1) + vb / (len(b) - 1))",
    "uber": f"({_CAN} + {_CHE} + {_COS} + {_EUC} + {_CJ} + {_KL.format('a', 'b[i]')} + {_MAN}) / 7",
}

_LM = r"\p{L}\p{M}"
_SEARCH = TQ.with_tokens() + r""", qarr AS (SELECT item_id AS q, """ + TQ._tok_sql(_LM) + r""" AS t FROM eval_items WHERE text IS NOT NULL),
qt AS (SELECT q, term, count(*) AS qtf FROM (SELECT q, unnest(t) AS term FROM qarr) GROUP BY 1, 2),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT d.doc_id, coalesce(n, 0) AS n_tokens FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) USING (doc_id)),
tot AS (SELECT count(*) AS N, avg(n_tokens) AS avg_len, sum(n_tokens) AS C, (SELECT count(DISTINCT term) FROM post) AS V FROM len),
idf AS (SELECT term, ln(1 + ((SELECT N FROM tot) - count(*) + 0.5) / (count(*) + 0.5)) AS idf, sum(tf) / (SELECT C FROM tot) AS pc FROM post GROUP BY 1)"""
_BM = _SEARCH + ", bm AS (SELECT q, doc_id AS id, round(sum(POWER_idf * tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * n_tokens / (SELECT avg_len FROM tot))) * 9 * qtf / (8 + qtf)), DIGITS) AS score FROM post JOIN len USING (doc_id) JOIN idf USING (term) JOIN qt USING (term) GROUP BY 1, 2)"
_BM1, _BM2 = _BM.replace("POWER_idf", "idf").replace("DIGITS", "6"), _BM.replace("POWER_idf", "idf * idf").replace("DIGITS", "5")
_QL = _SEARCH + """, r AS (SELECT doc_id, n_tokens, n_tokens / (n_tokens + (SELECT V FROM tot)) AS r FROM len),
qw AS (SELECT DISTINCT q, term, pc FROM qt JOIN idf USING (term)),
ql AS (SELECT q, r.doc_id AS id, round(-sum(ln(r * coalesce(tf, 0) / greatest(n_tokens, 1) + (1 - r) * pc)), 6) AS d FROM qw CROSS JOIN r LEFT JOIN post ON post.term = qw.term AND post.doc_id = r.doc_id GROUP BY 1, 2)"""

QUERIES = {f"dist_{n}": _distance(n) for n in D.DISTANCES} | {
    "moments": moments, "intervals": intervals, "nearest_neighbour": nearest_neighbour, "theta_nearest": theta_nearest, "theta_nearest_kl": theta_nearest_kl, "bm25_topk": bm25_topk, "bm25_scores": bm25_scores, "bm25_variant": bm25_variant,
    "qlik_topk": qlik_topk, "qlik_scores": qlik_scores, "ml_estimates": ml_estimates,
}

SQL = {f"dist_{n}": (_PROB if n in _PROBABILITY else _PLAIN) + _PAIR + f"SELECT q, id, round({f}, 6) + 0.0 AS d FROM mo" for n, f in _FORMULAS.items()} | {
    "moments": _E + "m AS (SELECT id, v, list_sum(v) / len(v) AS m FROM v), s AS (SELECT id, m, list_sum([(e - m) ^ 2 for e in v]) / len(v) AS s FROM m) SELECT id, round(m, 9) AS mean, round(s, 9) AS variance, round(sqrt(s), 9) AS sd FROM s",
    "intervals": _E + "o AS (SELECT 1) SELECT id, len([e for e in v if (e BETWEEN -2 AND -1) OR (e BETWEEN 1 AND 2)])::INT AS inside FROM v",
    "nearest_neighbour": _PLAIN + _PAIR + f", di AS (SELECT q, id, {_EUC} AS d FROM mo WHERE q <> id) SELECT q, arg_min(id, {{'d': d, 'i': id}}) AS nearest, round(min(d), 6) AS d FROM di GROUP BY 1",
    "theta_nearest": "WITH p AS (SELECT doc_id AS id, theta AS v FROM doc_topics WHERE theta IS NOT NULL AND list_max(theta) > 0), " + _PAIR + f", di AS (SELECT q, id, round({_FORMULAS['jensen_shannon']}, 9) + 0.0 AS d FROM mo WHERE q <> id) SELECT q, arg_min(id, {{'d': d, 'i': id}}) AS nearest, min(d) AS d FROM di GROUP BY 1",
    "theta_nearest_kl": "WITH p AS (SELECT doc_id AS id, theta AS v FROM doc_topics WHERE theta IS NOT NULL AND list_max(theta) > 0), " + _PAIR + ", di AS (SELECT q, id, round(list_sum([CASE WHEN a[i] = 0 THEN 0 WHEN b[i] = 0 THEN 'inf'::DOUBLE ELSE a[i] * ln(a[i] / b[i]) END for i in range(1, len(a) + 1)]) / ln(2), 9) + 0.0 AS d FROM mo WHERE q <> id) SELECT q, arg_min(id, {'d': d, 'i': id}) AS nearest, min(d) AS d FROM di GROUP BY 1",
    "bm25_scores": _BM1 + " SELECT * FROM bm",
    "bm25_topk": _BM1 + " SELECT * FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INT AS rank, score FROM bm) WHERE rank <= 10",
    "bm25_variant": _BM2 + " SELECT * FROM bm",
    "qlik_scores": _QL + " SELECT * FROM ql",
    "qlik_topk": _QL + " SELECT * FROM (SELECT q, id, d, row_number() OVER (PARTITION BY q ORDER BY d, id)::INT AS rank FROM ql) WHERE rank <= 10",
    "ml_estimates": _SEARCH + " SELECT term, doc_id, round(tf / n_tokens, 9) AS p_doc, round(pc, 12) AS p_corpus FROM post JOIN len USING (doc_id) JOIN idf USING (term)",
}
