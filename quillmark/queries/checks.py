"""Queries of samplers, draws and scan policies whose rows SQL can repeat.

A sampler is random, its bookkeeping is not: with document priors that allow one topic for each
document every scheme must end with exactly these topics, whatever its sweeps draw; with one topic
the left-to-right estimate is a sum of logarithms; a scan policy visits a stated number of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.models import draws, lda, scan
from quillmark.operators import classify, search, vocab
from quillmark.operators import topics as K
from quillmark.operators.storage import materialize, remove_later, shared_folder
from quillmark.plans import config
from quillmark.queries import models as M
from quillmark.queries import text as TQ
from quillmark.queries import topic as PQ
from quillmark.queries.base import table
from quillmark.streaming import streams

TOPICS, ALPHA, BETA = 10, 0.1, 0.01


def _bound(s: SparkSession, d: str, scheme: str, sweeps: int = 2, **kw) -> tuple[lda.TopicModel, DataFrame]:
    """A model whose documents may each use topic ``doc_id % 10`` only; how many sweeps it makes can't change its topics."""
    docs, ids = M.corpus(s, d)
    allowed = docs.select("doc_id", F.array((F.col("doc_id") % TOPICS).cast("int")).alias("allowed"))
    m = lda.TopicModel(docs, ids.count(), lda.Settings(topics=TOPICS, alpha=ALPHA, beta=BETA, scheme=scheme, iterations=sweeps, **kw), doc_priors=allowed)
    return m.sample(), ids


def _bound_words(scheme: str):
    def q(s: SparkSession, d: str) -> DataFrame:
        m, ids = _bound(s, d, scheme)
        return K.top_words(K.type_topic_counts(m.assign()), 10).join(ids, "type_id").select("topic", "rank", "term", "n")

    return q


def bound_theta(s: SparkSession, d: str) -> DataFrame:
    """L28 of a trained model."""
    m, _ = _bound(s, d, "polyaurn")
    return m.theta().select("doc_id", F.posexplode("theta").alias("topic", "theta")).select("doc_id", "topic", F.round("theta", 9).alias("theta"))


def bound_likelihood(s: SparkSession, d: str) -> DataFrame:
    """The likelihood after each of three sweeps, the last one continued, seen by a callback."""
    seen: list[tuple[int, float]] = []
    note = lambda m: seen.append((m.iteration, m.log_likelihood()))
    m, _ = _bound(s, d, "uncollapsed", 0)
    m.sample(2, callback=note)
    m.sample(1, callback=note)
    return s.createDataFrame(seen, "iteration int, value double").select("iteration", F.round("value", 1).alias("value"))


def saved_model(s: SparkSession, d: str) -> DataFrame:
    """Tokens of each topic of a model that was saved, loaded with its document priors, and swept again."""
    m, _ = _bound(s, d, "uncollapsed", 1)
    folder = f"{shared_folder(s)}/quillmark/model-{uuid.uuid4().hex}"
    remove_later(s, folder)
    m.save(folder)
    return K.tokens_per_topic(K.type_topic_counts(lda.TopicModel.load(s, folder).sample(1).assign()))


def aborted_model(s: SparkSession, d: str) -> DataFrame:
    """An abort after the first sweep."""
    m, _ = _bound(s, d, "uncollapsed", 0)
    m.sample(5, callback=lambda x: x.abort())
    return s.createDataFrame([(m.iteration, m.aborted)], "iteration int, aborted boolean")


def _planted(s: SparkSession, d: str) -> tuple[lda.TopicModel, DataFrame]:
    """A model that takes over the topics of another one: (7 doc_id + 13 pos) mod 10."""
    docs, ids = M.corpus(s, d)
    m = lda.TopicModel(docs, ids.count(), lda.Settings(topics=TOPICS, alpha=ALPHA, beta=BETA, scheme="collapsed", burn_in=0.0))
    z = F.transform("types", lambda _, i: F.pmod(F.col("doc_id") * 7 + i * 13, F.lit(TOPICS)).cast("int"))
    m.set_assignments(docs.select("doc_id", z.alias("z")))
    return m, ids


def planted_counts(s: SparkSession, d: str) -> DataFrame:
    m, ids = _planted(s, d)
    return K.type_topic_counts(m.assign()).join(ids, "type_id").select("term", "topic", "n")


def reordered(s: SparkSession, d: str) -> DataFrame:
    """Tokens of each topic after topics are renumbered by falling tokens."""
    m, _ = _planted(s, d)
    m.reorder()
    return K.tokens_per_topic(K.type_topic_counts(m.assign()))


def collapsed_phi(s: SparkSession, d: str) -> DataFrame:
    """The phi of a collapsed sampler, (n + beta) / (n_k + V beta), averaged over identical states."""
    m, ids = _planted(s, d)
    m._phi_sum, m._phi_n = m.phi + m.phi, 2
    p = m.phi_mean()
    k, v = np.nonzero(np.ones_like(p))
    rows = s.createDataFrame(pd.DataFrame({"topic": k.astype("int32"), "type_id": v.astype("int32"), "p": p[k, v]}))
    return rows.join(ids, "type_id").select("topic", "term", F.round("p", 12).alias("p"))


def one_topic_held_out(s: SparkSession, d: str) -> DataFrame:
    """With one topic the estimate is the sum of ln phi, 100 particles or not."""
    docs, ids = M.corpus(s, d)
    m = lda.TopicModel(docs, ids.count(), lda.Settings(topics=1, alpha=ALPHA, beta=BETA, scheme="collapsed"))
    return lda.held_out(docs, m.phi, m.alpha).select("doc_id", F.round("log_probability", 3).alias("log_probability"))


def forced_theta(s: SparkSession, d: str) -> DataFrame:
    """Inference under a phi in which each word belongs to one topic, ``type_id % 10``."""
    docs, ids = M.corpus(s, d)
    n = ids.count()
    phi = np.zeros((TOPICS, n))
    phi[np.arange(n) % TOPICS, np.arange(n)] = 1.0
    got = lda.infer(docs, phi / np.maximum(phi.sum(1, keepdims=True), 1), np.full(TOPICS, ALPHA), 2)
    return got.select("doc_id", F.posexplode("theta").alias("topic", "theta")).select("doc_id", "topic", F.round("theta", 9).alias("theta"))


# scan policies ------------------------------------------------------------------------------------
def scan_documents(s: SparkSession, d: str) -> DataFrame:
    """B1 to B4, B12 in the sampler: documents visited in each of three sweeps, and tokens kept."""
    docs, ids = M.corpus(s, d)
    out = []
    for name in ("even_split", "percentage", "adaptive", "fixed_split"):
        c = config.Config(topics=TOPICS, batch_building_scheme=name, percentage_split_size_doc=0.25, fixed_split_size_doc=[0.125, 0.5], instability_period=1)
        m = lda.TopicModel(docs, ids.count(), lda.Settings(topics=TOPICS, alpha=ALPHA, scheme="uncollapsed", scan=scan.from_config(c, 5)))
        for i in range(1, 4):
            m.visited = None
            m.sample(1)
            out.append((name, i, docs.count() if m.visited is None else m.visited.count(), int(m.n.sum())))
    return s.createDataFrame(out, "policy string, iteration int, visited long, tokens long")


def scan_topics(s: SparkSession, d: str) -> DataFrame:
    """Contiguous parts, and how many topics a percentage takes."""
    rows = [(f"part {i}", int(x.min()), int(x.max()), len(x)) for i, x in enumerate(scan.even_topics(100, 7))]
    x = scan.percentage_topics(100, 0.255, 1, 3)
    return s.createDataFrame([*rows, ("percentage", 0, 99, len(set(x.tolist())))], "part string, low int, high int, n int")


def scan_types(s: SparkSession, d: str) -> DataFrame:
    """The types that each policy picks in an iteration, over the counts of the assignment table."""
    got = PQ._ttc(s, d).groupBy("type_id").agg(F.sum("n").alias("n")).orderBy("type_id").toPandas()
    n = got["n"].to_numpy()[None, :]
    moved = got["type_id"].to_numpy() % 3 == 0
    frequent, changed = scan.frequent_types(0.1), scan.changed_types(2, 10)
    picks = {
        ("frequent", 1): frequent(1, n, moved), ("changed", 3): changed(3, n, moved), ("changed", 1): changed(1, n, moved), ("changed", 20): changed(20, n, moved), ("all", 1): scan.all_types()(1, n, moved),
        ("meta", 4): scan.alternate(frequent, changed)(4, n, moved), ("meta", 5): scan.alternate(frequent, changed)(5, n, moved),
    }
    every = np.arange(len(got))
    rows = [(name, i, int(got["type_id"].iloc[j])) for (name, i), p in picks.items() for j in (every if p is None else p)]
    return s.createDataFrame(pd.DataFrame(rows, columns=["policy", "iteration", "type_id"])).select("policy", F.col("iteration").cast("int"), F.col("type_id").cast("int"))


def scan_bounds(s: SparkSession, d: str) -> DataFrame:
    """Sizes of random picks lie in their bounds, and a walk of one token's step takes every type."""
    got = PQ._ttc(s, d).groupBy("type_id").agg(F.sum("n").alias("n")).orderBy("type_id").toPandas()
    n = got["n"].to_numpy()[None, :]
    every = np.ones(n.shape[1], bool)
    share = [len(scan.beta_fraction_types(2, 5, 1)(i, n, every)) for i in (0, 100, 300)]
    walk = scan.systematic_types(1, 1)(1, n, every)
    return s.createDataFrame([("start", share[0] == n.shape[1]), ("less later", share[2] < share[0]), ("walk of one", len(walk) == n.shape[1])], "what string, holds boolean")


def batch_sizes(s: SparkSession, d: str) -> DataFrame:
    """Sizes of percentage and adaptive batches."""
    docs = table(s, d, "documents").select("doc_id")
    rows = [("percentage", 1, classify.percentage_batch(docs, 0.3, 1).distinct().count())] + [("adaptive", i, classify.adaptive_batch(docs, i, 2, 0.3, 1).distinct().count()) for i in range(1, 4)]
    return s.createDataFrame(rows, "policy string, iteration int, n long")


# draws --------------------------------------------------------------------------------------------
def _per_theta(s: SparkSession, d: str, f, schema: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(int(i), *f(int(i), np.asarray(t))) for i, t in zip(p["doc_id"], p["theta"])], columns=["doc_id", *[x.split()[0] for x in schema.split(", ")]])

    return table(s, d, "doc_topics").where("theta IS NOT NULL").select("doc_id", "theta").mapInPandas(run, f"doc_id long, {schema}")


def alias_probabilities(s: SparkSession, d: str) -> DataFrame:
    """What the alias tables of every topic distribution give to each topic; a row of zeros is uniform."""

    def one(_: int, t: np.ndarray) -> tuple:
        cut, alias = draws.alias_tables(t[None, :])
        p = cut[0].copy()
        np.add.at(p, alias[0], 1 - cut[0])
        return (p / len(t)).tolist(),

    got = _per_theta(s, d, one, "p array<double>")
    return got.select("doc_id", F.posexplode("p").alias("topic", "p")).select("doc_id", "topic", (F.round("p", 11) + 0.0).alias("p"))


def dirichlet_draws(s: SparkSession, d: str) -> DataFrame:
    """Every draw sums to one (or to zero where all weights are zero); zero weights stay out; what isn't redrawn keeps its value and what is its mass."""

    def one(i: int, t: np.ndarray) -> tuple:
        rng = np.random.default_rng(i)
        x = draws.dirichlet(rng, t[None, :])[0]
        half = np.arange(0, len(t), 2)
        c = draws.conditional_dirichlet(rng, t, np.ones(len(t)), half)
        made = [round(float(f(rng, t[None, :] * 50, 0.01).sum()), 9) for f in draws.PHI_DRAWS.values()]
        return round(float(x.sum()), 9), int((x[t == 0] > 0).sum()), round(float(c[half].sum()), 9), int((c[half + 1] != t[half + 1]).sum()), *made

    return _per_theta(s, d, one, "total double, outside int, mass double, moved int, by_dirichlet double, by_urn double, by_selection double")


def count_draws(s: SparkSession, d: str) -> DataFrame:
    """Binomials at chances of 0 and 1, multinomial totals, and how many different indices are drawn without replacement."""

    def one(i: int, t: np.ndarray) -> tuple:
        rng = np.random.default_rng(i)
        b = draws.binomials(rng, np.array([i, i]), np.array([0.0, 1.0]))
        return int(b[0]), int(b[1]), int(draws.multinomial(rng, i % 1000, np.ones(5)).sum()), len(set(draws.without_replacement(rng, 100, i % 90).tolist()))

    return _per_theta(s, d, one, "never long, always long, many long, different long")


def cumulative_search(s: SparkSession, d: str) -> DataFrame:
    """P10: the first topic whose cumulative weight passes 0.37 of the whole."""
    one = lambda i, t: (draws.search_cumulative(np.cumsum(t), 0.37) if t.any() else -1,)
    return _per_theta(s, d, one, "topic int")


def gamma_moments(s: SparkSession, d: str) -> DataFrame:
    """Means of a million gammas, betas and Poisson draws lie within five standard errors."""
    rng, n = np.random.default_rng(1), 1_000_000
    rows = [(f"gamma {a}", bool(abs(rng.standard_gamma(a, n).mean() - a) < 5 * np.sqrt(a / n))) for a in (0.1, 1.0, 30.0)]
    rows += [("beta", bool(abs(rng.beta(2, 5, n).mean() - 2 / 7) < 5e-3))]
    rows += [(f"poisson {a}", bool(abs(rng.poisson(a, n).mean() - a) < 5 * np.sqrt(a / n))) for a in (0.01, 3.0, 500.0)]
    u = draws.uniforms(3, np.arange(n))
    rows += [("uniform", bool(abs(u.mean() - 0.5) < 2e-3 and u.min() > 0 and u.max() < 1))]
    return s.createDataFrame(rows, "what string, holds boolean")


# search, classes, streams -------------------------------------------------------------------------
def _lda_state(docs: DataFrame, tokens: DataFrame) -> tuple:
    """Postings, lengths and the state (5 doc_id + 11 pos) mod 10 as phi and theta."""
    a = tokens.withColumn("topic", ((F.col("doc_id") * 5 + F.col("pos") * 11) % TOPICS).cast("int"))
    nk = a.groupBy("topic").agg(F.count(F.lit(1)).alias("nk"))
    phi = a.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n")).join(nk, "topic").select("topic", "term", (F.col("n") / F.col("nk")).alias("p"))
    lengths = vocab.doc_lengths(docs, tokens)
    theta = a.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("n")).join(lengths, "doc_id").select("doc_id", "topic", (F.col("n") / F.col("n_tokens")).alias("theta"))
    return vocab.postings(tokens), lengths, phi, theta


def _lda_parts(s: SparkSession, d: str) -> tuple:
    """Query words of ``documents`` with an id divisible by 500, and the state."""
    tokens = TQ._tokens(s, d)
    q = tokens.where("doc_id % 500 = 0").select(F.col("doc_id").alias("q"), "term").distinct()
    return q, *_lda_state(TQ._docs(s, d), tokens)


def lda_query_likelihood(s: SparkSession, d: str) -> DataFrame:
    """D19 (J7): ten best of each query by a stored state."""
    q, post, lengths, phi, theta = _lda_parts(s, d)
    r = search.lda_likelihood(q, post, lengths, phi, theta).select("q", "id", F.round("d", 6).alias("d"))
    return search.top_k(r, 10)


def lda_length_prior(s: SparkSession, d: str) -> DataFrame:
    """D21."""
    q, post, lengths, phi, theta = _lda_parts(s, d)
    r = search.lda_likelihood(q, post, lengths, phi, theta, length_prior=True, query_lengths=lengths.withColumnRenamed("doc_id", "q")).select("q", "id", F.round("d", 6).alias("d"))
    return search.top_k(r, 10)


def lda_backoff(s: SparkSession, d: str) -> DataFrame:
    """Absent words take the mean co-occurrence score with the document's words; every document that has words is a query."""
    docs = TQ._docs(s, d)
    lists = materialize(docs.select("doc_id", T.tokens("text").alias("t")), "tokens")
    tokens = vocab.explode_tokens(lists, text="t", tokenizer=F.col)
    post, lengths, phi, theta = _lda_state(docs, tokens)
    words = materialize(vocab.doc_words(lists), "words")
    scores = vocab.adjacent_scores(lists, tokens.groupBy("term").agg(F.count(F.lit(1)).alias("tf")), "t", F.col)
    q = words.where(F.size("terms") > 0).select(F.col("doc_id").alias("q"), "terms")
    r = search.lda_likelihood(q, post, lengths, phi, theta, backoff=scores, best=10, doc_words=words).select("q", "id", F.round("d", 6).alias("d"))
    return search.top_k(r, 10)


def lda_long_query(s: SparkSession, d: str) -> DataFrame:
    """Query likelihood of a long query plus KL of the query's topics and the document's."""
    q, post, lengths, _, theta = _lda_parts(s, d)
    r = search.long_query(q, post, lengths, theta, theta.where("doc_id % 500 = 0").withColumnRenamed("doc_id", "q"), TOPICS).select("q", "id", F.round("d", 6).alias("d"))
    return search.top_k(r, 10)


def by_corpus(s: SparkSession, d: str) -> DataFrame:
    """Three models that score by remainders, with ties."""
    docs = table(s, d, "documents").select("doc_id")
    score = lambda m: lambda x: x.select("doc_id", (F.col("doc_id") % m).cast("double").alias("score"))
    return classify.by_corpus({"seven": score(7), "five": score(5), "three": score(3)}, docs)


def fold_artefacts(s: SparkSession, d: str) -> DataFrame:
    """Training and test rows of each of five folds add up to all rows."""
    docs = table(s, d, "documents").select("doc_id")
    parts = classify.cross_validate(docs, 5, lambda x: x.count(), lambda n, x: x.agg(F.count(F.lit(1)).alias("t")).withColumn("n", F.col("t") + F.lit(n)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("n").agg(F.sum("t").cast("long").alias("tested"), F.count(F.lit(1)).alias("folds"))


def trained_distance(s: SparkSession, d: str) -> DataFrame:
    """State from the training rows (their mean), distances of query rows to it."""
    v = table(s, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"))
    fit = search.fit_transform(lambda t: t.agg(F.avg("x").alias("m")), lambda m, q: q.join(F.broadcast(m), F.lit(True)).select("id", F.round(F.abs(F.col("x") - F.col("m")), 6).alias("d")))
    return fit(v, v.where("id % 50 = 0"))


def running_terms(s: SparkSession, d: str) -> DataFrame:
    """Term frequencies of a stream that has delivered all documents."""
    name = f"terms_{uuid.uuid4().hex}"
    t = table(s, d, "documents").select("doc_id", "text")
    stream = s.readStream.schema(t.schema).parquet(f"{d}/documents.parquet" if "*" in d else f"{d}/documents.parquet*")
    q = streams.running_terms(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name)


QUERIES = {f"bound_{x}": _bound_words(x) for x in lda.SCHEMES} | {
    "bound_theta": bound_theta, "bound_likelihood": bound_likelihood, "saved_model": saved_model, "aborted_model": aborted_model, "planted_counts": planted_counts, "reordered_topics": reordered, "collapsed_phi": collapsed_phi,
    "one_topic_held_out": one_topic_held_out, "forced_theta": forced_theta, "scan_documents": scan_documents, "scan_topics": scan_topics, "scan_types": scan_types, "scan_bounds": scan_bounds, "batch_sizes": batch_sizes,
    "alias_probabilities": alias_probabilities, "dirichlet_draws": dirichlet_draws, "count_draws": count_draws, "cumulative_search": cumulative_search, "gamma_moments": gamma_moments, "lda_query_likelihood": lda_query_likelihood,
    "lda_length_prior": lda_length_prior, "lda_backoff": lda_backoff, "lda_long_query": lda_long_query, "by_corpus": by_corpus, "fold_artefacts": fold_artefacts, "trained_distance": trained_distance, "running_terms": running_terms,
}

_W = TQ.with_tokens()
_BOUND = _W + ", c AS (SELECT (doc_id % 10)::INT AS topic, term, count(*) AS n FROM tok GROUP BY 1, 2)"
_TOP = TQ._IDS + ", c AS (SELECT (doc_id % 10)::INT AS topic, term, count(*) AS n FROM tok GROUP BY 1, 2) SELECT * FROM (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY n DESC, type_id DESC)::INT AS rank, term, n FROM c JOIN ids USING (term)) WHERE rank <= 10"
_LEN = ", le AS (SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) USING (doc_id)), ks AS (SELECT unnest(range(10))::INT AS topic)"
_LL = _BOUND + _LEN + """, v AS (SELECT count(DISTINCT term) * 0.01::DOUBLE AS vb FROM c), nk AS (SELECT topic, sum(n) AS nk FROM c GROUP BY 1),
ll AS (SELECT (SELECT sum(lgamma(n + 0.1::DOUBLE) - lgamma(0.1::DOUBLE) - lgamma(n + 1.0::DOUBLE) + lgamma(1.0::DOUBLE)) FROM le WHERE n > 0) + (SELECT sum(lgamma(n + 0.01::DOUBLE) - lgamma(0.01::DOUBLE)) FROM c)
 - (SELECT sum(lgamma((SELECT vb FROM v) + coalesce(nk, 0))) FROM ks LEFT JOIN nk USING (topic)) + 10 * lgamma((SELECT vb FROM v)) AS value)"""
_PLANT = _W + ", p AS (SELECT doc_id, term, ((doc_id * 7 + pos * 13) % 10)::INT AS topic FROM tok)"
_LIST = "theta IS NOT NULL"
_STATE = _W + """, a AS (SELECT doc_id, term, ((doc_id * 5 + pos * 11) % 10)::INT AS topic FROM tok), le AS (SELECT d.doc_id, coalesce(n, 0) AS len FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) USING (doc_id)),
nk AS (SELECT topic, count(*) AS nk FROM a GROUP BY 1), phi AS (SELECT topic, term, count(*) / any_value(nk) AS p FROM a JOIN nk USING (topic) GROUP BY 1, 2), th AS (SELECT doc_id, topic, count(*) / any_value(len) AS t FROM a JOIN le USING (doc_id) GROUP BY 1, 2),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2), cf AS (SELECT term, sum(tf) / (SELECT count(*) FROM tok) AS pc FROM post GROUP BY 1),
q AS (SELECT DISTINCT doc_id AS q, term FROM tok WHERE doc_id % 500 = 0), w AS (SELECT DISTINCT term FROM q),
pt AS (SELECT term, doc_id, sum(p * t) AS pt FROM w JOIN phi USING (term) JOIN th USING (topic) GROUP BY 1, 2)"""
_EACH = _STATE + """, e AS (SELECT pt.term, pt.doc_id, pt, pc, len, CASE WHEN len > 0 THEN coalesce(tf, 0) / len ELSE 0 END AS pd FROM pt JOIN cf USING (term) JOIN le USING (doc_id) LEFT JOIN post USING (term, doc_id)),
r AS (SELECT q, doc_id AS id, -sum(ln(0.7 * (len / (len + 1) * PD + (1 - len / (len + 1)) * pc) + 0.3 * pt)) AS d FROM e JOIN q USING (term) GROUP BY 1, 2)"""
_BEST = " SELECT * FROM (SELECT q, id, round(d, 6) AS d, row_number() OVER (PARTITION BY q ORDER BY round(d, 6), id)::INT AS rank FROM {0}) WHERE rank <= 10"
_T150 = "(lgamma(75.5::DOUBLE) - lgamma(75::DOUBLE) - 0.5 * ln(150 * pi()) - 75.5 * ln(1 + {0} * {0} / 150))"
_CO = ", nx AS (SELECT term AS w1, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tok), co AS (SELECT w1, w2, count(*) AS n FROM nx WHERE w2 IS NOT NULL GROUP BY 1, 2), tf AS (SELECT term, count(*) AS tf FROM tok GROUP BY 1), bo AS (SELECT w1, w2 FROM co UNION SELECT w2, w1 FROM co), sc AS (SELECT bo.w1, bo.w2, coalesce(a.n, b.n) / tf AS s FROM bo JOIN w ON w.term = bo.w1 LEFT JOIN co a ON a.w1 = bo.w1 AND a.w2 = bo.w2 LEFT JOIN co b ON b.w1 = bo.w2 AND b.w2 = bo.w1 JOIN tf ON tf.term = bo.w1), ne AS (SELECT post.doc_id, w1 AS term, sum(s) AS co FROM post JOIN sc ON sc.w2 = post.term GROUP BY 1, 2), ty AS (SELECT doc_id, count(*) AS types FROM post GROUP BY 1)"
_N = "(SELECT count(*) FROM documents)"
_TK = f"(SELECT sum(len({TQ._tok_sql(TQ._LM)}))::BIGINT FROM documents)"
_TYPES = PQ._A + ", ty AS (SELECT type_id, row_number() OVER (ORDER BY sum(n) DESC, type_id) AS r, count(*) OVER () AS v FROM ttc GROUP BY 1), fr AS (SELECT type_id FROM ty WHERE r <= ceil(0.1::DOUBLE * v)), ch AS (SELECT type_id FROM ty WHERE type_id % 3 = 0)"

SQL = {f"bound_{x}": _TOP for x in lda.SCHEMES} | {
    "bound_theta": _W + _LEN + " SELECT doc_id, topic, round(CASE WHEN topic = doc_id % 10 THEN n + 0.1::DOUBLE ELSE 0.1::DOUBLE END / (n + 1::DOUBLE), 9) AS theta FROM le, ks",
    "bound_likelihood": _LL + " SELECT i::INT AS iteration, round(value, 1) AS value FROM ll, (SELECT unnest([1, 2, 3]) AS i)",
    "saved_model": _BOUND + " SELECT topic, sum(n)::BIGINT AS tokens FROM c GROUP BY 1",
    "aborted_model": "SELECT 1 AS iteration, TRUE AS aborted",
    "planted_counts": _PLANT + " SELECT term, topic, count(*) AS n FROM p GROUP BY 1, 2",
    "reordered_topics": _PLANT + ", k AS (SELECT topic, count(*) AS tokens FROM p GROUP BY 1) SELECT (row_number() OVER (ORDER BY tokens DESC, topic) - 1)::INT AS topic, tokens FROM k",
    "collapsed_phi": _PLANT + ", g AS (SELECT DISTINCT term FROM p), ks AS (SELECT topic, count(*) AS nk FROM p GROUP BY 1), n AS (SELECT topic, term, count(*) AS n FROM p GROUP BY 1, 2) SELECT ks.topic, g.term, round((coalesce(n, 0) + 0.01::DOUBLE) / (nk + 0.01::DOUBLE * (SELECT count(*) FROM g)), 12) AS p FROM g CROSS JOIN ks LEFT JOIN n ON n.topic = ks.topic AND n.term = g.term",
    "one_topic_held_out": _W + ", f AS (SELECT term, ln((count(*) + 0.01::DOUBLE) / ((SELECT count(*) FROM tok) + 0.01::DOUBLE * (SELECT count(DISTINCT term) FROM tok))) AS lp FROM tok GROUP BY 1), t AS (SELECT doc_id, sum(lp) AS s FROM tok JOIN f USING (term) GROUP BY 1) SELECT doc_id, round(coalesce(s, 0), 3) AS log_probability FROM documents LEFT JOIN t USING (doc_id)",
    "forced_theta": TQ._IDS + _LEN + ", c AS (SELECT doc_id, (type_id % 10)::INT AS topic, count(*) AS m FROM tok JOIN ids USING (term) GROUP BY 1, 2) SELECT doc_id, topic, round((coalesce(m, 0) + 0.1::DOUBLE) / (n + 1::DOUBLE), 9) AS theta FROM le CROSS JOIN ks LEFT JOIN c USING (doc_id, topic)",
    "scan_documents": f"SELECT p AS policy, i AS iteration, CASE WHEN p = 'even_split' OR (p = 'adaptive' AND i = 1) THEN {_N} WHEN p = 'fixed_split' THEN floor((CASE WHEN i = 2 THEN 0.5::DOUBLE ELSE 0.125::DOUBLE END) * {_N})::BIGINT ELSE ceil(0.25::DOUBLE * {_N})::BIGINT END AS visited, {_TK} AS tokens FROM (SELECT unnest(['even_split', 'percentage', 'adaptive', 'fixed_split']) AS p), (SELECT unnest([1, 2, 3]) AS i)",
    "scan_topics": "SELECT 'part ' || i AS part, min(t)::INT AS low, max(t)::INT AS high, count(*)::INT AS n FROM (SELECT t, ntile(7) OVER (ORDER BY t) - 1 AS i FROM (SELECT unnest(range(100)) AS t)) GROUP BY i UNION ALL SELECT 'percentage', 0, 99, 26",
    "scan_types": _TYPES + " SELECT * FROM (SELECT 'frequent' AS policy, 1 AS iteration, type_id FROM fr UNION ALL SELECT 'meta', 4, type_id FROM fr UNION ALL SELECT 'changed', 3, type_id FROM ch UNION ALL SELECT 'meta', 5, type_id FROM ch UNION ALL SELECT 'changed', 1, type_id FROM ty UNION ALL SELECT 'changed', 20, type_id FROM ty UNION ALL SELECT 'all', 1, type_id FROM ty)",
    "scan_bounds": "SELECT * FROM (VALUES ('start', TRUE), ('less later', TRUE), ('walk of one', TRUE)) t(what, holds)",
    "batch_sizes": f"SELECT p AS policy, i AS iteration, CASE WHEN p = 'adaptive' AND i = 1 THEN {_N} ELSE ceil(0.3::DOUBLE * {_N})::BIGINT END AS n FROM (VALUES ('percentage', 1), ('adaptive', 1), ('adaptive', 2), ('adaptive', 3)) t(p, i)",
    "alias_probabilities": f"SELECT doc_id, generate_subscripts(theta, 1)::INT - 1 AS topic, round(CASE WHEN list_sum(theta) = 0 THEN 0.01 ELSE unnest(theta) / list_sum(theta) END, 11) + 0.0 AS p FROM doc_topics WHERE {_LIST}",
    "dirichlet_draws": f"SELECT doc_id, CASE WHEN list_max(theta) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS total, 0 AS outside, round(list_sum([theta[i] for i in range(1, 100, 2)]), 9) AS mass, 0 AS moved, 1::DOUBLE AS by_dirichlet, 1::DOUBLE AS by_urn, 1::DOUBLE AS by_selection FROM doc_topics WHERE {_LIST}",
    "count_draws": f"SELECT doc_id, 0::BIGINT AS never, doc_id AS always, doc_id % 1000 AS many, doc_id % 90 AS different FROM doc_topics WHERE {_LIST}",
    "cumulative_search": f"WITH x AS (SELECT doc_id, theta, list_sum(theta) AS s, unnest(range(1, 101)) AS i FROM doc_topics WHERE {_LIST}), c AS (SELECT doc_id, i, s, sum(theta[i]) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM x) SELECT doc_id, CASE WHEN max(s) = 0 THEN -1 ELSE min(i) FILTER (c > 0.37 * s) - 1 END::INT AS topic FROM c GROUP BY 1",
    "gamma_moments": "SELECT unnest(['gamma 0.1', 'gamma 1.0', 'gamma 30.0', 'beta', 'poisson 0.01', 'poisson 3.0', 'poisson 500.0', 'uniform']) AS what, TRUE AS holds",
    "lda_query_likelihood": _EACH.replace("PD", "pd") + _BEST.format("r"),
    "lda_length_prior": _EACH.replace("PD", "pd") + f", z AS (SELECT r.q, r.id, r.d - CASE WHEN a.len = b.len THEN 0 ELSE {_T150.format('ln(abs(a.len - b.len))')} END AS d FROM r JOIN le a ON a.doc_id = r.q JOIN le b ON b.doc_id = r.id)" + _BEST.format("z"),
    "lda_backoff": _STATE.replace(" WHERE doc_id % 500 = 0", "") + _CO + _EACH[len(_STATE) :].replace("LEFT JOIN post USING (term, doc_id)", "LEFT JOIN post USING (term, doc_id) LEFT JOIN ne USING (term, doc_id) LEFT JOIN ty USING (doc_id)").replace("coalesce(tf, 0) / len ELSE 0 END", "CASE WHEN tf IS NULL THEN coalesce(co / types, 0) ELSE tf / len END ELSE 0 END").replace("PD", "pd") + _BEST.format("r"),
    "lda_long_query": _STATE + """, vv AS (SELECT count(*) AS v FROM cf), ql AS (SELECT q, le.doc_id AS id, -sum(ln(len / (len + v) * coalesce(tf, 0) / greatest(len, 1) + (1 - len / (len + v)) * pc)) AS d FROM q JOIN cf USING (term) CROSS JOIN le CROSS JOIN vv LEFT JOIN post ON post.term = q.term AND post.doc_id = le.doc_id GROUP BY 1, 2),
sm AS (SELECT le.doc_id, k AS topic, (coalesce(t, 0) + 0.000001::DOUBLE) / (1 + 10 * 0.000001::DOUBLE) AS t FROM le CROSS JOIN (SELECT unnest(range(10))::INT AS k) LEFT JOIN th ON th.doc_id = le.doc_id AND th.topic = k WHERE len > 0),
kl AS (SELECT a.doc_id AS q, b.doc_id AS id, sum(a.t * ln(a.t / b.t)) / ln(2) AS kl FROM sm a JOIN sm b USING (topic) WHERE a.doc_id % 500 = 0 GROUP BY 1, 2), z AS (SELECT q, id, d + kl AS d FROM ql JOIN kl USING (q, id))""" + _BEST.format("z"),
    "by_corpus": "SELECT doc_id, CASE WHEN doc_id % 5 >= doc_id % 7 AND doc_id % 5 >= doc_id % 3 THEN 'five' WHEN doc_id % 7 >= doc_id % 3 THEN 'seven' ELSE 'three' END AS predicted, greatest(doc_id % 7, doc_id % 5, doc_id % 3)::DOUBLE AS score FROM documents",
    "fold_artefacts": f"SELECT {_N} AS n, {_N} AS tested, 5::BIGINT AS folds",
    "trained_distance": "SELECT vec_id AS id, round(abs(embedding[1]::DOUBLE - (SELECT avg(embedding[1]::DOUBLE) FROM embeddings WHERE embedding IS NOT NULL)), 6) AS d FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 50 = 0",
    "running_terms": _W + " SELECT term, count(*) AS tf FROM tok GROUP BY 1",
}
