"""Queries of the samplers, inference, evaluation and streaming: iterative, so checked by their invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.models import lda
from quillmark.operators import search, vocab
from quillmark.operators.storage import materialize
from quillmark.operators.topics import top_words, type_topic_counts
from quillmark.queries import text as TQ
from quillmark.queries.base import table

TOPICS = 10


def corpus(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, types) over the whole vocabulary, and its numbering in order of first appearance."""
    tokens = TQ._tokens(s, d)
    ids = materialize(vocab.type_ids(tokens), "vocabulary")
    arrays = vocab.corpus_arrays(tokens, ids)
    docs = TQ._docs(s, d).select("doc_id").join(arrays, "doc_id", "left").select("doc_id", F.coalesce("types", F.array().cast("array<int>")).alias("types"))
    return materialize(docs, "corpus"), ids


def _model(s: SparkSession, d: str, scheme: str, **kw) -> tuple[lda.TopicModel, DataFrame, DataFrame]:
    docs, ids = corpus(s, d)
    n = ids.count()
    m = lda.TopicModel(docs, n, lda.Settings(topics=TOPICS, alpha=0.1, beta=0.01, scheme=scheme), **kw)
    return m.sample(), docs, ids


def _trained(scheme: str):
    def q(s: SparkSession, d: str) -> DataFrame:
        m, _, ids = _model(s, d, scheme)
        top = top_words(type_topic_counts(m.assign()), 10)
        return top.join(ids, "type_id").select("topic", "rank", "term", "n")

    return q


def topic_prior_model(s: SparkSession, d: str) -> DataFrame:
    """Words of even type ids are barred from topic 0, and documents of even id from topic 1."""
    docs, ids = corpus(s, d)
    n = ids.count()
    priors = np.ones((TOPICS, n))
    priors[0, ::2] = 0
    allowed = docs.where("doc_id % 2 = 0").select("doc_id", F.array(*[F.lit(k) for k in range(TOPICS) if k != 1]).alias("allowed"))
    m = lda.TopicModel(docs, n, lda.Settings(topics=TOPICS, alpha=0.1, scheme="polyaurn_priors"), topic_priors=priors, doc_priors=allowed).sample()
    return m.assign().groupBy("topic", (F.col("doc_id") % 2).alias("odd")).agg(F.count(F.lit(1)).alias("n"))


def inferred_theta(s: SparkSession, d: str) -> DataFrame:
    m, docs, _ = _model(s, d, "polyaurn")
    return lda.infer(docs, m.phi_mean(), m.alpha).select("doc_id", F.posexplode("theta").alias("topic", "theta"))


def model_theta(s: SparkSession, d: str) -> DataFrame:
    m, _, _ = _model(s, d, "uncollapsed")
    return m.theta().select("doc_id", F.posexplode("theta").alias("topic", "theta"))


def held_out(s: SparkSession, d: str) -> DataFrame:
    m, docs, _ = _model(s, d, "polyaurn")
    return lda.held_out(docs, m.phi_mean(), m.alpha)


def phi_table(s: SparkSession, d: str) -> DataFrame:
    m, _, ids = _model(s, d, "polyaurn")
    p = m.phi_mean()
    k, v = np.nonzero(p)
    import pandas as pd

    return s.createDataFrame(pd.DataFrame({"topic": k.astype("int32"), "type_id": v.astype("int32"), "p": p[k, v]})).join(ids, "type_id").select("topic", "term", "p")


def lda_search(s: SparkSession, d: str) -> DataFrame:
    """The ten closest documents of each evaluation text by LDA query likelihood."""
    m, _, ids = _model(s, d, "polyaurn")
    p = m.phi_mean()
    k, v = np.nonzero(p)
    import pandas as pd

    phi = s.createDataFrame(pd.DataFrame({"topic": k.astype("int32"), "type_id": v.astype("int32"), "p": p[k, v]})).join(ids, "type_id").select("topic", "term", "p")
    theta = m.theta().select("doc_id", F.posexplode("theta").alias("topic", "theta"))
    tokens = vocab.restrict(TQ._tokens(s, d), ids)
    q = vocab.restrict(vocab.explode_tokens(table(s, d, "eval_items").select(F.col("item_id").alias("doc_id"), "text")), ids)
    q = vocab.postings(q).select(F.col("doc_id").alias("q"), "term")
    r = search.lda_likelihood(q, vocab.postings(tokens), vocab.doc_lengths(TQ._docs(s, d), tokens), phi, theta)
    return search.top_k(r, 10)


QUERIES = {f"lda_{x}": _trained(x) for x in lda.SCHEMES} | {"lda_priors": topic_prior_model, "lda_infer_theta": inferred_theta, "lda_theta": model_theta, "lda_held_out": held_out, "lda_phi": phi_table, "lda_search": lda_search}
SQL: dict[str, str] = {}
