"""Programs: training, train and test, inference, similarity, BM25 search, classification, cross-validation, export.

``python -m quillmark.plans.programs COMMAND --run_cfg FILE [--key value ...]``; see ``COMMANDS``.
"""

from __future__ import annotations

import importlib
import sys
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.models import lda, scan
from quillmark.operators import classify, diagnostics, search, topics, vocab
from quillmark.operators.storage import materialize, write_bytes
from quillmark.plans.config import Config, from_arguments
from quillmark.sources import loaders, sinks


def settings(c: Config) -> lda.Settings:
    """What a configuration says about the model, random scan included."""
    seed = c.run_seed()
    return lda.Settings(
        topics=c.topics, alpha=c.alpha, beta=c.beta, iterations=c.iterations, scheme=c.scheme, seed=seed, burn_in=c.phi_mean_burnin / 100, thin=max(c.phi_mean_thin, 1),
        hyper_interval=max(c.hyperparam_optim_interval, 0), symmetric_alpha=c.symmetric_alpha, selection_prior=c.variable_selection_prior, hdp_gamma=c.hdp_gamma, report_interval=c.topic_interval,
        start_topics=c.hdp_nr_start_topics if lda.scheme(c.scheme)[0] == "hdp" else 0, phi_builder=c.phi_builder(), scan=scan.from_config(c, seed),
    )


def in_intervals(i: int, bounds: list[int]) -> bool:
    """Whether an iteration lies in one of the closed intervals ``a, b, a, b, ...``; one number alone is an interval of its own."""
    pairs = zip(bounds[::2], bounds[1::2] or bounds) if len(bounds) != 1 else [(bounds[0], bounds[0])]
    return any(a <= i <= b for a, b in pairs)


def _callback(c: Config) -> Callable | None:
    """``module:function`` of ``iteration_callback_class``, called with the model after each sweep."""
    if not c.iteration_callback_class:
        return None
    module, _, name = c.iteration_callback_class.partition(":")
    return getattr(importlib.import_module(module), name)


class Recorder:
    """What a run writes while it samples: likelihood, densities, held-out figures, timings, and tables in intervals."""

    def __init__(self, spark: SparkSession, c: Config, out: sinks.Run, ids: DataFrame, test: DataFrame | None, more: Callable | None) -> None:
        self.spark, self.c, self.out, self.ids, self.test, self.more = spark, c, out, ids, test, more
        self.stats: list[dict] = []
        self.held: list[dict] = []
        self.before: DataFrame | None = None
        self.last = time.time()

    def __call__(self, m: lda.TopicModel) -> None:
        c, i = self.c, m.iteration
        now = time.time()
        self.out.timed("sampling", now - self.last)
        if c.topic_interval and i % c.topic_interval == 0:
            row: dict = {"iteration": i, "seconds": round(now - self.last, 3)}
            if c.log_type_topic_density:
                row["type_topic_density"] = float((m.n > 0).mean())
            if c.log_phi_density:
                row["phi_density"] = float((m.phi > 0).mean())
            if c.log_document_density:
                row["document_density"] = topics.doc_density(topics.doc_topic_counts(m.assign()), c.topics).first()[0]
            if c.log_tokens_per_topic:
                row["tokens_per_topic"] = ",".join(str(int(x)) for x in m.n.sum(1))
            if self.test is not None:
                got = lda.held_out(self.test, m.phi, m.alpha, seed=m.s.seed).agg(F.sum("log_probability")).first()[0]
                row["held_out"] = got
                self.held.append({"iteration": i, "log_likelihood": got})
            self.stats.append(row)
        if c.print_ndocs_cnt and in_intervals(i, c.print_ndocs_interval):
            first = m.theta().orderBy("doc_id").limit(c.print_ndocs_cnt)
            sinks.write_table(first, f"{self.out.path}/doc_theta/iteration={i}")
        if c.print_ntopwords_cnt and in_intervals(i, c.print_ntopwords_interval):
            top = topics.top_words(topics.type_topic_counts(m.assign()), c.print_ntopwords_cnt)
            sinks.write_table(topics.topic_lines(top, self.ids), f"{self.out.path}/top_words/iteration={i}")
        if c.dn_diagnostic_interval:
            after = materialize(topics.type_topic_counts(m.assign()), "counts") if any(in_intervals(j, c.dn_diagnostic_interval) for j in (i, i + 1)) else None
            if after is not None and self.before is not None and in_intervals(i, c.dn_diagnostic_interval):
                sinks.write_delta(self.before, after, f"{self.out.path}/delta_n", i)
            self.before = after
        if self.more:
            self.more(m)
        self.last = time.time()


def train(spark: SparkSession, c: Config, callback: Callable | None = None) -> tuple[lda.TopicModel, DataFrame]:
    """Load, sample and write what the configuration asks for; returns the model and its vocabulary.

    ``test_dataset`` is read over the frozen vocabulary and its held-out log-likelihood logged;
    ``test_ids_filename`` takes the named documents out of the training set instead.
    """
    docs = loaders.load_documents(spark, c.dataset, c.file_regex)
    held_docs = None
    if c.test_ids_filename:
        listed = spark.read.text(c.test_ids_filename).select(F.trim("value").alias("name")).where("name <> ''").distinct()
        docs = materialize(docs, "documents")
        docs, held_docs = classify.split_by_ids(docs, listed, "name")
    corpus, ids = loaders.corpus_of(spark, docs, c)
    corpus, ids = materialize(corpus, "corpus"), materialize(ids, "vocabulary")
    n = ids.count()
    test = None
    if held_docs is not None:
        test = materialize(loaders.corpus_of(spark, held_docs, c, ids)[0], "held-out")
    elif c.test_dataset:
        test = materialize(loaders.load_dataset(spark, c.test_dataset, c, ids)[0], "held-out")
    priors = None
    if c.topic_prior_filename:
        priors = loaders.prior_matrix(topics.zero_out_words(loaders.read_topic_priors(spark, c.topic_prior_filename), ids, c.topics), c.topics, n)
    allowed = loaders.read_doc_priors(spark, c.document_prior_filename) if c.document_prior_filename else None
    m = lda.TopicModel(corpus, n, settings(c), topic_priors=priors, doc_priors=allowed)
    out = sinks.Run(spark, c.base_out_dir, c.experiment_out_dir or "run", vars(c))
    record = Recorder(spark, c, out, ids, test, callback or _callback(c))
    m.sample(callback=record, abort_file=f"{c.base_out_dir}/abort")
    sinks.write_log(spark, m.history, f"{out.path}/likelihood.txt")
    sinks.write_log(spark, record.stats, f"{out.path}/stats.txt")
    sinks.write_log(spark, record.held, f"{out.path}/test_held_out_log_likelihood.txt")
    write_results(spark, c, m, corpus, ids, out)
    if test is not None:
        lda.infer(test, m.phi_mean(), m.alpha, 100, m.s.seed).select("doc_id", "theta").write.parquet(f"{out.path}/test_theta")
    out.finish()
    return m, ids


def write_results(spark: SparkSession, c: Config, m: lda.TopicModel, corpus: DataFrame, ids: DataFrame, out: sinks.Run) -> None:
    at = lambda name: f"{out.path}/{name}"
    assign = m.assign()
    ttc = topics.type_topic_counts(assign)
    sinks.write_csv(topics.topic_lines(topics.top_words(ttc, c.nr_top_words), ids), at("top_words.csv"))
    p = topics.probabilities(ttc, c.topics, m.beta)
    sinks.write_csv(topics.topic_lines(topics.top_by(p, topics.relevance(c.lambda_), c.nr_top_words), ids), at("relevance_words.csv"))
    if c.save_doc_topic_means:
        sinks.write_table(m.theta().select("doc_id", "zbar"), at(c.doc_topic_mean_filename))
    if c.save_doc_theta_estimate:
        sinks.write_table(m.theta().select("doc_id", "theta"), at(c.doc_topic_theta_filename))
    if c.save_doc_topic_diagnostics:
        sinks.write_csv(diagnostics.all_diagnostics(assign, ids, c.topics, float(m.alpha.mean()), m.beta, c.nr_top_words), at(c.doc_topic_diagnostics_filename))
    if c.save_phi_mean or c.save_phi_means:
        write_bytes(spark, at(f"{c.phi_mean_filename}.bin"), sinks.matrix_bytes(m.phi_mean()))
    if c.save_vocabulary:
        sinks.write_vocabulary(ids, at(c.vocabulary_filename))
    if c.save_term_frequencies:
        sinks.write_csv(ttc.groupBy("type_id").agg(F.sum("n").alias("n")), at(c.term_frequencies_filename))
    if c.save_doc_lengths:
        sinks.write_csv(corpus.select("doc_id", F.size("types").alias("n")), at(c.doc_lengths_filename))
    if c.save_corpus:
        sinks.write_table(corpus, at(c.corpus_filename))
    if c.log_topic_indicators:
        sinks.write_indicators(assign, at("z"), c.topic_indicator_logging_format, ids)
    if m.kernel == "hdp":
        sinks.write_csv(diagnostics.k_at_percentile(ttc, c.hdp_k_percentile), at("hdp_topics"))
    if c.save_sampler:
        folder = f"{c.saved_sampler_dir}/{lda.run_key(m.s, c.dataset)}"
        m.save(folder)
        ids.write.mode("overwrite").parquet(f"{folder}/vocabulary")


def infer(spark: SparkSession, c: Config, folder: str, dataset: str, sweeps: int = 100) -> DataFrame:
    """Topics of new documents under a saved model and its frozen vocabulary."""
    m = lda.TopicModel.load(spark, folder)
    ids = spark.read.parquet(f"{folder}/vocabulary")
    corpus, _ = loaders.load_dataset(spark, dataset, c, ids)
    return lda.infer(corpus, m.phi_mean(), m.alpha, sweeps, c.run_seed())


def similarity(train_theta: DataFrame, query_theta: DataFrame, distance: str = "cosine") -> DataFrame:
    """The closest training document of each query document by topic distribution."""
    a, b = (d.select(F.col("doc_id").alias("id"), F.col("theta").alias("vec")) for d in (query_theta, train_theta))
    return search.nearest_neighbour(a, b, distance, skip_self=False)


def bm25(train_docs: DataFrame, query_docs: DataFrame, k: int = 10, **kw) -> DataFrame:
    """Test documents against training documents, the best scores first (Q6)."""
    tokens = loaders.tokenise(train_docs, **kw)
    q = vocab.postings(loaders.tokenise(query_docs, **kw)).select(F.col("doc_id").alias("q"), "term", F.col("tf").alias("qtf"))
    scores = search.bm25(q, vocab.postings(tokens), vocab.doc_lengths(train_docs, tokens)).withColumnRenamed("score", "d")
    return search.top_k(scores, k, largest=True)


def _zbar(inferred: DataFrame, k: int) -> DataFrame:
    """doc_id, zbar array of documents with tokens."""
    share = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: F.size(F.filter("z", lambda z: z == t)) / F.size("z"))
    return inferred.where(F.size("types") > 0).select("doc_id", share.alias("zbar"))


def classifier(docs: DataFrame, n_types: int, s: lda.Settings, folds: int = 5, sweeps: int = 50) -> list[DataFrame]:
    """K-fold predictions (doc_id, truth, predicted) of documents (doc_id, types, label)."""
    alpha = float(np.mean(s.alphas()))
    long = lambda df: df.select("doc_id", F.posexplode("zbar").alias("topic", "zbar"))

    def fit(part: DataFrame) -> tuple:
        m = lda.TopicModel(part.select("doc_id", "types"), n_types, s).sample()
        return m, classify.centroids(long(m.theta()), part.select("doc_id", "label"), alpha)

    def predict(state: tuple, part: DataFrame) -> DataFrame:
        m, centre = state
        got = _zbar(lda.infer(part.select("doc_id", "types"), m.phi_mean(), m.alpha, sweeps, s.seed), s.topics)
        return classify.classify(long(got), centre, alpha).join(part.select("doc_id", F.col("label").alias("truth")), "doc_id")

    return classify.cross_validate(docs, folds, fit, predict, seed=s.seed)


def cross_validation(docs: DataFrame, n_types: int, s: lda.Settings, folds: int, out: str, sweeps: int = 100) -> None:
    """For each fold, under ``out``/fold=i: the mean phi and the ids and z-bar of the training part, and the ids and z-bar of the held-out part, inferred under that phi."""
    tagged = docs.withColumn("_f", classify.fold("doc_id", folds, s.seed))
    for i in range(folds):
        at = f"{out}/fold={i}"
        m = lda.TopicModel(tagged.where(F.col("_f") != i).select("doc_id", "types"), n_types, s).sample()
        p = m.phi_mean()
        docs.sparkSession.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(p)], "topic int, phi array<double>").write.mode("overwrite").parquet(f"{at}/train-phi")
        m.theta().select("doc_id", "zbar").write.mode("overwrite").parquet(f"{at}/train-zbar")
        held = lda.infer(tagged.where(F.col("_f") == i).select("doc_id", "types"), p, m.alpha, sweeps, s.seed)
        _zbar(held, s.topics).write.mode("overwrite").parquet(f"{at}/test-zbar")
        for name, part in (("train", F.col("_f") != i), ("test", F.col("_f") == i)):
            sinks.write_csv(tagged.where(part).select("doc_id"), f"{at}/{name}-ids", header=False)


# commands -----------------------------------------------------------------------------------------
def _out(c: Config, name: str) -> str:
    return f"{c.base_out_dir}/{c.experiment_out_dir or 'run'}-{name}"


def _options(spark: SparkSession, c: Config) -> dict:
    return {"raw": c.no_preprocess, "keep_numbers": c.keep_numbers, "keep_connectors": c.keep_connecting_punctuation, "longest": c.max_doc_buf_size, "stoplist": loaders.read_stoplist(spark, c.stoplist)}


def run_train(spark: SparkSession, c: Config) -> None:
    for _ in range(max(c.no_runs, 1)):
        train(spark, c)


def run_infer(spark: SparkSession, c: Config) -> None:
    """Infers the topics of ``test_dataset`` under the saved sampler of the same settings and ``dataset``."""
    folder = f"{c.saved_sampler_dir}/{lda.run_key(settings(c), c.dataset)}"
    infer(spark, c, folder, c.test_dataset).select("doc_id", "theta").write.mode("overwrite").parquet(_out(c, "theta"))


def run_similarity(spark: SparkSession, c: Config) -> None:
    """Trains on ``dataset``, then the closest training document of each document of ``test_dataset`` (or of half of the data, by fold)."""
    docs = loaders.load_documents(spark, c.dataset, c.file_regex)
    if c.test_dataset:
        queries = loaders.load_documents(spark, c.test_dataset, c.file_regex)
    else:
        half = classify.fold("doc_id", 2, c.seed)
        docs, queries = docs.where(half == 0), docs.where(half == 1)
    corpus, ids = loaders.corpus_of(spark, docs, c)
    ids = materialize(ids, "vocabulary")
    m = lda.TopicModel(materialize(corpus, "corpus"), ids.count(), settings(c)).sample()
    q = lda.infer(loaders.corpus_of(spark, queries, c, ids)[0], m.phi_mean(), m.alpha, 500, m.s.seed)
    similarity(m.theta(), q).write.mode("overwrite").parquet(_out(c, "similar"))


def run_bm25(spark: SparkSession, c: Config) -> None:
    """The ten best documents of ``dataset`` for each of ``test_dataset``."""
    a, b = (loaders.load_documents(spark, x, c.file_regex) for x in (c.dataset, c.test_dataset))
    bm25(a, b, 10, **_options(spark, c)).write.mode("overwrite").parquet(_out(c, "bm25"))


def _labelled(spark: SparkSession, c: Config) -> tuple[DataFrame, int]:
    docs = materialize(loaders.load_documents(spark, c.dataset, c.file_regex), "documents")
    corpus, ids = loaders.corpus_of(spark, docs, c)
    return materialize(corpus.join(docs.select("doc_id", "label"), "doc_id"), "corpus"), ids.count()


def run_classify(spark: SparkSession, c: Config) -> None:
    """Five-fold predictions, the confusion matrix and the accuracy."""
    docs, n = _labelled(spark, c)
    parts = classifier(docs, n, settings(c), 5)
    p = parts[0]
    for x in parts[1:]:
        p = p.unionByName(x)
    p = materialize(p, "predictions")
    p.write.mode("overwrite").parquet(_out(c, "predictions"))
    sinks.write_csv(classify.confusion(p), _out(c, "confusion"))
    sinks.write_csv(classify.accuracy(p), _out(c, "accuracy"))


def run_cross_validate(spark: SparkSession, c: Config) -> None:
    docs, n = _labelled(spark, c)
    cross_validation(docs.drop("label"), n, settings(c), 10, _out(c, "folds"))


def run_export(spark: SparkSession, c: Config) -> None:
    """The corpus as svm-light lines, and its vocabulary."""
    corpus, ids = loaders.load_dataset(spark, c.dataset, c)
    ids = materialize(ids, "vocabulary")
    sinks.write_svmlight(corpus, _out(c, "svmlight"))
    sinks.write_vocabulary(ids, _out(c, "vocabulary"))


def run_mass(spark: SparkSession, c: Config) -> None:
    """The share of tokens that the most frequent types cover, every 50th type."""
    tokens = loaders.tokenise(loaders.load_documents(spark, c.dataset, c.file_regex), **_options(spark, c))
    mass = vocab.cumulative_mass(vocab.term_stats(tokens), vocab.type_ids(tokens))
    sinks.write_csv(mass.where("rank % 50 = 0").select("rank", "mass"), _out(c, "mass"))


COMMANDS: dict[str, Callable[[SparkSession, Config], None]] = {
    "train": run_train, "infer": run_infer, "similarity": run_similarity, "bm25": run_bm25, "classify": run_classify, "cross-validate": run_cross_validate, "export": run_export, "mass": run_mass,
}


def main(args: list[str]) -> None:
    if not args or args[0] not in COMMANDS:
        sys.exit(f"{__doc__}\ncommands: {', '.join(COMMANDS)}")
    spark = SparkSession.builder.appName("quillmark").getOrCreate()
    for c in from_arguments(args[1:]).values():
        COMMANDS[args[0]](spark, c)


if __name__ == "__main__":
    main(sys.argv[1:])
