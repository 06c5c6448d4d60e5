"""Diagnostics of topics (K10-K23), each one row per topic (or topic and word), from count tables.

``0 ln 0`` is 0 throughout (Q30). Topics without tokens have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares of a document above which a topic counts as allocated.
PROPORTIONS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)


def topic_tokens(ttc: DataFrame) -> DataFrame:
    """K10."""
    return ttc.groupBy("topic").agg(F.sum("n").alias("tokens"))


def document_entropy(dtc: DataFrame) -> DataFrame:
    """-sum n ln n / N + ln N over the documents of a topic."""
    n = F.col("n")
    return dtc.groupBy("topic").agg((-F.sum(n * F.log(n)) / F.sum(n) + F.log(F.sum(n))).alias("document_entropy"))


def word_length(top: DataFrame, vocab: DataFrame) -> DataFrame:
    """Mean length of the top words and the sum of their standardised lengths (0 where all are equally long)."""
    w = top.join(vocab, "type_id").select("topic", F.length("term").alias("len"))
    all_ = w.agg(F.avg("len").alias("m"), F.stddev_samp("len").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("len") - F.col("m")) / F.col("sd")).otherwise(0.0)
    return w.join(F.broadcast(all_), F.lit(True)).groupBy("topic").agg(F.avg("len").alias("word_length"), F.sum(z).alias("word_length_sd"))


def codocuments(assign: DataFrame, top: DataFrame) -> DataFrame:
    """topic, r1 >= r2, docs: documents in which both top words (by rank) are assigned to the topic.

    The pairs of one document and topic are at most the square of the number of top words.
    """
    seen = assign.join(F.broadcast(top.select("topic", "type_id", "rank")), ["topic", "type_id"]).groupBy("doc_id", "topic").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    pairs = seen.select("topic", F.explode("ranks").alias("r1"), "ranks").select("topic", "r1", F.explode(F.filter("ranks", lambda x: x <= F.col("r1"))).alias("r2"))
    return pairs.groupBy("topic", "r1", "r2").agg(F.count(F.lit(1)).alias("docs"))


def coherence(codocs: DataFrame, top: DataFrame, beta: float) -> DataFrame:
    """Sum over pairs of top words of ln((D(i, j) + beta) / (D(j, j) + beta)), j ranked above i."""
    t = top.select("topic", "rank")
    grid = t.select("topic", F.col("rank").alias("r1")).join(t.select("topic", F.col("rank").alias("r2")), "topic").where("r2 < r1")
    both = codocs.select("topic", "r1", "r2", F.col("docs").alias("d12"))
    diag = codocs.where("r1 = r2").select("topic", "r2", F.col("docs").alias("d2"))
    x = grid.join(both, ["topic", "r1", "r2"], "left").join(diag, ["topic", "r2"], "left")
    score = F.log((F.coalesce("d12", F.lit(0)) + beta) / (F.coalesce("d2", F.lit(0)) + beta))
    return x.groupBy("topic").agg(F.sum(score).alias("coherence"))


def _p(ttc: DataFrame) -> DataFrame:
    return ttc.where("n > 0").withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("topic")))


def uniform_distance(ttc: DataFrame) -> DataFrame:
    """Divergence of a topic's words from the uniform distribution over the vocabulary."""
    v = ttc.agg(F.countDistinct("type_id").alias("V"))
    return _p(ttc).join(F.broadcast(v), F.lit(True)).groupBy("topic").agg(F.sum(F.col("p") * F.log(F.col("p") * F.col("V"))).alias("uniform_dist"))


def corpus_distance(ttc: DataFrame) -> DataFrame:
    """Divergence of a topic's words from those of the corpus."""
    all_ = ttc.agg(F.sum("n").alias("total"))
    pw = ttc.groupBy("type_id").agg(F.sum("n").alias("cw")).join(F.broadcast(all_), F.lit(True)).select("type_id", (F.col("cw") / F.col("total")).alias("pc"))
    return _p(ttc).join(pw, "type_id").groupBy("topic").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("pc"))).alias("corpus_dist"))


def effective_words(ttc: DataFrame) -> DataFrame:
    """1 / sum p^2."""
    return _p(ttc).groupBy("topic").agg((1 / F.sum(F.col("p") * F.col("p"))).alias("eff_num_words"))


def token_doc_diff(top: DataFrame, codocs: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence between the token and document shares of the top words."""
    docs = codocs.where("r1 = r2").select("topic", F.col("r1").alias("rank"), "docs")
    w = Window.partitionBy("topic")
    x = top.join(docs, ["topic", "rank"], "left").select("topic", F.col("n").alias("n"), F.coalesce("docs", F.lit(0)).alias("docs"))
    x = x.select("topic", (F.col("n") / F.sum("n").over(w)).alias("p"), (F.col("docs") / F.sum("docs").over(w)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part: Column = F.when(F.col("p") > 0, 0.5 * F.col("p") * F.log(F.col("p") / m)).otherwise(0.0) + F.when(F.col("q") > 0, 0.5 * F.col("q") * F.log(F.col("q") / m)).otherwise(0.0)
    return x.groupBy("topic").agg(F.sum(part).alias("token_doc_diff"))


def rank1(dtc: DataFrame) -> DataFrame:
    """Share of a topic's documents in which it has most tokens; the smaller topic first among ties."""
    best = dtc.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("topic")).alias("t"))).alias("x")).select((-F.col("x.t")).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("first"))
    return dtc.groupBy("topic").agg(F.count(F.lit(1)).alias("docs")).join(best, "topic", "left").select("topic", (F.coalesce("first", F.lit(0)) / F.col("docs")).alias("rank_1_docs"))


def allocation(dtc: DataFrame, k: int, alpha: float) -> DataFrame:
    """allocation_ratio (documents above 0.5 over those above 0.02, null if none) and allocation_count (above 0.3 over all)."""
    n = F.sum("n").over(Window.partitionBy("doc_id"))
    x = dtc.withColumn("share", (F.col("n") + alpha) / (n + k * alpha))
    at = lambda p: F.sum(F.when(F.col("share") >= p, 1).otherwise(0))
    ratio = F.when(at(PROPORTIONS[1]) > 0, at(PROPORTIONS[6]) / at(PROPORTIONS[1]))
    return x.groupBy("topic").agg(ratio.alias("allocation_ratio"), (at(PROPORTIONS[5]) / F.count(F.lit(1))).alias("allocation_count"))


def reverse_cumulative(dtc: DataFrame) -> DataFrame:
    """Topic, at_least, docs: documents with at least that many tokens of the topic, for every count up to the largest.

    The histogram has one row for each count that occurs; a running sum over it and a fill of the
    gaps give the rest, so no document is sorted.
    """
    h = dtc.where("n > 0").groupBy("topic", F.col("n").alias("at_least")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("topic").orderBy(F.desc("at_least"))
    run = h.withColumn("docs", F.sum("c").over(w))
    below = F.coalesce(F.lead("at_least").over(w), F.lit(0)) + 1
    return run.withColumn("low", below).select("topic", F.explode(F.sequence("low", "at_least")).alias("at_least"), "docs")


def k_at_percentile(ttc: DataFrame, percentile: float = 0.8) -> DataFrame:
    """One row, k: the first place (from 0), by falling tokens, at which the share of tokens exceeds the percentile."""
    t = topic_tokens(ttc)
    w = Window.orderBy(F.desc("tokens"), "topic")
    c = t.select((F.row_number().over(w) - 1).alias("i"), (F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("tokens").over(Window.partitionBy())).alias("share"))
    return c.agg(F.coalesce(F.min(F.when(F.col("share") > percentile, F.col("i"))), F.count(F.lit(1))).cast("long").alias("k"))


def empty_topics(ttc: DataFrame, k: int) -> DataFrame:
    """Topics without a token."""
    spark = ttc.sparkSession
    return spark.range(k).select(F.col("id").cast("int").alias("topic")).join(ttc.where("n > 0").select("topic").distinct(), "topic", "left_anti")


def allocation_cdf(ttc: DataFrame) -> DataFrame:
    """Topic, tokens, percent, cdf in order of the topic."""
    t = topic_tokens(ttc)
    whole = F.sum("tokens").over(Window.partitionBy())
    w = Window.orderBy("topic").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("topic", "tokens", (F.col("tokens") / whole).alias("percent"), (F.sum("tokens").over(w) / whole).alias("cdf"))


def all_diagnostics(assign: DataFrame, vocab: DataFrame, k: int, alpha: float, beta: float, n_top: int = 20) -> DataFrame:
    """All scores of every topic in one wide row (K20 writes it as CSV, text or XML)."""
    from quillmark.operators.topics import doc_topic_counts, top_words, type_topic_counts

    ttc, dtc = type_topic_counts(assign), doc_topic_counts(assign)
    top = top_words(ttc, n_top)
    co = codocuments(assign, top)
    out = topic_tokens(ttc)
    for part in (document_entropy(dtc), word_length(top, vocab), coherence(co, top, beta), uniform_distance(ttc), corpus_distance(ttc), effective_words(ttc), token_doc_diff(top, co), rank1(dtc), allocation(dtc, k, alpha)):
        out = out.join(part, "topic", "left")
    return out
