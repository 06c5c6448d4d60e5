"""Topic-model state as tables, probabilities, word rankings and likelihood.

State: ``assign`` (doc_id, pos, type_id, topic) with one row for each token; ``ttc`` (type_id, topic, n)
counts it. Cells of a dense type-by-topic grid that no token fills are made where smoothing needs
them, from V types and K topics only. Rankings break ties by descending type id unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.distances import lgamma
from quillmark.operators.order import in_order


def current_assignment(delivered: DataFrame) -> DataFrame:
    """One row for each token of a table with repeated deliveries: the latest, then the largest topic; null topics are left out."""
    latest = F.max(F.struct("sampled_at", "topic", "type_id"))
    one = delivered.where("topic IS NOT NULL").groupBy("doc_id", "pos").agg(latest.alias("x"))
    return one.select("doc_id", "pos", F.col("x.type_id").alias("type_id"), F.col("x.topic").alias("topic"))


def type_topic_counts(assign: DataFrame) -> DataFrame:
    return assign.groupBy("type_id", "topic").agg(F.count(F.lit(1)).alias("n"))


def doc_topic_counts(assign: DataFrame) -> DataFrame:
    return assign.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("n"))


def tokens_per_topic(ttc: DataFrame) -> DataFrame:
    return ttc.groupBy("topic").agg(F.sum("n").alias("tokens"))


def hash_assignment(tokens: DataFrame, k: int) -> DataFrame:
    """A deterministic start that any engine can repeat: topic = (7 doc_id + 13 pos + 31 length(term)) mod k."""
    return tokens.withColumn("topic", ((F.col("doc_id") * 7 + F.col("pos") * 13 + F.length("term") * 31) % k).cast("int"))


def theta(dtc: DataFrame, k: int, alpha: float) -> DataFrame:
    """doc_id, topic, zbar, theta for every topic of every document with tokens."""
    grid = _grid(dtc.select("doc_id").distinct(), k)
    total = dtc.groupBy("doc_id").agg(F.sum("n").alias("total"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return grid.join(dtc, ["doc_id", "topic"], "left").join(total, "doc_id").select("doc_id", "topic", (n / F.col("total")).alias("zbar"), ((n + alpha) / (F.col("total") + k * alpha)).alias("theta"))


def _grid(keys: DataFrame, k: int) -> DataFrame:
    return keys.withColumn("topic", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def probabilities(ttc: DataFrame, k: int, beta: float) -> DataFrame:
    """K3: type_id, topic, n, p_w_k, p_w, p_k, p_k_w and the unsmoothed u_w_k, u_w for every cell of the grid.

    ``p_k`` has no smoothing; where a topic has no token its unsmoothed p(w|k) is 0.
    """
    dense = _grid(ttc.select("type_id").distinct(), k).join(ttc, ["type_id", "topic"], "left").select("type_id", "topic", F.coalesce("n", F.lit(0)).alias("n"))
    by_k, by_w = Window.partitionBy("topic"), Window.partitionBy("type_id")
    s = F.col("n") + beta
    sums = ttc.agg(F.sum("n").alias("total"), F.countDistinct("type_id").alias("V"))
    per_k = ttc.groupBy("topic").agg(F.sum("n").alias("nk"))
    d = dense.join(F.broadcast(per_k), "topic", "left").join(F.broadcast(sums), F.lit(True))
    nk, whole = F.coalesce(F.col("nk"), F.lit(0)), F.col("total") + F.col("V") * k * beta
    nw = F.sum("n").over(by_w)
    _ = by_k
    return d.select(
        "type_id", "topic", "n", (s / (nk + F.col("V") * beta)).alias("p_w_k"), ((nw + k * beta) / whole).alias("p_w"), (nk / F.col("total")).alias("p_k"), (s / (nw + k * beta)).alias("p_k_w"),
        F.when(nk == 0, 0.0).otherwise(F.col("n") / nk).alias("u_w_k"), (nw / F.col("total")).alias("u_w"),
    )


def relevance(lam: float = 0.6) -> Column:
    """K4 (Q23): lam ln p(w|k) + (1 - lam) (ln p(w|k) - ln p(w))."""
    lw = F.log("p_w_k")
    return lam * lw + (1 - lam) * (lw - F.log("p_w"))


def distinctiveness() -> Column:
    """K5: p(k|w) ln(p(k|w) / p(k)); 0 in an empty topic."""
    return F.when(F.col("p_k") == 0, 0.0).otherwise(F.col("p_k_w") * F.log(F.col("p_k_w") / F.col("p_k")))


def saliency() -> Column:
    """K6."""
    return F.col("p_w") * distinctiveness()


def reweighted() -> Column:
    """K7: p(w|k) over its sum over the topics."""
    return F.col("p_w_k") / F.sum("p_w_k").over(Window.partitionBy("type_id"))


def top_by(scored: DataFrame, score: Column, k: int) -> DataFrame:
    """topic, rank, type_id, score: the k best types of each topic.

    The score is rounded to 12 decimals before it ranks, so that equal formulas tie alike everywhere.
    """
    w = Window.partitionBy("topic").orderBy(F.desc("score"), F.desc("type_id"))
    return scored.select("topic", "type_id", F.round(score, 12).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_words(ttc: DataFrame, k: int) -> DataFrame:
    """K1, K2, K8: topic, rank, type_id, n by count; fewer rows where a topic has fewer types."""
    w = Window.partitionBy("topic").orderBy(F.desc("n"), F.desc("type_id"))
    return ttc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("topic", "rank", "type_id", "n")


def topic_lines(top: DataFrame, vocab: DataFrame) -> DataFrame:
    """K9: topic, line: ``Topic n: w1, w2, ...`` with topics counted from 1."""
    words = top.join(vocab, "type_id").groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("w"))
    return words.select("topic", F.concat(F.lit("Topic "), (F.col("topic") + 1).cast("string"), F.lit(": "), F.col("w")).alias("line"))


def log_likelihood(assign: DataFrame, k: int, alpha: float, beta: float) -> DataFrame:
    """One row, log_likelihood of the collapsed joint; documents without tokens add nothing."""
    g = lambda x: lgamma(x.cast("double"))
    c = lambda x: g(F.lit(float(x)))
    ttc, dtc = type_topic_counts(assign), doc_topic_counts(assign)
    docs = dtc.groupBy("doc_id").agg(F.sum(g(F.col("n") + alpha) - c(alpha)).alias("a"), F.sum("n").alias("total"))
    docs = docs.agg(F.sum(F.col("a") - g(F.col("total") + k * alpha) + c(k * alpha)).alias("docs"))
    cells = ttc.agg(F.sum(g(F.col("n") + beta) - c(beta)).alias("cells"), F.countDistinct("type_id").alias("V"))
    topics = tokens_per_topic(ttc).agg(F.collect_list("tokens").alias("nk"), F.count(F.lit(1)).alias("used"))
    v = F.col("V") * beta
    per_topic = F.aggregate("nk", F.lit(0.0), lambda s, n: s + g(v + n)) + (k - F.col("used")) * g(v)
    return docs.join(cells, F.lit(True)).join(topics, F.lit(True)).select((F.col("docs") + F.col("cells") - per_topic + k * g(v)).alias("log_likelihood"))


def count_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Topic, type_id, delta where a count of one sweep differs from the sweep before."""
    d = before.select("topic", "type_id", (-F.col("n")).alias("n")).unionAll(after.select("topic", "type_id", "n"))
    return d.groupBy("topic", "type_id").agg(F.sum("n").alias("delta")).where("delta <> 0")


def reorder_topics(ttc: DataFrame) -> DataFrame:
    """Topic, new_topic: topics renumbered by falling tokens, ties by topic."""
    return tokens_per_topic(ttc).select("topic", (F.row_number().over(Window.orderBy(F.desc("tokens"), "topic")) - 1).cast("int").alias("new_topic"))


def density(ttc: DataFrame, k: int) -> DataFrame:
    """type_topic_density (share of filled cells) and phi_zeros (share of empty cells, Q14)."""
    s = ttc.agg(F.count(F.lit(1)).alias("filled"), F.countDistinct("type_id").alias("V"))
    d = F.col("filled") / (F.col("V") * k)
    return s.select(d.alias("type_topic_density"), (1 - d).alias("phi_zeros"))


def doc_density(dtc: DataFrame, k: int) -> DataFrame:
    """doc_density: the mean share of topics that a document uses."""
    return dtc.groupBy("doc_id").agg((F.count(F.lit(1)) / k).alias("d")).agg(F.avg("d").alias("doc_density"))


def frequent_types(ttc: DataFrame, share: float) -> DataFrame:
    """The ceil(share * V) most frequent types; ties by type id."""
    n = ttc.groupBy("type_id").agg(F.sum("n").alias("n"))
    x = in_order(n, F.desc("n"), "type_id", total="size").withColumn("rank", (F.col("index") + 1).cast("int"))
    return x.where(F.col("rank") <= F.ceil(F.col("size") * F.lit(share))).select("type_id", "n", "rank")


def systematic_types(ttc: DataFrame, step: int, offset: int) -> DataFrame:
    """Types hit by a walk of ``step`` tokens from ``offset`` (1 .. step) over the types in id order."""
    n = ttc.groupBy("type_id").agg(F.sum("n").alias("n"))
    d = in_order(n, "type_id", running={"n": "cum"})
    hit = F.floor((F.col("cum") - offset) / step) - F.floor((F.col("cum") - F.col("n") - offset) / step)
    return d.where(hit >= 1).select("type_id", "n")


def zero_out_words(priors: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """Topic, type_id of the cells that anchored words lose: a word named for some topics is barred from all others.

    ``priors``: topic, term. Words outside the vocabulary are ignored.
    """
    named = priors.join(vocab, "term").select("type_id", "topic").distinct()
    return _grid(named.select("type_id").distinct(), k).join(named, ["type_id", "topic"], "left_anti").select("topic", "type_id")
