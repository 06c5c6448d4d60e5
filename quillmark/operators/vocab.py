"""Vocabularies and corpus statistics (V1-V17) over long token tables ``(doc_id, pos, term)``.

Rows with a null text have no tokens. All counts are longs. Empty tables give empty results; corpus
totals over an empty table are zero. Terms are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import text as T
from quillmark.operators.order import in_order
from quillmark.operators.storage import materialize


def explode_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer=T.tokens) -> DataFrame:
    """doc_id, pos (from 0), term."""
    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(tokenizer(text)).alias("pos", "term"))


def remove_stopwords(tokens: DataFrame, stoplist: DataFrame, word: str = "word") -> DataFrame:
    """T8/S12 for a stoplist of any size: tokens without an equal word; positions are kept."""
    return tokens.join(stoplist.where(F.col(word).isNotNull()).select(F.col(word).alias("term")).distinct(), "term", "left_anti").select(*tokens.columns)


def term_stats(tokens: DataFrame) -> DataFrame:
    """V1, V2: term, tf, df. Counting inside the document first keeps the shuffle at one row per (document, term)."""
    per_doc = tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def tfidf(stats: DataFrame, n_docs: int | Column) -> DataFrame:
    """V3: tf * ln(N / df) with the corpus total as tf; 0 where tf or df is 0."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return stats.withColumn("tfidf", F.when((F.col("tf") == 0) | (F.col("df") == 0), 0.0).otherwise(F.col("tf") * F.log(n / F.col("df"))))


def type_ids(tokens: DataFrame) -> DataFrame:
    """type_id, term in order of first appearance (smallest doc_id, then position).

    The vocabulary is numbered by range partitions, so its size is not bounded by one task.
    """
    first = tokens.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("f"))
    return in_order(first, "f.doc_id", "f.pos").select(F.col("index").cast("int").alias("type_id"), "term")


def rank_by_tfidf(weighted: DataFrame, ids: DataFrame) -> DataFrame:
    """V4: rank from 1 by descending tf-idf, ties by descending type id. V6 is a filter on ``term``."""
    return in_order(weighted.join(ids, "term"), F.desc("tfidf"), F.desc("type_id")).withColumn("rank", (F.col("index") + 1).cast("int")).drop("index")


def keep_top(ranked: DataFrame, n: int) -> DataFrame:
    """V5: the n best terms, by a top-k instead of a global sort."""
    return ranked.orderBy(F.desc("tfidf"), F.desc("type_id")).limit(n)


def prune_rare(stats: DataFrame, threshold: int) -> DataFrame:
    """V7: terms with at least ``threshold`` occurrences."""
    return stats.where(F.col("tf") >= threshold)


def restrict(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens whose term is in a frozen vocabulary; positions are kept."""
    return tokens.join(vocabulary.select("term"), "term", "left_semi").select(*tokens.columns)


def doc_lengths(docs: DataFrame, tokens: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """V8: doc_id, n_tokens, 0 for documents without tokens."""
    n = tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select(F.col(doc_id).alias("doc_id")).join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_tokens"))


def corpus_arrays(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """V8: doc_id, types: the type ids of each document in order."""
    return tokens.join(ids, "term").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type_id"))), lambda x: x["type_id"]).alias("types"))


def postings(tokens: DataFrame) -> DataFrame:
    """Term, doc_id, tf, the sparse inverted index."""
    return tokens.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def doc_words(docs: DataFrame, tokens: str = "t") -> DataFrame:
    """V9 as a row for each document: doc_id, terms (distinct), tfs, counted inside the batch; for ids that are unique."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column(1).flatten().dictionary_encode()
                row, size = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy(zero_copy_only=False)), max(len(flat.dictionary), 1)
                cell, n = np.unique(row * size + flat.indices.to_numpy(), return_counts=True)
                starts = pa.array(np.searchsorted(cell, np.arange(b.num_rows + 1) * size), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(starts, flat.dictionary.take(pa.array(cell % size))), pa.ListArray.from_arrays(starts, pa.array(n, pa.int64()))], names=["doc_id", "terms", "tfs"])

    return docs.where(F.col(tokens).isNotNull()).select("doc_id", tokens).mapInArrow(run, "doc_id long, terms array<string>, tfs array<long>")


def corpus_totals(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """V9: n_docs, n_tokens, n_types, avg_doc_len (0 without documents)."""
    per = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_types"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).join(per, how="full", on=F.lit(True)).select("n_docs", "n_tokens", "n_types", F.when(F.col("n_docs") == 0, 0.0).otherwise(F.col("n_tokens") / F.col("n_docs")).alias("avg_doc_len"))


def cumulative_mass(stats: DataFrame, ids: DataFrame) -> DataFrame:
    """Term, type_id, tf, rank, mass: types by falling frequency (ties by type id) and the share of tokens so far."""
    numbered = in_order(stats.join(ids, "term").select("term", "type_id", "tf"), F.desc("tf"), "type_id", running={"tf": "so_far"})
    whole = stats.agg(F.sum("tf").alias("whole"))
    return numbered.join(F.broadcast(whole), F.lit(True)).select("term", "type_id", "tf", (F.col("index") + 1).cast("int").alias("rank"), (F.col("so_far") / F.col("whole")).alias("mass"))


def rare_sweep(stats: DataFrame, thresholds: tuple[int, ...] = (0, 10, 100, 200, 500, 1000, 2000)) -> DataFrame:
    """Threshold, vocabulary, corpus_tokens, in one pass over the vocabulary."""
    sums = [x for t in thresholds for x in (F.sum(F.when(F.col("tf") >= t, 1).otherwise(0)).alias(f"v{t}"), F.sum(F.when(F.col("tf") >= t, F.col("tf")).otherwise(0)).alias(f"c{t}"))]
    row = F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(f"v{t}", F.lit(0)).cast("long").alias("vocabulary"), F.coalesce(f"c{t}", F.lit(0)).cast("long").alias("corpus_tokens")) for t in thresholds])
    return stats.agg(*sums).select(F.explode(row).alias("x")).select("x.*")


def adjacent_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer=T.tokens) -> DataFrame:
    """V13 from texts: w1, w2, n; pairs are made inside the token array, so only pair counts are shuffled."""
    t = docs.where(F.col(text).isNotNull()).select(tokenizer(text).alias("t"))
    pairs = F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("w1"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("w2"))
    return t.select(F.explode(pairs).alias("p")).groupBy(F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(tokens: DataFrame) -> DataFrame:
    """V13 from a token table: w1, w2, n: how often w2 directly follows w1 in a document."""
    after = F.lead("term").over(Window.partitionBy("doc_id").orderBy("pos"))
    return tokens.select(F.col("term").alias("w1"), after.alias("w2")).where("w2 IS NOT NULL").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def symmetric_cooccurrence(pairs: DataFrame) -> DataFrame:
    """w1 <= w2 and the sum of both directions."""
    return pairs.groupBy(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).agg(F.sum("n").alias("n"))


def normalised_cooccurrence(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """w1, w2, score for both orders of each pair: the forward count, else the swapped one, over the count of w1."""
    both = pairs.select("w1", "w2", F.col("n").alias("forward"), F.lit(None).cast("long").alias("swapped")).unionAll(pairs.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), F.lit(None).cast("long"), F.col("n")))
    one = both.groupBy("w1", "w2").agg(F.coalesce(F.max("forward"), F.max("swapped")).alias("n"))
    return one.join(stats.select(F.col("term").alias("w1"), "tf"), "w1").select("w1", "w2", (F.col("n") / F.col("tf")).alias("score"))


def adjacent_scores(docs: DataFrame, counts: DataFrame, text: str = "text", tokenizer=T.tokens) -> DataFrame:
    """V14 from texts, for the words w1 in ``counts`` (term, tf): both directions of a pair are counted under one key, so there is one shuffle.

    ``counts`` is counted: up to 500,000 words are broadcast, beyond it the scores are joined.
    """
    t = docs.where(F.col(text).isNotNull()).select(tokenizer(text).alias("t"))
    pairs = F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))
    n = lambda held: F.nullif(F.count(F.when(held, 1)), F.lit(0))
    one = t.select(F.explode(pairs).alias("p")).groupBy(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).agg(n(F.col("p.a") <= F.col("p.b")).alias("forward"), n(F.col("p.a") > F.col("p.b")).alias("swapped"))
    way = lambda a, b, n, other: F.struct(F.col(a).alias("w1"), F.col(b).alias("w2"), F.coalesce(n, other).alias("n"))
    ways = F.array(way("a", "b", "forward", "swapped"), way("b", "a", "swapped", "forward"))
    both = one.select(F.explode(F.slice(ways, 1, F.when(F.col("a") == F.col("b"), 1).otherwise(2))).alias("x")).select("x.*")
    words = materialize(counts.select(F.col("term").alias("w1"), "tf"), "counts")
    return both.join(F.broadcast(words) if words.count() <= 500_000 else words, "w1").select("w1", "w2", (F.col("n") / F.col("tf")).alias("score"))


def common_words(a: Column, b: Column) -> Column:
    """The distinct words of both token arrays, sorted."""
    return F.array_sort(F.array_intersect(a, b))
