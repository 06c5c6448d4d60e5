"""Divergence-based classification, confusion matrices and data splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators.order import in_order


def centroids(zbar: DataFrame, labels: DataFrame, alpha: float) -> DataFrame:
    """Label, topic, p: (sum of the class's z-bar + alpha) / its documents, then made to sum to one.

    ``zbar``: doc_id, topic, zbar on the full grid; ``labels``: doc_id, label. Null labels form no class.
    """
    x = zbar.join(labels.where("label IS NOT NULL"), "doc_id").groupBy("label", "topic").agg(F.sum("zbar").alias("s"), F.count(F.lit(1)).alias("n"))
    raw = x.withColumn("c", (F.col("s") + alpha) / F.col("n"))
    return raw.select("label", "topic", (F.col("c") / F.sum("c").over(Window.partitionBy("label"))).alias("p"))


def classify(zbar: DataFrame, centre: DataFrame, alpha: float) -> DataFrame:
    """doc_id, predicted, score = 1 / symmetric KL to the class; among equal scores the smaller label.

    Documents meet the centroids by topic; classes times topics is small.
    """
    w = Window.partitionBy("doc_id")
    q = zbar.withColumn("q", F.col("zbar") + alpha).withColumn("q", F.col("q") / F.sum("q").over(w)).select("doc_id", "topic", "q")
    ln2 = 0.6931471805599453
    kl = (F.col("p") * F.log(F.col("p") / F.col("q")) + F.col("q") * F.log(F.col("q") / F.col("p"))) / (2 * ln2)
    d = q.join(centre, "topic").groupBy("doc_id", "label").agg(F.round(F.sum(kl), 12).alias("d"))
    best = d.groupBy("doc_id").agg(F.min(F.struct("d", "label")).alias("x"))
    return best.select("doc_id", F.col("x.label").alias("predicted"), (1 / F.greatest(F.col("x.d"), F.lit(1e-12))).alias("score"))


def confusion(predictions: DataFrame) -> DataFrame:
    """C4: truth, predicted, n with totals: a null truth or predicted is the total over it (``level`` tells it from data)."""
    return predictions.cube("truth", "predicted").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def confusion_wide(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """C4 for export: one row for each true class, one column for each predicted one."""
    return predictions.groupBy("truth").pivot("predicted", labels).count().na.fill(0)


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))


def fold(key: Column | str, folds: int, seed: int = 0) -> Column:
    """C3, C6 (Q26): the fold of a row, from its key and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key) if isinstance(key, str) else key), F.lit(folds)).cast("int")


def simple_fold(key: Column | str, folds: int) -> Column:
    """The fold of a numeric key that any engine can repeat."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.pmod(k * 2654435761, F.lit(1 << 32)), F.lit(folds)).cast("int")


def cross_validate(docs: DataFrame, folds: int, train: Callable[[DataFrame], object], test: Callable[[object, DataFrame], DataFrame], key: str = "doc_id", seed: int = 0, retries: int = 3) -> list[DataFrame]:
    """Predictions of each fold, trained on the others; a failing fold is tried again up to ``retries`` times."""
    tagged = docs.withColumn("_fold", fold(key, folds, seed))
    out = []
    for i in range(folds):
        for attempt in range(retries):
            try:
                model = train(tagged.where(F.col("_fold") != i).drop("_fold"))
                out.append(test(model, tagged.where(F.col("_fold") == i).drop("_fold")))
                break
            except Exception:
                if attempt + 1 == retries:
                    raise
    return out


def by_corpus(models: dict[str, Callable[[DataFrame], DataFrame]], docs: DataFrame) -> DataFrame:
    """One model for each class; each gives doc_id, score, and the best score wins (the smaller class among ties)."""
    out = None
    for name, score in models.items():
        part = score(docs).withColumn("label", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "label"))["label"].alias("predicted"), F.max("score").alias("score"))


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(train, test): test has the listed ids."""
    return docs.join(ids, key, "left_anti"), docs.join(ids, key, "left_semi")


def perplexity_split(tokens: DataFrame, test_docs: DataFrame) -> DataFrame:
    """Part, doc_id, pos, term: the floor(n / 2) first tokens of a test document in a seeded order are held out, all others train.

    The order is (31 pos + 17 doc_id) mod 1009, then pos, which any engine can repeat.
    """
    w = Window.partitionBy("doc_id").orderBy((F.col("pos") * 31 + F.col("doc_id") * 17) % 1009, "pos")
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    t = tokens.join(test_docs, "doc_id", "left_semi").withColumn("part", F.when(F.row_number().over(w) <= F.floor(n / 2), "test").otherwise("train"))
    rest = tokens.join(test_docs, "doc_id", "left_anti").withColumn("part", F.lit("train"))
    return rest.unionByName(t).select("part", "doc_id", "pos", "term")


def even_batches(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """B1: doc_id, batch (from 1): contiguous batches of nearly equal size in id order."""
    x = in_order(docs.select(key), key, total="size")
    small, more = F.floor(F.col("size") / n), F.col("size") % n  # the first batches have one row more
    long = more * (small + 1)
    batch = F.when(F.col("index") < long, F.floor(F.col("index") / (small + 1))).otherwise(more + F.floor((F.col("index") - long) / F.greatest(small, F.lit(1))))
    return x.select(key, (batch + 1).cast("int").alias("batch"))


def percentage_batch(docs: DataFrame, share: float, seed: int, key: str = "doc_id") -> DataFrame:
    """B2: exactly ceil(share * N) documents without replacement, by a seeded hash order that any engine can repeat (a top-k, no global sort)."""
    import math

    return docs.select(key).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(math.ceil(share * docs.count()))


def adaptive_batch(docs: DataFrame, iteration: int, instability: int, share: float, seed: int, key: str = "doc_id") -> DataFrame:
    """All documents while the chain is unstable, a percentage batch after it."""
    return docs.select(key) if iteration < instability else percentage_batch(docs, share, seed + iteration, key)


def fixed_batch(docs: DataFrame, fractions: list[float], step: int, key: str = "doc_id") -> DataFrame:
    """The batch of a step of a cyclic list of fractions; a rolling pointer, which starts at the second document, wraps around."""
    n = docs.count()
    start = 1 + sum(int(fractions[i % len(fractions)] * n) for i in range(step))
    size = int(fractions[step % len(fractions)] * n)
    return in_order(docs.select(key), key).where(F.pmod(F.col("index") - start, F.lit(max(n, 1))) < size).select(key)
