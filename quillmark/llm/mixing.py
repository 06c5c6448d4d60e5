"""Problem 8: mixing sources to target weights by Poisson replication.

Every record has a hash-seeded uniform u for each mix. The mean at which the Poisson distribution's
inverse at u reaches k is its k-th critical mean, so a record is drawn as often as it has critical
means below its source's mean rate. Rates are set where the drawn tokens of the source come nearest
to its share: critical means are added up in narrow logarithmic buckets, which bounds what is sorted
by the number of sources. As records are whole, what is drawn misses the goal by a part of a record;
in each of ``ROUNDS`` rounds the one record of a source whose size comes nearest to what is missing is
used once more, or once less. Chosen records are exploded by their counts and shuffled globally.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators.storage import materialize

#: The setting that names a byte-level BPE vocabulary in rank format, and where it is looked for if unset; read on the driver only.
VOCABULARY_KEY, VOCABULARY = "quillmark.tokenizer.vocabulary", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern of that tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEADROOM = 0.9
ROUNDS = 3
STEPS = 400  # buckets for each factor e of a mean rate: a bucket is 0.25 % wide


def _counter(lines) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.value)}
        enc = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(x)) if isinstance(x, str) else 0 for x in s], dtype="int64")

    return run


def with_token_counts(df: DataFrame, text: str = "text", vocabulary: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each whole text; null texts have 0. The vocabulary file (about 1 MB) is broadcast.

    Write the result before filtering on it: a filter on ``out`` would be computed apart, by a second tokenisation.
    """
    with open(vocabulary or df.sparkSession.conf.get(VOCABULARY_KEY, VOCABULARY), "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read().splitlines())
    return df.withColumn(out, F.pandas_udf(_counter(lines), "long")(F.col(text)))


def critical_means(u: np.ndarray, most: int) -> np.ndarray:
    """Row k - 1: the mean at which a Poisson draw by inversion at u reaches k, for k = 1 .. most."""
    out = np.zeros((most, len(u)))
    target = np.clip(u, 1e-15, 1 - 1e-15)
    for k in range(1, most + 1):
        low, high = np.zeros(len(u)), np.full(len(u), k + 60.0 + 12 * np.sqrt(k))
        for _ in range(60):
            m = (low + high) / 2
            term, total = np.exp(-m), np.exp(-m)
            for i in range(1, k):
                term = term * m / i
                total = total + term
            above = total > target  # the chance of fewer than k is still above u: the mean is too low
            low, high = np.where(above, m, low), np.where(above, high, m)
        out[k - 1] = (low + high) / 2
    return out


def _critical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = []
        for most, g in pdf.groupby("max_repeats", sort=False):
            c = critical_means(g["u"].to_numpy(), int(most))
            b = np.floor(np.log(np.maximum(c, 1e-12)) * STEPS).astype(np.int64)
            g = g[["mix_name", "source", "doc_id", "n_tokens"]].copy()
            g["buckets"] = list(np.sort(b, axis=0).T)
            parts.append(g)
        yield pd.concat(parts) if parts else pd.DataFrame({"mix_name": [], "source": [], "doc_id": [], "n_tokens": [], "buckets": []})


class Mixture:
    """The draws of every mix: ``selection`` has one row for each use of a record, ``shares`` what was reached.

    The total of a mix is the largest at which every source that has tokens can reach its share with
    a mean of at most ``HEADROOM`` times its cap, unless ``total_tokens`` states it; a source that
    can't reach its share is then used to its cap. Sources without documents, null sources, and
    records without a token contribute nothing. Rows that share an id are drawn alike. A null or
    non-positive cap or share means that the source isn't used. Only sources of the targets are read.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, vocabulary: str | None = None, total_tokens: int | None = None) -> None:
        self.targets = targets.select("mix_name", "source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        used = self.targets.where("source IS NOT NULL AND max_repeats > 0 AND target_share > 0")
        docs = documents.where(F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
        self.sized = materialize(with_token_counts(docs, "text", vocabulary).select("doc_id", "source", "n_tokens"), "sized").where("n_tokens > 0")
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_name", "doc_id"), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        drawn = self.sized.join(used, "source").select("mix_name", "source", "doc_id", "n_tokens", "max_repeats", u.alias("u"))
        self.critical = materialize(drawn.mapInPandas(_critical, "mix_name string, source string, doc_id long, n_tokens long, buckets array<long>"), "critical")
        size = self.sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
        goal = used.join(size, "source")
        reach = F.col("available") * F.col("max_repeats") * HEADROOM / F.col("target_share")
        total = goal.groupBy("mix_name").agg(F.floor(F.min(reach)).alias("total")) if total_tokens is None else goal.groupBy("mix_name").agg(F.lit(total_tokens).cast("long").alias("total"))
        goal = goal.join(total, "mix_name").select("mix_name", "source", (F.col("target_share") * F.col("total")).alias("goal"))
        mass = self.critical.select("mix_name", "source", "n_tokens", F.explode("buckets").alias("b")).groupBy("mix_name", "source", "b").agg(F.sum("n_tokens").alias("t"))
        run = Window.partitionBy("mix_name", "source").orderBy("b")
        cuts = mass.withColumn("reached", F.sum("t").over(run)).join(goal, ["mix_name", "source"])
        off = F.abs(F.col("reached") - F.col("goal"))
        best = cuts.groupBy("mix_name", "source").agg(F.min_by("b", F.struct(off, F.col("b"))).alias("b"), F.min(off).alias("off"), F.min("goal").alias("goal"))
        # a source may be nearest to its goal when nothing of it is drawn
        self.rates = materialize(best.select("mix_name", "source", F.when(F.col("goal") < F.col("off"), F.lit(-(1 << 40))).otherwise(F.col("b")).alias("cut")), "rates")
        drawn = self.critical.join(self.rates, ["mix_name", "source"]).select("mix_name", "source", "doc_id", "n_tokens", F.size("buckets").alias("most"), F.size(F.filter("buckets", lambda x: x <= F.col("cut"))).alias("repeats"))
        self.counts = self._evened(drawn, goal).where("repeats > 0").drop("most")
        each = self.counts.select("mix_name", "doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"))
        place = F.xxhash64(F.lit(seed + 1), "mix_name", "doc_id", "copy")
        self.selection = each.withColumn("place", place).repartitionByRange("mix_name", "place", "doc_id").sortWithinPartitions("mix_name", "place", "doc_id")

    @staticmethod
    def _evened(drawn: DataFrame, goal: DataFrame) -> DataFrame:
        """The draws after ``ROUNDS`` single uses more or less of a source, each only where it brings the source nearer to its goal."""
        goal = materialize(goal, "goals")
        for _ in range(ROUNDS):
            drawn = materialize(drawn, "drawn")
            missing = goal.join(drawn.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("got")), ["mix_name", "source"]).select("mix_name", "source", (F.col("goal") - F.col("got")).alias("missing"))
            steps = F.array(F.when(F.col("repeats") < F.col("most"), F.lit(1)), F.when(F.col("repeats") > 0, F.lit(-1)))
            moves = drawn.join(missing, ["mix_name", "source"]).select("mix_name", "source", "doc_id", "n_tokens", "missing", F.explode(F.array_compact(steps)).alias("step"))
            left = F.abs(F.col("missing") - F.col("step") * F.col("n_tokens"))
            best = moves.groupBy("mix_name", "source").agg(F.min(F.struct(left.alias("left"), "doc_id", "step")).alias("b"), F.first("missing").alias("missing")).where(F.col("b.left") < F.abs("missing"))
            best = best.select("mix_name", "source", F.col("b.doc_id").alias("move_id"), F.col("b.step").alias("step"))
            moved = F.when((F.col("doc_id") == F.col("move_id")), F.col("step")).otherwise(F.lit(0))
            drawn = drawn.join(best, ["mix_name", "source"], "left").select("mix_name", "source", "doc_id", "n_tokens", "most", (F.col("repeats") + moved).alias("repeats"))
        return materialize(drawn, "drawn")

    @property
    def shares(self) -> DataFrame:
        """mix_name, source, target_share, max_repeats, documents, tokens, actual_share, most_repeats for every target row."""
        got = self.counts.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
        whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("whole"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return self.targets.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left").select("mix_name", "source", "target_share", "max_repeats", zero("documents"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), zero("most_repeats"))
