"""Random-scan policies (B1-B12): which documents, topics and types an iteration visits, by name.

A document policy maps (table of doc_id, iteration) to the visited ids, or None for all. A topic policy
maps an iteration, a type policy (iteration, topic-by-type counts, mask of the types whose counts
changed in the last sweep) to indices, or None for all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quillmark.models.draws import without_replacement
from quillmark.operators import classify

Documents = Callable[[DataFrame, int], DataFrame | None]
Topics = Callable[[int], np.ndarray | None]
Types = Callable[[int, np.ndarray, np.ndarray], np.ndarray | None]


def every_document(_: DataFrame, __: int) -> None:
    """B1: all batches of an even split are visited in each iteration, so every document is."""


def every_topic(_: int) -> None:
    """All batches of an even split, so every topic."""


@dataclass(frozen=True)
class Scan:
    documents: Documents = every_document
    topics: Topics = every_topic
    types: Types = lambda i, n, changed: None


# documents ----------------------------------------------------------------------------------------
def percentage_documents(share: float, seed: int) -> Documents:
    """B2: ceil(share * N) documents without replacement, anew in each iteration."""
    return lambda docs, i: classify.percentage_batch(docs, share, seed + i)


def adaptive_documents(share: float, seed: int, instability: int) -> Documents:
    """All documents in the first ``instability`` iterations, then B2."""
    return lambda docs, i: None if i <= instability else classify.percentage_batch(docs, share, seed + i)


def cyclic_documents(fractions: list[float]) -> Documents:
    """The fractions in turn, over a pointer that rolls on through the documents."""
    if not fractions:
        raise ValueError("a fixed split needs fractions")
    return lambda docs, i: classify.fixed_batch(docs, fractions, i - 1)


# topics -------------------------------------------------------------------------------------------
def even_topics(topics: int, parts: int) -> list[np.ndarray]:
    """Topics in nearly equal contiguous parts."""
    return np.array_split(np.arange(topics), parts)


def percentage_topics(topics: int, share: float, seed: int, iteration: int) -> np.ndarray:
    """ceil(share * K) topics without replacement."""
    return without_replacement(np.random.default_rng([seed, iteration, 3]), topics, int(np.ceil(share * topics)))


# types --------------------------------------------------------------------------------------------
def _by_frequency(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts.sum(0), kind="stable")


def all_types() -> Types:
    """B6."""
    return lambda i, n, changed: None


def frequent_types(share: float) -> Types:
    """The ceil(share * V) most frequent types."""
    return lambda i, n, changed: np.sort(_by_frequency(n)[: int(np.ceil(share * n.shape[1]))])


def changed_types(instability: int = 0, full_period: int = 0) -> Types:
    """The types whose counts changed in the last sweep; all while the chain is unstable and in every ``full_period``-th iteration."""

    def pick(i: int, n: np.ndarray, changed: np.ndarray) -> np.ndarray | None:
        return None if i <= instability or (full_period > 0 and i % full_period == 0) else np.flatnonzero(changed)

    return pick


def beta_fraction_types(a: float, b: float, seed: int, anneal: int = 200) -> Types:
    """A Beta(a, b) share of the most frequent types, growing to it from all types over the first iterations."""

    def pick(i: int, n: np.ndarray, changed: np.ndarray) -> np.ndarray:
        share = np.random.default_rng([seed, i, 4]).beta(a, b)
        w = min(i / anneal, 1.0)
        order = _by_frequency(n)
        return np.sort(order[: max(1, int(np.ceil((w * share + 1 - w) * len(order))))])

    return pick


def systematic_types(step: int, seed: int) -> Types:
    """Types in proportion to their frequency, by a walk of ``step`` tokens from a random offset; a type without a token is an error."""

    def pick(i: int, n: np.ndarray, changed: np.ndarray) -> np.ndarray:
        tokens = n.sum(0)
        if step < 1 or (tokens < 1).any():
            raise ValueError("step and counts must be one or more")
        cum = np.cumsum(tokens)
        offset = int(np.random.default_rng([seed, i, 5]).integers(1, step + 1))
        return np.flatnonzero((cum - offset) // step > (cum - tokens - offset) // step)

    return pick


def alternate(*policies: Types) -> Types:
    """One policy after the other, round robin."""
    if not policies:
        raise ValueError("a round robin needs policies")
    return lambda i, n, changed: policies[i % len(policies)](i, n, changed)


# by name ------------------------------------------------------------------------------------------
# Class names under which configuration files ask for a policy, and our short names.
NAMES = {
    "EvenSplitBatchBuilder": "even_split", "PercentageBatchBuilder": "percentage", "AdaptiveBatchBuilder": "adaptive", "FixedSplitBatchBuilder": "fixed_split",
    "EvenSplitTopicBatchBuilder": "even_split", "PercentageTopicBatchBuilder": "percentage", "AllWordsTopicIndexBuilder": "all", "MandelbrotTopicIndexBuilder": "frequent",
    "DeltaNTopicIndexBuilder": "changed", "TopWordsRandomFractionTopicIndexBuilder": "beta_fraction", "ProportionalTopicIndexBuilder": "proportional",
    "MixedMandelbrotDeltaNTopicIndexBuilder": "frequent_and_changed", "MetaTopicIndexBuilder": "meta",
}


def short(name: str) -> str:
    """The short name of a policy, from it or from a class name with or without a package."""
    last = name.strip().rsplit(".", 1)[-1]
    return NAMES.get(last, last)


#: Policies by name, each made from a configuration and the run's seed.
DOCUMENT_POLICIES: dict[str, Callable] = {
    "even_split": lambda c, seed: every_document, "percentage": lambda c, seed: percentage_documents(c.percentage_split_size_doc, seed),
    "adaptive": lambda c, seed: adaptive_documents(c.percentage_split_size_doc, seed, c.instability_period), "fixed_split": lambda c, seed: cyclic_documents(c.fixed_split_size_doc),
}
TOPIC_POLICIES: dict[str, Callable] = {"even_split": lambda c, seed: every_topic, "percentage": lambda c, seed: lambda i: percentage_topics(c.topics, c.percentage_split_size_topic, seed, i)}
TYPE_POLICIES: dict[str, Callable] = {
    "all": lambda c, seed: all_types(), "frequent": lambda c, seed: frequent_types(c.percent_top_tokens), "changed": lambda c, seed: changed_types(c.instability_period, c.full_phi_period),
    "beta_fraction": lambda c, seed: beta_fraction_types(2.0, 5.0, seed), "proportional": lambda c, seed: systematic_types(c.proportional_ib_skip_step, seed),
    "frequent_and_changed": lambda c, seed: alternate(frequent_types(c.percent_top_tokens), changed_types(c.instability_period, c.full_phi_period)),
    "meta": lambda c, seed: alternate(*[_named(TYPE_POLICIES, x, "sub_topic_index_builders")(c, seed) for x in c.sub_topic_index_builders]),
}


def _named(registry: dict[str, Callable], name: str, key: str) -> Callable:
    if short(name) not in registry:
        raise ValueError(f"{key} = {name}: unknown policy, known are {', '.join(sorted(registry))}")
    return registry[short(name)]


def from_config(c, seed: int) -> Scan:
    """The policies that a configuration names; unknown names are errors."""
    return Scan(
        _named(DOCUMENT_POLICIES, c.batch_building_scheme, "batch_building_scheme")(c, seed),
        _named(TOPIC_POLICIES, c.topic_batch_building_scheme, "topic_batch_building_scheme")(c, seed),
        _named(TYPE_POLICIES, c.topic_index_building_scheme, "topic_index_building_scheme")(c, seed),
    )
