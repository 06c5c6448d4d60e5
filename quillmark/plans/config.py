"""Configuration (G1-G6): a properties file with global keys and ``[section]`` overrides, over typed defaults.

Command-line values win over the section, the section over the global keys, these over the defaults.
"""

from __future__ import annotations

import argparse
import time
import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path

TRUE = ("true", "yes", "1")
#: Keys that steer threads, progress or debug output of a single machine; Spark schedules by itself.
NO_EFFECT = ("batches", "topic_batches", "results_size", "debug", "print_phi", "measure_timing", "show_progress_bar", "document_sampler_split_limit", "alias_poisson_threshold", "start_diagnostic", "original_dataset")
# Class names of phi builders in configuration files, and our draws.
PHI_BUILDERS = {"": None, "dirichlet": "dirichlet", "polya_urn": "polya_urn", "DefaultSparseDirichletSamplerBuilder": "dirichlet", "PolyaUrnFixedCoeffPoissonDirichletSamplerBuilder": "polya_urn"}


@dataclass
class Config:
    """Every key with its default; keys keep the names that configuration files use (``lambda`` is ``lambda_``)."""

    dataset: str = ""
    test_dataset: str = ""
    original_dataset: str = ""
    scheme: str = "polyaurn"
    sampler_class: str = ""
    iteration_callback_class: str = ""
    topics: int = 10
    alpha: float = 5.0
    beta: float = 0.01
    iterations: int = 1500
    batches: int = 4
    topic_batches: int = 3
    rare_threshold: int = 0
    tfidf_vocab_size: int = -1
    topic_interval: int = 10
    start_diagnostic: int = 500
    seed: int = 0
    debug: int = 0
    print_phi: bool = False
    measure_timing: bool = False
    results_size: int = 1
    batch_building_scheme: str = "even_split"
    topic_batch_building_scheme: str = "even_split"
    topic_index_building_scheme: str = "all"
    sub_topic_index_builders: list[str] = field(default_factory=list)
    percentage_split_size_doc: float = 1.0
    percentage_split_size_topic: float = 1.0
    fixed_split_size_doc: list[float] = field(default_factory=list)
    percent_top_tokens: float = 0.2
    proportional_ib_skip_step: int = 10
    instability_period: int = 0
    full_phi_period: int = 0
    dn_diagnostic_interval: list[int] = field(default_factory=list)
    print_ndocs_interval: list[int] = field(default_factory=list)
    print_ndocs_cnt: int = 0
    print_ntopwords_interval: list[int] = field(default_factory=list)
    print_ntopwords_cnt: int = 0
    log_type_topic_density: bool = False
    log_document_density: bool = False
    log_phi_density: bool = False
    log_tokens_per_topic: bool = False
    log_topic_indicators: bool = False
    topic_indicator_logging_format: str = "standard"
    experiment_out_dir: str = ""
    base_out_dir: str = "runs"
    variable_selection_prior: float = 0.5
    topic_prior_filename: str = ""
    document_prior_filename: str = ""
    stoplist: str = "stoplist.txt"
    keep_numbers: bool = False
    keep_connecting_punctuation: bool = False
    no_preprocess: bool = False
    max_doc_buf_size: int = 10_000
    file_regex: str = r".*\.txt$"
    save_doc_topic_means: bool = False
    doc_topic_mean_filename: str = "doc_topic_means"
    save_doc_topic_diagnostics: bool = False
    doc_topic_diagnostics_filename: str = "doc_topic_diagnostics"
    save_doc_theta_estimate: bool = False
    doc_topic_theta_filename: str = "doc_topic_theta"
    save_phi_mean: bool = False
    save_phi_means: bool = False
    phi_mean_filename: str = "phi_means"
    phi_mean_burnin: int = 0
    phi_mean_thin: int = 1
    save_vocabulary: bool = False
    vocabulary_filename: str = "vocabulary"
    save_term_frequencies: bool = False
    term_frequencies_filename: str = "term_frequencies"
    save_doc_lengths: bool = False
    doc_lengths_filename: str = "doc_lengths"
    save_corpus: bool = False
    corpus_filename: str = "corpus"
    save_sampler: bool = False
    saved_sampler_dir: str = "saved_samplers"
    nr_top_words: int = 20
    lambda_: float = 0.6
    hyperparam_optim_interval: int = -1
    symmetric_alpha: bool = False
    hdp_gamma: float = 1.0
    hdp_nr_start_topics: int = 1
    hdp_k_percentile: float = 0.8
    document_sampler_split_limit: int = 100
    sparse_dirichlet_sampler_builder_name: str = ""
    alias_poisson_threshold: int = 100
    test_ids_filename: str = ""
    no_runs: int = 1
    show_progress_bar: bool = False

    def __post_init__(self) -> None:
        """Keys that can't be honoured are refused; keys without an effect here are named in a warning."""
        if self.sampler_class:
            raise ValueError("sampler_class: samplers are chosen by scheme")
        default = {f.name: f.default for f in fields(self)}
        idle = [k for k in NO_EFFECT if getattr(self, k) != default[k]]
        if idle:
            warnings.warn(f"keys without effect: {', '.join(idle)}", stacklevel=3)
        self.phi_builder()

    def phi_builder(self) -> str | None:
        """The draw of phi that ``sparse_dirichlet_sampler_builder_name`` names, None for the scheme's own."""
        last = self.sparse_dirichlet_sampler_builder_name.strip().rsplit(".", 1)[-1]
        if last not in PHI_BUILDERS:
            raise ValueError(f"sparse_dirichlet_sampler_builder_name = {last}: known are {', '.join(PHI_BUILDERS)}")
        return PHI_BUILDERS[last]

    def run_seed(self) -> int:
        """0 and -1 mean a seed from the clock (Q19)."""
        return self.seed if self.seed not in (0, -1) else time.time_ns() % (1 << 31)


def as_bool(text: str | None, default: bool = False) -> bool:
    """True, yes and 1 are true; a missing value is the default (Q21)."""
    return default if text is None or not text.strip() else text.strip().lower() in TRUE


def parse_properties(text: str) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Global keys and sections. ``#`` and ``;`` start comment lines; ``key = value`` or ``key : value``."""
    top: dict[str, str] = {}
    sections: dict[str, dict[str, str]] = {}
    into = top
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#;!":
            continue
        if line.startswith("[") and line.endswith("]"):
            into = sections.setdefault(line[1:-1].strip(), {})
            continue
        cut = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=-1)
        if cut >= 0:
            into[line[:cut].strip()] = line[cut + 1 :].strip()
    return top, sections


def _typed(name: str, kind: str, raw: str):
    kind = str(kind)
    if kind == "bool":
        return as_bool(raw)
    if kind.startswith("list"):
        items = [x.strip() for x in raw.split(",") if x.strip()]
        to = {"list[float]": float, "list[int]": int}.get(kind, str)
        return [to(x) for x in items]
    try:
        return {"int": int, "float": float}.get(kind, str)(raw)
    except ValueError:
        raise ValueError(f"{name} = {raw!r} is no {kind}") from None


def build(values: dict[str, str]) -> Config:
    """A configuration from raw values; unknown keys are left out."""
    known = {("lambda" if f.name == "lambda_" else f.name): f for f in fields(Config)}
    return Config(**{known[k].name: _typed(k, known[k].type, v) for k, v in values.items() if k in known})


def load(path: str, overrides: dict[str, str] | None = None) -> dict[str, Config]:
    """All configurations of a file, with overrides on top."""
    return load_text(Path(path).read_text(), overrides)


def load_text(text: str, overrides: dict[str, str] | None = None) -> dict[str, Config]:
    """All configurations named by ``configs`` (or the one global one), with overrides on top."""
    top, sections = parse_properties(text)
    names = [x.strip() for x in top.get("configs", "").split(",") if x.strip()] or list(sections)
    overrides = overrides or {}
    if not names:
        return {"default": build(top | overrides)}
    return {n: build(top | sections.get(n, {}) | overrides) for n in names}


def from_arguments(args: list[str]) -> dict[str, Config]:
    """``--run_cfg FILE`` and any ``--key value`` or ``--key=value``."""
    p = argparse.ArgumentParser(prog="quillmark", allow_abbrev=False)
    p.add_argument("--run_cfg")
    for f in fields(Config):
        p.add_argument("--lambda" if f.name == "lambda_" else f"--{f.name}", dest=f.name)
    got = {k: v for k, v in vars(p.parse_args(args)).items() if v is not None}
    path = got.pop("run_cfg", None)
    raw = {("lambda" if k == "lambda_" else k): v for k, v in got.items()}
    return load(path, raw) if path else {"default": build(raw)}
