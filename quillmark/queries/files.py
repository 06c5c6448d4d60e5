"""Queries of sources, sinks and configuration: tables go out to files in the shared folder and come back.

``docs`` and ``documents`` are written in whole; archives, directory trees and in-memory texts are made of
``eval_items``, which doesn't grow.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import topics as K
from quillmark.operators import vectors, vocab
from quillmark.operators.storage import remove_later, shared_folder, write_bytes
from quillmark.plans import config, programs
from quillmark.queries import text as TQ
from quillmark.queries import topic as PQ
from quillmark.queries.base import table
from quillmark.sources import loaders, sinks

#: Characters that end a line or that the two engines class differently; they are written as a blank.
BREAKS = "[\\x09-\\x0D\\x1C-\\x1F\\x85\\u2028\\u2029]"
_WHITE = "[" + "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 0x85, 0x2028, 0x2029))) + "]"


def _at(s: SparkSession, name: str) -> str:
    folder = f"{shared_folder(s)}/quillmark/files-{uuid.uuid4().hex}"
    remove_later(s, folder)
    return f"{folder}/{name}"


def _clean(c: str):  # noqa: ANN202
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), BREAKS, " ")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "docs").select("doc_id", F.concat_ws("\t", _clean("name"), _clean("label"), _clean("data")).alias("value"))


def _written(s: SparkSession, d: str, **options: str) -> str:
    """``docs`` as line files, in order of doc_id over several files."""
    path = _at(s, "docs")
    rows = _lines(s, d).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select("value")
    rows.write.options(**options).text(path)
    return path


def _items(s: SparkSession, d: str) -> list:
    return table(s, d, "eval_items").orderBy("item_id").select("item_id", "task", F.regexp_replace("text", BREAKS, " ").alias("text")).collect()


def read_lines(s: SparkSession, d: str) -> DataFrame:
    """Documents are numbered by line."""
    return loaders.read_documents(s, _written(s, d))


def read_gzip(s: SparkSession, d: str) -> DataFrame:
    """S5."""
    return loaders.read_documents(s, _written(s, d, compression="gzip"))


def read_zip(s: SparkSession, d: str) -> DataFrame:
    """S5, S6."""
    body = "\n".join(f"{r.item_id}\t{r.task}\t{r.text}" for r in _items(s, d))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("items.txt", body)
    path = _at(s, "items.zip")
    write_bytes(s, path, out.getvalue())
    return loaders.read_documents(s, path)


def load_pruned(s: SparkSession, d: str) -> DataFrame:
    """Vocabulary of the line files after rare words are pruned."""
    c = config.Config(dataset=_written(s, d), rare_threshold=5, stoplist="")
    docs = loaders.read_documents(s, c.dataset)
    return loaders.corpus_of(s, docs, c)[1]


def load_kept(s: SparkSession, d: str) -> DataFrame:
    """Tokens of each document that are among the 100 best words."""
    c = config.Config(tfidf_vocab_size=100, stoplist="")
    docs = loaders.read_documents(s, _written(s, d))
    return loaders.corpus_of(s, docs, c)[0].select("doc_id", F.size("types").alias("n"))


def load_raw(s: SparkSession, d: str) -> DataFrame:
    """Case and signs are kept."""
    docs = loaders.read_documents(s, _written(s, d))
    return loaders.tokenise(docs, raw=True).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def read_tree(s: SparkSession, d: str) -> DataFrame:
    """One file for each document, its folder as label, by a pattern of paths."""
    path = _at(s, "tree")
    for r in _items(s, d):
        write_bytes(s, f"{path}/{r.task}/{r.item_id}.txt", r.text.encode())
        write_bytes(s, f"{path}/{r.task}/{r.item_id}.bak", b"left out")
    return loaders.read_directory(s, path).select(F.regexp_extract("name", r"(\d+)\.txt$", 1).cast("long").alias("item_id"), "label", "text")


def in_memory(s: SparkSession, d: str) -> DataFrame:
    """S8, S10."""
    r = _items(s, d)
    return loaders.from_strings(s, [x.text for x in r], [x.task for x in r], [str(x.item_id) for x in r])


def pipe(s: SparkSession, d: str) -> DataFrame:
    """Numbers are kept, a stoplist file is applied; its blank lines and the missing list are empty."""
    path = _at(s, "stoplist.txt")
    write_bytes(s, path, "\n\n".join(TQ.STOPWORDS).encode())
    missing = loaders.read_stoplist(s, _at(s, "none.txt"))
    tokens = loaders.tokenise(TQ._docs(s, d), keep_numbers=True, stoplist=loaders.read_stoplist(s, path).unionByName(missing))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def text_matrix(s: SparkSession, d: str) -> DataFrame:
    """The topic distributions as a text matrix and back."""
    path = _at(s, "matrix")
    sinks.write_matrix(table(s, d, "doc_topics").where("theta IS NOT NULL"), path, "doc_id", "theta")
    return loaders.read_matrix(s, path)


def binary_matrix(s: SparkSession, d: str) -> DataFrame:
    """Tokens of each topic and of each remainder of the type id, as a binary matrix and back."""
    got = PQ._ttc(s, d).groupBy("topic", (F.col("type_id") % 20).alias("c")).agg(F.sum("n").alias("n")).collect()
    m = np.zeros((PQ.TOPICS, 20))
    for r in got:
        m[r.topic, r.c] = r.n
    path = _at(s, "matrix.bin")
    write_bytes(s, path, sinks.matrix_bytes(m))
    return loaders.read_binary_matrix(s, path, PQ.TOPICS, 20).select("row", F.posexplode("values").alias("col", "value"))


def indicators(s: SparkSession, d: str) -> DataFrame:
    """Topics of each document as lines and back."""
    path = _at(s, "z")
    sinks.write_indicators(PQ._assign(s, d), path)
    return loaders.read_indicators(s, path)


def indicator_log(s: SparkSession, d: str) -> DataFrame:
    """O2: one line for each token."""
    path = _at(s, "z-log")
    sinks.write_indicators(PQ._assign(s, d), path, "long", PQ._vocab(s, d))
    return s.read.text(path).withColumnRenamed("value", "line")


def vocabulary_file(s: SparkSession, d: str) -> DataFrame:
    """The vocabulary in order of its ids, one term a line."""
    path = _at(s, "vocabulary")
    sinks.write_vocabulary(TQ._ids(s, d), path)
    return loaders.read_vocabulary(s, path)


def tables_written(s: SparkSession, d: str) -> DataFrame:
    """Tokens of each topic as CSV with a header."""
    path = _at(s, "tokens")
    sinks.write_csv(K.tokens_per_topic(PQ._ttc(s, d)), path)
    return s.read.option("header", True).schema("topic int, tokens long").csv(path)


def top_words_file(s: SparkSession, d: str) -> DataFrame:
    """O4, K9."""
    path = _at(s, "top")
    sinks.write_table(PQ.topic_lines(s, d), path)
    return s.read.parquet(path)


def svmlight_file(s: SparkSession, d: str) -> DataFrame:
    """One line for each document, in order."""
    path = _at(s, "svmlight")
    sinks.write_svmlight(vocab.corpus_arrays(TQ._tokens(s, d), TQ._ids(s, d)), path)
    return loaders.numbered_lines(s, path).select("index", F.col("value").alias("line"))


def metrics_log(s: SparkSession, d: str) -> DataFrame:
    """A tab-separated log of figures and back."""
    rows = [{"iteration": r.rank, "share": r.mass} for r in TQ.topic_mass_report(s, d).collect()]
    path = _at(s, "stats.txt")
    sinks.write_log(s, rows, path)
    return s.read.option("header", True).option("sep", "\t").schema("iteration int, share double").csv(path)


def run_directory(s: SparkSession, d: str) -> DataFrame:
    """What a run directory says of its settings, and which files it holds."""
    c = config.Config(topics=7, alpha=0.5, dataset="docs")
    run = sinks.Run(s, _at(s, "runs"), "test", vars(c))
    run.timed("sampling", 1.5)
    run.finish()
    note = json.loads("".join(r.value for r in s.read.text(f"{run.path}/manifest.json").collect()))
    times = json.loads("".join(r.value for r in s.read.text(f"{run.path}/timings.json").collect()))
    return s.createDataFrame([("topics", str(note["settings"]["topics"])), ("alpha", str(note["settings"]["alpha"])), ("dataset", note["settings"]["dataset"]), ("sampling", str(times["sampling"])), ("total", str("total" in times))], "key string, value string")


def delta_dump(s: SparkSession, d: str) -> DataFrame:
    """The counts that changed, under the iteration's folder."""
    a = PQ._assign(s, d)
    before = K.type_topic_counts(a.withColumn("topic", ((F.col("doc_id") * 7 + F.col("pos") * 13) % PQ.TOPICS).cast("int")))
    path = _at(s, "delta")
    sinks.write_delta(before, K.type_topic_counts(a), path, 12)
    return s.read.parquet(path)


# configuration ------------------------------------------------------------------------------------
def _config_text(s: SparkSession, d: str) -> str:
    rows = table(s, d, "lda_configs").orderBy("config_name").collect()
    body = ["# runs of the table", "configs = " + ", ".join(r.config_name for r in rows), "topics = 3", "beta = 0.5", "keep_numbers = yes", "no_preprocess = no", "save_corpus : 1"]
    for r in rows:
        body += [f"[{r.config_name}]", f"dataset = {r.dataset_filename}", f"test_dataset = {r.test_dataset_filename or ''}", f"scheme = {r.scheme}", f"topics = {r.no_topics}", f"alpha = {r.alpha!r}", f"iterations = {r.iterations}", f"seed = {r.seed}", f"rare_threshold = {r.rare_threshold}", "unknown_key = 1"]
    return "\n".join(body)


def _rows_of(s: SparkSession, got: dict[str, config.Config]) -> DataFrame:
    rows = [(n, c.dataset, c.test_dataset, c.scheme, c.topics, c.alpha, c.beta, c.iterations, c.seed, c.rare_threshold, c.keep_numbers, c.no_preprocess, c.save_corpus) for n, c in got.items()]
    return s.createDataFrame(rows, "config_name string, dataset string, test_dataset string, scheme string, topics int, alpha double, beta double, iterations int, seed int, rare_threshold int, keep_numbers boolean, no_preprocess boolean, save_corpus boolean")


def config_file(s: SparkSession, d: str) -> DataFrame:
    """Sections over global keys over defaults."""
    return _rows_of(s, config.load_text(_config_text(s, d)))


def config_command_line(s: SparkSession, d: str) -> DataFrame:
    """The command line over everything."""
    return _rows_of(s, config.load_text(_config_text(s, d), {"beta": "0.25", "topics": "11"}))


def config_defaults(s: SparkSession, d: str) -> DataFrame:
    """Some defaults of a configuration made in code."""
    c = config.Config(topics=4)
    return s.createDataFrame([("topics", float(c.topics)), ("alpha", c.alpha), ("beta", c.beta), ("iterations", float(c.iterations)), ("lambda", c.lambda_), ("max_doc_buf_size", float(c.max_doc_buf_size)), ("nr_top_words", float(c.nr_top_words))], "key string, value double")


def document_priors(s: SparkSession, d: str) -> DataFrame:
    """Lines ``pos|id|class, number, topics`` of every document."""
    path = _at(s, "priors")
    word = F.element_at(F.array(F.lit("pos, "), F.lit("id, "), F.lit("Class, "), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    table(s, d, "documents").select(F.concat(word, F.concat_ws(", ", "doc_id", F.col("doc_id") % 10, F.col("doc_id") % 7)).alias("value")).write.text(path)
    return loaders.read_doc_priors(s, path).select("doc_id", F.array_join(F.transform("allowed", lambda x: x.cast("string")), " ").alias("allowed"))


def topic_prior_file(s: SparkSession, d: str) -> DataFrame:
    """Lines ``topic, word, word`` with a comment."""
    path = _at(s, "topics.txt")
    write_bytes(s, path, b"# anchors\n0, harbour, keel\n2, orbit\n\n")
    return loaders.read_topic_priors(s, path)


def tokenizer_choice(s: SparkSession, d: str) -> DataFrame:
    """Tokens of the tokeniser that each setting asks for."""
    docs = TQ._docs(s, d).where("text IS NOT NULL")
    size = lambda *a: F.sum(F.size(T.choose_tokenizer(*a)("text"))).cast("long")
    return docs.agg(size(False, False, False).alias("simple"), size(False, True, False).alias("numeric"), size(True, False, False).alias("raw"), size(False, False, True).alias("connector"))


def too_long_tokens(s: SparkSession, d: str) -> DataFrame:
    """Documents in which a token is longer than a buffer of 14 characters would raise; here they are counted."""
    return TQ._docs(s, d).select("doc_id", F.exists(T.tokens("text"), lambda x: F.length(x) > 14).alias("raises")).where("raises").select("doc_id")


def number_format(s: SparkSession, d: str) -> DataFrame:
    """four decimals of sixteenths, and zero."""
    f = F.udf(vectors.scientific, "string")
    return table(s, d, "doc_topics").select("doc_id", f((F.col("n_tokens") % 4096) / 16.0).alias("text"))


def matrix_lines(s: SparkSession, d: str) -> DataFrame:
    """a matrix of whole numbers as text."""
    got = K.tokens_per_topic(PQ._ttc(s, d)).orderBy("topic").collect()
    body = vectors.matrix_text([[r.topic, r.tokens] for r in got], 8, "|")
    return s.createDataFrame([(x,) for x in body.split("\n")], "line string")


def intervals(s: SparkSession, d: str) -> DataFrame:
    """The iterations of stated intervals, in which programs write tables."""
    return s.range(30).where(F.udf(lambda i: programs.in_intervals(i, [2, 4, 10, 12]), "boolean")("id")).select(F.col("id").alias("iteration"))


QUERIES = {
    "read_lines": read_lines, "read_gzip": read_gzip, "read_zip": read_zip, "load_pruned": load_pruned, "load_kept": load_kept, "load_raw": load_raw, "read_tree": read_tree, "in_memory": in_memory, "pipe_stoplist": pipe,
    "text_matrix": text_matrix, "binary_matrix": binary_matrix, "indicators": indicators, "indicator_log": indicator_log, "vocabulary_file": vocabulary_file, "tables_written": tables_written, "top_words_file": top_words_file,
    "svmlight_file": svmlight_file, "metrics_log": metrics_log, "run_directory": run_directory, "delta_dump": delta_dump, "config_file": config_file, "config_command_line": config_command_line, "config_defaults": config_defaults,
    "document_priors": document_priors, "topic_prior_file": topic_prior_file, "tokenizer_choice": tokenizer_choice, "too_long_tokens": too_long_tokens, "number_format": number_format, "matrix_lines": matrix_lines, "iteration_intervals": intervals,
}

_C = "regexp_replace(coalesce({0}, ''), '" + _WHITE + "', ' ', 'g')"
_LINE = r"'^(\S*)[\s,]*([^\t]+)[\s,]*(.*)$'"
_READ = f"""WITH li AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, {_C.format('name')} || chr(9) || {_C.format('label')} || chr(9) || {_C.format('data')} AS x FROM docs),
rd AS (SELECT doc_id, regexp_extract(x, {_LINE}, 1) AS name, regexp_extract(x, {_LINE}, 2) AS label, regexp_extract(x, {_LINE}, 3) AS text FROM li)"""
_ITEM = "regexp_replace(text, '" + _WHITE + "', ' ', 'g')"
_TOKS = _READ + f", arr AS (SELECT doc_id, {TQ._tok_sql(TQ._LM)} AS t FROM rd), tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM arr), st AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df, min({{'d': doc_id, 'p': pos}}) AS f FROM tok GROUP BY 1)"
_COUNT = lambda e: f"sum(len({e}))::BIGINT"
_CONFIG = "SELECT config_name, dataset_filename AS dataset, coalesce(test_dataset_filename, '') AS test_dataset, scheme, {t} AS topics, alpha, {b}::DOUBLE AS beta, iterations, seed, rare_threshold, TRUE AS keep_numbers, FALSE AS no_preprocess, TRUE AS save_corpus FROM lda_configs"

SQL = {
    "read_lines": _READ + " SELECT * FROM rd",
    "read_gzip": _READ + " SELECT * FROM rd",
    "read_zip": f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS doc_id, regexp_extract(x, {_LINE}, 1) AS name, regexp_extract(x, {_LINE}, 2) AS label, regexp_extract(x, {_LINE}, 3) AS text FROM (SELECT item_id, item_id || chr(9) || task || chr(9) || {_ITEM} AS x FROM eval_items)",
    "load_pruned": _TOKS + " SELECT (row_number() OVER (ORDER BY f) - 1)::INT AS type_id, term FROM st WHERE tf >= 5",
    "load_kept": _TOKS + ", ids AS (SELECT *, row_number() OVER (ORDER BY f) AS i FROM st), best AS (SELECT term FROM ids ORDER BY tf * ln((SELECT count(*) FROM rd) / df) DESC, i DESC LIMIT 100) SELECT rd.doc_id, count(best.term)::INT AS n FROM rd LEFT JOIN tok USING (doc_id) LEFT JOIN best USING (term) GROUP BY 1",
    "load_raw": _READ + f", t AS (SELECT unnest({TQ._RAW}) AS term FROM rd) SELECT term, count(*) AS n FROM t GROUP BY 1",
    "read_tree": f"SELECT item_id, task AS label, {_ITEM} AS text FROM eval_items",
    "in_memory": f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS doc_id, item_id::VARCHAR AS name, task AS label, {_ITEM} AS text FROM eval_items",
    "pipe_stoplist": TQ.with_tokens(TQ._tok_sql(TQ._LM + r"\p{Nd}")) + f" SELECT term, count(*) AS n FROM tok WHERE term NOT IN ({TQ._STOP}) GROUP BY 1",
    "text_matrix": "SELECT r AS row, generate_subscripts(theta, 1)::INT - 1 AS col, unnest(theta) AS value FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r, theta FROM doc_topics WHERE theta IS NOT NULL)",
    "binary_matrix": PQ._A + ", g AS (SELECT topic AS row, c::INT AS col FROM ks, (SELECT unnest(range(20)) AS c)) SELECT g.row::BIGINT AS row, g.col, coalesce(sum(n), 0)::DOUBLE AS value FROM g LEFT JOIN ttc ON ttc.topic = g.row AND ttc.type_id % 20 = g.col GROUP BY 1, 2",
    "indicators": PQ._A + " SELECT dense_rank() OVER (ORDER BY doc_id) - 1 AS doc, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, topic FROM assign",
    "indicator_log": PQ._A + " SELECT doc_id || ' NA ' || pos || ' ' || type_id || ' ' || term || ' ' || topic AS line FROM assign JOIN vocab USING (type_id)",
    "vocabulary_file": TQ._IDS + " SELECT type_id, term FROM ids",
    "tables_written": PQ._A + " SELECT topic, tokens FROM tp",
    "top_words_file": PQ.SQL["topic_lines"],
    "svmlight_file": TQ._IDS + ", ar AS (SELECT doc_id, list(type_id ORDER BY pos) AS a FROM tok JOIN ids USING (term) GROUP BY 1) SELECT row_number() OVER (ORDER BY doc_id) - 1 AS \"index\", len(a) || ' ' || array_to_string(list_transform(a, lambda x: x || ':1'), ' ') AS line FROM ar",
    "metrics_log": TQ._CUM + " SELECT rank AS iteration, mass AS share FROM cm WHERE rank % 50 = 0",
    "run_directory": "SELECT * FROM (VALUES ('topics', '7'), ('alpha', '0.5'), ('dataset', 'docs'), ('sampling', '1.5'), ('total', 'True')) t(key, value)",
    "delta_dump": f"SELECT *, 12 AS iteration FROM ({PQ.SQL['count_delta']})",
    "config_file": _CONFIG.format(t="no_topics", b="0.5"),
    "config_command_line": _CONFIG.format(t="11", b="0.25"),
    "config_defaults": "SELECT * FROM (VALUES ('topics', 4::DOUBLE), ('alpha', 5), ('beta', 0.01), ('iterations', 1500), ('lambda', 0.6), ('max_doc_buf_size', 10000), ('nr_top_words', 20)) t(key, value)",
    "document_priors": "SELECT doc_id, (doc_id % 10) || ' ' || (doc_id % 7) AS allowed FROM documents",
    "topic_prior_file": "SELECT * FROM (VALUES (0, 'harbour'), (0, 'keel'), (2, 'orbit')) t(topic, term)",
    "tokenizer_choice": f"SELECT {_COUNT(TQ._tok_sql(TQ._LM))} AS simple, {_COUNT(TQ._tok_sql(TQ._LM + chr(92) + 'p{Nd}'))} AS numeric, {_COUNT(TQ._RAW)} AS raw, {_COUNT(TQ._CON % ('', ''))} AS connector FROM documents WHERE text IS NOT NULL",
    "too_long_tokens": TQ.with_tokens() + " SELECT DISTINCT doc_id FROM tok WHERE length(term) > 14",
    "number_format": "SELECT doc_id, CASE WHEN n_tokens % 4096 = 0 THEN '<0.0>' ELSE printf('%.4f', (n_tokens % 4096) / 16.0::DOUBLE) END AS text FROM doc_topics",
    "matrix_lines": PQ._A + " SELECT lpad(topic::VARCHAR, 8, ' ') || '|' || lpad(tokens::VARCHAR, 8, ' ') AS line FROM tp",
    "iteration_intervals": "SELECT x AS iteration FROM (SELECT unnest(range(30)) AS x) WHERE x BETWEEN 2 AND 4 OR x BETWEEN 10 AND 12",
}
