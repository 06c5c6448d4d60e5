"""Sources (S1-S14): files in several layouts as ``(doc_id, name, label, text)``.

``doc_id`` numbers the documents in order of (file path, place in the file), blank lines left out; it
is assigned by a range-partitioned sort of paths and places, never by arrival or by content.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import vocab
from quillmark.operators.order import in_order
from quillmark.operators.storage import exists, is_directory

#: name, label and data of a line; a line without a tab is label only (Q28).
LINE = r"^(\S*)[\s,]*([^\t]+)[\s,]*(.*)$"


def parse_line(line: Column | str) -> list[Column]:
    """name, label and text of a line; lines that do not match give empty strings."""
    c = T.col(line)
    return [F.regexp_extract(c, LINE, i).alias(n) for i, n in ((1, "name"), (2, "label"), (3, "text"))]


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block, place: the lines of plain or gzip files; (file, block, place) is their order, splits of one file included."""
    m = F.col("_metadata")
    return spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """index, value: the lines that aren't blank, numbered from 0 in order of file and place."""
    lines = _zip_lines(spark, path) if path.endswith(".zip") else placed_lines(spark, path)
    return in_order(lines.where(F.trim("value") != ""), "file", "block", "place").select("index", "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Name, label, text of the lines of plain, gzip or zip files (by suffix); blank lines are skipped."""
    if path.endswith(".zip"):
        return read_zip(spark, path)
    return spark.read.text(path).where(F.trim("value") != "").select(*parse_line("value"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, name, label, text; doc_id is the number of the line among the lines that aren't blank."""
    return numbered_lines(spark, path).select(F.col("index").alias("doc_id"), *parse_line("value"))


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for entry, name in enumerate(sorted(z.namelist())):
                    with z.open(name) as f:
                        held: list[str] = []
                        done = 0
                        for line in io.TextIOWrapper(f, "utf-8", errors="replace"):
                            held.append(line.rstrip("\r\n"))
                            if len(held) == 10_000:
                                yield _lines(held, path, entry, done)
                                done += len(held)
                                held = []
                        if held:
                            yield _lines(held, path, entry, done)


def _lines(held: list[str], path: str, entry: int, done: int) -> pd.DataFrame:
    return pd.DataFrame({"value": held, "file": path, "block": entry, "place": np.arange(done, done + len(held))})


def _zip_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_unzip, "value string, file string, block long, place long")


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """The lines of zip archives; one archive is one task, as the format allows no splitting."""
    return _zip_lines(spark, path).where(F.trim("value") != "").select(*parse_line("value"))


def read_directory(spark: SparkSession, path: str, pattern: str = r".*\.txt$") -> DataFrame:
    """One document for each file of a tree; name is the path, label the last directory; ``pattern`` is a regex on the path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("name", F.input_file_name())
    return files.where(F.col("name").rlike(pattern)).select("name", F.regexp_extract("name", r"([^/]+)/[^/]+$", 1).alias("label"), F.col("value").alias("text"))


def from_strings(spark: SparkSession, texts: list[str], labels: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """In-memory texts with running ids; label ``X`` and name ``docno:i`` unless given."""
    rows = [(i, names[i] if names else f"docno:{i + 1}", labels[i] if labels else "X", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, name string, label string, text string")


def number_documents(docs: DataFrame, *order: str) -> DataFrame:
    """doc_id from 0 in the stated order, by range partitions."""
    return in_order(docs, *order, index="doc_id")


def read_stoplist(spark: SparkSession, path: str | None) -> DataFrame:
    """Word, one for each line; a missing file is an empty list."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], "word string")
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def tokenise(docs: DataFrame, raw: bool = False, keep_numbers: bool = False, keep_connectors: bool = False, longest: int = 10_000, stoplist: DataFrame | None = None) -> DataFrame:
    """A chain of tokeniser, length check and stoplist: doc_id, pos, term."""
    choose = T.choose_tokenizer(raw, keep_numbers, keep_connectors)
    tokens = vocab.explode_tokens(docs, tokenizer=lambda c: T.check_token_length(choose(c), longest))
    return tokens if stoplist is None else vocab.remove_stopwords(tokens, stoplist)


def load_pruned(docs: DataFrame, threshold: int, **kw) -> tuple[DataFrame, DataFrame]:
    """(doc_id, types) without words under ``threshold`` occurrences, and the vocabulary in order of first appearance."""
    tokens = tokenise(docs, **kw)
    kept = vocab.restrict(tokens, vocab.prune_rare(vocab.term_stats(tokens), threshold))
    ids = vocab.type_ids(kept)
    return vocab.corpus_arrays(kept, ids), ids


def load_kept(docs: DataFrame, keep: int, **kw) -> tuple[DataFrame, DataFrame]:
    """The same with the ``keep`` best words by tf-idf."""
    tokens = tokenise(docs, **kw)
    weighted = vocab.tfidf(vocab.term_stats(tokens).join(F.broadcast(vocab.corpus_size(docs)), F.lit(True)), F.col("n_docs"))
    best = vocab.keep_top(weighted.join(vocab.type_ids(tokens), "term"), keep)
    kept = vocab.restrict(tokens, best)
    ids = vocab.type_ids(kept)
    return vocab.corpus_arrays(kept, ids), ids


def with_vocabulary(docs: DataFrame, ids: DataFrame, **kw) -> DataFrame:
    """Documents over a frozen vocabulary: unknown words are left out."""
    return vocab.corpus_arrays(tokenise(docs, **kw), ids)


def load_documents(spark: SparkSession, path: str, file_regex: str = r".*\.txt$") -> DataFrame:
    """doc_id, name, label, text of a file, archive or directory tree; files of a tree are numbered by path."""
    if is_directory(spark, path):
        return number_documents(read_directory(spark, path, file_regex), "name")
    return read_documents(spark, path)


def corpus_of(spark: SparkSession, docs: DataFrame, settings, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, types) and the vocabulary of documents, as the settings (``quillmark.plans.config``) ask for.

    Every document gets a row, those without a known word an empty list.
    """
    kw = {"raw": settings.no_preprocess, "keep_numbers": settings.keep_numbers, "keep_connectors": settings.keep_connecting_punctuation, "longest": settings.max_doc_buf_size, "stoplist": read_stoplist(spark, settings.stoplist)}
    if ids is not None:
        corpus = with_vocabulary(docs, ids, **kw)
    elif settings.tfidf_vocab_size > 0:
        corpus, ids = load_kept(docs, settings.tfidf_vocab_size, **kw)
    else:
        corpus, ids = load_pruned(docs, settings.rare_threshold, **kw)
    none = F.array().cast("array<int>")
    return docs.select("doc_id").join(corpus, "doc_id", "left").select("doc_id", F.coalesce("types", none).alias("types")), ids


def load_dataset(spark: SparkSession, path: str, settings, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads a file, archive or directory as the settings ask for."""
    return corpus_of(spark, load_documents(spark, path, settings.file_regex), settings, ids)


def read_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Row, col, value of a text matrix; rows are numbered from 0 in order of file and line."""
    lines = numbered_lines(spark, path).withColumnRenamed("index", "row")
    return lines.select("row", F.posexplode(F.split("value", rf"\s*{sep}\s*")).alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("value"))


def read_binary_matrix(spark: SparkSession, path: str, rows: int, cols: int, kind: str = "double") -> DataFrame:
    """Row, values of a big-endian int or double matrix."""
    dtype = ">i4" if kind == "int" else ">f8"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                m = np.frombuffer(content, dtype, rows * cols).reshape(rows, cols).astype(float)
                yield pd.DataFrame({"row": np.arange(rows), "values": list(m)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, values array<double>")


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """Doc, pos, topic of a file with one comma-separated line for each document, numbered from 0; an empty line is a document without tokens."""
    lines = in_order(placed_lines(spark, path), "file", "block", "place", index="doc").where("trim(value) <> ''")
    return lines.select("doc", F.posexplode(F.split("value", r"\s*,\s*")).alias("pos", "t")).select("doc", "pos", F.col("t").cast("int").alias("topic"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """type_id, term, one term for each line of one file."""
    lines = in_order(placed_lines(spark, path), "file", "block", "place")
    return lines.select(F.col("index").cast("int").alias("type_id"), F.col("value").alias("term"))


def read_topic_priors(spark: SparkSession, path: str) -> DataFrame:
    """Topic, term from lines ``topic, word, word, ...``; lines that begin with # are comments."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", r"\s*,\s*")
    return lines.select(F.trim(F.get(parts, F.lit(0))).cast("int").alias("topic"), F.explode(F.slice(parts, 2, 1_000_000)).alias("term")).select("topic", F.trim("term").alias("term")).where("term <> ''")


def prior_matrix(zeroed: DataFrame, topics: int, types: int) -> np.ndarray:
    """The 0/1 matrix from ``zero_out_words``; a row or column of zeros only is an error."""
    m = np.ones((topics, types))
    p = zeroed.toPandas()
    m[p["topic"].to_numpy(int), p["type_id"].to_numpy(int)] = 0
    if not m.any(1).all() or not m.any(0).all():
        raise ValueError("topic priors rule out a whole topic or type")
    return m


def read_doc_priors(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, allowed from lines ``[pos|id|class,] number, topic, topic, ...``; lines that begin with # are comments.

    Whatever the word, the number is the place of a document, from 0 (the order of ``read_documents``); of
    several lines for one document any one may win. Another word, a negative or missing number, or a topic that is no
    number is an error.
    """
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select("value", parts.alias("p"))
    first = F.get("p", F.lit(0))
    bare = first.rlike(r"^[+-]?\d+$")
    known = F.lower(first).isin("pos", "id", "class")
    rest = F.when(bare, F.col("p")).otherwise(F.slice("p", 2, 1_000_000))
    x = lines.select("value", (bare | known).alias("known"), rest.alias("r"))
    number = F.try_to_number(F.get("r", F.lit(0)), F.lit("S9999999999")).cast("long")
    bad = F.raise_error(F.concat(F.lit("no document prior: "), F.col("value")))
    doc = F.when(F.col("known") & (number >= 0), number).otherwise(bad.cast("long"))
    return x.select(doc.alias("doc_id"), F.transform(F.slice("r", 2, 1_000_000), lambda t: t.cast("int")).alias("allowed")).dropDuplicates(["doc_id"])
