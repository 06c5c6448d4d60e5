"""Sources, sinks, configuration, programs and streams."""

import gzip
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.models import lda
from quillmark.operators import classify, diagnostics, topics, vocab
from quillmark.plans import config, programs
from quillmark.sources import loaders, sinks
from quillmark.streaming import streams

LINES = [f"docno:{i}\tX\tcommon words number{'abcdefghij'[i]} and more common words" for i in range(10)]


@pytest.fixture
def files(tmp_path):
    text = "\n".join(LINES) + "\n\n"
    (tmp_path / "small.txt").write_text(text)
    with gzip.open(tmp_path / "small.txt.gz", "wt") as f:
        f.write(text)
    with zipfile.ZipFile(tmp_path / "small.zip", "w") as z:
        z.writestr("small.txt", text)
    for label in ("red", "blue"):
        (tmp_path / "tree" / label).mkdir(parents=True)
        (tmp_path / "tree" / label / "one.txt").write_text(f"{label} text\nof two lines")
    (tmp_path / "tree" / "red" / "skip.dat").write_text("no")
    return tmp_path


def test_plain_gzip_zip_agree(spark, files):
    got = [sorted(map(tuple, loaders.read_lines(spark, str(files / n)).collect())) for n in ("small.txt", "small.txt.gz", "small.zip")]
    assert got[0] == got[1] == got[2]
    assert len(got[0]) == 10
    assert got[0][0][:2] == ("docno:0", "X")


def test_line_without_tab_is_label_only(spark):
    d = spark.createDataFrame([("name some label",)], "value string").select(*loaders.parse_line("value")).first()
    assert (d.name, d.text) == ("name", "")


def test_directory(spark, files):
    d = loaders.read_directory(spark, str(files / "tree")).collect()
    assert sorted(r.label for r in d) == ["blue", "red"]
    assert all("two lines" in r.text for r in d)


def test_prune_and_keep(spark, files):
    docs = loaders.number_documents(loaders.read_lines(spark, str(files / "small.txt")), "name")
    corpus, ids = loaders.load_pruned(docs, 2)
    assert {r.term for r in ids.collect()} == {"common", "words", "and", "more"}
    assert corpus.count() == 10
    _, kept = loaders.load_kept(docs, 3)
    assert kept.count() == 3
    assert loaders.with_vocabulary(docs, ids).first().types is not None


def test_stoplist(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("and\n\nmore\n")
    assert sorted(r.word for r in loaders.read_stoplist(spark, str(tmp_path / "stop.txt")).collect()) == ["and", "more"]
    assert loaders.read_stoplist(spark, str(tmp_path / "none.txt")).count() == 0


def test_priors_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# note\n0, java, jvm\n2, cell\n")
    assert sorted(map(tuple, loaders.read_topic_priors(spark, str(tmp_path / "t.txt")).collect())) == [(0, "java"), (0, "jvm"), (2, "cell")]
    (tmp_path / "d.txt").write_text("pos, 0, 0,2,4\npos, 19, 1,3,5\n")
    assert {r.doc_id: r.allowed for r in loaders.read_doc_priors(spark, str(tmp_path / "d.txt")).collect()} == {0: [0, 2, 4], 19: [1, 3, 5]}


def test_doc_prior_words_and_errors(spark, tmp_path):
    (tmp_path / "d.txt").write_text("id, 3, 1\nClass, 4, 0,2\n7, 5\n")
    assert {r.doc_id: r.allowed for r in loaders.read_doc_priors(spark, str(tmp_path / "d.txt")).collect()} == {3: [1], 4: [0, 2], 7: [5]}
    for wrong in ("word, 1, 2", "pos, -1, 2", "pos, x, 2"):
        (tmp_path / "e.txt").write_text(wrong + "\n")
        with pytest.raises(Exception, match="no document prior"):
            loaders.read_doc_priors(spark, str(tmp_path / "e.txt")).collect()


def test_documents_follow_lines(spark, tmp_path):
    rows = [f"docno:{12 - i}\tX\ttext {i}" for i in range(12)]
    (tmp_path / "a.txt").write_text("\n\n".join(rows))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.txt", "\n\n".join(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # several splits of one file
    try:
        for n in ("a.txt", "a.zip"):
            got = {r.doc_id: r.name for r in loaders.read_documents(spark, str(tmp_path / n)).collect()}
            assert got == {i: f"docno:{12 - i}" for i in range(12)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_matrices(spark, tmp_path):
    m = np.array([[1.5, 2.0], [3.0, -4.0]])
    (tmp_path / "m.bin").write_bytes(sinks.matrix_bytes(m))
    got = loaders.read_binary_matrix(spark, str(tmp_path / "m.bin"), 2, 2).orderBy("row").collect()
    assert [r["values"] for r in got] == m.tolist()
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "row long, values array<double>")
    sinks.write_matrix(df, str(tmp_path / "m"))
    assert sorted(r.value for r in loaders.read_matrix(spark, str(tmp_path / "m")).collect()) == [-4.0, 1.5, 2.0, 3.0]


def test_indicator_files(spark, tmp_path):
    a = spark.createDataFrame([(0, 0, 5, 1), (0, 1, 6, 2), (1, 0, 5, 3)], "doc_id long, pos int, type_id int, topic int")
    v = spark.createDataFrame([(5, "five"), (6, "six")], "type_id int, term string")
    sinks.write_indicators(a, str(tmp_path / "z"))
    assert sorted(r.topic for r in loaders.read_indicators(spark, str(tmp_path / "z")).collect()) == [1, 2, 3]
    sinks.write_indicators(a, str(tmp_path / "m"), "long", v)
    assert "0 NA 1 6 six 2" in [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    sinks.write_vocabulary(v, str(tmp_path / "v"))
    assert {r.term for r in loaders.read_vocabulary(spark, str(tmp_path / "v")).collect()} == {"five", "six"}


def test_diagnostics_formats(spark):
    a = spark.createDataFrame([(d, p, (d + p) % 5, p % 2) for d in range(6) for p in range(8)], "doc_id long, pos int, type_id int, topic int")
    v = spark.createDataFrame([(i, "w" * (i + 1)) for i in range(5)], "type_id int, term string")
    wide = diagnostics.all_diagnostics(a, v, 2, 0.1, 0.01, 3)
    assert sinks.diagnostics_text(wide).count("\n") == 2
    assert sinks.diagnostics_text(wide, "xml").count("<topic ") == 2
    assert topics.log_likelihood(a, 2, 0.1, 0.01).first()[0] < 0


def test_configuration(tmp_path):
    (tmp_path / "c.cfg").write_text("configs = a, b\n# note\ntopics = 7\nkeep_numbers: yes\nlambda = 0.3\nfixed_split_size_doc = 0.1, 0.5\n[a]\nscheme = adlda\n[b]\ntopics = 9\nunknown = 1\n")
    c = config.load(str(tmp_path / "c.cfg"))
    assert (c["a"].topics, c["a"].scheme, c["a"].keep_numbers, c["a"].lambda_) == (7, "adlda", True, 0.3)
    assert (c["b"].topics, c["b"].fixed_split_size_doc) == (9, [0.1, 0.5])
    assert config.Config().alpha == 5.0
    over = config.from_arguments(["--run_cfg", str(tmp_path / "c.cfg"), "--topics", "3", "--lambda=0.9"])
    assert (over["b"].topics, over["b"].lambda_) == (3, 0.9)
    assert config.as_bool(None, True) is True
    assert config.as_bool("1")
    assert config.Config(seed=0).run_seed() > 0
    with pytest.raises(ValueError, match="topics"):
        config.build({"topics": "many"})


def test_training_program(spark, files):
    c = config.Config(dataset=str(files / "small.txt"), topics=2, alpha=0.5, iterations=3, seed=1, base_out_dir=str(files / "out"), save_vocabulary=True, save_doc_topic_means=True, save_doc_topic_diagnostics=True, save_sampler=True, saved_sampler_dir=str(files / "saved"), stoplist="", topic_interval=1, nr_top_words=3, save_corpus=True, log_topic_indicators=True, save_phi_mean=True)
    m, _ = programs.train(spark, c)
    assert len(m.history) == 3
    out = next((files / "out").iterdir())
    assert {"top_words.csv", "vocabulary", "doc_topic_means", "likelihood.txt", "stats.txt", "manifest.json"} <= {p.name for p in out.iterdir()}
    folder = str(files / "saved" / lda.run_key(m.s, c.dataset))
    got = programs.infer(spark, c, folder, str(files / "small.txt"), 3)
    assert got.count() == 10
    th = m.theta()
    assert programs.similarity(th, th).where("d > 1e-9").count() == 0


def test_bm25_program(spark, files):
    docs = loaders.number_documents(loaders.read_lines(spark, str(files / "small.txt")), "name")
    best = programs.bm25(docs, docs, 1).collect()
    assert len(best) == 10
    assert all(r.q == r.id for r in best)


def test_classifier_program(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(0, 10, 30) + 10 * (i % 2)], "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, types array<int>, label string")
    parts = programs.classifier(docs, 20, lda.Settings(topics=2, alpha=0.1, iterations=10, seed=2), folds=2, sweeps=5)
    p = parts[0].unionByName(parts[1])
    assert p.count() == 60
    assert p.where("truth = predicted").count() > 50


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    docs = spark.createDataFrame([(1, "a b a", "2024-01-01 00:00:00"), (2, "b c", "2024-01-01 05:00:00"), (3, None, "2024-01-01 06:00:00")], "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    docs.write.parquet(str(src))
    stream = spark.readStream.schema(docs.schema).parquet(str(src))
    q = streams.running_terms(stream).writeStream.outputMode("complete").format("memory").queryName("terms").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.term: r.tf for r in spark.table("terms").collect()} == {"a": 2, "b": 2, "c": 1}
    v = spark.createDataFrame([(0, "a"), (1, "b")], "type_id int, term string")
    phi = np.array([[0.9, 0.1], [0.1, 0.9]])
    streams.start(streams.infer_stream(stream, v, phi, np.array([0.1, 0.1]), 5), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1].types == [0, 1, 0]
    assert set(got) == {1, 2}
    w = streams.windowed_terms(docs, "at").groupBy("term").agg(F.sum("tf").alias("n"))
    assert {r.term: r.n for r in w.collect()} == {"a": 2, "b": 2, "c": 1}


def test_vocabulary_ids_follow_first_appearance(spark, jokes):
    ids = {r.term: r.type_id for r in vocab.type_ids(vocab.explode_tokens(jokes)).collect()}
    assert (ids["a"], ids["freudian"], ids["slip"]) == (0, 1, 2)


def test_unknown_policies_and_keys_are_refused():
    assert programs.settings(config.Config()).topics == 10
    with pytest.raises(ValueError, match="topic_index_building_scheme"):
        programs.settings(config.Config(topic_index_building_scheme="nothing"))
    with pytest.raises(ValueError, match="sampler_class"):
        config.Config(sampler_class="x")
    with pytest.warns(UserWarning, match="batches"):
        config.Config(batches=7)
    assert [i for i in range(9) if programs.in_intervals(i, [1, 2, 6, 7])] == [1, 2, 6, 7]


def test_train_with_test_set_and_intervals(spark, files):
    (files / "test.txt").write_text("x\tX\tcommon words words\ny\tX\tmore unknown\n")
    c = config.Config(dataset=str(files / "small.txt"), test_dataset=str(files / "test.txt"), topics=2, alpha=0.5, iterations=3, seed=1, base_out_dir=str(files / "o"), stoplist="", topic_interval=1, dn_diagnostic_interval=[2, 3], print_ndocs_cnt=2, print_ndocs_interval=[2, 2], print_ntopwords_cnt=2, print_ntopwords_interval=[3, 3], log_type_topic_density=True, log_document_density=True, log_phi_density=True, log_tokens_per_topic=True)
    programs.train(spark, c)
    out = next((files / "o").iterdir())
    assert len((out / "test_held_out_log_likelihood.txt").read_text().splitlines()) == 4
    stats = (out / "stats.txt").read_text().splitlines()
    assert {"phi_density", "document_density", "type_topic_density", "tokens_per_topic", "held_out"} <= set(stats[0].split("\t"))
    assert spark.read.parquet(str(out / "doc_theta")).count() == 2
    assert {r.iteration for r in spark.read.parquet(str(out / "top_words")).select("iteration").distinct().collect()} == {3}
    assert (out / "delta_n").exists()
    assert spark.read.parquet(str(out / "test_theta")).count() == 2


def test_cross_validation_writes_phi_and_zbar(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, [int(x) for x in rng.integers(0, 10, 30) + 10 * (i % 2)]) for i in range(40)], "doc_id long, types array<int>")
    programs.cross_validation(docs, 20, lda.Settings(topics=2, alpha=0.1, iterations=3, seed=2), 2, str(tmp_path), 5)
    a, b = (spark.read.parquet(str(tmp_path / "fold=0" / n)) for n in ("train-zbar", "test-zbar"))
    assert a.count() + b.count() == 40
    phi = spark.read.parquet(str(tmp_path / "fold=0" / "train-phi")).collect()
    assert all(abs(sum(r.phi) - 1) < 1e-9 and len(r.phi) == 20 for r in phi)
    assert spark.read.csv(str(tmp_path / "fold=0" / "test-ids")).count() == b.count()


@pytest.mark.parametrize("command", ["train", "similarity", "bm25", "export", "mass", "classify"])
def test_commands(spark, files, command):
    c = config.Config(dataset=str(files / "small.txt"), test_dataset=str(files / "small.txt"), topics=2, alpha=0.5, iterations=1, seed=1, base_out_dir=str(files / "cmd"), stoplist="", topic_interval=0)
    programs.COMMANDS[command](spark, c)
    assert list((files / "cmd").iterdir())


def test_smaller_class_wins_ties(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    flat = lambda d: d.select("doc_id", F.lit(1.0).alias("score"))
    for names in ("ab", "ba"):
        assert {r.predicted for r in classify.by_corpus({n: flat for n in names}, docs).collect()} == {"a"}
