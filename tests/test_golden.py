"""Known values of tokenisers, statistics, distances, search and topic formulas, and their edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from quillmark.functions import distances as D
from quillmark.functions import text as T
from quillmark.operators import classify, diagnostics, order, search, skew, storage, topics, vectors, vocab


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_tokenisers(spark):  # T1-T5
    s = F.lit("But_I can't  a1b\tx—y But_i_can")
    assert one(spark, T.tokens(s)) == ["but", "i", "can", "t", "ab", "x", "y", "but", "i", "can"]
    assert one(spark, T.tokens(s, keep_numbers=True))[4] == "a1b"
    assert "but_i_can" in one(spark, T.tokens(s, keep_connectors=True))
    assert one(spark, T.raw_tokens(s))[:3] == ["But_I", "can't", "a1b"]
    assert one(spark, T.tokens(F.lit("a\nb"))) == ["a", "b"]
    assert one(spark, T.tokens(F.lit(""))) == []
    assert one(spark, T.tokens(F.lit(None).cast("string"))) is None
    assert one(spark, T.drop_stopwords(F.array(F.lit("a"), F.lit("b"), F.lit("a")), ["a"])) == ["b"]


def test_long_token(spark):  # T9
    with pytest.raises(Exception, match="longer"):
        one(spark, T.check_token_length(F.array(F.lit("x" * 11)), 10))


def test_long_text(spark):
    assert one(spark, F.size(T.tokens(F.lit("word " * 200_000)))) == 200_000


def tfidf_sample(spark):
    return spark.createDataFrame([(0, "this is a sample"), (1, "this is a another another example example example")], "doc_id long, text string")


def test_tfidf_rank(spark):  # V1-V5
    docs = tfidf_sample(spark)
    tokens = vocab.explode_tokens(docs)
    st = {r.term: (r.tf, r.df) for r in vocab.term_stats(tokens).collect()}
    assert st == {"this": (2, 2), "is": (2, 2), "a": (2, 2), "sample": (1, 1), "another": (2, 1), "example": (3, 1)}
    w = vocab.tfidf(vocab.term_stats(tokens), 2)
    ranked = vocab.rank_by_tfidf(w, vocab.type_ids(tokens)).orderBy("rank")
    assert [r.term for r in ranked.collect()] == ["example", "another", "sample", "a", "is", "this"]
    assert vocab.corpus_totals(docs, tokens).first().avg_doc_len == 6


def test_cooccurrence(spark, jokes):  # V13
    pairs = vocab.symmetric_cooccurrence(vocab.cooccurrence(vocab.explode_tokens(jokes)))
    got = {(r.w1, r.w2): r.n for r in pairs.collect()}
    assert got[("inside", "intel")] == 3
    assert got[("a", "freudian")] == 1
    assert ("a", "intel") not in got


def test_empty_tables(spark, jokes):
    none = jokes.where("false")
    t = vocab.explode_tokens(none)
    assert vocab.term_stats(t).count() == 0
    assert vocab.corpus_totals(none, t).first().asDict() == {"n_docs": 0, "n_tokens": 0, "n_types": 0, "avg_doc_len": 0.0}
    assert [r.n_tokens for r in vocab.doc_lengths(jokes, vocab.explode_tokens(jokes)).orderBy("doc_id").collect()][-2:] == [0, 0]


def test_distances(spark):
    a, b = arr(3, 8, 7, 5, 2, 9), arr(10, 8, 6, 6, 4, 5)
    assert one(spark, D.cosine(a, b)) == pytest.approx(1 - 0.8638935626791596)
    assert one(spark, D.jaccard(arr(1, 0), arr(0, 1))) == D.MAX_DOUBLE
    assert one(spark, D.continuous_jaccard(arr(1, 0), arr(0, 1))) == 0.0
    assert one(spark, D.kl(arr(1, 0), arr(0, 1))) == math.inf
    assert one(spark, D.canberra(arr(0, 1), arr(0, 1))) == 0.0
    for f in D.DISTANCES.values():
        assert one(spark, f(arr(0.2, 0.3, 0.5), arr(0.2, 0.3, 0.5))) == pytest.approx(0 if f is not D.bhattacharyya else 0.0, abs=1e-9)
    with pytest.raises(Exception, match="length"):
        one(spark, D.cosine(arr(1), arr(1, 2)))


def test_lgamma(spark):
    for x in (0.01, 0.5, 1.0, 3.7, 250.0):
        assert one(spark, D.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-9)


@pytest.mark.parametrize(("corpus", "query", "doc", "mixture", "want"), [
    (["apa", "apa banan"], "apa", 0, None, 0.2222),
    (["revenue down", "x"], "y", 0, None, None),
])
def test_query_likelihood(spark, corpus, query, doc, mixture, want):  # D17
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    t = vocab.explode_tokens(docs)
    q = vocab.explode_tokens(spark.createDataFrame([(9, query)], "doc_id long, text string")).selectExpr("doc_id q", "term").withColumn("qtf", F.lit(1))
    got = {r.id: r.d for r in search.query_likelihood(q, vocab.postings(t), vocab.doc_lengths(docs, t), mixture=mixture).collect()}
    if want is None:
        assert not got  # words outside the corpus give no score
    else:
        assert 1 - math.exp(-got[doc]) == pytest.approx(want, abs=1e-4)


def test_bm25_prefers_the_document_with_the_word(spark, jokes):  # D18
    docs = jokes.where("text <> ''")
    t = vocab.explode_tokens(docs)
    q = spark.createDataFrame([(1, "joke", 1), (1, "nowhere", 1)], "q long, term string, qtf long")
    assert [r.id for r in search.bm25(q, vocab.postings(t), vocab.doc_lengths(docs, t)).collect()] == [2]


def test_nearest_neighbour_ties_and_empties(spark):  # J1, J3
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, []), (5, None)], "id long, vec array<double>")
    q = rows.where("id IN (1, 4)")
    d = {(r.q, r.id): r.d for r in search.distance_to_all(q, rows, "euclidean").collect()}
    assert d[(4, 4)] == 0.0
    assert d[(1, 4)] == math.inf
    assert (1, 5) not in d
    assert {r.q: r.nearest for r in search.nearest_neighbour(q, rows.where("id < 4"), "euclidean").collect()} == {1: 2, 4: 1}
    assert search.nearest_neighbour(q, rows.where("false"), "cosine").where("nearest = -1").count() == 2


COUNTS = [[3, 2, 5], [1, 5, 2], [0, 0, 0], [9, 1, 1], [20, 0, 0]]


def ttc(spark):
    return spark.createDataFrame([(w, k, n) for w, row in enumerate(COUNTS) for k, n in enumerate(row) if n], "type_id int, topic int, n long")


def test_topic_probabilities(spark):  # K3
    p = {(r.type_id, r.topic): r for r in topics.probabilities(ttc(spark), 3, 0.01).collect()}
    assert p[(0, 0)].u_w_k == pytest.approx(3 / 33)
    assert sum(p[(w, 1)].p_w_k for w in (0, 1, 3, 4)) == pytest.approx(1)
    assert sum(p[(4, k)].p_k_w for k in range(3)) == pytest.approx(1)
    assert p[(1, 2)].p_k == pytest.approx(8 / 49)


def test_top_words(spark):  # K1
    top = topics.top_words(ttc(spark), 2).orderBy("topic", "rank").collect()
    assert [(r.topic, r.type_id) for r in top] == [(0, 4), (0, 3), (1, 1), (1, 0), (2, 0), (2, 1)]


def test_reverse_cumulative(spark):  # K21
    counts = [[0, 5, 1], [1, 1, 0], [3, 1, 1]]
    dtc = spark.createDataFrame([(d, k, n) for d, row in enumerate(counts) for k, n in enumerate(row) if n], "doc_id long, topic int, n long")
    got = {}
    for r in diagnostics.reverse_cumulative(dtc).orderBy("topic", "at_least").collect():
        got.setdefault(r.topic, []).append(r.docs)
    assert got == {0: [2, 1, 1], 1: [3, 1, 1, 1, 1], 2: [2]}


def test_percentile(spark):  # K22
    t = spark.createDataFrame([(0, k, n) for k, n in enumerate([3, 6, 4, 8, 10])], "type_id int, topic int, n long")
    assert diagnostics.k_at_percentile(t).first().k == 3


def test_priors(spark):  # G7
    words = ["java", "jvm", "jre", "NullPointerException", "cell", "control", "cabinet"]
    v = spark.createDataFrame(list(enumerate(words)), "type_id int, term string")
    priors = spark.createDataFrame([(0, w) for w in words[:4]] + [(2, w) for w in words[4:]], "topic int, term string")
    got = {}
    for r in topics.zero_out_words(priors, v, 4).collect():
        got.setdefault(r.topic, set()).add(words[r.type_id])
    assert got == {0: set(words[4:]), 2: set(words[:4]), 1: set(words), 3: set(words)}


def test_confusion_totals(spark):  # C4
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "truth string, predicted string")
    got = {(r.truth, r.predicted): r.n for r in classify.confusion(p).collect()}
    assert got[(None, None)] == 3
    assert got[("a", None)] == 2
    assert classify.accuracy(p).first().accuracy == pytest.approx(2 / 3)


def test_vector_text(spark):  # F5, F6, F9
    assert one(spark, vectors.sort_indices(arr(1, 3, 3, 2))) == [1, 2, 3, 0]
    assert one(spark, vectors.svmlight(F.array(F.lit(4), F.lit(4)))) == "2 4:1 4:1"
    assert vectors.scientific(0.0) == "<0.0>"
    assert vectors.scientific(1.5) == "1.5000"


def test_intervals(spark):  # F8
    assert one(spark, D.in_intervals(F.lit(3.0), [1, 2, 3, 4])) is True
    with pytest.raises(ValueError, match="even"):
        D.in_intervals(F.lit(1.0), [1, 2, 3])


def test_skewed_joins_keep_all_rows(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id = 1 THEN NULL ELSE cast(id % 50 AS string) END AS k")
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    got = skew.attach_group(rows, groups, "k", "id")
    assert got.count() == 2999
    assert got.where("k = 'hot'").select("low").distinct().collect()[0].low == 0
    right = groups.select("k", "low")
    assert skew.salted_join(rows, right, "k", "id", chunk=100).count() == 2999
    keys = storage.materialize(groups.select("k", "n"))
    assert skew.semi_join_checked(rows, keys, "k", "id").count() == skew.semi_join_checked(rows, keys, "k", "id", most=0).count() == 2999


def test_type_topic_matrix_has_all_counts(spark, small):  # L29
    from quillmark.queries import topic as Q

    m = Q.QUERIES["type_topic_matrix"](spark, small)
    counts = Q.QUERIES["type_topic_counts"](spark, small).agg(F.sum("n")).first()[0]
    assert m.columns == ["type_id"] + [f"t{i}" for i in range(Q.TOPICS)]
    assert m.agg(F.sum(sum(F.col(c) for c in m.columns[1:]))).first()[0] == counts


def test_theta_nearest_kl_names_the_document(spark, small):  # D24, J6
    import numpy as np

    from quillmark.queries import vector as Q
    from quillmark.queries.base import table

    rows = [r for r in table(spark, small, "doc_topics").select("doc_id", "theta").collect() if r.theta and max(r.theta) > 0]
    theta = {r.doc_id: np.array(r.theta, float) for r in rows}
    got = {r.q: (r.nearest, r.d) for r in Q.QUERIES["theta_nearest_kl"](spark, small).collect()}
    assert set(got) == {q for q in theta if q % 50 == 0}
    for q, (nearest, d) in got.items():
        a = theta[q]
        with np.errstate(divide="ignore", invalid="ignore"):
            kl = {i: np.where(a > 0, a * np.log2(a / b), 0).sum() for i, b in theta.items() if i != q}
        assert d == pytest.approx(min(kl.values()), abs=2e-9)
        assert nearest != q
        assert kl[nearest] == pytest.approx(d, abs=2e-9)


def test_every_hot_key_is_split(spark):
    """600 keys above the chunk: all are salted, by broadcast, and by broadcast and shuffle where the split table is large."""
    rows = spark.range(600 * 30 + 50).select("id", F.when(F.col("id") < 600 * 30, F.col("id") % 600).otherwise(F.lit(None)).alias("k"))
    right = spark.range(700).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for most in (1000, 10):
        got = skew.salted_join(rows, right, "k", "id", chunk=10, most=most)
        assert got.count() == 600 * 30
        assert got.where("v <> 2 * k").count() == 0
        groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
        met = skew.attach_group(rows, groups, "k", "id", chunk=10, most=most)
        assert met.count() == 600 * 30
        assert met.where("low <> k OR n <> 30").count() == 0


def test_rows_in_order(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x"), F.lit(2).alias("y"))
    got = order.in_order(rows.repartition(5), F.desc("x"), total="all", running={"y": "sum"}).collect()
    assert sorted((r["index"], r.x, r["all"], r["sum"]) for r in got) == [(i, 999 - i, 1000, 2 * i + 2) for i in range(1000)]
    assert order.in_order(rows.limit(0), "x").count() == 0


def test_nearest_by_kl(spark):  # D24
    rows = spark.createDataFrame([(1, [0.5, 0.5, 0.0]), (2, [0.5, 0.25, 0.25]), (3, [1.0, 0.0, 0.0]), (4, [0.5, 0.25, 0.25]), (5, None)], "id long, vec array<double>")
    got = {(r.q, r["rank"]): (r.id, r.d) for r in search.nearest_by_kl(rows, rows, 2).collect()}
    assert got[1, 1] == (2, 0.5)
    assert got[1, 2] == (4, 0.5)
    assert got[2, 1] == (4, 0.0)
    assert got[2, 2] == (1, float("inf"))
    assert got[3, 1] == (1, 1.0)
    assert search.nearest_by_kl(rows.where("false"), rows).count() == 0


def test_backoff_makes_no_row_for_a_word_that_a_document_lacks(spark, monkeypatch):  # D20
    """Six documents of which each lacks nearly all query words: what is written and what the scores are."""
    import numpy as np

    words = {i: [f"w{(i * 7 + j) % 40}" for j in range(5)] for i in range(6)}
    posts = spark.createDataFrame([(w, i, 1) for i, ws in words.items() for w in ws], "term string, doc_id long, tf long")
    lengths = spark.createDataFrame([(i, 5) for i in words], "doc_id long, n_tokens long")
    phi = spark.createDataFrame([(0, f"w{i}", 0.025) for i in range(40)], "topic int, term string, p double")
    theta = spark.createDataFrame([(i, 0, 1.0) for i in words], "doc_id long, topic int, theta double")
    q = spark.createDataFrame([(0, w) for w in sorted({w for ws in words.values() for w in ws})], "q long, term string")
    s = {(a, b): (3 * a + b) % 11 / 20 for a in range(40) for b in range(40) if a != b}
    scores = spark.createDataFrame([(f"w{a}", f"w{b}", v) for (a, b), v in s.items()], "w1 string, w2 string, score double")
    kept, write = {}, search.materialize

    def note(df, label="t"):
        kept[label] = write(df, label)
        return kept[label]

    monkeypatch.setattr(search, "materialize", note)
    got = {r.id: r.d for r in search.lda_likelihood(q, posts, lengths, phi, theta, backoff=scores).collect()}
    assert kept["documents"].agg(F.sum(F.size("terms"))).first()[0] == posts.count()
    vocab_ = [r.term for r in q.collect()]
    cf = {w: sum(w in ws for ws in words.values()) for w in vocab_}
    for i, ws in words.items():
        p = [1 / 5 if w in ws else np.mean([s.get((int(w[1:]), int(x[1:])), 0.0) for x in ws]) for w in vocab_]
        want = -sum(np.log(0.7 * (5 / 6 * a + 1 / 6 * cf[w] / 30) + 0.3 * 0.025) for w, a in zip(vocab_, p))
        assert got[i] == pytest.approx(want, abs=1e-9)
    first = search.top_k(search.lda_likelihood(q, posts, lengths, phi, theta, backoff=scores, best=2), 2).collect()
    assert [r.id for r in sorted(first, key=lambda r: r["rank"])] == sorted(got, key=lambda i: (got[i], i))[:2]


def test_backoff_asks_with_every_document(spark, small):  # D20
    from quillmark.queries import checks

    docs = spark.read.parquet(f"{small}/documents.parquet")
    asked = {r.doc_id for r in docs.where(F.size(T.tokens("text")) > 0).collect()}
    got = checks.lda_backoff(spark, small).groupBy("q").agg(F.count("*").alias("n")).collect()
    assert len(asked) > 90
    assert {r.q: r.n for r in got} == dict.fromkeys(asked, 10)


def test_best_likelihood_leaves_out_only_what_cannot_be_among_the_best(spark, monkeypatch):  # D20
    """The same best rows as of all scores, with frequent words, bounds, first documents and passes of small sizes; equal documents tie."""
    import numpy as np

    rng = np.random.default_rng(3)
    words = {i: np.minimum(rng.zipf(1.4, 3 + i % 23), 80).tolist() for i in range(120)}
    words |= {120 + i: words[i] for i in range(0, 12)}
    posts = spark.createDataFrame([(f"w{w}", i, ws.count(w)) for i, ws in words.items() for w in set(ws)], "term string, doc_id long, tf long")
    lengths = spark.createDataFrame([(i, len(ws)) for i, ws in words.items()], "doc_id long, n_tokens long")
    phi = spark.createDataFrame([(k, f"w{w}", float(p)) for k, ps in enumerate(rng.dirichlet(np.full(80, 0.3), 3)) for w, p in enumerate(ps, 1)], "topic int, term string, p double")
    theta = spark.createDataFrame([(i, k, float(p)) for i in range(120) for k, p in enumerate(rng.dirichlet(np.ones(3)))] + [(120 + i, k, 1 / 3) for i in range(12) for k in range(3)], "doc_id long, topic int, theta double")
    scores = spark.createDataFrame([(f"w{a}", f"w{b}", float(rng.random()) / b) for a in range(1, 81) for b in range(1, 81) if rng.random() < 0.2], "w1 string, w2 string, score double")
    q = posts.select(F.col("doc_id").alias("q"), "term")
    want = search.lda_likelihood(q, posts, lengths, phi, theta, backoff=scores).select("q", "id", F.round("d", 6).alias("d"))
    for name, n in {"HOT": 5, "GROUP": 4, "FIRST": 15, "BLOCK": 50, "MOST_WORDS": 700}.items():
        monkeypatch.setattr(search, name, n)
    lists = q.groupBy("q").agg(F.collect_list("term").alias("terms"))
    for ask in (q, lists):
        kept = search.lda_likelihood(ask, posts, lengths, phi, theta, backoff=scores, best=3).select("q", "id", F.round("d", 6).alias("d"))
        assert kept.count() < 0.5 * want.count()
        assert sorted(map(tuple, search.top_k(kept, 3).collect())) == sorted(map(tuple, search.top_k(want, 3).collect()))
    assert search.lda_likelihood(lists.where("false"), posts, lengths, phi, theta, backoff=scores, best=3).count() == 0


def test_adjacent_scores_are_the_normalised_cooccurrence(spark, jokes):  # V14
    stats = vocab.term_stats(vocab.explode_tokens(jokes))
    want = vocab.normalised_cooccurrence(vocab.adjacent_pairs(jokes), stats).collect()
    got = vocab.adjacent_scores(jokes, stats.select("term", "tf")).collect()
    assert len(want) > 10
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    words = {r.doc_id: dict(zip(r.terms, r.tfs)) for r in vocab.doc_words(jokes.select("doc_id", T.tokens("text").alias("t"))).collect()}
    assert words[2] == {"the": 1, "intel": 1, "inside": 1, "joke": 2, "is": 1, "a": 1}
    assert words[3] == {"a": 2, "b": 1}
    assert words[5] == {}
    assert 4 not in words


def test_nearest_by_jensen_shannon_compares_few_pairs(spark, monkeypatch):  # J6
    """The same rows as all pairs; exact distances of less than a tenth of them; ties, zeros and the row itself."""
    import numpy as np
    import pyarrow as pa

    a, b = np.random.default_rng(5).dirichlet(np.full(20, 0.2), (2, 3000))
    with np.errstate(divide="ignore", invalid="ignore"):
        h, f = (np.sqrt(a) - np.sqrt(b)) ** 2 / 2, np.where(a > 0, a * np.log2(2 * a / (a + b)), 0) / 2 + np.where(b > 0, b * np.log2(2 * b / (a + b)), 0) / 2
    assert (h <= f + 1e-15).all() and (f <= h / np.log(2) + 1e-15).all()
    v = np.concatenate([a[:1500], a[:20], np.eye(20)[:3], np.eye(20)[:1]])
    met, exact = [], search._jensen_shannon
    monkeypatch.setattr(search, "_jensen_shannon", lambda x, y: met.append(len(x)) or exact(x, y))
    ids = np.arange(len(v)) * 10
    lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), lists(v)], names=["id", "v"])
    ask = np.r_[0:60, 1495:1524]

    class Shared:
        value = (ids[ask], v[ask])

    (out,) = search._jensen_shannon_batches(Shared)(iter([batch.slice(700), batch.slice(0, 700)]))
    assert sum(met) < 0.1 * len(ask) * len(v)
    got = {q: (i, d) for q, i, d in zip(*(c.to_pylist() for c in out.columns))}
    for q in ask:
        d = exact(np.broadcast_to(v[q], v.shape), v)
        d[q] = np.inf
        assert got[ids[q]] == (ids[np.flatnonzero(d == d.min())[0]], d.min())
    rows = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, None), (4, [0.5, 0.5]), (5, [0.5, 0.5])], "id long, vec array<double>")
    assert {(r.q, r.id, r.d) for r in search.nearest_by_jensen_shannon(rows, rows).collect() if r.q != 2} == {(1, 4, 0.0), (4, 1, 0.0), (5, 1, 0.0)}
    assert search.nearest_by_jensen_shannon(rows.where("false"), rows).count() == 0
