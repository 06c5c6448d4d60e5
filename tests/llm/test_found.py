"""Each operator against a plain reading of its definition, on the smallest tables and on built cases."""

import collections
import time
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import encoding, formatting, leaks, lookalikes, mixing, neighbours, overlaps, queries, terms

WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
DROP = regex.compile(r"[^\p{L}\p{M}\p{Nd}]")
ITEM = regex.compile(r"(?<![\p{L}\p{M}\p{Nd}])(?=(?:title|venue|keywords|summary)\s*:)")


def words(t):
    return WORD.findall(t.lower())


def key(t):
    head, *items = (DROP.sub("", p) for p in ITEM.split(t.lower()))
    return head, tuple(sorted(filter(None, items)))


def rows(small, sql):
    return duckdb.connect().execute(sql.replace("{d}", small)).fetchall()


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


# problem 1 ----------------------------------------------------------------------------------------
def test_terms(spark, small):
    keep, tok = regex.compile(r"[^\p{L}\p{M}\p{Z}\p{P}]"), regex.compile(r"[\p{L}\p{M}]+")
    docs = [(f, tok.findall(keep.sub("", regex.sub(r"[\t\r\n]", " ", t.lower())))) for f, t in rows(small, "SELECT file_name, data FROM '{d}/docs.parquet' WHERE data IS NOT NULL")]
    want = set()
    for name, file, rare, pct in rows(small, "SELECT config_name, dataset_filename, rare_threshold, common_doc_pct FROM '{d}/lda_configs.parquet'"):
        mine = [t for f, t in docs if f == file]
        n, df = collections.Counter(x for t in mine for x in t), collections.Counter(x for t in mine for x in set(t))
        want |= {(name, t, "rare") for t in n if n[t] < rare} | {(name, t, "common") for t in n if 100 * df[t] > pct * len(mine)}
    assert set(map(tuple, queries.p1_found(spark, small).collect())) == want


def test_terms_edge_cases(spark):
    d = spark.createDataFrame([(1, "f", "a a b", 0), (2, "f", "", 0), (3, "f", None, 0), (4, "f", "a " * 50_000, 0), (5, None, "x", 0), (6, "g", "a1b ﬁ", 0)], "doc_id long, file_name string, data string, term int")
    got = {(r.collection, r.term): (r.occurrences, r.records) for r in terms.term_frequencies(d, "file_name", "doc_id", "data").collect()}
    assert got == {("f", "a"): (50_002, 2), ("f", "b"): (1, 1), (None, "x"): (1, 1), ("g", "ab"): (1, 1), ("g", "ﬁ"): (1, 1)}
    assert terms.term_frequencies(d.where("false"), "file_name", "doc_id", "data").count() == 0
    c = spark.createDataFrame([("c", "f", None, None), ("n", None, 1, 1), ("e", "none", 1, 1)], "config_name string, dataset_filename string, rare_threshold int, common_doc_pct int")
    assert terms.useless_terms(d, c).count() == 0


def test_run_length_scan_goes_on_over_batches():
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["collection", "term", "record", "times"])

    parts = [batch([("f", "a", 1, 2), ("f", "a", 2, 1)]), batch([("f", "a", 2, 4)]), batch([("f", "a", 3, 1), ("f", "b", 1, 1)]), batch([(None, "b", 1, 1)])]
    got = [tuple(r.values()) for b in terms._scan(iter(parts)) for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted([("f", "a", 8, 3), ("f", "b", 1, 1), (None, "b", 1, 1)], key=str)


# problem 2 ----------------------------------------------------------------------------------------
def test_overlaps(spark, small):
    docs = rows(small, "SELECT doc_id, file_name, data FROM '{d}/docs.parquet' WHERE data IS NOT NULL")
    info = {i: (f, words(t), key(t)) for i, f, t in docs}
    want = set()
    for train, test in rows(small, "SELECT DISTINCT dataset_filename, test_dataset_filename FROM '{d}/lda_configs.parquet' WHERE test_dataset_filename IS NOT NULL"):
        for i, (f, a, k) in info.items():
            if f != test or not a:
                continue
            for j, (g, b, m) in info.items():
                if g == train and b and (k == m or (abs(len(a) - len(b)) <= 0.15 * max(len(a), len(b)) and sum((collections.Counter(a) - collections.Counter(b)).values()) <= 0.15 * max(len(a), len(b)) and distance(a, b) <= 0.15 * max(len(a), len(b)))):
                    want.add((min(i, j), max(i, j)))
    assert want
    assert set(map(tuple, queries.p2_found(spark, small).collect())) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_edit_distance(a, b):
    assert overlaps.edit_distance(a, b, 30) == distance(a, b)
    assert (overlaps.edit_distance(a, b, 3) <= 3) == (distance(a, b) <= 3)


def test_overlaps_recall_at_the_limit(spark):
    """Heavily edited copies, 12 to 15 % of the words: nearly all are found."""
    rng = np.random.default_rng(0)
    out, n = [], 300
    for i in range(n):
        t = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        u = list(t)
        for p in rng.choice(60, 8, replace=False):
            u[p] = f"new{rng.integers(10**9)}"
        out += [(2 * i, "train", " ".join(t)), (2 * i + 1, "test", " ".join(u))]
    docs = spark.createDataFrame(out, "doc_id long, file_name string, data string")
    c = spark.createDataFrame([("c", "train", "test")], "config_name string, dataset_filename string, test_dataset_filename string")
    got = set(map(tuple, overlaps.overlaps(docs, c).collect()))
    assert got <= {(2 * i, 2 * i + 1) for i in range(n)}
    assert len(got) >= 0.98 * n


def test_overlaps_edge_cases(spark):
    docs = [(1, "train", None), (2, "test", ""), (3, "train", "!!"), (4, "test", "!!"), (5, "train", "Same, words here"), (6, "test", "same words HERE"), (7, "test", "samewords here"), (8, "other", "same words here"), (9, "train", "same words here")]
    docs += [(10 + i, "train", "hot copy of a text") for i in range(40)] + [(60, "test", "hot copy of a text")]
    d = spark.createDataFrame(docs, "doc_id long, file_name string, data string")
    c = spark.createDataFrame([("a", "train", "test"), ("b", "train", "test"), ("n", "train", None)], "config_name string, dataset_filename string, test_dataset_filename string")
    got = set(map(tuple, overlaps.overlaps(d, c).collect()))
    assert got == {(5, 6), (5, 7), (6, 9), (7, 9)} | {(10 + i, 60) for i in range(40)}
    assert overlaps.overlaps(d.where("false"), c).count() == 0


# problem 3 ----------------------------------------------------------------------------------------
def test_same_but_format(spark, small):
    groups = collections.defaultdict(list)
    for i, t in rows(small, "SELECT doc_id, data FROM '{d}/docs.parquet' WHERE data IS NOT NULL"):
        if any(key(t)):
            groups[key(t)].append(i)
    want = {(min(v), i) for v in groups.values() for i in v if i != min(v)}
    assert want
    assert set(map(tuple, queries.p3_found(spark, small).collect())) == want


def test_format_edge_cases(spark):
    docs = [(1, "title: A b | venue: C"), (2, "VENUE : c;\n title:a B"), (3, "title a b venue c x"), (4, None), (5, ""), (6, "?!"), (7, "--"), (8, "ab"), (9, "a b"), (10, "ba"), (11, "long " * 40_000), (12, "LONG" * 40_000)]
    docs += [(100 + i, "hot, text!") for i in range(500)]
    d = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, data string, key long")
    got = set(map(tuple, formatting.same_but_format(d).collect()))
    assert got == {(1, 2), (8, 9), (11, 12)} | {(100, 100 + i) for i in range(1, 500)}
    copies = {r.doc_id: r.copies for r in formatting.collapsed(d).collect()}
    assert copies == {1: 2, 3: 1, 8: 2, 10: 1, 11: 2, 100: 500}
    assert formatting.same_but_format(d.where("false")).count() == 0


def test_items_and_what_stands_before_them(spark):
    texts = {1: "title: a b | venue: c", 2: "VENUE: C; title - A? title: a B", 3: "* Venue: c. Title: a, b", 4: "ti\u200btle: a b | venue: c", 5: "[title: a b] venue : c", 6: "subtitle: a b | venue: c", 7: "x title: a | y", 8: "title: a | y x"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, data string")
    got = {r.doc_id: r.kept_doc_id for r in formatting.same_but_format(d).collect()}
    assert got == {3: 1, 5: 1}


# problem 4 ----------------------------------------------------------------------------------------
def brute_neighbours(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -9)
    return {ids[i]: [(ids[j], s[i, j]) for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


def test_neighbours(spark, small):
    got = rows(small, "SELECT doc_id, theta FROM '{d}/doc_topics.parquet' WHERE theta IS NOT NULL ORDER BY 1")
    ids, x = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    keep = x.any(1)
    near = brute_neighbours(ids[keep], x[keep], 5)
    want = {(min(i, j), max(i, j)) for i, v in near.items() for j, s in v if s >= 0.97}
    found = set(map(tuple, queries.p4_found(spark, small).collect()))
    assert len(found & want) >= 0.99 * len(want)
    assert len(found - want) <= 0.01 * len(want)


def test_neighbour_recall_and_search(spark):
    """Clustered vectors: graph and greedy search find at least nine in ten of the true neighbours."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    x = centres[rng.integers(0, 40, 3000)] + 0.5 * rng.standard_normal((3000, 24))
    ids = np.arange(3000) * 10
    near = brute_neighbours(ids, x, 5)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "doc_id long, theta array<double>")
    g = collections.defaultdict(set)
    for r in neighbours.nearest(df).collect():
        g[r.id].add(r.neighbour)
    assert np.mean([len(g[i] & {j for j, _ in v}) / 5 for i, v in near.items()]) >= 0.9
    h = collections.defaultdict(set)
    for r in neighbours.search(df, df.where("doc_id % 50 = 0"), beam=64).collect():
        h[r.id].add(r.neighbour)
    assert np.mean([len(h[i] & {j for j, _ in near[i]}) / 5 for i in h]) >= 0.9
    assert set(h) == {i for i in near if i % 50 == 0}


def test_neighbours_edge_cases(spark):
    same, other = [1.0, 2.0, 0.0], [0.0, 0.0, 3.0]
    data = [(i, same) for i in range(1, 31)] + [(50, other), (51, [2.0, 4.0, 0.0]), (52, None), (53, [0.0, 0.0, 0.0]), (54, [float("nan"), 1.0, 1.0]), (1, same)]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "doc_id long, theta array<double>, sim string")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, least=0.9).orderBy("id", "rank").collect():
        got[r.id].append(r.neighbour)
    assert got[30] == [1, 2, 3, 4, 5]
    assert got[2] == [1, 3, 4, 5, 6]
    assert got[51] == [1, 2, 3, 4, 5]
    assert set(got) == {*range(1, 31), 51}
    assert neighbours.nearest(df.where("false")).count() == 0
    assert neighbours.nearest(df.where("doc_id = 50")).count() == 0


def test_more_copies_than_k_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    data = [(i, [1.0, 2.0, 3.0]) for i in range(1, 31)] + [(100 + i, rng.random(3).tolist()) for i in range(40)] + [(200 + i, rng.random(7).tolist()) for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, theta array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, k=10).orderBy("id", "rank").collect():
        got[r.id].append(r.neighbour)
    assert got[30] == list(range(1, 11))
    assert got[1] == list(range(2, 12))
    assert len(got) == 90
    assert all(len(v) == 10 for v in got.values())
    for low, high in ((100, 140), (200, 220)):
        part = [(i, v) for i, v in data if low <= i < high or (low == 100 and i < 100)]
        want = brute_neighbours(np.array([i for i, _ in part]), np.array([v for _, v in part]), 10)
        assert all(got[i] == [j for j, _ in want[i]] for i in range(low, high))
    exact = collections.defaultdict(list)
    for r in neighbours.exact_nearest(df, df.where("doc_id % 50 = 0"), k=10).orderBy("id", "rank").collect():
        exact[r.id].append(r.neighbour)
    assert dict(exact) == {i: got[i] for i in (100, 200)}


# problem 6 ----------------------------------------------------------------------------------------
MARKS = ["a", "e", "o", "é", "ñ", "Å", "́", "̈", "̣", "̧", "ạ", "ộ", "가", "각", "ᄀ", "ᅡ", "ᆨ", "ெ", "ா", "ে", "া", " ", "̈́", "क़", "שּׁ", "ּ", "ׁ", "ש", "豈", "z", "\U0001d15e", "\U0001d157", "\U0001d165"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(MARKS), max_size=9).map("".join), min_size=1, max_size=20))
def test_composition_is_canonical(texts):
    assert lookalikes.consistent(pa.array(texts)).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_consistent_form():
    cases = {
        "Ｑｕｅ　ｗａｉｔ！": "Que wait!", "n﻿och zw­ei​n": "noch zwein", "x y z w": "x y z w", "👩‍🔬 x² ½ ①": "👩‍🔬 x² ½ ①", "the hеіѕсh plain": "the heisch plain", "Αntwort": "Antwort",
        "naı̈ve café": "naı̈ve café", "это берёт и": "это берёт и", "берёт й й": "берёт й й", "the рaсе and more": "the pace and more", "слово сaм про": "слово сам про", "Cop‍": "Cop‍", "a  b\n\tC": "a  b\n\tC", "": "",
    }
    assert lookalikes.consistent(pa.array(list(cases))).to_pylist() == list(cases.values())
    assert lookalikes.consistent(pa.array([None, "a", None], pa.string())).to_pylist() == [None, "a", None]
    again = lookalikes.consistent(pa.array(list(cases.values()))).to_pylist()
    assert again == list(cases.values())


def test_alike_pairs(spark):
    docs = [(1, "café au lait"), (2, "café au lait"), (3, "cafe au lait"), (4, "café au lait"), (5, None), (6, ""), (7, "!"), (8, "！"), (9, "ｃafé au lait")]
    docs += [(100 + i, "hot text") for i in range(50)] + [(200, "hot te​xt")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, data string, form string")
    got = set(map(tuple, lookalikes.alike_pairs(d).collect()))
    assert got == {(1, 2), (2, 4), (1, 9), (2, 9), (4, 9)} | {(100 + i, 200) for i in range(50)}
    assert lookalikes.alike_pairs(d.where("false")).count() == 0


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("ցood Ꭺpple in plain text", "good Apple in plain text"), ("ｶﾞｷ", "ガキ"), ("the αB-crystallin gene", None), ("the ΔT of the ΔT", None), ("ΔT", None), ("αB", None), ("μM of Ca", None),
        ("oզ Հայաստան օր", "օզ Հայաստան օր"), ("оf the Τhe", "of the The"), ("хороший тeкст", "хороший текст"), ("Հայաստան", None), ("pɑypal", None),
    ],
)
def test_look_alikes_of_further_scripts_and_symbols(spark, text, form):
    extra = lookalikes.confusables(spark)
    assert lookalikes.consistent(pa.array([text]), extra).to_pylist() == [form or text]
    assert lookalikes.consistent(pa.array(["Հայ Ꭺ тeкст", text]), extra).to_pylist()[1] == (form or text)  # whatever else is in the batch


def test_alike_classes(spark, small):
    pairs = queries.p6_found(spark, small).collect()
    got = {r.doc_id: r for r in queries.p6_classes(spark, small).collect()}
    assert set(got) == {x for r in pairs for x in (r.doc_id_a, r.doc_id_b)}
    assert all(got[r.doc_id_a].class_id == got[r.doc_id_b].class_id for r in pairs)
    assert all(r.class_id <= r.doc_id and r.spellings > 1 for r in got.values())


# problem 7 ----------------------------------------------------------------------------------------
def test_leaks(spark, small):
    def runs(t):
        w = words(t)
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    items = [(i, runs(t)) for i, t in rows(small, "SELECT item_id, text FROM '{d}/eval_items.parquet'")]
    want = {(i, d) for d, t in rows(small, "SELECT doc_id, text FROM '{d}/documents.parquet' WHERE text IS NOT NULL") for r in [runs(t)] for i, s in items if r & s}
    assert set(map(tuple, queries.p7_found(spark, small).collect())) == want


def test_reordered_passages_and_edges(spark, monkeypatch):
    w = [f"word{i}" for i in range(30)]
    docs = [(1, "start " + " ".join(w[15:]) + " mid " + " ".join(w[:15]) + " end"), (2, " ".join(w[:12])), (3, None), (4, ""), (5, "x " * 30_000 + " ".join(w[:13])), (6, " ".join(w).upper())]
    items = [(1, " ".join(w)), (2, None), (3, ""), (4, "short item"), (5, " ".join(w[:20]))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.item_id, r.doc_id): (r.tiles, r.longest, r.covered) for r in leaks.leaks(d, q).collect()}
    assert got == {(1, 1): (2, 15, 30), (1, 5): (1, 13, 13), (1, 6): (1, 30, 30), (5, 1): (1, 15, 15), (5, 5): (1, 13, 13), (5, 6): (1, 20, 20)}
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 10)
    assert {(r.item_id, r.doc_id) for r in leaks.leaks(d, q).collect()} == set(got)
    assert leaks.leaks(d.where("false"), q).count() == leaks.leaks(d, q.where("false")).count() == 0
    five = {(r.item_id, r.doc_id): r.coverage for r in leaks.leaks(d, q, min_match=5).collect()}
    assert five[(1, 2)] == pytest.approx(12 / 30)


def plain_tiles(doc, item, least):
    """Greedy string tiling by its definition."""
    fd, fi, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and fd[i + n] and fi[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= least and n > best[2]:
                    best = (i, j, n)
        if not best[2]:
            return out
        i, j, n = best
        fd[i : i + n], fi[j : j + n] = [False] * n, [False] * n
        out.append(best)


def test_tiles_take_the_longest_match_first():
    doc, item = list("abcxyzabcd"), list("abcd..xyz")
    assert leaks.tile(doc, item, 3) == [(6, 0, 4), (3, 6, 3)]
    rng = np.random.default_rng(3)
    for letters, least in ((2, 2), (3, 2), (5, 3), (1, 4)):
        for _ in range(15):
            a, b = ([str(x) for x in rng.integers(0, letters, n)] for n in rng.integers(0, 40, 2))
            assert leaks.tile(a, b, least) == plain_tiles(a, b, least)


def test_tiling_of_repeated_words_is_fast():
    began = time.time()
    assert len(leaks.tile(["0"] * 30_000, ["0"] * 400, 13)) == 1
    mixed = (["a", "b", "b"] * 10_000, ["a", "b", "b", "b", "a"] * 80)
    leaks.tile(*mixed, 2)
    assert time.time() - began < 4


# problem 8 ----------------------------------------------------------------------------------------
def test_critical_means():
    u = np.array([0.05, 0.5, 0.99])
    m = mixing.critical_means(u, 4)
    from math import exp, factorial

    for k in range(4):
        for j, x in enumerate(u):
            assert sum(exp(-m[k, j]) * m[k, j] ** i / factorial(i) for i in range(k + 1)) == pytest.approx(x, abs=1e-9)
    assert (np.diff(m, axis=0) > 0).all()


def test_mixture(spark):
    rng = np.random.default_rng(3)
    docs = [(i, s, "token " * int(rng.integers(5, 40))) for i, s in enumerate(["big"] * 2000 + ["mid"] * 300 + ["few"] * 60)]
    docs += [(9001, None, "lost"), (9002, "big", None), (9003, "few", "")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "mid", 0.3, 3), ("m", "few", 0.15, 4), ("m", "gone", 0.05, 2)], "mix_name string, source string, target_share double, max_repeats int")
    m = mixing.Mixture(d, t)
    got = {r.source: r for r in m.shares.collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("few", 0.15)):
        assert got[s].actual_share == pytest.approx(share / 0.95, rel=0.03)
        assert got[s].most_repeats <= got[s].max_repeats
    assert got["gone"].tokens == 0
    sel = m.selection.collect()
    assert collections.Counter(r.doc_id for r in sel).most_common(1)[0][1] <= 4
    assert sum(r.n_tokens for r in sel) == sum(r.tokens for r in got.values())
    again = mixing.Mixture(d.repartition(5), t).selection.collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in sel]
    assert mixing.Mixture(d.where("false"), t).selection.count() == 0


def test_token_counts_are_the_tokenizers(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixing.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=mixing.SPLIT, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello, world", "naïve été", "", "こんにちは"]
    df = mixing.with_token_counts(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string"))
    assert [r.n_tokens for r in df.orderBy("i").collect()] == [len(enc.encode_ordinary(t)) for t in texts] + [0]


# problem 9 ----------------------------------------------------------------------------------------
GOOD = [
    "Über den naïven café: «déjà vu» – “très” bien… 20 °C, £ 40 ± 2 §", "MANHÃ” e «MANHÃ» AÇÃO LÃÇÃO É»", "smörgåsbord « ¿qué? »", "Это берёт Её «БЕРЁТ» – НЕТ… ОТЧЁТ", "Η ερώτηση την γράφει ΚΑΙ", "plain ascii text only", "l’été d’où ‘auf’ € 5", "ÉTÉ À LA CÔTE", "√2 ≈ 1.41 and ±∞", "Рёв и её", "",
]


def test_correct_text_is_no_case():
    damaged, _, _, text = encoding.repair(pa.array(GOOD))
    assert not damaged.any()
    assert text.to_pylist() == GOOD


SAFE = [
    "The letters äöü, ÄÖÜ and éèê carry marks", "ÜÖÄ ÜÖÄ ÜÖÄ", "Слово ПК и МакОС работает в СПбГУ и МГУ", "one\x85two", "ФБИ и ЦРУ, ЦБ и МВФ", "ÂÊÎÔÛ âêîôû", "МИНУТЫ СОБРАНИЯ ВЧЕРА УТРОМ",
    "àèìòù âêîôû áéíóú", "ÁÉÍÓÚ áéíóú àèìòù", "ΑΒΓ άέή", "æøå ÆØÅ åäö ÅÄÖ", "ОЭСР и НАТО, СНГ, ОДКБ, ВТО, МОК", "Η ΕΛΛΆΔΑ ΚΑΙ Η ΕΕ", "ÉCOLE PRIVÉE À PARIS", "АБВГДЕЁЖЗИЙ абвгдеёжзий",
]


@pytest.mark.parametrize("text", SAFE)
def test_lists_of_letters_and_abbreviations_are_no_case(text):
    thrice = " ".join([text] * 3)
    damaged, _, _, back = encoding.repair(pa.array([text, thrice]))
    assert not damaged.any()
    assert back.to_pylist() == [text, thrice]


def test_a_swapped_stretch_in_correct_text():
    bad = "показывает отчёт между частью гавани и список".encode("koi8_r").decode("cp1251")
    text = "Вопрос стоит так: " + bad + ". После этого слово ПК верно"
    damaged, _, names, back = encoding.repair(pa.array([text]))
    assert damaged[0]
    assert names == ["koi8_r"]
    assert back[0].as_py() == "Вопрос стоит так: показывает отчёт между частью гавани и список. После этого слово ПК верно"


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("text", ["Un café très naïf, dont l’été – déjà “long” – finit", "Über möglich größer geprüft schön früh", "La razón según el año pequeño también"])
def test_round_trip(wrong, text):
    try:
        bad = text.encode().decode(wrong)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode())
    damaged, _, _, back = encoding.repair(pa.array([bad, "prefix été " + bad + " suffix über"]))
    assert damaged.all()
    assert back.to_pylist() == [text, "prefix été " + text + " suffix über"]


def test_twice_damaged_and_lost():
    text = "Größe “für” alle"
    once = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
    twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in once.encode())
    damaged, _, _, back = encoding.repair(pa.array([twice, "caf� is lost", "\x93so\x94 it is"]))
    assert damaged.all()
    assert back.to_pylist() == [text, "caf� is lost", "“so” it is"]


@pytest.mark.parametrize(("true", "read"), [("cp1251", "latin-1"), ("koi8_r", "cp1251"), ("iso8859_7", "latin-1"), ("koi8_r", "latin-1")])
def test_alphabets(true, read):
    text = "Ερώτηση την γράφει και μένει" if true == "iso8859_7" else "Вопрос и список показывает отчёт между частью гавани"
    damaged, _, _, back = encoding.repair(pa.array([text.encode(true).decode(read)]))
    assert damaged[0]
    assert back[0].as_py() == text


def test_cyrillic_utf8():
    text = "Вопрос и список показывает отчёт"
    for wrong in ("cp1252", "cp1251"):
        bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode())
        damaged, _, _, back = encoding.repair(pa.array([bad]))
        assert damaged[0]
        assert back[0].as_py() == text


def test_garbled_edges(spark):
    d = spark.createDataFrame([(1, "cafÃ©", "x"), (2, None, "x"), (3, "", "x"), (1, "cafÃ©", "x"), (4, "fine " * 100_000 + "cafÃ©", "x"), (5, "caf�", "x")], "doc_id long, text string, encoding string")
    got = sorted((r.doc_id, r.complete) for r in encoding.garbled(d).collect())
    assert got == [(1, True), (1, True), (4, True), (5, False)]
    assert encoding.garbled(d.where("false")).count() == 0


def test_sql_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_found_columns(spark, small):
    want = {"p1_found": ["config_name", "term", "mark"], "p2_found": ["doc_id_a", "doc_id_b"], "p3_found": ["kept_doc_id", "doc_id"], "p4_found": ["doc_id_a", "doc_id_b"], "p6_found": ["doc_id_a", "doc_id_b"], "p7_found": ["item_id", "doc_id"], "p9_found": ["doc_id"]}
    for n in ("p7_found", "p9_found"):
        assert queries.queries()[n](spark, small).columns == want[n]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, small, name):
    import os

    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    df = queries.queries()[name](spark, small)
    cur = c.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*sorted(cols)).collect()))) == sorted(repr(tuple(r[cols.index(x)] for x in sorted(cols))) for r in cur.fetchall())


def test_overlap_report(spark, small):
    p = queries.p2_overlap_report(spark, small)
    assert p.agg(F.sum("pairs")).first()[0] >= queries.p2_found(spark, small).count()
