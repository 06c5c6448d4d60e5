"""Samplers: invariants, seeds, recovery of planted topics; draws; saving; scan policies."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.models import draws, kernels, lda, scan
from quillmark.plans import config
from quillmark.queries import models
from quillmark.queries import text as TQ

K, V = 4, 40


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of one of four topics with ten words each, one empty document."""
    rng = np.random.default_rng(0)
    rows = [(i, [int(x) for x in rng.integers(0, 10, 40) + 10 * (i % K)]) for i in range(200)] + [(999, [])]
    return spark.createDataFrame(rows, "doc_id long, types array<int>")


def settings(**kw):
    return lda.Settings(**({"topics": K, "alpha": 0.1, "beta": 0.01, "iterations": 12, "seed": 3} | kw))


@pytest.mark.parametrize("scheme", sorted(lda.SCHEMES))
def test_invariants_and_recovery(spark, planted, scheme):
    m = lda.TopicModel(planted, V, settings(scheme=scheme, iterations=15)).sample()
    n = m.counts()
    assert n.sum() == 200 * 40
    assert (m.phi >= 0).all()
    assert np.allclose(m.phi.sum(1), 1)
    z = m.state.df.select("doc_id", "z").collect()
    assert all(0 <= t < K for r in z for t in r.z)
    purity = np.mean([np.bincount(r.z, minlength=K).max() / len(r.z) for r in z if r.z])
    assert purity > 0.6
    theta = m.theta().collect()
    assert all(abs(sum(r.theta) - 1) < 1e-9 for r in theta)
    assert next(r for r in theta if r.doc_id == 999).zbar == [0.0] * K


def test_same_seed_same_model_under_any_partitioning(planted):
    a = lda.TopicModel(planted.repartition(1), V, settings(iterations=3)).sample()
    b = lda.TopicModel(planted.repartition(7), V, settings(iterations=3)).sample()
    assert (a.counts() == b.counts()).all()
    assert (a.phi == b.phi).all()


def test_inference_and_held_out(planted):
    m = lda.TopicModel(planted, V, settings(iterations=20)).sample()
    got = lda.infer(planted, m.phi_mean(), m.alpha, 20, 1).collect()
    assert np.mean([max(r.theta) for r in got if r.types]) > 0.7
    held = lda.held_out(planted, m.phi_mean(), m.alpha, 20)
    assert lda.perplexity(held, planted) < V
    assert held.where("doc_id = 999").first().log_probability == 0.0


def test_priors(planted):
    priors = np.ones((K, V))
    priors[0, :10] = 0
    allowed = planted.where("doc_id % 2 = 0").select("doc_id", F.array(F.lit(0), F.lit(2)).alias("allowed"))
    m = lda.TopicModel(planted, V, settings(scheme="polyaurn_priors", iterations=5), topic_priors=priors, doc_priors=allowed).sample()
    assert m.phi[0, :10].sum() == 0
    assert m.assign().where("doc_id % 2 = 0 AND topic NOT IN (0, 2)").count() == 0
    with pytest.raises(ValueError, match="rule out"):
        lda.TopicModel(planted, V, settings(), topic_priors=np.zeros((K, V)))


def test_save_load_continue(spark, planted, tmp_path):
    m = lda.TopicModel(planted, V, settings(iterations=2)).sample()
    m.save(f"file://{tmp_path}/m")
    again = lda.TopicModel.load(spark, f"file://{tmp_path}/m")
    assert np.allclose(again.phi, m.phi)
    again.sample(2)
    m.sample(2)
    assert (again.counts() == m.counts()).all()
    with pytest.raises(ValueError, match="vocabulary"):
        again.set_phi(np.ones((K, V + 1)))


def test_abort_callback_reorder_optimise(planted, tmp_path):
    seen = []
    (tmp_path / "stop").write_text("")
    m = lda.TopicModel(planted, V, settings())
    assert m.sample(5, abort_file=str(tmp_path / "stop")).iteration == 0
    m.aborted = False
    m.sample(2, callback=lambda x: seen.append(x.iteration))
    assert seen == [1, 2]
    before = m.counts()
    order = m.reorder()
    assert (m.counts() == before[order]).all()
    m.optimise()
    assert m.alpha[0] > 0
    assert np.isfinite(m.log_likelihood())


def test_refused_and_unknown_schemes():
    with pytest.raises(NotImplementedError):
        lda.scheme("ppu_hlda")
    with pytest.raises(ValueError, match="unknown"):
        lda.scheme("nothing")


def test_alias_tables():
    w = np.array([[1.0, 2.0, 3.0, 4.0]])
    cut, alias = draws.alias_tables(w)
    u = draws.uniforms(1, np.arange(200_000))
    got = np.bincount(draws.alias_draw(np.repeat(cut, len(u), 0), np.repeat(alias, len(u), 0), u), minlength=4) / len(u)
    assert np.allclose(got, w[0] / 10, atol=0.01)


def test_draws():
    rng = np.random.default_rng(0)
    d = draws.dirichlet(rng, np.array([[1.0, 0.0, 2.0]]))
    assert d[0, 1] == 0
    assert d.sum() == pytest.approx(1)
    c = draws.conditional_dirichlet(rng, np.array([0.2, 0.3, 0.5]), np.ones(3), np.array([0, 1]))
    assert c[2] == 0.5
    assert c.sum() == pytest.approx(1)
    p = draws.polya_urn(rng, np.array([[0.0, 50.0, 50.0]]), 0.01)
    assert p.sum() == pytest.approx(1)
    u = draws.uniforms(5, np.arange(1000), 3)
    assert 0.45 < u.mean() < 0.55
    assert len(np.unique(u)) == 1000
    s = draws.spike_dirichlet(rng, np.array([[0.0, 5.0, 0.0], [0.0, 0.0, 0.0]]), 0.1, 0.5)
    assert np.allclose(s.sum(1), 1)


def test_left_to_right_is_exact_for_one_topic():
    phi = np.array([[0.5], [0.25], [0.25]])
    assert kernels.left_to_right(np.array([0, 1, 2]), phi, np.array([1.0]), 0, 0, 5) == pytest.approx(np.log(0.5 * 0.25 * 0.25))


def test_scan_policies():
    n = np.array([[1, 140, 14, 20, 5]])
    all_ = np.ones(5, bool)
    assert list(scan.frequent_types(0.4)(1, n, all_)) == [1, 3]
    pick = scan.systematic_types(60, 1)
    assert np.mean([1 in pick(i, n, all_) for i in range(50)]) == 1
    with pytest.raises(ValueError, match="one or more"):
        scan.systematic_types(2, 1)(1, np.array([[0, 3]]), all_)
    assert [list(x) for x in scan.even_topics(5, 2)] == [[0, 1, 2], [3, 4]]
    assert len(scan.percentage_topics(10, 0.25, 1, 1)) == 3
    assert list(scan.alternate(lambda i, n, c: [0], lambda i, n, c: [1])(3, n, all_)) == [1]
    assert len(scan.beta_fraction_types(2, 2, 0)(0, n, all_)) == 5
    moved = np.array([True, False, True, False, False])
    assert list(scan.changed_types()(1, n, moved)) == [0, 2]
    assert scan.changed_types(instability=3)(3, n, moved) is None
    assert scan.changed_types(full_period=4)(8, n, moved) is None
    assert scan.all_types()(1, n, moved) is None


def test_scan_from_configuration():
    c = config.Config(topics=K, batch_building_scheme="some.package.PercentageBatchBuilder", percentage_split_size_doc=0.2, topic_batch_building_scheme="percentage", percentage_split_size_topic=0.5, topic_index_building_scheme="MetaTopicIndexBuilder", sub_topic_index_builders=["changed", "frequent"])
    p = scan.from_config(c, 1)
    assert len(p.topics(1)) == 2
    assert len(p.types(1, np.array([[4, 3, 2, 1, 1]]), np.ones(5, bool))) == 1
    with pytest.raises(ValueError, match="batch_building_scheme"):
        scan.from_config(config.Config(batch_building_scheme="nothing"), 1)


@pytest.mark.parametrize("docs", ["percentage", "adaptive", "fixed_split"])
def test_unvisited_documents_keep_their_topics(planted, docs):
    c = config.Config(topics=K, batch_building_scheme=docs, percentage_split_size_doc=0.1, fixed_split_size_doc=[0.1, 0.2], instability_period=1)
    m = lda.TopicModel(planted, V, settings(scheme="uncollapsed", scan=scan.from_config(c, 3)))
    m.sample(1)
    z = {r.doc_id: r.z for r in m.state.df.collect()}
    before = m.phi.copy()
    m.sample(1)
    seen = {r.doc_id for r in m.visited.collect()}
    assert len(seen) == {"percentage": 21, "adaptive": 21, "fixed_split": 40}[docs]
    now = {r.doc_id: r.z for r in m.state.df.collect()}
    assert set(now) == set(z)
    assert all(now[i] == z[i] for i in z if i not in seen)
    assert any(now[i] != z[i] for i in seen)
    assert m.counts().sum() == 200 * 40
    assert not np.allclose(m.phi, before)


def test_only_some_topics_of_phi_are_drawn(planted):
    m = lda.TopicModel(planted, V, settings(scheme="uncollapsed", scan=scan.Scan(topics=lambda i: np.array([1]))))
    before = m.phi.copy()
    m.sample(1)
    assert (m.phi[[0, 2, 3]] == before[[0, 2, 3]]).all()
    assert not np.allclose(m.phi[1], before[1])


@pytest.mark.parametrize("scheme", ["uncollapsed", "efficient_uncollapsed", "spalias", "collapsed", "lightcollapsed", "lightpclda"])
def test_document_priors_bind_every_kernel(planted, scheme):
    allowed = planted.select("doc_id", F.array((F.col("doc_id") % K).cast("int")).alias("allowed"))
    m = lda.TopicModel(planted, V, settings(scheme=scheme, iterations=2), doc_priors=allowed).sample()
    assert m.assign().where(f"topic <> doc_id % {K}").count() == 0


def test_near_end_draw_is_the_same_draw():
    p = np.random.default_rng(0).random((1000, 7))
    u = np.random.default_rng(1).random(1000)
    assert (kernels._pick(p, u) == kernels._pick_near(p, u)).all()


def test_digamma():
    assert draws.digamma(np.array([1.0, 0.5, 20.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.9705239922421498], abs=1e-10)


def test_saved_models_keep_priors_and_means(spark, planted, tmp_path):
    priors = np.ones((K, V))
    priors[0, :10] = 0
    allowed = planted.where("doc_id % 2 = 0").select("doc_id", F.array(F.lit(0), F.lit(2)).alias("allowed"))
    m = lda.TopicModel(planted, V, settings(scheme="polyaurn_priors", iterations=4), topic_priors=priors, doc_priors=allowed).sample(3)
    m.save(f"file://{tmp_path}/p")
    again = lda.TopicModel.load(spark, f"file://{tmp_path}/p")
    assert np.allclose(again.phi_mean(), m.phi_mean())
    again.sample(1)
    m.sample(1)
    assert (again.counts() == m.counts()).all()
    assert again.phi[0, :10].sum() == 0
    assert again.assign().where("doc_id % 2 = 0 AND topic NOT IN (0, 2)").count() == 0


def test_assignments_of_another_sampler(planted):
    a = lda.TopicModel(planted, V, settings(iterations=2)).sample()
    b = lda.TopicModel(planted, V, settings(scheme="uncollapsed"))
    b.set_assignments(a.state.df)
    assert (b.counts() == a.counts()).all()
    with pytest.raises(ValueError, match="don't fit"):
        b.set_assignments(a.state.df.limit(3))


def test_random_scan_keeps_the_mass_of_other_types(planted):
    m = lda.TopicModel(planted, V, settings(iterations=1, scheme="uncollapsed"))
    before = m.phi.copy()
    m.s.phi_types = lambda i: np.arange(5)
    m.sample(1)
    assert np.allclose(m.phi[:, 5:], before[:, 5:])
    assert np.allclose(m.phi.sum(1), 1)


def test_alias_tables_are_exact():
    w = np.random.default_rng(0).gamma(0.1, size=(300, 7))
    w[0], w[1] = 0, [1, 0, 0, 0, 0, 0, 0]
    cut, alias = draws.alias_tables(w)
    got = cut.copy()
    np.add.at(got, (np.arange(300)[:, None], alias), 1 - cut)
    want = np.where(w.sum(1, keepdims=True) > 0, w / np.maximum(w.sum(1, keepdims=True), 1e-300), 1 / 7)
    assert np.allclose(got / 7, want)


def test_sampler_queries_keep_every_token(spark, small):
    docs, ids = models.corpus(spark, small)
    tokens = TQ._tokens(spark, small)
    assert ids.count() == tokens.select("term").distinct().count() > 1000
    assert docs.agg(F.sum(F.size("types"))).first()[0] == tokens.count()


def test_sampler_queries_use_the_default_sweeps(spark, small, monkeypatch):
    seen = []
    monkeypatch.setattr(lda.TopicModel, "sample", lambda m: seen.append(m.s.iterations) or m)
    models.QUERIES["lda_polyaurn"](spark, small)
    models.QUERIES["lda_priors"](spark, small)
    assert seen == [lda.Settings().iterations] * 2


def test_collapsed_proposals_leave_the_token_out_and_share_moves():  # L9
    n = 600
    z = [np.array([i % 2]) for i in range(n)]
    b = kernels.Batch(np.arange(n), [np.array([i]) for i in range(n)], z, 2)
    own = np.zeros((n, 2))
    own[np.arange(n), np.arange(n) % 2] = 1
    totals = own.sum(0)
    beta = 0.01
    kernels.proposal_sweep(b, own, own + beta, np.ones(2), 3, 1, (own, totals, beta))
    now = np.array([x[0] for x in b.lists()])
    assert (own.argmax(1) == now).all()
    assert (totals == np.bincount(now, minlength=2)).all()
    assert np.mean(now != np.arange(n) % 2) > 0.2  # a word seen once isn't held by its own count


def _ragged(k, docs=300, types=400, seed=2):
    """Documents of very different length, one of them empty, and a phi with zeros and a type of no topic."""
    rng = np.random.default_rng(seed)
    lists = [rng.integers(0, types, n).astype(np.int32) for n in np.minimum(rng.lognormal(3, 1, docs).astype(int), 500)]
    lists[7] = lists[7][:0]
    phi = np.where(rng.random((types, k)) < 0.3, 0.0, rng.random((types, k)))
    phi[5] = 0
    return np.arange(docs) * 7 + 3, lists, pa.array(lists, pa.list_(pa.int32())), phi, rng.uniform(0.05, 1, k)


@pytest.mark.parametrize("k", [1, 7, 300])
def test_step_sweeps_draw_what_the_padded_sweeps_draw(k):  # L1, L3, L4, L7, L8, L20
    ids, lists, types, phi, alpha = _ragged(k)
    old, new = kernels.Batch(ids, lists, None, k), kernels.Steps(ids, types, None, k, 9)
    kernels.initialise(old, 9)
    same = lambda: [x.tolist() for x in old.lists()] == new.lists().to_pylist() and (old.counts.T == new.counts).all()
    assert same()
    kernels.sweep(old, phi, alpha, 9, 1)
    kernels.step_sweep(new, phi, alpha, 9, 1)
    assert same()
    kernels.sweep(old, phi, alpha, 9, 2)
    kernels.step_sweep(new, phi, alpha, 9, 2, new.columns(phi))
    assert same()
    tables = lambda: draws.AliasCache(lambda rows: phi[rows] * alpha, len(phi))
    kernels.sparse_sweep(old, phi, alpha, 9, 3, None, tables())
    kernels.step_sparse_sweep(new, phi, alpha, 9, 3, tables())
    assert same()
    n = np.zeros((len(phi), k))
    np.add.at(n, (np.concatenate(lists), np.concatenate(old.lists())), 1)
    n2, totals, totals2 = n.copy(), n.sum(0), n.sum(0)
    kernels.collapsed_sweep(old, n, totals, alpha, 0.01, 9, 4)
    kernels.step_collapsed_sweep(new, n2, totals2, alpha, 0.01, 9, 4)
    assert same() and (n == n2).all() and (totals == totals2).all()


@pytest.mark.parametrize("k", [1, 6])
def test_left_to_right_of_a_batch(k):  # L32
    ids, lists, types, phi, alpha = _ragged(k, 40)
    got = kernels.left_to_right_all(ids, types, phi, alpha, 4, 20, 2000)
    want = [kernels.left_to_right(x, phi, alpha, int(i), 4, 20) for i, x in zip(ids, lists)]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert kernels.left_to_right_all(ids[:0], types[:0], phi, alpha, 4).shape == (0,)


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_counts_of_a_state(planted, monkeypatch, most):  # L27
    monkeypatch.setattr(lda, "MOST_COUNTED", most)
    m = lda.TopicModel(planted, V, settings(iterations=0))
    want = np.zeros((K, V))
    for r in m.assign().collect():
        want[r.topic, r.type_id] += 1
    assert (m.counts() == want).all()
    assert want.sum() > 0


def test_the_state_is_written_as_one_value_for_each_document(spark, planted):
    m = lda.TopicModel(planted, V, settings(scheme="collapsed", iterations=2)).sample()
    assert dict(m.state.packed.dtypes) == {"doc_id": "bigint", "types": "binary", "z": "binary"}
    assert {r.doc_id: r.types for r in m.state.df.collect()} == {r.doc_id: r.types for r in planted.collect()}
    lists = pa.array([[1, 2, 70_000], [], None, [4]], pa.list_(pa.int32()))
    for part, want in ((lists, [[1, 2, 70_000], [], [], [4]]), (lists.slice(1), [[], [], [4]]), (lists.slice(1, 2), [[], []])):
        assert lda._unpacked(lda._packed(part, lda._numbers(100_000)), lda._numbers(100_000)).to_pylist() == want
    assert lda._unpacked(lda._packed(lists, np.dtype(np.int32)).slice(3), np.dtype(np.int32)).to_pylist() == [[4]]
    with pytest.raises(ValueError, match="out of range"):
        lda._packed(lists, lda._numbers(256))


@pytest.mark.parametrize("most", [0, 20_000_000])
def test_inference_draws_what_the_padded_sweeps_draw(planted, monkeypatch, most):  # L23
    """Whether phi is laid out once for all sweeps or looked up in each."""
    monkeypatch.setattr(lda, "MOST_GATHERED", most)
    phi, alpha = np.random.default_rng(1).dirichlet(np.full(V, 0.3), K), np.array([0.1, 0.2, 0.3, 0.4])
    got = {r.doc_id: r for r in lda.infer(planted, phi, alpha, 5, 2).collect()}
    docs = planted.collect()
    b = kernels.Batch(np.array([r.doc_id for r in docs]), [np.array(r.types, int) for r in docs], None, K)
    kernels.initialise(b, 2)
    for i in range(5):
        kernels.sweep(b, phi.T, alpha, 2, i + 1)
    for r, z in zip(docs, b.lists()):
        assert got[r.doc_id].z == z.tolist()
        assert got[r.doc_id].theta == pytest.approx((np.bincount(z, minlength=K) + alpha) / (len(z) + 1.0))
