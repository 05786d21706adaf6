"""Replicated fits, draws, numbering and fixed effects against dense normal equations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coaffil.operators import fixed_effects, numbering, replicates as R
from coaffil.operators.permuted import permuted_places

XS = ["label", "x1", "x2"]


def dense(y, x, alpha, weight=None, rounds=100):
    """NB2 by Newton's method on the whole matrix."""
    w = np.ones(len(y)) if weight is None else weight
    b = np.zeros(x.shape[1])
    b[0] = math.log(max((w * y).sum() / w.sum(), 1e-9))
    for _ in range(rounds):
        mu = np.exp(x @ b)
        h = (x * (w * mu / (1 + alpha * mu))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (w * (y - mu) / (1 + alpha * mu)))
    return b, np.linalg.inv(h)


def log_likelihood(y, x, b, alpha):
    mu, t = np.exp(x @ b), 1 / alpha
    return sum(math.lgamma(v + t) - math.lgamma(t) - math.lgamma(v + 1) + t * math.log(t / (t + m)) + v * math.log(m / (t + m)) for v, m in zip(y, mu))


def sample(n, seed, share=0.3, effect=0.4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    label = (r.random(n) < share).astype(float)
    mu = np.exp(1 + effect * label + 0.5 * x[:, 0] - 0.2 * x[:, 1])
    return r.poisson(r.gamma(2.0, mu / 2.0)), label, x


def as_frame(spark, y, label, x, more=()):
    rows = [(i, int(a), float(b), float(c), float(d), *m) for i, (a, b, (c, d), *m) in enumerate(zip(y, label, x, *more))]
    names = "id long, y long, label double, x1 double, x2 double" + "".join(f", m{k} {'string' if isinstance(v[0], str) else 'double'}" for k, v in enumerate(more))
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="module")
def data(spark):
    y, label, x = sample(700, 1)
    return y, label, x, as_frame(spark, y, label, x)


def design(label, x):
    return np.column_stack([np.ones(len(label)), label, x])


def test_given_and_estimated_dispersion(data):
    y, label, x, df = data
    found = R.blocks(df, "y", XS, ["id"], leaf=64)
    m = design(label, x)
    for alpha in (0.0, 0.7):
        got = R.fit(found, alpha=alpha, leaf=64)["all"]
        b, inverse = dense(y, m, alpha)
        assert np.allclose(got.coef[0], b, atol=1e-8) and np.allclose(got.se()[0], np.sqrt(np.diag(inverse)), rtol=1e-7) and got.converged[0] and got.n[0] == 700
    got = R.fit(found, leaf=64)["all"]
    alpha = got.alpha[0]
    b, _ = dense(y, m, alpha)
    assert np.allclose(got.coef[0], b, atol=1e-7)
    best = log_likelihood(y, m, b, alpha)
    for other in (alpha * 0.98, alpha * 1.02):
        assert log_likelihood(y, m, dense(y, m, other)[0], other) < best


def test_blocks_without_an_order_fit_alike(data):
    y, label, x, df = data
    loose = R.blocks(df, "y", XS, [], leaf=64)
    assert loose.strata == {("all", ""): (700, label.sum())} and loose.df.count() <= 11
    got = R.fit(loose, alpha=0.7, leaf=64)["all"]
    assert np.allclose(got.coef[0], dense(y, design(label, x), 0.7)[0], atol=1e-8) and got.n[0] == 700
    with pytest.raises(ValueError):
        R.fit(loose, R.Draws("permute", 3), alpha=1.0)


def test_dispersion_by_group_and_diverged_groups(spark):
    parts, want = [], {}
    for g, (n, seed) in {"a": (300, 2), "b": (200, 3)}.items():
        y, label, x = sample(n, seed)
        parts.append(as_frame(spark, y, label, x).withColumn("g", F.lit(g)))
        want[g] = (y, design(label, x))
    y, label, x = sample(60, 4)
    none = as_frame(spark, np.where(label == 1, 0, y), label, x).withColumn("g", F.lit("zero arm"))
    flat = as_frame(spark, y, np.zeros(60), x).withColumn("g", F.lit("one arm"))
    got = R.fit(R.blocks(parts[0].union(parts[1]).union(none).union(flat), "y", XS, ["id"], group="g"))
    for g, (y, m) in want.items():
        assert got[g].converged[0]
        assert np.allclose(got[g].coef[0], dense(y, m, got[g].alpha[0])[0], atol=1e-6)
        score = [log_likelihood(y, m, got[g].coef[0], got[g].alpha[0] * f) for f in (0.99, 1, 1.01)]
        assert max(score) == score[1]
    assert not got["zero arm"].converged[0] and not got["one arm"].converged[0]


def test_a_poisson_sample_ends_at_the_bound(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 2))
    label = (r.random(400) < 0.5).astype(float)
    y = np.rint(np.exp(1 + 0.2 * x[:, 0]))  # spread below Poisson's
    got = R.fit(R.blocks(as_frame(spark, y, label, x), "y", XS, ["id"]))["all"]
    assert got.converged[0] and got.alpha[0] < 1e-6
    assert np.allclose(got.coef[0], dense(y, design(label, x), 0.0)[0], atol=1e-5)


def test_permutations_keep_counts_and_refit_like_dense_ones(data):
    y, label, x, df = data
    leaf, reps, seed = 64, 40, 11
    found = R.blocks(df, "y", XS, ["id"], leaf=leaf)
    got = R.fit(found, R.Draws("permute", reps, seed), alpha=0.5, leaf=leaf)["all"]
    drawn = np.concatenate([R.leaf_draw("permute", seed, "", 700, int(label.sum()), reps, at, leaf) for at in range(-(-700 // leaf))])
    assert (drawn.sum(0) == label.sum()).all() and len({tuple(c) for c in drawn.T}) == reps
    for k in range(0, reps, 7):
        assert np.allclose(got.coef[k], dense(y, design(drawn[:, k].astype(float), x), 0.5)[0], atol=1e-7)
    again = R.fit(found, R.Draws("permute", reps, seed), alpha=0.5, leaf=leaf)["all"]
    assert np.allclose(again.coef, got.coef, atol=1e-10) and got.converged.all()


def test_draws_are_uniform():
    # Of 5 labels on 12 rows each row has 5 / 12; pairs fall together as without replacement, across leaves too.
    drawn = np.concatenate([R.leaf_draw("permute", 3, "s", 12, 5, 20000, at, 5) for at in range(3)]).astype(float)
    assert np.abs(drawn.mean(1) - 5 / 12).max() < 0.02
    both = drawn @ drawn.T / 20000
    assert np.abs(both[~np.eye(12, dtype=bool)] - 5 * 4 / (12 * 11)).max() < 0.02
    picks = np.concatenate([R.leaf_draw("bootstrap", 3, "s", 12, 12, 20000, at, 5) for at in range(3)])
    assert (picks.sum(0) == 12).all() and np.abs(picks.mean(1) - 1).max() < 0.05 and np.abs(picks.var(1) - 11 / 12).max() < 0.06


def test_strata_and_dealt_counts(spark):
    y, label, x = sample(300, 8)
    strata = np.array([f"s{i % 4}" if i < 280 else "s9" for i in range(300)], object)
    found = R.blocks(as_frame(spark, y, label, x, [strata.tolist()]), "y", XS, ["id"], stratum="m0", leaf=32)
    assert {s: n for (_, s), (n, _) in found.strata.items()} == {s: int((strata == s).sum()) for s in set(strata)}
    for (_, s), (n, total) in found.strata.items():
        assert total == label[strata == s].sum()
        drawn = np.concatenate([R.leaf_draw("permute", 2, s, n, int(total), 9, at, 32) for at in range(-(-n // 32))])
        assert (drawn.sum(0) == total).all()
    got = R.fit(found, R.Draws("permute", 9, 2), alpha=1.0, leaf=32)["all"]
    k = 4
    new = np.zeros(300)
    for s in set(strata):
        n, total = found.strata["all", s]
        new[strata == s] = np.concatenate([R.leaf_draw("permute", 2, s, n, int(total), 9, at, 32) for at in range(-(-n // 32))])[:, k]
    assert np.allclose(got.coef[k], dense(y, design(new, x), 1.0)[0], atol=1e-7)
    counts = tuple(sorted((s, n, int(t)) for (_, s), (n, t) in found.strata.items()))
    dealt = R.dealt_totals(6, counts, 500)
    for s, n, _ in counts:
        assert max(dealt[s]) <= n
    assert len(R.fit(found, R.Draws("deal", 5, 6, counts=counts), alpha=1.0, leaf=32)["all"].coef) == 5


def test_bootstrap_leave_out_and_losses(spark):
    y, label, x = sample(150, 9)
    code = np.arange(150) % 3
    loss = np.array([[min(int(v), k) if (i + k) % 11 else -1 for k in range(4)] for i, v in enumerate(y)], "<i4")
    df = as_frame(spark, y, label, x, [code.astype(float).tolist()])
    packed = spark.createDataFrame([(i, bytearray(row.tobytes())) for i, row in enumerate(loss)], "id long, loss binary")
    found = R.blocks(df.join(packed, "id"), "y", XS, ["id"], extra=("m0", "loss"), leaf=40)
    m = design(label, x)
    boot = R.fit(found, R.Draws("bootstrap", 6, 4), alpha=0.4, leaf=40)["all"]
    picks = np.concatenate([R.leaf_draw("bootstrap", 4, "", 150, 150, 6, at, 40) for at in range(4)]).astype(float)
    assert np.allclose(boot.coef[2], dense(y, m, 0.4, picks[:, 2])[0], atol=1e-7) and (boot.n == 150).all()
    left = R.fit(found, R.Draws("leave", 3, extra="m0"), alpha=0.4, leaf=40)["all"]
    for k in range(3):
        assert np.allclose(left.coef[k], dense(y[code != k], m[code != k], 0.4)[0], atol=1e-7) and left.n[k] == 100
    without = R.fit(found, R.Draws("without", 4, extra="loss"), alpha=0.4, leaf=40)["all"]
    for k in range(4):
        kept = loss[:, k] >= 0
        assert np.allclose(without.coef[k], dense((y - loss[:, k])[kept], m[kept], 0.4)[0], atol=1e-7)
    sums = R.label_sums(found, R.Draws("permute", 30, 5), "m0", leaf=40)["all"]
    drawn = np.concatenate([R.leaf_draw("permute", 5, "", 150, int(label.sum()), 30, at, 40) for at in range(4)])
    assert np.allclose(sums, (drawn * code[:, None]).sum(0))


def test_remainders_are_permuted_whole(data, spark):
    y, label, x, df = data
    m = np.column_stack([np.ones(700), x])
    fitted = m @ np.linalg.lstsq(m, label, rcond=None)[0]
    rest = label - fitted
    more = spark.createDataFrame([(i, float(v)) for i, v in enumerate(fitted)], "id long, stay double")
    found = R.blocks(df.join(more, "id"), "y", XS, ["id"], extra=("stay",), leaf=64)
    shared = spark.sparkContext.broadcast(rest)
    got = R.fit(found, R.Draws("shift", 5, 3, extra="stay", rest=shared), alpha=0.5, leaf=64)["all"]
    places = permuted_places(np.arange(700), 700, 3, np.arange(5))
    for k in range(5):
        assert sorted(places[:, k]) == list(range(700))
        assert np.allclose(got.coef[k], dense(y, design(fitted + rest[places[:, k]], x), 0.5)[0], atol=1e-7)


def test_special_functions():
    psi, tri = R.digamma_pair(np.array([1.0, 0.5, 1e-3, 10.0, 1e6]))
    euler = 0.5772156649015329
    assert np.allclose(psi[:2], [-euler, -euler - 2 * math.log(2)], atol=1e-12) and np.allclose(tri[:2], [math.pi**2 / 6, math.pi**2 / 2], atol=1e-10)
    for v, a in zip((1e-3, 10.0, 1e6), psi[2:]):
        h = v * 1e-4
        assert abs((math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) / a - 1) < 1e-5


def test_row_numbers_and_bins(spark):
    r = random.Random(3)
    rows = [(r.randrange(50), i) for i in range(333)]
    df = spark.createDataFrame(rows, "k long, id long").repartition(7)
    numbered, total = numbering.with_row_numbers(df, "k", "id")
    assert total == 333 and [(x.k, x.id) for x in numbered.orderBy("row_number").collect()] == sorted(rows)
    assert [x.row_number for x in numbered.select("row_number").orderBy("row_number").collect()] == list(range(333))
    for bins in (1, 5, 10, 400):
        got = {x.row_number: x.b for x in numbered.select("row_number", numbering.quantile_bin(F.col("row_number"), total, bins).alias("b")).collect()}
        want = [k + 1 for k in range(bins) for _ in range(333 // bins + (k < 333 % bins))]
        assert [got[i] for i in range(333)] == want
    none, zero = numbering.with_row_numbers(df.where("k > 99"), "k")
    assert (none.count(), zero) == (0, 0)


def test_fixed_effects_equal_the_design_with_a_column_a_group(spark):
    r = np.random.default_rng(12)
    groups = 200
    g = r.integers(0, groups, 3000)
    x = r.normal(size=(3000, 2))
    label = (r.random(3000) < 0.3).astype(float)
    effect = r.normal(size=groups)
    y = r.poisson(r.gamma(1.5, np.exp(0.6 + effect[g] + 0.3 * label + 0.2 * x[:, 0]) / 1.5))
    y[g == 7] = 0
    df = as_frame(spark, y, label, x, [[f"g{v}" for v in g]])
    for bound in (1 << 20, 1):
        got = fixed_effects.fixed_effects_fit(df, XS, "m0", y="y", alpha=0.6, broadcast_groups=bound)
        empty = {v for v in set(g) if not y[g == v].sum()}
        kept = np.array([v not in empty for v in g])
        used = sorted(set(g[kept]))
        m = np.column_stack([label[kept], x[kept], *[(g[kept] == v).astype(float) for v in used]])
        b = np.zeros(m.shape[1])
        for _ in range(60):
            mu = np.exp(m @ b)
            h = (m * (mu / (1 + 0.6 * mu))[:, None]).T @ m
            b += np.clip(np.linalg.solve(h, m.T @ ((y[kept] - mu) / (1 + 0.6 * mu))), -2, 2)
        assert got.converged and got.groups == len(used) and got.groups_dropped == len(empty) and got.rows == kept.sum()
        assert np.allclose(got.coef, b[:3], atol=1e-7) and np.allclose(got.inverse, np.linalg.inv(h)[:3, :3], rtol=1e-6, atol=1e-10)
        own = {e.g: e.effect for e in got.effects.collect()}
        assert max(abs(own[f"g{v}"] - b[3 + k]) for k, v in enumerate(used)) < 1e-6
