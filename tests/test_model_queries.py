"""The regression queries on the smallest tables, few draws: they hold together where covariates are constant and arms small."""

import os

import pytest

from coaffil.plans import model_queries as M

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(autouse=True)
def few(monkeypatch):
    for name in ("PERMUTATIONS", "BOOTSTRAPS", "RESIDUALS", "SPEC_PERMUTATIONS", "PLACEBO_FITS"):
        monkeypatch.setattr(M, name, 15)


@pytest.mark.parametrize("name", [n for n in M.QUERIES if n not in M.ORACLE and not n.startswith("subsample")])
def test_runs_on_the_smallest_tables(spark, name):
    df = M.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert len(rows) >= 1 and len(set(df.columns)) == len(df.columns)


def test_specifications_agree_with_each_other(spark):
    rows = {r.spec: r for r in M.spec_fits(spark, DATA).collect()}
    headline = M.nb_glm(spark, DATA).where("term = 'treated'").first()
    assert rows["headline"].converged == headline.converged
    if headline.converged:
        assert abs(rows["headline"].coef - headline.coef) < 1e-7 and rows["headline"].log_effect_removed == 0
    assert {"cap_4", "cap_6", "cap_8", "cap_10", "fractional", "author_supported", "joint_perturbation", "headline_productivity"} < set(rows)
    # No work has ten institutions, so the widest caps take nothing away.
    assert rows["cap_10"].n == rows["headline"].n and rows["cap_10"].coef == pytest.approx(rows["headline"].coef)


def test_subsample_of_all_works_is_the_frame(spark):
    from coaffil.plans.views import spark_view

    whole, capped = M.subsample_frames(spark, DATA, 10**9, 2, 6, 7)
    names = ["std", "treated", "degree", "log_univ", "log_station", "log_junction", "log_papers"]
    rounded = lambda df: sorted(tuple(round(float(v), 9) for v in r) for r in df.select(*names).collect())
    want = rounded(spark_view(spark, DATA, "frame"))
    assert rounded(whole.where("rep = 1")) == want == rounded(whole.where("rep = 2"))
    under = spark_view(spark, DATA, "capped").where("cap = 6")
    assert sorted((r.std, r.degree) for r in capped.where("rep = 2").collect()) == sorted((r.std, r.degree) for r in under.collect())
    few, _ = M.subsample_frames(spark, DATA, 40, 3, 6, 7)
    assert few.select("rep").distinct().count() == 3 and few.count() < 3 * len(want)


def test_subsample_rows_have_all_clauses(spark):
    rows = M.subsample_rows(spark, DATA, works=800, draws=2, permutations=9)
    assert [r[0] for r in rows] == [1, 2] and all(len(r) == 15 for r in rows)
    for r in rows:
        assert r[11] is None or r[11] == (r[4] < 0.05 and r[3] > 1)


def test_specifications_come_from_one_pass_over_the_works(spark, monkeypatch):
    """Caps, fractions and author support used to be joined from pairs of their own each; now no pairs are formed."""
    from coaffil.operators import network

    def fail(*a, **k):
        raise AssertionError("pairs of a work are formed again")

    for name in ("row_pairs", "coaffil_edges", "author_supported_edges"):
        monkeypatch.setattr(network, name, fail)
    specs = M.spec_frame(spark, DATA)
    assert specs.select("spec").distinct().count() == 8
    one = {r.spec: r.s for r in specs.groupBy("spec").agg({"degree": "sum"}).withColumnRenamed("sum(degree)", "s").collect()}
    assert one["cap_4"] <= one["cap_6"] <= one["headline"] and one["author_supported"] <= one["headline"]
