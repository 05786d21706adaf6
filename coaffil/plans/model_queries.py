"""Regression queries over the analysis frame.

Fits are NB2 with the label and three covariates; the dispersion is estimated by maximum likelihood
for each specification and kept in its permutations and bootstraps.  Replicates that don't converge
are counted and left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exclusion
from ..operators import inference as I
from ..operators import network
from ..operators import replicates as R
from ..operators.fixed_effects import fixed_effects_fit
from ..operators.hashed import paired_sums
from ..operators.network import checkpointed
from ..operators.numbering import quantile_bin, with_row_numbers
from .sql_queries import BOOTSTRAPS as PAIRED_DRAWS, DRAWS, PAIRED, PERMUTATIONS as DRAWS_PERMUTED, PLACEBO, PLACEBOS, RADII, SQL, draw_statistics
from .views import CAPS, capped_of, for_spark, profile, run_sql, spark_view, tile, with_views

COVARIATES = ["log_univ", "log_station", "log_junction"]
XS = ["treated", *COVARIATES]
#: Draws with a refit each.
PERMUTATIONS, BOOTSTRAPS, RESIDUALS, SPEC_PERMUTATIONS, PLACEBO_FITS = 5000, 2000, 5000, 500, 1000
EQUIVALENCE = (0.8, 1.25)
SUMMARY = "n long, treated long, coef double, se double, irr double, ci95_low double, ci95_high double, ci90_low double, ci90_high double, p double, alpha double, converged boolean"
Z90 = 1.6448536269514722


def _frame(spark: SparkSession, d: str) -> DataFrame:
    """Estimation frame, cut from its lineage once: every round of a fit reads it again."""
    return checkpointed(spark_view(spark, d, "frame"))


def _catchments(spark: SparkSession, d: str) -> DataFrame:
    """(std, anchor): the nearest anchor of most of an institution's rows, the lowest of ties."""
    return run_sql(spark, d, """SELECT std, min_by(anchor, -n * 1000000 + anchor) AS anchor FROM (
        SELECT affil.std, m.anchor, count(*) AS n FROM affil JOIN matches m ON m.raw = affil.raw GROUP BY affil.std, m.anchor) c GROUP BY std""")


def _quantile(values: np.ndarray, q: float) -> float | None:
    """Percentile of the draws, null where there is none."""
    return float(np.percentile(values, q)) if len(values) else None


def _deviation(values: np.ndarray) -> float | None:
    return float(values.std(ddof=1)) if len(values) > 1 else None


def _mean(values: np.ndarray) -> float | None:
    return float(values.mean()) if len(values) else None


def _start(fits: R.Fits) -> np.ndarray:
    """Coefficients to start permuted fits from: those observed, without the label's."""
    b = fits.coef[0].copy()
    b[1] = 0.0
    return b


def _treated(found: R.Blocks) -> dict[str, int]:
    out: dict[str, int] = {}
    for (g, _), (_, label) in found.strata.items():
        out[g] = out.get(g, 0) + int(round(label))
    return out


def _summary(fits: R.Fits, treated: int, k: int = 0) -> tuple:
    """One row of a fit: the label's coefficient with its intervals; nulls where the fit did not converge."""
    n, ok = int(fits.n[k]), bool(fits.converged[k])
    if not ok:
        return (n, treated, *(None,) * 9, False)
    c, se = float(fits.coef[k, 1]), float(fits.se()[k, 1])
    bounds = [math.exp(c + z * se) for z in (-I.Z95, I.Z95, -Z90, Z90)]
    return (n, treated, c, se, math.exp(c), *bounds, I._p_value(c / se), float(fits.alpha[k]), True)


def _terms(spark, fits: R.Fits, xs: list[str], spec: str) -> DataFrame:
    """Long table of one fit; no rows but a flag would be of use where it did not converge, so coefficients are null then."""
    se, ok, rows = fits.se()[0], bool(fits.converged[0]), []
    for t, c, s in zip(["const", *xs], fits.coef[0].tolist(), se.tolist()):
        known = (c, s, math.exp(min(c, 700.0)), math.exp(min(c - I.Z95 * s, 700.0)), math.exp(min(c + I.Z95 * s, 700.0)), I._p_value(c / s)) if ok else (None,) * 6
        rows.append((spec, t, *known, float(fits.alpha[0]), ok))
    return spark.createDataFrame(rows, "spec string, term string, coef double, se double, ratio double, ci95_low double, ci95_high double, p double, alpha double, converged boolean")


def _fitted(spark, d, xs: list[str] | None = None, alpha: float | None = None, draws: bool = False):
    """Frame, its blocks (in order where draws will follow) and the fit."""
    frame = _frame(spark, d)
    found = R.blocks(frame, "degree", xs or XS, ["std"] if draws else [])
    return frame, found, R.fit(found, alpha=alpha)["all"]


def nb_glm_binary(spark, d):
    fits = _fitted(spark, d, ["treated"], 1.0)[2]
    return _terms(spark, fits, ["treated"], "binary").where("term = 'treated'").select("term", F.round("coef", 6).alias("coef"))


def nb_glm(spark, d):
    return _terms(spark, _fitted(spark, d)[2], XS, "headline")


def nb_dispersion(spark, d):
    fits = _fitted(spark, d)[2]
    return spark.createDataFrame([(float(fits.alpha[0]), float(fits.coef[0, 1]), bool(fits.converged[0]))], "alpha double, coef double, converged boolean")


def nb_glm_alpha1(spark, d):
    return _terms(spark, _fitted(spark, d, alpha=1.0)[2], XS, "alpha1")


def nb_glm_productivity(spark, d):
    xs = [*XS, "log_papers"]
    return _terms(spark, _fitted(spark, d, xs)[2], xs, "productivity")


def nb_vs_poisson(spark, d):
    frame, found, fits = _fitted(spark, d)
    poisson = R.fit(found, alpha=0.0)["all"]
    nb, po = I.log_likelihood(frame, XS, fits.coef[0], float(fits.alpha[0])), I.log_likelihood(frame, XS, poisson.coef[0], 0.0)
    p = len(XS) + 1
    return spark.createDataFrame([(nb, po, 2 * (nb - po), 2 * (p + 1) - 2 * nb, 2 * p - 2 * po)], "ll_nb double, ll_poisson double, lr double, aic_nb double, aic_poisson double")


def nb_fixed_effects(spark, d):
    """Effects of countries beside the covariates, with the dispersion of the model without them."""
    frame, _, fits = _fitted(spark, d)
    got = fixed_effects_fit(frame, XS, "country", alpha=float(fits.alpha[0]))
    c, se = float(got.coef[0]), math.sqrt(got.inverse[0, 0]) if got.converged else math.nan
    with_treated = frame.where("treated = 1 and country is not null").select("country").distinct().count()
    row = (got.rows, got.groups, got.groups_dropped, with_treated, c, se, math.exp(c), math.exp(c - I.Z95 * se), math.exp(c + I.Z95 * se), I._p_value(c / se), float(fits.alpha[0]), got.converged)
    return spark.createDataFrame([row], "n long, countries long, countries_dropped long, countries_with_treated long, coef double, se double, irr double, ci95_low double, ci95_high double, p double, alpha double, converged boolean")


# --- specifications --------------------------------------------------------------------------------


SPEC_COLUMNS = ["std", "treated", *COVARIATES, "log_papers", "country"]


def _headline(rows: DataFrame, degree: str = "degree", spec: str = "headline") -> DataFrame:
    return rows.select(*SPEC_COLUMNS, F.col(degree).cast("double").alias("degree"), F.lit(spec).alias("spec"))


def _under_caps(rows: DataFrame, least: int = 4) -> DataFrame:
    spec = F.concat(F.lit("cap_"), F.col("cap").cast("string")).alias("spec")
    return capped_of(rows).where(F.col("cap") >= least).select(*SPEC_COLUMNS, F.col("degree").cast("double").alias("degree"), spec)


def spec_frame(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """The frame under each specification: columns of the frame, and spec.

    Caps leave out works of as many institutions or more and rebuild the degrees; the joint
    perturbation also takes the label from institutions whose nearest anchor is in doubt.  All
    degrees come from one ``profile`` (``rows``, with all caps and authors).
    """
    rows = _spec_rows(spark, d) if rows is None else rows
    doubtful = run_sql(spark, d, "SELECT m.raw FROM matches m JOIN anchors a ON a.anchor = m.anchor WHERE a.name LIKE '%IA%'").distinct().withColumn("doubtful", F.lit(True))
    joint = rows.join(network.small(checkpointed(doubtful)), "raw", "left").withColumn("treated", F.when(F.col("doubtful"), 0).otherwise(F.col("treated")))
    out = _headline(rows).unionByName(_under_caps(rows))
    out = out.unionByName(_under_caps(joint).where("spec = 'cap_10'").withColumn("spec", F.lit("joint_perturbation")))
    return out.unionByName(_headline(rows, "fractional", "fractional")).unionByName(_headline(rows, "supported", "author_supported"))


def _spec_rows(spark, d) -> DataFrame:
    return profile(spark, d, CAPS, "author")


def _spec_fits(spark, d, rows: DataFrame | None = None, draws: bool = True):
    found = R.blocks(spec_frame(spark, d, rows), "degree", XS, ["std"] if draws else [], group="spec")
    return found, R.fit(found)


def _removed(fits: dict[str, R.Fits], spec: str, base: str = "headline") -> float | None:
    """Share of the base's log effect that a specification takes away."""
    if not (fits[spec].converged[0] and fits[base].converged[0]) or not fits[base].coef[0, 1]:
        return None
    return 1 - float(fits[spec].coef[0, 1] / fits[base].coef[0, 1])


def spec_fits(spark, d):
    """One fit a specification, each with its own dispersion, and the productivity-controlled headline."""
    base = _spec_rows(spark, d)
    found, fits = _spec_fits(spark, d, base, draws=False)
    treated = _treated(found)
    rows = [(s, *_summary(f, treated[s]), _removed(fits, s)) for s, f in sorted(fits.items())]
    more = R.fit(R.blocks(base, "degree", [*XS, "log_papers"], []))["all"]
    rows.append(("headline_productivity", *_summary(more, treated["headline"]), _removed({"headline": fits["headline"], "p": more}, "p")))
    return spark.createDataFrame(rows, f"spec string, {SUMMARY}, log_effect_removed double")


def spec_permutations(spark, d):
    """Permutation p and bootstrap of each specification, with the dispersion of its own fit."""
    found, fits = _spec_fits(spark, d)
    kept = {s: f for s, f in fits.items() if f.converged[0]}
    alpha, start = {s: float(f.alpha[0]) for s, f in fits.items()}, {s: _start(f) for s, f in kept.items()}
    perm = R.fit(found, R.Draws("permute", SPEC_PERMUTATIONS, 8), alpha=alpha, start=start)
    boot = R.fit(found, R.Draws("bootstrap", SPEC_PERMUTATIONS, 9), alpha=alpha, start={s: f.coef[0] for s, f in kept.items()})
    rows = []
    for s, f in sorted(fits.items()):
        if s not in kept:
            rows.append((s, *(None,) * 8))
            continue
        c, p, b = float(f.coef[0, 1]), perm[s], boot[s]
        drawn = b.coef[b.converged, 1]
        sd, ratios = _deviation(drawn), np.exp(drawn)
        rows.append((s, c, _permutation_p(c, p), int((~p.converged).sum()), sd, _quantile(ratios, 2.5), _quantile(ratios, 97.5), I.tost(c, sd, *EQUIVALENCE) if sd else None, int((~b.converged).sum())))
    return spark.createDataFrame(rows, "spec string, coef double, permutation_p double, permutations_dropped long, bootstrap_sd double, bootstrap_low double, bootstrap_high double, tost_p_bootstrap double, bootstraps_dropped long")


def covariate_attenuation(spark, d):
    """Each coefficient in the headline, under a cap of 10 and counted fractionally, and the shares removed."""
    _, fits = _spec_fits(spark, d, draws=False)
    specs = ["headline", "cap_10", "fractional"]
    rows = []
    for k, t in enumerate(XS):
        h, c, f = (float(fits[s].coef[0, k + 1]) if fits[s].converged[0] else None for s in specs)
        rows.append((t, h, c, f, *(1 - v / h if h and v is not None else None for v in (c, f))))
    return spark.createDataFrame(rows, "term string, headline double, cap_10 double, fractional double, removed_cap_10 double, removed_fractional double")


def threshold_fits(spark, d):
    """The label by each match radius, fitted at dispersion 1; radii with fewer than 5 labelled institutions are left out."""
    frame = run_sql(spark, d, f"""SELECT x.radius, f.std, f.degree, CASE WHEN 2 * x.yes > x.n THEN 1 ELSE 0 END AS treated, f.log_univ, f.log_station, f.log_junction FROM (
        SELECT q.radius, affil.std, sum(CASE WHEN m.distance <= q.radius THEN 1 ELSE 0 END) AS yes, count(m.distance) AS n FROM affil LEFT JOIN matches m ON m.raw = affil.raw CROSS JOIN {RADII} q GROUP BY q.radius, affil.std) x
        JOIN frame f ON f.std = x.std""").withColumn("radius", F.col("radius").cast("long"))
    found = R.blocks(frame, "degree", XS, [], group="radius")
    treated = _treated(found)
    rows = [(int(g), *_summary(f, treated[g])) for g, f in sorted(R.fit(found, alpha=1.0).items(), key=lambda x: int(x[0])) if treated[g] >= 5]
    return spark.createDataFrame(rows, f"radius long, {SUMMARY}")


def leave_one_out_fits(spark, d):
    """The headline without each country in turn, at dispersion 1."""
    frame = _frame(spark, d)
    counts = sorted((r.country, r.n, r.t) for r in frame.where("country is not null").groupBy("country").agg(F.count("*").alias("n"), F.sum("treated").alias("t")).collect())
    codes = spark.createDataFrame([(c, float(k)) for k, (c, _, _) in enumerate(counts)], "country string, code double")
    coded = frame.join(F.broadcast(codes), "country", "left").na.fill(-1.0, ["code"])  # a row a country
    found = R.blocks(coded, "degree", XS, [], extra=("code",))
    fits = R.fit(found, R.Draws("leave", len(counts), extra="code"), alpha=1.0)["all"]
    treated = _treated(found)["all"]
    rows = [(c, *_summary(fits, treated - t, k)) for k, (c, _, t) in enumerate(counts)]
    return spark.createDataFrame(rows, f"country string, {SUMMARY}")


def vintage_fits(spark, d):
    """Headline, cap 10 and fractional with the density counted within half the radius, and their shares of its log effect."""
    close = spark_view(spark, d, "close_raw").select("raw", F.col("around").alias("close"))
    rows = profile(spark, d, (10,)).join(network.small(checkpointed(close)), "raw", "left")
    rows = checkpointed(rows.withColumn("log_univ", F.log1p(F.coalesce("close", F.lit(0)).cast("double"))))
    capped = capped_of(rows, (10,)).select(*SPEC_COLUMNS, F.col("degree").cast("double").alias("degree"), F.lit("cap_10").alias("spec"))
    frame = _headline(rows).unionByName(capped).unionByName(_headline(rows, "fractional", "fractional"))
    found = R.blocks(frame, "degree", XS, [], group="spec")
    fits, treated = R.fit(found), _treated(found)
    return spark.createDataFrame([(s, *_summary(f, treated[s]), _removed(fits, s)) for s, f in sorted(fits.items())], f"spec string, {SUMMARY}, log_effect_removed double")


def vif_model(spark, d):
    """Variance inflation of each predictor of the productivity model: the diagonal of the inverse correlation matrix.

    Null for a constant predictor; infinite for all where they are collinear.
    """
    xs = [*XS, "log_papers"]
    frame = spark_view(spark, d, "frame")
    upper = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    x = [F.col(c).cast("double") for c in xs]
    cells = frame.agg(*[F.covar_pop(x[i], x[j]) for i, j in upper]).first()
    v = np.zeros((len(xs), len(xs)))
    for c, (i, j) in zip(cells, upper):
        v[i, j] = v[j, i] = c or 0.0
    varied = np.diag(v) > 1e-12
    sd = np.sqrt(np.diag(v)[varied])
    c = v[np.ix_(varied, varied)] / np.outer(sd, sd)
    values = np.diag(np.linalg.inv(c)).tolist() if varied.any() and np.linalg.cond(c) < 1e12 else [math.inf] * int(varied.sum())
    found = dict(zip(np.array(xs)[varied].tolist(), values))
    return spark.createDataFrame([(t, found.get(t)) for t in xs], "term string, vif double")


# --- tests and errors ------------------------------------------------------------------------------


def tost(spark, d):
    """Equivalence of the label's rate ratio: normal and Student's form, and with the bootstrap's standard deviation."""
    _, found, fits = _fitted(spark, d, draws=True)
    c, se, df = float(fits.coef[0, 1]), float(fits.se()[0, 1]), int(fits.n[0]) - len(XS) - 1
    boot = R.fit(found, R.Draws("bootstrap", SPEC_PERMUTATIONS, 31), alpha=float(fits.alpha[0]), start={"all": fits.coef[0]})["all"]
    sd = _deviation(boot.coef[boot.converged, 1])
    rows = [(form, c, e, I.tost(c, e, *EQUIVALENCE, df=k) if e and fits.converged[0] else None) for form, e, k in (("normal", se, None), ("student", se, df), ("bootstrap", sd, None))]
    return spark.createDataFrame(rows, "form string, coef double, se double, p double").withColumn("equivalent", F.col("p") < 0.05)


def sandwich_se(spark, d):
    frame, _, fits = _fitted(spark, d)
    hc0, hc3 = (I.sandwich(frame, XS, fits.coef[0], fits.inverse[0], float(fits.alpha[0]), leverage=k) for k in (False, True))
    return spark.createDataFrame([(t, *map(float, v)) for t, *v in zip(["const", *XS], fits.coef[0], fits.se()[0], hc0, hc3)], "term string, coef double, model_se double, hc0 double, hc3 double")


def cluster_se(spark, d):
    """Standard errors clustered by country and by the catchment of the nearest anchor; rows without one are a cluster together."""
    frame, _, fits = _fitted(spark, d)
    frame = checkpointed(frame.join(_catchments(spark, d), "std", "left").withColumn("catchment", F.coalesce(F.col("anchor").cast("string"), F.lit(""))).na.fill("", ["country"]))
    country, catchment = (I.sandwich(frame, XS, fits.coef[0], fits.inverse[0], float(fits.alpha[0]), cluster=c) for c in ("country", "catchment"))
    return spark.createDataFrame([(t, *map(float, v)) for t, *v in zip(["const", *XS], fits.coef[0], country, catchment)], "term string, coef double, country_se double, catchment_se double")


# --- permutations ----------------------------------------------------------------------------------


def _permutation_p(seen: float, fits: R.Fits) -> float:
    drawn = fits.coef[fits.converged, 1]
    return float((np.sum(np.abs(drawn) >= abs(seen)) + 1) / (len(drawn) + 1))


def _null_row(scheme: str, strata: int, seen: float, fits: R.Fits) -> tuple:
    """Statistics of the draws that converged; nulls where fewer than two did."""
    c = fits.coef[fits.converged, 1]
    if len(c) < 2 or not c.std():
        return (scheme, strata, seen, len(c), int((~fits.converged).sum()), _permutation_p(seen, fits), *(None,) * 9)
    sd, size = float(c.std(ddof=1)), np.abs(c)
    off = c - c.mean()
    p95, p99 = (float(np.percentile(size, q)) for q in (95, 99))
    return (
        scheme, strata, seen, len(c), int((~fits.converged).sum()), _permutation_p(seen, fits), float(c.mean()), sd, float((off**3).mean() / (off**2).mean() ** 1.5),
        float((off**4).mean() / (off**2).mean() ** 2 - 3), p95, p99, p95 / sd, float((size > 3 * sd).mean()), abs(seen) / sd,
    )


NULL = "scheme string, strata long, coef double, draws long, draws_dropped long, p double, mean double, sd double, skew double, kurtosis double, p95 double, p99 double, p95_over_sd double, beyond_3sd double, observed_over_sd double"


def label_permutation(spark, d):
    """The label dealt anew over all rows, the whole model refitted for each draw; p95 is the critical value."""
    _, found, fits = _fitted(spark, d, draws=True)
    drawn = R.fit(found, R.Draws("permute", PERMUTATIONS, 17), alpha=float(fits.alpha[0]), start={"all": _start(fits)})["all"]
    return spark.createDataFrame([_null_row("unrestricted", 1, float(fits.coef[0, 1]), drawn)], NULL)


def stratified_permutation_fits(spark, d):
    """The label dealt inside countries, density quintiles and deciles, and by catchment, with full refits."""
    frame, _, fits = _fitted(spark, d)
    seen, alpha, start = float(fits.coef[0, 1]), float(fits.alpha[0]), {"all": _start(fits)}
    ranked, n = with_row_numbers(frame, "log_univ", "std")
    ranked = ranked.join(_catchments(spark, d), "std", "left")
    schemes = {
        "country": F.coalesce("country", F.lit("")), "density_quintile": quantile_bin(F.col("row_number"), n, 5).cast("string"),
        "density_decile": quantile_bin(F.col("row_number"), n, 10).cast("string"), "catchment": F.coalesce(F.col("anchor").cast("string"), F.lit("")),
    }
    rows = []
    for name, column in schemes.items():
        found = R.blocks(ranked.withColumn("stratum", column), "degree", XS, ["std"], stratum="stratum")
        counts = tuple(sorted((s, size, int(round(t))) for (_, s), (size, t) in found.strata.items()))
        kind = R.Draws("deal", SPEC_PERMUTATIONS, 3, counts=counts) if name == "catchment" else R.Draws("permute", SPEC_PERMUTATIONS, 14)
        rows.append(_null_row(name, len(counts), seen, R.fit(found, kind, alpha=alpha, start=start)["all"]))
    return spark.createDataFrame(rows, NULL)


def hub_loading_fits(spark, d):
    """How far the extreme null draws are those that label the institutions of highest degree."""
    frame, _, fits = _fitted(spark, d)
    cut = frame.agg(F.percentile("degree", F.lit(0.99))).first()[0]
    found = R.blocks(frame.withColumn("hub", (F.col("degree") >= cut).cast("double")), "degree", XS, ["std"], extra=("hub",))
    draws = R.Draws("permute", PERMUTATIONS, 17)
    drawn = R.fit(found, draws, alpha=float(fits.alpha[0]), start={"all": _start(fits)})["all"]
    hubs, size = R.label_sums(found, draws, "hub")["all"][drawn.converged], np.abs(drawn.coef[drawn.converged, 1])
    extreme = size >= (_quantile(size, 95) or 0.0)
    r = float(np.corrcoef(size, hubs)[0, 1]) if len(size) > 1 and hubs.std() and size.std() else None
    return spark.createDataFrame([(len(size), r, _mean(hubs[extreme]), _mean(hubs))], "draws long, correlation double, hubs_in_extreme_draws double, hubs double")


def residual_permutation(spark, d):
    """The part of the label that the covariates leave unexplained is permuted, their part stays; full refits."""
    frame, _, fits = _fitted(spark, d)
    names = ["_one", *COVARIATES]
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in COVARIATES]]
    p = len(names)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    cells = frame.agg(*[F.sum(x[i] * x[j]) for i, j in upper], *[F.sum(v * F.col("treated")) for v in x]).first()
    m = np.zeros((p, p))
    for v, (i, j) in zip(cells, upper):
        m[i, j] = m[j, i] = v
    slope = np.linalg.lstsq(m, np.array(cells[len(upper) :], float), rcond=None)[0]
    stay = sum((float(b) * v for b, v in zip(slope, x)), F.lit(0.0))
    found = R.blocks(frame.withColumn("stay", stay), "degree", XS, ["std"], extra=("stay",))
    n = found.strata["all", ""][0]
    if n > 1 << 25:
        raise ValueError("the remainders of more than 2^25 rows (256 MB) are not broadcast")
    rest = np.empty(n)
    parts = found.df.select("_leaf", F.transform(F.arrays_zip("_v1", f"_e{0}"), lambda z: z["_v1"] - z["_e0"]).alias("rest"))
    for r in parts.toLocalIterator():
        rest[r._leaf * R.LEAF : r._leaf * R.LEAF + len(r.rest)] = r.rest
    draws = R.Draws("shift", RESIDUALS, 23, extra="stay", rest=spark.sparkContext.broadcast(rest))  # 8 bytes a row, checked above
    drawn = R.fit(found, draws, alpha=float(fits.alpha[0]), start={"all": _start(fits)})["all"]
    return spark.createDataFrame([_null_row("residual", 1, float(fits.coef[0, 1]), drawn)], NULL)


def bootstrap_coef(spark, d):
    _, found, fits = _fitted(spark, d, draws=True)
    drawn = R.fit(found, R.Draws("bootstrap", BOOTSTRAPS, 31), alpha=float(fits.alpha[0]), start={"all": fits.coef[0]})["all"]
    c = drawn.coef[drawn.converged, 1]
    return spark.createDataFrame([(len(c), int((~drawn.converged).sum()), *(_quantile(c, q) for q in (2.5, 97.5, 5, 95)), _deviation(c))], "reps long, dropped long, low double, high double, low90 double, high90 double, sd double")


def _label_draws(spark, d) -> DataFrame:
    """(rep, n1, n, s1, s, hubs) of the label permutations of the rank-free statistics: the n1 least random numbers of each draw."""
    frame = _frame(spark, d)
    n, n1, s, cut = frame.agg(F.count("*"), F.sum("treated"), F.sum(F.col("degree").cast("double")), F.percentile("degree", F.lit(0.99))).first()
    rows = frame.select(F.col("std").alias("paper"), F.lit(1).alias("ti"), F.col("degree").cast("double").alias("s1"), (F.col("degree") >= cut).cast("double").alias("hubs"))
    last = exclusion.cuts(rows.select("paper", "ti"), DRAWS_PERMUTED, 0.0, 17, goal=n1)
    sums = exclusion.picked_sums(rows, ["s1", "hubs"], last, DRAWS_PERMUTED, 17)
    return checkpointed(sums.withColumns({"n1": F.lit(n1).cast("long"), "n": F.lit(n), "s": F.lit(s)}))


def _draw_query(name: str):
    def run(spark, d):
        return run_sql(spark, d, draw_statistics("{draws}")[name], draws=_label_draws(spark, d))

    run.__name__ = name
    return run


def _paired(spark, d) -> DataFrame:
    """(rep, b0, b1): what ``sql_queries.PAIRED`` calls g."""
    rows = profile(spark, d, (6,)).select("std", "treated", F.col("degree").alias("y"), F.when(F.col("least_k") < 6, F.col("d6")).alias("z"))
    ratio = "ln(({0}1 / nullif({1}1, 0e0)) / nullif({0}0 / nullif({1}0, 0e0), 0e0))".format
    return paired_sums(rows, "std", PAIRED_DRAWS, 21).select("rep", F.expr(ratio("s", "n")).alias("b0"), F.expr(ratio("t", "m")).alias("b1"))


def _paired_query(name: str):
    def run(spark, d):
        return spark.sql(for_spark(SQL[name].replace(PAIRED, "WITH g AS (SELECT * FROM {g})")), g=_paired(spark, d))

    run.__name__ = name
    return run


def stratified_permutation(spark, d):
    """The mean-ratio statistic with labels dealt inside countries, density quintiles and deciles; its SQL ranks every draw's rows."""
    frame = _frame(spark, d)
    ranked, n = with_row_numbers(frame.select("std", "degree", "treated", "country", "log_univ"), "log_univ", "std", name="place")
    rows = ranked.select(
        F.col("std").alias("paper"), "treated", "degree", "country", F.expr(tile("place", str(n), 5)).cast("string").alias("density_quintile"),
        F.expr(tile("place", str(n), 10)).cast("string").alias("density_decile"))
    strata = ["country", "density_quintile", "density_decile"]
    draws = exclusion.stratified_sums(checkpointed(rows), strata, DRAWS_PERMUTED, 17)
    arm = lambda k: F.avg(F.when(F.col("treated") == k, F.col("degree").cast("double")))
    seen = frame.agg(F.log(arm(1) / arm(0)).alias("obs"))  # one row
    coef = draws.select("strata", F.expr("ln((s1 / nullif(n1, 0)) / ((s - s1) / nullif(n - n1, 0)))").alias("coef")).crossJoin(F.broadcast(seen))
    extreme = F.count_if(F.abs("coef") >= F.abs("obs"))
    return coef.groupBy("strata").agg(F.count("*").alias("reps"), F.round(F.stddev_samp("coef"), 6).alias("sd"), F.round((extreme + 1.0) / (F.count("*") + 1.0), 6).alias("p"))


# --- placebo exclusions ------------------------------------------------------------------------------


def _placebo(spark, d, frame: DataFrame, share: float, reps: int, seed: int, below: int | None = None):
    """Cuts, and (std, loss) of the frame's institutions, for random exclusions up to a share of all pairs."""
    affil = spark_view(spark, d, "affil")
    works = spark_view(spark, d, "sizes").where("k >= 2" + (f" and k < {below}" if below else "")).select("paper", F.expr("k * (k - 1) / 2").cast("long").alias("ti"))
    everything = spark_view(spark, d, "sizes").agg(F.sum(F.expr("k * (k - 1) / 2"))).first()[0]
    universe = works.agg(F.sum("ti")).first()[0]
    cut = exclusion.cuts(works, reps, share * everything / universe, seed)
    losses = exclusion.degree_losses(affil, "paper", "std", cut, reps, seed, below=below)
    return cut, frame.join(losses, "std")


def placebo_exclusion(spark, d):
    """By draw: works left out, their share of pairs, the arms' ratio of mean degrees and the log effect removed."""
    frame = _frame(spark, d)
    cut, rows = _placebo(spark, d, frame, 0.17, PLACEBOS, 5)
    sums = exclusion.arm_sums(rows.withColumn("arm", F.col("treated")), PLACEBOS)
    mean = lambda k: F.max(F.when(F.col("arm") == k, F.col("s") / F.col("n")))
    ratio = sums.groupBy("rep").agg((mean(1) / mean(0)).alias("ratio"))
    arm = lambda k: F.avg(F.when(F.col("treated") == k, F.col("degree").cast("double")))
    base = frame.agg((arm(1) / arm(0)).alias("base"))  # one row
    done = ratio.join(F.broadcast(cut.select("rep", "dropped", "share")), "rep").crossJoin(F.broadcast(base))
    return done.select("rep", "dropped", F.round("share", 6).alias("share"), F.round("ratio", 6).alias("ratio"), F.round(1 - F.log("ratio") / F.log("base"), 6).alias("removed"))


def placebo_fits(spark, d):
    """Do random works take as much of the effect as the large ones do?  Full refits of each draw, against the cap of 6."""
    frame = profile(spark, d, CAPS)
    specs = _headline(frame).unionByName(_under_caps(frame).where("spec = 'cap_6'"))
    fits = R.fit(R.blocks(specs, "degree", XS, [], group="spec"))
    head, capped = float(fits["headline"].coef[0, 1]), float(fits["cap_6"].coef[0, 1])
    share = float(spark_view(spark, d, "sizes").agg(F.sum(F.expr("CASE WHEN k >= 6 THEN k * (k - 1) / 2 ELSE 0 END")) / F.sum(F.expr("k * (k - 1) / 2"))).first()[0])
    known = bool(fits["headline"].converged[0] and fits["cap_6"].converged[0] and head)
    removed_cap = 1 - capped / head if known else math.nan
    rows = []
    for universe, below, seed in (("all_works", None, 5), ("small_works_only", 6, 6)):
        if below is not None and share >= 1 - share:  # the small works can't make up the share
            continue
        cut, losses = _placebo(spark, d, frame.select("std", "degree", *XS), share, PLACEBO_FITS, seed, below)
        found = R.blocks(losses, "degree", XS, [], extra=("loss",))
        got = R.fit(found, R.Draws("without", PLACEBO_FITS, extra="loss"), start={"all": fits["headline"].coef[0]})["all"]
        c = got.coef[got.converged, 1] if known else np.zeros(0)
        irr, removed = np.exp(c), 1 - c / head
        sd = _deviation(removed)
        as_cap = ((removed >= removed_cap).mean(), (irr <= math.exp(capped)).mean(), ((removed >= removed_cap).sum() + 1) / (len(c) + 1)) if len(c) else (None,) * 3
        rows.append((
            universe, len(c), int((~got.converged).sum()), share, float(cut.agg(F.avg("dropped")).first()[0]), _mean(got.n[got.converged]), _mean(irr), _deviation(irr), *(_quantile(irr, q) for q in (2.5, 5, 50, 95)),
            _mean(removed), *(_quantile(removed, q) for q in (95, 99, 100)), removed_cap if known else None, *(None if v is None else float(v) for v in as_cap), float((removed_cap - removed.mean()) / sd) if sd else None,
        ))
    return spark.createDataFrame(rows, "universe string, draws long, draws_dropped long, tie_share double, works_excluded double, n double, irr_mean double, irr_sd double, irr_p2_5 double, irr_p5 double, irr_median double, irr_p95 double, removed_mean double, removed_p95 double, removed_p99 double, removed_max double, removed_cap double, share_removed_as_cap double, share_irr_as_cap double, p_one_sided double, z_of_cap double")


# --- subsamples of works ---------------------------------------------------------------------------


def subsample_frames(spark, d, works: int, draws: int, cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The frame rebuilt from each draw of works, and the same under a cap: columns of the frame, and rep.

    Votes, first matched address, productivity, sets, edges and degrees all come from the drawn works
    alone.  A draw takes exactly ``works`` of them without replacement, or all there are.
    """
    affil = spark_view(spark, d, "affil")
    units = affil.select("paper").where("paper is not null").distinct().withColumn("ti", F.lit(1))
    count = units.count()
    cut = exclusion.cuts(units, draws, 0.0, seed, goal=min(works, count)).select("rep", F.col("u").alias("u_cut"), F.col("paper").alias("p_cut"))
    u = F.expr(exclusion.mixed_sql("paper", "rep", seed))
    chosen = units.select("paper").crossJoin(F.broadcast(cut)).withColumn("u", u).where("u < u_cut or (u = u_cut and paper <= p_cut)").select("rep", "paper")  # a row a draw
    # Works and institutions of a draw are its own: keyed by draw and id.
    rows = checkpointed(affil.join(chosen, "paper").withColumns({"work": F.struct("rep", "paper"), "inst": F.struct("rep", "std")}))
    matched = rows.join(spark_view(spark, d, "matches").select("raw", "near"), "raw", "left")
    labels = matched.groupBy("inst").agg((2 * F.count_if(F.coalesce("near", F.lit(False))) > F.count("near")).alias("treated"), F.count_distinct("paper").alias("papers"))
    first = matched.where("near is not null").groupBy("inst").agg(F.min_by("raw", F.struct("paper", "line", "raw")).alias("raw"))
    places = spark_view(spark, d, "counts_raw").join(spark_view(spark, d, "raw_country"), "raw")
    far = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(4e6)))
    base = labels.join(first, "inst").join(places, "raw").select(
        "inst", F.col("treated").cast("int").alias("treated"), F.log1p(F.col("around").cast("double")).alias("log_univ"), far("station").alias("log_station"),
        far("junction").alias("log_junction"), F.log1p(F.col("papers").cast("double")).alias("log_papers"),
    )
    base = checkpointed(base)
    degree = lambda below: network.degrees(network.coaffil_edges(rows, "work", "inst", below), rows, "inst").select("inst", "degree")
    keyed = lambda df: df.select(F.col("inst.rep").alias("rep"), F.col("inst.std").alias("std"), *[c for c in df.columns if c != "inst"])
    present = rows.join(rows.groupBy("work").agg(F.count_distinct("std").alias("k")).where(F.col("k") < cap), "work", "left_semi").select("inst").distinct()
    return keyed(base.join(degree(None), "inst")), keyed(base.join(present, "inst").join(degree(cap), "inst"))


SUBSAMPLE = (
    "rep long, n long, treated long, irr double, model_p double, permutation_p double, productivity_irr double, productivity_p double, cap_n long, cap_irr double, cap_permutation_p double, "
    "clause1 boolean, clause2 boolean, clause3 boolean, clause4 boolean"
)


def subsample_rows(spark, d, works: int = 5000, draws: int = 20, permutations: int = 199, cap: int = 6, seed: int = 7) -> list[tuple]:
    """The four clauses of the decision in each draw of works, with everything refitted; draws without a fit have null clauses."""
    whole, capped = subsample_frames(spark, d, works, draws, cap, seed)
    found, under = (R.blocks(checkpointed(f), "degree", XS, ["std"], group="rep") for f in (whole, capped))
    more = R.blocks(whole, "degree", [*XS, "log_papers"], [], group="rep")
    fits, productive, small = R.fit(found), R.fit(more), R.fit(under)

    def permuted(b: R.Blocks, f: dict, k: int) -> dict[str, float]:
        ok = {g for g in f if f[g].converged[0]}
        only = R.Blocks(b.df.where(F.col("_g").isin(sorted(ok))), b.names, b.xs, b.strata, {g: v for g, v in b.groups.items() if g in ok})
        got = R.fit(only, R.Draws("permute", permutations, k), alpha={g: float(f[g].alpha[0]) for g in ok}, start={g: _start(f[g]) for g in ok}) if ok else {}
        return {g: _permutation_p(float(f[g].coef[0, 1]), got[g]) for g in got}

    p1, p4 = permuted(found, fits, 100), permuted(under, small, 200)
    treated, rows = _treated(found), []
    for g in sorted(fits, key=int):
        one, three, four = _summary(fits[g], treated[g]), _summary(productive[g], treated[g]) if g in productive else None, _summary(small[g], 0) if g in small else None
        known = one[-1] and three is not None and three[-1] and four is not None and four[-1]
        clauses = (one[9] < 0.05 and one[4] > 1, p1[g] < 0.05 and one[4] > 1, three[9] < 0.05 and three[4] > 1, p4[g] < 0.05 and four[4] > 1) if known else (None,) * 4
        rows.append((int(g), one[0], one[1], one[4], one[9], p1.get(g), three[4] if three else None, three[9] if three else None, four[0] if four else None, four[4] if four else None, p4.get(g), *clauses))
    return rows


def subsample_fits(spark, d):
    return spark.createDataFrame(subsample_rows(spark, d), SUBSAMPLE)


def subsample_summary(spark, d):
    """Shares of draws that pass each clause, the first three, and all four."""
    rows = subsample_rows(spark, d)
    ok = [r for r in rows if r[-1] is not None]
    share = lambda *k: float(np.mean([all(r[11 + i] for i in k) for r in ok])) if ok else None
    middle = lambda k, q=50: float(np.percentile([r[k] for r in ok], q)) if ok else None
    row = (len(rows), len(ok), middle(3), middle(3, 25), middle(3, 75), middle(2), middle(1), share(0), share(1), share(2), share(3), share(0, 1, 2), share(0, 1, 2, 3), middle(4), middle(5), middle(6))
    return spark.createDataFrame([row], "draws long, valid long, irr_median double, irr_q1 double, irr_q3 double, treated_median double, n_median double, clause1 double, clause2 double, clause3 double, clause4 double, clauses_1_to_3 double, all_four double, model_p_median double, permutation_p_median double, productivity_irr_median double")


QUERIES = {f.__name__: f for f in (
    nb_glm_binary, nb_glm, nb_dispersion, nb_glm_alpha1, nb_glm_productivity, nb_vs_poisson, nb_fixed_effects, covariate_attenuation, spec_fits, spec_permutations,
    threshold_fits, leave_one_out_fits, vintage_fits, vif_model, tost, sandwich_se, cluster_se, label_permutation, stratified_permutation_fits, hub_loading_fits,
    residual_permutation, bootstrap_coef, placebo_exclusion, placebo_fits, subsample_fits, subsample_summary,
)}
QUERIES |= {name: _draw_query(name) for name in draw_statistics("")}
#: Their SQL stays with the other texts; Spark takes the draws from the operator.
DRAWN_QUERIES = {name: _paired_query(name) for name in ("paired_share_bootstrap", "log_difference_summary")} | {"stratified_permutation": stratified_permutation}
#: With a binary label alone the coefficient is the log ratio of the arms' means, whatever the dispersion.
ORACLE = {name: with_views(sql) for name, sql in draw_statistics(DRAWS).items()} | {
    "placebo_exclusion": with_views(PLACEBO),
    "nb_glm_binary": with_views("SELECT 'treated' AS term, round(ln(avg(CASE WHEN treated = 1 THEN CAST(degree AS DOUBLE) END) / avg(CASE WHEN treated = 0 THEN CAST(degree AS DOUBLE) END)), 6) AS coef FROM frame"),
}
