"""Count regression by iteratively reweighted least squares, as grouped Spark aggregates.

Each round is one aggregate of cross products by group (specification or replicate); only those
p x p sums reach the driver, however many rows there are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Z95 = 1.959963984540054


def _p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def nb_fit(frame: DataFrame, xs: list[str], y: str = "degree", alpha: float = 1.0, group: str | None = None, weight: str | None = None, rounds: int = 50) -> dict:
    """NB2 regression with log link and given ``alpha`` (0: Poisson), a constant first.

    Returns {group: (coefficients, inverse information matrix)}; a singular group is left out.
    Rows with a null in y or xs are dropped.
    """
    cols = ["_one", *xs]
    p = len(cols)
    rows = frame.withColumn("_one", F.lit(1.0)).withColumn("_g", F.col(group).cast("string") if group else F.lit("all"))
    rows = rows.select("_g", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("m")).dropna().persist()
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    def sums(mu, z) -> dict:
        w = F.col("m") * F.col("mu") / (1 + alpha * F.col("mu"))
        d = rows_with(mu).withColumn("w", w).withColumn("z", z)
        cells = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in upper] + [F.sum(F.col("w") * F.col("z") * F.col(f"x{i}")) for i in range(p)]
        return {r[0]: np.array(r[1:], float) for r in d.groupBy("_g").agg(*cells).collect()}

    def rows_with(mu):
        return rows.withColumn("mu", mu) if beta is None else rows.join(F.broadcast(rows.sparkSession.createDataFrame([(g, *map(float, b)) for g, b in beta.items()], "_g string, " + ", ".join(f"b{i} double" for i in range(p)))), "_g").withColumn("mu", mu)

    def solved(cells: np.ndarray):
        a = np.zeros((p, p))
        for v, (i, j) in zip(cells, upper):
            a[i, j] = a[j, i] = v
        return np.linalg.inv(a), cells[len(upper) :]

    beta: dict | None = None
    means = rows.groupBy("_g").agg(F.avg("y").alias("ybar"))
    rows0 = rows
    rows = rows0.join(F.broadcast(means), "_g")  # one row a group
    out: dict = {}
    eta = F.log("mu")
    start = (F.col("y") + F.col("ybar")) / 2 + 1e-9
    for _ in range(rounds):
        mu = start if beta is None else F.exp(F.least(F.lit(50.0), sum((F.col(f"b{i}") * F.col(f"x{i}") for i in range(1, p)), F.col("b0"))))
        cells = sums(mu, eta + (F.col("y") - F.col("mu")) / F.col("mu"))
        new = {}
        for g, c in cells.items():
            try:
                inverse, rhs = solved(c)
            except np.linalg.LinAlgError:
                continue
            new[g] = inverse @ rhs
            out[g] = (new[g], inverse)
        moved = max((np.abs(new[g] - beta[g]).max() for g in new if beta and g in beta), default=math.inf)
        beta = new
        if not new or moved < 1e-9:
            break
    rows0.unpersist()
    return {g: v for g, v in out.items() if beta and g in beta}


def coefficients(spark, fits: dict, terms: list[str], spec: str) -> DataFrame:
    """Long table (spec, grp, term, coef, se, ratio, its 95 % interval, p) of fits."""
    rows = []
    for g, (b, inverse) in sorted(fits.items()):
        for t, c, v in zip(["const", *terms], b.tolist(), np.diag(inverse).tolist()):
            se = math.sqrt(max(v, 0.0))
            rows.append((spec, g, t, c, se, math.exp(min(c, 700.0)), math.exp(min(c - Z95 * se, 700.0)), math.exp(min(c + Z95 * se, 700.0)), _p_value(c / se) if se else None))
    return spark.createDataFrame(rows, "spec string, grp string, term string, coef double, se double, ratio double, ci95_low double, ci95_high double, p double")


def nb_dispersion(frame: DataFrame, xs: list[str], y: str = "degree", tolerance: float = 1e-6) -> tuple[float, np.ndarray, np.ndarray]:
    """Dispersion by maximum likelihood with its coefficients: fit at the present value, then a profile search.

    The sums of log-gamma terms follow from the counts of each outcome, so a search step is one
    aggregate over a grid of values; outcomes are rounded half-even for this step.
    """
    alpha = 1.0
    for _ in range(12):
        b, inverse = nb_fit(frame, xs, y, alpha)["all"]
        mu = F.exp(sum((float(c) * F.col(x).cast("double") for c, x in zip(b[1:], xs)), F.lit(float(b[0]))))
        d = frame.select(F.bround(F.col(y).cast("double"), 0).alias("y"), mu.alias("mu")).dropna().persist()
        hist = sorted((int(r.y), r["count"]) for r in d.groupBy("y").count().collect())
        n, low, high = sum(c for _, c in hist), -12.0, 12.0
        for _ in range(6):
            grid = np.linspace(low, high, 33)
            sums = d.agg(*[F.sum((F.col("y") + math.exp(t)) * F.log(F.col("mu") + math.exp(t))) for t in grid]).first()
            value = [sum(c * (math.lgamma(v + math.exp(t)) - math.lgamma(math.exp(t))) for v, c in hist) + n * math.exp(t) * t - s for t, s in zip(grid, sums)]
            k = int(np.argmax(value))
            low, high = grid[max(0, k - 1)], grid[min(32, k + 1)]
        d.unpersist()
        new = math.exp(-(low + high) / 2)
        if abs(math.log(new / alpha)) < tolerance:
            break
        alpha = new
    return alpha, b, inverse


def sandwich(frame: DataFrame, xs: list[str], b: np.ndarray, inverse: np.ndarray, alpha: float, y: str = "degree", cluster: str | None = None, leverage: bool = False) -> np.ndarray:
    """Standard errors HC0, HC3 with ``leverage``, or cluster-robust where ``cluster`` names a column.

    HC3 divides a row's score by one minus its leverage w x' (X'WX)^-1 x.
    """
    names = ["_one", *xs]
    p = len(names)
    d = frame.withColumn("_one", F.lit(1.0))
    x = [F.col(n).cast("double") for n in names]
    mu = F.exp(sum((float(c) * v for c, v in zip(b, x)), F.lit(0.0)))
    score = (F.col(y) - mu) / (1 + alpha * mu)
    if leverage:
        score = score / (1 - mu / (1 + alpha * mu) * sum((float(inverse[i, j]) * x[i] * x[j] for i in range(p) for j in range(p)), F.lit(0.0)))
    d = d.select(*([cluster] if cluster else []), *[(v * score).alias(f"s{i}") for i, v in enumerate(x)])
    if cluster:
        d = d.groupBy(cluster).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)])
    cells = d.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(p) for j in range(p)]).first()
    meat = np.array(cells, float).reshape(p, -1)
    return np.sqrt(np.diag(inverse @ meat @ inverse))


def log_likelihood(frame: DataFrame, xs: list[str], b: np.ndarray, alpha: float, y: str = "degree") -> float:
    """NB2 log-likelihood (alpha 0: Poisson); log-gamma terms from the counts of each outcome."""
    mu = F.exp(sum((float(c) * F.col(x).cast("double") for c, x in zip(b[1:], xs)), F.lit(float(b[0]))))
    d = frame.select(F.col(y).cast("double").alias("y"), mu.alias("mu"))
    hist = [(r.y, r["count"]) for r in d.groupBy("y").count().collect()]
    if alpha == 0:
        return d.agg(F.sum(F.col("y") * F.log("mu") - F.col("mu"))).first()[0] - sum(c * math.lgamma(v + 1) for v, c in hist)
    t = 1 / alpha
    main = d.agg(F.sum(F.col("y") * F.log("mu") - (F.col("y") + t) * F.log(F.col("mu") + t))).first()[0]
    return main + sum(c * (math.lgamma(v + t) - math.lgamma(t) - math.lgamma(v + 1) + t * math.log(t)) for v, c in hist)


def tost(coef: float, se: float, low: float = 0.8, high: float = 1.25, df: float | None = None) -> float:
    """Equivalence p-value: the larger of the two one-sided ones, normal or with ``df`` degrees of freedom Student's."""
    below = (lambda z: 0.5 * math.erfc(-z / math.sqrt(2))) if df is None else (lambda z: student_cdf(z, df))
    return max(below((coef - math.log(high)) / se), 1 - below((coef - math.log(low)) / se))


def student_cdf(t: float, df: float) -> float:
    """Student's distribution by quadrature of its density over the angle atan(t / sqrt(df))."""
    nodes, weights = np.polynomial.legendre.leggauss(200)
    half = math.atan(t / math.sqrt(df)) / 2
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 0.5 + scale * half * float((weights * np.cos(half * (nodes + 1)) ** (df - 1)).sum())
