"""Count regression with an effect for each of many groups, which no design matrix holds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import checkpointed


@dataclass
class FixedEffects:
    coef: np.ndarray
    inverse: np.ndarray
    converged: bool
    rows: int
    groups: int
    #: Groups without any outcome: their effect runs to minus infinity and tells nothing of the other terms.
    groups_dropped: int
    effects: DataFrame


def fixed_effects_fit(frame: DataFrame, xs: list[str], group: str, y: str = "degree", alpha: float = 1.0, rounds: int = 50, tolerance: float = 1e-9, broadcast_groups: int = 100_000) -> FixedEffects:
    """NB2 regression on xs and one effect a group, by scoring with the effects eliminated in blocks.

    The groups' part of the information matrix is diagonal, so one aggregate by group gives the
    Schur complement of the effects, a matrix of the xs alone, and each group's own step.  Effects
    stay in a table, however many groups there are; rows with a null are dropped.  The result is
    that of a design with a column for each group.
    """
    p = len(xs)
    rows = frame.select(F.col(group).alias("g"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs)], F.col(y).cast("double").alias("y")).dropna().persist()
    sums = checkpointed(rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("total")))
    kept = sums.where("total > 0")
    effects = checkpointed(kept.select("g", F.log(F.col("total") / F.col("n")).alias("effect")))
    n, groups = kept.agg(F.sum("n"), F.count("*")).first()
    dropped = sums.count() - groups
    b, done, inverse = np.zeros(p), False, np.full((p, p), np.nan)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(rounds):
        side = F.broadcast(effects) if groups <= broadcast_groups else effects
        mu = F.exp(F.least(F.lit(50.0), F.col("effect") + sum((float(v) * F.col(f"x{i}") for i, v in enumerate(b)), F.lit(0.0))))
        d = rows.join(side, "g").withColumn("mu", mu)
        d = d.withColumn("w", F.col("mu") / (1 + alpha * F.col("mu"))).withColumn("r", (F.col("y") - F.col("mu")) / (1 + alpha * F.col("mu")))
        by = d.groupBy("g").agg(
            F.first("effect").alias("effect"), F.sum("w").alias("w"), F.sum("r").alias("r"), *[F.sum(F.col("w") * F.col(f"x{i}")).alias(f"w{i}") for i in range(p)],
            *[F.sum(F.col("r") * F.col(f"x{i}")).alias(f"r{i}") for i in range(p)], *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"w{i}_{j}") for i, j in upper],
        )
        by = checkpointed(by)
        cells = by.agg(
            *[F.sum(F.col(f"w{i}_{j}") - F.col(f"w{i}") * F.col(f"w{j}") / F.col("w")) for i, j in upper],
            *[F.sum(F.col(f"r{i}") - F.col(f"w{i}") * F.col("r") / F.col("w")) for i in range(p)], F.max(F.abs(F.col("r") / F.col("w"))),
        ).first()
        if cells[0] is None:
            break
        schur = np.zeros((p, p))
        for k, (i, j) in enumerate(upper):
            schur[i, j] = schur[j, i] = cells[k]
        try:
            inverse = np.linalg.inv(schur)
        except np.linalg.LinAlgError:
            break
        step = inverse @ np.array(cells[len(upper) : len(upper) + p], float)
        step *= min(1.0, 5 / max(float(np.abs(step).max()), 1e-300))
        b = b + step
        own = (F.col("r") - sum((float(v) * F.col(f"w{i}") for i, v in enumerate(step)), F.lit(0.0))) / F.col("w")
        effects = by.select("g", (F.col("effect") + F.greatest(F.lit(-5.0), F.least(F.lit(5.0), own))).alias("effect"))
        if np.abs(step).max() < tolerance and cells[-1] < 1e-6:
            done = True
            break
    rows.unpersist()
    return FixedEffects(b, inverse, done and bool(np.isfinite(inverse).all()), n or 0, groups, dropped, effects)
