"""Random exclusions of works: what each draw takes from every entity's degree, for all draws at once.

Works are put in a random order for each draw and left out until their share of all pairs reaches a
target, the crossing work included.  The cut of each draw is found from sums over buckets of the
random number, and then from the rows of one bucket alone.  A work carries one bit a draw (left
out), so an edge is lost in the draws in which the bits of all its works are set: one bitwise
aggregate over the edges serves all draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .network import checkpointed, row_pairs, spread

#: A prime, and the multipliers of the mixing: fixed values of the draws.
P, A1, A2, A3 = 2147483647, 48271, 69621, 40692
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
#: Edges of an entity that one task counts together; beyond it they are salted.
TOGETHER = 1 << 16


def mixed_sql(key: str, rep: str, seed: int) -> str:
    """A number in [0, 1) from an integer key and a draw, in SQL that any engine runs; ``mixed`` is the same in arrays."""
    key, rep = f"CAST({key} AS BIGINT)", f"CAST({rep} AS BIGINT)"
    x = f"(({key} % {P} * {A1} + {rep} * {A2} + {seed}) % {P})"
    x = f"(({x} * {x} + {rep} * {A3} + {seed}) % {P})"
    x = f"(({x} * {A1} + {key} % {P}) % {P})"
    return f"(CAST(({x} * {x} + {rep}) % {P} AS DOUBLE) / {P}e0)"


def mixed(key: np.ndarray, rep: np.ndarray, seed: int) -> np.ndarray:
    """Keys x draws."""
    if len(key) > 64:  # pieces that the processor's caches hold
        return np.concatenate([mixed(key[at : at + 64], rep, seed) for at in range(0, len(key), 64)])
    k, r = (key.astype(np.int64) % P)[:, None], rep.astype(np.int64)[None, :]
    x = _modulo(k * A1 + (r * A2 + seed))
    x = _modulo(np.add(np.multiply(x, x, out=x), r * A3 + seed, out=x))
    x = _modulo(np.add(np.multiply(x, A1, out=x), k, out=x))
    return _modulo(np.add(np.multiply(x, x, out=x), r, out=x)) / float(P)


def _modulo(x: np.ndarray) -> np.ndarray:
    """Remainders by P, which is 2^31 - 1, of numbers from 0 on, in place: two folds of the bits and a subtraction."""
    for _ in range(2):
        high = x >> 31
        np.bitwise_and(x, P, out=x)
        np.add(x, high, out=x)
    np.subtract(x, P, out=x, where=x >= P)
    return x


def cuts(works: DataFrame, reps: int, share: float, seed: int, goal: int | None = None) -> DataFrame:
    """(rep, u, paper, dropped, share): the last work that each draw leaves out, and what is left out.

    ``goal`` is the pairs to reach instead of a share of them; with one pair a work, each draw takes
    exactly so many works.  ``works`` has paper and ti, its pairs (1 or more); null papers are not in the universe.  Finding the
    cuts takes two looks at every work's number in every draw; no rows are made of them but those of
    the bucket that the cut falls in.
    """
    spark = works.sparkSession
    works = checkpointed(spread(works.where("paper is not null").select(F.col("paper").cast("long"), F.col("ti").cast("long")), "paper"))
    total, rows = works.agg(F.coalesce(F.sum("ti"), F.lit(0)), F.count("*")).first()
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, 1 << (rows >> 11).bit_length()))
    rep = np.arange(1, reps + 1)

    def numbers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, batch.num_rows, 1024):
            paper, ti = (c.to_numpy() for c in batch.slice(at, 1024).columns)
            yield paper, ti, mixed(paper, rep, seed)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros(reps * buckets), np.zeros(reps * buckets, np.int64)
        for batch in batches:
            for _, ti, u in numbers(batch):
                cell = ((u * buckets).astype(np.int64) + np.arange(reps) * buckets).ravel()
                sums += np.bincount(cell, np.repeat(ti, reps), len(sums))
                count += np.bincount(cell, minlength=len(sums))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some // buckets + 1), pa.array((some % buckets).astype(np.int32)), pa.array(sums[some].astype(np.int64)), pa.array(count[some])], ["rep", "bucket", "ti", "n"])

    # Bounded: a row for each draw and bucket.
    sums = works.mapInArrow(summed, "rep long, bucket int, ti long, n long").groupBy("rep", "bucket").agg(F.sum("ti").alias("ti"), F.sum("n").alias("n"))
    order = Window.partitionBy("rep").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("ti").over(order), F.lit(0))).withColumn("n_before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    goal = F.lit(float(total) * share if goal is None else float(goal))
    # The last bucket that begins below the goal holds the crossing work.
    edge = sums.where(F.col("before") < goal).groupBy("rep").agg(F.max_by(F.struct("bucket", "before", "n_before"), "bucket").alias("e")).select("rep", "e.*")
    edge = checkpointed(edge)
    at_edge = np.full(reps, -1)
    for r in edge.collect():  # a row a draw
        at_edge[r.rep - 1] = r.bucket

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paper, ti, u in numbers(batch):
                i, j = np.nonzero((u * buckets).astype(np.int64) == at_edge)
                yield pa.RecordBatch.from_arrays([pa.array(j + 1), pa.array(u[i, j]), pa.array(paper[i]), pa.array(ti[i])], ["rep", "u", "paper", "ti"])

    inside = works.mapInArrow(picked, "rep long, u double, paper long, ti long").join(F.broadcast(edge), "rep")
    order = Window.partitionBy("rep").orderBy("u", "paper").rowsBetween(Window.unboundedPreceding, 0)
    run = inside.withColumn("upto", F.col("before") + F.sum("ti").over(order)).withColumn("dropped", F.col("n_before") + F.count("*").over(order))
    last = run.where(F.col("upto") - F.col("ti") < goal)
    top = last.groupBy("rep").agg(F.max_by(F.struct("u", "paper", "dropped", "upto"), F.struct("u", "paper")).alias("t"))
    return checkpointed(top.select("rep", "t.u", "t.paper", "t.dropped", (F.col("t.upto") / total).alias("share")))


def _bits(reps: int) -> list[str]:
    return [f"w{k}" for k in range(-(-reps // 64))]


def work_bits(works: DataFrame, cut: DataFrame, reps: int, seed: int) -> DataFrame:
    """``works`` (paper long, members, inside: whether it is in the universe) with a bit a draw, 64 to a column: left out."""
    rows = sorted((r.rep, r.u, r.paper) for r in cut.collect())  # a row a draw
    rep, u_cut, p_cut = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    width = len(_bits(reps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                paper = part.column("paper").to_numpy(zero_copy_only=False)
                inside = part.column("inside").to_numpy(zero_copy_only=False).astype(bool)
                gone = np.zeros((len(paper), 64 * width), bool)
                if len(rep):
                    u = mixed(paper, rep, seed)
                    gone[:, rep - 1] = ((u < u_cut) | ((u == u_cut) & (paper[:, None] <= p_cut))) & inside[:, None]
                words = np.packbits(gone, axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(width)]], [*part.schema.names, *_bits(reps)])

    kinds = ", ".join(f"{n} {t}" for n, t in works.dtypes)
    return works.mapInArrow(run, kinds + "".join(f", {w} long" for w in _bits(reps)))


def _counted(ends: DataFrame, reps: int) -> DataFrame:
    """(std, salt, lost binary) of bit rows sorted by std and salt: 32-bit counts by draw."""
    words = _bits(reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                raw = np.column_stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(words))]).astype("<i8")
                bits = np.unpackbits(raw.view(np.uint8).reshape(len(keys), -1), axis=1, bitorder="little")[:, :reps]
                first = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
                groups = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
                out = []
                for i, s in zip(first, groups):
                    if keys[i] == now:
                        sums = sums + s
                        continue
                    if now is not None:
                        out.append((*now, sums.astype("<i4").tobytes()))
                    now, sums = keys[i], s
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (batch.column(0).type, pa.int32(), pa.binary()))], ["std", "salt", "lost"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([sums.astype("<i4").tobytes()], pa.binary())], ["std", "salt", "lost"])

    kind = dict(ends.dtypes)["std"]
    return ends.select("std", "salt", *words).mapInArrow(run, f"std {kind}, salt int, lost binary")


def degree_losses(affil: DataFrame, work: str, entity: str, cut: DataFrame, reps: int, seed: int, least: int = 2, below: int | None = None, together: int = TOGETHER) -> DataFrame:
    """(std, loss binary): by draw, as 32-bit integers, the neighbours that an entity loses; -1 where all its works are left out.

    The universe are works of at least ``least`` and fewer than ``below`` entities; ``cut`` comes from
    ``cuts`` over it.  Entities that lose nothing in any draw have rows too.
    """
    words = _bits(reps)
    k = F.size("s")
    inside = k >= least
    if below is not None:
        inside = inside & (k < below)
    sets = affil.where(F.col(entity).isNotNull() & F.col(work).isNotNull()).groupBy(F.col(work).cast("long").alias("paper")).agg(F.array_sort(F.collect_set(entity)).alias("s"))
    bits = checkpointed(work_bits(spread(sets.select("paper", "s", inside.alias("inside")), "paper"), cut, reps, seed))
    all_of = [F.bit_and(w).alias(w) for w in words]
    gone = bits.select(F.explode("s").alias("std"), *words).groupBy("std").agg(*all_of)
    pairs = row_pairs(bits.select("s", *words), tuple(words)).withColumnsRenamed({"x": "a", "y": "b"})
    some = F.lit(False)
    for w in words:
        some = some | (F.col(w) != 0)
    lost = checkpointed(pairs.groupBy("a", "b").agg(*all_of).where(some))
    ends = lost.select(F.col("a").alias("std"), F.col("b").alias("other"), *words).unionByName(lost.select(F.col("b").alias("std"), F.col("a").alias("other"), *words))
    most = ends.groupBy("std").count().agg(F.max("count")).first()[0] or 0
    if most > together:
        sizes = ends.groupBy("std").agg(F.ceil(F.count("*") / together).cast("int").alias("salts"))
        ends = ends.join(sizes, "std").withColumn("salt", F.pmod(F.xxhash64("other"), F.col("salts").cast("long")).cast("int"))
    else:
        ends = ends.withColumn("salt", F.lit(0))
    counted = _counted(ends.repartition("std", "salt").sortWithinPartitions("std", "salt"), reps)
    parts = counted.groupBy("std").agg(F.collect_list("lost").alias("lost"))  # one for each salt
    both = gone.join(parts, "std", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.column_stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(words))]).astype("<i8")
            absent = np.unpackbits(raw.view(np.uint8).reshape(batch.num_rows, -1), axis=1, bitorder="little")[:, :reps].astype(bool)
            out = []
            for row, found in zip(absent, batch.column(1 + len(words)).to_pylist()):
                loss = sum((np.frombuffer(x, "<i4") for x in found or []), np.zeros(reps, "<i4"))
                out.append(np.where(row, -1, loss).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["std", "loss"])

    return both.select("std", *words, "lost").mapInArrow(run, f"std {dict(gone.dtypes)['std']}, loss binary")


def arm_sums(rows: DataFrame, reps: int) -> DataFrame:
    """(rep, arm, n, s): entities that remain and the sum of their remaining degrees, of rows (arm int, degree, loss)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for arm, degree, loss in zip(*(batch.column(c).to_pylist() for c in range(3))):
                x = np.frombuffer(loss, "<i4")
                own = sums.setdefault(arm, [np.zeros(reps, np.int64), np.zeros(reps)])
                own[0] += x >= 0
                own[1] += np.where(x >= 0, degree - x, 0)
        for arm, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(range(1, reps + 1), pa.int64()), pa.array([arm] * reps, pa.int32()), pa.array(n), pa.array(s)], ["rep", "arm", "n", "s"])

    picked = rows.select(F.col("arm").cast("int"), F.col("degree").cast("double"), "loss")
    return picked.mapInArrow(run, "rep long, arm int, n long, s double").groupBy("rep", "arm").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def picked_sums(rows: DataFrame, columns: list[str], cut: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, *columns): sums of the columns over the rows (paper, ...) that each draw picks up to its cut."""
    found = sorted((r.rep, r.u, r.paper) for r in cut.collect())  # a row a draw
    rep, u_cut, p_cut = (np.array(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(columns), len(rep)))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                paper, *values = (c.to_numpy() for c in batch.slice(at, 1024).columns)
                u = mixed(paper, rep, seed)
                picked = (u < u_cut) | ((u == u_cut) & (paper[:, None] <= p_cut))
                sums += np.stack(values) @ picked.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int64)), *map(pa.array, sums)], ["rep", *columns])

    picked = spread(rows.select(F.col("paper").cast("long"), *[F.col(c).cast("double") for c in columns]), "paper")
    schema = "rep long" + "".join(f", {c} double" for c in columns)
    return picked.mapInArrow(run, schema).groupBy("rep").agg(*[F.sum(c).alias(c) for c in columns])


def stratified_sums(rows: DataFrame, strata: list[str], reps: int, seed: int, window: float = 6.0, buckets: int = 32) -> DataFrame:
    """(strata, rep, n1, s1, n, s): by draw, what the rows of least random number sum to, of each stratum as many as it has labels.

    ``rows`` has paper (an integer key without nulls or repeats), treated (0 or 1), degree and a
    string column for each of ``strata``.  A stratum's cut is looked for near the share that it
    labels: one look counts the rows below and in narrow buckets around it, a second brings the rows
    of the crossing bucket alone, a third sums what lies below the cuts.  Sizes of strata, and a cut
    for each stratum and draw, are all that a task holds.
    """
    spark = rows.sparkSession
    names, sizes = [], []
    for c in strata:
        for r in sorted(rows.groupBy(F.coalesce(c, F.lit("")).alias("g")).agg(F.count("*").alias("n"), F.sum("treated").alias("t")).collect(), key=lambda r: r.g):  # a row a stratum
            names.append((c, r.g))
            sizes.append((r.n, int(r.t)))
    code = {k: i for i, k in enumerate(names)}
    n, goal = (np.array(v, np.int64) for v in zip(*sizes)) if sizes else (np.zeros(0, np.int64),) * 2
    coded = F.create_map(*[F.lit(v) for i, (c, g) in enumerate(names) for v in (f"{c}|{g}", i)]) if names else None
    if coded is None:
        return spark.createDataFrame([], "strata string, rep long, n1 long, s1 double, n long, s double")
    at = lambda c: F.try_element_at(coded, F.concat(F.lit(f"{c}|"), F.coalesce(c, F.lit("")))).cast("int").alias(f"_{c}")
    # Few tasks of many rows each: a task sends all its counters.
    tasks = max(spark.sparkContext.defaultParallelism, int(n.sum() // len(strata)) >> 17)
    base = checkpointed(rows.select(F.col("paper").cast("long"), F.col("degree").cast("double").alias("degree"), *[at(c) for c in strata]).repartition(tasks, "paper"))
    rep = np.arange(1, reps + 1)
    share = goal / np.maximum(n, 1)
    wide = window * np.sqrt(np.maximum(share * (1 - share), 1 / np.maximum(n, 1)) / np.maximum(n, 1))
    low, step = share - wide, 2 * wide / buckets
    groups, width = len(names), buckets + 2

    def bucket(u: np.ndarray, g: np.ndarray) -> np.ndarray:
        """0 below the window, buckets + 1 above it."""
        return np.clip(np.floor((u - low[g][:, None]) / step[g][:, None]) + 1, 0, buckets + 1).astype(np.int64)

    def pieces(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                paper, degree, *codes = (c.to_numpy() for c in batch.slice(k, 1024).columns)
                yield paper, degree, codes, mixed(paper, rep, seed)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(groups * reps * width, np.int32)
        for _, _, codes, u in pieces(batches):
            for g in codes:
                cell = ((g[:, None] * reps + np.arange(reps)) * width + bucket(u, g)).ravel()
                if len(counts) <= 4 * len(cell):
                    counts += np.bincount(cell, minlength=len(counts)).astype(np.int32)
                else:
                    place, some = np.unique(cell, return_counts=True)
                    counts[place] += some.astype(np.int32)
        cells = counts.reshape(groups, reps, width)
        for g in np.flatnonzero(cells.any((1, 2))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(reps, g)), pa.array(rep), *[pa.array(np.ascontiguousarray(cells[g, :, k]).astype(np.int64)) for k in range(width)]], ["g", "rep", *[f"c{k}" for k in range(width)]])

    kinds = "g long, rep long, " + ", ".join(f"c{k} long" for k in range(width))
    sums = base.mapInArrow(counted, kinds).groupBy("g", "rep").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)])
    at_edge, before = np.full((groups, reps), -1), np.zeros((groups, reps), np.int64)
    g, r, *cells = (c.to_numpy() for c in sums.toArrow().columns)  # a row a stratum and draw
    upto = np.cumsum(np.stack(cells, 1), 1)
    k = (upto < goal[g][:, None]).sum(1)  # the bucket that holds the last labelled row
    at_edge[g, r - 1] = np.where(goal[g] > 0, k, -1)
    before[g, r - 1] = np.where(k > 0, upto[np.arange(len(k)), np.maximum(k, 1) - 1], 0)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paper, _, codes, u in pieces(batches):
            for g in codes:
                i, j = np.nonzero(bucket(u, g) == at_edge[g])
                yield pa.RecordBatch.from_arrays([pa.array(g[i].astype(np.int64)), pa.array(j + 1), pa.array(u[i, j]), pa.array(paper[i])], ["g", "rep", "u", "paper"])

    inside = base.mapInArrow(picked, "g long, rep long, u double, paper long")
    order = Window.partitionBy("g", "rep").orderBy("u", "paper")
    wanted = spark.createDataFrame([(g, r + 1, int(goal[g] - before[g, r])) for g in range(groups) for r in range(reps) if goal[g]], "g long, rep long, place long")
    last = inside.withColumn("place", F.row_number().over(order).cast("long")).join(wanted, ["g", "rep", "place"])
    u_cut, p_cut = np.full((groups, reps), -1.0), np.zeros((groups, reps), np.int64)
    g, r, u, paper = (c.to_numpy() for c in last.select("g", "rep", "u", "paper").toArrow().columns)  # a row a stratum and draw
    u_cut[g, r - 1], p_cut[g, r - 1] = u, paper

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(strata), 2, reps))
        for paper, degree, codes, u in pieces(batches):
            for k, g in enumerate(codes):
                cut = u_cut[g]
                yes = ((u < cut) | ((u == cut) & (paper[:, None] <= p_cut[g]))).astype(float)
                found[k] += np.stack([np.ones(len(degree)), degree]) @ yes
        for k, c in enumerate(strata):
            yield pa.RecordBatch.from_arrays([pa.array([c] * reps), pa.array(rep), pa.array(found[k, 0]), pa.array(found[k, 1])], ["strata", "rep", "n1", "s1"])

    total = base.agg(F.count("*").alias("n"), F.sum("degree").alias("s"))  # one row
    drawn = base.mapInArrow(summed, "strata string, rep long, n1 double, s1 double").groupBy("strata", "rep").agg(F.sum("n1").alias("n1"), F.sum("s1").alias("s1"))
    return drawn.crossJoin(F.broadcast(total)).select("strata", "rep", F.col("n1").cast("long").alias("n1"), "s1", "n", "s")
