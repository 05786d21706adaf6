"""Embedding near-deduplication by sorted projection passes.

Different vectors of a label and length are the vertices, with numbers of their own.  In each pass
the vertices of a label are ordered lexicographically by the concatenated bits of random hyperplane
hashes, new ones for each pass, taken after subtracting the label's mean.  A vertex is compared with
the neighbours that follow it in that order as long as they share its first ``bits`` bits.  How many
bits, and so how many passes, follows for each label from its measured occupancy: of all prefix
lengths the one whose passes, enough to miss a pair at the threshold with probability ``missed``,
cost the least comparing and moving.  Labels of up to ``block`` vertices need no bits: one pass
compares them whole.  A window of more than ``block`` vertices is dealt out as pairs of blocks, so
that no task holds more than two.

A task joins what it links and returns one row for each linked vertex, not one for each link.  Links
are then counted inside each component, again by pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import components, join_unique, land

#: Prefix lengths that are weighed.
BITS = list(range(0, 34, 2))
#: Moving a vertex to a task costs as much as comparing it with so many others (64 components; measured on one core).
MOVE = 20_000


def join_rows(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of rows i and j in place; a label is the smallest row of its component."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        labels[np.maximum(a, b)] = np.minimum(a, b)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y link; products within rounding of the threshold are summed again in one fixed order."""
    dot = x @ y.T
    out = dot >= cosine
    for i, j in zip(*np.nonzero(np.abs(dot - cosine) < 1e-12)):
        out[i, j] = (x[i] * y[j]).sum() >= cosine
    return out


def _tiles(x: np.ndarray, side: np.ndarray, whole: bool, cosine: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, c, links of rows from a and rows from c), over all pairs of rows or those of different sides (rows sorted by side)."""
    half = len(x) if whole else int(np.searchsorted(side, side[0], "right"))
    for a in range(0, half, 512):
        b = min(a + 512, half)
        for c in range(a if whole else half, len(x), 4096):
            m = _linked(x[a:b], x[c : c + 4096], cosine)
            if whole and c < b:
                m &= np.arange(a, b)[:, None] < np.arange(c, c + m.shape[1])
            yield a, c, m


def _grouped(rows: DataFrame, keys: list[str], handle: Callable, schema: str) -> DataFrame:
    """``handle(side, whole, ids, weight, x)`` for each run of equal ``keys`` of rows (i, j, side, id, weight, vec), in key order.

    ``keys`` end in i and j, the two blocks that meet; equal ones stand for one block within itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.column_stack([table.column(k).to_numpy() for k in keys])
            starts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b == len(key) and not last:
                    break
                part = table.slice(a, b - a)
                vec = part.column("vec").combine_chunks()
                out = handle(
                    part.column("side").to_numpy(), bool(key[a, -1] == key[a, -2]), part.column("id").to_numpy(),
                    part.column("weight").to_numpy(), vec.flatten().to_numpy().reshape(b - a, -1),
                )
                if out is not None:
                    yield out
            held = [] if last else table.slice(int(starts[-2])).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ends = [[b.column(k)[at].as_py() for k in range(len(keys))] for b, at in ((held[0], 0), (batch, batch.num_rows - 1))]
            if ends[0] != ends[1] and sum(b.num_rows for b in held) >= 4096:
                yield from done(False)
        if held:
            yield from done(True)

    order = [*keys, "side", *(["sig"] if "sig" in rows.columns else [])]
    rows = rows.select(*keys, "id", "weight", "vec", *order[len(keys) :])
    return rows.repartitionByRange(*keys).sortWithinPartitions(*order).mapInArrow(run, schema)


def _in_blocks(rows: DataFrame, size: Column) -> DataFrame:
    """Rows once for each pair of blocks they are in: (i, j) in order, and ``side``, the row's own block of ``size``."""
    rows = rows.withColumn("blocks", size.cast("int")).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))


def _plan(rows: DataFrame, labels: DataFrame, cosine: float, block: int, missed: float) -> DataFrame:
    """(g, mean, bits, passes) of the labels of more than ``block`` vertices; rows (g, id, vec) are theirs."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).to_numpy()
            for one in np.unique(g):
                part = batch.filter(pa.array(g == one))
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([x.sum(0).tolist()], pa.list_(pa.float64()))], ["g", "total"])

    total = rows.select("g", "vec").mapInArrow(sums, "g long, total array<double>").select("g", F.posexplode("total").alias("at", "v"))
    mean = total.groupBy("g", "at").agg(F.sum("v").alias("v")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("m"))
    mean = labels.join(mean, "g").select("g", "n", F.expr("transform(m, x -> x.v / n)").alias("mean"))
    mean = land(mean.withColumn("spread", F.expr("greatest(1e-9, 1 - aggregate(mean, 0D, (a, c) -> a + c * c))")))

    pilot = join_unique(rows, mean.select("g", "n", "mean"), ["g"], "n", rows.count())
    pilot = _hashed(pilot.withColumn("passes", F.lit(1)).withColumn("bits", F.lit(BITS[-1])), False)
    cells = pilot.groupBy("g", "cell").agg(F.count("*").alias("m"))
    cells = cells.withColumn("bits", F.explode(F.array(*map(F.lit, BITS)))).withColumn("cell", F.expr(f"shiftrightunsigned(cell, {BITS[-1]} - bits)"))
    cells = cells.groupBy("g", "bits", "cell").agg(F.sum("m").cast("double").alias("m"))
    work = cells.groupBy("g", "bits").agg(F.sum(F.col("m") * (F.col("m") / 2 + MOVE * F.ceil(F.col("m") / block))).alias("work"))
    near = F.greatest(F.lit(-1.0), 1 - (1 - cosine) / F.col("spread"))
    found = F.pow(1 - F.acos(near) / math.pi, F.col("bits"))
    passes = F.when(F.col("bits") == 0, 1.0).when(found > 1e-6, F.ceil(math.log(missed) / F.log(1 - found)).cast("double"))
    best = work.join(mean, "g").withColumn("passes", passes).where("passes is not null")
    return land(best.groupBy("g").agg(F.min_by(F.struct("bits", F.col("passes").cast("int").alias("passes"), "mean", "n"), F.col("passes") * F.col("work")).alias("b")).select("g", "b.*"))


def _hashed(rows: DataFrame, vectors: bool = True) -> DataFrame:
    """(g, pass, cell, sig, and id, vec) of rows (g, id, vec, mean, bits, passes) for each of their passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for mixed in batches:
            g, bits, passes = (mixed.column(c).to_numpy() for c in ("g", "bits", "passes"))
            for one in np.unique(g):
                batch = mixed.filter(pa.array(g == one))
                x = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1) - np.array(batch.column("mean")[0].as_py() or 0.0)
                b = int(bits[g == one][0])
                for p in range(int(passes[g == one][0])):
                    if (p, x.shape[1]) not in planes:
                        planes[p, x.shape[1]] = np.random.default_rng(1000 + p).standard_normal((x.shape[1], 64))
                    sig = np.packbits(x @ planes[p, x.shape[1]] > 0, axis=1).view(">u8").ravel().astype(np.uint64)
                    cell = (sig >> np.uint64(64 - b)).astype(np.int64) if b else np.zeros(len(sig), np.int64)
                    out = [batch.column("g"), pa.array(np.full(len(sig), p, np.int32)), pa.array(cell), pa.array(sig.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(out + ([batch.column("id"), batch.column("vec")] if vectors else []), names)

    names = ["g", "pass", "cell", "sig", *(["id", "vec"] if vectors else [])]
    schema = "g long, pass int, cell long, sig long" + ", id long, vec array<double>" * vectors
    return rows.select("g", "id", "vec", "mean", "bits", "passes").mapInArrow(run, schema)


def near_edges(rows: DataFrame, labels: DataFrame, cosine: float, block: int, missed: float) -> DataFrame:
    """Edges (u, v) whose components are those of the links found among rows (g, id, vec); labels (g, n) count them."""

    def joined(side: np.ndarray, whole: bool, ids: np.ndarray, weight: np.ndarray, x: np.ndarray) -> pa.RecordBatch | None:
        root = np.arange(len(ids))
        if whole or side[0] != side[-1]:
            for a, c, m in _tiles(x, side, whole, cosine):
                m &= root[a : a + m.shape[0], None] != root[c : c + m.shape[1]]
                if m.any():
                    i, j = np.nonzero(m)
                    join_rows(root, i + a, j + c)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"]) if len(moved) else None

    large = labels.where(F.col("n") > block)
    plain = [F.lit(0).alias("pass"), F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("sig"), "id", "vec"]
    if large.isEmpty():
        dealt = rows.select("g", *plain).withColumn("blocks", F.lit(1))
    else:
        total = rows.count()
        marked = join_unique(rows, labels.withColumn("big", F.col("n") > block), ["g"], "n", total)
        big = marked.where("big").drop("big")
        plan = _plan(big, large, cosine, block, missed)
        hashed = land(_hashed(join_unique(big, plan, ["g"], "n", total)))
        sizes = hashed.groupBy("g", "pass", "cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block))
        dealt = join_unique(hashed, sizes, ["g", "pass", "cell"], "n", total).unionByName(marked.where("not big").select("g", *plain).withColumn("blocks", F.lit(1).cast("long")))
    dealt = _in_blocks(dealt, F.col("blocks")).withColumn("weight", F.lit(1).cast("long"))
    return _grouped(dealt, ["g", "pass", "cell", "i", "j"], joined, "u long, v long").distinct()


def link_counts(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(id, others): rows that link with the vertex, of members (component, size, id, weight, vec) of one component."""

    def counted(side: np.ndarray, whole: bool, ids: np.ndarray, weight: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        n = np.zeros(len(ids), np.int64)
        if whole or side[0] != side[-1]:
            for a, c, m in _tiles(x, side, whole, cosine):
                n[a : a + m.shape[0]] += m @ weight[c : c + m.shape[1]]
                n[c : c + m.shape[1]] += weight[a : a + m.shape[0]] @ m
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])

    dealt = _in_blocks(members, F.ceil(F.col("size") / block))
    return _grouped(dealt, ["component", "i", "j"], counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("others"))


def embedding_near_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    cosine: float = 0.93, block: int = 1 << 14, missed: float = 0.003,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows of null
    label, link with nothing.  Others link among those of equal label, whatever its type, and of
    their own length; components are scaled first, so no norm overflows or vanishes.  Rows that
    repeat an id are vectors of their own: they link, or don't, by what they hold.  A row of null id
    takes no part in links and has a null component_id.  Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.expr("vec_id is not null and label is not null and vec is not null and size(vec) > 0 and forall(vec, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    rows = rows.withColumn("good", F.coalesce(good & F.expr("exists(vec, c -> c <> 0)"), F.lit(False)))
    alone = rows.where("not good").selectExpr("vec_id", "0L as n_links", "vec_id as component_id", "true as kept")
    # Bound by one-element arrays: a plain column would be put into the lambda and computed for each component.
    scaled = "transform(array(array_max(transform(vec, c -> abs(c)))), m -> transform(vec, c -> c / m))[0]"
    length = "array(sqrt(aggregate(v, 0D, (a, c) -> a + c * c)))"
    one = F.expr(f"transform(array({scaled}), v -> transform({length}, n -> transform(v, c -> c / n + 0D))[0])[0]")
    unit = rows.where("good").select("vec_id", "label", one.alias("vec"))

    kinds = unit.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    kinds = land(kinds.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    total = kinds.count()
    labels = land(kinds.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("g", F.monotonically_increasing_id()))
    known = land(join_unique(kinds.select("label", "dim", "id", "vec"), labels, ["label", "dim"], "n", total).select("g", "id", "vec"))
    group = components(near_edges(known, labels.select("g", "n"), cosine, block, missed))
    group = land(group.unionByName(group.select(F.col("component").alias("id"), "component").distinct()))

    sizes = group.groupBy("component").agg(F.count("*").alias("n")).withColumn("size", F.col("n"))
    members = join_unique(group, sizes, ["component"], "n", total).join(kinds.select("id", "weight", "least", "vec"), "id")
    members = land(members)
    counts = link_counts(members, cosine, block)
    first = members.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_unique(members.select("component", "id"), first, ["component"], "n", total).select("id", "component_id").join(counts, "id")
    found = (
        kinds.join(named, "id", "left")
        .select("label", "vec", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"), "weight")
    )
    linked = join_unique(unit, land(found), ["label", "vec"], "weight", unit.count())
    return linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
