"""Co-affiliation networks: edges, degrees, communities, betweenness."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Entities of a work that are paired in one row; larger works are dealt out as pairs of such blocks.
BLOCK = 512


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt to all cores by a fixed number of partitions: for rows that mean more work than their bytes show."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def row_pairs(sets: DataFrame, keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(x, y, *keep): all pairs of elements of each row's array ``s``, the earlier first.

    Arrays beyond ``block`` elements become one row for each pair of blocks, spread over the tasks, so
    none forms more than ``block`` squared pairs of a row.
    """
    def paired(rows: DataFrame) -> DataFrame:
        rest = F.when(F.col("_same"), F.slice("_right", F.col("_i") + 2, F.size("_right"))).otherwise(F.col("_right"))
        return rows.select(F.posexplode("_left").alias("_i", "x"), "_right", "_same", *keep).select("x", F.explode(rest).alias("y"), *keep)

    small = sets.where(F.size("s") <= block).select(F.col("s").alias("_left"), F.col("s").alias("_right"), F.lit(True).alias("_same"), *keep)
    last = F.ceil(F.size("s") / block).cast("int") - 1
    large = sets.where(F.size("s") > block).select(F.explode(F.sequence(F.lit(0), last)).alias("_p"), "s", *keep)
    large = large.select("_p", F.explode(F.sequence(F.col("_p"), last)).alias("_q"), "s", *keep)
    cut = large.select(F.slice("s", F.col("_p") * block + 1, F.lit(block)).alias("_left"), F.slice("s", F.col("_q") * block + 1, F.lit(block)).alias("_right"), (F.col("_p") == F.col("_q")).alias("_same"), *keep)
    return paired(small).unionByName(paired(spread(cut)))


def coaffil_edges(affil: DataFrame, work: str, entity: str, below: int | None = None) -> DataFrame:
    """(a, b, weight), a < b: works that list both entities.  ``below``: only works with fewer entities.

    A work's entities are gathered once as a sorted set; its pairs are formed inside the row, or in
    blocks where it has many.
    """
    sets = affil.where(F.col(entity).isNotNull()).groupBy(work).agg(F.array_sort(F.collect_set(entity)).alias("s")).where("size(s) > 1")
    if below is not None:
        sets = sets.where(F.size("s") < below)
    pairs = row_pairs(sets.select("s")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame, vertices: DataFrame, entity: str) -> DataFrame:
    """(entity, degree, weighted): distinct neighbours and their weights; isolated vertices have 0."""
    ends = edges.select(F.explode(F.array("a", "b")).alias(entity), "weight")
    d = ends.groupBy(entity).agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted"))
    return vertices.select(entity).distinct().join(d, entity, "left").na.fill(0, ["degree", "weighted"])


def degree_fractional(affil: DataFrame, work: str, entity: str) -> DataFrame:
    """(entity, degree): ties of a k-entity work weigh 1 / (k - 1), so a work with k >= 2 adds one."""
    sets = affil.where(F.col(entity).isNotNull()).groupBy(work).agg(F.collect_set(entity).alias("s"))
    return sets.select(F.explode("s").alias(entity), (F.size("s") >= 2).cast("long").alias("one")).groupBy(entity).agg(F.sum("one").cast("double").alias("degree"))


def ego_counts(affil: DataFrame, work: str, entity: str, caps: tuple[int, ...] = (), author: str | None = None) -> DataFrame:
    """(entity, degree, papers, fractional, least_k, d<cap>..., supported): an entity's counts from one shuffle of works and one of entities.

    A row of an entity and a work carries the work's set, so the neighbours of an entity meet in one
    place, a row each; the entity itself among them stands for its works.  ``least_k``: entities of
    its smallest work, a missing one counted; ``d<cap>``: neighbours in works of fewer than so many;
    with ``author``, ``supported``: neighbours that some work links by two authors.  Rows without a
    work make a work of the entity's own, without neighbours or size.
    """
    real = F.col("_w").isNotNull()
    rows = affil.select(F.col(work).alias("_w"), F.col(entity).alias("_e"), *([F.col(author).alias("_a")] if author else []))
    if author:
        low, high = F.min("_a"), F.max("_a")
        rows = rows.repartition("_w").groupBy("_w", "_e").agg(F.when(low == high, low).alias("_one"))
        member = F.struct(F.col("_e").alias("e"), F.col("_one").alias("one"))
        sets = rows.groupBy("_w").agg(F.collect_list(F.when(F.col("_e").isNotNull(), member)).alias("s"), F.max(F.col("_e").isNull().cast("int")).alias("hole"))
    else:
        sets = rows.groupBy("_w").agg(F.collect_set("_e").alias("s"), F.max(F.col("_e").isNull().cast("int")).alias("hole"))
    size = F.size("s")
    sets = sets.select("s", F.when(real, size + F.col("hole")).alias("k"), (real & (size >= 2)).cast("int").alias("two"), real.alias("real"))
    small = sets.where((size <= BLOCK) & F.col("real")).select(F.explode("s").alias("m"), F.col("s").alias("near"), "k", "two")
    lone = sets.where(~F.col("real")).select(F.explode("s").alias("m"), "k", "two").select("m", F.array("m").alias("near"), "k", "two")
    last = F.ceil(size / BLOCK).cast("int") - 1
    large = spread(sets.where((size > BLOCK) & F.col("real")).select("s", "k", "two", F.explode(F.sequence(F.lit(0), last)).alias("q")))
    large = large.select(F.explode("s").alias("m"), F.slice("s", F.col("q") * BLOCK + 1, F.lit(BLOCK)).alias("near"), "k", "two")
    ends = small.unionByName(lone).unionByName(large)
    ends = ends.select(F.col("m.e").alias("e"), F.col("m.one").alias("one"), "near", "k", "two") if author else ends.select(F.col("m").alias("e"), "near", "k", "two")
    met = ends.repartition("e").select("e", "k", "two", *(["one"] if author else []), F.explode("near").alias("x"))
    met = met.withColumn("o", F.col("x.e")).withColumn("dual", F.coalesce(F.col("one") == F.col("x.one"), F.lit(False))) if author else met.withColumnRenamed("x", "o")
    own = F.col("e") == F.col("o")
    found = met.groupBy("e", "o").agg(
        F.count("*").alias("n"), F.sum("two").alias("two"), *([F.min("k").alias("k")] if caps else []), *([F.bool_and("dual").alias("dual")] if author else []),
    )
    return found.groupBy(F.col("e").alias(entity)).agg(
        F.count_if(~own).alias("degree"), F.max(F.when(own, F.col("n"))).alias("papers"), F.max(F.when(own, F.col("two"))).cast("double").alias("fractional"),
        *([F.max(F.when(own, F.col("k"))).alias("least_k")] if caps else []), *[F.count_if(~own & (F.col("k") < c)).alias(f"d{c}") for c in caps],
        *([F.count_if(~own & ~F.col("dual")).alias("supported")] if author else []),
    )


def small(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df``, which is counted, marked for broadcast where it has no more than so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def author_supported_edges(affil: DataFrame, work: str, entity: str, author: str) -> DataFrame:
    """(a, b, n, duals): works that link a and b, and those of them that rest on one author alone."""
    who = affil.where(F.col(entity).isNotNull()).groupBy(work, entity).agg(F.collect_set(author).alias("who"))
    sets = who.groupBy(work).agg(F.array_sort(F.collect_list(F.struct(F.col(entity).alias("e"), F.array_sort("who").alias("w")))).alias("s")).where("size(s) > 1")
    pairs = row_pairs(sets.select("s"))
    pairs = pairs.select(F.col("x.e").alias("a"), F.col("y.e").alias("b"), ((F.size("x.w") == 1) & (F.size("y.w") == 1) & (F.col("x.w") == F.col("y.w"))).alias("dual"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if("dual").alias("duals"))


def author_supported_degree(affil: DataFrame, work: str, entity: str, author: str) -> DataFrame:
    """(entity, degree_all, degree_supported): neighbours, and those that some work links by two distinct authors."""
    ends = author_supported_edges(affil, work, entity, author).select(F.explode(F.array("a", "b")).alias(entity), (F.col("n") > F.col("duals")).alias("kept"))
    d = ends.groupBy(entity).agg(F.count("*").alias("degree_all"), F.count_if("kept").alias("degree_supported"))
    return affil.where(F.col(entity).isNotNull()).select(entity).distinct().join(d, entity, "left").na.fill(0, ["degree_all", "degree_supported"])


def author_supported_ties(affil: DataFrame, work: str, entity: str, author: str) -> DataFrame:
    """One row of counts: authorships, those of several entities, work-pairs, those that rest on one author alone, edges before and after dropping them."""
    edges = author_supported_edges(affil, work, entity, author).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("work_pairs"), F.coalesce(F.sum("duals"), F.lit(0)).alias("dual_only"),
        F.count("*").alias("edges_before"), F.count_if(F.col("n") > F.col("duals")).alias("edges_after"),
    )
    own = affil.where(F.col(entity).isNotNull()).groupBy(work, author).agg(F.count_distinct(entity).alias("k"))
    return own.agg(F.count("*").alias("authorships"), F.count_if(F.col("k") > 1).alias("multi_authorships")).crossJoin(F.broadcast(edges))  # one row each


def label_propagation(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, community) by weighted label propagation until no label changes; ties take the smallest label.

    Nodes of even and odd hash are updated in turn, against two-cycles.  Each half round is a join and
    two aggregates, checkpointed.
    """
    both = checkpointed(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "weight")))
    labels = both.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id"))
    still = 0
    for r in range(max_rounds * 2):
        votes = both.join(labels, F.col("v") == F.col("id")).groupBy("u", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("u").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("b"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2
        new = labels.join(best, F.col("id") == F.col("u"), "left").select("id", F.when(turn, F.col("b.community")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old"))
        new = checkpointed(new)
        still = still + 1 if new.where("community <> old").isEmpty() else 0
        labels = new.select("id", "community")
        if still == 2:
            break
    return labels


def community_composition(labels: DataFrame, treated: DataFrame, top: int = 8) -> DataFrame:
    """The ``top`` largest communities: community, n, treated, share, and the numbers of communities, and of those with treated members.

    ``labels`` has id and community, ``treated`` id and treated; ids without a label are left out,
    those without a verdict count as untreated.
    """
    g = labels.join(treated.select("id", "treated"), "id", "left").groupBy("community").agg(F.count("*").alias("n"), F.count_if(F.coalesce("treated", F.lit(False))).alias("treated"))
    g = checkpointed(g)
    totals = g.agg(F.count("*").alias("communities"), F.count_if(F.col("treated") > 0).alias("communities_with_treated"))  # one row
    return g.withColumn("share", F.col("treated") / F.col("n")).orderBy(F.desc("n"), "community").limit(top).crossJoin(F.broadcast(totals))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(q): modularity of a labelling (id, community) of the weighted edges."""
    x, y = (labels.select(F.col("id").alias(c), F.col("community").alias(f"c{c}")) for c in ("a", "b"))
    e = edges.join(x, "a").join(y, "b")
    inner = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg((2 * F.sum("weight")).alias("inside"))
    total = e.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("tot"))
    m2 = e.agg((2 * F.sum("weight")).alias("m2"))
    return total.join(inner, "c", "left").crossJoin(F.broadcast(m2)).agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m2") - F.pow(F.col("tot") / F.col("m2"), 2)).alias("q"))


def betweenness(edges: DataFrame, pivots: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, betweenness) from shortest paths of cost 1 / weight out of each pivot; scaled to all nodes, normalised.

    The state (pivot, node, dist, sigma) is relaxed for all pivots at once until no distance changes;
    path counts and dependencies then run in order of hops, one job a round.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), (1 / F.col("weight")).alias("cost")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"), (1 / F.col("weight")).alias("cost")))
    nodes = both.select("u").distinct()
    n, k = nodes.count(), pivots.count()
    dist = pivots.select(F.col("id").alias("s"), F.col("id").alias("u"), F.lit(0.0).alias("d"))
    front = dist
    for _ in range(max_rounds):
        step = front.join(both, "u").groupBy("s", F.col("v").alias("u")).agg(F.min(F.col("d") + F.col("cost")).alias("nd"))
        new = step.join(dist, ["s", "u"], "left").where("d is null or nd < d - 1e-9").select("s", "u", F.col("nd").alias("d"))
        new = checkpointed(new)
        if new.isEmpty():
            break
        dist = checkpointed(dist.join(new.select("s", "u"), ["s", "u"], "left_anti").unionByName(new))
        front = new
    # Shortest-path edges p -> u; hop = longest number of such edges from the pivot.
    p = dist.select("s", F.col("u").alias("p"), F.col("d").alias("dp"))
    dag = checkpointed(p.join(both.select(F.col("u").alias("p"), F.col("v").alias("u"), "cost"), "p").join(dist, ["s", "u"]).where("abs(dp + cost - d) < 1e-9").select("s", "p", "u"))
    left = dag
    sigma = pivots.select(F.col("id").alias("s"), F.col("id").alias("u"), F.lit(1.0).alias("sigma"), F.lit(0).alias("hop"))
    done, hop = sigma, 0
    while not left.isEmpty():
        hop += 1
        waiting = left.join(done.select("s", F.col("u").alias("p")), ["s", "p"], "left_anti").select("s", "u").distinct()
        ready = left.join(waiting, ["s", "u"], "left_anti")
        got = ready.join(done.select("s", F.col("u").alias("p"), "sigma"), ["s", "p"]).groupBy("s", "u").agg(F.sum("sigma").alias("sigma")).withColumn("hop", F.lit(hop))
        got = checkpointed(got)
        done = checkpointed(done.unionByName(got.select("s", "u", "sigma", "hop")))
        left = checkpointed(left.join(got.select("s", "u"), ["s", "u"], "left_anti"))
    delta = done.select("s", "u", F.lit(0.0).alias("delta"))
    ranked = done.select("s", "u", "sigma", "hop")
    full = checkpointed(dag.join(ranked, ["s", "u"]).join(ranked.select("s", F.col("u").alias("p"), F.col("sigma").alias("sp")), ["s", "p"]))
    for h in range(hop, 0, -1):
        part = full.where(F.col("hop") == h).join(delta, ["s", "u"]).groupBy("s", F.col("p").alias("u")).agg(F.sum(F.col("sp") / F.col("sigma") * (1 + F.col("delta"))).alias("more"))
        delta = checkpointed(delta.join(part, ["s", "u"], "left").select("s", "u", (F.col("delta") + F.coalesce("more", F.lit(0.0))).alias("delta")))
    total = delta.where("s <> u").groupBy("u").agg(F.sum("delta").alias("b"))
    scale = n / k / max(1, (n - 1) * (n - 2))
    return nodes.join(total, "u", "left").select(F.col("u").alias("id"), (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def betweenness_centrality(edges: DataFrame, seed: int = 1, exact_up_to: int = 3000, pivots: int = 500, max_bytes: int = 1 << 28) -> DataFrame:
    """(id, betweenness) of the weighted graph: exact up to so many nodes, else from sampled pivots.

    Costs are 1 / weight.  The adjacency is compressed to arrays, 8 bytes an edge end (12 for weights that need doubles), and sent to
    the tasks once if it is no larger than ``max_bytes``; a task then works on one pivot at a time, in
    its connected part of the graph.
    A larger graph stays a table, on which ``betweenness`` relaxes all pivots together.
    """
    from .numbering import with_row_numbers

    spark = edges.sparkSession
    edges = checkpointed(edges.select("a", "b", F.col("weight").cast("double").alias("weight")))
    nodes, n = with_row_numbers(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "id", name="v")
    nodes = checkpointed(nodes)
    chosen = nodes if n <= exact_up_to else nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(pivots)
    k = n if n <= exact_up_to else min(pivots, n)
    if 24 * edges.count() > max_bytes:
        return betweenness(edges, checkpointed(chosen.select("id")))
    at = lambda c, name: nodes.select(F.col("id").alias(c), F.col("v").cast("int").alias(name))
    exact = edges.where(F.col("weight").cast("float").cast("double") != F.col("weight")).isEmpty()
    ends = edges.join(at("a", "u"), "a").join(at("b", "v"), "b").select("u", "v", F.col("weight").cast("float" if exact else "double").alias("w"))
    shared = spark.sparkContext.broadcast(_adjacency(ends, n, 2 * edges.count()))  # 8 or 12 bytes an edge end; its size is checked above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, weight, first = shared.value
        total, part, now = np.zeros(n), connected_parts(source, first), -1
        for batch in batches:
            pivots = batch.column(0).to_numpy()
            for s in pivots[np.argsort(part[pivots], kind="stable")].tolist():
                if part[s] != now:  # a part's arrays alone, kept while its pivots follow one another
                    now, own = part[s], np.flatnonzero(part == part[s])
                    sizes = np.diff(first, append=len(source))[own]
                    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    place = np.repeat(first[own] - begin, sizes) + np.arange(sizes.sum())
                    near, cost = np.searchsorted(own, source[place]).astype(np.int32), 1 / weight[place].astype(float)
                total[own] += dependencies(int(np.searchsorted(own, s)), near, begin, cost)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["v", "b"])

    found = checkpointed(spread(chosen.select(F.col("v").cast("long")), "v").mapInArrow(run, "v long, b double").groupBy("v").agg(F.sum("b").alias("b")))
    shared.destroy()  # so that graphs of several calls don't add up in the driver
    scale = n / k / max(1, (n - 1) * (n - 2)) if k else 0.0
    return nodes.join(found, "v", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _adjacency(ends: DataFrame, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sources and weights of the edge ends by target, and where each target's begin, of edges (u, v, w) between n nodes.

    Targets are packed by the tasks, in blocks of nodes; the driver fills the arrays block by block and
    holds no other copy.
    """
    both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    blocks = max(1, min(n, size >> 18))
    per, real = max(1, -(-n // blocks)), np.dtype(np.float32 if dict(ends.dtypes)["w"] == "float" else np.float64)
    dealt = both.withColumn("block", F.floor(F.col("v") / per).cast("int")).repartition(min(blocks, 64), "block").sortWithinPartitions("block", "v", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # of one node after another
            u, v, w = (batch.column(k).to_numpy() for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([int(v[0])], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (u, v, w))], ["low", "u", "v", "w"])

    packed = checkpointed(dealt.select("u", "v", "w").mapInArrow(run, "low int, u binary, v binary, w binary"))
    degree = np.zeros(n + 1, np.int64)
    for r in packed.select("v").toLocalIterator():
        degree[1:] += np.bincount(np.frombuffer(r.v, np.int32), minlength=n)
    first = np.cumsum(degree)[:-1]
    source, weight, filled = np.empty(size, np.int32), np.empty(size, real), first.copy()
    for r in packed.toLocalIterator():
        v = np.frombuffer(r.v, np.int32)
        node, begin, count = np.unique(v, return_index=True, return_counts=True)
        place = np.repeat(filled[node] - begin, count) + np.arange(len(v))
        source[place], weight[place] = np.frombuffer(r.u, np.int32), np.frombuffer(r.w, real)
        filled[node] += count
    return source, weight, first


def connected_parts(source: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least node that each node is connected with; edges are grouped by target as in ``dependencies``."""
    part = np.arange(len(first))
    while True:
        new = np.minimum(part, np.minimum.reduceat(part[source], first)) if len(first) else part
        new = new[new]
        if np.array_equal(new, part):
            return part
        part = new


def dependencies(s: int, source: np.ndarray, first: np.ndarray, cost: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Dependency of a pivot on each node: shortest distances, path counts and their share, each by sweeps over all edges.

    Edges are grouped by target; ``first`` is where each target's group begins, and none is empty.
    A sweep extends paths by one edge, so there are as many as a shortest path has edges at most; the first ones look at the
    edges of nodes that came nearer alone.
    """
    n = len(first)
    sizes = np.diff(first, append=len(source))
    target = np.repeat(np.arange(n, dtype=np.int32), sizes)
    dist = np.full(n, np.inf)
    dist[s] = 0.0
    front = np.array([s])
    while len(front):  # edges go both ways at the same cost, so a node's group are also its ways out
        if sizes[front].sum() * 2 > len(source):
            new = np.minimum(dist, np.minimum.reduceat(dist[source] + cost, first))
        else:
            many = sizes[front]
            place = np.repeat(first[front] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            new = dist.copy()
            np.minimum.at(new, source[place], np.repeat(dist[front], many) + cost[place])
        front = np.flatnonzero(new < dist - tolerance)
        dist[front] = new[front]
    with np.errstate(invalid="ignore"):
        on = np.isfinite(dist[target]) & (np.abs(dist[source] + cost - dist[target]) < tolerance)
    u, v = source[on], target[on]
    start = np.zeros(n)
    start[s] = 1.0
    paths = start
    while True:
        new = start + np.bincount(v, paths[u], n)
        if np.array_equal(new, paths):
            break
        paths = new
    share = paths[u] / paths[v]
    out = np.zeros(n)
    while True:
        new = np.bincount(u, share * (1 + out[v]), n)
        if np.allclose(new, out, rtol=1e-14, atol=0):
            break
        out = new
    out = new
    out[s] = 0.0
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's folder; a temporary one only where none is set in local mode (tests)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="coaffil-"))
    return df.checkpoint()
