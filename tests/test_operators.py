"""Operators against closed forms and brute force on small tables."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from coaffil import functions as X
from coaffil.operators import geo, inference, network, text


def _metres(a, b):
    la, lo, lb, ob = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * X.EARTH_M * math.asin(math.sqrt(min(1, h)))


def test_radius_join_finds_every_pair_near_poles_and_date_line(spark):
    random.seed(2)
    spots = [(random.uniform(-90, 90), random.uniform(-180, 180)) for _ in range(150)] + [(89.5, 10.0), (89.0, -170.0), (0.0, 179.95), (0.1, -179.95), (-90.0, 0.0)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(999, None, None)], "l long, lat double, lon double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "r long, lat double, lon double")
    for radius in (3e5, 2e6):
        got = {(x.l, x.r) for x in geo.within_radius(left, right, "l", "r", radius).collect()}
        assert got == {(i, j) for i, a in enumerate(spots) for j, b in enumerate(spots) if _metres(a, b) <= radius}


def test_nearest_anchor_is_the_same_at_any_size(spark):
    random.seed(5)
    spots = [(i, random.uniform(-90, 90), random.uniform(-180, 180)) for i in range(60)]
    p = spark.createDataFrame(spots, "k long, lat double, lon double")
    a = spark.createDataFrame([(i, random.uniform(40, 60), random.uniform(-20, 20)) for i in range(7)] + [(99, None, 1.0)], "anchor long, lat double, lon double")
    want = sorted(tuple(r) for r in geo.nearest_anchor(p, a, "k", 4e5).collect())
    got = sorted(tuple(r) for r in geo.nearest_anchor(p, a, "k", 4e5, max_broadcast_rows=1).collect())
    assert got == want and len(got) == 60


def test_nearest_anchor_ties_go_to_the_lowest(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, None)], "k long, lat double, lon double")
    a = spark.createDataFrame([(7, 0.0, 1.0), (3, 0.0, -1.0)], "anchor long, lat double, lon double")
    assert [(r.k, r.anchor, r.near) for r in geo.nearest_anchor(p, a, "k", 1e6).collect()] == [(1, 3, True)]


def test_fractional_degree_and_handshake(spark):
    random.seed(3)
    rows = [(random.randrange(30), random.randrange(12)) for _ in range(120)]
    affil = spark.createDataFrame(rows, "w long, e long")
    edges = network.coaffil_edges(affil, "w", "e")
    degree = {r.e: r.degree for r in network.degrees(edges, affil, "e").collect()}
    assert sum(degree.values()) == 2 * edges.count()
    want: dict = {}
    for w in {r[0] for r in rows}:
        s = {e for x, e in rows if x == w}
        for e in s:
            want[e] = want.get(e, 0) + (1 if len(s) > 1 else 0)
    assert {r.e: r.degree for r in network.degree_fractional(affil, "w", "e").collect()} == want


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1)], "a long, b long, weight long")
    pivots = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    got = {r.id: round(r.betweenness, 6) for r in network.betweenness(edges, pivots).collect()}
    assert got == {1: 0.0, 2: round(2 / 3, 6), 3: round(2 / 3, 6), 4: 0.0}


def test_binary_label_gives_the_ratio_of_means_and_scores_vanish(spark):
    random.seed(4)
    rows = [(random.randrange(12) + 4 * (i % 3 == 0), int(i % 3 == 0), random.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "degree long, treated int, x double")
    for alpha in (0.0, 0.5, 2.0):
        b, _ = inference.nb_fit(df, ["treated"], alpha=alpha)["all"]
        arms = [np.mean([r[0] for r in rows if r[1] == k]) for k in (0, 1)]
        assert abs(b[1] - math.log(arms[1] / arms[0])) < 1e-7
    b, _ = inference.nb_fit(df, ["treated", "x"], alpha=0.7)["all"]
    X_ = np.array([(1, r[1], r[2]) for r in rows])
    mu = np.exp(X_ @ b)
    assert np.abs(X_.T @ ((np.array([r[0] for r in rows]) - mu) / (1 + 0.7 * mu))).max() < 1e-5


def test_rings_close_over_reversed_ways_and_open_ones_go(spark):
    P = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(1, 0, "outer", P((0, 0), (1, 0), (1, 1))), (1, 1, None, P((0, 0), (0, 1), (1, 1))), (1, 2, "outer", P((5, 5), (6, 6))), (1, 3, "inner", P((2, 2), (3, 2), (3, 3), (2, 2)))]
    df = spark.createDataFrame(rows, "relation long, way int, role string, points array<struct<x: double, y: double>>")
    got = geo.assemble_rings(df).collect()
    assert len(got) == 1 and len(got[0].points) == 5


def test_text_expressions(spark):
    df = spark.createDataFrame([("1 Dept of X, Inst of Y, Univ Z, Town, Land",), (None,)], "a string")
    v = df.select(text.address_variants(F.col("a")).alias("v")).collect()
    assert v[0].v[1].startswith("Dept of X") and "Univ Z, Town, Land" in v[0].v and v[0].v[-1] == "Town, Land"
    flags = spark.createDataFrame([("True",), (" T ",), ("1",), ("False",), ("x",), (None,)], "a string").select(X.parse_bool(F.col("a")).alias("f")).collect()
    assert [r.f for r in flags] == [True, True, True, False, False, False]
    points = spark.createDataFrame([("Point(-1.5 2)",), ("Point(a b)",), (None,)], "a string").select(X.wkt_point(F.col("a")).alias("p")).collect()
    assert tuple(points[0].p) == (-1.5, 2.0) and points[1].p is None and points[2].p is None


def test_stream_enriches_new_keys_once(spark, tmp_path):
    from coaffil.streaming.incremental import enrich_stream

    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for batch in ([(1,), (2,), (None,)], [(2,), (3,)]):
        spark.createDataFrame(batch, "k long").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k long").parquet(src)
        enrich_stream(stream, out, "k", lambda df: df.withColumn("v", F.col("k") * 10), cp).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, 10), (2, 20), (3, 30)]


def test_files_round_trip(spark, tmp_path):
    import gzip

    from coaffil.sources import tables

    rows = [(1, 'a "quoted", comma'), (2, "two\nlines"), (3, None), (4, "é🎉")]
    df = spark.createDataFrame(rows, "id long, name string")
    tables.write_csv(df.coalesce(1), str(tmp_path / "c"))
    part = next((tmp_path / "c").glob("*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,name")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(part.read_bytes()))
    for path in (tmp_path / "c", tmp_path / "c.csv.gz"):
        assert sorted(map(tuple, tables.read_csv(spark, str(path), df.schema).collect())) == rows
    tables.write_json(df.coalesce(1), str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "j")).collect())) == rows
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "x"},\n {"id": 2}]')
    assert sorted(map(tuple, tables.read_json(spark, str(tmp_path / "a.json"), df.schema).collect())) == [(1, "x"), (2, None)]
    df.withColumn("corpus", F.when(F.col("id") < 3, "old").otherwise("new")).write.partitionBy("corpus").parquet(str(tmp_path / "p"))
    assert tables.read_corpus(spark, str(tmp_path / "p"), "old").count() == 2 and tables.read_corpus(spark, str(tmp_path / "p")).count() == 4


def test_standard_errors_and_equivalence(spark):
    random.seed(8)
    rows = [(random.randrange(9) + 5 * (i % 4 == 0), int(i % 4 == 0), random.random()) for i in range(80)]
    df = spark.createDataFrame(rows, "degree long, treated int, x double")
    b, inverse = inference.nb_fit(df, ["treated", "x"])["all"]
    X_ = np.array([(1, r[1], r[2]) for r in rows], float)
    mu = np.exp(X_ @ b)
    s = X_ * ((np.array([r[0] for r in rows]) - mu) / (1 + mu))[:, None]
    h = mu / (1 + mu) * np.einsum("ij,jk,ik->i", X_, inverse, X_)
    for leverage, e in ((False, s), (True, s / (1 - h)[:, None])):
        want = np.sqrt(np.diag(inverse @ (e.T @ e) @ inverse))
        assert np.allclose(inference.sandwich(df, ["treated", "x"], b, inverse, 1.0, leverage=leverage), want, rtol=1e-9)
    # Quantiles of Student's distribution from printed tables.
    for df_, t, p in ((1, 6.314, 0.95), (10, 2.228, 0.975), (30, -1.697, 0.05), (120, 2.617, 0.995)):
        assert abs(inference.student_cdf(t, df_) - p) < 1e-4


def test_rank_test_p_value_in_log_space(spark):
    from coaffil.plans.sql_queries import log10_p, mann_whitney_sql

    for z in (0.1, 1.0, 2.5, 5.0, 8.0):
        got = spark.sql(f"SELECT {log10_p(f'CAST({z} AS DOUBLE)')} AS p").first().p
        assert abs(got - math.log10(math.erfc(z / math.sqrt(2)))) < 1e-6
    assert -870 < spark.sql(f"SELECT {log10_p('63e0')} AS p").first().p < -860  # far below the smallest double
    spark.createDataFrame([(1, 5), (1, 7), (1, 7), (0, 1), (0, 5), (0, 2)], "arm int, v int").createOrReplaceTempView("ranked_sample")
    r = spark.sql(mann_whitney_sql("ranked_sample")).first()
    assert (r.n1, r.n0, r.u, r.cles) == (3, 3, 8.5, round(8.5 / 9, 6))


def test_pairs_of_a_large_work_are_dealt_in_blocks(spark):
    big = list(range(2000))
    rows = [(1, e) for e in big] + [(2, e) for e in big[:40]] + [(3, 5), (4, None), (3, 5)]
    affil = spark.createDataFrame(rows, "w long, e long")
    got = {(r.a, r.b): r.weight for r in network.coaffil_edges(affil.where("w <> 1"), "w", "e").collect()}
    assert got == {(a, b): 1 for a in range(40) for b in range(a + 1, 40)}
    sets = affil.where("e is not null").groupBy("w").agg(F.array_sort(F.collect_set("e")).alias("s"))
    for block in (7, 64, 5000):
        pairs = network.row_pairs(sets, ("w",), block)
        assert pairs.where("x >= y").isEmpty() and pairs.count() == pairs.distinct().count() == 2000 * 1999 // 2 + 40 * 39 // 2
    assert network.coaffil_edges(affil, "w", "e").agg(F.sum("weight")).first()[0] == 2000 * 1999 // 2 + 40 * 39 // 2
    # 20,000 entities: 820 pairs of blocks, over many tasks.
    wide = spark.range(1).select(F.sequence(F.lit(0), F.lit(19999)).alias("s"))
    assert network.row_pairs(wide).rdd.getNumPartitions() >= 8


def brute_betweenness(edges):
    """Sum over pairs of the share of shortest paths through a node, by enumerating paths' counts."""
    import heapq

    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, 1 / w))
        near.setdefault(b, []).append((a, 1 / w))
    total = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, before, order, heap, seen = {s: 0.0}, {s: 1.0}, {}, [], [(0.0, s)], set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in seen:
                continue
            seen.add(u)
            order.append(u)
            for v, c in near[u]:
                if v not in dist or d + c < dist[v] - 1e-9:
                    dist[v], paths[v], before[v] = d + c, paths[u], [u]
                    heapq.heappush(heap, (d + c, v))
                elif abs(d + c - dist[v]) < 1e-9 and u not in before[v]:
                    paths[v] += paths[u]
                    before[v].append(u)
        back = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before.get(v, []):
                back[u] += paths[u] / paths[v] * (1 + back[v])
            if v != s:
                total[v] += back[v]
    n = len(near)
    return {v: t / ((n - 1) * (n - 2)) for v, t in total.items()}


def test_betweenness_equals_brute_force_with_ties_and_parts(spark):
    random.seed(7)
    edges = {(a, b): random.choice([1, 1, 2, 4]) for a in range(30) for b in range(a + 1, 30) if random.random() < 0.12}
    edges |= {(100, 101): 1, (101, 102): 2, (200, 201): 3}  # parts of their own
    rows = [(a, b, w) for (a, b), w in edges.items()]
    df = spark.createDataFrame(rows, "a long, b long, weight long")
    want = brute_betweenness(rows)
    got = {r.id: r.betweenness for r in network.betweenness_centrality(df).collect()}
    assert got.keys() == want.keys() and max(abs(got[v] - want[v]) for v in want) < 1e-12
    beyond = {r.id: r.betweenness for r in network.betweenness_centrality(df, max_bytes=1).collect()}
    assert max(abs(beyond[v] - want[v]) for v in want) < 1e-9
    # Sampled pivots scale to all nodes: with every node as a pivot the sample is the whole.
    whole = {r.id: r.betweenness for r in network.betweenness_centrality(df, exact_up_to=0, pivots=len(want)).collect()}
    assert max(abs(whole[v] - want[v]) for v in want) < 1e-12
    few = network.betweenness_centrality(df, seed=3, exact_up_to=0, pivots=5)
    assert few.count() == len(want) and [tuple(r) for r in few.orderBy("id").collect()] == [tuple(r) for r in network.betweenness_centrality(df.repartition(5), seed=3, exact_up_to=0, pivots=5).orderBy("id").collect()]


def test_communities_of_two_cliques(spark):
    clique = lambda lo, hi: [(a, b, 5) for a in range(lo, hi) for b in range(a + 1, hi)]
    edges = spark.createDataFrame([*clique(0, 6), *clique(10, 15), (5, 10, 1), (20, 21, 1)], "a long, b long, weight long")
    labels = network.label_propagation(edges)
    by = {r.id: r.community for r in labels.collect()}
    assert len({by[v] for v in range(6)}) == 1 and len({by[v] for v in range(10, 15)}) == 1 and by[20] == by[21]
    assert len(set(by.values())) == 3
    treated = spark.createDataFrame([(0, True), (1, False), (20, True), (99, True), (3, None)], "id long, treated boolean")
    top = network.community_composition(labels, treated, top=2).collect()
    assert [(r.n, r.treated, r.communities, r.communities_with_treated) for r in top] == [(6, 1, 3, 2), (5, 0, 3, 2)]
    inside = sum(w for a, b, w in [*clique(0, 6), *clique(10, 15), (20, 21, 1)])
    m = inside + 1
    ends = {0: 2 * 75 + 1, 1: 2 * 50 + 1, 2: 2}
    want = inside / m - sum((v / (2 * m)) ** 2 for v in ends.values())
    assert abs(network.modularity(edges, labels).first().q - want) < 1e-12


def test_csv_columns_go_by_name(spark, tmp_path):
    from coaffil.sources import tables

    (tmp_path / "a.csv").write_bytes("﻿name,extra,id\nx,1,7\n\"y, z\",2,8\n".encode())
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), "id long, name string")
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.orderBy("id").collect()] == [(7, "x"), (8, "y, z")]
    import pytest

    with pytest.raises(ValueError, match="absent"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), "id long, absent string")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "two" / "b.csv").write_text("name,id\ny,2\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "two"), "id long, name string").collect()


def test_a_table_is_published_only_when_it_passes(spark, tmp_path):
    import pytest

    from coaffil.sources import tables

    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    checks = {"known id present": F.count_if(F.col("id") == 1) > 0, "ids unique": F.count("*") == F.count_distinct("id"), "no null": F.count("id") == F.count("*")}
    tables.publish(good, path, checks)
    assert spark.read.parquet(path).count() == 2
    for bad, name in (([(2, "c")], "known id present"), ([(1, "c"), (1, "d")], "ids unique"), ([(1, "c"), (None, "d")], "no null"), ([], "known id present")):
        with pytest.raises(ValueError, match=name):
            tables.publish(spark.createDataFrame(bad, "id long, name string"), path, checks)
        assert sorted(r.name for r in spark.read.parquet(path).collect()) == ["a", "b"]
    tables.publish(spark.createDataFrame([(1, "new")], "id long, name string"), path, checks)
    assert [r.name for r in spark.read.parquet(path).collect()] == ["new"] and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["t"]


def test_exclusions_equal_brute_force(spark):
    from coaffil.operators import exclusion

    random.seed(9)
    rows = [(w, random.randrange(25)) for w in range(120) for _ in range(random.randint(1, 6))] + [(500, 77), (501, 78), (501, 79), (None, 3), (7, None)]
    affil = spark.createDataFrame(rows, "w long, e long")
    sets = {}
    for w, e in rows:
        if w is not None and e is not None:
            sets.setdefault(w, set()).add(e)
    reps, seed, share = 70, 4, 0.3
    works = {w: len(s) * (len(s) - 1) // 2 for w, s in sets.items() if len(s) > 1}
    total = sum(works.values())
    cut = exclusion.cuts(spark.createDataFrame(list(works.items()), "paper long, ti long"), reps, share, seed)
    kept = {r.rep: r for r in cut.collect()}
    loss = {r.std: np.frombuffer(r.loss, "<i4") for r in exclusion.degree_losses(affil, "w", "e", cut, reps, seed).collect()}
    salted = {r.std: np.frombuffer(r.loss, "<i4") for r in exclusion.degree_losses(affil, "w", "e", cut, reps, seed, together=3).collect()}
    assert all((salted[k] == v).all() for k, v in loss.items()) and salted.keys() == loss.keys() == {e for s in sets.values() for e in s}

    def degree(some):
        near = {}
        for w in some:
            for e in sets[w]:
                near.setdefault(e, set()).update(sets[w] - {e})
        return near

    names = np.array(sorted(works))
    u = exclusion.mixed(names, np.arange(1, reps + 1), seed)
    whole = degree(sets)
    for r in range(reps):
        out, gone = 0, set()
        for w in sorted(works, key=lambda w: (u[list(names).index(w), r], w)):
            gone.add(w)
            out += works[w]
            if out / total >= share:
                break
        assert (kept[r + 1].dropped, round(kept[r + 1].share, 9)) == (len(gone), round(out / total, 9))
        left = degree([w for w in sets if w not in gone])
        for e, v in loss.items():
            assert v[r] == (len(whole[e]) - len(left[e]) if e in left else -1)
    spark.createDataFrame([(int(k), 1) for k in names], "paper long, rep long").selectExpr(f"max(abs({exclusion.mixed_sql('paper', 'rep', seed)})) as m").collect()
    sql = {r.paper: r.v for r in spark.createDataFrame([(int(k),) for k in names], "paper long").selectExpr("paper", f"{exclusion.mixed_sql('paper', '3', seed)} as v").collect()}
    assert all(sql[int(k)] == u[i, 2] for i, k in enumerate(names))


def test_drawn_works_are_exactly_so_many(spark):
    from coaffil.operators import exclusion

    units = spark.range(1000).select(F.col("id").alias("paper"), F.lit(1).alias("ti"))
    got = exclusion.cuts(units, 20, 0.0, 3, goal=137).collect()
    assert len(got) == 20 and {r.dropped for r in got} == {137}
    sums = exclusion.picked_sums(units, ["ti"], exclusion.cuts(units, 20, 0.0, 3, goal=137), 20, 3).collect()
    assert len(sums) == 20 and {r.ti for r in sums} == {137.0}


def test_closure_has_no_limit_of_levels_or_rows(spark):
    chain = spark.range(1, 130).select("id", (F.col("id") - 1).alias("parent"))
    twice = spark.createDataFrame([(500, 129), (500, 129), (501, 500), (900, 800)], "id long, parent long")
    got = sorted(tuple(r) for r in text.closure(chain.unionByName(twice), spark.createDataFrame([(0,)], "id long")).collect())
    assert got == [(i, i) for i in range(130)] + [(500, 130), (500, 130), (501, 131), (501, 131)]


def test_class_closure_of_more_rows_than_a_recursive_query_may_have(spark, tmp_path):
    from coaffil.plans.frame_queries import class_closure

    spark.range(1_100_000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    n, deep = class_closure(spark, str(tmp_path)).agg(F.count("*"), F.max("depth")).first()
    assert (n, deep) == (1_099_998, 19)


def test_counts_and_least_distances_equal_brute_force(spark):
    random.seed(3)
    spots = [(random.uniform(-90, 90), random.uniform(-180, 180)) for _ in range(120)] + [(89.5, 10.0), (89.0, -170.0), (0.0, 179.95), (0.1, -179.95), (-90.0, 0.0), (90.0, 3.0), (0.0, 180.0), (0.0, -180.0)]
    spots += [(random.gauss(48, 1), random.gauss(2, 1)) for _ in range(300)]
    kinds = ["a", "b", None]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(9999, None, None)], "l long, lat double, lon double")
    right = spark.createDataFrame([(i, *p, kinds[i % 3]) for i, p in enumerate(spots)] + [(9999, 1.0, None, "a")], "r long, lat double, lon double, kind string")
    for radius, salted in ((3e5, {}), (2e6, {"most_left": 40, "most_right": 30}), (7e6, {}), (1.2e7, {})):
        want = {}
        for i, a in enumerate(spots):
            for j, b in enumerate(spots):
                if (d := _metres(a, b)) <= radius:
                    n, least = want.get((i, kinds[j % 3]), (0, math.inf))
                    want[i, kinds[j % 3]] = (n + 1, min(least, d))
        got = {(x.l, x.category): (x.n, x.nearest) for x in geo.counted_within(left, right, "l", "r", radius, "kind", **salted).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_counting_forms_no_pairs(spark):
    p = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") / 1e3).alias("lat"), (F.col("id") / 1e3).alias("lon"))
    found = geo.counted_within(p, p, "k", "k", 2e6, nearest=False)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and found.agg(F.sum("n")).first()[0] == 4000**2


def test_counts_of_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK", 4)
    random.seed(8)
    rows = [(random.choice([1, 2, 3, 4, 5, 6, 7, 8, None]), random.choice([*range(12), None]), random.choice("xyz")) for _ in range(60)]
    rows += [(50, e, "x") for e in range(11)] + [(51, 99, None), (52, 98, "x"), (52, 98, "x")]
    got = {r.std: r.asDict() for r in network.ego_counts(spark.createDataFrame(rows, "paper long, std long, author string"), "paper", "std", (3, 6), "author").collect()}
    works = {}
    for w, e, a in rows:
        works.setdefault(w, {}).setdefault(e, set()).add(a)
    for std in {e for _, e, _ in rows if e is not None}:
        mine = {w: m for w, m in works.items() if std in m}
        near = lambda test: {o for w, m in mine.items() if w is not None and test(m) for o in m if o not in (None, std)}
        dual = lambda m, o: len(m[std] - {None}) == 1 and m[std] - {None} == m[o] - {None}
        kept = {o for w, m in mine.items() if w is not None for o in m if o not in (None, std) and not dual(m, o)}
        want = {
            "std": std, "degree": len(near(lambda m: True)), "papers": len(mine), "fractional": float(sum(w is not None and len(set(m) - {None}) >= 2 for w, m in mine.items())),
            "least_k": min((len(m) for w, m in mine.items() if w is not None), default=None), "d3": len(near(lambda m: len(m) < 3)), "d6": len(near(lambda m: len(m) < 6)), "supported": len(kept),
        }
        assert got[std] == want


def test_stratified_draws_equal_brute_force(spark):
    from coaffil.operators import exclusion

    random.seed(4)
    rows = [(k, int(random.random() < 0.2), random.randrange(30), random.choice(["x", "y", None]), "all" if k else "one") for k in range(3000)]
    df = spark.createDataFrame(rows, "paper long, treated int, degree int, a string, b string")
    for window in (6.0, 0.01):  # cuts inside the window, and beyond it
        got = {(r.strata, r.rep): (r.n1, r.s1, r.n, r.s) for r in exclusion.stratified_sums(df, ["a", "b"], 5, 17, window=window).collect()}
        u = exclusion.mixed(np.arange(3000), np.arange(1, 6), 17)
        for name, at in (("a", 3), ("b", 4)):
            for rep in range(1, 6):
                n1 = s1 = 0
                for g in {r[at] for r in rows}:
                    own = sorted((r for r in rows if r[at] == g), key=lambda r: (u[r[0], rep - 1], r[0]))
                    chosen = own[: sum(r[1] for r in own)]
                    n1, s1 = n1 + len(chosen), s1 + sum(r[2] for r in chosen)
                assert got[name, rep] == (n1, s1, 3000, sum(r[2] for r in rows))


def test_betweenness_packs_the_graph_outside_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    def fail(*a, **k):
        raise AssertionError("the edges are collected as a table")

    random.seed(6)
    pairs = {(i, j): random.randint(1, 3) for i in range(30) for j in range(i + 1, 30) if random.random() < 0.2 and (i < 18) == (j < 18)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, weight long")
    want = {r.id: r.betweenness for r in network.betweenness_centrality(edges, max_bytes=0).collect()}
    for name in ("toPandas", "toArrow"):
        monkeypatch.setattr(type(edges), name, fail)
        monkeypatch.setattr(DataFrame, name, fail)
    got = {r.id: r.betweenness for r in network.betweenness_centrality(edges).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    source, weight, first = network._adjacency(edges.selectExpr("int(a) u", "int(b) v", "float(weight) w"), 30, 2 * len(pairs))
    for v in range(30):
        at = slice(first[v], first[v + 1] if v < 29 else None)
        assert sorted(zip(source[at].tolist(), weight[at].tolist())) == sorted((a if b == v else b, float(w)) for (a, b), w in pairs.items() if v in (a, b))
