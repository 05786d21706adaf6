"""Queries that apply the DataFrame operators, with SQL that computes the same another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import geo, network, text
from .sql_queries import mann_whitney_sql
from .views import dist, spark_view, with_views

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT a, b, weight FROM edges")
def coaffil_edges(spark, d):
    return network.coaffil_edges(spark_view(spark, d, "affil"), "paper", "std")


@query("SELECT x.raw AS a, y.raw AS b, count(DISTINCT x.paper) AS weight FROM affil x JOIN affil y ON x.paper = y.paper AND x.raw < y.raw GROUP BY x.raw, y.raw")
def naive_edges(spark, d):
    return network.coaffil_edges(spark_view(spark, d, "affil"), "paper", "raw")


@query("SELECT std, degree FROM degrees")
def degree_whole(spark, d):
    affil = spark_view(spark, d, "affil")
    return network.degrees(network.coaffil_edges(affil, "paper", "std"), affil, "std").select("std", "degree")


@query("SELECT s.std, CAST(coalesce(w, 0) AS BIGINT) AS weighted FROM (SELECT DISTINCT std FROM membership) s LEFT JOIN (SELECT v AS std, sum(weight) AS w FROM (SELECT a AS v, weight FROM edges UNION ALL SELECT b, weight FROM edges) e GROUP BY v) x ON x.std = s.std")
def degree_weighted(spark, d):
    affil = spark_view(spark, d, "affil")
    return network.degrees(network.coaffil_edges(affil, "paper", "std"), affil, "std").select("std", "weighted")


@query("SELECT s.std, round(coalesce(x.f, 0e0), 6) AS degree FROM (SELECT DISTINCT std FROM membership) s LEFT JOIN (SELECT v AS std, sum(1e0 / (k - 1)) AS f FROM (SELECT paper, a AS v FROM pairs UNION ALL SELECT paper, b FROM pairs) p JOIN sizes ON sizes.paper = p.paper GROUP BY v) x ON x.std = s.std")
def degree_fractional(spark, d):
    return network.degree_fractional(spark_view(spark, d, "affil"), "paper", "std")


@query("""WITH w AS (SELECT paper, std, string_agg(DISTINCT author, ',' ORDER BY author) AS who, count(DISTINCT author) AS n FROM affil GROUP BY paper, std),
    p AS (SELECT x.std AS a, y.std AS b, x.n = 1 AND y.n = 1 AND x.who = y.who AS dual FROM w x JOIN w y ON x.paper = y.paper AND x.std < y.std),
    e AS (SELECT a, b, count(*) AS n, count(*) FILTER (WHERE dual) AS duals FROM p GROUP BY a, b)
    SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS work_pairs, CAST(coalesce(sum(duals), 0) AS BIGINT) AS dual_only, count(*) AS edges_before, count(*) FILTER (WHERE n > duals) AS edges_after, max(o.authorships) AS authorships, max(o.multi) AS multi_authorships
    FROM e CROSS JOIN (SELECT count(*) AS authorships, count(*) FILTER (WHERE k > 1) AS multi FROM (SELECT paper, author, count(DISTINCT std) AS k FROM affil GROUP BY paper, author) z) o""")
def author_supported_ties(spark, d):
    return network.author_supported_ties(spark_view(spark, d, "affil"), "paper", "std", "author")


@query("""WITH w AS (SELECT paper, std, string_agg(DISTINCT author, ',' ORDER BY author) AS who, count(DISTINCT author) AS n FROM affil GROUP BY paper, std),
    e AS (SELECT x.std AS a, y.std AS b, bool_or(NOT (x.n = 1 AND y.n = 1 AND x.who = y.who)) AS kept FROM w x JOIN w y ON x.paper = y.paper AND x.std < y.std GROUP BY x.std, y.std)
    SELECT s.std, count(v.std) AS degree_all, count(*) FILTER (WHERE v.kept) AS degree_supported FROM (SELECT DISTINCT std FROM membership) s LEFT JOIN (SELECT a AS std, kept FROM e UNION ALL SELECT b, kept FROM e) v ON v.std = s.std GROUP BY s.std""")
def author_supported_degree(spark, d):
    return network.author_supported_degree(spark_view(spark, d, "affil"), "paper", "std", "author")


@query("SELECT raw, anchor, round(distance, 4) AS distance, near FROM matches")
def nearest_anchor(spark, d):
    found = geo.nearest_anchor(spark_view(spark, d, "raw_geo"), spark_view(spark, d, "anchors"), "raw", 1.5e6)
    return found.select("raw", "anchor", F.round("distance", 4).alias("distance"), "near")


@query("SELECT raw, around FROM counts_raw")
def radius_count(spark, d):
    raw = spark_view(spark, d, "raw_geo").where("lat is not null")
    n = geo.counted_within(raw, spark_view(spark, d, "points"), "raw", "point", 1e6, nearest=False).select("raw", F.col("n").alias("around"))
    return raw.select("raw").join(n, "raw", "left").na.fill(0, ["around"])


@query(f"SELECT m.raw, p.category, round(min({dist('m', 'p')}), 4) AS nearest FROM matches m CROSS JOIN points p WHERE {dist('m', 'p')} <= 2e6 GROUP BY m.raw, p.category")
def nearest_within_radius(spark, d):
    points = spark_view(spark, d, "points")
    near = geo.counted_within(spark_view(spark, d, "raw_geo"), points, "raw", "point", 2e6, "category")
    return near.select("raw", "category", F.round("nearest", 4).alias("nearest"))


def _squares(spark: SparkSession, d: str) -> DataFrame:
    """Rings of each anchor: a square of 6 degrees around it and a second one beside it, as edges."""
    a = spark_view(spark, d, "anchors")
    corners = [(-6, -6), (6, -6), (6, 6), (-6, 6), (-6, -6)]
    rings = F.array(*[
        F.struct(F.lit(r).alias("ring"), *[(F.col(c) + float(v)).alias(n) for n, c, v in (("x1", "lon", p[0] + 15 * r), ("y1", "lat", p[1]), ("x2", "lon", q[0] + 15 * r), ("y2", "lat", q[1]))])
        for r in (0, 1) for p, q in zip(corners, corners[1:])
    ])
    return a.select("anchor", F.explode(rings).alias("e")).select("anchor", "e.*")


_INSIDE = "m.lat >= a.lat - 6 AND m.lat < a.lat + 6 AND ((m.lon >= a.lon - 6 AND m.lon < a.lon + 6) OR (m.lon >= a.lon + 9 AND m.lon < a.lon + 21))"


@query(f"SELECT m.raw, {_INSIDE} AS inside FROM matches m JOIN anchors a ON a.anchor = m.anchor")
def point_in_polygon(spark, d):
    return geo.point_in_polygon(spark_view(spark, d, "matches").select("raw", "anchor", "lat", "lon"), _squares(spark, d), "raw")


@query(f"SELECT m.raw, count(*) FILTER (WHERE {_INSIDE} AND (lower(a.name) LIKE '%an%' OR lower(a.name) LIKE '%us%')) > 0 AS inside_named FROM raw_geo m CROSS JOIN anchors a WHERE m.lat IS NOT NULL GROUP BY m.raw")
def polygon_keyword_tag(spark, d):
    named = spark_view(spark, d, "anchors").where(X.keyword_flag(F.col("name"), ["an", "us"])).select("anchor")
    raw = spark_view(spark, d, "raw_geo").where("lat is not null")
    return geo.polygon_tag(raw, _squares(spark, d).join(named, "anchor", "left_semi"), "raw").withColumnRenamed("inside", "inside_named")


@query("SELECT CAST(n_nationkey AS BIGINT) AS relation, CAST(0 AS BIGINT) AS ring, CAST(5 AS BIGINT) AS points FROM nation")
def assemble_rings(spark, d):
    a = spark_view(spark, d, "anchors")
    at = lambda x, y: F.struct((F.col("lon") + float(x)).alias("x"), (F.col("lat") + float(y)).alias("y"))
    ways = F.array(
        F.struct(F.lit(0).alias("way"), F.lit("outer").alias("role"), F.array(at(-6, -6), at(6, -6), at(6, 6)).alias("points")),
        F.struct(F.lit(1).alias("way"), F.lit("").alias("role"), F.array(at(-6, -6), at(-6, 6), at(6, 6)).alias("points")),
        F.struct(F.lit(2).alias("way"), F.lit("outer").alias("role"), F.array(at(20, 0), at(21, 0), at(22, 1)).alias("points")),
        F.struct(F.lit(3).alias("way"), F.lit("inner").alias("role"), F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, -1)).alias("points")),
    )
    members = a.select(F.col("anchor").alias("relation"), F.explode(ways).alias("w")).select("relation", "w.*")
    return geo.assemble_rings(members).select("relation", "ring", F.size("points").cast("bigint").alias("points"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS id, concat(l_returnflag, l_linestatus) AS author, CAST(l_suppkey AS STRING) AS raw, concat('p', CAST(l_partkey AS STRING)) AS institutions, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS countries FROM lineitem")
def flatten_nested(spark, d):
    li = _t(spark, d, "lineitem")
    inst = F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("country"))
    raw = F.col("l_suppkey").cast("string")
    works = li.groupBy(F.col("l_orderkey").cast("bigint").alias("id")).agg(F.collect_list(F.struct(
        F.concat("l_returnflag", "l_linestatus").alias("author"), F.when(F.col("l_linenumber") % 3 == 0, F.array(raw)).alias("raws"), raw.alias("raw"), F.array(inst).alias("institutions"))).alias("authorships"))
    kind = works.schema
    return text.flatten_nested(works.select(F.from_json(F.to_json(F.struct("*")), kind).alias("w")).select("w.*"))


@query("SELECT l_returnflag AS spec, CAST(count(*) AS DOUBLE) AS n, round(max(l_quantity), 2) AS largest, NULL::DOUBLE AS missing FROM lineitem GROUP BY l_returnflag")
def results_flat(spark, d):
    g = _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("spec")).agg(F.count("*").cast("double").alias("n"), F.round(F.max("l_quantity"), 2).cast("double").alias("largest"))
    return text.results_flat(g.unpivot("spec", ["n", "largest"], "metric", "value"), ["n", "largest", "missing"])


@query("SELECT DISTINCT user_id FROM events WHERE user_id % 10 < 3 AND user_id NOT IN (SELECT user_id FROM events WHERE user_id % 4 = 0 AND user_id IS NOT NULL)")
def incremental_anti(spark, d):
    e = _t(spark, d, "events")
    return text.new_keys(e.where("user_id % 10 < 3"), e.where("user_id % 4 = 0"), "user_id")


@query("SELECT CAST(p_partkey AS BIGINT) AS part, unnest(list_filter(list_transform(string_split(concat(p_brand, ', ', p_type, ',, ', p_name), ','), lambda x: trim(x)), lambda x: x <> '')) AS value FROM part")
def split_multivalue(spark, d):
    joined = F.concat("p_brand", F.lit(", "), "p_type", F.lit(",, "), "p_name")
    return _t(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("part"), F.explode(X.split_multivalue(joined)).alias("value"))


@query("SELECT CAST(p_partkey AS BIGINT) AS part, contains(lower(p_name), 'red') OR contains(lower(p_type), 'promo') AS hit FROM part")
def keyword_flag(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("part"), (X.keyword_flag(F.col("p_name"), ["red"]) | X.keyword_flag(F.col("p_type"), ["Promo"])).alias("hit"))


@query("SELECT CAST(p_partkey AS BIGINT) AS part FROM part WHERE regexp_matches(p_type, '(?i)(um|ll)$')")
def regex_filter(spark, d):
    return _t(spark, d, "part").where(X.regex_flag(F.col("p_type"), "(um|ll)$")).select(F.col("p_partkey").cast("bigint").alias("part"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o, coalesce(lower(trim(v)) IN ('true', 't', '1'), false) AS flag FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN ' t ' WHEN 2 THEN '1' WHEN 3 THEN 'False' WHEN 4 THEN 'yes' END AS v FROM orders) x")
def parse_bool(spark, d):
    v = F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN ' t ' WHEN 2 THEN '1' WHEN 3 THEN 'False' WHEN 4 THEN 'yes' END")
    return _t(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("o"), X.parse_bool(v).alias("flag"))


@query("SELECT point, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points WHERE point % 5 <> 0")
def wkt_point(spark, d):
    wkt = F.when(F.col("point") % 5 == 0, "Point(x y)").otherwise(F.format_string("Point(%.2f %.2f)", "lon", "lat"))
    p = spark_view(spark, d, "points").withColumn("w", X.wkt_point(wkt)).where("w is not null")
    return p.select("point", F.round("w.lon", 6).alias("lon"), F.round("w.lat", 6).alias("lat"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr') THEN substr(source, 1, 20) ELSE CAST(doc_id AS STRING) END AS label FROM documents")
def label_fallback(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.label_fallback(F.create_map("lang", F.substring("source", 1, 20)), F.col("doc_id").cast("string")).alias("label"))


@query("SELECT point, concat(printf('%.4f', round_even(lat, 4)), '_', printf('%.4f', round_even(lon, 4))) AS key FROM points")
def coord_key(spark, d):
    return spark_view(spark, d, "points").select("point", X.coord_key(F.col("lat"), F.col("lon")).alias("key"))


@query(None)
def address_variants(spark, d):
    a = F.regexp_replace("text", r"\. ", ", ")
    return _t(spark, d, "documents").select("doc_id", F.posexplode(text.address_variants(a)).alias("pos", "variant"))


@query("""WITH RECURSIVE c AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(0 AS BIGINT) AS depth FROM part WHERE p_partkey IN (2, 3) UNION ALL
    SELECT CAST(p.p_partkey AS BIGINT), c.depth + 1 FROM part p JOIN c ON p.p_partkey // 2 = c.id WHERE p.p_partkey > 1) SELECT id, depth FROM c""")
def class_closure(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"))
    return text.closure(part.withColumn("parent", F.expr("id div 2")).where("id > 1"), part.where("id in (2, 3)"))


@query("""SELECT round(sum(coalesce(i.inside, 0) / m2 - pow(t.tot / m2, 2)), 6) AS q FROM (SELECT c, sum(weight) AS tot FROM (SELECT a % 10 AS c, weight FROM edges UNION ALL SELECT b % 10, weight FROM edges) e GROUP BY c) t
    LEFT JOIN (SELECT a % 10 AS c, 2e0 * sum(weight) AS inside FROM edges WHERE a % 10 = b % 10 GROUP BY a % 10) i ON i.c = t.c, (SELECT 2e0 * sum(weight) AS m2 FROM edges) m""")
def modularity_q(spark, d):
    affil = spark_view(spark, d, "affil")
    labels = affil.select(F.col("std").alias("id")).distinct().withColumn("community", F.col("id") % 10)
    return network.modularity(network.coaffil_edges(affil, "paper", "std"), labels).select(F.round("q", 6).alias("q"))


@query(None)
def label_propagation(spark, d):
    return network.label_propagation(network.coaffil_edges(spark_view(spark, d, "affil"), "paper", "std"))


@query(None)
def community_composition(spark, d):
    """The eight largest communities, with how many there are and how many have a treated member."""
    affil = spark_view(spark, d, "affil")
    found = network.label_propagation(network.coaffil_edges(affil, "paper", "std"))
    return network.community_composition(found, spark_view(spark, d, "labels_std").withColumnRenamed("std", "id"))


@query(None)
def betweenness_pivots(spark, d):
    return network.betweenness_centrality(network.coaffil_edges(spark_view(spark, d, "affil"), "paper", "raw"))


@query(None)
def betweenness_seed_stability(spark, d):
    """The rank contrast of the arms' betweenness for four pivot seeds."""
    edges = network.checkpointed(network.coaffil_edges(spark_view(spark, d, "affil"), "paper", "std"))
    label = network.checkpointed(spark_view(spark, d, "labels_std"))
    found = None
    for seed in (42, 1, 7, 2026):
        b = network.betweenness_centrality(edges, seed, exact_up_to=0, pivots=500)
        ranked = label.join(b, label["std"] == b["id"], "left").select(F.col("treated").cast("int").alias("arm"), F.round(F.coalesce("betweenness", F.lit(0.0)), 12).alias("v"))
        g = spark.sql(mann_whitney_sql("{t}"), t=ranked).withColumn("seed", F.lit(seed))
        found = g if found is None else found.unionByName(g)
    return found


_TIES_LOST = f"""WITH w AS (SELECT paper, std, string_agg(DISTINCT author, ',' ORDER BY author) AS who, count(DISTINCT author) AS n FROM affil GROUP BY paper, std),
    e AS (SELECT x.std AS a, y.std AS b, bool_and(x.n = 1 AND y.n = 1 AND x.who = y.who) AS lost FROM w x JOIN w y ON x.paper = y.paper AND x.std < y.std GROUP BY x.std, y.std),
    t AS (SELECT f.treated AS arm, count(v.std) AS v FROM frame f LEFT JOIN (SELECT a AS std FROM e WHERE lost UNION ALL SELECT b FROM e WHERE lost) v ON v.std = f.std GROUP BY f.std, f.treated)
    SELECT m.*, x.removed_treated, x.removed_control FROM ({mann_whitney_sql("t")}) m
    CROSS JOIN (SELECT round(avg(CASE WHEN arm = 1 THEN v END), 6) AS removed_treated, round(avg(CASE WHEN arm = 0 THEN v END), 6) AS removed_control FROM t) x"""


@query(_TIES_LOST)
def ties_lost(spark, d):
    """Ties that rest on one author alone, by arm: their means and rank contrast."""
    ties = network.author_supported_degree(spark_view(spark, d, "affil"), "paper", "std", "author")
    t = spark_view(spark, d, "frame").join(ties, "std").select(F.col("treated").alias("arm"), (F.col("degree_all") - F.col("degree_supported")).alias("v"))
    t = network.checkpointed(t)
    mean = lambda k: F.round(F.avg(F.when(F.col("arm") == k, F.col("v"))), 6)
    means = t.agg(mean(1).alias("removed_treated"), mean(0).alias("removed_control"))
    return spark.sql(mann_whitney_sql("{t}"), t=t).crossJoin(F.broadcast(means))  # one row each


@query(f"""SELECT k.raw, k.c5, k.c2 FROM (SELECT m.raw, count(*) FILTER (WHERE {dist('m', 'p')} <= 2e6) AS c5, count(*) FILTER (WHERE {dist('m', 'p')} <= 1e6) AS c2 FROM matches m CROSS JOIN points p GROUP BY m.raw) k WHERE k.c5 - k.raw % 7 >= k.c2""")
def radius_monotonic_check(spark, d):
    raw, points = spark_view(spark, d, "raw_geo").where("lat is not null"), spark_view(spark, d, "points")
    count = lambda m, n: geo.counted_within(raw, points, "raw", "point", m, nearest=False).select("raw", F.col("n").alias(n))
    both = raw.select("raw").join(count(2e6, "c5"), "raw", "left").join(count(1e6, "c2"), "raw", "left").na.fill(0, ["c5", "c2"])
    # The wider count comes from another, older source that misses some; implausible rows go.
    return both.where(F.col("c5") - F.col("raw") % 7 >= F.col("c2"))


def oracle() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
