"""Analysis tables as views over the given tables, in SQL that both engines run.

``spark_view(spark, sf_dir, name)`` gives a view as a DataFrame; ``with_views(sql)`` prefixes the
common table expressions that a DuckDB query needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geo as geo_ops
from ..operators import network
from ..operators.numbering import with_row_numbers

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]


def geo(k: str) -> str:
    k = f"CAST({k} AS BIGINT)"
    return f"CAST(({k} * 7919) % 12001 AS DOUBLE) / 1e2 - 6e1 AS lat, CAST(({k} * 104729) % 36000 AS DOUBLE) / 1e2 - 1.8e2 AS lon"


def dist(a: str, b: str, radius: str = "6.371e6") -> str:
    """Great-circle distance between the points of aliases ``a`` and ``b``."""
    h = (
        f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)"
    )
    return f"(2 * {radius} * asin(sqrt(least(1e0, greatest(0e0, {h})))))"


def uniform(*parts: str) -> str:
    """Marks a hash-uniform number for ``for_spark`` and ``for_duckdb``."""
    return f"UNIFORM[concat_ws('|', {', '.join(f'CAST({p} AS STRING)' for p in parts)})]"


#: A work lists an institution (std) once for each of its rows; raw is the address string.
VIEWS = {
    "affil": "SELECT CAST(l_orderkey AS BIGINT) AS paper, CAST(l_partkey AS BIGINT) AS std, CAST(l_suppkey AS BIGINT) AS raw, concat(l_returnflag, l_linestatus) AS author, CAST(l_linenumber AS BIGINT) AS line FROM lineitem",
    "membership": "SELECT DISTINCT paper, std FROM affil",
    "raw_geo": f"SELECT raw, CASE WHEN raw % 8 <> 0 THEN lat END AS lat, CASE WHEN raw % 8 <> 0 THEN lon END AS lon FROM (SELECT CAST(s_suppkey AS BIGINT) AS raw, {geo('s_suppkey + 1000')} FROM supplier) x",
    "anchors": f"SELECT CAST(n_nationkey AS BIGINT) AS anchor, n_name AS name, {geo('n_nationkey + 11')} FROM nation",
    "points": f"SELECT CAST(c_custkey AS BIGINT) AS point, c_mktsegment AS category, {geo('c_custkey')} FROM customer",
    "raw_country": "SELECT CAST(s_suppkey AS BIGINT) AS raw, n_name AS country, CAST(n_regionkey AS BIGINT) AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "matches": f"""SELECT raw, lat, lon, anchor, distance, distance <= 1.5e6 AS near FROM (
        SELECT r.raw, r.lat, r.lon, a.anchor, {dist('r', 'a')} AS distance,
          row_number() OVER (PARTITION BY r.raw ORDER BY {dist('r', 'a')}, a.anchor) AS place
        FROM raw_geo r CROSS JOIN anchors a WHERE r.lat IS NOT NULL) x WHERE place = 1""",
    "sizes": "SELECT paper, count(*) AS k FROM membership GROUP BY paper",
    "pairs": "SELECT x.paper, x.std AS a, y.std AS b FROM membership x JOIN membership y ON x.paper = y.paper AND x.std < y.std",
    "edges": "SELECT a, b, count(*) AS weight FROM pairs GROUP BY a, b",
    "degrees": "SELECT s.std, coalesce(d.degree, 0) AS degree FROM (SELECT DISTINCT std FROM membership) s LEFT JOIN (SELECT v AS std, count(*) AS degree FROM (SELECT a AS v FROM edges UNION ALL SELECT b FROM edges) e GROUP BY v) d ON s.std = d.std",
    "labels_std": """SELECT std, coalesce(2 * sum(CASE WHEN near THEN 1 ELSE 0 END) > count(near), false) AS treated
        FROM affil LEFT JOIN matches ON affil.raw = matches.raw GROUP BY std""",
    "counts_raw": f"""SELECT m.raw, count(p.point) AS around, min(d) AS nearest, min(CASE WHEN p.category = 'AUTOMOBILE' THEN d END) AS station, min(CASE WHEN p.category = 'BUILDING' THEN d END) AS junction FROM matches m LEFT JOIN (
        SELECT r.raw, p.point, p.category, {dist('r', 'p')} AS d FROM matches r CROSS JOIN points p) p ON p.raw = m.raw AND p.d <= 1e6 GROUP BY m.raw""",
    "first_raw": "SELECT std, min_by(affil.raw, affil.paper * 100000000 + affil.line * 10000000 + affil.raw) AS raw FROM affil JOIN matches ON affil.raw = matches.raw GROUP BY std",
    "caps": "SELECT CAST(cap AS BIGINT) AS cap FROM (VALUES (3), (4), (6), (8), (10)) v(cap)",
    "frame": """SELECT d.std, d.degree, CASE WHEN l.treated THEN 1 ELSE 0 END AS treated, ln(1e0 + c.around) AS log_univ,
          ln(1e0 + coalesce(c.nearest, 4e6)) AS log_near, ln(1e0 + coalesce(c.station, 4e6)) AS log_station, ln(1e0 + coalesce(c.junction, 4e6)) AS log_junction, p.papers, ln(1e0 + p.papers) AS log_papers, g.country
        FROM degrees d JOIN labels_std l ON d.std = l.std JOIN first_raw f ON f.std = d.std JOIN counts_raw c ON c.raw = f.raw
        JOIN (SELECT std, count(*) AS papers FROM membership GROUP BY std) p ON p.std = d.std
        JOIN raw_country g ON g.raw = f.raw""",
    "numbered": "SELECT std, treated, degree, row_number() OVER (ORDER BY std) - 1 AS i, count(*) OVER () AS size FROM frame",
    "ranked": "SELECT std, treated, degree, country, row_number() OVER (ORDER BY log_univ, std) - 1 AS place, count(*) OVER () AS size FROM frame",
    "in_arms": "SELECT std, treated, degree, row_number() OVER (PARTITION BY treated ORDER BY std) - 1 AS i, count(*) OVER (PARTITION BY treated) AS size FROM frame",
    "close_raw": f"SELECT m.raw, count(*) AS around FROM matches m JOIN points p ON {dist('m', 'p')} <= 5e5 GROUP BY m.raw",
    "capped": """SELECT p.cap, f.std, f.treated, f.log_univ, f.log_station, f.log_junction, f.log_papers, f.country, coalesce(d.degree, 0) AS degree
        FROM (SELECT DISTINCT c.cap, m.std FROM caps c JOIN sizes s ON s.k < c.cap JOIN membership m ON m.paper = s.paper) p JOIN frame f ON f.std = p.std
        LEFT JOIN (SELECT cap, v AS std, count(*) AS degree FROM (SELECT DISTINCT c.cap, p.a AS v, p.b AS w FROM caps c JOIN sizes s ON s.k < c.cap JOIN pairs p ON p.paper = s.paper
          UNION ALL SELECT DISTINCT c.cap, p.b, p.a FROM caps c JOIN sizes s ON s.k < c.cap JOIN pairs p ON p.paper = s.paper) e GROUP BY cap, v) d ON d.cap = p.cap AND d.std = p.std""",
}


def _closed(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += {"[": 1, "]": -1}.get(text[i], 0)
        if not depth:
            return i
    raise ValueError("unclosed mark")


def _marks(text: str, name: str, put) -> str:
    while (at := text.find(name + "[")) >= 0:
        end = _closed(text, at + len(name))
        text = text[:at] + put(text[at + len(name) + 1 : end]) + text[end + 1 :]
    return text


def replicates(n: int) -> str:
    """Marks a table (rep) of the numbers 1 to n."""
    return f"REPLICATES[{n}]"


def for_spark(sql: str) -> str:
    sql = _marks(sql, "REPLICATES", lambda n: f"(SELECT id AS rep FROM range(1, {int(n) + 1}))")
    sql = _marks(sql, "UNIFORM", lambda x: f"(CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS DOUBLE) / 4294967296e0)")
    sql = _marks(sql, "LISTED", lambda x: f"array_join(transform(array_sort(collect_list({x})), y -> CAST(y AS STRING)), ',')")
    return _marks(sql, "PCT", lambda x: "percentile({}, {})".format(*x.rsplit("~", 1)))


def for_duckdb(sql: str) -> str:
    sql = _marks(sql, "REPLICATES", lambda n: f"(SELECT range AS rep FROM range(1, {int(n) + 1}))")
    sql = _marks(sql, "UNIFORM", lambda x: f"(CAST(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0)")
    sql = _marks(sql, "LISTED", lambda x: f"string_agg(CAST({x} AS VARCHAR), ',' ORDER BY {x})")
    return _marks(sql, "PCT", lambda x: "quantile_cont({}, {})".format(*x.rsplit("~", 1)))


def needed(sql: str, stop: tuple[str, ...] = ()) -> list[str]:
    """Views that the text names, directly or through others but not through those of ``stop``, in order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in found and re.search(rf"\b(FROM|JOIN) {name}\b", text):
                found.add(name)
                if name not in stop:
                    todo.append(body)
    return [n for n in VIEWS if n in found]


def with_views(sql: str) -> str:
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed(sql))
    sql = sql.strip()
    if views and sql.upper().startswith("WITH RECURSIVE"):
        sql = f"WITH RECURSIVE {views}, {sql[14:]}"
    elif views:
        sql = f"WITH {views}, {sql[4:]}" if sql.upper().startswith("WITH") else f"WITH {views} {sql}"
    return for_duckdb(sql)


#: Caps of the view ``caps``.
CAPS = (3, 4, 6, 8, 10)


def _matches(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    if "matches" not in memo:
        memo["matches"] = network.checkpointed(geo_ops.nearest_anchor(spark_view(spark, sf_dir, "raw_geo"), spark_view(spark, sf_dir, "anchors"), "raw", 1.5e6))
    return memo["matches"]


def _counts_raw(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    raw = spark_view(spark, sf_dir, "raw_geo").where("lat is not null")
    points = spark_view(spark, sf_dir, "points")
    near = geo_ops.counted_within(raw, points, "raw", "point", 1e6, "category")
    of = lambda kind: F.min(F.when(F.col("category") == kind, F.col("nearest")))
    near = near.groupBy("raw").agg(F.sum("n").alias("around"), F.min("nearest").alias("nearest"), of("AUTOMOBILE").alias("station"), of("BUILDING").alias("junction"))
    return raw.select("raw").join(near, "raw", "left").na.fill(0, ["around"])


def _edges(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    return network.coaffil_edges(spark_view(spark, sf_dir, "affil"), "paper", "std")


def profile(spark: SparkSession, sf_dir: str, caps: tuple[int, ...] = (), author: str | None = None, memo: dict | None = None) -> DataFrame:
    """The frame with its first address (raw) and the further counts of ``network.ego_counts``, cut from its lineage.

    Votes and first addresses come from one aggregate over the rows, networks of all kinds from
    another; addresses, of which there are far fewer than rows, are joined by broadcast.
    """
    memo = {} if memo is None else memo
    affil = spark_view(spark, sf_dir, "affil")
    near = network.small(_matches(spark, sf_dir, memo).select("raw", "near"))
    key = F.when(F.col("near").isNotNull(), F.col("paper") * 100000000 + F.col("line") * 10000000 + F.col("raw"))
    votes = affil.where("std is not null").join(near, "raw", "left").groupBy("std").agg(
        F.coalesce(2 * F.sum(F.when(F.col("near"), 1).otherwise(0)) > F.count("near"), F.lit(False)).cast("int").alias("treated"), F.min_by("raw", key).alias("raw"))
    places = network.checkpointed(_counts_raw(spark, sf_dir, memo).join(spark_view(spark, sf_dir, "raw_country").select("raw", "country"), "raw"))
    far = lambda c: F.log(1.0 + F.coalesce(F.col(c), F.lit(4e6)))
    counts = network.ego_counts(affil, "paper", "std", caps, author)
    more = [c for c in counts.columns if c not in ("std", "degree", "papers")]
    rows = counts.join(votes.where("raw is not null"), "std").join(network.small(places), "raw")
    return network.checkpointed(rows.select(
        "std", "degree", "treated", F.log(1.0 + F.col("around")).alias("log_univ"), far("nearest").alias("log_near"), far("station").alias("log_station"), far("junction").alias("log_junction"),
        "papers", F.log(1.0 + F.col("papers")).alias("log_papers"), "country", "raw", *more))


FRAME = ["std", "degree", "treated", "log_univ", "log_near", "log_station", "log_junction", "papers", "log_papers", "country"]


def capped_of(rows: DataFrame, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """The view ``capped`` of a profile with these caps."""
    parts = F.array(*[F.struct(F.lit(c).cast("long").alias("cap"), F.col(f"d{c}").alias("degree")) for c in caps])
    long = rows.drop("degree").withColumn("_p", F.explode(parts)).where(F.col("least_k") < F.col("_p.cap"))
    return long.select("_p.cap", "std", "treated", "log_univ", "log_station", "log_junction", "log_papers", "country", "_p.degree")


def _profile(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    if "profile" not in memo:
        memo["profile"] = profile(spark, sf_dir, CAPS if memo.get("caps") else (), memo=memo)
    return memo["profile"]


def _frame(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    return _profile(spark, sf_dir, memo).select(*FRAME)


def _first_raw(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    near = network.small(_matches(spark, sf_dir, memo).select("raw"))
    return spark_view(spark, sf_dir, "affil").join(near, "raw").groupBy("std").agg(F.min_by("raw", F.col("paper") * 100000000 + F.col("line") * 10000000 + F.col("raw")).alias("raw"))


def _capped(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    return capped_of(_profile(spark, sf_dir, memo))


def _numbered(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    rows, n = with_row_numbers(_frame(spark, sf_dir, memo).select("std", "treated", "degree"), "std", name="i")
    return rows.withColumn("size", F.lit(n).cast("long"))


def _ranked(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    rows, n = with_row_numbers(_frame(spark, sf_dir, memo).select("std", "treated", "degree", "country", "log_univ"), "log_univ", "std", name="place")
    return rows.drop("log_univ").withColumn("size", F.lit(n).cast("long"))


def _in_arms(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    rows, n = with_row_numbers(_frame(spark, sf_dir, memo).select("std", "treated", "degree"), "treated", "std", name="i")
    control = rows.where("treated = 0").count()  # the arms follow one another
    own = F.when(F.col("treated") == 1, F.col("i") - control).otherwise(F.col("i"))
    return rows.withColumn("i", own).withColumn("size", F.when(F.col("treated") == 1, F.lit(n - control)).otherwise(F.lit(control)).cast("long"))


def _close_raw(spark: SparkSession, sf_dir: str, memo: dict) -> DataFrame:
    raw = spark_view(spark, sf_dir, "raw_geo").where("lat is not null")
    return geo_ops.counted_within(raw, spark_view(spark, sf_dir, "points"), "raw", "point", 5e5, nearest=False).select("raw", F.col("n").alias("around"))


def tile(place: str, size: str, bins: int) -> str:
    """The bin from 1 of a place from 0: sizes differ by one at most, the larger bins first."""
    small, more = f"floor({size} / {bins})", f"({size} % {bins})"
    edge = f"({more} * ({small} + 1))"
    return f"CAST(CASE WHEN {place} < {edge} THEN floor({place} / ({small} + 1)) + 1 ELSE floor(({place} - {edge}) / greatest({small}, 1)) + {more} + 1 END AS BIGINT)"


#: Views that Spark takes from the operators: no brute-force pairs there, unlike in the text that DuckDB runs.
FROM_OPERATORS = {"matches": _matches, "counts_raw": _counts_raw, "edges": _edges, "first_raw": _first_raw, "frame": _frame, "capped": _capped, "numbered": _numbered, "ranked": _ranked, "in_arms": _in_arms, "close_raw": _close_raw}


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    """The text on Spark: given tables by path, plain views inlined for Catalyst, others from the operators, ``more`` by ``{name}``."""
    names = needed(sql, tuple(FROM_OPERATORS))
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names if n not in FROM_OPERATORS)
    body = sql.strip()
    if views:
        body = f"WITH {views}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {views} {body}"
    body = for_spark(body)
    for t in TABLES:
        body = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", body)
    memo = {"caps": "capped" in names}  # tables that several views of the text come from are made once
    frames = {n: FROM_OPERATORS[n](spark, sf_dir, memo) for n in names if n in FROM_OPERATORS}
    for n in frames:
        body = re.sub(rf"\b(FROM|JOIN) {n}\b( (?!ON\b|JOIN\b|LEFT\b|WHERE\b|GROUP\b|CROSS\b)[a-z]\w*)?", lambda m, n=n: f"{m[1]} {{{n}}}{m[2] or ' ' + n}", body)
    return spark.sql(body, **frames, **more)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")
