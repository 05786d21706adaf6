"""URL filters: fixed host and path rules, then a path-template tree.

Each host has a tree of its own; a url is a path in it, the segments of its path, in which long hex
runs and digit runs are folded into ``#``, a character that no path holds.  A tree is grown a level
at a time from the rules' own verdicts on the host's urls (their labels).  Among a node's branches
those whose labelled purity (share of urls that the rules block) doesn't differ statistically from
that of their siblings, unlabelled ones among them, are merged into one wildcard branch ``?``, which
no path holds either; the others keep their name.  The urls that end at a node count as one more of
its branches, in that test and in the wildcard branch's purity, and themselves keep the node's own.
A node's purity is smoothed towards its parent's, a host's towards a set prior: a template without
labels takes that of its nearest labelled ancestor, and a host without any is never judged by
another's.  What all urls of a node have in common is passed at once.  A template is rejected when
its smoothed purity reaches one half.

Each url takes the verdict of the longest rule that fits it, else that of its template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import join_unique, land

#: Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: The name of the branch of urls that end at a node; no segment holds it.
END = "/"


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(F.col("_rest"), "^([^/?#]*)", 1)
    return (
        pages.withColumn("_rest", rest)
        .withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        .withColumn("path", F.regexp_extract(F.col("_rest"), "^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def fitting_rule(rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, or null; ties go to the rule listed first."""
    fits = [
        F.when(
            ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path)),
            F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    return F.coalesce(*fits)


def _folded(path: Column) -> Column:
    """The path with long hex runs and digit runs as wildcards."""
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{16,}", "#"), "[0-9]+", "#")

def _alike(z: float) -> Column:
    """Whether a branch (l labelled, b blocked) differs from its siblings (the rest of L and B) by chance at most."""
    l, b, rest, other = F.col("l"), F.col("b"), F.col("L_") - F.col("l"), F.col("B_") - F.col("b")
    pooled = F.col("B_") / F.col("L_")
    spread = z * F.sqrt(pooled * (1 - pooled) * (1 / l + 1 / rest))
    return F.when((l == 0) | (rest == 0), True).otherwise(F.abs(b / l - other / rest) <= spread)


def templates(leaves: DataFrame, prior_strength: float, prior_purity: float, z: float) -> DataFrame:
    """(host, folded, template, purity) of leaves (host, folded, labelled, blocked), one for each host and folded path."""
    n = leaves.count()
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("n"))
    hosts = hosts.select("host", "n", ((F.col("b") + prior_strength * prior_purity) / (F.col("l") + prior_strength)).alias("p"))
    state = join_unique(leaves, hosts, ["host"], "n", n).withColumns({"node": F.concat(F.col("host"), F.lit("/")), "rem": F.split("folded", "/")})
    done = None
    while True:
        # What the urls of a node have in common is what its first and last remainder have in common.
        ends = state.groupBy("node").agg(F.min("rem").alias("lo"), F.max("rem").alias("hi"), F.count("*").alias("n"))
        skip = (
            "if(least(size(lo), size(hi)) = 0, 0, coalesce(array_min(filter(sequence(0, least(size(lo), size(hi)) - 1), i -> lo[i] <> hi[i])), least(size(lo), size(hi))))"
        )
        state = join_unique(state, ends.select("node", "n", F.expr(skip).alias("skip")), ["node"], "n", n)
        state = state.withColumn("node", F.expr("concat(node, array_join(transform(slice(rem, 1, skip), x -> concat('/', x)), ''))"))
        state = land(state.withColumn("rem", F.expr("slice(rem, skip + 1, size(rem))")).drop("skip"))
        ended = state.where("size(rem) = 0").select("host", "folded", F.col("node").alias("template"), F.col("p").alias("purity"))
        done = ended if done is None else done.unionByName(ended)
        # Urls that end here are a branch among the others.
        state = state.withColumn("child", F.coalesce(F.get("rem", F.lit(0)), F.lit(END)))
        going = state.where("size(rem) > 0")
        if going.isEmpty():
            return done
        child = state.groupBy("node", "child").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max("p").alias("p"), F.count("*").alias("n"))
        whole = child.groupBy("node").agg(F.sum("l").alias("L_"), F.sum("b").alias("B_"), F.count("*").alias("branches"))
        child = join_unique(child, whole, ["node"], "branches", n)
        child = land(child.withColumn("name", F.when(_alike(z), F.lit("?")).otherwise(F.col("child"))).drop("L_", "B_"))
        branch = child.groupBy("node", "name").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.max("p").alias("p"), F.count("*").alias("n"))
        branch = branch.select("node", "name", "n", ((F.col("b") + prior_strength * F.col("p")) / (F.col("l") + prior_strength)).alias("q"))
        named = join_unique(child.select("node", "child", "name", F.col("n").alias("rows")), branch, ["node", "name"], "n", n)
        state = join_unique(going, named, ["node", "child"], "rows", n)
        state = land(state.select("host", "folded", "labelled", "blocked", F.concat("node", F.lit("/"), "name").alias("node"), F.expr("slice(rem, 2, size(rem))").alias("rem"), F.col("q").alias("p")))


def url_filter(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
    prior_strength: float = 4.0, prior_purity: float = 0.0, reject_at: float = 0.5, z: float = 1.96,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    Null urls and urls without ``://`` have empty host and path and are a template of their own.
    ``prior_strength`` is the number of pseudo-urls at its parent's purity added to a node, a host's
    having ``prior_purity``; ``z`` the critical value up to which a branch's purity counts as its
    siblings'.  Paths of any depth and length count whole.  Ids may be null or repeat; other columns
    are ignored; empty input gives no rows.  A host on whose urls no rule fits is allowed, unless
    ``prior_purity`` reaches ``reject_at``.
    """
    urls = with_host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    urls = urls.withColumn("fit", fitting_rule(rules)).withColumn("folded", _folded(F.col("path"))).select("page_id", "host", "path", "fit", "folded")
    # One row for each host and folded path; a hot host shrinks to its templates before any shuffle.
    leaves = urls.groupBy("host", "folded").agg(
        F.count("fit").alias("labelled"), F.count(F.when(F.col("fit.verdict") == "block", 1)).alias("blocked"), F.count("*").alias("times")
    )
    leaves = land(leaves)
    judged = templates(leaves.drop("times"), prior_strength, prior_purity, z)
    judged = judged.select("host", "folded", F.when(F.col("purity") >= reject_at, "block").otherwise("allow").alias("method"))
    judged = land(judged.join(leaves.select("host", "folded", "times"), ["host", "folded"]))
    return join_unique(urls, judged, ["host", "folded"], "times", urls.count()).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "method").alias("verdict")
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    test = "(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {test.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in ordered)
    said = " ".join(f"WHEN {test.format(h=h, p=p)} THEN '{v}'" for v, h, p in ordered)
    return rf"""
WITH RECURSIVE a AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS r FROM pages
), b AS (
  SELECT page_id,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), u AS (
  SELECT *, CASE {rule} END AS rule, CASE {said} END AS said,
    regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{16,}}', '#', 'g'), '[0-9]+', '#', 'g') AS folded FROM b
), leaf AS (
  SELECT host, folded, count(said) AS l, count(*) FILTER (said = 'block') AS b FROM u GROUP BY ALL
), t AS (
  SELECT host, folded, l, b, concat(host, '/') AS node, string_split(folded, '/') AS rem,
    CAST(sum(b) OVER (PARTITION BY host) AS DOUBLE) / (sum(l) OVER (PARTITION BY host) + 4e0) AS p, false AS fin FROM leaf
  UNION ALL
  SELECT host, folded, l, b, CASE WHEN len(rem) = 0 THEN node ELSE concat(node, '/', name) END, rem[2:],
    CASE WHEN len(rem) = 0 THEN p ELSE (CAST(sum(b) OVER (PARTITION BY node, name) AS DOUBLE) + 4e0 * p) / (sum(l) OVER (PARTITION BY node, name) + 4e0) END, len(rem) = 0
  FROM (
    SELECT *, CASE WHEN cl = 0 OR nl = cl THEN '?' WHEN abs(cb / cl - (nb - cb) / (nl - cl)) <= 1.96e0 * sqrt(nb / nl * (1 - nb / nl) * (1 / cl + 1 / (nl - cl))) THEN '?' ELSE rem[1] END AS name
    FROM (
      SELECT *, CAST(sum(l) OVER (PARTITION BY node) AS DOUBLE) AS nl, CAST(sum(b) OVER (PARTITION BY node) AS DOUBLE) AS nb, CAST(sum(l) OVER (PARTITION BY node, rem[1]) AS DOUBLE) AS cl, CAST(sum(b) OVER (PARTITION BY node, rem[1]) AS DOUBLE) AS cb
      FROM (
        SELECT host, folded, l, b, p, concat(node, array_to_string(list_transform(rem[1:skip], lambda x: '/' || x), '')) AS node, rem[skip + 1:] AS rem
        FROM (
          SELECT *, coalesce(list_min(list_filter(range(0, least(len(lo), len(hi))), lambda i: lo[i + 1] <> hi[i + 1])), least(len(lo), len(hi))) AS skip
          FROM (SELECT *, min(rem) OVER (PARTITION BY node) AS lo, max(rem) OVER (PARTITION BY node) AS hi FROM t WHERE NOT fin) w1) w2) w3) w4) w5
), m AS (
  SELECT host, folded, CASE WHEN p >= 0.5 THEN 'block' ELSE 'allow' END AS method FROM t WHERE fin
)
SELECT page_id, u.host, path, rule, coalesce(said, method) AS verdict FROM u JOIN m ON u.host = m.host AND u.folded = m.folded
"""


SQL = _sql()
