"""Queries that are one declarative text: Catalyst plans it on Spark, DuckDB checks it."""

from __future__ import annotations

from ..operators.exclusion import mixed_sql
from .views import dist, replicates, tile, uniform

U_STD = mixed_sql("f.std", "r.rep", 17)
#: Draws of the resampling queries.
PERMUTATIONS, BOOTSTRAPS, PLACEBOS = 1000, 1000, 1000
REPS, BOOTS = replicates(PERMUTATIONS), replicates(BOOTSTRAPS)
CAPS = "(SELECT CAST(cap AS BIGINT) AS cap FROM (VALUES (3),(4),(6),(8),(10)) v(cap))"
RADII = "(SELECT CAST(m AS DOUBLE) AS radius FROM (VALUES (1300000),(1400000),(1500000),(1600000),(2000000)) v(m))"
R = "round({}, 6)".format


def corr(x: str, y: str) -> str:
    """Pearson correlation; null where a side is constant."""
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0e0)"




#: A rational approximation of the complementary error function, relative error below 1.2e-7.
ERFC = ["1.7087277e-1", "-8.2215223e-1", "1.48851587e0", "-1.13520398e0", "2.7886807e-1", "-1.8628806e-1", "9.678418e-2", "3.7409196e-1", "1.00002368e0", "-1.26551223e0"]


def log10_p(z: str) -> str:
    """Decimal logarithm of the two-sided normal p-value of ``z``; doesn't vanish for large ``z``."""
    x = f"(abs({z}) / 1.4142135623730951e0)"
    t = f"(1e0 / (1e0 + 5e-1 * {x}))"
    poly = ERFC[0]
    for c in ERFC[1:]:
        poly = f"({c} + {t} * {poly})"
    return f"((ln({t}) - {x} * {x} + {poly}) / 2.302585092994046e0)"


#: U, r, CLES, z and p of a value table t(arm, v) by group columns, from the counts of each distinct value.
def mann_whitney_sql(source: str, group: str = "") -> str:
    g, by, on = (f"{group}, ", f"PARTITION BY {group} ", f"GROUP BY {group}") if group else ("", "", "")
    z = "(u - n1 * n0 / 2e0) / nullif(sqrt(n1 * n0 / 12e0 * ((n1 + n0 + 1) - ties / nullif((n1 + n0) * (n1 + n0 - 1e0), 0e0))), 0e0)"
    return f"""
    SELECT {g}n1, n0, {R('u')} AS u, {R('2 * u / nullif(n1 * n0, 0) - 1')} AS r, {R('u / nullif(n1 * n0, 0)')} AS cles, {R('z')} AS z, round({log10_p('z')}, 4) AS log10_p
    FROM (SELECT {g}n1, n0, u, {z} AS z
    FROM (SELECT {g}CAST(sum(ones) AS BIGINT) AS n1, CAST(sum(n - ones) AS BIGINT) AS n0,
        sum(CAST(ones AS DOUBLE) * (below + (n + 1) / 2e0)) - CAST(sum(ones) AS DOUBLE) * (sum(ones) + 1) / 2e0 AS u,
        sum(CAST(n AS DOUBLE) * n * n - n) AS ties
      FROM (SELECT {g}v, n, ones, coalesce(sum(n) OVER ({by}ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {g}v, count(*) AS n, sum(arm) AS ones FROM {source} GROUP BY {g}v) counted) ranked {on}) m) q"""


#: Mean outcome by arm, the rate ratio (the fit of a label alone) and its model standard error at dispersion 1.
ARMS = """count(*) AS n, CAST(sum(treated) AS BIGINT) AS treated, avg(CASE WHEN treated = 1 THEN CAST(degree AS DOUBLE) END) AS m1, avg(CASE WHEN treated = 0 THEN CAST(degree AS DOUBLE) END) AS m0"""
SE = "sqrt((1 + m1) / (treated * m1) + (1 + m0) / ((n - treated) * m0))"


#: Label coefficients of the frame (b0) and of its part under a cap of 6 with rebuilt degrees (b1), of the same rows drawn.
PAIRED = f"""WITH base AS (SELECT std, treated, degree, i, size FROM numbered),
        draw AS (SELECT r.rep, least(floor(b.size * {uniform('b.i', 'r.rep', '21')}), b.size - 1) AS pick, count(*) AS times FROM base b CROSS JOIN {BOOTS} r GROUP BY r.rep, least(floor(b.size * {uniform('b.i', 'r.rep', '21')}), b.size - 1)),
        x AS (SELECT d.rep, d.times, b.treated, CAST(b.degree AS DOUBLE) AS y, CAST(c.degree AS DOUBLE) AS z FROM draw d JOIN base b ON b.i = d.pick LEFT JOIN (SELECT std, degree FROM capped WHERE cap = 6) c ON c.std = b.std),
        g AS (SELECT rep, ln((sum(times * y) FILTER (WHERE treated = 1) / sum(times) FILTER (WHERE treated = 1)) / (sum(times * y) FILTER (WHERE treated = 0) / sum(times) FILTER (WHERE treated = 0))) AS b0,
          ln((sum(times * z) FILTER (WHERE treated = 1) / sum(times) FILTER (WHERE treated = 1 AND z IS NOT NULL)) / (sum(times * z) FILTER (WHERE treated = 0) / sum(times) FILTER (WHERE treated = 0 AND z IS NOT NULL))) AS b1 FROM x GROUP BY rep)"""
#: Half samples of the frame, each with the decision's clauses: the model's p, the label permutation's (by its exact
#: variance), and the model under a cap of 10, all with a ratio above 1.
CLAUSES = f"""SELECT rep, treated, m1 / m0 AS ratio, m1 > m0 AND ln(m1 / m0) / {SE} > 1.959964e0 AS clause1,
        m1 > m0 AND (m1 - m0) / nullif(sqrt(s2 * n / (CAST(treated AS DOUBLE) * (n - treated))), 0e0) > 1.959964e0 AS clause2, coalesce(c1 > c0 AND ln(c1 / c0) / sqrt((1 + c1) / (k1 * c1) + (1 + c0) / (k0 * c0)) > 1.959964e0, false) AS clause4
        FROM (SELECT r.rep, {ARMS.replace("treated", "f.treated").replace("AS f.treated", "AS treated").replace("degree", "f.degree")}, var_samp(f.degree) AS s2,
          avg(CASE WHEN f.treated = 1 THEN CAST(c.degree AS DOUBLE) END) AS c1, avg(CASE WHEN f.treated = 0 THEN CAST(c.degree AS DOUBLE) END) AS c0, count(CASE WHEN f.treated = 1 THEN c.degree END) AS k1, count(CASE WHEN f.treated = 0 THEN c.degree END) AS k0
        FROM frame f LEFT JOIN (SELECT std, degree FROM capped WHERE cap = 10) c ON c.std = f.std CROSS JOIN {replicates(50)} r WHERE {U_STD} < 5e-1 GROUP BY r.rep) g WHERE treated > 0 AND m1 > 0 AND m0 > 0"""


SQL: dict[str, str] = {
    # projections and filters
    "uri_tail": "SELECT CAST(page_id AS BIGINT) AS page_id, regexp_replace(url, '^.*/', '') AS tail FROM pages",
    "haversine": f"SELECT r.raw, a.anchor, round({dist('r', 'a')}, 4) AS metres, round({dist('r', 'a', '6371e0')}, 6) AS km FROM raw_geo r CROSS JOIN anchors a WHERE r.lat IS NOT NULL",
    "method_agreement": f"""SELECT m.raw, m.near, c.around >= 20 AS crowded, m.near = (c.around >= 20) AS agree
        FROM (SELECT r.raw, t.near FROM raw_geo r LEFT JOIN matches t ON r.raw = t.raw) m LEFT JOIN counts_raw c ON c.raw = m.raw""",
    "agreement_counts": """SELECT count(*) FILTER (WHERE near IS NOT NULL AND big IS NOT NULL) AS both_known, count(*) FILTER (WHERE near = big) AS agree,
          count(*) FILTER (WHERE near AND NOT big) AS only_near, count(*) FILTER (WHERE big AND NOT near) AS only_big, count(*) FILTER (WHERE near AND big) AS both
        FROM (SELECT r.raw, t.near, c.around >= 20 AS big FROM raw_geo r LEFT JOIN matches t ON r.raw = t.raw LEFT JOIN counts_raw c ON c.raw = r.raw) x""",
    "method_used": """SELECT r.raw, CASE WHEN g.country LIKE '%A%' AND r.raw % 3 = 0 THEN 'A' WHEN r.lat IS NULL THEN 'no_coordinates' WHEN c.around IS NULL THEN 'overpass_failed' ELSE 'B' END AS method
        FROM raw_geo r JOIN raw_country g ON g.raw = r.raw LEFT JOIN counts_raw c ON c.raw = r.raw""",
    "asymmetric_trust": "SELECT raw, near, CASE WHEN raw % 3 = 0 THEN true WHEN raw % 3 = 1 THEN false END AS precise, CASE WHEN raw % 3 = 0 THEN true ELSE near END AS best FROM matches",
    "registry_self_check": "SELECT count(*) AS n, count(*) FILTER (WHERE name = 'GERMANY') > 0 AS known_present, count(DISTINCT anchor) = count(*) AS ids_unique FROM anchors",
    "log_effect_removed": f"""SELECT c.cap, c.n, c.treated, {R('c.m1 / c.m0')} AS ratio, {R('1 - ln(c.m1 / c.m0) / ln(b.m1 / b.m0)')} AS removed
        FROM (SELECT cap, {ARMS} FROM capped GROUP BY cap) c CROSS JOIN (SELECT {ARMS} FROM frame) b WHERE b.m1 <> b.m0 AND c.m1 > 0 AND c.m0 > 0""",
    "joint_perturbation": """SELECT c.std, c.treated, CASE WHEN a.name LIKE '%IA%' THEN 0 ELSE c.treated END AS treated_after FROM capped c JOIN first_raw f ON f.std = c.std
        JOIN matches m ON m.raw = f.raw JOIN anchors a ON a.anchor = m.anchor WHERE c.cap = 10""",
    # joins
    "left_join_methods": "SELECT r.raw, r.lat, m.anchor, round(m.distance, 4) AS distance, m.near FROM raw_geo r LEFT JOIN matches m ON r.raw = m.raw",
    "density_join": "SELECT a.raw, round(a.lat, 7) AS lat, round(a.lon, 7) AS lon, d.around FROM raw_geo a LEFT JOIN (SELECT round(m.lat, 7) AS klat, round(m.lon, 7) AS klon, max(c.around) AS around FROM matches m JOIN counts_raw c ON c.raw = m.raw GROUP BY round(m.lat, 7), round(m.lon, 7)) d ON round(a.lat, 7) = d.klat AND round(a.lon, 7) = d.klon",
    "variant_lookup": """SELECT k.raw, x.found, x.pos FROM (SELECT CAST(s_suppkey AS BIGINT) AS raw FROM supplier) k LEFT JOIN (SELECT v.raw, min_by(g.gaz, v.pos) AS found, min(v.pos) AS pos FROM (
          SELECT CAST(s_suppkey AS BIGINT) AS raw, 1 AS pos, s_name AS variant FROM supplier UNION ALL
          SELECT CAST(s_suppkey AS BIGINT), 2, concat('x', CAST(s_nationkey AS STRING)) FROM supplier UNION ALL
          SELECT CAST(s_suppkey AS BIGINT), 3, concat('y', CAST(s_suppkey % 7 AS STRING)) FROM supplier) v
        JOIN (SELECT concat('x', CAST(n_nationkey AS STRING)) AS name, CAST(n_nationkey AS BIGINT) AS gaz FROM nation WHERE n_nationkey % 2 = 0 UNION ALL
          SELECT concat('y', CAST(r_regionkey AS STRING)), CAST(100 + r_regionkey AS BIGINT) FROM region) g ON g.name = v.variant GROUP BY v.raw) x ON x.raw = k.raw""",
    "cap_presence": f"SELECT c.cap, count(DISTINCT m.std) AS present FROM {CAPS} c JOIN sizes s ON s.k < c.cap JOIN membership m ON m.paper = s.paper GROUP BY c.cap",
    "cap_frame": """SELECT f.std, f.treated, coalesce(d.degree, 0) AS degree FROM frame f
        JOIN (SELECT DISTINCT m.std FROM membership m JOIN sizes s ON s.paper = m.paper WHERE s.k < 6) p ON p.std = f.std
        LEFT JOIN (SELECT v AS std, count(*) AS degree FROM (SELECT DISTINCT a AS v, b AS w FROM pairs JOIN sizes ON sizes.paper = pairs.paper WHERE k < 6 UNION ALL SELECT DISTINCT b, a FROM pairs JOIN sizes ON sizes.paper = pairs.paper WHERE k < 6) e GROUP BY v) d ON d.std = f.std""",
    "cap_sweep": f"""SELECT e.cap, count(*) AS edges, count(DISTINCT a) AS left_ends FROM (SELECT DISTINCT c.cap, p.a, p.b FROM {CAPS} c JOIN sizes s ON s.k < c.cap JOIN pairs p ON p.paper = s.paper) e GROUP BY e.cap""",
    "leave_one_group_out": f"""SELECT country, n, treated, {R('s1 / treated')} AS mean_treated, {R('s1 / nullif(treated, 0) / nullif(s0 / nullif(n - treated, 0), 0e0)')} AS ratio FROM (
        SELECT g.country, t.n - g.n AS n, t.treated - g.treated AS treated, t.s1 - g.s1 AS s1, t.s0 - g.s0 AS s0 FROM
          (SELECT country, count(*) AS n, CAST(sum(treated) AS BIGINT) AS treated, sum(CAST(treated * degree AS DOUBLE)) AS s1, sum(CAST((1 - treated) * degree AS DOUBLE)) AS s0 FROM frame GROUP BY country) g
          CROSS JOIN (SELECT count(*) AS n, CAST(sum(treated) AS BIGINT) AS treated, sum(CAST(treated * degree AS DOUBLE)) AS s1, sum(CAST((1 - treated) * degree AS DOUBLE)) AS s0 FROM frame) t) x WHERE treated > 0""",
    "valid_edges": "SELECT e.a, e.b, e.weight FROM edges e JOIN first_raw x ON x.std = e.a JOIN first_raw y ON y.std = e.b",
    "string_to_entity": "SELECT affil.raw, min(f.std) AS std FROM affil JOIN frame f ON f.std = affil.std GROUP BY affil.raw",
    "registry_join": """SELECT i.id, i.label, c.lat, c.lon, x.country FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS label, CAST(n_regionkey AS BIGINT) AS class FROM nation) i
        JOIN (SELECT CAST(r_regionkey AS BIGINT) AS class FROM region WHERE r_regionkey < 3) k ON k.class = i.class JOIN anchors c ON c.anchor = i.id
        LEFT JOIN (SELECT CAST(r_regionkey AS BIGINT) AS class, r_name AS country FROM region WHERE r_regionkey < 2) x ON x.class = i.class""",
    "pair_geography": f"""WITH q AS (
          SELECT s.paper, s.k, gx.country = gy.country AS same, {dist('mx', 'my', '6371e0')} AS d, lx.treated OR ly.treated AS touched
          FROM pairs p JOIN sizes s ON s.paper = p.paper LEFT JOIN first_raw x ON x.std = p.a LEFT JOIN first_raw y ON y.std = p.b LEFT JOIN matches mx ON mx.raw = x.raw LEFT JOIN matches my ON my.raw = y.raw
          LEFT JOIN raw_country gx ON gx.raw = x.raw LEFT JOIN raw_country gy ON gy.raw = y.raw JOIN labels_std lx ON lx.std = p.a JOIN labels_std ly ON ly.std = p.b),
        c AS (SELECT q.*, v.class FROM q JOIN (VALUES ('ge10', 10, 1000000), ('from2to9', 2, 9), ('ge6', 6, 1000000)) v(class, low, high) ON q.k BETWEEN v.low AND v.high),
        w AS (SELECT class, PCT[med~0.5] AS median FROM (SELECT class, paper, PCT[d~0.5] AS med FROM c WHERE d IS NOT NULL GROUP BY class, paper) m GROUP BY class)
        SELECT c.class, count(DISTINCT c.paper) AS works, count(c.same) AS pairs_with_country, {R('avg(CASE WHEN c.same THEN 1e0 WHEN NOT c.same THEN 0e0 END)')} AS same_country,
          {R('CAST(count(*) FILTER (WHERE c.d < 50) AS DOUBLE) / count(*)')} AS within_50km, round(max(w.median), 4) AS median_of_medians_km,
          {R('avg(CASE WHEN c.touched AND c.same THEN 1e0 WHEN c.touched AND NOT c.same THEN 0e0 END)')} AS treated_same_country,
          {R('CAST(count(*) FILTER (WHERE c.touched AND c.d < 50) AS DOUBLE) / nullif(count(c.same) FILTER (WHERE c.touched), 0)')} AS treated_within_50km
        FROM c LEFT JOIN w ON w.class = c.class GROUP BY c.class""",
    "key_union": "SELECT std, CAST(max(has_geo) AS BIGINT) AS has_geo, CAST(max(in_work) AS BIGINT) AS in_work FROM (SELECT std, 1 AS has_geo, 0 AS in_work FROM first_raw UNION ALL SELECT std, 0, 1 FROM membership) x GROUP BY std",
    # aggregations
    "unique_addresses": "SELECT DISTINCT raw FROM affil WHERE raw IS NOT NULL",
    "corpus_dimensions": "SELECT count(*) AS n_rows, count(DISTINCT paper) AS works, count(DISTINCT std) AS institutions, count(DISTINCT raw) AS strings, count(DISTINCT author) AS authors FROM affil",
    "paper_sets": "SELECT paper, count(*) AS k, LISTED[std] AS institutions FROM membership GROUP BY paper",
    "paper_count": "SELECT std, count(DISTINCT paper) AS papers FROM affil GROUP BY std",
    "majority_label": "SELECT std, treated FROM labels_std",
    "majority_label_pair": "SELECT std, coalesce(2 * sum(CASE WHEN near THEN 1 ELSE 0 END) > count(near), false) AS treated FROM (SELECT DISTINCT raw, std FROM affil) p LEFT JOIN matches ON p.raw = matches.raw GROUP BY std",
    "first_valid": "SELECT f.std, f.raw, m.lat, m.lon FROM first_raw f JOIN matches m ON m.raw = f.raw",
    "mode_name": "SELECT std, name, n FROM (SELECT std, name, n, row_number() OVER (PARTITION BY std ORDER BY n DESC, name) AS i FROM (SELECT affil.std, a.name, count(*) AS n FROM affil JOIN matches m ON m.raw = affil.raw JOIN anchors a ON a.anchor = m.anchor GROUP BY affil.std, a.name) c) r WHERE i = 1",
    "institution_lookup": """SELECT l.std, l.treated, f.raw AS first_raw, c.around, p.papers FROM labels_std l LEFT JOIN first_raw f ON f.std = l.std LEFT JOIN counts_raw c ON c.raw = f.raw
        JOIN (SELECT std, count(DISTINCT paper) AS papers FROM affil GROUP BY std) p ON p.std = l.std""",
    "analysis_frame": f"SELECT std, degree, treated, {R('log_univ')} AS log_univ, {R('log_near')} AS log_near, papers, {R('log_papers')} AS log_papers, country FROM frame",
    "naive_frame": f"""SELECT r.raw, coalesce(d.degree, 0) AS degree, CASE WHEN m.near THEN 1 ELSE 0 END AS treated, {R('ln(1e0 + c.around)')} AS log_univ
        FROM (SELECT DISTINCT raw FROM affil) r JOIN matches m ON m.raw = r.raw JOIN counts_raw c ON c.raw = r.raw
        LEFT JOIN (SELECT x AS raw, count(DISTINCT y) AS degree FROM (SELECT a.raw AS x, b.raw AS y FROM (SELECT DISTINCT paper, raw FROM affil) a JOIN (SELECT DISTINCT paper, raw FROM affil) b ON a.paper = b.paper AND a.raw <> b.raw) e GROUP BY x) d ON d.raw = r.raw""",
    "set_size_stats": f"SELECT {R('avg(CAST(k AS DOUBLE))')} AS mean_k, {R('PCT[k~0.5]')} AS median_k, max(k) AS max_k, {R('avg(CASE WHEN k >= 10 THEN 1e0 ELSE 0e0 END)')} AS share_large FROM sizes",
    "censoring_share": f"SELECT {R('avg(CASE WHEN c.nearest IS NULL THEN 1e0 ELSE 0e0 END)')} AS censored, count(*) AS n, max(b.at_bound) AS at_bound FROM counts_raw c CROSS JOIN (SELECT {R('avg(CASE WHEN log_near >= ln(1e0 + 4e6) THEN 1e0 ELSE 0e0 END)')} AS at_bound FROM frame) b",
    "missingness_by_group": f"SELECT region, count(*) AS n, CAST(sum(CASE WHEN lat IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS failed, {R('avg(CASE WHEN lat IS NULL THEN 1e0 ELSE 0e0 END)')} AS rate FROM (SELECT DISTINCT raw FROM affil) a JOIN raw_country g ON g.raw = a.raw LEFT JOIN raw_geo r ON r.raw = a.raw GROUP BY region HAVING count(*) >= 20 ORDER BY rate DESC, region",
    "entity_country": """WITH r AS (SELECT l.paper, l.author, l.std, CASE WHEN l.raw % 8 <> 0 THEN g.country END AS country FROM affil l JOIN raw_country g ON g.raw = l.raw),
        a AS (SELECT paper, author, count(*) AS n, count(country) AS known, count(DISTINCT country) AS kinds, max(country) AS one FROM r GROUP BY paper, author),
        v AS (SELECT r.std, CASE WHEN a.known = a.n THEN r.country ELSE a.one END AS country FROM r JOIN a ON a.paper = r.paper AND a.author = r.author WHERE a.known = a.n OR a.kinds = 1)
        SELECT std, country FROM (SELECT std, country, row_number() OVER (PARTITION BY std ORDER BY count(*) DESC, country) AS i FROM v GROUP BY std, country) x WHERE i = 1""",
    "tie_share": f"SELECT c.cap, count(*) FILTER (WHERE s.k >= c.cap) AS works, {R('sum(CASE WHEN s.k >= c.cap THEN s.k * (s.k - 1) / 2e0 ELSE 0e0 END) / sum(s.k * (s.k - 1) / 2e0)')} AS share FROM sizes s CROSS JOIN {CAPS} c GROUP BY c.cap",
    "node_reconciliation": f"""SELECT treated, count(*) AS nodes, count(*) FILTER (WHERE degree > 0) AS non_isolated, count(*) FILTER (WHERE degree = 0) AS isolated, {R('avg(CAST(degree AS DOUBLE))')} AS mean_degree,
          count(*) FILTER (WHERE p.std IS NULL) AS dropped_by_cap, {R('avg(CASE WHEN p.std IS NULL THEN CAST(degree AS DOUBLE) END)')} AS mean_degree_dropped, {R('avg(CASE WHEN p.std IS NULL THEN 1e0 ELSE 0e0 END)')} AS share_dropped,
          max(e.edges) AS edges FROM frame f LEFT JOIN (SELECT std FROM capped WHERE cap = 3) p ON p.std = f.std CROSS JOIN (SELECT count(*) AS edges FROM edges) e GROUP BY treated""",
    "arm_summary": f"SELECT treated, count(*) AS n, {R('avg(CAST(degree AS DOUBLE))')} AS mean_degree, {R('PCT[degree~0.5]')} AS median_degree, {R('avg(log_univ)')} AS mean_density FROM frame GROUP BY treated",
    "box_summary": f"""WITH q AS (SELECT treated, PCT[degree~0.25] AS q1, PCT[degree~0.5] AS median, PCT[degree~0.75] AS q3, avg(CAST(degree AS DOUBLE)) AS mean FROM frame GROUP BY treated)
        SELECT q.treated, CAST(min(f.degree) FILTER (WHERE f.degree >= q.q1 - 15e-1 * (q.q3 - q.q1)) AS BIGINT) AS low, {R('max(q.q1)')} AS q1, {R('max(q.median)')} AS median, {R('max(q.q3)')} AS q3,
          CAST(max(f.degree) FILTER (WHERE f.degree <= q.q3 + 15e-1 * (q.q3 - q.q1)) AS BIGINT) AS high, {R('max(q.mean)')} AS mean FROM frame f JOIN q ON q.treated = f.treated GROUP BY q.treated""",
    "mann_whitney": mann_whitney_sql("(SELECT treated AS arm, degree AS v FROM frame) t"),
    "catchment_stats": f"""WITH c AS (SELECT anchor, n, treated, row_number() OVER (ORDER BY treated DESC, n DESC, anchor) AS place, count(*) OVER () AS catchments, sum(CASE WHEN treated > 0 THEN 1 ELSE 0 END) OVER () AS with_treated, CAST(sum(treated) OVER () AS BIGINT) AS all_treated FROM (
        SELECT m.anchor, count(*) AS n, CAST(sum(f.treated) AS BIGINT) AS treated FROM frame f JOIN first_raw x ON x.std = f.std JOIN matches m ON m.raw = x.raw GROUP BY m.anchor) g)
        SELECT anchor, n, treated, place, catchments, CAST(with_treated AS BIGINT) AS with_treated, {R('CAST(sum(CASE WHEN place <= 5 THEN treated ELSE 0 END) OVER () AS DOUBLE) / nullif(all_treated, 0)')} AS top5_share FROM c""",
    "covariate_corr": f"SELECT {R(corr('log_univ', 'log_near'))} AS univ_near, {R(corr('log_univ', 'CAST(degree AS DOUBLE)'))} AS univ_degree, {R(corr('log_papers', 'CAST(degree AS DOUBLE)'))} AS papers_degree FROM frame",
    "vif": f"SELECT {R('1 / (1 - pow(' + corr('log_univ', 'log_papers') + ', 2))')} AS vif FROM frame",
    "collapse_ratio": f"SELECT {R('CAST(count(DISTINCT raw) AS DOUBLE) / count(DISTINCT std)')} AS ratio FROM affil",
    "draw_summary": f"""SELECT count(*) AS draws, {R('PCT[ratio~0.5]')} AS median_ratio, {R('PCT[ratio~0.25]')} AS q1, {R('PCT[ratio~0.75]')} AS q3, {R('PCT[treated~0.5]')} AS median_treated,
        {R('avg(CASE WHEN clause1 THEN 1e0 ELSE 0e0 END)')} AS clause1, {R('avg(CASE WHEN clause2 THEN 1e0 ELSE 0e0 END)')} AS clause2, {R('avg(CASE WHEN clause4 THEN 1e0 ELSE 0e0 END)')} AS clause4,
        {R('avg(CASE WHEN clause1 AND clause2 AND clause4 THEN 1e0 ELSE 0e0 END)')} AS all_clauses FROM ({CLAUSES}) d""",
    "criterion_pass": f"SELECT rep, treated, {R('ratio')} AS ratio, clause1, clause2, clause4, clause1 AND clause2 AND clause4 AS passed FROM ({CLAUSES}) d",
    # windows
    "holm_stepdown": f"""WITH p AS (SELECT country, round({log10_p('z')}, 6) AS lp FROM (SELECT country, ln(m1 / m0) / {SE} AS z FROM (SELECT country, {ARMS} FROM frame GROUP BY country) a WHERE m1 > 0 AND m0 > 0) b)
        SELECT country, lp AS log10_p, place, min(CASE WHEN lp < log10(5e-2 / (m - place + 1)) THEN 1 ELSE 0 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rejected FROM (
        SELECT country, lp, count(*) OVER () AS m, row_number() OVER (ORDER BY lp, country) AS place FROM p) y""",
    "density_strata": f"SELECT stratum, count(*) AS n, CAST(sum(treated) AS BIGINT) AS treated, min(std) AS least FROM (SELECT std, treated, {tile('place', 'size', 5)} AS stratum FROM ranked) x GROUP BY stratum",
    "subsample_works": f"""WITH x AS (SELECT rep, paper FROM (SELECT r.rep, s.paper, row_number() OVER (PARTITION BY r.rep ORDER BY {uniform('s.paper', 'r.rep', '7')}, s.paper) AS i FROM sizes s CROSS JOIN {replicates(50)} r) y WHERE i <= 500),
        e AS (SELECT DISTINCT x.rep, p.a, p.b FROM x JOIN pairs p ON p.paper = x.paper),
        d AS (SELECT rep, std, count(*) AS degree FROM (SELECT rep, a AS std FROM e UNION ALL SELECT rep, b FROM e) v GROUP BY rep, std),
        m AS (SELECT DISTINCT x.rep, m.std FROM x JOIN membership m ON m.paper = x.paper),
        g AS (SELECT m.rep, {ARMS.replace("treated", "f.treated").replace("AS f.treated", "AS treated").replace("degree", "coalesce(d.degree, 0)")} FROM m JOIN frame f ON f.std = m.std LEFT JOIN d ON d.rep = m.rep AND d.std = m.std GROUP BY m.rep)
        SELECT rep, n, treated, {R('m1 / nullif(m0, 0e0)')} AS ratio FROM g""",
    "threshold_sweep": f"""SELECT radius, CAST(sum(treated) AS BIGINT) AS treated, {R('avg(CASE WHEN treated = 1 THEN CAST(degree AS DOUBLE) END)')} AS mean_treated, {R('avg(CASE WHEN treated = 1 THEN CAST(degree AS DOUBLE) END) / avg(CASE WHEN treated = 0 THEN CAST(degree AS DOUBLE) END)')} AS ratio FROM (
        SELECT x.radius, x.std, d.degree, CASE WHEN 2 * x.yes > x.n THEN 1 ELSE 0 END AS treated FROM (
          SELECT q.radius, affil.std, sum(CASE WHEN m.distance <= q.radius THEN 1 ELSE 0 END) AS yes, count(m.distance) AS n FROM affil LEFT JOIN matches m ON m.raw = affil.raw CROSS JOIN {RADII} q GROUP BY q.radius, affil.std) x
        JOIN degrees d ON d.std = x.std) y GROUP BY radius HAVING sum(treated) >= 5""",
    "node_table": "SELECT d.std AS id, substr(p.p_name, 1, 80) AS name, d.degree, round(m.lat, 6) AS lat, round(m.lon, 6) AS lon, l.treated, m.anchor FROM degrees d JOIN first_raw f ON f.std = d.std JOIN matches m ON m.raw = f.raw JOIN labels_std l ON l.std = d.std JOIN part p ON p.p_partkey = d.std",
    # resampling whose draws are hashes
    "stratified_permutation": f"""WITH f AS (SELECT 'country' AS strata, std, degree, treated, country AS g FROM frame UNION ALL
          SELECT 'density_quintile', std, degree, treated, CAST({tile('place', 'size', 5)} AS STRING) FROM ranked UNION ALL
          SELECT 'density_decile', std, degree, treated, CAST({tile('place', 'size', 10)} AS STRING) FROM ranked),
        x AS (SELECT f.strata, r.rep, f.degree, row_number() OVER (PARTITION BY f.strata, r.rep, f.g ORDER BY {U_STD}, f.std) <= sum(f.treated) OVER (PARTITION BY f.strata, r.rep, f.g) AS yes FROM f CROSS JOIN {REPS} r),
        d AS (SELECT strata, rep, ln(avg(CASE WHEN yes THEN CAST(degree AS DOUBLE) END) / avg(CASE WHEN NOT yes THEN CAST(degree AS DOUBLE) END)) AS coef FROM x GROUP BY strata, rep)
        SELECT d.strata, count(*) AS reps, {R('stddev_samp(d.coef)')} AS sd, {R('(count(*) FILTER (WHERE abs(d.coef) >= abs(b.obs)) + 1e0) / (count(*) + 1e0)')} AS p FROM d CROSS JOIN (SELECT ln(m1 / m0) AS obs FROM (SELECT {ARMS} FROM frame) a) b GROUP BY d.strata""",
    "catchment_permutation": f"""WITH c AS (SELECT f.std, f.degree, f.treated, m.anchor FROM frame f JOIN first_raw x ON x.std = f.std JOIN matches m ON m.raw = x.raw),
        k AS (SELECT anchor, count(*) AS size, CAST(sum(treated) AS BIGINT) AS n1, row_number() OVER (ORDER BY anchor) AS i FROM c GROUP BY anchor),
        d AS (SELECT r.rep, k.anchor, row_number() OVER (PARTITION BY r.rep ORDER BY {uniform('k.anchor', 'r.rep', '3')}, k.anchor) AS j FROM k CROSS JOIN {REPS} r ),
        t AS (SELECT d.rep, d.anchor, k.n1 FROM d JOIN k ON k.i = d.j),
        w AS (SELECT t.rep, c.degree, t.n1, row_number() OVER (PARTITION BY t.rep, t.anchor ORDER BY {uniform('c.std', 't.rep', '4')}, c.std) AS i FROM t JOIN c ON c.anchor = t.anchor),
        z AS (SELECT rep, ln(avg(CASE WHEN i <= n1 THEN CAST(degree AS DOUBLE) END) / avg(CASE WHEN i > n1 THEN CAST(degree AS DOUBLE) END)) AS coef, sum(CASE WHEN i <= n1 THEN 1 ELSE 0 END) AS treated FROM w GROUP BY rep)
        SELECT count(z.coef) AS reps, {R('avg(CAST(z.treated AS DOUBLE))')} AS mean_treated, {R('stddev_samp(z.coef)')} AS sd, {R('(count(*) FILTER (WHERE abs(z.coef) >= abs(b.obs)) + 1e0) / (count(z.coef) + 1e0)')} AS p FROM z CROSS JOIN (SELECT ln(m1 / m0) AS obs FROM (SELECT {ARMS} FROM frame) a) b""",
    "bootstrap_rank_biserial": f"""WITH n AS (SELECT std, treated, degree, i, size FROM in_arms),
        s AS (SELECT r.rep, n.treated, least(floor(n.size * {uniform('n.i', 'n.treated', 'r.rep', '9')}), n.size - 1) AS pick FROM n CROSS JOIN {BOOTS} r),
        t AS (SELECT s.rep, n.treated AS arm, n.degree AS v FROM s JOIN n ON n.treated = s.treated AND n.i = s.pick)
        SELECT count(*) AS reps, round(PCT[r~0.025], 5) AS low, round(PCT[r~0.975], 5) AS high, round(stddev_samp(r), 5) AS sd, max(o.observed) AS observed
        FROM ({mann_whitney_sql("t", "rep")}) d CROSS JOIN (SELECT r AS observed FROM ({mann_whitney_sql("(SELECT treated AS arm, degree AS v FROM frame) y")}) q) o""",
    "vintage_swap": f"""SELECT spec, {R(corr('x', 'CAST(degree AS DOUBLE)'))} AS r, {R('avg(x)')} AS mean, count(*) AS n FROM (SELECT 'far' AS spec, log_univ AS x, degree FROM frame UNION ALL
        SELECT 'close', ln(1e0 + coalesce(k.around, 0)), f.degree FROM frame f JOIN first_raw x ON x.std = f.std LEFT JOIN close_raw k ON k.raw = x.raw) v GROUP BY spec""",
    "paired_share_bootstrap": PAIRED + """ SELECT rep, round(b0, 5) AS b0, round(b1, 5) AS b1, CASE WHEN b0 > 0 THEN round(1 - b1 / b0, 4) END AS removed FROM g""",
    "cluster_bootstrap_diff": f"""WITH base AS (SELECT std, treated, degree, i, size FROM numbered),
        reps AS (SELECT rep FROM {replicates(200)} v),
        d AS (SELECT s.rep, b.std, b.treated, b.degree FROM (SELECT r.rep, least(floor(x.size * {uniform('x.i', 'r.rep', '41')}), x.size - 1) AS pick FROM base x CROSS JOIN reps r) s JOIN base b ON b.i = s.pick),
        link AS (SELECT affil.raw, min(f.std) AS std FROM affil JOIN frame f ON f.std = affil.std GROUP BY affil.raw),
        sets AS (SELECT DISTINCT paper, raw FROM affil),
        near AS (SELECT a.raw, count(DISTINCT b.raw) AS degree FROM sets a JOIN sets b ON b.paper = a.paper AND b.raw <> a.raw GROUP BY a.raw),
        naive AS (SELECT m.raw, CASE WHEN m.near THEN 1 ELSE 0 END AS treated, coalesce(near.degree, 0) AS degree FROM matches m LEFT JOIN near ON near.raw = m.raw),
        loose AS (SELECT n.raw, n.treated, n.degree, row_number() OVER (ORDER BY n.raw) - 1 AS i, count(*) OVER () AS size FROM naive n LEFT JOIN link l ON l.raw = n.raw WHERE l.raw IS NULL),
        t AS (SELECT rep * 2 AS scheme, treated AS arm, degree AS v FROM d UNION ALL SELECT d.rep * 2 + 1, n.treated, n.degree FROM d JOIN link ON link.std = d.std JOIN naive n ON n.raw = link.raw UNION ALL
          SELECT s.rep * 2 + 1, l.treated, l.degree FROM (SELECT r.rep, least(floor(x.size * {uniform('x.i', 'r.rep', '43')}), x.size - 1) AS pick FROM loose x CROSS JOIN reps r) s JOIN loose l ON l.i = s.pick),
        r AS ({mann_whitney_sql("t", "scheme")}),
        z AS (SELECT n.r - m.r AS x FROM r n JOIN r m ON n.scheme = m.scheme + 1 WHERE m.scheme % 2 = 0 AND n.r IS NOT NULL AND m.r IS NOT NULL)
        SELECT count(*) AS reps, round(avg(x), 5) AS mean, round(PCT[x~0.05], 5) AS ci90_low, round(PCT[x~0.95], 5) AS ci90_high, round(PCT[x~0.025], 5) AS ci95_low, round(PCT[x~0.975], 5) AS ci95_high,
          PCT[x~0.05] > -5e-2 AND PCT[x~0.95] < 5e-2 AS equivalent_005, PCT[x~0.05] > -1e-1 AND PCT[x~0.95] < 1e-1 AS equivalent_010 FROM z""",
    "log_difference_summary": PAIRED + """, d AS (SELECT b0 - b1 AS x FROM g WHERE b0 IS NOT NULL AND b1 IS NOT NULL)
        SELECT count(*) AS reps, round(PCT[x~0.5], 5) AS median, round(PCT[x~0.025], 5) AS ci95_low, round(PCT[x~0.975], 5) AS ci95_high, round(PCT[x~0.1], 5) AS ci80_low, round(PCT[x~0.9], 5) AS ci80_high,
          round(PCT[x~0.75] - PCT[x~0.25], 5) AS iqr, round(avg(CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END), 5) AS share_positive FROM d""",
}

#: What DuckDB runs for the placebo draws; Spark takes them from the exclusion operator.
PLACEBO = f"""WITH run AS (SELECT r.rep, s.paper, s.k * (s.k - 1) / 2e0 AS ti, {mixed_sql('s.paper', 'r.rep', 5)} AS u FROM sizes s CROSS JOIN {replicates(PLACEBOS)} r WHERE s.k >= 2),
        cum AS (SELECT rep, paper, ti, coalesce(sum(ti) OVER (PARTITION BY rep ORDER BY u, paper ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before FROM run),
        total AS (SELECT sum(k * (k - 1) / 2e0) AS ti FROM sizes WHERE k >= 2),
        cut AS (SELECT rep, paper, cum.ti / total.ti AS share FROM cum CROSS JOIN total WHERE before / total.ti < 17e-2),
        gone AS (SELECT g.rep, f.treated, count(*) AS n FROM (SELECT cut.rep, m.std, count(*) AS c FROM cut JOIN membership m ON m.paper = cut.paper GROUP BY cut.rep, m.std) g JOIN frame f ON f.std = g.std AND f.papers = g.c GROUP BY g.rep, f.treated),
        lost AS (SELECT x.rep, x.a, x.b FROM (SELECT cut.rep, p.a, p.b, count(*) AS c FROM cut JOIN pairs p ON p.paper = cut.paper GROUP BY cut.rep, p.a, p.b) x JOIN edges e ON e.a = x.a AND e.b = x.b AND e.weight = x.c),
        less AS (SELECT l.rep, f.treated, count(*) AS n FROM (SELECT rep, a AS std FROM lost UNION ALL SELECT rep, b FROM lost) l JOIN frame f ON f.std = l.std GROUP BY l.rep, f.treated),
        arm AS (SELECT treated, count(*) AS n, sum(CAST(degree AS DOUBLE)) AS s FROM frame GROUP BY treated),
        d AS (SELECT c.rep, c.dropped, c.share, a.treated, (a.s - coalesce(less.n, 0)) / (a.n - coalesce(gone.n, 0)) AS mean FROM (SELECT rep, count(*) AS dropped, sum(share) AS share FROM cut GROUP BY rep) c CROSS JOIN arm a
          LEFT JOIN less ON less.rep = c.rep AND less.treated = a.treated LEFT JOIN gone ON gone.rep = c.rep AND gone.treated = a.treated)
        SELECT d.rep, max(d.dropped) AS dropped, {R('max(d.share)')} AS share, {R('max(CASE WHEN d.treated = 1 THEN d.mean END) / max(CASE WHEN d.treated = 0 THEN d.mean END)')} AS ratio,
          {R('1 - ln(max(CASE WHEN d.treated = 1 THEN d.mean END) / max(CASE WHEN d.treated = 0 THEN d.mean END)) / ln(max(b.m1 / b.m0))')} AS removed FROM d CROSS JOIN (SELECT {ARMS} FROM frame) b GROUP BY d.rep"""


#: Label permutations: by draw, what the n1 rows of least random number sum to.  DuckDB ranks them; Spark takes the sums from the operator.
DRAWS = f"""(SELECT rep, CAST(max(n1) AS BIGINT) AS n1, count(*) AS n, sum(CASE WHEN i <= n1 THEN CAST(degree AS DOUBLE) ELSE 0e0 END) AS s1, sum(CAST(degree AS DOUBLE)) AS s, CAST(sum(CASE WHEN i <= n1 AND big THEN 1 ELSE 0 END) AS DOUBLE) AS hubs FROM (
        SELECT r.rep, f.degree, f.degree >= top.cut AS big, row_number() OVER (PARTITION BY r.rep ORDER BY {U_STD}, f.std) AS i, sum(f.treated) OVER (PARTITION BY r.rep) AS n1
        FROM frame f CROSS JOIN (SELECT PCT[degree~0.99] AS cut FROM frame) top CROSS JOIN {REPS} r) x GROUP BY rep)"""
_RATIO = "ln((s1 / n1) / ((s - s1) / (n - n1)))"


def draw_statistics(draws: str) -> dict[str, str]:
    """Statistics of the draws' table (rep, n1, n, s1, s, hubs)."""
    seen = f"(SELECT ln(m1 / m0) AS obs FROM (SELECT {ARMS} FROM frame) a)"
    return {
        "mean_diff_permutation": f"""SELECT count(*) AS reps, {R('avg(diff)')} AS mean, {R('stddev_samp(diff)')} AS sd, {R('max(b.m1 - b.m0)')} AS observed, {R('CAST(count(*) FILTER (WHERE abs(diff) >= abs(b.m1 - b.m0)) AS DOUBLE) / count(*)')} AS p
            FROM (SELECT rep, s1 / n1 - (s - s1) / (n - n1) AS diff FROM {draws} q) y CROSS JOIN (SELECT {ARMS} FROM frame) b""",
        "hub_loading": f"""WITH d AS (SELECT rep, hubs, abs({_RATIO}) AS coef FROM {draws} z), q AS (SELECT PCT[coef~0.95] AS p95 FROM d)
            SELECT count(*) AS reps, {R(corr('hubs', 'coef'))} AS correlation, {R('avg(hubs)')} AS hubs, {R('avg(CASE WHEN coef >= q.p95 THEN hubs END)')} AS hubs_in_extreme_draws FROM d CROSS JOIN q""",
        "null_diagnostics": f"""SELECT count(*) AS n, {R('avg(diff)')} AS mean, {R('stddev_samp(diff)')} AS sd, {R('PCT[abs(diff)~0.95]')} AS p95, {R('PCT[abs(diff)~0.99]')} AS p99,
            {R('avg(CASE WHEN abs(diff) > 3 * s THEN 1e0 ELSE 0e0 END)')} AS beyond_3sd, {R('max(abs(b.obs)) / stddev_samp(diff)')} AS observed_over_sd, {R('(count(*) FILTER (WHERE abs(diff) >= abs(b.obs)) + 1e0) / (count(*) + 1e0)')} AS p,
            {R('avg(pow(diff - m, 3)) / pow(avg(pow(diff - m, 2)), 15e-1)')} AS skew, {R('avg(pow(diff - m, 4)) / pow(avg(pow(diff - m, 2)), 2) - 3')} AS kurtosis
            FROM (SELECT diff, avg(diff) OVER () AS m, stddev_samp(diff) OVER () AS s FROM (SELECT {_RATIO} AS diff FROM {draws} q) y) z CROSS JOIN {seen} b""",
        "permutation_critical": f"SELECT {R('PCT[abs(diff)~0.95]')} AS critical, count(*) AS reps FROM (SELECT {_RATIO} AS diff FROM {draws} q) y",
    }
