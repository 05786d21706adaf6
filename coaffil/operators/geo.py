"""Point operators: nearest anchor, radius joins over a grid, polygons, ring assembly."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import EARTH_M, haversine
from .network import checkpointed

#: Metres of one degree on the sphere.
DEGREE_M = 111_195.0


def nearest_anchor(points: DataFrame, anchors: DataFrame, key: str, radius_m: float, max_broadcast_rows: int = 1000) -> DataFrame:
    """Adds anchor, distance and near to points (key, lat, lon); the lowest anchor wins ties.

    Rows without coordinates are left out.  Anchors up to ``max_broadcast_rows``, which are counted,
    are broadcast and reduced in the same stage by a map-side minimum.  Beyond that a grid join finds
    the nearest within ``radius_m``; points with none are tried again with twice the radius, until the
    circle covers the sphere, so the result is the same.
    """
    located = points.where("lat is not null and lon is not null")
    a = anchors.where("lat is not null and lon is not null").select("anchor", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    if a.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        pairs = located.crossJoin(F.broadcast(a)).withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon")))
        best = pairs.groupBy(key, "lat", "lon").agg(F.min(F.struct("distance", "anchor")).alias("b"))
        return best.select(key, "lat", "lon", "b.anchor", "b.distance", (F.col("b.distance") <= radius_m).alias("near"))
    todo, radius, found = checkpointed(located.select(key, "lat", "lon")), radius_m, None
    while True:
        best = within_radius(todo, anchors, key, "anchor", radius).groupBy(key).agg(F.min(F.struct("distance", "anchor")).alias("b"))
        tried = checkpointed(todo.join(best, key, "left"))
        hit = tried.where("b is not null").select(key, "lat", "lon", "b.anchor", "b.distance", (F.col("b.distance") <= radius_m).alias("near"))
        found = hit if found is None else found.unionByName(hit)
        todo = tried.where("b is null").select(key, "lat", "lon")
        if radius > math.pi * EARTH_M or todo.isEmpty():
            return found
        radius *= 2


def _dealt(left: DataFrame, right: DataFrame, left_key: str, radius_m: float, keep: list) -> tuple[DataFrame, DataFrame, float, float]:
    """Left points by each grid cell that their circle touches, right points (r_lat, r_lon, *keep) by their own, a cell's height and width."""
    step = min(180.0, radius_m / DEGREE_M)
    columns = max(1, int(360 // step))
    width = 360.0 / columns
    lon = F.pmod(F.col("lon") + 180, F.lit(360.0))
    r = right.where("lat is not null and lon is not null").select(
        *keep, F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"),
        F.floor(F.col("lat") / step).alias("row"), F.least(F.floor(lon / width), F.lit(columns - 1)).alias("col"),
    )
    reach = F.when(F.abs("lat") + step >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(min(radius_m / EARTH_M, math.pi / 2))) / F.cos(F.radians("lat"))))))
    cols = F.when(reach * 2 + width >= 360, F.sequence(F.lit(0), F.lit(columns - 1))).otherwise(
        F.sequence(F.floor((lon - reach - 1e-9) / width).cast("int"), F.floor((lon + reach + 1e-9) / width).cast("int"))
    )
    l = left.where("lat is not null and lon is not null").select(
        F.col(left_key).alias("_l"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"),
        F.explode(F.sequence(F.floor((F.col("lat") - step - 1e-9) / step), F.floor((F.col("lat") + step + 1e-9) / step))).alias("row"), cols.alias("cols"),
    ).withColumn("col", F.explode(F.array_distinct(F.transform("cols", lambda c: F.pmod(c, F.lit(columns)).cast("long"))))).drop("cols")
    return l, r, step, width


def within_radius(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius_m: float) -> DataFrame:
    """(left_key, right_key, distance) of all pairs within ``radius_m``, by an equi-join on grid cells.

    Each right point has one cell; a left point visits the cells that its circle touches, wrapping
    at the date line and taking whole bands near the poles.  Null coordinates match nothing.
    """
    l, r, _, _ = _dealt(left, right, left_key, radius_m, [F.col(right_key).alias("_r")])
    near = l.join(r, ["row", "col"]).withColumn("distance", haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    return near.where(F.col("distance") <= radius_m).select(F.col("_l").alias(left_key), F.col("_r").alias(right_key), "distance")


def _salted(l: DataFrame, r: DataFrame, most_left: int, most_right: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column salt: cells of more rows than that are cut, and each left part meets each right part."""
    cells = ["row", "col"]
    few = []
    for side, most in ((l, most_left), (r, most_right)):
        few.append([(x.row, x.col, -(-x["count"] // most)) for x in side.groupBy(*cells).count().where(F.col("count") > most).collect()])  # large cells alone
    if not any(few):
        return l.withColumn("salt", F.lit(0)), r.withColumn("salt", F.lit(0))
    spark = l.sparkSession
    for name, rows in zip(("nl", "nr"), few):
        parts = F.broadcast(spark.createDataFrame(rows, f"row long, col long, {name} int"))  # fewer rows than there are cells
        l, r = (x.join(parts, cells, "left").na.fill(1, [name]) for x in (l, r))
    own = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l = l.withColumn("_own", own("nl", "_l")).withColumn("_other", every("nr")).withColumn("salt", F.col("_own") * F.col("nr") + F.col("_other"))
    r = r.withColumn("_own", own("nr", "_r", "r_lat", "r_lon")).withColumn("_other", every("nl")).withColumn("salt", F.col("_other") * F.col("nr") + F.col("_own"))
    return l.drop("nl", "nr", "_own", "_other"), r.drop("nl", "nr", "_own", "_other")


def counted_within(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius_m: float, category: str | None = None, nearest: bool = True, most_left: int = 1 << 15, most_right: int = 1 << 18) -> DataFrame:
    """(left_key, category, n, nearest): how many right points lie within ``radius_m`` and the least distance of one, by category.

    Pairs are not formed.  Each cell of the grid is one group of a task, large ones in parts; in it
    right points lie in narrow bands of latitude, sorted by longitude.  A circle cuts a band in an
    interval of longitudes that are surely inside, which is counted by its ends, and two rims whose
    points are tested.  The least distance is looked for in growing circles.  Left points without a
    right one have no rows.
    """
    l, r, step, width = _dealt(left, right, left_key, radius_m, [F.col(right_key).alias("_r"), (F.col(category) if category else F.lit(None)).cast("string").alias("_c")])
    l, r = _salted(l, r, most_left, most_right)
    kind = dict(l.dtypes)["_l"]

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out = pa.schema([pa.field(left_key, a.schema.field("_l").type), ("category", pa.string()), ("n", pa.int64()), ("nearest", pa.float64())])
        found = []
        if a.num_rows and b.num_rows:
            row, col = key[0].as_py(), key[1].as_py()
            ids, la, lo = a.column("_l").combine_chunks(), a.column("l_lat").to_numpy(), a.column("l_lon").to_numpy()
            codes = b.column("_c").combine_chunks().dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.fill_null(-1).to_numpy()
            for k in np.unique(code):
                own = code == k
                bands = _Bands(b.column("r_lat").to_numpy()[own], b.column("r_lon").to_numpy()[own], row * step, step, col * width - 180 + width / 2)
                for at in range(0, len(la), 4096):
                    part = slice(at, at + 4096)
                    n = bands.count(la[part], lo[part], radius_m)
                    some = np.flatnonzero(n)
                    d = bands.nearest(la[part][some], lo[part][some], radius_m) if nearest else np.full(len(some), np.nan)
                    found.append(pa.Table.from_arrays([ids.take(pa.array(some + at)), pa.array([names[k] if k >= 0 else None] * len(some), pa.string()), pa.array(n[some]), pa.array(d, mask=np.isnan(d))], schema=out))
        return pa.concat_tables(found) if found else out.empty_table()

    keys = ["row", "col", "salt"]
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    parts = l.repartition(max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys).groupBy(*keys).cogroup(r.drop("_r").groupBy(*keys)).applyInArrow(run, f"{left_key} {kind}, category string, n long, nearest double")
    return parts.groupBy(left_key, "category").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"))


class _Bands:
    """Points of a grid cell in bands of latitude, by longitude from the cell's middle."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, low: float, step: float, middle: float, bands: int = 40):
        self.low, self.height, self.bands, self.middle = low, step / bands, bands, middle
        band = np.clip(np.floor((lat - low) / self.height), 0, bands - 1)
        key = band * 1024 + self._off(lon)
        order = np.argsort(key, kind="stable")
        self.key, self.lat, self.lon = key[order], lat[order], lon[order]
        # Of each band the latitudes that occur in it, which rounding may put a little outside.
        ends = low + self.height * np.arange(bands + 1)
        pad = 1e-9 * (1 + np.abs(ends).max())
        self.edges = np.radians(np.clip(np.stack([ends[:-1] - pad, ends[1:] + pad]), -90, 90))
        self.full = np.unique(band.astype(np.int64))

    def _off(self, lon: np.ndarray) -> np.ndarray:
        return (lon - self.middle + 180) % 360 - 180

    def _intervals(self, lat: np.ndarray, lon: np.ndarray, metres: np.ndarray):
        """Left rows, and ends of the index ranges: possibly inside from a to d, surely from b to c."""
        delta, phi = metres / EARTH_M, np.radians(lat)
        edge = self.edges[:, self.full]
        with np.errstate(all="ignore"):
            h = np.sin(delta / 2)[:, None] ** 2

            def half(e: np.ndarray) -> np.ndarray:
                s = (h - np.sin((e[None, :] - phi[:, None]) / 2) ** 2) / np.maximum(np.cos(e)[None, :] * np.cos(phi)[:, None], 1e-15)
                return np.where(s < 0, -1.0, 2 * np.arcsin(np.sqrt(np.clip(s, 0, 1))))

            w0, w1 = half(edge[0]), half(edge[1])
            inner, outer = np.minimum(w0, w1), np.maximum(w0, w1)
            turn = np.sin(phi) / np.cos(delta)
            top = np.where(np.abs(turn) < 1, np.arcsin(np.clip(turn, -1, 1)), 9.0)[:, None]
            widest = np.arcsin(np.clip(np.sin(delta) / np.maximum(np.cos(phi), 1e-15), 0, 1))[:, None]
            outer = np.where((edge[0][None, :] <= top) & (top <= edge[1][None, :]), np.maximum(outer, widest), outer)
            wide = (delta >= 1.57)[:, None]  # a hemisphere or more: every point is tested
            inner, outer = np.where(wide, -1.0, inner), np.where(wide, math.pi, outer)
        i, j = np.nonzero(outer >= 0)
        off, base = self._off(lon)[i], self.full[j] * 1024.0
        wo, wi = np.degrees(outer[i, j]) + 1e-5, np.degrees(inner[i, j]) - 1e-5
        rows, ends = [], []
        for shift in (-360.0, 0.0, 360.0):
            x = off + shift
            fits = (x - wo <= 180) & (x + wo >= -180)
            whole = wo >= 180
            fits = np.where(whole, shift == 0, fits)
            k = np.flatnonzero(fits)
            if not len(k):
                continue
            b, c = base[k], x[k]
            o = np.where(whole[k], 400.0, wo[k])
            sure = np.where(wi[k] >= 179.9, 400.0, wi[k])
            find = lambda v, side: np.searchsorted(self.key, b + np.clip(v, -500, 500), side)
            first, last = find(np.where(whole[k], -400.0, c - o), "left"), find(np.where(whole[k], 400.0, c + o), "right")
            # Where the outer interval is the whole band the inner one may reach round it: its points are tested then.
            none = (sure < 0) | (whole[k] & (sure < 400))
            left, right = find(np.where(sure >= 400, -400.0, c - sure), "left"), find(np.where(sure >= 400, 400.0, c + sure), "right")
            left, right = np.where(none, last, left), np.where(none, last, right)
            rows.append(i[k])
            ends.append(np.stack([first, np.clip(left, first, last), np.clip(right, first, last), last]))
        return (np.concatenate(rows), np.concatenate(ends, 1)) if rows else (np.zeros(0, np.int64), np.zeros((4, 0), np.int64))

    def _tested(self, lat: np.ndarray, lon: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray, most: int = 1 << 20):
        """Left row and distance of each point of the ranges, in pieces."""
        some = last > first
        rows, first, size = rows[some], first[some], (last - first)[some]
        upto = np.cumsum(size)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            n = size[at:to]
            j = np.repeat(first[at:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            i = np.repeat(rows[at:to], n)
            h = np.sin(np.radians(self.lat[j] - lat[i]) / 2) ** 2 + np.cos(np.radians(lat[i])) * np.cos(np.radians(self.lat[j])) * np.sin(np.radians(self.lon[j] - lon[i]) / 2) ** 2
            yield i, 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
            at = to

    def count(self, lat: np.ndarray, lon: np.ndarray, metres: float) -> np.ndarray:
        rows, (a, b, c, d) = self._intervals(lat, lon, np.full(len(lat), metres))
        n = np.bincount(rows, c - b, len(lat)).astype(np.int64)
        for first, last in ((a, b), (c, d)):
            for i, far in self._tested(lat, lon, rows, first, last):
                n += np.bincount(i[far <= metres], minlength=len(lat))
        return n

    def nearest(self, lat: np.ndarray, lon: np.ndarray, metres: float) -> np.ndarray:
        """The least distance, of points that have one within ``metres``."""
        best, todo, radius = np.full(len(lat), np.inf), np.arange(len(lat)), metres / 64
        while len(todo):
            rows, (a, _, _, d) = self._intervals(lat[todo], lon[todo], np.full(len(todo), radius))
            for i, far in self._tested(lat[todo], lon[todo], rows, a, d):
                np.minimum.at(best, todo[i], far)
            if radius >= metres:
                break
            todo, radius = todo[best[todo] > radius], min(2 * radius, metres)
        return best


def point_in_polygon(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, inside) of points (key, anchor, lat, lon): in any ring of the anchor's polygon, by ray casting.

    ``edges`` has (anchor, ring, x1, y1, x2, y2); points whose anchor has no polygon get null.
    """
    e = edges.withColumnRenamed("anchor", "_anchor")
    joined = points.join(e, points["anchor"] == e["_anchor"], "left")
    cross = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (
        F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    )
    rings = joined.groupBy(key, "ring").agg((F.sum(F.coalesce(cross, F.lit(False)).cast("int")) % 2 == 1).alias("odd"))
    return rings.groupBy(key).agg(F.bool_or(F.when(F.col("ring").isNotNull(), F.col("odd"))).alias("inside"))


def polygon_tag(points: DataFrame, edges: DataFrame, key: str, cell: float = 5.0) -> DataFrame:
    """(key, inside) of points (key, lat, lon): whether any polygon of ``edges`` (as in ``point_in_polygon``) holds the point.

    A polygon is joined only with the points in the grid cells of its bounding box.
    """
    box = edges.groupBy("anchor").agg(*[f(x).alias(n) for n, f, x in (("x0", F.min, F.least("x1", "x2")), ("xn", F.max, F.greatest("x1", "x2")), ("y0", F.min, F.least("y1", "y2")), ("yn", F.max, F.greatest("y1", "y2")))])
    at = lambda c: F.floor(F.col(c) / cell)
    cells = box.select("anchor", F.explode(F.sequence(at("x0"), at("xn"))).alias("cx"), F.sequence(at("y0"), at("yn")).alias("ys")).select("anchor", "cx", F.explode("ys").alias("cy"))
    near = points.where("lat is not null and lon is not null").withColumn("cx", at("lon")).withColumn("cy", at("lat")).join(cells, ["cx", "cy"])
    pair = near.select(F.struct(key, "anchor").alias("pair"), "anchor", "lat", "lon")
    hits = point_in_polygon(pair, edges, "pair").where("inside").select(F.col("pair")[key].alias(key)).distinct().withColumn("hit", F.lit(True))
    return points.select(key).join(hits, key, "left").select(key, F.coalesce("hit", F.lit(False)).alias("inside"))


def assemble_rings(members: DataFrame) -> DataFrame:
    """(relation, ring, points) from ways (relation, way, role, points array<struct<x,y>>).

    Ways of role ``outer`` or empty are chained by their end points in either direction; chains that
    don't close, or have fewer than four points, are dropped.  One relation is handled at a time.
    """

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        ways = [[(p["x"], p["y"]) for p in w] for w in pdf.sort_values("way")["points"] if len(w) > 1]
        rings = []
        while ways:
            ring = ways.pop(0)
            while ring[0] != ring[-1]:
                for i, w in enumerate(ways):
                    if w[0] == ring[-1]:
                        ring = ring + w[1:]
                    elif w[-1] == ring[-1]:
                        ring = ring + w[-2::-1]
                    elif w[-1] == ring[0]:
                        ring = w[:-1] + ring
                    elif w[0] == ring[0]:
                        ring = w[:0:-1] + ring
                    else:
                        continue
                    ways.pop(i)
                    break
                else:
                    break
            if ring[0] == ring[-1] and len(ring) >= 4:
                rings.append(ring)
        return pd.DataFrame({
            "relation": [pdf["relation"].iloc[0]] * len(rings), "ring": range(len(rings)),
            "points": [[{"x": x, "y": y} for x, y in r] for r in rings],
        })

    wanted = members.where("coalesce(role, '') in ('', 'outer')")
    return wanted.groupBy("relation").applyInPandas(chained, "relation long, ring long, points array<struct<x: double, y: double>>")
