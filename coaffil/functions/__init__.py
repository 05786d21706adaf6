"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance; the root's argument is clipped to [0, 1]; null if a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, whatever the partitioning."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def split_multivalue(c: Column) -> Column:
    """Parts of a comma-joined list, trimmed, blanks dropped; null gives the empty array."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def parse_bool(c: Column) -> Column:
    """True for true, t and 1 in any case and padding; anything else, null included, is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "t", "1"), F.lit(False))


def wkt_point(c: Column) -> Column:
    """struct(lon, lat) of ``Point(lon lat)``; null where it can't be parsed."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    pattern = rf"^Point\({number} {number}\)$"
    lon, lat = (F.regexp_extract(c, pattern, k).try_cast("double") for k in (1, 2))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def uri_tail(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def label_fallback(labels: Column, ident: Column, langs: tuple[str, ...] = ("en", "de", "fr", "ja", "zh")) -> Column:
    """The first label there is in the order of ``langs``, else the id itself."""
    return F.coalesce(*[F.try_element_at(labels, F.lit(k)) for k in langs], ident)


def coord_key(lat: Column, lon: Column, places: int = 4) -> Column:
    """Bucket key: both coordinates rounded half-even, joined by an underscore."""
    return F.concat_ws("_", *[F.format_string(f"%.{places}f", F.bround(x, places)) for x in (lat, lon)])


def keyword_flag(c: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the value, whatever the case; null is false."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(c), F.lit(w.lower()))
    return F.coalesce(hit, F.lit(False))


def regex_flag(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def asymmetric_trust(precise: Column, rough: Column) -> Column:
    """A precise yes wins; a precise no or null leaves the rough verdict."""
    return F.when(precise, F.lit(True)).otherwise(rough)


def log_effect_removed(ratio: Column, base: Column) -> Column:
    return F.when(base != 1, 1 - F.log(ratio) / F.log(base))
