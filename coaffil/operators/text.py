"""Text and nested-record operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import checkpointed

#: Words that mark the institution's part of an address; fixed values.
INSTITUTION_WORDS = ["univ", "institut", "college", "laborator", "centre", "center", "school", "hospital", "academ"]
#: Rows of a level of a closure that are broadcast, 16 bytes each.
SMALL_LEVEL = 1 << 16


def flatten_nested(works: DataFrame) -> DataFrame:
    """One row per work, authorship and raw string, of nested works.

    The single raw string is appended to the list where the list lacks it; an authorship without any
    string gives one row of null, and so does a work without authorships.  Countries drop nulls.
    """
    a = works.select("id", F.explode_outer("authorships").alias("a"))
    raws = F.coalesce(F.col("a.raws"), F.array().cast("array<string>"))
    single = F.col("a.raw")
    raws = F.when(single.isNotNull() & ~F.coalesce(F.array_contains(raws, single), F.lit(False)), F.array_append(raws, single)).otherwise(raws)
    flat = a.select("id", F.col("a.author").alias("author"), F.explode_outer(raws).alias("raw"), F.col("a.institutions").alias("i"))
    return flat.select(
        "id", "author", "raw",
        F.array_join(F.transform("i", lambda x: x["name"]), ", ").alias("institutions"),
        F.array_join(F.filter(F.transform("i", lambda x: x["country"]), lambda c: c.isNotNull()), ", ").alias("countries"),
    )


def address_variants(address: Column) -> Column:
    """Ordered distinct variants of an address, from the whole to its last parts.

    The address; without footnote digits before its first letter; without e-mail parts; from the last
    comma part that names an institution, if not the first; the last three parts; the last two, if
    there are more.
    """
    plain = F.regexp_replace(address, r"^\s*[0-9]+\s*(\p{L})", "$1")
    bare = F.regexp_replace(F.regexp_replace(plain, r"(?i)electronic address:.*$", ""), r"\S+@\S+", "")
    bare = F.regexp_replace(bare, r"^[ .;,]+|[ .;,]+$", "")
    parts = F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda p: p != "")
    named = F.transform(parts, lambda p: p.rlike("(?i)" + "|".join(INSTITUTION_WORDS)))
    n = F.size(parts)
    back = F.array_position(F.reverse(named), True)  # from the end, 0: none
    at = n - back + 1
    from_name = F.when((back > 0) & (at > 1), F.array_join(F.slice(parts, at.cast("int"), n), ", "))
    last = lambda k: F.when(n > k, F.array_join(F.slice(parts, -k, k), ", "))
    return F.array_distinct(F.filter(F.array(address, plain, bare, from_name, last(3), last(2)), lambda v: v.isNotNull() & (v != "")))


def results_flat(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide table of a long one (spec, metric, value); a missing metric is null."""
    return results.groupBy("spec").pivot("metric", metrics).agg(F.max("value"))


def new_keys(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``batch`` that ``done`` lacks; null keys are left out."""
    return batch.where(F.col(key).isNotNull()).select(key).distinct().join(done.select(key), key, "left_anti")


def closure(children: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth): ``roots`` (id) at depth 0, and the rows of ``children`` (id, parent) under them, level by level until one is empty.

    Rows that repeat count as often as they do in a recursive union; there is no limit of rows or
    levels.  The parents must not form a cycle.
    """
    # Landed, so that Catalyst doesn't carry each level's conditions on into the next one's.
    children = checkpointed(children.select("id", "parent"))
    level = checkpointed(roots.select("id", F.lit(0).cast("long").alias("depth")))
    found = level
    while n := level.count():
        above = level.select(F.col("id").alias("parent"), "depth")
        above = F.broadcast(above) if n <= SMALL_LEVEL else above
        level = checkpointed(children.join(above, "parent").select("id", (F.col("depth") + 1).alias("depth")))
        found = found.unionByName(level)
    return found
