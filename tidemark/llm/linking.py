"""Groups of similar items from shared buckets, without all pairs of a bucket.

Items meet in buckets. First each item is compared with its bucket's head alone, the one that
meets most others; verified links join items into groups. A CROWDED bucket has a head for each class
of sizes, and its items are compared with the heads of their own class and the next ones. Only items that share a
bucket and still are in different groups are then compared with each other, so a large group of alike
items costs a few comparisons each rather than one for each pair. All of these are compared, whatever the
bucket's size: what CROWDED decides is which comparisons come first, not which items are linked.

Groups are connected components by alternating large and small stars, in Spark's own operators:
edges shrink towards stars around each component's least item, a few rounds of two aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import broadcast_up_to, materialize

#: Rounds after which components must be stars; each round at least halves a path.
MAX_ROUNDS = 60
#: Items of a bucket from which on it has a head for each class of sizes, and the ratio of sizes of one class.
CROWDED, CLASS = 256, 1.12
#: Buckets of more than two items are broadcast up to so many (a key and a count each).
BROADCAST_BUCKETS = 1_000_000


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (u, v); root is the least node that can be reached."""
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    state = _state(now)
    if not state[0]:
        return _stars(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each item's smaller neighbours, and itself, go to the least of them
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        head = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(head, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(head.select("u", F.col("m").alias("v")))
        now = materialize(small.filter("u <> v").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return _stars(now)


def _stars(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def link(members: DataFrame, keys: list[str], near: Callable[[DataFrame], DataFrame], possible: Callable[[str, str], Column], payload: list[str], *, alone: dict[str, Column], couple: str, before: str | None = None, extra: DataFrame | None = None, bound: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(node, root) of all items that ``near`` links to another.

    ``members`` has ``keys`` (the bucket), ``id`` and ``payload`` columns, the first of which is the
    item's size. ``possible(a, b)`` is a condition on the payload, prefixed a_ and b_, that all links meet;
    ``near`` keeps those rows of a frame of distinct (a, b) that are links. Of a bucket of two the
    aggregates ``alone`` are enough to tell by ``couple`` whether they can be linked, so only larger
    buckets are joined with their members again, unless members bring the ``size`` of their bucket. Where the column
    ``before`` of two items is equal and not null, they share another bucket, too, and are compared there.
    ``extra`` (id, extra) is one more payload column for those items that are still to be compared across groups,
    and ``bound`` a condition on it.
    """
    ends = {"lo": F.min("id"), "hi": F.max("id"), **alone}
    if "size" in members.columns:
        shared = members.filter("size = 2").groupBy(*keys).agg(*(c.alias(k) for k, c in ends.items())).filter(f"lo <> hi and ({couple})")
        couples = shared.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        held = members.filter("size > 2")
    else:
        size = members.groupBy(*keys).agg(F.count("*").alias("size"), *(c.alias(k) for k, c in ends.items()))
        shared = materialize(size.filter(f"size > 2 or size = 2 and lo <> hi and ({couple})").select(*keys, "size", "lo", "hi"), "shared")
        couples = shared.filter("size = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        many = shared.filter("size > 2").select(*keys, "size")
        held = materialize(members.join(broadcast_up_to(many, BROADCAST_BUCKETS), keys), "buckets")
    # an item that meets more others is nearer to the middle of its group
    degree = held.groupBy("id").agg(F.sum(F.col("size") - 1).alias("degree"))
    crowd = F.col("size") > CROWDED
    part = F.when(crowd, F.floor(F.log(F.greatest(F.col(payload[0]), F.lit(1))) / math.log(CLASS))).otherwise(F.lit(0)).cast("int")
    placed = held.withColumn("part", part)
    heads = placed.join(degree, "id").groupBy(*keys, "part").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), *payload)).alias("head"))
    heads = heads.select(*keys, "part", (-F.col("head.minus")).alias("a"), *(F.col(f"head.{p}").alias(f"a_{p}") for p in payload))
    parts = F.explode(F.when(crowd, F.array(F.col("part") - 1, "part", F.col("part") + 1)).otherwise(F.array("part"))).alias("part")
    stars = placed.select(*keys, F.col("id").alias("b"), *(F.col(p).alias(f"b_{p}") for p in payload), parts)
    stars = stars.join(heads, [*keys, "part"]).filter("a <> b").filter(possible("a", "b"))
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(couples)
    stars = materialize(stars.distinct(), "stars")
    first = materialize(near(stars), "links")
    groups = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
    marked = held.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = marked.groupBy(*keys).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select(*keys)
    told = [] if before is None else [before]
    apart = marked.join(mixed, keys, "left_semi").select("id", "root", *payload, *told, *keys)
    apart = materialize(apart, "open")
    if extra is not None:
        apart = apart.join(extra, "id")
        payload = [*payload, "extra"]
    payload = [*payload, *told]
    one = apart.select(*keys, F.col("id").alias("a"), F.col("root").alias("a_root"), *(F.col(p).alias(f"a_{p}") for p in payload))
    two = apart.select(*keys, F.col("id").alias("b"), F.col("root").alias("b_root"), *(F.col(p).alias(f"b_{p}") for p in payload))
    meets = possible("a", "b") & bound("a", "b") if bound else possible("a", "b")
    if before is not None:
        meets = meets & ~F.coalesce(F.col(f"a_{before}") == F.col(f"b_{before}"), F.lit(False))
    across = one.join(two, keys).filter("a < b and a_root <> b_root").filter(meets).select("a", "b").distinct()
    across = materialize(across.join(stars, ["a", "b"], "left_anti"), "across")
    if across.isEmpty():
        return groups
    second = materialize(near(across), "links")
    if second.isEmpty():
        return groups
    return components(first.unionByName(second).select(F.col("a").alias("u"), F.col("b").alias("v")))
