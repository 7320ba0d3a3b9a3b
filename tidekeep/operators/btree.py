"""The page directory of a static B-tree over a run: leaves, internal levels and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FANOUT, LEAF_PAIRS
from .ranks import with_rank


def with_page(pairs: DataFrame, leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """Pairs with the leaf page that they stand in."""
    return with_rank(pairs).withColumn("page", F.floor(F.col("rank") / leaf_pairs).cast("int")).drop("rank")


def leaf_pages(pairs: DataFrame, leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """(page, min_key, max_key, num_pairs) of every leaf; only the last may be partial."""
    return with_page(pairs, leaf_pairs).groupBy("page").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("num_pairs"))


def internal_levels(pairs: DataFrame, leaf_pairs: int = LEAF_PAIRS, fanout: int = FANOUT) -> DataFrame:
    """(level, node, max_key): leaves are level 0, and every `fanout` nodes have one above, up to a single root.

    Every leaf names its ancestors by arithmetic on its number, so that all levels are one
    aggregate over the leaves.  How many levels there are follows from a count.
    """
    leaves, height = -(-pairs.count() // leaf_pairs), 0
    while -(-leaves // fanout**height) > 1:
        height += 1
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(height)), lambda k: F.struct(k.alias("level"), F.floor(F.col("page") / F.pow(F.lit(float(fanout)), k)).cast("int").alias("node"))))
    named = leaf_pages(pairs, leaf_pairs).select("max_key", above.alias("n"))
    return named.groupBy("n.level", "n.node").agg(F.max("max_key").alias("max_key")).select("level", "node", "max_key")


def separators(pairs: DataFrame, leaf_pairs: int = LEAF_PAIRS, fanout: int = FANOUT) -> DataFrame:
    """(level, node, keys): what an internal node stores, the maxima of its children but the last, whose maximum moves up."""
    every = internal_levels(pairs, leaf_pairs, fanout)
    children = every.select((F.col("level") + 1).alias("level"), F.floor(F.col("node") / fanout).cast("int").alias("parent"), "node", "max_key")
    ordered = F.array_sort(F.collect_list(F.struct("node", "max_key")))  # at most `fanout` children
    kept = children.groupBy("level", F.col("parent").alias("node")).agg(ordered.alias("c")).select("level", "node", F.transform(F.slice("c", 1, F.size("c") - 1), lambda x: x["max_key"]).alias("keys"))
    return kept.join(every.where("level > 0").select("level", "node"), ["level", "node"], "left_semi")


def route(pairs: DataFrame, probes: DataFrame, leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """(key, page): the first leaf whose maximum reaches the key, null beyond the last.

    An as-of join by position: a key belongs to the page of its successor among the stored
    keys, found by merging probes with page maxima in key order, bucket by bucket.
    """
    pages = leaf_pages(pairs, leaf_pairs).select("page", "max_key")
    pages = pages.join(pages.select((F.col("page") + 1).alias("page"), F.col("max_key").alias("before")), "page", "left")
    span = pairs.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).first()
    width = max(1, (span.hi - span.lo + 1) * leaf_pairs // max(span.n, 1)) if span.n else 1
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    low = F.coalesce(F.col("before").cast("long") + 1, F.lit(span.lo if span.n else 0).cast("long"))
    zones = pages.select("page", "max_key", low.alias("low"), F.explode(F.sequence(cell(low), cell(F.col("max_key")))).alias("cell"))
    # a key under the least stored one goes to the first page
    asked = probes.select("key", F.greatest(F.col("key"), F.lit(span.lo if span.n else 0)).cast("long").alias("at")).withColumn("cell", cell(F.col("at")))
    hit = (asked.cell == zones.cell) & (asked["at"] >= zones.low) & (asked["at"] <= zones.max_key)
    return asked.join(zones, hit, "left").select("key", "page")


def leaf_search(pairs: DataFrame, probes: DataFrame, leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """(key, page, value): the leaf that a key is routed to, and its value there; null if the leaf lacks it."""
    stored = with_page(pairs, leaf_pairs).select("page", "key", "value")
    return route(pairs, probes, leaf_pairs).join(stored, ["page", "key"], "left").select("key", "page", "value")


def page_locality(pairs: DataFrame, keys: DataFrame, leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """(page, keys_hit): leaves that a set of stored keys touches."""
    return with_page(pairs, leaf_pairs).join(keys.select("key").distinct(), "key", "left_semi").groupBy("page").agg(F.count("*").alias("keys_hit"))
