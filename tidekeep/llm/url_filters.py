"""URL filters: which captures were on a dated list when they were fetched.

List entries are dated additions and removals of domains and URL prefixes.  They become
validity intervals [from, to) for each list and pattern; a capture's URL is spread to the
patterns that could cover it (its host's parent domains and its path's leading segments),
and an as-of join finds the intervals that hold at its fetch time.

All of it is DataFrame expressions.  The as-of join is an equality of patterns with the
fetch time inside the interval as a condition of the join itself: the intervals of a list
and pattern don't overlap, so that at most one of them holds, and no group of intervals or
captures is gathered in memory.  A host with a third of all captures is dealt over `SALTS`
tasks, for which the list is repeated.

Null URLs, fetch times or unparsable hosts match nothing.  Entries without pattern, date or
known action are ignored; of several on one instant, removals come last.  A pattern covers
itself and what is below it, on label and segment borders only.  Host names are compared in
lower case; scheme, user, port, query and fragment don't count.  Repeated captures keep a
row each, and other columns of captures are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host, '' if there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) from entries (list, kind, pattern, action, at).

    kind is `domain` or `prefix`, action `add` or `remove`.  An addition of what is there,
    like a removal of what isn't, changes nothing.  valid_to is null while nothing ends it.
    """
    known = entries.where(F.col("kind").isin("domain", "prefix") & F.col("action").isin("add", "remove") & F.col("pattern").isNotNull() & F.col("at").isNotNull())
    host, path = (F.regexp_extract("pattern", r"(?s)^([^/]*)(.*)$", k) for k in (1, 2))
    known = known.withColumn("pattern", F.concat(F.lower(host), path))  # as host_of does
    own = Window.partitionBy("list", "kind", "pattern").orderBy("at", "action")
    changes = known.withColumn("before", F.lag("action").over(own)).where(F.coalesce(F.col("before"), F.lit("remove")) != F.col("action"))
    spans = changes.withColumn("valid_to", F.lead("at").over(own)).where("action = 'add'")
    return spans.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at"))).select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def _patterns(url: Column) -> Column:
    """What could cover the URL: (kind, pattern) of parent domains and path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("pattern")))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), k), "/")).alias("pattern"))
    )
    none = F.slice(domains, 1, 0)
    return F.when(host == "", none).otherwise(F.concat(domains, F.when(F.size(steps) > 0, prefixes).otherwise(none)))


def matches(captures: DataFrame, intervals: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """(key, url, at, list, kind, pattern, valid_from) of every interval that holds for a capture at its fetch time."""
    asked = captures.where(F.col(url).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(at).alias("_at"), F.explode(_patterns(F.col(url))).alias("_p"))
    asked = asked.select("_key", "_url", "_at", F.col("_p.kind").alias("kind"), F.col("_p.pattern").alias("pattern"), F.pmod(F.xxhash64("_key", "_at"), F.lit(SALTS)).cast("int").alias("salt"))
    listed = intervals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (asked["kind"] == listed["kind"]) & (asked["pattern"] == listed["pattern"]) & (asked["salt"] == listed["salt"])
    holds = (listed["valid_from"] <= F.col("_at")) & (listed["valid_to"].isNull() | (F.col("_at") < listed["valid_to"]))
    found = asked.join(listed, same & holds)
    return found.select(F.col("_key").alias(key), F.col("_url").alias(url), F.col("_at").alias(at), listed["list"], listed["kind"], listed["pattern"], listed["valid_from"])


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """One row per capture: key, url, at, blocked, number of intervals that hold, first matching pattern by name and its list."""
    own = [key, url, at]
    found = matches(captures, validity_intervals(entries), key, url, at)
    hits = found.select(*own, F.lit(1).alias("_hit"), F.lit(0).alias("_row"), F.struct("pattern", "list").alias("_first"))
    every = captures.select(*own, F.lit(0).alias("_hit"), F.lit(1).alias("_row"), F.lit(None).cast(hits.schema["_first"].dataType).alias("_first"))
    summed = every.unionByName(hits).groupBy(*own).agg(F.sum("_hit").alias("_hits"), F.sum("_row").alias("_rows"), F.min("_first").alias("_first"))
    # each of several equal captures has all the hits
    each = summed.withColumn("n_matches", F.expr("_hits div _rows")).withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return each.select(*own, (F.col("n_matches") > 0).alias("blocked"), "n_matches", F.col("_first.pattern").alias("pattern"), F.col("_first.list").alias("list"))
