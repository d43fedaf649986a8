"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, stored


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node reached.

    Large-star and small-star steps alternate until no link changes; each round is a grouped minimum and a join,
    written to the shared folder, and their number grows with the logarithm of the longest chain.
    """
    digest = lambda t: t.selectExpr("count(*) as n", "sum(cast(xxhash64(u, v) as decimal(38, 0))) as h").first()
    now = stored(links.filter("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), "links")
    seen = digest(now)
    while seen["n"]:
        both = now.unionByName(now.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(least, "u").filter("v > u").selectExpr("v as u", "m as v").filter("u <> v").distinct()
        large = stored(large, "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").selectExpr("v as u", "m as v").unionByName(least.selectExpr("u", "m as v")).distinct()
        small = stored(small, "links-small")
        discard(now, large)
        now, before, seen = small, seen, digest(small)
        if before == seen:
            break
    nodes = now.selectExpr("u as node", "v as component")
    return nodes.unionByName(now.selectExpr("v as node", "v as component").distinct())
