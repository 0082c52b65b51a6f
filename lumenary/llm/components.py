"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import checkpointed


#: Parts that the rows of one node are dealt to where they look something up.
SALTS = 16


def _looked_up(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` with what ``table`` has for their ``key``; rows of one key go to several tasks, by ``by``."""
    every = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(every, [key, "salt"], how).drop("salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (long) of every linked node; a component's name is its least node.

    Each round points every node to its least neighbour (or itself), follows the pointers to their
    ends by doubling, and replaces linked nodes by what they point to. A star and a rising path
    collapse in one round, and in any other only local minima are left. Links and labels stay
    distributed, and a node that very many point to is dealt to several tasks; every round is
    written to the shared checkpoint folder. An empty table has no components.
    """
    links = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b")
    links = checkpointed(links.distinct())
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    steps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))
        step = checkpointed(step)
        while True:  # every node to its root, twice as far each time
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("root"))
            moved = _looked_up(step, onward, "to", "node").select("node", F.col("root").alias("to"), (F.col("to") != F.col("root")).alias("moved"))
            moved = checkpointed(moved)
            step = moved.select("node", "to")
            if moved.filter("moved").isEmpty():
                break
        steps.append(step)
        left, right = (step.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        ends_of = _looked_up(_looked_up(links, left, "a", "b"), right, "b", "a").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        links = checkpointed(ends_of.filter("a < b").distinct())
    labels = ends.withColumn("component", F.col("node"))
    for step in steps:
        named = step.select(F.col("node").alias("component"), "to")
        labels = _looked_up(labels, named, "component", "node", "left").select("node", F.coalesce("to", "component").alias("component"))
    return checkpointed(labels)
