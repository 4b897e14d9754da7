"""Connected components of a link table by rounds of contraction.

In each round every node hooks on to the smallest of itself and its neighbours, one pointer jump shortens the chains, and the links are redrawn
between what is left.  A round is a few joins on written tables; nothing is gathered in one place, and links to one hub are counted down
before they are shuffled.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Written


def components(links: DataFrame, written: Written, max_rounds=60) -> DataFrame:
    """``node, label`` of every node in ``links`` (``a, b``, any order, repeats and loops allowed); equal labels mean connected."""
    edges = written.table(_both_ways(links.select("a", "b")))
    mapped = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            return mapped if mapped is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        hooked = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
        hooked = written.table(hooked)
        jump = hooked.select(F.col("node").alias("via"), F.col("label").alias("end"))
        parents = written.table(hooked.join(jump, F.col("label") == F.col("via")).select("node", F.col("end").alias("label")))
        if mapped is None:
            now = parents
        else:
            step = parents.select(F.col("node").alias("via"), F.col("label").alias("end"))
            now = written.table(mapped.join(step, F.col("label") == F.col("via"), "left").select("node", F.coalesce("end", "label").alias("label")))
        left, right = (parents.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b"))
        redrawn = edges.join(left, "a").select("a_label", "b").distinct().join(right, "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        following = written.table(redrawn.filter("a <> b").distinct())
        used = [edges, hooked] + ([mapped, parents] if mapped is not None else [])
        written.drop(*used)
        edges, mapped = following, now
    raise ValueError("the components did not settle")


def _both_ways(links: DataFrame) -> DataFrame:
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.unionAll(back).filter("a <> b").distinct()
