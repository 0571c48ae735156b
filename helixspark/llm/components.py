"""Connected components of a table of links, by smallest labels and pointer jumping; every round is written to the shared folder.

Rows that meet at one vertex are dealt over parts where they are many: the links of a vertex, and the vertices that have one label.
Null ends and links of a vertex to itself are left out; repeated links count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged

#: Links of one vertex that one part holds, and parts of one label.
DEALT, SALTS = 4096, 16


def components(links: DataFrame) -> DataFrame:
    """links: a, b longs. Returns v, comp for each vertex in links; comp is the smallest vertex of the component."""
    links = links.filter("a <> b")
    edges = links.select("a", "b").union(links.select("b", "a")).distinct()
    hot = edges.groupBy(F.col("b").alias("hot")).agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts")).filter("parts > 1")
    hot = staged(hot, "components-hot")
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
    edges = staged(edges.join(hot, F.col("b") == F.col("hot"), "left").select("a", "b", part.alias("part")), "components-edges")
    labels = staged(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "components-0")
    while True:
        there = labels.join(hot, F.col("v") == F.col("hot"), "left").select(F.col("v").alias("b"), "comp", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")).alias("part"))
        around = edges.join(there, ["b", "part"]).groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        lower = labels.join(around, "v").select("v", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        # A vertex takes the label of its label. Labels that are their own are no news, and what labels no other vertex isn't asked for; both stay out of the join.
        moved = labels.filter("comp < v").select(F.col("v").alias("comp"), F.col("comp").alias("beyond"))
        jump = moved.join(labels.select("comp").distinct(), "comp").select("comp", "beyond", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        lower = lower.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        step = staged(lower.join(jump, ["comp", "salt"], "left").select("v", F.least("comp", "beyond").alias("comp"), "was"), "components-step")
        release(labels)
        labels = step.select("v", "comp")
        labels._staged = step._staged
        if step.filter("comp <> was").isEmpty():
            release(edges, hot)
            return labels
