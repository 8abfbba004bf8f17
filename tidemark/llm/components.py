"""Connected components of a graph of links, by least labels and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import materialise


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node that links (``u``, ``v``, in any direction and
    number) lead to, for every node with a link. Labels are saved after each round."""
    reverse = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = materialise(links.select("u", "v").union(reverse).distinct())
    labels = materialise(both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("least"))
        stepped = labels.join(seen.withColumnRenamed("u", "node"), "node").select(
            "node", "label", F.least("label", "least").alias("next")
        )
        stepped = materialise(stepped)
        parents = stepped.select(F.col("node").alias("next"), F.col("next").alias("above"))
        jumped = stepped.join(parents, "next").select("node", "label", F.col("above").alias("next"))
        jumped = materialise(jumped)
        changed = jumped.filter("next <> label").limit(1).count()
        labels = jumped.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
