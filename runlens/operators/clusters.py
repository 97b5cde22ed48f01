"""Connected components of links between names, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.streaming.ingest import state_folder


def connected(links: DataFrame) -> DataFrame:
    """node, component: the least node that links (a, b) reach, for every linked node.

    Every round each node takes the least label of its neighbours and then its label's own label, so the distance a
    label travels doubles. Rounds are written to the shared folder; a round without a change ends it.
    """
    spark, folder = links.sparkSession, state_folder(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both.write.parquet(f"{folder}/links")
    both = spark.read.parquet(f"{folder}/links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component"))
    number = 0
    while True:
        labels.write.parquet(f"{folder}/round-{number}")
        labels = spark.read.parquet(f"{folder}/round-{number}")
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("mid"))
        own = labels.select(F.col("node").alias("mid"), F.col("component").alias("own"))
        moved = stepped.join(own, "mid", "left").select("node", "was", F.least("mid", F.coalesce("own", "mid")).alias("component"))
        if moved.where("was <> component").isEmpty():
            return labels
        labels, number = moved.select("node", "component"), number + 1
