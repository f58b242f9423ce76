"""Connected components by minimum labels with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import discard, materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (src, dst long) to (id, label): the least id each id is linked with.

    Each round takes the least label among neighbours, then the label of that
    label, so chains halve; the loop ends when no label changes. Nothing but
    one flag per round comes to the driver. Ids without an edge are absent.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = materialize(both.where("src <> dst").distinct())
    labels = materialize(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("label"), F.lit(True).alias("moved")))
    for _ in range(rounds):
        if labels.where("moved").isEmpty():
            break
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = labels.select("id", F.col("label").alias("was")).join(near, "id").select("id", "was", F.least("was", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        step = step.join(up, "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "was")
        new = materialize(step.select("id", "label", (F.col("label") < F.col("was")).alias("moved")))
        discard(labels)
        labels = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("id", "label")
