"""Connected components, and cutting lineage where a loop needs it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's ``spark.checkpoint.dir``, which all executors share.

    A temporary folder is made only where that is unset and one process does all
    work; on a cluster a missing setting is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="folkmoot-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (u, v): the least node reachable.

    Labels spread along edges and then jump to their labels' labels, so rounds
    grow with the logarithm of a component's diameter; each is checkpointed.
    """
    both = settle(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label"))
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("heard"))
        near = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        now = settle(near.join(jump, "via").select("node", F.least("via", "far").alias("label"), (F.least("via", "far") != F.col("label")).alias("moved")))
        labels = now.select("node", "label")
        if now.where("moved").isEmpty():
            return labels
