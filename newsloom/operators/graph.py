"""Connected components on tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Point checkpoints at the session's shared folder; on one machine at a folder of our own where it names none."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="newsloom-"))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table beside the checkpoints. A checkpoint would keep the plan's constraints, which grow from round to round."""
    checkpoint_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has made and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def moves(step: DataFrame) -> DataFrame:
    """c, cc: the labels in use that have a lower label themselves, of nodes (id, c).

    They are few once most nodes have their component's own label, which isn't one of them: Spark then sends them to the
    nodes, and the nodes of a large component need not meet in one task.
    """
    used = step.select(F.col("c").alias("id")).distinct()
    return step.where("id <> c").join(used, "id", "left_semi").select(F.col("id").alias("c"), F.col("c").alias("cc"))


def components(edges: DataFrame) -> DataFrame:
    """id, component: the least id reachable, for each end of the edges (a, b).

    Labels spread along edges and then jump to their label's label, so rounds grow with the logarithm of the diameter.
    Labels only fall, so the rounds end; a node that most edges share sends one row from each task.
    Each round is checkpointed to the shared folder, from where lost executors' parts are read again.
    """
    checkpoint_folder(edges.sparkSession)
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # the edges are made once
    both = edges.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")).checkpoint()
    while True:
        near = both.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "c").alias("c"))
        after = step.join(moves(step), "c", "left").select("id", F.col("component").alias("old"), F.least("c", "cc").alias("component")).checkpoint()
        changed = not after.where("old <> component").isEmpty()
        labels = after.select("id", "component")
        if not changed:
            return labels
