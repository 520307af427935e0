"""What operators need from a cluster: a shared checkpoint folder and the package on every executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a single machine (as in tests) gets a temporary folder, and a cluster an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the session's shared checkpoint folder, so that lost executors cost nothing but a read."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared checkpoint folder: smaller than a checkpoint, and later reads take only the columns that they use."""
    path = f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """df with the place (from 1) of each row in an order; sorted over the cluster, with no task that sees all rows.

    The sorted rows are kept, so ties have one order for all readers. Only the
    number of rows of each partition reaches the driver.
    """
    own = name
    while own.lower() in {c.lower() for c in df.columns}:
        own += "_"
    rows = checkpoint(df.orderBy(*order).withColumn(own, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(own), 33)
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    base, first = 0, []
    for p in sorted(sizes):
        first += [F.lit(p), F.lit(base)]
        base += sizes[p]
    if not first:
        return rows
    start = F.element_at(F.create_map(*first), part)
    return rows.withColumn(own, start + F.col(own).bitwiseAND(F.lit((1 << 33) - 1)) + 1)


def ship(spark: SparkSession) -> None:
    """Prepares a session: smaller Arrow batches, and this package importable in Python workers that can't import it themselves (Spark's file server hands a zip to each)."""
    # Batches are bounded by rows of long texts, not of short ones; a setting of the user's own stays.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "spanveil_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
