"""Tables that cut a long lineage: Parquet under the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written under spark.checkpoint.dir and read back, so that a lost executor costs a reread. Where the setting is unset, under a folder of our own if
    driver and executors are one process; on a cluster that is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tablewright-')}"
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/tablewright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
