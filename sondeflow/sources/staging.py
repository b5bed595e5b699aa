"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Folders of local sessions without the setting, by application.
_OWN: dict[str, str] = {}


def staged(df: DataFrame) -> DataFrame:
    """Write the rows under spark.checkpoint.dir and read them again, so later rounds neither recompute them nor depend on one executor.

    Only a local session without that setting gets a folder of its own. The tables stay until the folder is cleared after the job.
    """
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        app = spark.sparkContext.applicationId
        root = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="sondeflow-"))
    path = f"{root.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
