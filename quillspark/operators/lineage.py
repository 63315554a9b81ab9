"""Cutting lineage where a plan is used more than once or grows from round to round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the reliable checkpoint folder.

    That is the one the session names in ``spark.checkpoint.dir``; one of our own is set only
    where there is none and the session runs on one machine (tests).
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.getConf().get("spark.checkpoint.dir") and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("on a cluster, name a folder that all machines share in spark.checkpoint.dir")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="quill-"))
    return df.checkpoint(eager=True)
