"""Results that are computed once and end their plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> bool:
    """Whether the session has a checkpoint folder; sets the one of ``spark.checkpoint.dir``, or a temporary one of a local session."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        local = sc.master.startswith("local") and "cluster" not in sc.master
        folder = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp() if local else None)
        if folder:
            sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().isDefined()


def kept(df: DataFrame) -> DataFrame:
    """``df``, written to the shared checkpoint folder and read from there; where there is none, persisted."""
    if checkpoint_folder(df.sparkSession):
        return df.checkpoint()
    df = df.persist()
    df.count()
    return df


def stored(df: DataFrame) -> DataFrame:
    """``df`` as ``kept``, but as Parquet: compressed, and read by column; where there is no folder, persisted."""
    if not checkpoint_folder(df.sparkSession):
        return kept(df)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
