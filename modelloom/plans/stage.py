"""Tables written between the rounds of an iteration, so that plans stay short and a lost executor costs one round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset a local session gets a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="modelloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    path, schema = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
