"""A model store that is replaced as one.

Each training writes a folder of its own; the manifest, a table of one row for each finished training,
gets its row last, by one append that Spark commits as a whole.  Readers take the folder of the newest
row, so a training that ended half-way is never read, and one that is being written changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "sequence long, folder string, finished timestamp"


def manifest(spark: SparkSession, model_dir: str) -> DataFrame:
    """The finished trainings of a store; raises where there is no store."""
    return spark.read.schema(_MANIFEST).json(f"{model_dir.rstrip('/')}/manifest")


def publish(spark: SparkSession, model_dir: str, write: Callable[[str], None]) -> str:
    """Lets ``write`` fill a new folder and makes it the store's newest; one writer at a time."""
    folder = f"versions/{uuid.uuid4().hex}"
    write(f"{model_dir.rstrip('/')}/{folder}")
    try:
        last = manifest(spark, model_dir).agg(F.max("sequence")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = 0
    row = spark.createDataFrame([(last + 1, folder)], "sequence long, folder string").coalesce(1)
    row.withColumn("finished", F.current_timestamp()).write.mode("append").json(f"{model_dir.rstrip('/')}/manifest")
    return f"{model_dir.rstrip('/')}/{folder}"


def newest(spark: SparkSession, model_dir: str) -> str:
    """The folder of the last finished training."""
    row = manifest(spark, model_dir).orderBy(F.desc("sequence")).first()
    if row is None:
        raise FileNotFoundError(f"no finished training in {model_dir}")
    return f"{model_dir.rstrip('/')}/{row['folder']}"
