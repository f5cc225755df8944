"""Cutting lineage in storage that every executor shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import shared_folder


#: Rows that a Python worker is handed at once at most.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Has Python workers of this session handed fewer rows at once, as a row here is a whole text; it stays so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def checkpoint(frame: DataFrame) -> DataFrame:
    """frame, computed once and kept in the shared folder; a lost executor loses none of it."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """frame, written as Parquet in folder, or else in the shared folder, and read again.

    It stays there, as other jobs may read it; cleaning the shared folder is up to its owner.
    """
    spark = frame.sparkSession
    folder = folder or shared_folder(spark)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spare_name(frame: DataFrame, name: str) -> str:
    """name, lengthened until frame has no column of that name."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
