"""New recordings as they arrive: a file stream whose finished ids are left out, and failed ones come again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_new(spark: SparkSession, folder: str, done: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], schema: str = "recording string, body string"):
    """Start a query over JSON files that arrive in folder: each batch's recordings that the table at `done` lacks are parsed
    (parse gives rows with a column recording) and added to it. Recordings that parse drops aren't added, so they are
    parsed again when they come again; a batch that is run twice adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["recording"])
        try:
            new = new.join(spark.read.parquet(done).select("recording"), "recording", "left_anti")
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        parse(new).write.mode("append").parquet(done)

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by order, of equal ones that with the greatest other columns, so that a rebuild gives the same rows."""
    rest = sorted(c for c in table.columns if c not in (key, order))
    return table.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x")).select(key, "x.*")
