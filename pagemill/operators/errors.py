"""Errors as a table: what went wrong when, and saving that reports instead of raising."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_dir

SCHEMA = "at timestamp, kind string, message string"


class ErrorLog:
    """A table of errors in a shared folder; writers append, and writing never raises."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.path = spark, f"{folder or shared_dir(spark)}/errors"

    def add(self, kind: str, message: str, at: float | None = None) -> None:
        with suppress(Exception):  # what is logged went wrong already
            row = self.spark.createDataFrame([(at or time.time(), kind, message)], "at double, kind string, message string")
            row.select(F.timestamp_seconds("at").alias("at"), "kind", "message").coalesce(1).write.mode("append").parquet(self.path)

    def add_rows(self, rows: DataFrame) -> None:
        """Append many rows (at, kind, message), written by their tasks."""
        with suppress(Exception):
            rows.select("at", "kind", "message").write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        """All errors so far."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception:  # nothing was ever logged
            return self.spark.createDataFrame([], SCHEMA)

    def save(self, path: str, write: Callable[[str], object], kind: str = "export") -> dict:
        """{saved, path} after write(path); a failure is logged and returned as {saved, error}."""
        try:
            write(path)
        except Exception as problem:
            message = str(problem) or type(problem).__name__
            self.add(kind, message)
            return {"saved": False, "error": message}
        return {"saved": True, "path": path}


def lines(errors: DataFrame) -> DataFrame:
    """(at, line) as a log file has them: [ISO time] kind: message."""
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return errors.select("at", F.concat(F.lit("["), stamp, F.lit("] "), F.concat_ws(": ", "kind", "message")).alias("line"))


def of_fetches(audited: DataFrame, as_of: str) -> DataFrame:
    """(at, kind, message) of pages that could not be fetched."""
    return audited.where("error is not null").select(F.to_timestamp(F.lit(as_of)).alias("at"), F.lit("fetch").alias("kind"), F.concat("error", F.lit(" "), "url").alias("message"))
