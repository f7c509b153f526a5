"""Stores of results and flag events that readers only see in whole writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow import schemas
from complaintflow.plans.reporting import current_flags
from complaintflow.sources.segments import Segments, rows_of


class Committed(Segments):
    """Rows of one schema, appended write by write. A write counts from its commit on, as a whole; until then, and where it
    breaks off, readers see what was there before. A write of a known name replaces the former one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, day: str | None = None):
        super().__init__(spark, path)
        self.schema, self.day = schema, day

    def append(self, name: str, rows: DataFrame) -> None:
        wanted = [f.split()[0] for f in self.schema.split(", ")]
        # a folder of its own for each attempt: what a replaced or broken one left is never read
        folder = f"{name}-{self.version}"
        rows = rows.select(*wanted)
        if self.day:
            rows.withColumn("day", F.to_date(self.day)).write.mode("overwrite").partitionBy("day").parquet(self.folder(folder))
        else:
            rows.write.mode("overwrite").parquet(self.folder(folder))
        self.segments = {n: s for n, s in self.segments.items() if s["write"] != name}
        self.segments[folder] = {"write": name, "rows": rows_of(self.read(self._stored(), [folder])), "version": self.version + 1}
        self.commit()

    def _stored(self) -> str:
        return f"{self.schema}, day date" if self.day else self.schema

    def rows(self, day_from: str | None = None) -> DataFrame:
        """What is committed, optionally from a day on."""
        rows = self.read(self._stored(), list(self.segments))
        if day_from and self.day:
            rows = rows.filter(F.col("day") >= F.lit(day_from).cast("date"))
        return rows.drop("day")


def result_store(spark: SparkSession, path: str) -> Committed:
    return Committed(spark, path, schemas.RESULTS, "analyzed_at")


def flag_store(spark: SparkSession, path: str) -> Committed:
    return Committed(spark, path, schemas.FLAG_EVENTS)


def flags_as_of(events: DataFrame, moment: str | None = None) -> DataFrame:
    """The current flag of each result, optionally as it was at a moment."""
    return current_flags(events if moment is None else events.filter(F.col("flagged_at") <= F.lit(moment).cast("timestamp_ntz")))
