"""Folders that only grow, and the list of those that count.

A manifest names the segments of a store and is replaced as a whole: it is written into one of two slots in turn, so the
previous one stays until the next is complete, and a reader sees a segment either not at all or whole. One writer at a time.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "segment"


class Segments:
    """The segments below ``path``; ``note`` holds whatever else the owner wants to be committed with them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._write({"version": 0, "segments": {}, "note": {}}, "ignore")
        slots = spark.read.text(f"{path}/manifest").select("value").collect()
        state = max((json.loads(r["value"]) for r in slots), key=lambda s: s["version"])
        self.version: int = state["version"]
        self.segments: dict[str, dict] = state["segments"]
        self.note: dict = state["note"]

    def _write(self, state: dict, mode: str) -> None:
        row = self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        row.write.mode(mode).text(f"{self.path}/manifest/slot={state['version'] % 2}")

    def commit(self) -> None:
        """From here on the segments and the note as they are in this object count."""
        self.version += 1
        self._write({"version": self.version, "segments": self.segments, "note": self.note}, "overwrite")

    def folder(self, name: str) -> str:
        return f"{self.path}/{SEGMENT}={name}"

    def read(self, schema: str, names: list[str]) -> DataFrame:
        """The rows of the named segments."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(f"{schema}, {SEGMENT} string").option("basePath", self.path)
                .parquet(*map(self.folder, names)).drop(SEGMENT))

    def clear(self, schema: str, names: list[str]) -> None:
        """Empties segments that no longer count."""
        for name in names:
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self.folder(name))


def level(rows: int, base: int, fanout: int) -> int:
    """Segments of up to ``base`` rows are on level 0; each level holds ``fanout`` times as many."""
    return 0 if rows <= base else math.ceil(math.log(rows / base, fanout) - 1e-9)


def crowded(segments: dict[str, dict], base: int, fanout: int, but: str | None = None) -> list[str]:
    """The segments of the lowest level that has ``fanout`` of them or more, without ``but``."""
    levels: dict[int, list[str]] = {}
    for name, s in segments.items():
        if name != but:
            levels.setdefault(level(s["rows"], base, fanout), []).append(name)
    return next((sorted(names) for _, names in sorted(levels.items()) if len(names) >= fanout), [])


def rows_of(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]
