"""Pages by token over rows that are stored in the order of the pages.

Rows lie in slices that follow each other by (time descending, key); a small table has the first and last row of each slice.
The page after a token is read from the slices that come next, so the ten-thousandth page reads as few as the first. Later
rows are a segment of their own, and a page takes the next slices of every segment.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.sources.segments import SEGMENT, Segments, rows_of

SLICE_ROWS = 10_000
Token = tuple[datetime | None, str]


class PageStore:
    """Rows of ``schema`` below ``path`` in the order (``time`` descending with nulls last, ``key``)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, time: str, key: str, slice_rows: int = SLICE_ROWS):
        self.spark, self.schema, self.time, self.key, self.slice_rows = spark, schema, time, key, slice_rows
        self.rows = Segments(spark, f"{path}/rows")
        self.zones = Segments(spark, f"{path}/zones")

    def put(self, name: str, rows: DataFrame) -> None:
        """Adds rows; a name written again is replaced. They count from the commit of their zones on."""
        n = rows_of(rows)
        slices = max(1, -(-n // self.slice_rows))
        order = [F.col(self.time).desc_nulls_last(), F.col(self.key).asc()]
        # sorted by slice first, the number of the range, so that a slice has one file
        placed = rows.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id())
        placed.sortWithinPartitions("slice", *order).write.mode("overwrite").partitionBy("slice").parquet(self.rows.folder(name))
        stored = self._rows([name])
        first = F.min_by(F.struct(self.time, self.key), self._rank())
        last = F.max_by(F.struct(self.time, self.key), self._rank())
        zones = stored.groupBy("slice").agg(first.alias("first"), last.alias("last"), F.count("*").alias("n"))
        zones.coalesce(max(1, slices // 100_000)).write.mode("overwrite").parquet(self.zones.folder(name))
        self.rows.segments[name] = self.zones.segments[name] = {"rows": n}
        self.rows.commit()
        self.zones.commit()

    def _rank(self, row: Column | None = None) -> Column:
        """A struct that grows along the pages."""
        time, key = (F.col(self.time), F.col(self.key)) if row is None else (row[self.time], row[self.key])
        return F.struct(time.isNull(), -F.coalesce(F.unix_micros(time.cast("timestamp")), F.lit(0)), key)

    def _token(self, token: Token) -> Column:
        time = F.lit(token[0]).cast("timestamp_ntz")
        return F.struct(time.isNull(), -F.coalesce(F.unix_micros(time.cast("timestamp")), F.lit(0)), F.lit(token[1]))

    def _rows(self, names: list[str]) -> DataFrame:
        schema = f"{self.schema}, slice int, {SEGMENT} string"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.rows.path).parquet(*map(self.rows.folder, names))

    def total(self) -> int:
        """Rows of all segments."""
        return sum(s["rows"] for s in self.zones.segments.values())

    def page(self, per_page: int, after: Token | None = None, where: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The next ``per_page`` rows under the filter ``where``, in order. The token of the next page is its last row's (time, key).

        More slices are taken as long as the filter leaves too few rows.
        """
        columns = [f.split()[0] for f in self.schema.split(", ")]
        names, take = list(self.zones.segments), 1
        schema = f"slice int, first struct<{self.time}: timestamp_ntz, {self.key}: string>, last struct<{self.time}: timestamp_ntz, {self.key}: string>, n long"
        zones = (self.spark.createDataFrame([], f"{schema}, {SEGMENT} string") if not names else self.spark.read
                 .schema(f"{schema}, {SEGMENT} string").option("basePath", self.zones.path).parquet(*map(self.zones.folder, names)))
        ahead = zones if after is None else zones.filter(self._rank(F.col("last")) > self._token(after))
        while True:
            # of each segment the next slices; the first row of the one after them limits what is known to be complete
            near = [z for name in names for z in
                    ahead.filter(F.col(SEGMENT) == name).orderBy(self._rank(F.col("first"))).limit(take + 1).collect()]
            chosen, beyond = [], []
            for name in names:
                mine = [z for z in near if z[SEGMENT] == name]
                chosen += mine[:take]
                beyond += mine[take:]
            rows = self._rows(sorted({z[SEGMENT] for z in chosen}))
            for c in ("slice", SEGMENT):
                rows = rows.filter(F.col(c).isin(sorted({z[c] for z in chosen})) if chosen else F.lit(False))
            some = {}
            for z in chosen:
                some.setdefault(z[SEGMENT], []).append(z["slice"])
            exactly = F.lit(False)
            for name, slices in some.items():
                exactly = exactly | ((F.col(SEGMENT) == name) & F.col("slice").isin(slices))
            rows = rows.filter(exactly)
            if after is not None:
                rows = rows.filter(self._rank() > self._token(after))
            for z in beyond:
                rows = rows.filter(self._rank() < self._token((z["first"][self.time], z["first"][self.key])))
            page = where(rows.select(*columns)).orderBy(F.col(self.time).desc_nulls_last(), F.col(self.key)).limit(per_page)
            if not beyond or rows_of(page) == per_page:
                return page
            take *= 4

    def token(self, page: DataFrame) -> Token | None:
        """Of the last row of a page; None for an empty one, after which there is nothing."""
        last = page.select(F.max_by(F.struct(self.time, self.key), self._rank()).alias("t")).first()["t"]
        return None if last is None else (last[self.time], last[self.key])
