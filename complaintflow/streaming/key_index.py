"""Which keys a store has, found without reading the store.

Keys lie in a fixed number of hash parts. Each batch adds one segment with a folder for each part it touches, sorted by key
and with Parquet's Bloom filters; as soon as a size level has ``fanout`` segments they are merged into one. A batch therefore
reads the parts its keys hash to, in at most ``fanout`` - 1 segments a level, whatever the number of batches before: the
levels follow the number of keys, not of batches. Few keys are also pushed down one by one, so that the Bloom filters and
the order inside the files skip what can't have them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.sources.segments import Segments, crowded, rows_of

PARTS = 16
FANOUT = 8
LEVEL_ROWS = 10_000
#: Up to so many keys are given to the scan one by one.
FEW_KEYS = 200
#: Merged segments have files of about so many keys.
FILE_KEYS = 5_000_000
SCHEMA = "id string, part int"


class KeyIndex(Segments):
    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS, fanout: int = FANOUT):
        super().__init__(spark, path)
        self.parts = self.note.setdefault("parts", parts)
        self.fanout = fanout

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def known(self, keys: DataFrame, but: str | None = None) -> DataFrame:
        """``id`` of the indexed keys in all parts that the ``id`` of ``keys`` hash to, leaving out the segment ``but``."""
        names = [n for n in self.segments if n != but]
        if not names:
            return self.read("id string", [])
        placed = keys.select("id", self.part(F.col("id")).alias("part"))
        some = placed.limit(FEW_KEYS + 1).collect()
        few = len(some) <= FEW_KEYS
        touched = sorted({r["part"] for r in (some if few else placed.select("part").distinct().collect())})
        rows = self.read(SCHEMA, names).filter(F.col("part").isin(touched) if touched else F.lit(False))
        return (rows.filter(F.col("id").isin([r["id"] for r in some])) if few else rows).select("id")

    def put(self, name: str, keys: DataFrame) -> None:
        """Segment ``name`` has the keys of ``keys``; written again, it is replaced. Takes effect with ``commit``."""
        self._save(name, keys.select("id", self.part(F.col("id")).alias("part")), 1)

    def _save(self, name: str, rows: DataFrame, files: int) -> None:
        n = max(1, self.segments.get(name, {}).get("rows", 0))
        (rows.repartitionByRange(files, "part", "id").sortWithinPartitions("part", "id")
         .write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true")
         .option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.expected.ndv#id", str(max(1000, n // self.parts)))
         .partitionBy("part").parquet(self.folder(name)))
        self.segments[name] = {"rows": rows_of(self.read(SCHEMA, [name]))}

    def merge(self, but: str | None = None) -> None:
        """Merges full levels, never the segment ``but``: its batch may have to be run again."""
        while names := crowded(self.segments, LEVEL_ROWS, self.fanout, but):
            merged = f"merged-{uuid.uuid4().hex}"
            total = sum(self.segments[n]["rows"] for n in names)
            self.segments[merged] = {"rows": total}
            self._save(merged, self.read(SCHEMA, names), 1 + total // FILE_KEYS)
            for n in names:
                del self.segments[n]
            self.commit()
            self.clear(SCHEMA.split(",")[0], names)

    def catch_up(self, keys: DataFrame, rows: int, name: str) -> bool:
        """Where the store has another number of rows than was committed, its missing ``keys`` become a segment. Reads all keys
        then, and none otherwise. Says whether it had to."""
        if self.note.get("pending") is None and self.note.get("rows", 0) == rows:
            return False
        every = self.read(SCHEMA, list(self.segments)).select("id")
        missing = keys.select("id").filter(F.col("id").isNotNull()).distinct().join(every, "id", "left_anti")
        self.segments[name] = {"rows": rows}
        self._save(name, missing.select("id", self.part(F.col("id")).alias("part")), 1 + rows // FILE_KEYS)
        if not self.segments[name]["rows"]:
            del self.segments[name]
        self.note |= {"pending": None, "rows": rows}
        self.commit()
        return True


def row_count(spark: SparkSession, path: str, schema: str) -> int:
    """Rows of a Parquet folder, by the footers of its files."""
    return rows_of(spark.read.schema(schema).parquet(path))
