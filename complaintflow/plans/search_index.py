"""Text search through an inverted index of three-character grams.

Reviews lie in hash parts, numbered within their part. For each gram and part the index lists the numbers of the
reviews that have it. A search intersects the lists of the term's grams, rarest first, and compares the term with the texts
of what is left; the texts of other reviews are not read. Terms without three characters in a row are compared with all.

Building moves each text once, to a strip of its part; there are as many strips as keep all cores busy, however few the parts.
The lists are made where the stored texts are read: a task lists some reviews at a time, so a list may lie in several pieces,
and no row for a single gram of a single review is ever moved. New reviews are a segment of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow import schemas
from complaintflow.plans import reporting
from complaintflow.sources.segments import SEGMENT, Segments, rows_of

GRAM = 3
PARTS = 64
#: The lists of so many of the rarest grams are intersected; the texts decide in any case.
RAREST = 4
#: Up to so many candidates are given to the scan of the texts one by one, beyond that they are joined.
FEW = 2_000
#: Strips in all parts together, for each core; the numbers of a strip are ``STRIPS`` apart, so no two strips share one.
STRIPS_PER_CORE = 4
STRIPS = 1 << 10
#: A piece of the lists covers texts of about so many characters.
PIECE_CHARS = 4_000_000
LISTS = f"gram string, n int, numbers array<int>, part int, {SEGMENT} string"


def _lists(low: list[str], numbers: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
    """All three characters in a row in the texts, in lower case as the comparison has it, and for each the numbers of the
    texts that have it, ascending like ``numbers``."""
    chars = np.frombuffer("".join(low).encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.array([len(t) for t in low], np.int64)
    starts = np.maximum(lengths - GRAM + 1, 0)
    of = np.repeat(np.arange(len(low)), starts)
    at = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(np.cumsum(lengths) - lengths, starts)
    code = (chars[at] << 42) | (chars[at + 1] << 21) | chars[at + 2]
    kinds, kind = np.unique(code, return_inverse=True)
    pairs = np.unique(kind.astype(np.int64) * max(len(low), 1) + of)
    kind, of = pairs // max(len(low), 1), pairs % max(len(low), 1)
    three = np.stack([kinds >> 42, (kinds >> 21) & 0x1FFFFF, kinds & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    cuts = np.flatnonzero(np.diff(kind)) + 1
    return [three[i:i + GRAM] for i in range(0, len(three), GRAM)], np.split(numbers[of], cuts) if len(of) else []


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, n, numbers, part) of the texts in (part, number, low), a piece at a time."""
    for frame in frames:
        frame = frame[frame["low"].notna()].sort_values(["part", "number"])
        piece = frame["low"].str.len().cumsum() // PIECE_CHARS
        for (part, _), some in frame.groupby(["part", piece]):
            found, numbers = _lists(some["low"].tolist(), some["number"].to_numpy(np.int32))
            yield pd.DataFrame({"gram": found, "n": [len(x) for x in numbers], "numbers": numbers, "part": part})


def needed_grams(spark: SparkSession, term: str) -> list[str]:
    """The grams that a text must have to match; none where wildcards leave less than three characters in a row."""
    pieces = [p for p in re.split("[%_]", term) if p]
    if not pieces:
        return []
    low = spark.createDataFrame([(p,) for p in pieces], "piece string").select(F.lower("piece").alias("low")).collect()
    return sorted({r["low"][i:i + GRAM] for r in low for i in range(len(r["low"]) - GRAM + 1)})


class SearchIndex:
    """The index below ``path``: lists of grams, and the reviews by part and number."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark = spark
        self.lists = Segments(spark, f"{path}/lists")
        self.texts = Segments(spark, f"{path}/texts")
        self.parts = self.lists.note.setdefault("parts", parts)

    def put(self, name: str, reviews: DataFrame) -> None:
        """Adds reviews (or replaces those of the same name). Texts count from the moment their lists do."""
        strips = min(STRIPS, max(1, -(-STRIPS_PER_CORE * self.spark.sparkContext.defaultParallelism // self.parts)))
        placed = reviews.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int"))
        strip = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(strips)).cast("int")
        placed = placed.withColumn("_strip", F.col("part") * strips + strip).repartition(self.parts * strips, "_strip")
        place = (F.expr("row_number() OVER (PARTITION BY _strip ORDER BY id)") - 1) * STRIPS + F.col("_strip") % strips
        numbered = placed.withColumn("number", place).drop("_strip")
        (numbered.sortWithinPartitions("part", "number").write.mode("overwrite").partitionBy("part").parquet(self.texts.folder(name)))
        self.texts.segments[name] = {"rows": rows_of(self._texts([name]))}
        self.texts.commit()
        each = self._texts([name]).select("part", "number", F.lower("review_text").alias("low"))
        listed = each.mapInPandas(_listed, "gram string, n int, numbers array<int>, part int")
        (listed.sortWithinPartitions("part", "gram")
         .write.mode("overwrite").option("parquet.bloom.filter.enabled#gram", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
         .partitionBy("part").parquet(self.lists.folder(name)))
        self.lists.segments[name] = {"rows": self.texts.segments[name]["rows"]}
        self.lists.commit()

    def _read(self, store: Segments, schema: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", store.path).parquet(*map(store.folder, names))

    def _texts(self, names: list[str]) -> DataFrame:
        return self._read(self.texts, f"{schemas.REVIEWS}, number int, part int, {SEGMENT} string", names)

    def candidates(self, term: str) -> DataFrame | None:
        """(segment, part, number) of the reviews that have all grams of the term; None where it has none."""
        asked = needed_grams(self.spark, term)
        if not asked:
            return None
        found = self._read(self.lists, LISTS, list(self.lists.segments)).filter(F.col("gram").isin(asked))
        # the pieces of a list are of different reviews
        found = found.groupBy(SEGMENT, "part", "gram").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("numbers")).alias("numbers"))
        lists = found.groupBy(SEGMENT, "part").agg(F.count("*").alias("k"), F.sort_array(F.collect_list(F.struct("n", "numbers"))).alias("lists"))
        common = F.aggregate(F.slice("lists", 2, RAREST - 1), F.col("lists")[0]["numbers"], lambda a, x: F.array_intersect(a, x["numbers"]))
        return lists.filter(F.col("k") == len(asked)).select(SEGMENT, "part", F.explode(common).alias("number"))

    def matching(self, term: str) -> DataFrame:
        """The reviews whose text has the term, as ``reporting.search`` understands it."""
        texts = self._texts(list(self.lists.segments))
        found = self.candidates(term)
        if found is not None:
            few = found.limit(FEW + 1).collect()
            if len(few) <= FEW:
                at = {c: sorted({r[c] for r in few}) for c in (SEGMENT, "part", "number")}
                for c, values in at.items():
                    texts = texts.filter(F.col(c).isin(values) if values else F.lit(False))
                found = self.spark.createDataFrame(few, found.schema)
            texts = texts.join(F.broadcast(found) if len(few) <= FEW else found, [SEGMENT, "part", "number"], "left_semi")
        matched = texts if not term else texts.filter(reporting.search(F.col("review_text"), term))
        return matched.drop(SEGMENT, "part", "number")


def search_page(index: SearchIndex, results: DataFrame, page: int = 1, per_page: int = 25, rating: int | None = None,
                term: str = "", analyzed: bool | None = None) -> DataFrame:
    """``reporting.raw_page`` over the reviews that the index finds."""
    return reporting.raw_page(index.matching(term), results, page, per_page, rating, "", analyzed)
