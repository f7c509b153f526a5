"""Near duplicates by SimHash and pigeonhole blocks.

A 64-bit fingerprint is cut into six blocks. Two fingerprints that differ in at most three bits agree in at least three
blocks, so they meet in one of the 20 choices of three blocks (32 bits, so that unrelated fingerprints seldom meet). Every
meeting is verified by Hamming distance and reported for the first choice only. Copies of one fingerprint are one node.

Defined results: a null or blank text has fingerprint zero and is linked like any other; texts of one or two words are one
shingle; repeated rows share a fingerprint; rows without doc_id link others like any row, and a group without any doc_id
has component_id null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from complaintflow.llm.components import components
from complaintflow.llm.shared import arrow_map, columns, stored, table, text_bytes

BITS = 64
MAX_DISTANCE = 3
BLOCKS = 6
SHINGLE = 3


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 (seed 42) of each word shingle; bytes split and lower-case as ASCII does."""
    words = b" ".join(text.lower().split())
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, "<u8")
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    if len(gaps) < shingle:
        return np.array([digest(words, 42)], "<u8")
    starts = [0, *(gaps[: len(gaps) - shingle + 1] + 1).tolist()]
    ends = [*gaps[shingle - 1:].tolist(), len(words)]
    return np.fromiter((digest(words[s:e], 42) for s, e in zip(starts, ends)), "<u8", len(starts))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits over the hashes of all word shingles."""
    hashes = shingles(text, shingle)
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    counts = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[part:part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and fp (the 64 bits as a signed long), one row for each row."""
    rows = columns(docs, *keep, "text")
    schema = StructType([rows.schema[k] for k in keep]).add("fp", "long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column("text"))], np.uint64)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(bits.view(np.int64))], [*keep, "fp"])

    return arrow_map(rows, run, schema)


def _block_masks() -> list[int]:
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` that differ in one to three bits, each once."""
    masks = _block_masks()
    tables = []
    for t, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - MAX_DISTANCE)):
        key = sum(masks[i] for i in chosen)
        # a pair belongs to the first choice it agrees in: blocks before the last chosen one that aren't chosen must differ
        differ = [masks[i] for i in range(chosen[-1]) if i not in chosen]
        differ += [(1 << 64) - 1] * (MAX_DISTANCE - len(differ))
        tables.append(F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(key))).alias("key"),
                               *(F.lit(_signed(m)).alias(f"m{i}") for i, m in enumerate(differ))))
    dealt = fps.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.*")
    left = dealt.select(F.col("fp").alias("a"), "t", "key", "m0", "m1", "m2")
    right = dealt.select(F.col("fp").alias("b"), "t", "key")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(apart) <= MAX_DISTANCE)
    for m in ("m0", "m1", "m2"):
        near &= apart.bitwiseAND(F.col(m)) != 0
    return left.join(right, (left["t"] == right["t"]) & (left["key"] == right["key"]) & near).select("a", "b")


def classes(fps: DataFrame) -> DataFrame:
    """fp, class (the smallest fingerprint reachable over links) for the distinct fingerprints of ``fps``."""
    distinct = stored(fps.select("fp").distinct())
    found = components(links(distinct).select(F.col("a").alias("u"), F.col("b").alias("v")))
    return (distinct.join(found, distinct["fp"] == found["node"], "left")
            .select("fp", F.coalesce("component", "fp").alias("class")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id among the documents reachable over links."""
    fps = stored(fingerprints(docs))
    smallest = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(classes(fps), "fp")
    named = smallest.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return fps.join(smallest.select("fp", "class").join(named, "class"), "fp").select("doc_id", "fp", "component_id")


def representatives(rows: DataFrame, order: list[str]) -> DataFrame:
    """The columns ``order`` of one row of each group of near duplicates: the least by these columns, nulls last."""
    fps = stored(fingerprints(rows, tuple(order)))
    ranked = F.struct(*(c for o in order for c in (F.col(o).isNull().alias(f"null_{o}"), F.col(o))))
    least = fps.groupBy("fp").agg(F.min(ranked).alias("first")).join(classes(fps), "fp")
    return least.groupBy("class").agg(F.min("first").alias("first")).select(*(F.col("first")[o].alias(o) for o in order))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
