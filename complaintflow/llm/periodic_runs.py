"""Periodic runs of words, caught online at completed power-of-two blocks.

Whenever a block of 2^k words is completed, a catcher waits for the block to come back at one of the distances that level k
is responsible for. A stretch of period p and length L has its first L - p words again p words later, and among them lies
an aligned block of 2^k words as soon as 2^(k+1) - 1 <= L - p; the levels share out the distances by that bound. Each
appended word completes one window of every level, which is compared with the one or two blocks at that level's distances.
A block that came back is extended to both sides by suffix comparisons over the dyadic window hashes; where the text ends
before a difference, the comparison stays open and is advanced by the words that follow. Squares of one period that touch
merge, since they extend to the same stretch; of several periods of one stretch the smallest stays.

``SquareCatcher.append`` takes any number of words: one by one or a whole text, the runs are the same. Work is
O(n log^2 n) for n words whatever they are; memory is the window hashes, 8 bytes a word and level.

Defined results: a null, empty or blank text has no words and no runs; ties of a run's rank go to the smaller start, then
period; repeated rows are judged each; an empty table gives an empty result; extra columns are ignored unless named in
``keep``; names of the result in ``keep`` are an error.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from complaintflow.llm.shared import WORD, arrow_map, columns, table, text_bytes

LEAST_WORDS = 24
LEAST_PERIODS = 3
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, exactly."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


class SquareCatcher:
    """The maximal stretches of at least ``periods`` periods and ``least`` words of a growing sequence of numbers."""

    def __init__(self, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, seed: int = 0):
        if periods < 2 or least < 2:
            raise ValueError("a run has two periods and two words or more")
        self.least, self.periods, self.seed = least, periods, seed
        self.n = 0
        self.words = np.zeros(0, np.int64)
        self.levels: list[np.ndarray] = []
        self.seen: dict[int, int] = {}  # level -> its next window
        self.open: dict[tuple[int, int], int] = {}  # (start, period) of stretches that reach the end
        self.closed: dict[tuple[int, int], int] = {}  # (start, period) -> end of those that a word has ended
        # in a stretch of period p at least max(least, periods * p) - p words come again
        repeated = min(max(least, periods * p) - p for p in range(1, least + 2))
        self.lowest = (repeated + 1).bit_length() - 2

    def _farthest(self, level: int) -> int:
        """The longest distance of a level: more repeated words than a level needs are the next level's."""
        return ((1 << (level + 2)) - 2) // (self.periods - 1) if level >= self.lowest else 0

    # ------------------------------------------------------------------ window hashes
    def _grow(self, numbers: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(numbers)
        if self.n > len(self.words):
            room = max(self.n, 2 * before)
            self.words = np.concatenate([self.words[:before], np.zeros(room - before, np.int64)])
            self.levels = [np.concatenate([h[:before], np.zeros(room - before, np.uint64)]) for h in self.levels]
        self.words[before:self.n] = numbers
        top = self.lowest
        while self.periods * (self._farthest(top) + 1) <= self.n:
            top += 1
        for level in range(top + 1):
            if level == len(self.levels):
                self.levels.append(np.zeros(len(self.words), np.uint64))
                start = 0
            else:
                start = max(0, before - (1 << level) + 1)
            stop = self.n - (1 << level) + 1
            if stop > start:
                if level:
                    half = self.levels[level - 1]
                    a, b = half[start:stop], half[start + (1 << level - 1):stop + (1 << level - 1)]
                else:
                    a, b = self.words[start:stop].view(np.uint64), np.uint64(self.seed + 1)
                z = (a * _MIX[0] + b) * _MIX[1]
                z ^= z >> np.uint64(31)
                z *= _MIX[2]
                z ^= z >> np.uint64(29)
                self.levels[level][start:stop] = z

    def _equal_after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x and from y (x < y) on are alike."""
        n = np.zeros(len(x), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            size, h = 1 << level, self.levels[level]
            going = np.flatnonzero(y + n + size <= self.n)
            while len(going):
                at = n[going]
                going = going[h[x[going] + at] == h[y[going] + at]]
                n[going] += size
                going = going[y[going] + n[going] + size <= self.n] if level == len(self.levels) - 1 else going[:0]
        return n

    def _equal_before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words just before x and before y (x < y) are alike."""
        n = np.zeros(len(x), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            size, h = 1 << level, self.levels[level]
            going = np.flatnonzero(x - n - size >= 0)
            while len(going):
                at = n[going] + size
                going = going[h[x[going] - at] == h[y[going] - at]]
                n[going] += size
                going = going[x[going] - n[going] - size >= 0] if level == len(self.levels) - 1 else going[:0]
        return n

    # ------------------------------------------------------------------ catching
    def append(self, numbers: np.ndarray) -> None:
        before = self.n
        self._grow(np.asarray(numbers, np.int64))
        if self.n == before:
            return
        if self.open:
            start, period = np.array(list(self.open), np.int64).T
            end = before + self._equal_after(before - period, np.full(len(period), before))
            self.open = {}
            self._merge(start, end, period)
        for level in range(self.lowest, len(self.levels)):
            size, h = 1 << level, self.levels[level]
            nearest, farthest = self._farthest(level - 1) + 1, self._farthest(level)
            window = np.arange(max(nearest, self.seen.get(level, 0)), self.n - size + 1)
            if not len(window):
                continue
            self.seen[level] = self.n - size + 1
            block = window - nearest >> level << level
            for back in range(0, farthest - nearest + size, size):
                at = block - back
                hit = np.flatnonzero((h[np.maximum(at, 0)] == h[window]) & (at >= 0) & (window - at <= farthest))
                if len(hit):
                    self._caught(at[hit], window[hit], size)

    def _caught(self, block: np.ndarray, window: np.ndarray, size: int) -> None:
        period = window - block
        if len(block) > 64:  # what lies within a known stretch whose period divides the distance extends to that stretch
            known = [(e - s, -p, s, e) for (s, p), e in [*self.closed.items(), *((k, self.n) for k in self.open)]]
            owner, runs = np.full(self.n, -1), np.array([(s, e, -p) for _, p, s, e in sorted(known)] or [(0, 0, 1)])
            for i, (s, e, _) in enumerate(runs):
                owner[s:e] = i
            mine = owner[block]
            new = (mine < 0) | (runs[mine, 1] < window + size) | (period % runs[mine, 2] != 0)
            block, window, period = block[new], window[new], period[new]
        left = self._equal_before(block, window)
        right = self._equal_after(block + size, window + size)
        self._merge(block - left, window + size + right, period)

    def _merge(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        long = end - start >= np.maximum(self.least, self.periods * period)
        for s, e, p in zip(start[long].tolist(), end[long].tolist(), period[long].tolist()):
            if e < self.n:
                self.closed[s, p] = e
        for s, p in zip(start[end == self.n].tolist(), period[end == self.n].tolist()):
            self.open[s, p] = self.n

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) by start, then period. Every period is verified word by word."""
        ends = self.closed | {k: self.n for k in self.open if self.n - k[0] >= max(self.least, self.periods * k[1])}
        for (s, p), e in ends.items():
            if not np.array_equal(self.words[s:e - p], self.words[s + p:e]):  # two windows with one hash
                again = SquareCatcher(self.least, self.periods, self.seed + 1)
                again.append(self.words[:self.n])
                return again.runs()
        smallest: dict[tuple[int, int], int] = {}
        for (s, p), e in ends.items():
            smallest[s, e] = min(p, smallest.get((s, e), p))
        return sorted(((s, e - s, p) for (s, e), p in smallest.items()), key=lambda r: (r[0], r[2]))


def find_runs(numbers: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    if len(numbers) < max(least, periods):
        return []
    catcher = SquareCatcher(least, periods)
    catcher.append(numbers)
    return catcher.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside runs and in the first period of every run that has them."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def most_periods(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties go to the smaller start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


_RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
_OWN = ("n_words", "runs", "top", "collapsed")


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """``keep``, n_words, runs (array of start, length, period), top (the run of most periods), collapsed (kept words, blanks between)."""
    if set(keep) & set(_OWN):
        raise ValueError(f"keep must not have {_OWN}")
    rows = columns(docs, *dict.fromkeys([*keep, "text"]))
    schema = StructType([rows.schema[k] for k in keep]).add("n_words", LongType()).add("runs", ArrayType(_RUN)).add("top", _RUN).add("collapsed", StringType())
    run_type = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, found, best, kept = [], [], [], []
        for text in text_bytes(batch.column("text")):
            words = text.split()
            runs = find_runs(word_numbers(words), least, periods)
            top = most_periods(runs)
            sizes.append(len(words))
            found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            best.append(top and dict(zip(("start", "length", "period"), top)))
            kept.append(b" ".join(collapsed(words, runs)).decode())
        return pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(run_type)), pa.array(best, run_type),
             pa.array(kept, pa.string())], [*keep, *_OWN])

    return arrow_map(rows, run, schema)


# --------------------------------------------------------------------------- the registered query
def periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: in every tenth document (by h, the CRC-32 of its doc_id) the words from word a on repeat the p words from there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))

    def rebuilt(words: Column, h: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")

    chosen = F.when(h % 10 == 0, words)
    listed = columns(docs, "doc_id", "text").select("doc_id", "text", chosen.alias("words"), h.alias("h"))
    return listed.select("doc_id", F.when(F.size("words") > 0, rebuilt(F.col("words"), F.col("h"))).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents with their periodic tails. A row without doc_id has no h and keeps its text."""
    found = periodic_runs(periodic_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"),
        F.col("top.period").alias("period"), F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
