"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

An index is a family of levels. Each level is a suffix array over sampled suffixes: of every 100-byte window, the suffix that
starts at the window's smallest 32-byte hash, so equal windows sample the same suffix at the same place. Suffixes are
ordered by the fingerprint of their first 32 bytes. A new batch gets its own array; one merge scan over the batch and all
levels brings equal beginnings together. When two levels have the same rank, they merge into one of the next rank, so an
entry is rewritten a logarithmic number of times.

Consecutive windows that sample the same suffix are one entry with a fingerprint of all their bytes. In the scan

* an entry whose bytes were seen earlier is a match as a whole;
* a first entry whose beginning is shared with other bytes is contested: its bytes are fetched, it is cut into pieces of
  seven windows and these are scanned by their common 94 bytes in the same manner, and what is contested there is scanned
  window by window.

So every 100-byte string that also starts earlier is found, and nothing compares pairs. Each task first settles what repeats
within its own rows, so a string that a third of all documents share arrives at most once from each task.

Earlier means: smaller doc_id, or the same doc_id and an earlier start, in whatever order batches come.

Defined results: null texts are empty; texts of under 100 bytes are kept as they are; a null doc_id counts as smaller than
any other; rows that repeat a doc_id with the same text are one document in one place, so neither removes the other; several
texts of one doc_id (or of none) are documents in the order of their MD5; an empty table gives an empty result; extra columns
are ignored. Fingerprints have 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from complaintflow.llm.shared import numbered, stored, table, text_bytes

MATCH = 100
PREFIX = 32
PIECE = 7
#: The batches in which the query adds its documents.
BATCHES = 2
#: Entries that a task holds before it settles and passes them on.
HELD = 1 << 20

ROWS = "core long, span long, doc_id long, start int, shape int, kind byte"
ENTRY, FOUND, LEVEL = 0, 1, 2  # kinds of row: of the batch, an interval settled in its task, of a level

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(17, n.bit_length())
        one = np.ones(1, np.uint64)
        _powers[:] = [np.cumprod(np.concatenate([one, np.full(size, b, np.uint64)]))
                      for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


class Hasher:
    """Fingerprints of any slices of one byte string."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        power, self.inverse = _tables(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:len(b)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def suffixes(data: bytes) -> tuple[np.ndarray, ...]:
    """core, span, start, shape (128 x windows + place of the suffix in the first) of each run of windows with one suffix."""
    n = len(data) - MATCH + 1
    if n < 1:
        e = np.zeros(0, np.int64)
        return e, e, e, e
    h = Hasher(data)
    prefix = h.all(PREFIX)
    low = (prefix & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(prefix), dtype=np.uint64)
    width, size = MATCH - PREFIX + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[:n], low[width - size:width - size + n])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = np.append(start[1:], n)
    at = at[start]
    shape = (end - start) * 128 + at - start
    span = h(start, end - 1 + MATCH) + shape.astype(np.uint64) * np.uint64(_BASE)
    return prefix[at].view(np.int64), span.view(np.int64), start, shape


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of intervals of each document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(new) - 1
    shift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    cut = np.flatnonzero(np.concatenate([[True], (start + shift)[1:] > reach[:-1]]))
    last = np.append(cut[1:], len(doc)) - 1
    return doc[cut], start[cut], reach[last] - shift[last]


def _settled(core, span, doc, start, shape) -> pa.RecordBatch:
    """Entries of which the task knows no earlier copy, and the intervals of the others."""
    order = np.lexsort((start, doc, span, core))
    core, span, doc, start, shape = (x[order] for x in (core, span, doc, start, shape))
    head = np.ones(len(core), bool)
    head[1:] = (core[1:] != core[:-1]) | (span[1:] != span[:-1])
    of = np.maximum.accumulate(np.where(head, np.arange(len(core)), 0)) if len(core) else np.zeros(0, np.int64)
    repeat = (doc != doc[of]) | (start != start[of])
    d, s, e = _merged(doc[repeat], start[repeat], start[repeat] + shape[repeat] // 128 + MATCH - 1)
    keep = ~repeat
    spread = _mix(d.view(np.uint64) * np.uint64(31) + s.astype(np.uint64)).view(np.int64)
    put = lambda a, b, t: pa.array(np.concatenate([a, b]).astype(t))
    return pa.RecordBatch.from_arrays(
        [put(core[keep], spread, np.int64), put(span[keep], np.zeros(len(d)), np.int64), put(doc[keep], d, np.int64),
         put(start[keep], s, np.int32), put(shape[keep], e - s, np.int32), put(np.full(keep.sum(), ENTRY), np.full(len(d), FOUND), np.int8)],
        ["core", "span", "doc_id", "start", "shape", "kind"])


def _gathered(batches, entries):
    """Passes on what ``entries`` makes of each row, settled task by task in bounded amounts."""
    held, n = [], 0
    for batch in batches:
        for entry in entries(batch):
            held.append(entry)
            n += len(entry[0])
            if n >= HELD:
                yield _settled(*map(np.concatenate, zip(*held)))
                held, n = [], 0
    if n:
        yield _settled(*map(np.concatenate, zip(*held)))


def suffix_array(docs: DataFrame) -> DataFrame:
    def entries(batch):
        for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
            core, span, start, shape = suffixes(text)
            yield core, span, np.full(len(core), doc, np.int64), start, shape

    return docs.mapInArrow(lambda batches: _gathered(batches, entries), ROWS)


def _scan(rows: DataFrame, last: bool = False) -> DataFrame:
    """Adds ``again`` (its bytes were seen earlier) and ``contested``."""
    dealt = rows.repartition("core", "span") if last else rows.repartition("core")
    place = F.rank().over(Window.partitionBy("core", "span").orderBy("doc_id", "start"))
    dealt = dealt.withColumn("again", (F.col("kind") != FOUND) & (place > 1))
    if last:
        return dealt.withColumn("contested", F.lit(False))
    group = Window.partitionBy("core")
    contested = (F.min("span").over(group) != F.max("span").over(group)) & F.max(F.col("kind") == ENTRY).over(group)
    return dealt.withColumn("contested", contested & ~F.col("again") & (F.col("kind") != FOUND))


def _intervals(scanned: DataFrame) -> DataFrame:
    """doc_id, start, end of what was found."""
    return scanned.filter(F.col("again") | (F.col("kind") == FOUND)).select(
        "doc_id", "start", F.when(F.col("kind") == FOUND, F.col("start") + F.col("shape"))
        .otherwise(F.col("start") + F.floor(F.col("shape") / 128).cast("int") + MATCH - 1).alias("end"))


def _contexts(contested: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of contested entries: core, doc_id, start, shape, bytes."""
    lists = contested.groupBy("doc_id").agg(F.collect_list(F.struct("core", "start", "shape")).alias("entries"))

    def fetch(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for doc, text, entries in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), batch.column("entries").to_pylist()):
                for e in entries:
                    start, shape = e["start"], e["shape"]
                    for to, x in zip(out, (e["core"], doc, start, shape, text[start:start + shape // 128 + MATCH - 1])):
                        to.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                ["core", "doc_id", "start", "shape", "bytes"])

    return docs.join(lists, "doc_id").select("doc_id", "text", "entries").mapInArrow(
        fetch, "core long, doc_id long, start int, shape int, bytes binary")


def _cut(contexts: DataFrame, piece: int) -> DataFrame:
    """Entries for the pieces of ``piece`` windows of each context; pieces are counted from the suffix, so they line up."""

    def entries(batch):
        data = text_bytes(batch.column("bytes"))
        if not data:
            return
        core, doc, start, shape = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("core", "doc_id", "start", "shape"))
        n, place = shape // 128, shape % 128
        h, size = Hasher(b"".join(data)), np.array([len(x) for x in data])
        at = np.cumsum(size) - size  # where each context begins in the joined bytes; no slice leaves its context
        of = np.repeat(np.arange(len(n)), n)
        first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        number = (first - place[of] + MATCH) // piece  # the same for windows with the suffix in the same places
        head = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (of[1:] != of[:-1])]))
        tail, of, number = np.append(head[1:], len(number)) - 1, of[head], number[head]
        windows, head = tail - head + 1, first[head]
        whole = number * piece + place[of] - MATCH  # where the piece's first window would be
        seed = _mix(core[of].view(np.uint64) + number.astype(np.uint64) * np.uint64(_BASE))
        shared = h(at[of] + whole + piece - 1, at[of] + whole + MATCH) ^ seed
        form = windows * 128 + head - whole
        span = h(at[of] + head, at[of] + head + windows - 1 + MATCH) + form.astype(np.uint64) * np.uint64(_BASE)
        yield shared.view(np.int64), span.view(np.int64), doc[of], start[of] + head, windows * 128

    return contexts.mapInArrow(lambda batches: _gathered(batches, entries), ROWS)


class SuffixIndex:
    """Levels of suffix arrays. ``add`` returns what a batch shares with itself and with all that was added before."""

    def __init__(self, match: int = MATCH):
        if match != MATCH:
            raise ValueError(f"the index is built for matches of {MATCH} bytes")
        self.levels: list[tuple[int, DataFrame]] = []
        self.docs: list[DataFrame] = []

    def add(self, docs: DataFrame, final: bool = False) -> DataFrame:
        """docs: doc_id (not null), text. Returns doc_id, start, end. ``final``: no further batch comes, so none is indexed."""
        self.docs.append(docs)
        rows = suffix_array(docs)
        for _, level in self.levels:
            rows = rows.union(level.withColumn("kind", F.lit(LEVEL).cast("byte")).select(rows.columns))
        scanned = _scan(rows)
        marked = F.col("again") | F.col("contested") | (F.col("kind") == FOUND)
        scanned = stored(scanned.filter(marked) if final else scanned)
        if not final:
            fresh = scanned.filter((F.col("kind") == ENTRY) & ~F.col("again"))
            self._keep(0, fresh.select("core", "span", "doc_id", "start", "shape"))
        texts = self.docs[0]
        for more in self.docs[1:]:
            texts = texts.union(more)
        contexts = stored(_contexts(scanned.filter("contested"), texts))
        pieces = stored(_scan(_cut(contexts, PIECE)).filter(marked))
        # the pieces that are contested, with their bytes
        slot = 64  # a context has at most 69 windows, so it begins in the slot of its piece or one of the two before
        whole = contexts.select("core", "doc_id", F.col("start").alias("at"), F.col("shape").alias("of"), "bytes",
                                F.floor(F.col("start") / slot).cast("int").alias("slot"))
        begun = F.floor(F.col("start") / slot).cast("int")
        wanted = pieces.filter("contested").select("doc_id", "start", F.floor(F.col("shape") / 128).cast("int").alias("n"),
                                                   F.explode(F.array(begun, begun - 1, begun - 2)).alias("slot"))
        inside = ((whole["doc_id"] == wanted["doc_id"]) & (whole["slot"] == wanted["slot"])
                  & (wanted["start"] >= whole["at"]) & (wanted["start"] < whole["at"] + F.floor(whole["of"] / 128)))
        parts = whole.join(wanted, inside).select(
            "core", whole["doc_id"], "start", (F.col("n") * 128 + F.col("of") % 128 - (F.col("start") - F.col("at"))).cast("int").alias("shape"),
            F.substring(F.col("bytes"), F.col("start") - F.col("at") + 1, F.col("n") + MATCH - 1).alias("bytes"))
        windows = _scan(_cut(parts, 1), last=True)
        return _intervals(scanned).union(_intervals(pieces)).union(_intervals(windows))

    def _keep(self, rank: int, level: DataFrame) -> None:
        """Adds a level; equal ranks merge into the next. A batch's own array is what the scan has stored."""
        merged = False
        while same := next((x for x in self.levels if x[0] == rank), None):
            self.levels.remove(same)
            first = F.min(F.struct("doc_id", "start", "shape")).alias("first")
            level = level.union(same[1]).groupBy("core", "span").agg(first).select("core", "span", "first.*")
            rank, merged = rank + 1, True
        self.levels.append((rank, stored(level.sortWithinPartitions("core", "span")) if merged else level))


def remove(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    texts = numbered(docs)
    index, found = SuffixIndex(), None
    for i in range(batches):
        part = index.add(texts.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i), final=i == batches - 1)
        found = part if found is None else found.union(part)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist()):
                s = np.array([(x["start"], x["end"]) for x in spans or ()], np.int64).reshape(-1, 2)
                _, start, end = _merged(np.zeros(len(s), np.int64), s[:, 0], s[:, 1])
                # runs that touch are one
                edges = [0, *(x for pair in zip(start.tolist(), end.tolist()) for x in pair), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept))
            n, gone, runs, digest, kept = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("own_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.join(spans, "doc_id", "left").select("own_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).drop("kept")


#: Every window of 100 bytes by itself; texts as hexadecimal, two digits a byte.
SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS p, h FROM d),
k AS (SELECT doc_id, p, md5(substring(h, CAST(2 * p + 1 AS BIGINT), 200)) AS m FROM w),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, rank() OVER (PARTITION BY m ORDER BY doc_id, p) AS place FROM k) WHERE place > 1),
islands AS (SELECT doc_id, p, sum(CASE WHEN p - before > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island
  FROM (SELECT doc_id, p, lag(p, 1, p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM again)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM islands GROUP BY doc_id, island),
per AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY doc_id),
cut AS (SELECT d.doc_id, len(h) // 2 AS n, coalesce(starts, []) AS starts, coalesce(ends, []) AS ends, h FROM d LEFT JOIN per USING (doc_id)),
kept AS (SELECT doc_id, n, len(starts) AS spans, array_to_string(list_transform(range(0, len(starts) + 1),
    lambda i: substring(h, CAST(2 * CASE WHEN i = 0 THEN 0 ELSE ends[i] END + 1 AS BIGINT),
                           CAST(2 * (coalesce(starts[i + 1], n) - CASE WHEN i = 0 THEN 0 ELSE ends[i] END) AS BIGINT))), '') AS rest FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - len(rest) // 2 AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
       sha256(unhex(rest)) AS kept_sha256 FROM kept"""
