"""Removal of repeated passages by sliding spans of sentences.

Sentences end at a line end, or at . ! ? before white space. From every sentence, the shortest run of consecutive sentences
with at least ``MIN_WORDS`` words is hashed, and so is the shortest run that ends with it. A passage of whole sentences that
repeats anywhere, and has twice that many words, is therefore covered by repeated runs, however it is cut into sentences.
Hashes are joined globally; every sentence under a run that also occurs earlier (smaller doc_id, or earlier in the same
text) is removed. Words are compared without case, white space does not count.

The first place of each hash is found by an aggregate, so a passage that a third of all documents share is combined in each
task before it is shuffled; the join back is one that adaptive execution can split.

Defined results: a null text stays null, texts without words stay as they are; a null doc_id is smaller than any other;
texts shorter than a run are never removed; rows that repeat a doc_id with the same text are one document, several texts of
one doc_id (or of none) are documents in the order of their MD5; an empty table gives an empty result; extra columns are
ignored. Hashes have 128 bits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.llm.shared import numbered, stored, table, text_bytes

MIN_WORDS = 20
_SENTENCE = re.compile(rb"[^\n]*?(?:[.!?]+(?=[ \t\r\x0b\x0c])|(?=\n)|\Z)[ \t\r\x0b\x0c]*\n*")


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Start and end of each sentence with the white space behind it; together they are the whole text."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.end() > m.start()]


def runs(text: bytes) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int]]]:
    """(first sentence, number of sentences) of each run, the words before each sentence, and the halves of each hash."""
    words = [text[a:b].lower().split() for a, b in sentences(text)]
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    n = len(words)
    # from each sentence to the first that completes enough words; and back from each sentence
    ahead = np.searchsorted(before, before[:-1] + MIN_WORDS, "left")
    back = np.searchsorted(before, before[1:] - MIN_WORDS, "right") - 1
    found = {(i, int(j) - i) for i, j in enumerate(ahead) if j <= n and words[i]}
    found |= {(int(i), j + 1 - int(i)) for j, i in enumerate(back) if i >= 0 and words[j]}
    joined = [b" ".join(w) for w in words]
    out = sorted(found)
    halves = []
    for i, k in out:
        h = xxhash.xxh3_128_intdigest(b" ".join(x for x in joined[i:i + k] if x))
        halves.append((h >> 64, h & ((1 << 64) - 1)))
    return out, before.tolist(), halves


def spans(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, first, n."""

    def run(batches):
        for batch in batches:
            h1, h2, doc, first, count = [], [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                found, _, halves = runs(text)
                for (a, k), (x, y) in zip(found, halves):
                    h1.append(x)
                    h2.append(y)
                    first.append(a)
                    count.append(k)
                doc.append(np.full(len(found), i, np.int64))
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [as_long(h1), as_long(h2), pa.array(np.concatenate(doc) if doc else np.zeros(0, np.int64)), pa.array(first, pa.int32()), pa.array(count, pa.int32())],
                ["h1", "h2", "doc_id", "first", "n"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, first int, n int")


def repeated(found: DataFrame) -> DataFrame:
    """Of the spans those that also occur earlier."""
    # stored, as adaptive execution splits a hash that very many documents share only between two plain shuffles
    firsts = stored(found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "first")).alias("at"), F.max(F.struct("doc_id", "first")).alias("last"))
                    .filter("at != last").select("h1", "h2", "at"))
    return (found.join(firsts, ["h1", "h2"]).filter(F.struct("doc_id", "first") != F.col("at"))
            .select("doc_id", "first", "n"))


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, text (what is left)."""
    texts = numbered(docs)
    gone = repeated(stored(spans(texts.select("doc_id", "text")))).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("gone"))

    def cut(batches):
        for batch in batches:
            out, total, removed = [], [], []
            nulls = batch.column("text").is_null().to_pylist()
            for text, gone, null in zip(text_bytes(batch.column("text")), batch.column("gone").to_pylist(), nulls):
                parts = sentences(text)
                keep = np.ones(len(parts), bool)
                for x in gone or ():
                    keep[x["first"]:x["first"] + x["n"]] = False
                out.append(None if null else b"".join(text[a:b] for (a, b), k in zip(parts, keep) if k).decode())
                total.append(len(parts))
                removed.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("own_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "text"])

    return (texts.join(gone, "doc_id", "left").select("own_id", "text", "gone")
            .mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, text string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"))
