"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of ``PASSAGE`` words, weighted by TF-IDF with document frequencies over the whole corpus.
A randomised SVD (random projection, one power iteration, Rayleigh-Ritz) gives their latent space; its products over the
passages are summed by Spark. Every passage of every document is projected into it and compared with all benchmark passages
by cosine; candidates are then verified word by word against the item: by the longest common subsequence, and, where that
is long but not decisive, by whether the item's answer is there as well. Paraphrases that keep the order of most words, or
half of them and the answer, are found like verbatim passages.

The space is fitted to the benchmark's passages and not the corpus's: a space of few dimensions fitted to a corpus describes
its topics and can't tell single items apart. The benchmark is a stated query set, searched in blocks of up to ``PASSAGES``
passages. The rank of a block's space is the number of its passages: it holds each of them whole, so the cosine with any text
is the exact one and no copy is lost to a smaller space.

Defined results: null and empty texts have no passages and are clean; items without words are never found; repeated rows are
judged each; empty tables give an empty result or clean documents; extra columns are ignored. Words are runs of letters and
digits without case.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from complaintflow.llm.shared import arrow_map, columns, stored, table

PASSAGE = 40
STRIDE = 20
TERM_BITS = 18
OVERSAMPLING = 16
#: Passages in a block, unless one item has more, and items that are read together to make blocks.
PASSAGES = 512
BLOCK = 512
COSINE = 0.35
#: Share of an item's words in common order that decides alone, and the share that needs the answer too.
DECISIVE = 0.75
SUPPORTED = 0.5
ANSWER_WORDS = 8

_WORD = np.zeros(256, np.uint8)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = 1
_PLACES = np.random.default_rng(3).integers(1, 1 << 62, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Texts are hashed together up to about so many bytes.
CHUNK = 1 << 19


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """A 64-bit hash for each word of each text."""
    out, held, size = [], [], 0
    for i, t in enumerate(texts):
        held.append((t or "").lower().encode("utf-8", "replace") + b"\n")
        size += len(held[-1])
        if size >= CHUNK or i == len(texts) - 1:
            out += _hashed(held)
            held, size = [], 0
    return out


def words(text: str | None) -> np.ndarray:
    return words_of([text])[0]


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    b = np.frombuffer(b"".join(texts), np.uint8)
    word = _WORD[b]
    step = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    with np.errstate(over="ignore"):
        place = np.arange(len(b)) - np.repeat(np.append(start, len(b)), np.diff(np.concatenate([[0], start[1:], [len(b), len(b)]])))
        h = np.add.reduceat((b + np.uint64(1)) * word * _PLACES[place & 1023], start)
        h ^= h >> np.uint64(32)
        h = h * np.uint64(0x9E3779B97F4A7C15) + (end - start).astype(np.uint64) * np.uint64(2)
    return np.split(h, np.searchsorted(start, np.cumsum([len(t) for t in texts])[:-1]))


def terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def windows(n: int) -> np.ndarray:
    """Starts of the passages of n words: every run of STRIDE words is whole in one of them."""
    return np.arange(0, max(1, n - PASSAGE + STRIDE), STRIDE)


def common(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies of all hashed terms, over all documents. The table's size is fixed."""

    def count(batches):
        total, n = np.zeros(1 << TERM_BITS, np.int64), 0
        for batch in batches:
            for h in words_of(batch.column("text").to_pylist()):
                total[np.unique(terms(h))] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["term", "n"])

    counts = columns(docs, "text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << TERM_BITS)
    known = counts[counts["term"] >= 0]
    df[known["term"].to_numpy(np.int64)] = known["n"]
    n = float(counts.loc[counts["term"] < 0, "n"].sum())
    return np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)


def _rows(hashes: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors over the vocabulary."""
    x = np.zeros((len(hashes), len(vocabulary)), np.float32)
    for i, h in enumerate(hashes):
        t = terms(h)
        np.add.at(x[i], np.searchsorted(vocabulary, t), idf[t])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _summed(passages: DataFrame, product) -> np.ndarray:
    """The sum over all partitions of a matrix that ``product`` makes of their passages; summed in bands of rows in Spark."""
    band = 256

    def run(frames):
        total = None
        for f in frames:
            if len(f):
                part = product([np.frombuffer(x, np.uint64) for x in f["hashes"]]).astype(np.float64)
                total = part if total is None else total + part
        if total is not None:
            at = range(0, len(total), band)
            yield pd.DataFrame({"band": list(at), "width": [total.shape[1]] * len(at), "data": [total[i:i + band].tobytes() for i in at]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        # partitions differ in order from run to run: sum in order of their values
        parts = sorted(f["data"])
        total = sum((np.frombuffer(x) for x in parts[1:]), np.frombuffer(parts[0]))
        return f.head(1)[["band", "width"]].assign(data=[total.tobytes()])

    schema = "band long, width long, data binary"
    bands = passages.mapInPandas(run, schema).groupBy("band").applyInPandas(add, schema).orderBy("band").collect()
    return np.concatenate([np.frombuffer(x["data"]).reshape(-1, x["width"]) for x in bands])


def latent_space(passages: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the TF-IDF matrix of ``passages`` (hashes), by randomised SVD."""
    dims = min(rank + OVERSAMPLING, len(vocabulary))
    omega = np.random.default_rng(5).standard_normal((len(vocabulary), dims)).astype(np.float32)
    for _ in range(2):
        q = omega

        def power(hashes, q=q):
            x = _rows(hashes, vocabulary, idf)
            return x.T @ (x @ q)

        omega = np.linalg.qr(_summed(passages, power))[0].astype(np.float32)
    q = omega

    def gram(hashes):
        y = _rows(hashes, vocabulary, idf) @ q
        return y.T @ y

    value, vector = np.linalg.eigh(_summed(passages, gram))
    order = np.argsort(value)[::-1][:rank]
    return (q @ vector[:, order[value[order] > 1e-6 * value.max()]]).astype(np.float32)


def _searcher(items: list[tuple[int, np.ndarray]], vocabulary, idf, basis):
    lookup = np.full(1 << TERM_BITS, -1, np.int32)
    lookup[vocabulary] = np.arange(len(vocabulary))
    owner, passages = [], []
    for k, (_, h) in enumerate(items):
        for s in windows(len(h)):
            owner.append(k)
            passages.append(h[s:s + PASSAGE])
    # what each word adds to its passage's product with every benchmark passage in the space
    products = (basis * idf[vocabulary][:, None]) @ (_rows(passages, vocabulary, idf) @ basis).T
    owner = np.array(owner)

    def search(h: np.ndarray) -> list[tuple[int, float]]:
        """(item_id, share of its words found in order) of each item that a text of these words contains."""
        if not len(h):
            return []
        t = terms(h)
        energy, row = idf[t].astype(np.float64) ** 2, lookup[t]
        start = windows(len(h))
        end = np.minimum(start + PASSAGE, len(h))
        full, known = (np.concatenate([[0.0], np.cumsum(x)]) for x in (energy, energy * (row >= 0)))
        norm = full[end] - full[start]
        # what is outside the vocabulary is outside the space: such passages can't be near any item
        near = np.flatnonzero(known[end] - known[start] >= 0.5 * COSINE ** 2 * norm)
        candidates: dict[int, list[int]] = {}
        # sums over runs of STRIDE words, of which a passage has two; words outside the vocabulary add nothing
        inside = np.flatnonzero(row >= 0)
        bounds = np.searchsorted(inside, np.arange(0, len(h) + 2 * STRIDE, STRIDE))
        for part in range(0, len(near), 512):
            some = near[part:part + 512]
            lo, hi = some[0], some[-1] + 2
            mine = inside[bounds[lo]:bounds[hi]]
            sums = np.zeros((hi - lo, products.shape[1]), np.float32)
            filled = np.flatnonzero(np.diff(bounds[lo:hi + 1]))
            if len(mine):
                sums[filled] = np.add.reduceat(products[row[mine]], bounds[lo:hi][filled] - bounds[lo])
            cosine = (sums[some - lo] + sums[some - lo + 1]) / np.sqrt(norm[some])[:, None]
            for i, j in zip(*np.nonzero(cosine >= COSINE)):
                candidates.setdefault(int(owner[j]), []).append(int(start[some[i]]))
        found = []
        for k, places in candidates.items():
            item_id, item = items[k]
            answer, best, proven = item[-ANSWER_WORDS:], 0, False
            # the words around a place bound what any region in there can have in common
            reach = len(item) + max(len(item) // 2, STRIDE)
            likely = [p for p in places if _bound(item, h[max(0, p - len(item)):p + PASSAGE + reach])]
            for lo, hi in _regions(likely, len(item), len(h)):
                region = h[lo:hi]
                n = common(item, region)
                best = max(best, n)
                # any place may decide, not only the fullest
                proven = proven or n >= DECISIVE * len(item) or (n >= SUPPORTED * len(item) and _contains(region, answer))
            if proven:
                found.append((item_id, best / len(item)))
        return found

    return search


def _bound(item: np.ndarray, wide: np.ndarray) -> bool:
    """Whether enough of the item's words are there at all, and then in order."""
    least, there = SUPPORTED * len(item), set(wide.tolist())
    return sum(w in there for w in item.tolist()) >= least and common(item, wide) >= least


def _regions(places: list[int], item: int, n: int) -> list[tuple[int, int]]:
    """The words around candidate passages in windows of one and a half times the item, each place once."""
    size = item + max(item // 2, STRIDE)
    starts = {max(0, p + d) for p in places for d in range(-item, PASSAGE, max(1, size - item))}
    return [(s, min(n, s + size)) for s in sorted(starts) if s < n]


def _contains(text: np.ndarray, answer: np.ndarray) -> bool:
    if len(text) < len(answer):
        return False
    at = np.flatnonzero(text[:len(text) - len(answer) + 1] == answer[0])
    return any(np.array_equal(text[i:i + len(answer)], answer) for i in at)


def _of(benchmark: DataFrame, ids: list) -> DataFrame:
    return benchmark.filter(F.col("item_id").isin([i for i in ids if i is not None]) | (F.col("item_id").isNull() if None in ids else F.lit(False)))


def _blocks(benchmark: DataFrame, ids: list) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items that have words, in blocks of up to ``PASSAGES`` passages; rows of one item_id stay together."""
    for at in range(0, len(ids), BLOCK):
        rows = _of(benchmark, ids[at:at + BLOCK]).select("item_id", "text").orderBy("item_id", "text").collect()
        block, size = [], 0
        for _, same in groupby(rows, lambda r: r["item_id"]):
            items = [(r["item_id"], h) for r in same if len(h := words(r["text"]))]
            n = sum(len(windows(len(h))) for _, h in items)
            if block and size + n > PASSAGES:
                yield block
                block, size = [], 0
            block, size = block + items, size + n
        if block:
            yield block


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, contaminated, item_ids, best_share: one row for each row of ``docs``, whatever its doc_id.

    All blocks are searched in one pass over the documents.
    """
    spark = docs.sparkSession
    idf = document_frequencies(docs)
    ids = [r["item_id"] for r in benchmark.select("item_id").distinct().orderBy("item_id").collect()]
    shipped = []
    for items in _blocks(benchmark, ids):
        vocabulary = np.unique(terms(np.concatenate([h for _, h in items])))
        chosen = _of(benchmark, list(dict.fromkeys(i for i, _ in items)))

        def cut(frames):
            for f in frames:
                yield pd.DataFrame({"hashes": [h[s:s + PASSAGE].tobytes() for h in map(words, f["text"]) for s in windows(len(h)) if len(h)]})

        passages = stored(chosen.select("text").mapInPandas(cut, "hashes binary"))
        basis = latent_space(passages, vocabulary, idf, sum(len(windows(len(h))) for _, h in items))
        shipped.append(spark.sparkContext.broadcast((items, vocabulary, idf, basis)))
    found = _search(columns(docs, *dict.fromkeys([*keep, "text"])), keep, shipped)
    return found.select(*keep, (F.size("item_ids") > 0).alias("contaminated"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"),
                        F.coalesce(F.array_max("shares"), F.lit(0.0)).alias("best_share"))


def _search(docs: DataFrame, keep: tuple[str, ...], shipped: list) -> DataFrame:
    cached: list = []
    schema = StructType([docs.schema[k] for k in keep]).add("item_ids", ArrayType(LongType())).add("shares", ArrayType(DoubleType()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cached:
            cached.extend(_searcher(*s.value) for s in shipped)
        hits = [[x for search in cached for x in search(h)] for h in words_of(batch.column("text").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array([[i for i, _ in x] for x in hits], pa.list_(pa.int64())),
             pa.array([[s for _, s in x] for x in hits], pa.list_(pa.float64()))], [*keep, "item_ids", "shares"])

    return arrow_map(docs, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
