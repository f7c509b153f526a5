"""Quality classifier: supervised subword embeddings, averaged per document, softmax, stochastic gradient descent in numpy.

Features of a text are its words, pairs of words and the byte n-grams of three and four inside words with their boundaries,
and marks for a word or line that comes again in the text; each is hashed into one of ``BUCKETS`` learned vectors. A
document is the mean vector of each of the three kinds of feature, and two output rows with softmax turn it into a
probability.

The model is fitted on a bounded sample: the ``TRAIN_ROWS`` labelled documents with the smallest hash of doc_id among those
that may be learned from. All texts are scored whole. As the output is linear in the vectors, each bucket's vector is
reduced to one number before scoring.

Defined results: null and blank texts have no features and get the bias's score; labels that are null or not 0 or 1 are not
learned from; without any label every score is 0.5; repeated rows are scored each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.llm.shared import arrow_map, columns, stored, table, text_bytes

BUCKETS = 1 << 17
DIM = 8
TRAIN_ROWS = 2400
EPOCHS = 5
GRAMS = (3, 4)
RATE = 0.5
SEED = 7
KINDS = 3
#: Texts are scored together up to about so many bytes.
CHUNK = 1 << 19

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 17)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MULTIPLIER) >> _SHIFT).astype(np.int64)


#: An odd weight for each place in a word; words of over 1024 bytes share weights.
_PLACES = np.random.default_rng(SEED).integers(1, 1 << 62, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature its buckets and the text that each comes from, in order: words and pairs; byte n-grams;
    marks of what comes again."""
    lines = [b" " + b" ".join(t.split()) + b" " for t in texts]
    b = np.frombuffer(b"".join(lines) + b" ", np.uint8)
    owner_end = np.cumsum([len(x) for x in lines])
    gap = b == 32
    at = np.flatnonzero(gap)
    length = np.diff(at) - 1
    begin, length = at[:-1][length > 0] + 1, length[length > 0]
    owner = np.searchsorted(owner_end, begin, "right")
    b = b.astype(np.uint64)
    with np.errstate(over="ignore"):
        if len(begin):
            place = np.arange(len(b)) - np.repeat(np.append(begin, len(b)), np.diff(np.concatenate([[0], begin[1:], [len(b), len(b)]])))
            word = np.add.reduceat((b + np.uint64(1)) * ~gap * _PLACES[place & 1023], begin)
        else:
            word = np.zeros(0, np.uint64)
        same = owner[1:] == owner[:-1]
        pair = (word[:-1] * np.uint64(31) + word[1:] + np.uint64(3))[same]
        both = np.concatenate([owner, owner[1:][same]])
        order = np.argsort(both, kind="stable")
        words = np.concatenate([_bucket(word), _bucket(pair)])[order], both[order]
        grams, origins, rolling, inner = [], [], b, np.zeros(len(b), bool)
        for n in range(2, GRAMS[1] + 1):
            rolling = rolling[:-1] * np.uint64(257) + b[n - 1:]
            if n > 2:
                inner = inner[:len(rolling)] | gap[n - 2:n - 2 + len(rolling)]
            if n >= GRAMS[0]:
                whole = np.flatnonzero(~inner[:len(rolling)])
                grams.append(_bucket(rolling[whole] * np.uint64(8) + np.uint64(n)))
                origins.append(np.searchsorted(whole, owner_end))
        pieces, owners = [], []
        for g, ends in zip(grams, origins):
            counts = np.diff(np.concatenate([[0], ends]))
            pieces.append(g[:counts.sum()])
            owners.append(np.repeat(np.arange(len(texts)), counts))
        first = np.zeros(len(word), bool)
        first[np.unique(word * np.uint64(3) + owner.astype(np.uint64) * _MULTIPLIER, return_index=True)[1]] = True
        again = np.concatenate([np.zeros(min(1, len(word)), bool), same & (word[1:] == word[:-1])])
        marks = _bucket(np.uint64(1 << 40) + again * np.uint64(4) + ~first * np.uint64(2) + (length > 12) * np.uint64(1))
        told = []
        for i, t in enumerate(texts):
            rows = [x for x in t.split(b"\n") if x.strip()]
            told.append((len(rows), len(rows) - len(set(rows))))
        total = np.array([n for n, _ in told], np.int64)
        place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        line_marks = _bucket(np.uint64(1 << 41) + (place < np.repeat(np.array([r for _, r in told], np.int64), total)).astype(np.uint64))
    line_owner = np.repeat(np.arange(len(texts)), total)
    return [words, (np.concatenate(pieces), np.concatenate(owners)),
            (np.concatenate([marks, line_marks]), np.concatenate([owner, line_owner]))]


def train(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, float]:
    """(KINDS x BUCKETS weights towards label 1, bias)."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (KINDS, BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((KINDS, 2, DIM), np.float32), np.zeros(2, np.float32)
    rows = []
    for t in texts:
        row = []
        for f, _ in features([t]):
            ids, n = np.unique(f, return_counts=True)
            row.append((ids, (n / max(1, n.sum())).astype(np.float32)))
        rows.append(row)
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            hidden = np.stack([w @ vectors[k][ids] for k, (ids, w) in enumerate(rows[i])])
            z = np.einsum("kcd,kd->c", out, hidden) + bias
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[labels[i]] -= 1
            for k, (ids, w) in enumerate(rows[i]):
                step = rate * (g @ out[k])
                out[k] -= rate * np.outer(g, hidden[k])
                vectors[k][ids] -= np.outer(w, step) * len(ids) ** 0.5
            bias -= rate * g
    weights = np.stack([vectors[k] @ (out[k][1] - out[k][0]) for k in range(KINDS)])
    return weights.astype(np.float32), float(bias[1] - bias[0])


def probabilities(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    out, start = [], 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end]) <= CHUNK):
            held += len(texts[end])
            end += 1
        z = np.full(end - start, bias)
        for w, (ids, owner) in zip(weights, features(texts[start:end])):
            z += np.bincount(owner, w[ids], end - start) / np.maximum(1, np.bincount(owner, minlength=end - start))
        out.append(1 / (1 + np.exp(-z)))
        start = end
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fits on at most TRAIN_ROWS labelled rows (doc_id, label), in one task that reads only those."""
    sample = (labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int")).distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(TRAIN_ROWS))
    rows = columns(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(frames):
        data = pd.concat([pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "text": [], "label": []}), *frames])
        data = data.assign(text=[b"" if t is None else t.encode() for t in data["text"]]).sort_values(["doc_id", "label", "text"])
        weights, bias = train(list(data["text"]), [int(x) for x in data["label"]])
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    # repeated doc_ids in the documents can add rows; the bound holds for the rows that are learned from
    model = (rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "text").limit(TRAIN_ROWS).coalesce(1)
             .mapInPandas(run, "weights binary, bias double").first())
    if model is None:
        return np.zeros((KINDS, BUCKETS), np.float32), 0.0
    return np.frombuffer(model["weights"], np.float32).reshape(KINDS, BUCKETS), model["bias"]


def score(docs: DataFrame, weights: np.ndarray, bias: float, keep: tuple[str, ...] = (),
          name: str = "score") -> DataFrame:
    """doc_id, ``keep`` and the score, called ``name``. The model is of fixed size."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))
    kept = ["doc_id", *(k for k in keep if k != "doc_id")]
    source = columns(docs, *dict.fromkeys([*kept, "text"]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, b = model.value
        scores = pa.array(probabilities(text_bytes(batch.column("text")), w, b))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), scores], [*kept, name])

    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in kept)
    return arrow_map(source, run, f"{schema}, `{name}` double")


def held_out():
    """Rows never learned from: the CRC-32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    return fit(docs, labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, *quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
