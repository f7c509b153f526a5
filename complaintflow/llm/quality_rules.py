"""Quality rules: minimum word count and repetition, then robust multivariate outliers for each language and source.

Every text gives a vector of transformed statistics. For each language and source, a minimum-covariance-determinant
estimate of centre and scatter is found by concentration steps over all rows: distances under the current estimate are
counted into fine bins together with the moments of the rows in each bin, and the bins that hold the nearest 75 % of the
rows give the next estimate. A step is one aggregate whatever the size of a group, so no group meets in one task. Rows
whose Mahalanobis distance exceeds the cut-off are rejected.

Groups with fewer than ``MIN_ROWS`` rows are pooled by language, those that remain small are pooled together; where even
that pool is small, base rules alone decide.

Defined results: null and empty texts have no words and fail the base rules; null language or source is a value of its
own; repeated rows count as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from complaintflow.llm.shared import arrow_map, columns, stored, table, text_bytes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b"!\"'(),-./:;=?@[]_{}~"

MIN_ROWS = 60
CORE = 0.75
STEPS = 6
#: Distance beyond which a vector is an outlier, as a multiple of the distance that holds the core. For normal features the
#: 97.5 % point is sqrt(16.01 / 9.04) = 1.33 (chi-square, 7 degrees), but shares and lengths are skewed, and that rejects
#: many good texts; README has the figures.
CUT = 3.0
BINS_PER_OCTAVE = 32

#: Name, and the standard deviation that is added to each group's own: differences below it are never telling.
FEATURES = {"log_words": 0.5, "log_word_length": 0.05, "symbols": 0.05, "dup_lines": 0.1, "repeats": 0.1, "upper": 0.05,
            "punctuation": 0.05}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_punctuation"]


def statistics(text: bytes) -> tuple[int, ...]:
    """The values of BASE and EXTRA of one text."""
    words = text.split()
    n, joined = len(words), b"".join(words)
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    repeated = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        _, at, count = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        twice = count[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k:n - 2 + k] |= twice
        repeated = int(covered.sum())
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    punctuation = len(joined) - len(joined.translate(None, PUNCTUATION))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    return n, len(joined.decode("utf-8", "replace")), symbols, duplicates, repeated, lines, upper, punctuation


def document_statistics(docs: DataFrame) -> DataFrame:
    names = BASE + EXTRA

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([statistics(t) for t in text_bytes(batch.column("text"))], np.int64).reshape(-1, len(names))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(values[:, i]) for i in range(len(names)))],
            ["doc_id", "lang", "source", *names])

    return arrow_map(columns(docs, "doc_id", "lang", "source", "text"), run,
                     "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in names))


def _vector() -> dict:
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    return {
        "log_words": F.log(F.col("n_words").cast("double")),
        "log_word_length": F.log(F.col("word_chars") / F.col("n_words")),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "punctuation": share("n_punctuation", "word_chars"),
    }


def _pools(rows: DataFrame) -> DataFrame:
    """flow keys (lang_key, source_key) and the pool that each belongs to, null if even the last pool is small."""
    counts = rows.groupBy("lang_key", "source_key").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") < MIN_ROWS, F.col("n")).otherwise(0)
    counts = counts.withColumn("of_lang", F.sum(small).over(Window.partitionBy("lang_key")))
    rest = counts.filter((F.col("n") < MIN_ROWS) & (F.col("of_lang") < MIN_ROWS)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rest"))
    return counts.crossJoin(F.broadcast(rest)).select(
        "lang_key", "source_key",
        F.when(F.col("n") >= MIN_ROWS, F.concat_ws("\t", "lang_key", "source_key"))
        .when(F.col("of_lang") >= MIN_ROWS, F.col("lang_key"))
        .when(F.col("rest") >= MIN_ROWS, F.lit("")).alias("pool"))


def _names() -> tuple[list[str], list[str], list[tuple[int, int]]]:
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    return [f"m{i}" for i in range(p)], [f"q{i}_{j}" for i, j in pairs], pairs


def _estimate(moments: DataFrame) -> DataFrame:
    """pool, n, sums s*, sums of products t*  ->  pool, radius, mean m*, inverse of the floored scatter q*."""
    p, floor = len(FEATURES), np.diag(np.square(list(FEATURES.values())))
    means, inverse, pairs = _names()

    def run(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                m = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
                cov = np.zeros((p, p))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = r[f"t{i}_{j}"] / r["n"] - m[i] * m[j]
                inv = np.linalg.inv(cov + floor)
                out.append([r["pool"], r["radius"], *m, *(inv[i, j] for i, j in pairs)])
            yield pd.DataFrame(out, columns=["pool", "radius", *means, *inverse])

    return moments.mapInPandas(run, "pool string, radius double, " + ", ".join(f"{x} double" for x in means + inverse))


def _distance():
    x, (means, inverse, pairs) = list(FEATURES), _names()
    d = [F.col(a) - F.col(m) for a, m in zip(x, means)]
    return sum((F.col(q) * d[i] * d[j] * (1 if i == j else 2) for q, (i, j) in zip(inverse, pairs)), F.lit(0.0))


def _moments() -> list:
    x = list(FEATURES)
    return ([F.count("*").alias("n")] + [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)]
            + [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"t{i}_{j}") for i, j in _names()[2]])


def robust_estimates(rows: DataFrame) -> DataFrame:
    """One estimate for each pool. rows: pool and the features.

    The start is the coordinatewise median and quartile range of values rounded to hundredths, so the counts that the
    exact percentile keeps are few.
    """
    p, x, (_, _, pairs) = len(FEATURES), list(FEATURES), _names()
    quartiles = rows.groupBy("pool").agg(*(F.percentile(F.round(a, 2), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(a) for a in x))
    start = quartiles.select(
        "pool", F.lit(1.0).alias("n"), F.lit(0.0).alias("radius"), *(F.col(a)[1].alias(f"s{i}") for i, a in enumerate(x)),
        *((F.col(x[i])[1] * F.col(x[j])[1] + (F.pow((F.col(x[i])[2] - F.col(x[i])[0]) / 1.349, 2) if i == j else 0)).alias(f"t{i}_{j}")
          for i, j in pairs))
    estimate = stored(_estimate(start))
    total = Window.partitionBy("pool")
    before = total.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(STEPS):
        bins = (rows.join(estimate, "pool").withColumn("bin", F.floor(F.log2(_distance() + 1e-6) * BINS_PER_OCTAVE).cast("int"))
                .groupBy("pool", "bin").agg(*_moments()))
        core = (bins.withColumn("all", F.sum("n").over(total)).withColumn("nearer", F.coalesce(F.sum("n").over(before), F.lit(0)))
                .filter(F.col("nearer") < CORE * F.col("all")))
        sums = [F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(p)), *(f"t{i}_{j}" for i, j in pairs)]]
        radius = F.max(F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS_PER_OCTAVE)).alias("radius")
        estimate = stored(_estimate(core.groupBy("pool").agg(*sums, radius)))
    return estimate


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, BASE, base_failed, distance (as a multiple of the core's, null without a verdict), kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?"))
    stats = stored(document_statistics(docs).withColumn("base_failed", failed)
                   .withColumn("lang_key", key("lang")).withColumn("source_key", key("source")))
    rows = stats.filter(~F.col("base_failed"))
    pools = stored(_pools(rows))
    vectors = stored(rows.join(pools, ["lang_key", "source_key"]).filter("pool IS NOT NULL")
                     .select("pool", *(v.alias(k) for k, v in _vector().items())))
    estimates = robust_estimates(vectors)
    vector = stats.withColumns({k: F.when(~F.col("base_failed"), v) for k, v in _vector().items()})
    out = (vector.join(pools, ["lang_key", "source_key"], "left").join(estimates, "pool", "left")
           .withColumn("distance", F.sqrt(_distance() / F.col("radius"))))
    return out.select("doc_id", *BASE, "base_failed", "distance",
                      (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))
