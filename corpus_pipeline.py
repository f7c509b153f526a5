"""A training corpus from raw documents, in five stages. Each stage gets what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.llm import classifier, decontamination, mixing, pii, simhash
from complaintflow.llm.shared import stored, table

#: SQL can't express the classifier, the fingerprints or the latent space.
ORACLE_SQL = None


def _new(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier thinks good; it learns from the labels of those that are not held out."""
    weights, bias = classifier.quality_model(docs, table(spark, sf_dir, "labels"))
    score = _new("score", docs.columns)
    return classifier.score(docs, weights, bias, tuple(docs.columns), score).filter(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash over three-word shingles, linked at three bits): that with the
    smallest doc_id, null last; of several rows with that doc_id the one with the smallest digest of its columns.
    Only digests and fingerprints meet; the texts are looked up once for the rows that stay."""
    digest = _new("digest", docs.columns)
    rows = docs.withColumn(digest, F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))))
    first = stored(simhash.representatives(rows, ["doc_id", digest]))
    same = rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows[digest] == first[digest])
    return rows.join(first, same, "left_semi").dropDuplicates(["doc_id", digest]).select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: each row by its own verdict."""
    names = {c: _new(c, [*docs.columns, *_OWN]) if c in _OWN else c for c in docs.columns}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    found = decontamination.contamination(renamed, table(spark, sf_dir, "benchmark"), tuple(names.values()))
    return found.filter(~F.col("contaminated")).select(*(F.col(f"`{n}`").alias(c) for c, n in names.items()))


#: What the search adds to the columns of a document.
_OWN = ("contaminated", "item_ids", "best_share", "shares")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms."""
    count = _new("n_values", docs.columns)
    done = pii.pseudonymise(docs, count=count)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in mixed order, with how many of their words it takes (repeats counted)."""
    keep = tuple(c for c in ("text", "lang", "source", "n_chars") if c in docs.columns)
    return mixing.mix(docs, keep=keep).filter("taken > 0")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
