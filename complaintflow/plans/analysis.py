"""The gated analysis: one narrow plan from review text to the complaint record.

Without model scores the plan has no shuffle at all: projections and two lookups into the
(size-checked) taxonomy. With scores there is one join on the review key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complaintflow.functions import lexicon as lx
from complaintflow.functions.classify import keyword_confidence, keywords_found, layer1_vote, layer3_vote
from complaintflow.functions.normalize import TextRules, normalize_text
from complaintflow.functions.sentiment import SentimentRules, score_sentiment
from complaintflow.functions.text import fence, strip, token_count
from complaintflow.operators.scoring import overlay_labels, per_review
from complaintflow.operators.taxonomy import Taxonomy
from complaintflow.schemas import RECORD_COLUMNS

MIN_INPUT_CHARS = 5


@dataclass(frozen=True)
class Rules:
    text: TextRules = field(default_factory=TextRules)
    sentiment: SentimentRules = field(default_factory=SentimentRules)


def with_sentiment(df: DataFrame, text: str = "review_text", rules: Rules = Rules(),
                   model: str | None = None) -> DataFrame:
    """Adds ``normalized`` and the sentiment columns."""
    df = normalize_text(df, text, "normalized", rules.text)
    return score_sentiment(df, "normalized", rules.sentiment, model, squeezed=True)


def rescued(rating: Column, sentiment: Column, explicit: Column) -> Column:
    """A high rating over a negative reading without an explicit complaint."""
    return (sentiment == lx.NEG_LABEL) & (F.coalesce(rating, F.lit(0)) >= 4) & ~explicit


def misread_star(rating: Column, complaint: Column, strong: Column, explicit: Column) -> Column:
    """A low rating over a text that only praises."""
    return complaint & (F.coalesce(rating, F.lit(9)) <= 2) & strong & ~explicit


def with_layers(df: DataFrame, text: str = "normalized", where: Column | None = None) -> DataFrame:
    """Adds the keyword labels layer1..3, ``class_confidence`` and ``class_source``; the votes are
    only counted where ``where`` holds."""
    low = F.lower(F.col(text))
    df = df.select("*", (low if where is None else F.when(where, low)).alias("_low"))
    hits = keywords_found(F.col("_low"))
    df = df.select("*", F.when(F.col("_low").isNotNull(), hits).alias("_hits"))
    df = df.select("*", layer3_vote(F.col("_hits")).alias("_v3"), layer1_vote(F.col("_hits")).alias("_v1"))
    return df.select(
        "*", F.col("_v1.label").alias("layer1"), F.lit(lx.DEFAULT_L2).alias("layer2"),
        F.col("_v3.label").alias("layer3"), keyword_confidence(F.col("_v3.hits")).alias("class_confidence"),
        F.lit(lx.SOURCE_KEYWORD).alias("class_source")).drop("_v1", "_v3", "_hits", "_low")


def escalates(l1: Column, words: Column) -> Column:
    """Lower levels are looked up for a known, not general, first level and three words or more."""
    return (F.coalesce(l1, F.lit("")) != "") & ~F.contains(F.upper(l1), F.lit(lx.GENERAL)) & (words >= 3)


def analyze(reviews: DataFrame, taxonomy: Taxonomy, scores: DataFrame | None = None,
            rules: Rules = Rules(), text: str = "review_text", key: str = "id",
            columns: Sequence[str] | None = None, by_review: bool = False) -> DataFrame:
    """``reviews`` plus the 17 record columns, or only ``columns``, and then nothing else is computed. Needs ``rating``
    (int, nullable). Reviews and scores that are both stored ``by_review`` (``sources.bucketed``) are merged without any
    exchange."""
    keep = [c for c in reviews.columns if c not in RECORD_COLUMNS]
    df = reviews.select(*keep)
    model = l4_scores = l5_scores = None
    if scores is not None:
        lower = taxonomy.labels(4).unionByName(taxonomy.labels(5))
        wide = per_review(scores, lower, by_review).withColumnRenamed("review_id", key)
        df = df.join(wide, key, "left")
        model, l4_scores, l5_scores = "sentiment_top", "layer4_scores", "layer5_scores"

    df = with_sentiment(df, text, rules, model)
    rating, sentiment = F.col("rating"), F.col("sentiment")
    strong, explicit = F.col("strong_positive"), F.col("explicit_negative")
    df = df.withColumn("_rescued", rescued(rating, sentiment, explicit))
    df = df.withColumn("is_complaint", (sentiment == lx.NEG_LABEL) & ~F.col("_rescued"))
    df = df.withColumn("_misread", misread_star(rating, F.col("is_complaint"), strong, explicit))

    df = with_layers(df, where=F.col("is_complaint"))
    if scores is not None:
        df = overlay_labels(df)
    complaint, misread = F.col("is_complaint"), F.col("_misread")
    df = df.withColumn("escalated", complaint & ~misread & escalates(
        F.col("layer1"), token_count(F.col("normalized"), squeezed=True)))
    df = taxonomy.pick_lower_levels(df, F.col("escalated"), l4_scores, l5_scores)

    def layer(i: int, general: str) -> Column:
        return F.when(misread, general).when(complaint, F.col(f"layer{i}")).otherwise("")

    df = df.select(*[c for c in df.columns if c not in ("layer1", "layer2", "layer3")],
                   F.col("layer1").alias("_l1"), F.col("layer3").alias("_l3"),
                   layer(1, lx.GENERAL).alias("layer1"), layer(2, lx.GENERAL).alias("layer2"),
                   layer(3, lx.MISREAD_STAR).alias("layer3"))
    sconf, cconf = F.col("sentiment_confidence"), F.col("class_confidence")
    stars = F.concat(F.lit("Rating "), rating.cast("string"), F.lit("★ "))
    reason = (
        F.when(F.col("_rescued"), F.concat(stars, F.lit(
            lx.REASON_RESCUED)))
        .when(~complaint, F.concat(sentiment, F.lit(lx.REASON_NO_COMPLAINT)))
        .when(misread, F.concat(stars, F.lit(
            lx.REASON_MISREAD)))
        .otherwise(F.concat(F.lit(lx.REASON_COMPLAINT), F.col("_l1"), F.lit(" > "), F.col("_l3"),
                            F.when(F.col("layer4") != "", F.concat(F.lit(" > "), F.col("layer4"))).otherwise(""))))
    record = df.select(
        *keep,
        F.col("normalized"),
        F.when(F.col("_rescued"), lx.POS_LABEL).otherwise(sentiment).alias("sentiment"),
        F.round(sconf, 3).alias("sentiment_confidence"),
        F.when(F.col("_rescued"), F.concat("sentiment_source", F.lit(lx.RESCUE_SUFFIX)))
        .otherwise(F.col("sentiment_source")).alias("sentiment_source"),
        F.col("layer1").alias("category"), F.col("layer3").alias("subcategory"),
        F.when(misread, 0.85).when(complaint, F.round(cconf, 3)).otherwise(0.0).alias("classification_confidence"),
        *[F.col(f"layer{i}") for i in range(1, 6)], "quality_param", "escalated", "is_complaint",
        F.when(misread, F.round(F.least(sconf, F.lit(0.85)), 3)).when(complaint, F.round(F.least(sconf, cconf), 3))
        .otherwise(F.round(sconf, 3)).alias("confidence"),
        reason.alias("reason"))
    if columns is not None:
        record = record.select(*columns)
    return fence(record, *[c for c in RECORD_COLUMNS if c != "normalized" and c in record.columns])


def long_enough(text: Column) -> Column:
    """The smallest input the one-text analysis accepts."""
    return F.length(strip(F.coalesce(text, F.lit("")))) >= MIN_INPUT_CHARS


def batch_summary(results: DataFrame, error: str = "error") -> DataFrame:
    """Counts of one analysis batch; failed rows carry an error text and are not complaints."""
    failed = F.col(error).isNotNull()
    return results.agg(F.count_if(~failed).alias("ok"),
                       F.count_if(~failed & F.col("is_complaint")).alias("complaints"),
                       F.count_if(failed).alias("errors"))
