"""Ingest rules, insert-or-ignore by key, and the queue of reviews still to be analysed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_REVIEW_CHARS = 10


def parse_bound(value: str | None, end: bool = False) -> Column:
    """``YYYY-MM-DD`` as a wall-clock time, 23:59:59 for an end bound; null when unreadable."""
    day = F.to_timestamp_ntz(F.lit(value), F.lit("yyyy-MM-dd")) if _is_day(value) else F.lit(None).cast("timestamp_ntz")
    return day + F.expr("interval '23:59:59' hour to second") if end else day


def _is_day(value: str | None) -> bool:
    from datetime import datetime
    try:
        datetime.strptime(value or "", "%Y-%m-%d")
    except ValueError:
        return False
    return True


def rating_ceiling(rating: Column, max_rating: int) -> Column:
    """Ratings above the ceiling are dropped; 0 switches the rule off; no rating counts as 0."""
    return F.lit(True) if not max_rating else F.coalesce(rating, F.lit(0)) <= max_rating


def date_window(date: Column, date_from: str | None, date_to: str | None) -> Column:
    """Both bounds inclusive; rows without a date pass, and so does everything on an unreadable bound."""
    lower, upper = parse_bound(date_from), parse_bound(date_to, end=True)
    return date.isNull() | ((lower.isNull() | (date >= lower)) & (upper.isNull() | (date <= upper)))


def content_rule(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) >= MIN_REVIEW_CHARS


def has_key(key: Column) -> Column:
    return F.coalesce(key, F.lit("")) != ""


def quarantine(raw: DataFrame) -> DataFrame:
    """Rows that pass the content rule but have no key, with the reason."""
    return (raw.filter(content_rule(F.col("content")) & ~has_key(F.col("review_id")))
            .withColumn("reject_reason", F.lit("missing review id")))


def to_reviews(raw: DataFrame) -> DataFrame:
    """Source shape (review_id, user_name, content, score, at, app_version) to ``reviews``.

    A missing column takes its default; a null inside a present column stays, except for rating
    and version.
    """
    def col(name: str, default: Column) -> Column:
        return F.col(name) if name in raw.columns else default

    return raw.select(
        col("review_id", F.lit("")).alias("id"),
        col("user_name", F.lit("Anonim")).alias("username"),
        col("content", F.lit("")).alias("review_text"),
        F.coalesce(col("score", F.lit(0)), F.lit(0)).cast("int").alias("rating"),
        col("at", F.lit(None).cast("timestamp_ntz")).cast("timestamp_ntz").alias("review_date"),
        F.coalesce(col("app_version", F.lit("")), F.lit("")).alias("app_version"),
        *[F.col(c) for c in raw.columns if c in ("scraped_at", "arrival")])


def accepted(raw: DataFrame, max_rating: int = 0, date_from: str | None = None,
             date_to: str | None = None) -> DataFrame:
    """The row rules together, in review shape. One narrow pass; the comparisons reach the scan."""
    return to_reviews(raw.filter(
        rating_ceiling(F.col("score"), max_rating) & date_window(F.col("at"), date_from, date_to)
        & content_rule(F.col("content")) & has_key(F.col("review_id"))))


SORT_COLUMNS = {"newest": "at", "rating": "score", "relevance": "relevance"}


def first_matching(raw: DataFrame, count: int, sort: str = "newest", max_rating: int = 0,
                   date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The first ``count`` rows passing the rules, in source order. All raw rows are considered; the limit is a top-k."""
    order = [F.col(SORT_COLUMNS[sort]).desc(), *[F.col(c) for c in ("review_id", "arrival") if c in raw.columns]]
    kept = raw.filter(
        rating_ceiling(F.col("score"), max_rating) & date_window(F.col("at"), date_from, date_to)
        & content_rule(F.col("content")) & has_key(F.col("review_id")))
    return to_reviews(kept.orderBy(*order).limit(count))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest row per key. Spark turns ``row_number = 1`` into a per-task limit ahead of the
    shuffle, so a key with very many copies sends at most one row per task."""
    w = Window.partitionBy(key).orderBy(F.col(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def new_reviews(incoming: DataFrame, stored: DataFrame | None, arrival: str = "arrival") -> DataFrame:
    """Insert-or-ignore: rows without text or key are ignored, the first row per id is taken, and
    ids already stored are left as they are. Only the key column of the store is read."""
    rows = incoming.filter(F.col("review_text").isNotNull() & has_key(F.col("id")))
    rows = first_per_key(rows, "id", arrival)
    return rows if stored is None else rows.join(stored.select("id"), "id", "left_anti")


def pending(reviews: DataFrame, results: DataFrame) -> DataFrame:
    """Reviews without any result: being analysed is derived, not stored."""
    return reviews.join(results.select(F.col("review_id").alias("id")), "id", "left_anti")


def pending_queue(reviews: DataFrame, results: DataFrame, limit: int = 50) -> DataFrame:
    """The latest-scraped pending reviews, id as tie-breaker, at most ``limit``.

    The anti join and the top-k see keys and times only; the texts are looked up afterwards for
    the rows that were chosen.
    """
    chosen = (pending(reviews.select("id", "scraped_at"), results)
              .orderBy(F.col("scraped_at").desc(), F.col("id")).limit(limit).select("id"))
    return (reviews.join(chosen, "id", "left_semi")
            .orderBy(F.col("scraped_at").desc(), F.col("id")).limit(limit))


def pending_count(reviews: DataFrame, results: DataFrame) -> DataFrame:
    return pending(reviews.select("id"), results).agg(F.count("*").alias("pending_count"))
