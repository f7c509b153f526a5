"""Queries over stored results: dashboard, lists, drill-down, pages, export and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_COLUMNS = [
    "normalized_text", "sentiment", "sentiment_confidence", "is_complaint", "category", "subcategory",
    "classification_confidence", "reason", "escalated", "layer1", "layer2", "layer3", "layer4", "layer5",
    "quality_param", "analyzed_at",
]
# Texts and headings of the export.
FLAGGED_TEXT = "Flagged - Salah Klasifikasi"
YES, NO = "Ya", "Tidak"
EXPORT_HEADERS = {
    "username": "Username", "review_text": "Review Text", "rating": "Rating", "review_date": "Review Date",
    "sentiment": "Sentiment", "sentiment_confidence": "Confidence (%)", "layer1": "Layer 1", "layer2": "Layer 2",
    "layer3": "Layer 3", "layer4": "Layer 4", "layer5": "Layer 5", "quality_param": "Quality Parameter",
    "reason": "Reason", "escalated": "Escalated", "analyzed_at": "Analyzed At", "flag_status": "Flag Status",
    "flag_note": "Flag Note",
}


# --------------------------------------------------------------------------- dashboard
def totals(reviews: DataFrame, results: DataFrame) -> DataFrame:
    """Review, result, complaint and escalation counts: one pass per table, joined as a scalar."""
    n_reviews = reviews.agg(F.count("*").alias("n")).scalar()
    return results.agg(
        F.count("*").alias("total_analyzed"), F.count_if("is_complaint").alias("total_complaints"),
        F.count_if("escalated").alias("escalated_count")).withColumn("total_reviews", n_reviews)


#: How results are counted, in SQL; rows that stand for several results are summed instead.
ROWS = "count(*)"


def sentiment_distribution(results: DataFrame, count: str = ROWS) -> DataFrame:
    return results.groupBy("sentiment").agg(F.expr(count).alias("n"))


def category_distribution(results: DataFrame, count: str = ROWS) -> DataFrame:
    return (results.filter("is_complaint").groupBy("category").agg(F.expr(count).alias("n"))
            .filter(F.coalesce("category", F.lit("")) != "").orderBy(F.desc("n"), "category"))


def average_rating(reviews: DataFrame, results: DataFrame) -> DataFrame:
    """Mean rating over the review-result join, re-analysed reviews weighing more; 0 without rows.

    Results are counted per review before the join, so a review analysed very often is one row there.
    """
    times = results.groupBy(F.col("review_id").alias("id")).agg(F.count("*").alias("n"))
    joined = reviews.select("id", "rating").join(times, "id")
    weight = F.when(F.col("rating").isNotNull(), F.col("n"))
    mean = F.sum(F.col("rating").cast("long") * F.col("n")).cast("double") / F.sum(weight)
    return joined.agg(F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("avg_rating"))


# --------------------------------------------------------------------------- result lists
def current_flags(flag_events: DataFrame) -> DataFrame:
    """The last flag event per result. An unflag clears the time but keeps the note given with it."""
    last = F.max_by(F.struct("flagged", "note", "flagged_at"), F.struct("flagged_at", "flagged", "note"))
    return flag_events.groupBy("result_id").agg(last.alias("f")).select(
        "result_id", F.col("f.flagged").alias("flagged"),
        F.nullif(F.trim(F.col("f.note")), F.lit("")).alias("flag_note"),
        F.when(F.col("f.flagged"), F.col("f.flagged_at")).alias("flagged_at"))


def unknown_flags(flag_events: DataFrame, results: DataFrame) -> DataFrame:
    """Flag events for results that do not exist."""
    return flag_events.join(results.select("result_id"), "result_id", "left_anti")


def result_feed(reviews: DataFrame, results: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """The 25-column view over results, reviews and current flags behind lists and exports.

    Flags are joined before the review texts, so the texts take part in one join only.
    """
    feed = results.select("result_id", "review_id", *RESULT_COLUMNS)
    if flags is None:
        feed = feed.select("*", F.lit(False).alias("flagged"), F.lit(None).cast("string").alias("flag_note"),
                           F.lit(None).cast("timestamp_ntz").alias("flagged_at"))
    else:
        feed = feed.join(flags, "result_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    r = reviews.select(F.col("id").alias("review_id"), "username", "review_text", "rating", "review_date")
    return feed.join(r, "review_id").select(
        "result_id", "review_id", "username", "review_text", "rating", "review_date",
        *RESULT_COLUMNS, "flagged", "flag_note", "flagged_at")


def filtered(feed: DataFrame, **equal: object) -> DataFrame:
    """Equality on each given column (sentiment, category, layer1..5, rating); empty means no filter."""
    for name, value in equal.items():
        if value:
            feed = feed.filter(F.col(name) == F.lit(int(value) if name == "rating" else value))
    return feed


def recent_results(reviews: DataFrame, results: DataFrame, flags: DataFrame | None = None, limit: int = 50,
                   **equal: object) -> DataFrame:
    """The newest results under the filters, at most ``limit``, in the shape of ``result_feed``.

    The top-k runs over keys and filter columns; texts and flags are looked up for the chosen
    results only.
    """
    by_result = {n: x for n, x in equal.items() if n != "rating"}
    narrow = filtered(results, **by_result).select("result_id", "review_id", "analyzed_at")
    rated = filtered(reviews, rating=equal.get("rating")).select(F.col("id").alias("review_id"))
    chosen = (narrow.join(rated, "review_id", "left_semi")
              .orderBy(F.col("analyzed_at").desc(), F.col("result_id")).limit(limit))
    rows = results.join(chosen.select("result_id"), "result_id", "left_semi")
    wanted = reviews.join(chosen.select(F.col("review_id").alias("id")), "id", "left_semi")
    return (result_feed(wanted, rows, flags).orderBy(F.col("analyzed_at").desc(), F.col("result_id"))
            .limit(limit))


def all_results(feed: DataFrame, sentiment: str | None = None, layer1: str | None = None) -> DataFrame:
    return filtered(feed, sentiment=sentiment, layer1=layer1)


def export_table(feed: DataFrame, sentiment: str | None = None, layer1: str | None = None) -> DataFrame:
    """The 17 export columns: yes/no and flag texts, confidence as a percentage."""
    rows = all_results(feed, sentiment, layer1).select(
        *[c for c in feed.columns if c not in ("escalated", "sentiment_confidence")],
        F.when(F.col("escalated"), YES).otherwise(NO).alias("escalated"),
        F.round(F.coalesce("sentiment_confidence", F.lit(0.0)) * 100, 1).alias("sentiment_confidence"),
        F.when(F.col("flagged"), FLAGGED_TEXT).otherwise("").alias("flag_status"))
    return rows.select(*[F.col(c).alias(h) for c, h in EXPORT_HEADERS.items()])


# --------------------------------------------------------------------------- drill-down
#: What the drill-down needs of an analysis.
DRILL_COLUMNS = ["is_complaint", "subcategory", "layer1", "layer2", "layer3"]


def drill_down(results: DataFrame, count: str = ROWS) -> DataFrame:
    """Complaint counts per layer1, (layer1, layer2) and (layer1, layer2, layer3): ``level`` 1 to 3.

    The rows are grouped once at the finest level; the coarser levels roll up that small table.
    """
    def named(*cols: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit("Umum"))

    finest = results.filter("is_complaint").groupBy(
        named("layer1").alias("l1"), named("layer2").alias("l2"), named("layer3", "subcategory").alias("l3")
    ).agg(F.expr(count).alias("n"))
    rolled = finest.rollup("l1", "l2", "l3").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, 3).when(F.col("g") == 1, 2).otherwise(1)
    return (rolled.filter("g < 7").select(level.alias("level"), "l1", "l2", "l3", "n")
            .orderBy("level", F.desc("n"), "l1", "l2", "l3"))


def drill_down_lists(levels: DataFrame) -> DataFrame:
    """Nested form: per level and parent path the children with counts, largest first."""
    label = F.coalesce(F.when(F.col("level") == 3, F.col("l3")).when(F.col("level") == 2, F.col("l2")), F.col("l1"))
    parent = F.when(F.col("level") == 3, F.concat_ws("||", "l1", "l2")).when(F.col("level") == 2, F.col("l1")).otherwise("")
    entry = F.struct((-F.col("n")).alias("k"), F.col("label"), F.col("n"))
    return (levels.select("level", parent.alias("parent"), label.alias("label"), "n")
            .groupBy("level", "parent").agg(F.sort_array(F.collect_list(entry)).alias("e"))
            .select("level", "parent", F.transform("e", lambda x: F.struct(
                x["label"].alias("label"), x["n"].alias("count"))).alias("entries")))


# --------------------------------------------------------------------------- raw review pages
def search(text: Column, term: str) -> Column:
    """Case-insensitive containment in which ``%`` and ``_`` of the term are wildcards and nothing escapes them."""
    pattern = term.replace("\\", "\\\\")
    return text.ilike(f"%{pattern}%")


def display_date(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("-"))


def raw_reviews(reviews: DataFrame, results: DataFrame, rating: int | None = None, term: str = "",
                analyzed: bool | None = None) -> DataFrame:
    """Reviews under the page filters. Being analysed is derived from the results."""
    rows = reviews.select("id", "username", "review_text", "rating", "review_date")
    if rating:
        rows = rows.filter(F.col("rating") == int(rating))
    if term:
        rows = rows.filter(search(F.col("review_text"), term))
    if analyzed is not None:
        done = results.select(F.col("review_id").alias("id"))
        rows = rows.join(done, "id", "left_semi" if analyzed else "left_anti")
    return rows


def raw_page(reviews: DataFrame, results: DataFrame, page: int = 1, per_page: int = 25, rating: int | None = None,
             term: str = "", analyzed: bool | None = None) -> DataFrame:
    """One page, newest first with the id as tie-breaker, plus ``analyzed``, total and pages.

    The total is a scalar subquery over the same filters, not a window over all rows, and the
    ``analyzed`` mark is looked up for the rows of the page only.
    """
    page = max(page, 1)
    rows = raw_reviews(reviews, results, rating, term, analyzed)
    total = rows.agg(F.count("*").alias("n")).scalar()
    shown = (rows.orderBy(F.col("review_date").desc(), F.col("id"))
             .offset((page - 1) * per_page).limit(per_page))
    done = results.select(F.col("review_id").alias("id")).join(shown.select("id"), "id", "left_semi")
    marked = shown.join(done.distinct().withColumn("analyzed", F.lit(True)), "id", "left").withColumn("total", total)
    return marked.select(
        "id", "username", "review_text", "rating", "review_date", F.coalesce("analyzed", F.lit(False)).alias("analyzed"),
        display_date(F.col("review_date")).alias("shown_date"), "total",
        F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long").alias("total_pages"))
