"""Human labels against the taxonomy: exact, then fuzzy, then scored, then left for manual review.

Everything runs on the distinct label tuples, which are few next to the rows, and is joined back
once. Options come from equality joins on the path, so candidates never meet outside their path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complaintflow.functions.labels import clean_label
from complaintflow.functions.similarity import block_ratio
from complaintflow.functions.text import strip
from complaintflow.operators.taxonomy import Taxonomy

FUZZY_CUTOFF = 0.72
EMPTY, NO_OPTIONS, EXACT, FUZZY = "empty", "no_hierarchy_options", "exact", "fuzzy"
SCORED, MANUAL = "llm_zeroshot", "NEEDS_MANUAL_REVIEW"
LAYER_COLUMNS = [f"LAYER {i}" for i in range(1, 6)]


def closest_by_edits(label: Column, options: Column) -> Column:
    """Best option by one minus edit distance over the longer length; the larger text on ties."""
    ranked = F.transform(options, lambda o: F.struct(
        (1 - F.levenshtein(label, o) / F.greatest(F.length(label), F.length(o))).alias("score"), o.alias("option")))
    top = F.array_max(F.filter(ranked, lambda r: r["score"] >= FUZZY_CUTOFF))
    return F.struct(top["option"].alias("option"), top["score"].alias("score"))


def closest_by_blocks(label: Column, options: Column) -> Column:
    """Best option by the matching-block ratio; the larger text on ties."""
    ranked = F.transform(options, lambda o: F.struct(block_ratio(o, label, FUZZY_CUTOFF).alias("score"), o.alias("option")))
    top = F.array_max(F.filter(ranked, lambda r: r["score"] >= FUZZY_CUTOFF))
    return F.struct(top["option"].alias("option"), top["score"].alias("score"))


def label_score_maps(label_scores: DataFrame) -> DataFrame:
    """(label, option, score) rows as one map per label; one score per pair is kept."""
    once = label_scores.groupBy("label", "option").agg(F.max("score").alias("score"))
    return once.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("option", "score"))).alias("_scores"))


def _level(df: DataFrame, level: int, closest, maps: DataFrame | None) -> DataFrame:
    """Adds ``m<level>``, ``method<level>``, ``score<level>`` for cleaned label ``c<level>`` and the
    array ``options``, which is dropped."""
    label, options = F.col(f"c{level}"), F.col("options")
    open_case = label.isNotNull() & (F.size(options) > 0) & ~F.array_contains(options, label)
    plain = [c for c in df.columns if c != "options"]
    df = df.select("*", closest(F.when(open_case, label), options).alias("_fuzzy"))
    fuzzy = F.col("_fuzzy.option").isNotNull()
    scored: Column = F.lit(None).cast("struct<score:double,first:int,option:string>")
    if maps is not None:
        df = df.join(maps.withColumnRenamed("label", f"c{level}"), f"c{level}", "left")
        ranked = F.transform(options, lambda o, i: F.struct(
            F.col("_scores")[o].alias("score"), (-i).alias("first"), o.alias("option")))
        scored = F.array_max(F.filter(ranked, lambda r: r["score"].isNotNull()))
    df = df.select(*plain, "options", "_fuzzy", scored.alias("_scored"))
    method = (
        F.when(label.isNull(), EMPTY).when(F.size(options) == 0, NO_OPTIONS)
        .when(F.array_contains(options, label), EXACT).when(fuzzy, FUZZY)
        .when(F.col("_scored").isNotNull(), SCORED).otherwise(MANUAL))
    df = df.select(*plain, "_fuzzy", "_scored", method.alias(f"method{level}"))
    m = F.col(f"method{level}")
    return df.select(
        *plain, f"method{level}",
        F.when(m == FUZZY, F.col("_fuzzy.option")).when(m == SCORED, F.col("_scored.option"))
        .otherwise(label).alias(f"m{level}"),
        F.when(m == EXACT, 1.0).when(m == FUZZY, F.round("_fuzzy.score", 3))
        .when(m == SCORED, F.round("_scored.score", 3)).otherwise(0.0).alias(f"score{level}"))


def reconcile_tuples(tuples: DataFrame, taxonomy: Taxonomy, closest=closest_by_blocks,
                     label_scores: DataFrame | None = None) -> DataFrame:
    """Distinct raw tuples ``raw1..raw5`` with ``c1, c2`` and, per level 3 to 5, match, method and
    score. Each level uses the reconciled parent."""
    maps = None if label_scores is None else label_score_maps(label_scores)
    df = tuples.select("*", *[clean_label(F.col(f"raw{i}")).alias(f"c{i}") for i in range(1, 6)])
    df = df.withColumns({"l1": F.col("c1"), "l2": F.col("c2")})
    for level in (3, 4, 5):
        df = taxonomy.with_options(df, level)
        if level > 3:
            # without every parent there are no options, not even by the parent label alone
            parents = F.lit(True)
            for i in range(1, level):
                parents = parents & F.col(f"l{i}").isNotNull()
            df = df.withColumn("options", F.when(parents, F.col("options")).otherwise(
                F.array().cast("array<string>"))).drop("path_missing", "ambiguous")
        df = _level(df, level, closest, maps).withColumn(f"l{level}", F.col(f"m{level}"))
    return df.drop("l1", "l2", "l3", "l4", "l5", "c3", "c4", "c5")


def reconcile(report: DataFrame, taxonomy: Taxonomy, row_id: str = "row", closest=closest_by_blocks,
              label_scores: DataFrame | None = None) -> DataFrame:
    """Every report row with its raw labels and the reconciled ones of its tuple."""
    raw = report.select(row_id, *[c for c in report.columns if c not in (row_id, *LAYER_COLUMNS)],
                        *[F.col(f"`{c}`").alias(f"raw{i}") for i, c in enumerate(LAYER_COLUMNS, 1)])
    keys = [f"raw{i}" for i in range(1, 6)]
    tuples = reconcile_tuples(raw.select(*keys).distinct(), taxonomy, closest, label_scores)
    right = tuples.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in tuples.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return raw.join(right, same).drop(*[f"_{k}" for k in keys])


def reconciled_report(rows: DataFrame) -> DataFrame:
    """The wide report with the reconciled labels in the layer columns."""
    extra = [c for c in rows.columns if not c.startswith(("raw", "c1", "c2", "m", "score"))]
    return rows.select(*extra, F.col("c1").alias("LAYER 1"), F.col("c2").alias("LAYER 2"),
                       *[F.col(f"m{i}").alias(f"LAYER {i}") for i in (3, 4, 5)])


def open_labels(rows: DataFrame, row_id: str = "row") -> DataFrame:
    """The reconcile report: one line per row and layer that was neither exact nor empty."""
    # a missing name prints as None inside the path text
    name = {1: "c1", 2: "c2", 3: "m3", 4: "m4"}
    lines = [F.struct(
        F.lit(f"L{i}").alias("layer"), strip(F.col(f"raw{i}")).alias("raw"), F.col(f"m{i}").alias("matched"),
        F.col(f"method{i}").alias("method"), F.col(f"score{i}").alias("score"),
        F.concat_ws(">", *[F.coalesce(name[j], F.lit("None")) for j in range(1, i)]).alias("context"))
        for i in (3, 4, 5)]
    long = rows.select(F.col(row_id).alias("row"), F.explode(F.array(*lines)).alias("line"))
    return long.select("row", "line.*").filter(~F.col("method").isin(EXACT, EMPTY))


def method_breakdown(report: DataFrame) -> DataFrame:
    return report.groupBy("method").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "method")


def manual_review(report: DataFrame) -> DataFrame:
    return report.filter(F.col("method") == MANUAL)
