"""Training sets from labelled rows, and their exact stratified split and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complaintflow.functions import lexicon as lx
from complaintflow.functions.normalize import TextRules, normalize_text
from complaintflow.functions.text import token_count
from complaintflow.operators.joins import is_small, small_side

TARGETS = {"layer1": "LAYER 1", "layer2": "LAYER 2", "layer3": "LAYER 3"}


def normalized_rows(report: DataFrame, text: str = "text", rules: TextRules = TextRules()) -> DataFrame:
    """Rows with a text, normalised, keeping those with at least one token."""
    df = normalize_text(report.filter(F.col(text).isNotNull()), text, text, rules)
    return df.filter(token_count(F.col(text), squeezed=True) >= 1)


def target_rows(labelled: DataFrame, row_id: str = "row") -> DataFrame:
    """(target, row, text, label) for all targets in one pass; null labels dropped."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"`{c}`").alias("label")) for t, c in TARGETS.items()])
    return (labelled.select(F.col(row_id).alias("row"), "text", F.explode(pairs).alias("p"))
            .select("p.target", "row", "text", "p.label").filter(F.col("label").isNotNull()))


def label_counts(df: DataFrame) -> DataFrame:
    """Rows per class, largest first."""
    return df.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def fold_rare(df: DataFrame, min_count: int = 10, folded: str = lx.RARE_LABEL) -> DataFrame:
    """Classes with fewer than ``min_count`` rows become one class.

    The counts are a map-side combined aggregate, not a window over each class. Only the rare
    labels are joined back, so the side that is looked up never holds a frequent label; counted first,
    few of them are broadcast and no row moves to the task of its class.
    """
    rare = df.groupBy("label").agg(F.count("*").alias("_n")).filter(F.col("_n") < min_count).select("label", F.lit(True).alias("_rare"))
    joined = df.join(small_side(rare, is_small(rare)), "label", "left")
    return joined.select(*[F.when(F.col("_rare"), folded).otherwise(F.col("label")).alias("label") if c == "label"
                           else F.col(c) for c in df.columns])


def set_sizes(targets: DataFrame) -> DataFrame:
    """Row and class counts per target; classes are counted over the small per-label table."""
    per_label = targets.groupBy("target", "label").agg(F.count("*").alias("n"))
    return per_label.groupBy("target").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_classes"))


def negative_only(labelled: DataFrame, row_id: str = "row") -> DataFrame:
    """The sentiment set of a complaint report: every text is negative."""
    return labelled.select(F.col(row_id).alias("row"), "text", F.lit(lx.NEG_LABEL).alias("label"))


def label_index(df: DataFrame) -> DataFrame:
    """(label, index) in sorted order. Only the distinct labels are ordered, one row per class."""
    position = F.row_number().over(Window.orderBy("label")) - 1
    return df.select("label").distinct().select("label", position.alias("index"))


def stratified_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, slices: int = 4096) -> DataFrame:
    """Adds ``part`` (``train`` / ``test``): per class exactly ``round(share * n)`` test rows, those with
    the smallest hash of ``key``; a class of one stays in train.

    Ranking a whole class in one window would put the largest class into one task. Instead the
    hash range is cut into slices; the row counts per (class, slice) tell which slice holds the
    last test row, and only that slice is ranked, to find the last hash that is still in test.
    """
    prefix = F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    hashed = hashed.withColumn("_slice", F.floor(prefix * slices / 65536).cast("int"))
    counts = hashed.groupBy("label", "_slice").agg(F.count("*").alias("n"))
    per_class = counts.groupBy("label").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("_slice", "n"))).alias("slices"))
    per_class = per_class.withColumn("quota", F.when(
        F.col("total") > 1, F.round(F.col("total") * test_share)).otherwise(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("seen"), F.lit(-1).alias("cut"), zero.alias("rest"))

    def walk(s, x):
        reached = (s["cut"] < 0) & (s["seen"] + x["n"] >= F.col("quota"))
        return F.struct((s["seen"] + x["n"]).alias("seen"),
                        F.when(reached, x["_slice"]).otherwise(s["cut"]).alias("cut"),
                        F.when(reached, F.col("quota") - s["seen"]).otherwise(s["rest"]).alias("rest"))

    cuts = (per_class.filter("quota > 0").select("label", F.aggregate("slices", start, walk).alias("c"))
            .select("label", F.col("c.cut").alias("_slice"), F.col("c.rest").alias("_rest")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_h", key))
    last = (hashed.select("label", "_slice", "_h", key).join(cuts, ["label", "_slice"])
            .withColumn("_rank", rank).filter(F.col("_rank") == F.col("_rest"))
            .select("label", F.struct("_h", F.col(key).alias("_key")).alias("_last")))
    # one row a class; where classes are few, no row moves to the task of its class
    placed = hashed.join(small_side(last, is_small(df.select("label").distinct())), "label", "left")
    in_test = F.coalesce(F.struct("_h", F.col(key).alias("_key")) <= F.col("_last"), F.lit(False))
    return placed.select(*df.columns, F.when(in_test, "test").otherwise("train").alias("part"))


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weights n / (k * n_c) per class, from one aggregate; the totals are scalars over the
    per-class table."""
    counts = train.groupBy("label").agg(F.count("*").alias("n"))
    total, classes = (counts.agg(x).scalar() for x in (F.sum("n"), F.count("*")))
    weight = total / (classes * F.col("n"))
    return counts.select("label", "n", weight.alias("weight"))


def weighted(train: DataFrame) -> DataFrame:
    """Training rows with their class weight in ``weight``."""
    return train.join(small_side(class_weights(train).select("label", "weight"), is_small(train.select("label").distinct())), "label")
