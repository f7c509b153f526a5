"""The five-level taxonomy: option sets per full path, leaf fallbacks, parameters, picks."""

from __future__ import annotations

from functools import cached_property


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complaintflow.functions.text import fence, lookup
from complaintflow.operators.joins import is_small, small_side

LEVELS = ["l1", "l2", "l3", "l4", "l5"]
MAX_LITERAL_ROWS = 20_000


def _filled(*names: str) -> Column:
    """All of the columns hold a text; missing and empty count alike."""
    cond = F.lit(True)
    for n in names:
        cond = cond & (F.coalesce(F.col(n), F.lit("")) != "")
    return cond


def _path_key(*names: str) -> Column:
    """One text for a path; null where a part is missing."""
    return F.concat(*[c for n in names for c in (F.col(n), F.lit("\x1f"))])


def _path_text(path: tuple) -> str:
    return "".join(f"{x}\x1f" for x in path)


class Taxonomy:
    """Derived tables over rows ``(ord, l1..l5, param)``; ``ord`` is the source order.

    The option tables hold one row per path, so every lookup is an equality join.
    """

    def __init__(self, rows: DataFrame, literal_rows: int = MAX_LITERAL_ROWS):
        self.rows = rows
        self.literal_rows = literal_rows

    @cached_property
    def small(self) -> bool:
        return is_small(self.rows)

    @cached_property
    def literal(self) -> bool:
        """Whether the taxonomy is small enough to be part of the plan; rows and bytes are counted before any is brought in."""
        return self.literal_rows > 0 and is_small(self.rows, self.literal_rows)

    @cached_property
    def _literals(self) -> dict:
        """Options and parameters of a small taxonomy as lookups: by full path, and by the last label alone."""
        options: dict[int, dict] = {4: {}, 5: {}}
        leaf_options: dict[int, dict] = {4: {}, 5: {}}
        param: dict[str, str] = {}
        leaf_param: dict[str, str] = {}
        for r in sorted(self.rows.select("ord", *LEVELS, "param").collect(), key=lambda r: r["ord"]):
            path = tuple(r[c] for c in LEVELS)
            for depth in (4, 5):
                if all(path[:depth]):
                    options[depth].setdefault(_path_text(path[: depth - 1]), set()).add(path[depth - 1])
                    leaf_options[depth].setdefault(path[depth - 2], set()).add(path[depth - 1])
            if all(path) and r["param"]:
                param[_path_text(path)] = leaf_param[path[4]] = r["param"]
        array = "array<string>"
        sets = lambda x: lookup({k: sorted(v) for k, v in x.items()}, array)
        return {4: (sets(options[4]), sets(leaf_options[4])), 5: (sets(options[5]), sets(leaf_options[5])),
                "param": (lookup(param), lookup(leaf_param))}

    # ----------------------------------------------------------------- option sets
    def options(self, level: int) -> DataFrame:
        """Children at ``level`` (3, 4 or 5) per full parent path, sorted."""
        parents, child = LEVELS[: level - 1], LEVELS[level - 1]
        return self._grouped(parents, parents, child)

    def leaf_options(self, level: int) -> DataFrame:
        """Children at ``level`` (4 or 5) per bare parent label, over all branches, sorted."""
        return self._grouped(LEVELS[: level - 1], [LEVELS[level - 2]], LEVELS[level - 1])

    def _grouped(self, required: list[str], keys: list[str], child: str) -> DataFrame:
        pairs = self.rows.filter(_filled(*required, child)).select(*keys, child).distinct()
        return pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(child)).alias("options"))

    # ----------------------------------------------------------------- parameters
    def parameters(self) -> DataFrame:
        """Quality parameter per full five-part path; the last source row wins."""
        return self._last_parameter(LEVELS)

    def leaf_parameters(self) -> DataFrame:
        return self._last_parameter(["l5"])

    def _last_parameter(self, keys: list[str]) -> DataFrame:
        rows = self.rows.filter(_filled(*LEVELS, "param"))
        return rows.groupBy(*keys).agg(F.max_by("param", "ord").alias("param"))

    # ----------------------------------------------------------------- label lists
    def ambiguous(self, level: int) -> DataFrame:
        """Labels at ``level`` (3 or 4) that occur below more than one parent path."""
        parents, child = LEVELS[: level - 1], LEVELS[level - 1]
        pairs = self.rows.filter(_filled(*parents, child)).select(*parents, child).distinct()
        return (pairs.groupBy(F.col(child).alias("label")).agg(F.count("*").alias("n_paths"))
                .filter("n_paths > 1"))

    def labels(self, level: int) -> DataFrame:
        """Distinct labels: any row counts at levels 1 and 2."""
        col = LEVELS[level - 1]
        return self.rows.filter(_filled(col)).select(F.col(col).alias("label")).distinct()

    def labels_with_children(self, level: int) -> DataFrame:
        """Labels at ``level`` (3 or 4) that have at least one child on a complete path.

        The source program's accessor for level 3 is named after level 4, and the one for
        level 4 after level 5; here the name says what is returned.
        """
        col = LEVELS[level - 1]
        return self.rows.filter(_filled(*LEVELS[: level + 1])).select(F.col(col).alias("label")).distinct()

    # ----------------------------------------------------------------- lookups over many paths
    def _side(self, derived: DataFrame) -> DataFrame:
        """A derived table as the looked-up side; one of few rows is broadcast even if the taxonomy is large, so that rows
        don't meet by one of a few labels."""
        return small_side(derived, self.small or is_small(derived))

    def with_options(self, df: DataFrame, level: int, out: str = "options") -> DataFrame:
        """Adds the options for the path in the columns l1.. of ``df``: by full path, else by the
        parent label alone (levels 4 and 5), with ``path_missing`` and ``ambiguous`` as warnings."""
        keys = LEVELS[: level - 1]
        exact = self.options(level).withColumnRenamed("options", "_exact")
        df = df.join(self._side(exact), keys, "left")
        empty = F.array().cast("array<string>")
        if level == 3:
            return df.withColumn(out, F.coalesce("_exact", empty)).drop("_exact")
        parent = LEVELS[level - 2]
        leaf = self.leaf_options(level).withColumnRenamed("options", "_leaf")
        shared = self.ambiguous(level - 1).select(F.col("label").alias(parent), F.lit(True).alias("_shared"))
        leaf = leaf.join(shared, parent, "left")
        df = df.join(self._side(leaf), parent, "left")
        used_leaf = F.col("_exact").isNull() & F.col("_leaf").isNotNull()
        return df.select(
            *[c for c in df.columns if c not in ("_exact", "_leaf", "_shared", out)],
            F.coalesce("_exact", "_leaf", empty).alias(out),
            used_leaf.alias("path_missing"),
            (used_leaf & F.coalesce("_shared", F.lit(False))).alias("ambiguous"))

    def with_parameter(self, df: DataFrame, out: str = "param") -> DataFrame:
        """Adds the parameter: by full path, else by the level-5 label alone, else empty."""
        exact = self.parameters().withColumnRenamed("param", "_exact")
        leaf = self.leaf_parameters().withColumnRenamed("param", "_leaf")
        df = df.join(self._side(exact), LEVELS, "left").join(self._side(leaf), "l5", "left")
        return df.select(*[c for c in df.columns if c not in ("_exact", "_leaf", out)],
                         F.coalesce("_exact", "_leaf", F.lit("")).alias(out))

    # ----------------------------------------------------------------- level 4 and 5
    def pick_lower_levels(self, df: DataFrame, eligible: Column, l4_scores: str | None = None,
                          l5_scores: str | None = None) -> DataFrame:
        """Adds ``layer4``, ``layer5`` and ``quality_param`` for the columns layer1..3: the best-scored
        option of the path, the first one without scores, blanks without options or eligibility.

        Options come by full path, else by the parent label alone; each list is kept once. ``l4_scores`` and
        ``l5_scores`` name map columns option -> score. A taxonomy of up to ``literal_rows`` rows is a lookup
        inside the projection; a larger one is joined, for the eligible rows' paths only.
        """
        plain = df.columns
        df = df.select(*plain, *[F.when(eligible, F.col(f"layer{i}")).alias(f"_k{i}") for i in (1, 2, 3)])
        df = self._found(df, ["_k1", "_k2", "_k3"], 4, "_o4")
        df = df.withColumn("_k4", best_option(F.col("_o4"), l4_scores)).drop("_o4")
        df = self._found(df, ["_k1", "_k2", "_k3", "_k4"], 5, "_o5")
        df = df.withColumn("_k5", best_option(F.col("_o5"), l5_scores)).drop("_o5")
        df = self._found(df, ["_k1", "_k2", "_k3", "_k4", "_k5"], "param", "_p")
        keep = [c for c in plain if c not in ("layer4", "layer5", "quality_param")]
        return df.select(*keep, F.coalesce("_k4", F.lit("")).alias("layer4"), F.coalesce("_k5", F.lit("")).alias("layer5"),
                         F.coalesce("_p", F.lit("")).alias("quality_param"))

    def _found(self, df: DataFrame, keys: list[str], what: int | str, out: str) -> DataFrame:
        """Adds the options at a level, or the parameter, of the path in ``keys``: by full path, else by the last key."""
        last = keys[-1]
        if self.literal:
            by_path, by_label = self._literals[what]
            return df.withColumn(out, F.coalesce(by_path(_path_key(*keys)), by_label(F.col(last))))
        value = "param" if what == "param" else "options"
        exact, leaf = (self.parameters(), self.leaf_parameters()) if what == "param" else (self.options(what), self.leaf_options(what))
        levels = LEVELS[: len(keys)]
        exact = exact.select(*[F.col(c).alias(k) for c, k in zip(levels, keys)], F.col(value).alias("_exact"))
        leaf = leaf.select(F.col(levels[-1]).alias(last), F.col(value).alias("_leaf"))
        plain = df.columns
        df = fence(df, *keys)
        # all rows in one plan, which is evaluated once however many levels follow. Rows without a key need no lookup: where
        # rows move, they are spread by their own values and don't meet in one partition
        hashed = [c for c in plain if "map<" not in df.schema[c].dataType.simpleString()]
        spread = F.when(F.col(last).isNull(), F.pmod(F.hash(*hashed), F.lit(4096)) + 1).otherwise(0)
        for table, by in ((exact, keys), (leaf, [last])):
            if self.small or is_small(table):
                df = df.join(F.broadcast(table), by, "left")
            else:
                df = df.withColumn("_spread", spread).join(table.withColumn("_spread", F.lit(0)), [*by, "_spread"], "left").drop("_spread")
        return df.select(*plain, F.coalesce("_exact", "_leaf").alias(out))


def best_option(options: Column, scores: str | None) -> Column:
    """The element of a sorted option array with the highest score; the first one on ties or
    without scores. Options missing from the score map rank last."""
    if scores is None:
        return F.get(options, F.lit(0))
    ranked = F.transform(options, lambda o, i: F.struct(
        F.coalesce(F.col(scores)[o], F.lit(float("-inf"))).alias("score"), (-i).alias("first"), o.alias("o")))
    return F.array_max(ranked)["o"]


def match_answer(options: Column, answer: Column) -> Column:
    """A free-text answer to an option: the first one that contains the answer or is contained in
    it, ignoring case; the first option otherwise; null for a missing answer or no options."""
    low = F.lower(F.trim(answer))
    hits = F.filter(options, lambda o: F.contains(low, F.lower(o)) | F.contains(F.lower(o), low))
    return F.when(answer.isNotNull(), F.coalesce(F.get(hits, F.lit(0)), F.get(options, F.lit(0))))
