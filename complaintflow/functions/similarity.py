"""Similarity of short labels by their matching blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _longest_block(a: Column, b: Column) -> Column:
    """(size, -start in a): the longest text that both have, the earliest in ``a`` of several; size 0 without any."""
    def from_start(i: Column) -> Column:
        # what begins at i and is found in b: as each beginning of a block is one, too, their number is the longest's size
        sizes = F.sequence(F.lit(1), F.least(F.length(a) - i + 1, F.length(b)))
        found = F.filter(sizes, lambda n: F.instr(b, F.substr(a, i, n)) > 0)
        return F.struct(F.size(found).alias("size"), (-i).alias("at"))

    return F.array_max(F.transform(F.sequence(F.lit(1), F.length(a)), from_start))


def matching_blocks(a: Column, b: Column) -> Column:
    """Characters in matching blocks: the longest common block (earliest in ``a``, then in ``b``), and the same again left and
    right of it. The open pairs of pieces are a stack inside the row, so nothing is joined and nothing recurses."""
    piece = "array<struct<a:string,b:string>>"
    start = F.struct(F.array(F.struct(a.alias("a"), b.alias("b"))).cast(piece).alias("open"), F.lit(0).alias("total"))
    rounds = F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1)

    def both(x: Column, y: Column) -> Column:
        pair = F.array(F.struct(x.alias("a"), y.alias("b"))).cast(piece)
        return F.when((F.length(x) > 0) & (F.length(y) > 0), pair).otherwise(F.array().cast(piece))

    def step(state: Column, _: Column) -> Column:
        rest = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)

        def split(top: Column) -> Column:
            def around(block: Column) -> Column:
                n, i = block["size"], -block["at"]

                def pieces(j: Column) -> Column:
                    left = both(F.substr(top["a"], F.lit(1), i - 1), F.substr(top["b"], F.lit(1), j - 1))
                    right = both(F.substr(top["a"], i + n), F.substr(top["b"], j + n))
                    return F.struct(F.concat(rest, left, right).alias("open"), (state["total"] + n).alias("total"))

                return F.when(n > 0, _let(F.instr(top["b"], F.substr(top["a"], i, n)), pieces)).otherwise(
                    F.struct(rest.alias("open"), state["total"].alias("total")))

            return _let(_longest_block(top["a"], top["b"]), around)

        return F.when(F.size(state["open"]) > 0, _let(F.element_at(state["open"], -1), split)).otherwise(state)

    total = F.aggregate(rounds, start, step, lambda s: s["total"])
    return F.when((F.length(a) > 0) & (F.length(b) > 0), total).otherwise(F.when(a.isNotNull() & b.isNotNull(), 0))


def block_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Twice the characters in matching blocks over the characters of both; 1 for two empty texts. Null where the lengths alone
    keep it below ``least``."""
    both = F.length(a) + F.length(b)
    ratio = F.when(both == 0, 1.0).otherwise(2.0 * matching_blocks(a, b) / both)
    return F.when((2.0 * F.least(F.length(a), F.length(b)) >= least * both), ratio)
