"""Keyword votes for the upper three layers, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from complaintflow.functions import lexicon as lx
from complaintflow.functions.text import found_phrases, lookup, substrings_found

KEYWORDS: tuple[str, ...] = tuple(dict.fromkeys(
    k for labels in (lx.L3_KEYWORDS, lx.L1_KEYWORDS) for words in labels.values() for k in words))


def keywords_found(low: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """Which keywords occur as substrings; each is searched once for all votes."""
    return substrings_found(low, keywords)


def keyword_vote(hits: Column, labels: Mapping[str, Sequence[str]], default: str,
                 keywords: Sequence[str] = KEYWORDS) -> Column:
    """struct(hits, first, label): most keywords wins, the earlier label on ties, ``default``
    without any. Each keyword counts once."""
    votes = [F.struct(F.lit(0).alias("hits"), F.lit(1).alias("first"), F.lit(default).alias("label"))]
    for i, (label, words) in enumerate(labels.items()):
        n = F.lit(0)
        for w in words:
            n = n + F.get(hits, F.lit(keywords.index(w))).cast("int")
        votes.append(F.struct(n.alias("hits"), F.lit(-i).alias("first"), F.lit(label).alias("label")))
    return F.array_max(F.array(*votes))


def large_vote(low: Column, labels: Mapping[str, Sequence[str]], default: str) -> Column:
    """``keyword_vote`` for keyword lists of any size, from the text itself: one pass finds all keywords, and each found one
    names its labels."""
    names, of = list(labels), {}
    for i, words in enumerate(labels.values()):
        for w in words:
            of.setdefault(w, []).append(i)
    named = lookup(of, "array<int>")
    each = F.flatten(F.transform(found_phrases(low, list(of)), lambda p: named(p)))
    none = F.struct(F.lit(0).alias("hits"), F.lit(1).alias("first"), F.lit(default).alias("label"))
    # found labels only: their number follows the text, not the lists
    votes = F.transform(F.array_distinct(each), lambda i: F.struct(
        F.size(F.filter(each, lambda j: j == i)).alias("hits"), (-i).alias("first"), F.get(F.lit(names), i).alias("label")))
    return F.when(low.isNotNull(), F.array_max(F.concat(F.array(none), votes)))


def layer3_vote(hits: Column) -> Column:
    return keyword_vote(hits, lx.L3_KEYWORDS, lx.DEFAULT_L3)


def layer1_vote(hits: Column) -> Column:
    """The second label only with strictly more hits than the first."""
    return keyword_vote(hits, lx.L1_KEYWORDS, lx.DEFAULT_L1)


def keyword_confidence(hits: Column) -> Column:
    return F.when(hits == 0, F.lit(0.50)).otherwise(F.least(F.lit(0.55) + hits * F.lit(0.1), F.lit(0.85)))
