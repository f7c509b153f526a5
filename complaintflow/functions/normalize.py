"""Text normalisation as column expressions.

The text-level steps are regular expressions over the whole string. The token-level steps
(slang, stem, acronym) work on two aligned arrays, the tokens and their bare forms, so no
regular expression runs per token. Nothing here leaves the JVM or moves a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complaintflow.functions import lexicon as lx
from complaintflow.functions.text import SPACE, WORD, bare, fence, lookup, squeeze, strip
from complaintflow.operators.joins import is_small, small_side


# --------------------------------------------------------------------------- text-level steps
def replace_emoji(c: Column, emoji: Mapping[str, str] = lx.EMOJI) -> Column:
    for symbol, word in emoji.items():
        c = F.replace(c, F.lit(symbol), F.lit(f" {word} "))
    return c


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+", "")


def lower_trim(c: Column) -> Column:
    return strip(F.lower(c))


def expand_reduplication(c: Column) -> Column:
    """``brkali2`` -> ``berkali-kali``; any other word ending in 2 is doubled with a hyphen."""
    left, right = f"(?<![{WORD}])", f"(?![{WORD}])"
    c = F.regexp_replace(c, f"{left}(?:berkali|brkali)2{right}", "berkali-kali")
    return F.regexp_replace(c, f"{left}([{WORD}]{{3,}})2{right}", "$1-$1")


def split_digits(c: Column) -> Column:
    """A blank between a digit and an ASCII letter, in either order."""
    return F.regexp_replace(c, r"(?<=\p{Nd})(?=[a-zA-Z])|(?<=[a-zA-Z])(?=\p{Nd})", " ")


def collapse_repeats(c: Column) -> Column:
    """Three or more of the same character become one (digits and punctuation as well)."""
    return F.regexp_replace(c, r"([^\n])\1{2,}", "$1")


def remove_noise(c: Column) -> Column:
    return F.regexp_replace(c, rf"[^{WORD}{SPACE}.,!?\-/]", " ")


def fix_punctuation(c: Column) -> Column:
    c = F.regexp_replace(c, r"([!?])\1+", "$1")
    c = F.regexp_replace(c, r"\.{2,}", "...")
    return F.regexp_replace(c, f"[{SPACE}]([.,!?])", "$1")


def clean_text(df: DataFrame, col: str, out: str, emoji: Mapping[str, str] = lx.EMOJI) -> DataFrame:
    """All text-level steps in their fixed order; the result has single blanks only.

    Each costly step sits behind a cheap test of whether it can change the text at all. The test
    and the step both read a column of an earlier projection, so nothing is computed twice.
    """
    base = [c for c in df.columns if c != out]
    a, b = F.col("_a"), F.col("_b")

    def guarded(test: Column, step, c: Column) -> Column:
        return F.when(test, step(c)).otherwise(c)

    has_symbol = F.octet_length(a) != F.length(a) if all(not k.isascii() for k in emoji) else F.lit(True)
    df = df.select(*df.columns, F.coalesce(F.col(col), F.lit("")).alias("_a"))
    df = df.select(*base, guarded(has_symbol, lambda c: replace_emoji(c, emoji), a).alias("_b"))
    has_url = F.contains(b, F.lit("://")) | F.contains(b, F.lit("www."))
    df = df.select(*base, lower_trim(guarded(has_url, remove_urls, b)).alias("_a"))
    df = df.select(*base, guarded(F.contains(a, F.lit("2")), expand_reduplication, a).alias("_b"))
    c = guarded(b.rlike(r"\p{Nd}"), split_digits, b)
    for step in (collapse_repeats, remove_noise, fix_punctuation, squeeze):
        c = step(c)
    return df.select(*base, c.alias(out))


def capitalise(c: Column) -> Column:
    """Upper-case the first character only."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2_147_483_647))


# --------------------------------------------------------------------------- dictionaries
def eligible_stems(stems: Mapping[str, str], no_stem: Iterable[str] = lx.NO_STEM,
                   acronyms: Iterable[str] = lx.ACRONYMS) -> dict[str, str]:
    """The stem pairs that may be used: known words, short words and numbers are left alone."""
    blocked = set(no_stem) | set(acronyms)
    return {
        t: s for t, s in stems.items()
        if t not in blocked and not t.isdigit() and len(t) > 4 and s and 3 <= len(s) < len(t)
    }


@dataclass(frozen=True)
class TextRules:
    """The dictionaries of the token-level steps. ``stems`` empty means no stemming."""

    slang: Mapping[str, str] = field(default_factory=lambda: lx.SLANG)
    fillers: Iterable[str] = field(default_factory=lambda: lx.FILLERS)
    acronyms: Iterable[str] = field(default_factory=lambda: lx.ACRONYMS)
    no_stem: Iterable[str] = field(default_factory=lambda: lx.NO_STEM)
    stems: Mapping[str, str] = field(default_factory=dict)

    def finished(self, words: str) -> str:
        """Stem and acronym rules applied to a replacement text, once, at plan time."""
        stems, acronyms = eligible_stems(self.stems, self.no_stem, self.acronyms), set(self.acronyms)
        out = []
        for t in words.split():
            key = "".join(ch for ch in t if ch.isalnum() or ch == "_").lower()
            if key in stems:
                t = key = stems[key]
            out.append(key.upper() if key in acronyms else t)
        return " ".join(out)

    def single_word_table(self) -> dict[str, str]:
        """bare token -> final text, with slang, filler, stem and acronym rules folded together."""
        table = {a: a.upper() for a in self.acronyms}
        table.update({t: self.finished(t) for t in eligible_stems(self.stems, self.no_stem, self.acronyms)})
        table.update({k: self.finished(v) for k, v in self.slang.items() if " " not in k})
        table.update({f: "" for f in self.fillers})
        return table

    def pair_table(self) -> dict[str, str]:
        return {k: self.finished(v) for k, v in self.slang.items()}


# --------------------------------------------------------------------------- token-level steps
def _replace_tokens(tok: Column, key: Column, single: Mapping[str, str], pair: Mapping[str, str]) -> Column:
    """Greedy left-to-right replacement over aligned token and key arrays, joined by blanks.

    A pair of neighbours is looked up first and swallows both. Which tokens start a pair is
    decided for the whole row at once: the hits are written as a string of 0/1 flags and the
    pattern ``1.`` marks them left to right without overlap, which is the greedy order.
    """
    find_one = lookup(single)
    one_by_one = F.zip_with(tok, key, lambda t, k: F.coalesce(find_one(k), t))

    find_pair = lookup(pair)
    following = F.slice(key, F.lit(2), F.size(key))
    spaced_keys = any(" " in k for k in pair)

    def pair_key(a: Column, b: Column) -> Column:
        return F.trim(F.concat(a, F.lit(" "), b))

    def is_pair(a: Column, b: Column) -> Column:
        hit = b.isNotNull() & find_pair(pair_key(a, b)).isNotNull()
        # without two-word keys only a neighbour made of punctuation alone can complete a pair
        return hit if spaced_keys else ((a == "") | (b == "")) & hit

    flags = F.array_join(F.zip_with(key, following, lambda a, b: F.when(is_pair(a, b), "1").otherwise("0")), "")
    marks = F.split(F.regexp_replace(flags, "1.", "px"), "")
    rows = F.arrays_zip(tok.alias("t"), key.alias("k"), following.alias("n"), marks.alias("m"))

    def emit(r: Column) -> Column:
        return (
            F.when(r["m"] == "x", "")
            .when(r["m"] == "p", find_pair(pair_key(r["k"], r["n"])))
            .otherwise(F.coalesce(find_one(r["k"]), r["t"]))
        )

    with_pairs = F.transform(rows, emit)
    can_pair = F.lit(True) if spaced_keys else F.array_contains(key, "")
    return F.array_join(F.when(can_pair, with_pairs).otherwise(one_by_one), " ")


def _over_tokens(df: DataFrame, col: str, out: str, build) -> DataFrame:
    """Split ``col`` into tokens and keys once, as columns, and build ``out`` from text, tokens
    and keys."""
    base = [c for c in df.columns if c != out]
    staged = df.select(*base, F.col(col).alias("_text"), F.split(F.col(col), " ").alias("_tok"),
                       F.split(bare(F.col(col)), " ").alias("_key"))
    return staged.select(*base, build(F.col("_text"), F.col("_tok"), F.col("_key")).alias(out))


def apply_slang(df: DataFrame, col: str, out: str, rules: TextRules = TextRules()) -> DataFrame:
    """Slang pairs, fillers and single slang words over a text with single blanks."""
    single = {**{k: v for k, v in rules.slang.items() if " " not in k}, **{f: "" for f in rules.fillers}}
    return _over_tokens(df, col, out, lambda _, t, k: squeeze(_replace_tokens(t, k, single, rules.slang)))


def apply_stems(df: DataFrame, col: str, out: str, rules: TextRules) -> DataFrame:
    find = lookup(eligible_stems(rules.stems, rules.no_stem, rules.acronyms))
    return _over_tokens(
        df, col, out, lambda _, t, k: F.array_join(F.zip_with(t, k, lambda a, b: F.coalesce(find(b), a)), " "))


def restore_acronyms(df: DataFrame, col: str, out: str, rules: TextRules = TextRules()) -> DataFrame:
    find = lookup({a: a.upper() for a in rules.acronyms})
    return _over_tokens(
        df, col, out, lambda _, t, k: F.array_join(F.zip_with(t, k, lambda a, b: F.coalesce(find(b), a)), " "))


def normalize_text(df: DataFrame, col: str, out: str = "normalized", rules: TextRules = TextRules()) -> DataFrame:
    """The whole normaliser. Null and blank texts give an empty string.

    The token-level rules are folded into one table beforehand, so each token is looked up once.
    """
    base = [c for c in df.columns if c != out]
    cleaned = clean_text(df, col, "_clean")
    single, pair = rules.single_word_table(), rules.pair_table()

    def replaced(whole: Column, tok: Column, key: Column) -> Column:
        done = F.trim(F.regexp_replace(_replace_tokens(tok, key, single, pair), " {2,}", " "))
        if any(" " in k for k in pair):
            return done
        # a text with no key at all stays as it is; this also covers pairs, which need one key
        return F.when(F.arrays_overlap(key, F.lit([*single, *pair])), done).otherwise(whole)

    words = _over_tokens(cleaned, "_clean", "_words", replaced)
    return fence(words.select(*base, capitalise(F.col("_words")).alias(out)), out)


def apply_stem_table(df: DataFrame, key: str, col: str, out: str, stems: DataFrame,
                     rules: TextRules = TextRules()) -> DataFrame:
    """``apply_stems`` for a stem table (token, stem) of any size: one row per token, an equality
    join, and the texts put together again per ``key``. Only for tables too large for a literal."""
    blocked = [*rules.no_stem, *rules.acronyms]
    usable = stems.filter(
        ~F.col("token").isin(blocked) & ~F.col("token").rlike(r"^\p{Nd}+$") & (F.length("token") > 4)
        & (F.length("stem") >= 3) & (F.length("stem") < F.length("token"))
    ).groupBy("token").agg(F.max("stem").alias("stem"))
    text = F.col(col)
    pairs = F.arrays_zip(F.split(text, " ").alias("t"), F.split(bare(text), " ").alias("k"))
    each = df.select(key, F.posexplode(pairs).alias("pos", "p")).select(key, "pos", "p.t", F.col("p.k").alias("token"))
    word = F.struct("pos", F.coalesce("stem", "t").alias("w"))
    whole = each.join(usable, "token", "left").groupBy(key).agg(F.sort_array(F.collect_list(word)).alias("_w"))
    joined = whole.select(key, F.array_join(F.col("_w.w"), " ").alias("_out"))
    return df.join(joined, key, "left").select(*[c for c in df.columns if c != out], F.col("_out").alias(out))


def apply_slang_table(df: DataFrame, key: str, col: str, out: str, slang: DataFrame,
                      fillers: Iterable[str] = lx.FILLERS) -> DataFrame:
    """``apply_slang`` for a dictionary table (token, replacement) of any size: one row per token, two equality joins -
    the token and its pair with the next - and the texts put together again per ``key``."""
    text, silent = F.col(col), list(fillers)
    once = slang.groupBy("token").agg(F.max("replacement").alias("r"))
    keys = F.split(bare(text), " ")
    parts = F.arrays_zip(F.split(text, " ").alias("t"), keys.alias("k"), F.slice(keys, F.lit(2), F.greatest(F.size(keys), F.lit(1))).alias("n"))
    each = df.select(key, F.posexplode(parts).alias("pos", "p")).select(key, "pos", "p.t", "p.k", "p.n")
    each = each.withColumn("pair", F.trim(F.concat("k", F.lit(" "), "n")))
    singles = once.filter(~F.contains("token", F.lit(" "))).select(F.col("token").alias("k"), F.col("r").alias("one"))
    pairs = once.select(F.col("token").alias("pair"), F.col("r").alias("two"))
    small = is_small(once)  # then the tokens stay where they are until their texts are put together
    each = each.join(small_side(singles, small), "k", "left").join(small_side(pairs, small), "pair", "left")
    word = F.struct("pos", F.when(F.col("k").isin(silent), "").otherwise(F.coalesce("one", "t")).alias("one"), "two")
    whole = each.groupBy(key).agg(F.sort_array(F.collect_list(word)).alias("_w"))
    flags = F.array_join(F.transform("_w", lambda w: F.when(w["two"].isNotNull(), "1").otherwise("0")), "")
    # a pair takes its follower with it, so the last token of a text starts none
    marks = F.split(F.regexp_replace(flags, "1.", "px"), "")
    chosen = F.zip_with("_w", marks, lambda w, m: F.when(m == "x", "").when(m == "p", w["two"]).otherwise(w["one"]))
    joined = whole.select(key, squeeze(F.array_join(chosen, " ")).alias("_out"))
    return df.join(joined, key, "left").select(*[c for c in df.columns if c != out], F.col("_out").alias(out))
