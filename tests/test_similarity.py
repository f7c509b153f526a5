"""The matching-block ratio against the standard library's."""

import random
from difflib import SequenceMatcher, get_close_matches

from pyspark.sql import functions as F

from complaintflow.functions.similarity import block_ratio
from complaintflow.operators import reconcile as rc

WORDS = ["Token", "Pembayaran", "dan", "&", "Gagal", "Bayar", "Padam", "Meluas", "Rumah", "é", "😀", "OTP", "Tidak Masuk"]


def labels(rng, n):
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 5))) for _ in range(n)]


def test_ratio_of_short_texts(spark):
    rng = random.Random(1)
    pairs = list(zip(labels(rng, 150), labels(rng, 150)))
    pairs += [tuple("".join(rng.choices("ab", k=rng.randint(0, 12))) for _ in range(2)) for _ in range(150)]
    pairs += [("Token & Pembayaran", "Token dan Pembayaran"), ("", ""), ("", "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", block_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in rows] == [SequenceMatcher(None, r["a"], r["b"]).ratio() for r in rows]
    assert round(next(r["r"] for r in rows if r["a"] == "Token & Pembayaran" and r["b"].startswith("Token dan")), 3) == 0.895
    none = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string").select(block_ratio(F.col("a"), F.col("b")).alias("r"))
    assert [r["r"] for r in none.collect()] == [None, None]


def test_closest_is_that_of_the_standard_library(spark):
    rng = random.Random(2)
    cases = [(x, sorted(set(labels(rng, 12)) - {""})) for x in labels(rng, 120) if x]
    rows = spark.createDataFrame(cases, "label string, options array<string>").select(
        "*", rc.closest_by_blocks(F.col("label"), F.col("options")).alias("c")).collect()
    found = 0
    for r in rows:
        want = get_close_matches(r["label"], r["options"], 1, rc.FUZZY_CUTOFF)
        assert r["c"]["option"] == (want[0] if want else None)
        found += bool(want)
    assert 10 < found < len(rows)


def test_reconciling_takes_the_ratio_by_default(spark):
    from complaintflow.checks import views
    report = spark.createDataFrame([(1, "APLIKASI", "KETENAGALISTRIKAN", "Token dan Pembayaran", None, None)],
                                   "row int, `LAYER 1` string, `LAYER 2` string, `LAYER 3` string, `LAYER 4` string, `LAYER 5` string")
    row = rc.reconcile(report, views.fixture_taxonomy(spark)).first()
    assert (row["m3"], row["method3"], row["score3"]) == ("Token & Pembayaran", "fuzzy", 0.895)
