"""Large phrase and keyword lists against one search for each phrase."""

import random

from pyspark.sql import functions as F

from conftest import plan

from complaintflow.functions import normalize
from complaintflow.functions import classify, sentiment, text


def texts(spark, rng, n=200):
    rows = [("".join(rng.choices("abc .*é", k=rng.randint(0, 60))),) for _ in range(n)] + [(None,), ("",), ("a\nb",), ("aaaaaaaa" * 500,)]
    return spark.createDataFrame(rows, "t string")


def test_all_phrases_are_found_in_one_pass(spark):
    rng = random.Random(1)
    phrases = sorted({"".join(rng.choices("abc .*é", k=rng.randint(1, 5))) for _ in range(600)} | {"a\nb", "aaaa", "aaaaa"})
    rows = texts(spark, rng).select("t", text.found_phrases(F.col("t"), phrases).alias("f")).collect()
    for r in rows:
        assert (None if r["f"] is None else sorted(r["f"])) == (None if r["t"] is None else sorted(p for p in phrases if p in r["t"]))
    assert sum(len(r["f"] or ()) for r in rows) > 2000
    assert texts(spark, rng, 3).select(text.found_phrases(F.col("t"), []).alias("f")).first()["f"] == []


def test_votes_of_large_lists(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abc é", k=rng.randint(1, 4))) for _ in range(300)]
    labels = {f"label {i}": rng.sample(words, 12) for i in range(25)}
    every = list(dict.fromkeys(w for ws in labels.values() for w in ws))
    rows = texts(spark, rng)
    small = classify.keyword_vote(classify.keywords_found(F.col("t"), every), {k: list(dict.fromkeys(w)) for k, w in labels.items()}, "none", every)
    large = classify.large_vote(F.col("t"), {k: list(dict.fromkeys(w)) for k, w in labels.items()}, "none")
    got = rows.filter("t IS NOT NULL").select(small.alias("a"), large.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and len({r["a"]["label"] for r in got}) > 3
    assert rows.filter("t IS NULL").select(large.alias("b")).first()["b"] is None


def test_sentiment_does_not_change_with_the_way_of_searching(spark, monkeypatch):
    rng = random.Random(3)
    phrase = lambda: " ".join("".join(rng.choices("abc", k=2)) for _ in range(2))
    rules = sentiment.SentimentRules(negative={phrase(): rng.randint(1, 3) for _ in range(30)} | {"aa": 2}, positive={phrase(): rng.randint(1, 3) for _ in range(30)} | {"bb": 1})
    rows = spark.createDataFrame([(" ".join("".join(rng.choices("abc", k=2)) for _ in range(rng.randint(0, 25))),) for _ in range(200)], "t string")
    columns = ["sentiment", "sentiment_confidence"]
    one_by_one = sentiment.score_sentiment(rows, "t", rules).select("t", *columns).collect()
    monkeypatch.setattr(text, "MANY_PHRASES", 5)
    assert sentiment.score_sentiment(rows, "t", rules).select("t", *columns).collect() == one_by_one
    assert len({r["sentiment_confidence"] for r in one_by_one}) > 5


def test_tokens_stay_where_they_are_for_a_small_slang_table(spark):
    slang = spark.createDataFrame([("gk", "tidak"), ("gk bs", "tidak bisa")], "token string, replacement string")
    df = spark.createDataFrame([(1, "gk bs gk"), (2, "- gk"), (3, "bs")], "id int, t string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = normalize.apply_slang_table(df, "id", "t", "t", slang)
        assert plan(done).count("BroadcastHashJoin") == 2
        assert {r["id"]: r["t"] for r in done.collect()} == {1: "tidak bisa tidak", 2: "tidak", 3: "bs"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
