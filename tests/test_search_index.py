"""Search through the gram index against the scan of all texts."""

import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from complaintflow import schemas
from complaintflow.plans import reporting, search_index

DAY = datetime(2024, 1, 15)
PIECES = ["error", "tidak", "PLN mobile", "100%", "a_b", "a\\b", "\\", "É", "é", "ß", "İstanbul", "ΣΑΣ", "😀", "😀😀😡", "\n", "ab", "", "Token", "%", "listrik padam"]


def reviews(spark, texts):
    rows = [(f"r{i:04d}", "u", t, 1 + i % 5, DAY, "1", DAY) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.REVIEWS).repartition(3)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(PIECES, k=rng.randint(0, 8))) for _ in range(300)] + [None, "", "x", "only one has Zwiebelkuchen"]
    rows = reviews(spark, texts).cache()
    index = search_index.SearchIndex(spark, str(tmp_path_factory.mktemp("index")), parts=4)
    for k in range(3):
        index.put(f"s{k}", rows.filter(F.pmod(F.hash("id"), F.lit(3)) == k))
    return rows, index


def test_index_and_scan_agree(spark, store):
    rows, index = store
    rng = random.Random(9)
    terms = ["", "x", "ab", "a_b", "a\\b", "100%", "%", "___", "PLN_mob", "pln%MOBILE", "é", "ÉÉ", "i̇st", "İST", "ΣΑΣ", "σας", "😀😀", "😀😀😡", "s\n", "zwiebelKUCHEN",
             "err_r tid%", "nowhere", "\\", "ror\\", "ß"]
    terms += ["".join(rng.choices(PIECES, k=2)) for _ in range(15)]
    for term in terms:
        want = rows.filter(reporting.search(F.col("review_text"), term)) if term else rows
        got = index.matching(term)
        assert got.columns == rows.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), term


def test_texts_are_read_for_candidates_only(spark, store):
    rows, index = store
    assert index.candidates("ab") is None and index.candidates("a_b%cd") is None
    found = index.matching("Zwiebelkuchen")
    assert index.candidates("Zwiebelkuchen").count() == 1 and found.count() == 1
    # one segment and one part of twelve, and in there the row groups that have the number
    at = index.candidates("Zwiebelkuchen").first()
    text = found._jdf.queryExecution().executedPlan().toString()
    partitions = text.split("PartitionFilters: [")[1].split("], ")[0]
    assert f"= {at['segment']})" in partitions and f"= {at['part']})" in partitions
    assert f"EqualTo(number,{at['number']})" in text


def test_many_candidates_are_joined(spark, store, monkeypatch):
    rows, index = store
    monkeypatch.setattr(search_index, "FEW", 3)
    got, want = index.matching("tidak"), rows.filter(reporting.search(F.col("review_text"), "tidak"))
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


def test_pages_of_the_index(spark, store):
    rows, index = store
    results = spark.createDataFrame([("a1", "r0003")], "result_id string, review_id string")
    for rating, analyzed in ((None, None), (2, None), (None, False), (4, True)):
        got = search_index.search_page(index, results, 2, 7, rating, "error", analyzed)
        want = reporting.raw_page(rows, results, 2, 7, rating, "error", analyzed)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_name_written_again_is_replaced(spark, tmp_path):
    index = search_index.SearchIndex(spark, str(tmp_path), parts=2)
    assert index.matching("anything").count() == 0
    index.put("a", reviews(spark, ["first text", "second text"]))
    index.put("a", reviews(spark, ["third text"]))
    again = search_index.SearchIndex(spark, str(tmp_path))
    assert again.parts == 2 and [r["review_text"] for r in again.matching("TEXT").collect()] == ["third text"]
    assert again.matching("first").count() == 0


def test_lists_are_built_by_as_many_tasks_as_there_are_cores(spark, tmp_path):
    texts = [f"{PIECES[i % len(PIECES)]} number {i} {PIECES[i % 7]}" for i in range(400)]
    rows = reviews(spark, texts)
    index = search_index.SearchIndex(spark, str(tmp_path), parts=1)
    index.put("a", rows)
    stored = index._texts(["a"])
    assert len(stored.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert stored.select("number").distinct().count() == 400
    for term in ("number 39", "PLN_mob", "😀😀", "nowhere"):
        want = rows.filter(reporting.search(F.col("review_text"), term))
        assert sorted(map(str, index.matching(term).collect())) == sorted(map(str, want.collect())), term


def test_lists_in_pieces(monkeypatch):
    monkeypatch.setattr(search_index, "PIECE_CHARS", 20)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(PIECES, k=rng.randint(0, 6))).lower() for _ in range(50)] + [None, "", "ab"]
    frame = pd.DataFrame({"part": [i % 2 for i in range(53)], "number": range(53), "low": texts})
    got, want = {}, {}
    for piece in search_index._listed(iter([frame])):
        for g, n, numbers, part in piece.itertuples(index=False):
            assert n == len(numbers) == len(set(numbers.tolist()))
            got.setdefault((part, g), []).extend(numbers.tolist())
    for i, t in enumerate(texts):
        for g in {t[j:j + 3] for j in range(len(t or "") - 2)} if t else ():
            want.setdefault((i % 2, g), []).append(i)
    assert {key: sorted(x) for key, x in got.items()} == want
