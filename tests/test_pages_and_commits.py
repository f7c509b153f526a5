"""Pages by token, and stores that are read in whole writes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from complaintflow import schemas
from complaintflow.checks import views
from complaintflow.plans import pages, reporting
from complaintflow.sources import committed

START = datetime(2024, 1, 1)
SCHEMA = "id string, rating int, at timestamp_ntz"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(f"k{seed}-{i:05d}", rng.randint(1, 5), None if rng.random() < 0.05 else START + timedelta(minutes=rng.randint(0, 200))) for i in range(n)]


def in_order(data):
    return sorted(data, key=lambda r: (r[2] is None, -(r[2] - START).total_seconds() if r[2] else 0, r[0]))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = pages.PageStore(spark, str(tmp_path_factory.mktemp("pages")), SCHEMA, "at", "id", slice_rows=40)
    data = rows(400), rows(130, seed=2)
    for i, part in enumerate(data):
        store.put(f"s{i}", spark.createDataFrame(part, SCHEMA).repartition(3))
    return store, in_order(data[0] + data[1])


def test_pages_follow_each_other(store):
    store, want = store
    got, token = [], None
    for _ in range(7):
        page = store.page(60, token)
        got += [tuple(r) for r in page.collect()]
        token = store.token(page)
    assert got == want[:420] and store.total() == 530
    rest = store.page(1000, token)
    assert [tuple(r) for r in rest.collect()] == want[420:]
    assert store.page(10, store.token(rest)).count() == 0 and store.token(store.page(10, store.token(rest))) is None


def test_filters_take_further_slices(store):
    store, want = store
    only = [r for r in want if r[1] == 3]
    page = store.page(50, where=lambda d: d.filter("rating = 3"))
    assert [tuple(r) for r in page.collect()] == only[:50]
    after = store.page(500, store.token(page), lambda d: d.filter("rating = 3"))
    assert [tuple(r) for r in after.collect()] == only[50:]


def slices_read(page):
    text = page._jdf.queryExecution().executedPlan().toString()
    return text.split("PartitionFilters: [")[1].split("], ")[0]


def test_a_late_page_reads_as_few_slices_as_the_first(spark, tmp_path):
    store = pages.PageStore(spark, str(tmp_path), SCHEMA, "at", "id", slice_rows=20)
    data = in_order(rows(600, seed=3))
    store.put("s", spark.createDataFrame(data, SCHEMA))
    counts = []
    for at in (0, 200, 500):
        page = store.page(10, (data[at - 1][2], data[at - 1][0]) if at else None)
        assert [tuple(r) for r in page.collect()] == data[at:at + 10]
        counts.append(page.select("id").distinct().count())
        files = {r[0] for r in store._rows(["s"]).select("slice").distinct().collect()}
        assert len(files) > 15
        assert slices_read(page).count("IN (") <= 1 and len(slices_read(page)) < 300
    assert counts == [10, 10, 10]


def test_a_store_without_rows(spark, tmp_path):
    store = pages.PageStore(spark, str(tmp_path), SCHEMA, "at", "id")
    assert store.page(10).count() == 0 and store.total() == 0
    store.put("none", spark.createDataFrame([], SCHEMA))
    assert store.page(10).count() == 0


# --------------------------------------------------------------------------- whole writes
class Broken(Exception):
    pass


def test_a_write_that_stops_half_way_leaves_readers_unchanged(spark, tmp_path, monkeypatch):
    d = "/root/testdata/sf0.001"
    results = views.results(spark, d)
    path = str(tmp_path / "r")
    store = committed.result_store(spark, path)
    store.append("one", results.filter("is_complaint"))
    before = store.rows().count()
    # the files are there, the commit isn't
    monkeypatch.setattr(committed.Committed, "commit", lambda self: (_ for _ in ()).throw(Broken()))
    with pytest.raises(Broken):
        store.append("two", results.filter("NOT is_complaint"))
    monkeypatch.undo()
    reader = committed.result_store(spark, path)
    assert reader.rows().count() == before == results.filter("is_complaint").count()
    reader.append("two", results.filter("NOT is_complaint"))
    reader.append("two", results.filter("NOT is_complaint"))
    again = committed.result_store(spark, path).rows()
    assert sorted(map(str, again.collect())) == sorted(map(str, results.select(*again.columns).collect()))
    assert again.columns == [f.split()[0] for f in schemas.RESULTS.split(", ")]
    last = results.agg(F.max("analyzed_at")).first()[0].date().isoformat()
    assert reader.rows(last).count() == results.filter(F.to_date("analyzed_at") == last).count()


def test_flags_as_of_a_moment(spark, tmp_path):
    store = committed.flag_store(spark, str(tmp_path))
    store.append("a", spark.createDataFrame([("r1", True, "wrong", START), ("r2", True, None, START)], schemas.FLAG_EVENTS))
    store.append("b", spark.createDataFrame([("r1", False, "right", START + timedelta(days=2))], schemas.FLAG_EVENTS))
    now = {r["result_id"]: r["flagged"] for r in committed.flags_as_of(store.rows()).collect()}
    then = {r["result_id"]: r["flagged"] for r in committed.flags_as_of(store.rows(), "2024-01-02").collect()}
    assert now == {"r1": False, "r2": True} and then == {"r1": True, "r2": True}
    assert committed.flags_as_of(store.rows(), "2023-01-01").count() == 0
    assert [r["flagged"] for r in reporting.current_flags(store.rows()).orderBy("result_id").collect()] == [False, True]
