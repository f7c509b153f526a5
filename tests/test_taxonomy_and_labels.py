import random

import pytest
from pyspark.sql import functions as F

from conftest import plan

from complaintflow.checks.views import fixture_taxonomy
from complaintflow.functions.labels import clean_label
from complaintflow.operators import reconcile as rc
from complaintflow.operators.taxonomy import Taxonomy, match_answer


@pytest.fixture(scope="module")
def taxonomy(spark):
    return fixture_taxonomy(spark)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_option_sets(taxonomy):
    l4 = {r[:3]: r[3] for r in rows(taxonomy.options(4), "l1", "l2", "l3", "options")}
    assert l4[("APLIKASI", "KETENAGALISTRIKAN", "Token & Pembayaran")] == ["Gagal Bayar", "Token Tidak Masuk"]
    l5 = {r[:4]: r[4] for r in rows(taxonomy.options(5), "l1", "l2", "l3", "l4", "options")}
    assert l5[("APLIKASI", "KETENAGALISTRIKAN", "Token & Pembayaran", "Gagal Bayar")] == ["Metode Ditolak", "Saldo Terpotong"]
    assert not any(k[2] == "Catat Meter" for k in l4)
    assert rows(taxonomy.ambiguous(3), "label") == [("Pengaduan",)]
    assert rows(taxonomy.ambiguous(4), "label") == [("Pendaftaran Baru",)]
    assert rows(taxonomy.labels(1), "label") == [("APLIKASI",), ("LAYANAN",), ("UMUM",)]


PATHS = [("known", "APLIKASI", "KETENAGALISTRIKAN", "Token & Pembayaran"), ("unknown", "APLIKASI", "LAINNYA", "Pengaduan"),
         ("leaf", "x", "y", "Token & Pembayaran"), ("nothing", "APLIKASI", "LAINNYA", "none"), ("childless", "LAYANAN", "KETENAGALISTRIKAN", "Pengaduan")]
SCORES = {"Token Tidak Masuk": 0.9, "Respon Petugas": 0.8, "Saldo Terpotong": 0.7, "Padam Rumah": 0.6}


@pytest.mark.parametrize("literal_rows", [20_000, 0])
def test_lower_level_picks(spark, taxonomy, literal_rows):
    t = Taxonomy(taxonomy.rows, literal_rows)
    df = spark.createDataFrame(PATHS, "id string, layer1 string, layer2 string, layer3 string")
    first = {r[0]: r[1:] for r in rows(t.pick_lower_levels(df, F.lit(True)), "id", "layer4", "layer5", "quality_param")}
    assert first == {"known": ("Gagal Bayar", "Metode Ditolak", "Keandalan"), "unknown": ("Padam", "Padam Meluas", "Kecepatan"),
                     "leaf": ("Gagal Bayar", "Metode Ditolak", "Keandalan"), "nothing": ("", "", ""),
                     "childless": ("Padam", "Padam Meluas", "Responsivitas")}
    scored = df.withColumn("s", F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]))
    best = {r[0]: r[1:] for r in rows(t.pick_lower_levels(scored, F.lit(True), "s", "s"), "id", "layer4", "layer5", "quality_param")}
    assert best["known"] == ("Token Tidak Masuk", "Token Tertunda", "Kecepatan")
    assert best["childless"] == ("Respon Petugas", "", "")
    assert best["unknown"] == ("Respon Petugas", "", "")


def test_labels_shared_between_levels(spark):
    """A level-3 label that is also a level-4 label must not lend its children."""
    t = spark.createDataFrame([(1, "a", "b", "c", "d", None, None), (2, "a", "b", "d", "e", "f", "p")],
                              "ord long, l1 string, l2 string, l3 string, l4 string, l5 string, param string")
    df = spark.createDataFrame([("1", "a", "b", "c")], "id string, layer1 string, layer2 string, layer3 string")
    for literal_rows in (100, 0):
        r = Taxonomy(t, literal_rows).pick_lower_levels(df, F.lit(True)).first()
        assert (r["layer4"], r["layer5"]) == ("d", "")


def test_exact_path_parameter_takes_the_last_row(spark, taxonomy):
    df = spark.createDataFrame([("APLIKASI", "KETENAGALISTRIKAN", "Token & Pembayaran", "Gagal Bayar", "Saldo Terpotong"),
                                ("?", "?", "?", "?", "Padam Meluas"), ("?", "?", "?", "?", "?")], "l1 string, l2 string, l3 string, l4 string, l5 string")
    assert rows(taxonomy.with_parameter(df), "l5", "param") == [("?", ""), ("Padam Meluas", "Kecepatan"), ("Saldo Terpotong", "Ketepatan")]


def test_answers(spark):
    df = spark.createDataFrame([("I pick GAGAL bayar.",), ("token",), ("zzz",), (None,)], "a string")
    opts = F.lit(["Gagal Bayar", "Token Tidak Masuk"])
    assert [r[0] for r in df.select(match_answer(opts, F.col("a"))).collect()] == ["Gagal Bayar", "Token Tidak Masuk", "Gagal Bayar", None]


def test_label_cleaning(spark):
    cases = [("1. APLIKASI", "APLIKASI"), ("1.1.1 Token  &\nPembayaran", "Token & Pembayaran"), ("3 phase", "phase"), ("12", None), (" ", None), (None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "x string").coalesce(1)
    assert [r[0] for r in df.select(clean_label(F.col("x"))).collect()] == [c[1] for c in cases]


LABELS = [
    ("1.1 Token & Pembayaran", "Token & Pembayaran", "exact", 1.0), ("Token dan Pembayaran", "Token & Pembayaran", "fuzzy", 0.85),
    ("Token & Pembayarn", "Token & Pembayaran", "fuzzy", 0.944), ("pengaduan", "Pengaduan", "fuzzy", 0.889),
    ("Akun PLN", "Akun PLN", "NEEDS_MANUAL_REVIEW", 0.0), ("Meteran Rusak", "Meteran Rusak", "NEEDS_MANUAL_REVIEW", 0.0), (None, None, "empty", 0.0),
]


def report(spark, data):
    names = ["row", "LAYER 1", "LAYER 2", "LAYER 3", "LAYER 4", "LAYER 5"]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))


def test_reconciliation(spark, taxonomy):
    data = [(str(i), "1. APLIKASI", "KETENAGALISTRIKAN", c[0], None, None) for i, c in enumerate(LABELS)]
    data += [("u", "APLIKASI", "nowhere", "Padam", "Padam", " 2. Padam Rumh "), ("u2", "APLIKASI", "nowhere", "Padam", "Padam", " 2. Padam Rumh ")]
    done = rc.reconcile(report(spark, data), taxonomy)
    got = {r["row"]: (r["m3"], r["method3"], r["score3"]) for r in done.collect()}
    assert [got[str(i)] for i in range(len(LABELS))] == [c[1:] for c in LABELS]
    assert got["u"] == ("Padam", "no_hierarchy_options", 0.0) == got["u2"]
    lines = {(r["row"], r["layer"]): r for r in rc.open_labels(done).collect()}
    assert ("0", "L3") not in lines and ("6", "L3") not in lines
    # the unknown path has no options for level 4; level 5 falls back to the label "Padam" alone
    assert lines[("u", "L4")]["method"] == "no_hierarchy_options"
    l5 = lines[("u", "L5")]
    assert (l5["matched"], l5["method"], l5["raw"], l5["context"]) == ("Padam Rumah", "fuzzy", "2. Padam Rumh", "APLIKASI>nowhere>Padam>Padam")
    wide = {r["row"]: r for r in rc.reconciled_report(done).collect()}
    assert wide["1"]["LAYER 1"] == "APLIKASI" and wide["1"]["LAYER 3"] == "Token & Pembayaran"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_closest_against_brute_force(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(200):
        base = "".join(rng.choice("abcd ") for _ in range(8)).strip() or "a"
        opts = sorted({"".join(c if rng.random() > 0.2 else rng.choice("abcd") for c in base) for _ in range(4)})
        pairs.append((base, opts))
    pairs += [("Padam Kota", ["Padam Koba", "Padam Kola"]), ("bbdb", ["dbbb"]), (None, ["a"])]
    got = spark.createDataFrame(pairs, "l string, o array<string>").coalesce(1).select(rc.closest_by_edits(F.col("l"), F.col("o")).alias("r")).collect()
    for (label, opts), r in zip(pairs, got):
        scored = [(1 - edits(label, o) / max(len(label), len(o)), o) for o in opts] if label else []
        want = max((x for x in scored if x[0] >= 0.72), default=(None, None))
        assert (r["r"]["score"], r["r"]["option"]) == want
    assert got[200]["r"]["option"] == "Padam Kola"


def test_many_paths_with_one_shared_label(spark):
    """Option lists are kept once for each label, so 20 000 rows below one level-4 label are quick in both forms."""
    rows = spark.range(20000).selectExpr("id AS ord", "'A' AS l1", "'B' AS l2", "concat('c', id) AS l3", "'Lainnya' AS l4",
                                         "concat('d', id) AS l5", "'p' AS param")
    seen = spark.createDataFrame([("A", "B", "c7"), ("A", "B", "none"), (None, None, None)], "layer1 string, layer2 string, layer3 string")
    for limit in (20000, 0):
        picked = Taxonomy(rows, limit).pick_lower_levels(seen, F.lit(True))
        got = sorted((r["layer3"] or "", r["layer4"], r["layer5"], r["quality_param"]) for r in picked.collect())
        assert got == [("", "", "", ""), ("c7", "Lainnya", "d7", "p"), ("none", "", "", "")]


def test_a_large_taxonomy_is_looked_up_in_one_plan_without_meeting_by_label(spark, taxonomy, monkeypatch):
    paths = spark.createDataFrame([(i, "LAYANAN", None if i % 3 else "KETENAGALISTRIKAN", "Pengaduan" if i % 2 else None) for i in range(60)],
                                  "id int, layer1 string, layer2 string, layer3 string")
    rows = paths.withColumn("n", F.col("id") + 0)
    want = sorted(map(tuple, Taxonomy(taxonomy.rows).pick_lower_levels(rows, F.lit(True)).collect()))
    large = Taxonomy(taxonomy.rows, 0)
    large.small = False
    found = large.pick_lower_levels(rows, F.lit(True))
    assert "Union" not in plan(found) and plan(found).count("BroadcastHashJoin") == 6
    options = large.with_options(paths.toDF("id", "l1", "l2", "l3"), 4)
    assert plan(options).count("BroadcastHashJoin") == 2
    assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr("complaintflow.operators.taxonomy.is_small", lambda *_: False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = large.pick_lower_levels(rows, F.lit(True))
        assert "Union" not in plan(found) and sorted(map(tuple, found.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
