import random

import pytest
import random

from pyspark.sql import functions as F

from complaintflow import schemas
from complaintflow.checks.views import fixture_taxonomy
from complaintflow.functions import lexicon as lx
from complaintflow.functions import sentiment as se
from complaintflow.functions import text as tx
from complaintflow.operators.taxonomy import Taxonomy
from complaintflow.plans.analysis import analyze

TOKEN = ("APLIKASI", "Token & Pembayaran", 0.75, "Gagal Bayar", "Metode Ditolak", "Keandalan")
NEW = ("APLIKASI", "Pengaduan", 0.50, "Pendaftaran Baru", "Formulir Gagal", "Kemudahan")
SHORT = ("APLIKASI", "Pengaduan", 0.50, "", "", "")
NONE = ("", "", 0.0, "", "", "")
# id, text, rating, sentiment, confidence of it, source, (l1, l3, class confidence, l4, l5, parameter), complaint, confidence
CASES = [
    ("1", "Aplikasi sangat membantu mantap sekali terima kasih PLN", 1, "Positif", 0.92, "fallback", NONE, False, 0.92),
    ("2", "bagus banget aplikasinya mudah digunakan pln mobile terbaik", 2, "Positif", 0.92, "fallback", NONE, False, 0.92),
    ("3", "Aplikasi error terus tidak bisa beli token sudah 3 hari", 1, "Negatif", 0.92, "fallback",
     ("APLIKASI", "Token & Pembayaran", 0.65, "Gagal Bayar", "Metode Ditolak", "Keandalan"), True, 0.65),
    ("4", "listrik mati 2 hari tidak ada pemberitahuan", 2, "Negatif", 0.92, "fallback",
     ("LAYANAN", "Pengaduan", 0.75, "Padam", "Padam Meluas", "Responsivitas"), True, 0.75),
    ("5", "token tidak masuk sudah bayar tapi gagal terus", 4, "Negatif", 0.92, "fallback", TOKEN, True, 0.75),
    ("6", "pengaduan gangguan listrik melalui PLN mobile", 5, "Positif", 0.92, "fallback+rating_rescue", NONE, False, 0.92),
    ("7", "pln mobile membantu", 5, "Positif", 0.92, "fallback", NONE, False, 0.92),
    ("8", "lapor lewat aplikasi gampang dan cepat", 5, "Positif", 0.92, "fallback", NONE, False, 0.92),
    ("9", "awalnya bintang 5 tapi sekarang gak bisa masuk ke aplikasi sama sekali", 5, "Negatif", 0.92, "fallback", NEW, True, 0.50),
    ("10", "aplikasi sering crash dan tidak bisa login", None, "Negatif", 0.92, "fallback",
     ("APLIKASI", "Akun PLN Mobile", 0.65, "Pendaftaran Baru", "OTP Tidak Masuk", "Keandalan"), True, 0.65),
    ("e1", "", None, "Negatif", 0.60, "fallback", SHORT, True, 0.50),
    ("e2", "", 5, "Positif", 0.60, "fallback+rating_rescue", NONE, False, 0.60),
    ("e3", "tidak baik", None, "Negatif", 0.92, "fallback", SHORT, True, 0.50),
    ("e4", "bagus tapi lambat dan sulit", None, "Negatif", 0.803, "fallback", NEW, True, 0.50),
    ("e5", "belum lancar", None, "Negatif", 0.92, "fallback", SHORT, True, 0.50),
    ("o1", "otomatis", None, "Negatif", 0.60, "fallback", ("LAYANAN", "Pengaduan", 0.65, "", "", ""), True, 0.60),
]
SCORED = [
    ("s1", CASES[0][1], 1, "Negatif", 0.70, "IndoBERT-local", ("UMUM", lx.MISREAD_STAR, 0.85, "", "", ""), True, 0.70),
    ("s2", CASES[0][1], 1, "Positif", 0.90, "IndoBERT-local", NONE, False, 0.90),
]
SCORES = [("s1", "sentiment", 0, "LABEL_0", 0.20), ("s1", "sentiment", 1, "LABEL_1", 0.70), ("s1", "sentiment", 2, "LABEL_2", 0.10),
          ("s2", "sentiment", 0, "LABEL_0", 0.06), ("s2", "sentiment", 1, "LABEL_1", 0.04), ("s2", "sentiment", 2, "LABEL_2", 0.90)]


def run(spark, cases, taxonomy, scores=None):
    df = spark.createDataFrame([c[:3] for c in cases], "id string, review_text string, rating int").repartition(3)
    return {r["id"]: r for r in analyze(df, taxonomy, scores).collect()}


def check(got, cases):
    for key, _, _, sentiment, sconf, source, (l1, l3, cconf, l4, l5, param), complaint, conf in cases:
        r = got[key]
        assert (r["sentiment"], r["sentiment_confidence"], r["sentiment_source"]) == (sentiment, sconf, source), key
        assert (r["layer1"], r["layer3"], r["classification_confidence"]) == (l1, l3, cconf), key
        assert (r["layer4"], r["layer5"], r["quality_param"]) == (l4, l5, param), key
        assert (r["is_complaint"], r["confidence"]) == (complaint, conf), key
        assert (r["category"], r["subcategory"]) == (l1, l3), key


@pytest.mark.parametrize("literal_rows", [20_000, 0])
def test_golden_cases(spark, literal_rows):
    taxonomy = fixture_taxonomy(spark)
    taxonomy.literal_rows = literal_rows
    got = run(spark, CASES, taxonomy)
    check(got, CASES)
    assert not got["e3"]["escalated"] and got["3"]["escalated"]
    assert got["3"]["reason"] == "Negative complaint: APLIKASI > Token & Pembayaran > Gagal Bayar"
    assert got["1"]["reason"] == "Positif review — not classified as a complaint."
    assert got["6"]["reason"].startswith("Rating 5★ tanpa keluhan eksplisit")


def test_model_scores(spark):
    got = run(spark, SCORED, fixture_taxonomy(spark), spark.createDataFrame(SCORES, schemas.SCORES))
    check(got, SCORED)
    assert not got["s1"]["escalated"] and got["s1"]["layer2"] == "UMUM"


def test_empty_taxonomy_still_escalates(spark):
    empty = Taxonomy(spark.createDataFrame([], "ord long, " + schemas.TAXONOMY))
    got = run(spark, CASES, empty)
    for key in ("3", "4", "5", "9", "10", "e4"):
        assert got[key]["escalated"] and got[key]["layer4"] == "" and got[key]["layer5"] == ""
    assert got["3"]["reason"] == "Negative complaint: APLIKASI > Token & Pembayaran"


def test_only_negative_reviews_are_complaints(spark):
    got = run(spark, CASES + SCORED, fixture_taxonomy(spark)).values()
    assert all(r["sentiment"] == "Negatif" for r in got if r["is_complaint"])
    assert all(r["layer1"] == "" for r in got if not r["is_complaint"])


def brute_totals(low):
    neg = pos = 0.0
    for p, w in {**lx.NEGATIVE, **lx.POSITIVE}.items():
        if " " in p and p in low:
            if p in lx.NEGATIVE:
                neg += w
            else:
                pos += w
    words = low.split()
    for i, w in enumerate(words):
        turned = any(x in lx.NEGATORS for x in words[max(0, i - 2):i])
        for side, lexicon in (("n", lx.NEGATIVE), ("p", lx.POSITIVE)):
            if w in lexicon:
                amount = lexicon[w] * (0.5 if turned else 1)
                if (side == "n") != turned:
                    neg += amount
                else:
                    pos += amount
    return neg, pos


def test_lexicon_totals_against_brute_force(spark):
    rng = random.Random(5)
    pool = list(lx.NEGATIVE) + list(lx.POSITIVE) + lx.NEGATORS + ["x", "error,", "yang", "juga"]
    rows = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, low string")
    neg_p, pos_p = se.SentimentRules().phrase_weights()
    both = [*neg_p, *pos_p]
    df = df.select("i", "low", se.signed_weights(tx.tokens(F.col("low"))).alias("w"), tx.substrings_found(F.col("low"), both).alias("h"))
    neg, pos = se.side_totals(F.col("w"))
    df = df.select("i", (neg + se.phrase_score(F.col("h"), neg_p, both)).alias("n"), (pos + se.phrase_score(F.col("h"), pos_p, both)).alias("p"))
    assert [(r["n"], r["p"]) for r in df.orderBy("i").collect()] == [brute_totals(r) for r in rows]


def test_best_score_takes_the_first_on_ties(spark):
    df = spark.sql("select array(named_struct('label','a','score',0.4D), named_struct('label','b','score',0.4D)) s, "
                   "cast(array() as array<struct<label:string,score:double>>) e")
    r = df.select(se.best_score(F.col("s")).alias("s"), se.best_score(F.col("e")).alias("e")).first()
    assert r["s"]["label"] == "a" and r["e"] is None


def test_weights_of_hits_are_those_of_all_words(spark):
    from complaintflow.functions import sentiment as st
    rng = random.Random(5)
    words = [*list(st.SentimentRules().signed_words())[:30], *st.SentimentRules().negators, "x", "", "saya"]
    data = [([rng.choice(words) for _ in range(n)],) for n in range(60)] + [(None,)]
    df = spark.createDataFrame(data, "w array<string>").select(st.signed_weights(F.col("w")).alias("a"), st.hit_weights(F.col("w")).alias("h"))
    for r in df.collect():
        assert [x for x in r["h"] or []] == [x for x in r["a"] or [] if x]


def test_few_row_groups_are_spread(spark, tmp_path):
    from complaintflow.sources import tables
    cores = spark.sparkContext.defaultParallelism
    spark.range(2000).selectExpr("id", "repeat('x', 10) AS t").coalesce(1).write.parquet(f"{tmp_path}/one")
    spread = tables.spread(spark.read.parquet(f"{tmp_path}/one"))
    assert spread.rdd.getNumPartitions() == tables.SPREAD * cores and spread.count() == 2000
    many = spark.range(0, 100, 1, tables.SPREAD * cores)
    assert tables.spread(many) is many
