"""Views over the test tables in the shapes the operators work on.

Every view has one row per source row (or per source row and copy); texts are the whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.operators.taxonomy import Taxonomy
from complaintflow.sources.tables import spread

# Openings put in front of most documents, so that every rule meets matching text.
OPENINGS = [
    "Waduh, app nya eror trs gk bs masuk udh 5hari!!! mhn dibenerin 😡",
    "loadinggg aja seharian, menu ga mau kebuka wkwk",
    "kode otp blm msk2 ke hp, udh coba brkali2 tp gagal mulu",
    "knp listrik rumah saya mati mulu pdhl tagihan udh lunas kmrn!!!",
    "tagihan bln ini naik bnyk bgt, pemakaian sm aja kok, gmn ya???",
    "aplikas lemot bgt dr pagi, tlg di update dong min",
    "makasih min, byr listrik jd gampang bgt, sangad terbantu",
    "apk eror mulu, notif gak muncul sama sekali 😤",
    "saldo sdh terpotong tapi pembayaran gagal, uang belum kembali",
    "padam 4hari di kampung kami, petugas gak ada yg datang",
    "mantap sekali, sangat membantu keluarga kami, terima kasih",
    "bagus banget, mudah digunakan, layanan terbaik",
    "error terus waktu beli token, sudah seminggu tidak bisa",
    "bukan aplikasi bagus - tidak baik, gak lancar",
    "sudah bayar tapi token tidak masuk, gagal terus",
    "laporan gangguan listrik melalui PLN mobile",
    "lihat https://contoh.example/x?y=2 ya!! pulsa 2000 hilang .. tahun 2021",
    "bayar tagihan gampang dan cepat cepet2 😊👍",
    "dulu saya kasih bintang 5 tapi sekarang tidak bisa login sama sekali",
    "bagus sih tapi lambat dan sulit / gak - paham",
]

TAXONOMY_ROWS = [
    (1, "APLIKASI", "KETENAGALISTRIKAN", "Token & Pembayaran", "Gagal Bayar", "Saldo Terpotong", "Keandalan"),
    (2, "APLIKASI", "KETENAGALISTRIKAN", "Token & Pembayaran", "Gagal Bayar", "Metode Ditolak", "Keandalan"),
    (3, "APLIKASI", "KETENAGALISTRIKAN", "Token & Pembayaran", "Token Tidak Masuk", "Token Tertunda", "Kecepatan"),
    (4, "APLIKASI", "KETENAGALISTRIKAN", "Pengaduan", "Pendaftaran Baru", "Formulir Gagal", "Kemudahan"),
    (5, "APLIKASI", "KETENAGALISTRIKAN", "Akun PLN Mobile", "Pendaftaran Baru", "OTP Tidak Masuk", "Keandalan"),
    (6, "LAYANAN", "KETENAGALISTRIKAN", "Pengaduan", "Padam", "Padam Meluas", "Responsivitas"),
    (7, "LAYANAN", "KETENAGALISTRIKAN", "Pengaduan", "Padam", "Padam Rumah", "Responsivitas"),
    (8, "LAYANAN", "KETENAGALISTRIKAN", "Pengaduan", "Respon Petugas", None, None),
    (9, "LAYANAN", None, "Catat Meter", "Salah Catat", "Angka Beda", "Akurasi"),
    (10, "LAYANAN", "LAINNYA", "ICONNET", "Internet Lambat", "Padam Meluas", "Kecepatan"),
    (11, "APLIKASI", "KETENAGALISTRIKAN", "Token & Pembayaran", "Gagal Bayar", "Saldo Terpotong", "Ketepatan"),
    (12, "UMUM", "UMUM", "Salah Mengartikan Bintang 1", None, None, None),
]

# The labels of ``predictions``, known to the caller.
PREDICTION_LABELS = ["de", "en", "es", "fr", "other"]

RAW_LABELS = [
    ("1. APLIKASI", "1.1 KETENAGALISTRIKAN", "1.1 Token & Pembayaran", "Gagal Bayar", "Saldo Terpotong"),
    ("APLIKASI", "KETENAGALISTRIKAN", "Token dan Pembayaran", "Gagal  Bayar", "Metode Tolak"),
    ("APLIKASI", "KETENAGALISTRIKAN", "Token & Pembayarn", "Token Tidak Masuk", None),
    ("APLIKASI", "KETENAGALISTRIKAN", "pengaduan", "Pendaftaran", "Formulir Gagal"),
    ("APLIKASI", "KETENAGALISTRIKAN", "Akun PLN", "3 phase", "12"),
    ("LAYANAN", "KETENAGALISTRIKAN", "Meteran Rusak", "Padam", "Padam Rumh"),
    ("LAYANAN", "LAINNYA", "Padam", " ", "OTP"),
    ("LAYANAN", None, "Pengaduan", "Respon Petugas", "x"),
    (None, "KETENAGALISTRIKAN", "Pengaduan", "Padam", "Padam Meluas"),
    ("LAYANAN", "KETENAGALISTRIKAN", "1.1.1 Pengaduan", "Respon Petugas", "Lambat"),
    ("LAYANAN", "1.2. LAINNYA", "ICONNET", "Internet Lmbat", "Padam Meluas"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(start: str, minutes: str) -> Column:
    return F.expr(f"timestamp_ntz'{start}' + make_dt_interval(0, 0, cast({minutes} as int))")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document; ratings 1 to 5 and missing ones, independent of the opening."""
    slot = F.col("doc_id") % 24
    opening = F.get(F.lit(OPENINGS), slot.cast("int"))
    return spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("r"), F.col("doc_id")).alias("id"), F.col("source").alias("username"),
        F.when(slot < 20, F.concat(opening, F.lit(" "), F.col("text"))).otherwise(F.col("text")).alias("review_text"),
        F.expr("cast(nullif((doc_id div 24) % 6, 0) as int)").alias("rating"),
        _minutes("2024-01-01 00:00:00", "doc_id").alias("review_date"), F.col("lang").alias("app_version"),
        _minutes("2024-02-01 00:00:00", "doc_id % 500").alias("scraped_at"))


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store-page rows with defects: missing keys, dates, scores, short and missing texts, and a
    second copy of every fifth row under the same key."""
    docs = table(spark, sf_dir, "documents")
    copies = docs.withColumn("copy", F.explode(F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return copies.select(
        F.expr("CASE WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 37 = 0 THEN NULL ELSE concat('r', doc_id) END").alias("review_id"),
        F.col("source").alias("user_name"),
        F.expr("CASE WHEN doc_id % 13 = 0 THEN source WHEN doc_id % 43 = 0 THEN NULL "
               "ELSE concat(text, ' ', copy) END").alias("content"),
        F.expr("cast(nullif((doc_id div 3) % 6, 0) as int)").alias("score"),
        F.expr("CASE WHEN doc_id % 29 = 0 THEN NULL ELSE timestamp_ntz'2024-01-01 00:00:00' "
               "+ make_dt_interval(0, cast(doc_id % 2000 as int)) END").alias("at"),
        F.expr("nullif(lang, 'de')").alias("app_version"),
        F.expr("(doc_id * 7) % 101").alias("relevance"),
        F.expr("doc_id * 2 + copy").alias("arrival"))


def stored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews known from before: those whose document has a label."""
    known = table(spark, sf_dir, "labels").select(F.concat(F.lit("r"), F.col("doc_id")).alias("id"))
    return reviews(spark, sf_dir).join(known, "id", "left_semi")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results, one per event; a review has up to nine of them, some have no review."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.expr("concat('a', event_id)").alias("result_id"), F.expr("concat('r', event_id div 9 * 2)").alias("review_id"),
        F.col("props").alias("normalized_text"),
        F.expr("CASE WHEN event_type IN ('error', 'view') THEN 'Negatif' ELSE 'Positif' END").alias("sentiment"),
        F.lit("fallback").alias("sentiment_source"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 97) / 100.0D END").alias("sentiment_confidence"),
        F.expr("event_type IN ('error', 'view') AND event_id % 10 <> 0").alias("is_complaint"),
        F.expr("CASE event_id % 4 WHEN 2 THEN '' WHEN 1 THEN 'LAYANAN' ELSE 'APLIKASI' END").alias("category"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('Sub', event_id % 3) END").alias("subcategory"),
        F.expr("(event_id % 50) / 50.0D").alias("classification_confidence"),
        F.expr("(event_id % 25) / 25.0D").alias("confidence"), F.col("event_type").alias("reason"),
        F.expr("event_id % 6 = 0").alias("escalated"),
        F.expr("CASE event_id % 4 WHEN 2 THEN '' WHEN 1 THEN 'LAYANAN' ELSE 'APLIKASI' END").alias("layer1"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN '' ELSE 'KETENAGALISTRIKAN' END").alias("layer2"),
        F.expr("CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('L', event_id % 5) END").alias("layer3"),
        F.expr("concat('M', event_id % 8)").alias("layer4"), F.expr("concat('N', event_id % 9)").alias("layer5"),
        F.expr("concat('q', event_id % 2)").alias("quality_param"),
        F.expr("cast(date_trunc('SECOND', ts) as timestamp_ntz)").alias("analyzed_at"))


def flag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual flags from events of two kinds; later ones undo earlier ones, some hit no result."""
    return table(spark, sf_dir, "events").filter("event_type IN ('click', 'signup')").select(
        F.expr("concat('a', event_id div 2 * 3)").alias("result_id"), F.expr("event_type = 'click'").alias("flagged"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN '  ' ELSE concat(' note ', event_id, ' ') END").alias("note"),
        F.expr("cast(ts as timestamp_ntz)").alias("flagged_at"))


def fixture_taxonomy(spark: SparkSession) -> Taxonomy:
    return Taxonomy(spark.createDataFrame(
        TAXONOMY_ROWS, "ord long, l1 string, l2 string, l3 string, l4 string, l5 string, param string"))


def part_taxonomy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy that grows with the part table, with gaps on every level."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS ord", "p_type AS l1", "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_brand END AS l2",
        "split_part(p_name, ' ', 1) AS l3", "CASE WHEN p_partkey % 23 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS l4",
        "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('size ', p_size % 5) END AS l5",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat('q', p_partkey % 4) END AS param")


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths asked for by order lines; the brand comes from the supplier, so many are unknown."""
    line = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name")
    return line.join(part, "l_partkey").selectExpr(
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id", "l_orderkey", "l_linenumber", "p_type AS l1",
        "concat('Brand#', 1 + l_suppkey % 25) AS l2", "split_part(p_name, ' ', 1) AS l3",
        "split_part(p_name, ' ', 2) AS l4", "concat('size ', l_suppkey % 6) AS l5")


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows per review as a model would give them; some reviews and targets have none."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "concat('r', doc_id) AS review_id")
    sentiment = docs.filter("lang <> 'de'").selectExpr(
        "review_id", "'sentiment' AS target",
        "posexplode(array((doc_id * 7) % 100 / 100.0D, (doc_id * 11) % 100 / 100.0D, (doc_id * 13) % 100 / 100.0D)) AS (ord, score)")
    sentiment = sentiment.selectExpr("review_id", "target", "ord", "concat('LABEL_', ord) AS label", "score")
    layers = docs.filter("lang IN ('en', 'es')").selectExpr(
        "review_id", "doc_id", "posexplode(array('layer1', 'layer3')) AS (ord, target)")
    layers = layers.selectExpr(
        "review_id", "target", "0 AS ord",
        "CASE WHEN target = 'layer1' THEN CASE WHEN doc_id % 2 = 1 THEN 'LAYANAN' ELSE 'APLIKASI' END "
        "ELSE CASE WHEN doc_id % 3 = 1 THEN 'Pengaduan' WHEN doc_id % 7 = 5 THEN '' ELSE 'Token & Pembayaran' END END AS label",
        "(doc_id * 3) % 100 / 100.0D AS score")
    lower = docs.filter("lang <> 'fr'").selectExpr(
        "review_id", "doc_id", "posexplode(array('Gagal Bayar', 'Token Tidak Masuk', 'Padam', 'Respon Petugas', "
        "'Padam Meluas', 'Padam Rumah', 'Saldo Terpotong', 'Metode Ditolak', 'not in the taxonomy')) AS (ord, label)")
    lower = lower.selectExpr("review_id", "CASE WHEN ord < 4 THEN 'layer4' ELSE 'layer5' END AS target", "ord", "label",
                             "(doc_id * (ord + 2)) % 100 / 100.0D AS score")
    return sentiment.unionByName(layers).unionByName(lower)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with raw human labels in the headers of the wide report (one with stray blanks)."""
    docs = table(spark, sf_dir, "documents")
    raw = F.get(F.lit([list(r) for r in RAW_LABELS]), (F.col("doc_id") % 11).cast("int"))
    text = F.expr("CASE WHEN doc_id % 41 = 0 THEN NULL ELSE text END")
    return docs.select(F.col("doc_id").alias("row"), text.alias(" ISI ULASAN "),
                       *[F.get(raw, F.lit(i - 1)).alias(f"LAYER {i}") for i in range(1, 6)])


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a class: source within language, so some classes are rare."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS row", "text", "CASE WHEN doc_id % 47 = 0 THEN NULL WHEN lang = 'en' THEN lang ELSE concat(lang, '-', source) END AS label")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages against a defective guess that also names a class without support."""
    return table(spark, sf_dir, "documents").selectExpr(
        "lang AS actual", "CASE WHEN doc_id % 7 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'other' ELSE lang END AS predicted")
