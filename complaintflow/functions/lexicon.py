"""Default word lists of the Indonesian utility-app domain.

Every operator takes its lists as arguments; these are only the defaults.
"""

from __future__ import annotations

# --- fixed values: slang dictionary (token -> replacement) -------------------
SLANG: dict[str, str] = {
    "gak": "tidak", "ga": "tidak", "ngga": "tidak", "nggak": "tidak", "tdk": "tidak",
    "ndak": "tidak", "enggak": "tidak", "kagak": "tidak", "gx": "tidak",
    "gabisa": "tidak bisa", "gakbisa": "tidak bisa",
    "udah": "sudah", "udh": "sudah", "dah": "sudah", "sdh": "sudah", "dh": "sudah",
    "blm": "belum", "blum": "belum", "belom": "belum",
    "gimana": "bagaimana", "gmn": "bagaimana", "knp": "kenapa",
    "ngapain": "mengapa", "apaan": "apa", "gimna": "bagaimana",
    "bgt": "banget", "bngt": "banget", "bet": "banget",
    "sgt": "sangat", "sangad": "sangat",
    "bener": "benar", "bnr": "benar", "emang": "memang", "emg": "memang",
    "sy": "saya", "aq": "aku", "ak": "aku", "gue": "saya", "gw": "saya", "ane": "saya",
    "lo": "kamu", "lu": "kamu", "elu": "kamu", "loe": "kamu",
    "yg": "yang", "dgn": "dengan", "dg": "dengan", "utk": "untuk", "tuk": "untuk",
    "sm": "sama", "jg": "juga", "krn": "karena", "karna": "karena",
    "klo": "kalau", "kalo": "kalau", "klw": "kalau", "klu": "kalau",
    "tp": "tapi", "tpi": "tapi", "ttp": "tetap",
    "dr": "dari", "pd": "pada", "dlm": "dalam", "thd": "terhadap",
    "sdg": "sedang", "lg": "lagi", "msh": "masih", "skrg": "sekarang",
    "kmrn": "kemarin", "bs": "bisa", "dpt": "dapat", "hrs": "harus",
    "org": "orang", "byk": "banyak", "bnyak": "banyak", "bnyk": "banyak",
    "aja": "saja", "aj": "saja", "dlu": "dulu", "dlo": "dulu", "dl": "dulu",
    "tlg": "tolong", "pls": "tolong", "pliss": "tolong", "plz": "tolong",
    "sgr": "segera", "sprti": "seperti", "spt": "seperti", "scr": "secara",
    "msk": "masuk", "hr": "hari", "bln": "bulan", "thn": "tahun",
    "eror": "error", "errror": "error", "erro": "error",
    "byar": "bayar", "byr": "bayar",
    "tghn": "tagihan", "tgihn": "tagihan", "tagihn": "tagihan",
    "tokn": "token", "toekn": "token",
    "listik": "listrik", "listirk": "listrik", "lisrtik": "listrik",
    "pemadamn": "pemadaman",
    "aplikas": "aplikasi", "aplkasi": "aplikasi", "apk": "aplikasi",
    "pembayarn": "pembayaran", "pmbayaran": "pembayaran",
    "petugs": "petugas", "ptgas": "petugas",
    "gngguan": "gangguan",
    "loadingg": "loading", "loadinggg": "loading", "lodaing": "loading",
    "install": "instal", "update": "perbarui", "upgrd": "perbarui",
    "notif": "notifikasi", "notifiksi": "notifikasi",
    "pasword": "password", "passwrd": "password",
    "regis": "registrasi", "rgstrasi": "registrasi",
    "verikasi": "verifikasi", "veriikasi": "verifikasi",
    "makasih": "terima kasih", "mksih": "terima kasih", "mksh": "terima kasih",
    "mks": "terima kasih", "trmksh": "terima kasih", "thx": "terima kasih",
    "thanks": "terima kasih", "tq": "terima kasih",
    "cpt": "cepat", "cpat": "cepat", "cepet": "cepat",
    "lemot": "lambat", "lelet": "lambat", "lmot": "lambat",
    "pdhl": "padahal", "pdahal": "padahal",
    "lngsg": "langsung", "lgsg": "langsung",
    "hbs": "habis", "abis": "habis",
    "mulu": "terus", "trus": "terus", "trs": "terus", "mlulu": "terus",
    "kebuka": "dibuka", "kebaca": "terbaca",
    "gampang": "mudah", "ribet": "rumit",
    "benerin": "perbaiki", "beresin": "selesaikan",
    "nyambung": "terhubung", "konek": "terhubung",
    "donk": "dong", "dunk": "dong",
    "ny": "nya", "nnya": "nya",
    "nih": "ini", "tuh": "itu",
    "lah": "", "sih": "", "deh": "", "dong": "", "yah": "",
    "wkwk": "", "wkwkwk": "", "haha": "", "hehe": "", "hihi": "",
    "hmm": "", "mmm": "", "ehh": "", "ahh": "",
    "mhon": "mohon", "mhn": "mohon",
    "yth": "yang terhormat", "dll": "dan lain-lain", "dsb": "dan sebagainya",
    "tsb": "tersebut", "svr": "server",
}

# --- fixed values: dictionary used when no slang file is found ---------------
MINIMAL_SLANG: dict[str, str] = {
    "gak": "tidak", "ga": "tidak", "ngga": "tidak", "nggak": "tidak", "tdk": "tidak",
    "udah": "sudah", "udh": "sudah", "blm": "belum", "emang": "memang",
    "bgt": "banget", "yg": "yang", "dgn": "dengan", "utk": "untuk",
    "krn": "karena", "klo": "kalau", "kalo": "kalau", "tp": "tapi",
    "bs": "bisa", "hrs": "harus", "msh": "masih", "sgr": "segera",
    "tlg": "tolong", "eror": "error", "apk": "aplikasi", "trs": "terus",
    "mulu": "terus", "lemot": "lambat", "notif": "notifikasi",
    "makasih": "terima kasih", "thx": "terima kasih",
}

# --- fixed values: emoji -> word, applied in this order ----------------------
EMOJI: dict[str, str] = {
    "😡": "marah", "😠": "marah", "🤬": "marah", "😤": "kesal",
    "😭": "kecewa", "😢": "sedih", "😞": "kecewa", "😔": "kecewa",
    "😩": "frustrasi", "🤯": "frustrasi", "👎": "buruk",
    "❌": "gagal", "⚠️": "peringatan",
    "😊": "senang", "👍": "bagus", "🙏": "mohon",
    "😍": "suka", "⭐": "bintang", "🔥": "panas",
}

# --- fixed values: acronyms, words never stemmed, fillers --------------------
ACRONYMS: list[str] = [
    "pln", "otp", "idpel", "spklu", "splu", "spbklu", "kwh", "kva", "lsp", "slo", "nidi",
    "p2tl", "pb", "pd", "ps", "ev", "plts", "bpjs", "qris", "cc", "faq", "url", "ui", "ux",
    "api", "sms",
]

NO_STEM: list[str] = [
    "error", "loading", "token", "tagihan", "bayar", "listrik", "padam", "gangguan",
    "pengaduan", "aplikasi", "pembayaran", "registrasi", "verifikasi", "notifikasi", "password",
    "akun", "login", "install", "update", "server", "database", "tidak", "sudah", "belum",
    "karena", "kalau", "tapi", "saja", "tolong", "segera", "sangat", "banget", "masih", "terus",
    "masuk", "keluar", "perbaiki", "diperbaiki", "perbarui", "diperbarui",
]

FILLERS: list[str] = [
    "wkwk", "wkwkwk", "wkwkwkwk", "haha", "hehe", "hihi", "huhu", "xixi", "hahaha", "hehehehe",
    "hmm", "mmm", "umm",
]

# --- fixed values: sentiment lexicons (phrase -> weight) ---------------------
NEGATIVE: dict[str, int] = {
    "error": 3, "eror": 3, "gagal": 3, "tidak bisa": 3, "tidak masuk": 3, "crash": 3,
    "mati": 3, "padam": 3, "rusak": 3, "bermasalah": 3, "penipuan": 3, "tipu": 3,
    "kecewa": 2, "buruk": 2, "jelek": 2, "parah": 2, "lambat": 2, "lemot": 2, "susah": 2,
    "sulit": 2, "ribet": 2, "mahal": 2, "gangguan": 2, "menyebalkan": 2,
    "lama": 1, "kurang": 1, "belum": 1,
}
POSITIVE: dict[str, int] = {
    "sangat bagus": 3, "sangat membantu": 3, "luar biasa": 3, "terbaik": 3, "sempurna": 3,
    "bagus": 2, "baik": 2, "mantap": 2, "mudah": 2, "cepat": 2, "lancar": 2, "membantu": 2,
    "puas": 2, "terima kasih": 2, "makasih": 2, "keren": 2, "mantaap": 2, "recommend": 2,
    "oke": 1, "lumayan": 1, "berhasil": 1,
}
NEGATORS: list[str] = ["tidak", "ga", "gak", "ngga", "nggak", "bukan", "jangan", "belum"]

# --- fixed values: override phrases ------------------------------------------
STRONG_POSITIVE: list[str] = [
    "sangat membantu", "sangat bagus", "sangat baik", "sangat mudah",
    "sangat cepat", "sangat puas", "sangat senang", "sangat memuaskan",
    "sangat canggih", "sangat lengkap", "sangat praktis", "sangat mempermudah",
    "sangat terbantu", "terbantu sekali", "membantu sekali", "bagus sekali",
    "baik sekali", "mudah sekali", "cepat sekali",
    "luar biasa", "terbaik", "sempurna", "top banget", "bagus banget",
    "keren banget", "mantap banget", "membantu banget", "mudah banget",
    "cepat banget", "mantap", "mantaap", "mantaaap", "mantaaaap",
    "keren", "mantul", "kece", "josss", "josss banget",
    "aplikasi terbaik", "aplikasi bagus", "aplikasi keren", "aplikasi mantap",
    "terima kasih pln", "makasih pln", "thanks pln", "terimakasih pln",
    "puas dengan", "puas banget",
    "recommend", "direkomendasikan", "rekomendasikan",
    "memudahkan", "mempermudah", "mempercepat",
]
EXPLICIT_NEGATIVE: list[str] = [
    "tidak bisa", "tidak mau", "tidak berfungsi", "tidak bekerja",
    "tidak jalan", "tidak berhasil", "tidak masuk", "tidak nyala",
    "tidak keluar", "tidak muncul", "tidak bisa dibuka", "tidak bisa login",
    "tidak bisa bayar", "tidak bisa transfer", "tidak bisa top up",
    "ga bisa", "gak bisa", "ngga bisa",
    "error", "eror", "gagal", "crash", "hang", "force close",
    "lemot banget", "lambat banget", "loading terus", "loading lama",
    "byar pet", "byarpet",
    "kecewa", "mengecewakan", "sangat kecewa", "sangat mengecewakan",
    "tolong perbaiki", "mohon diperbaiki", "harap diperbaiki", "segera perbaiki",
    "tolong diperbaiki", "minta diperbaiki",
    "buruk", "jelek", "parah", "sampah", "zonk", "bohong", "penipuan",
    "tidak berguna", "tidak ada gunanya", "tidak membantu",
    "susah banget", "sulit banget", "ribet banget", "bermasalah terus",
    "kok tidak", "kok gak", "kok ga", "masa iya", "kenapa harus",
    "kapan diperbaiki", "kapan beres", "sudah lapor tapi",
    "otp tidak", "otp ga", "token tidak masuk", "token ga masuk",
]

# --- fixed values: keyword votes per label (order breaks ties) ---------------
L3_KEYWORDS: dict[str, list[str]] = {
    "Token & Pembayaran": ["token", "bayar", "pembayaran", "tagihan", "transaksi", "saldo", "top up", "topup"],
    "Akun PLN Mobile": ["login", "akun", "registrasi", "daftar", "otp", "password", "verifikasi", "email"],
    "Pengaduan": ["padam", "mati", "gangguan", "listrik", "byar pet", "nyala", "trip", "meteran", "meter"],
    "ICONNET": ["iconnet", "internet", "wifi", "indihome"],
    "Catat Meter": ["stand meter", "catat meter", "angka meter"],
}
L1_KEYWORDS: dict[str, list[str]] = {
    "APLIKASI": ["aplikasi", "app", "login", "error", "crash", "loading", "token", "bayar", "akun"],
    "LAYANAN": ["padam", "mati", "gangguan", "petugas", "pengaduan", "respon", "cs", "layanan"],
}
DEFAULT_L1 = "APLIKASI"
DEFAULT_L2 = "KETENAGALISTRIKAN"
DEFAULT_L3 = "Pengaduan"
GENERAL = "UMUM"
MISREAD_STAR = "Salah Mengartikan Bintang 1"

# --- fixed values: model label names and source tags -------------------------
SENTIMENT_LABELS: dict[str, str] = {"LABEL_0": "Positif", "LABEL_1": "Netral", "LABEL_2": "Negatif"}
POS_LABEL, NEU_LABEL, NEG_LABEL = "Positif", "Netral", "Negatif"
SOURCE_LEXICON = "fallback"
SOURCE_SENTIMENT_MODEL = "IndoBERT-local"
SOURCE_KEYWORD = "keyword"
SOURCE_LABEL_MODEL = "IndoBERT"
RESCUE_SUFFIX = "+rating_rescue"
RARE_LABEL = "Lainnya"

# --- fixed values: reason texts ----------------------------------------------
REASON_RESCUED = "tanpa keluhan eksplisit — model sentimen awal salah baca istilah domain PLN, dikoreksi jadi Positif."
REASON_NO_COMPLAINT = " review — not classified as a complaint."
REASON_MISREAD = f"dengan teks positif — terdeteksi sebagai '{MISREAD_STAR}' (inkonsistensi rating vs konten)."
REASON_COMPLAINT = "Negative complaint: "
