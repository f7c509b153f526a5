"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in Spark SQL expressions.

A number or date that is valid in its format is taken as a point (l, r) of Z_a x Z_b, ten alternating rounds add a keyed
hash of one half to the other modulo its size, and the point is written in the same format. That is a permutation of the
format's values, so equal values get equal pseudonyms in all documents and different ones stay different. E-mail names and
credentials are permuted character by character within their alphabets, half against half.

    card     Luhn-valid, 13 to 19 digits, plain or in groups; first digit and separators stay, the check digit is renewed
    phone    North American numbers as written; country code and punctuation stay. Areas and exchanges that may be dialled
             (200 and up) stay so; the other numbers are permuted among themselves
    ip       four octets
    date     YYYY-MM-DD, DD.MM.YYYY and DD/MM/YYYY from 1901 to 2096, moved within its 28 years
    ssn      valid areas, groups and serials
    email    the name before the @; the domain stays
    secret   values after password=/token=/secret=/api_key=, and AKIA access keys

Numbers that fail their check stay as they are. Nothing is shuffled and no Python runs on the rows.

Defined results: a null text stays null with no values counted; empty texts stay; very long texts are processed whole;
repeated rows are treated alike; an empty table gives an empty result; all columns of the input are kept, and a name for the
counts that clashes with them is an error.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.llm.shared import columns, table

#: The session setting that holds the key. Whoever has it can undo the pseudonyms, so it isn't in here.
KEY_SETTING = "spark.complaintflow.pseudonyms.key"
ROUNDS = 10

# Formats. No group repeats over alternatives, so that the matcher needs no deep stack on long texts.
SECRET = r"(?<![A-Za-z0-9_])(?:(?i:password|passwd|token|secret|api_key) ?[=:] ?\"?[A-Za-z0-9_\-]{12,}+\"?|AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){1,8}"
PHONE = r"(?<![\w+.\-])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![\w\-])"
IP = r"(?<![\w.\-])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![\w\-]|\.[0-9])"
DATE = r"(?<![\w.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w\-/]|\.[0-9])"
SSN = r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])"
CARD = (r"(?<![\w\-])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}"
        r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![\w\-])")
KINDS = {"secret": SECRET, "email": EMAIL, "phone": PHONE, "ip": IP, "date": DATE, "ssn": SSN, "card": CARD}
ANY = "|".join(KINDS.values())
#: Every format holds a digit, an @, or an assignment; texts without any of them are not searched further.
HINT = "[0-9@=:]"


def _hash(kind: str, key: str, turn: Column, half: Column) -> Column:
    """A keyed number below 2^56."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{kind}|"), turn.cast("string"), F.lit("|"), half), 256), 1, 14), 16, 10).cast("long")


def feistel(kind: str, key: str, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
    """A permutation of Z_a x Z_b: a struct (l, r)."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))
    state = lambda l, r: F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), state(left, right),
        lambda s, i: F.when(i % 2 == 1, state(F.pmod(s["l"] + _hash(kind, key, i, s["r"].cast("string")), a), s["r"]))
        .otherwise(state(s["l"], F.pmod(s["r"] + _hash(kind, key, i, s["l"].cast("string")), b))))


def letters(kind: str, key: str, value: Column) -> Column:
    """A permutation of texts of one pattern: every character stays in its alphabet, others stay. Letters up to f are an
    alphabet of their own, so hexadecimal texts stay hexadecimal."""
    alphabets = {"[0-9]": "0123456789", "[a-f]": "abcdef", "[g-z]": "ghijklmnopqrstuvwxyz", "[A-F]": "ABCDEF", "[G-Z]": "GHIJKLMNOPQRSTUVWXYZ"}
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")

    def moved(half: Column, other: Column, turn: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), turn.cast("string"), F.lit("|"), other), 512)

        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substr(digest, (i * 4) % 124 + 1, F.lit(4)), 16, 10).cast("int")
            pick = lambda alphabet: F.substr(F.lit(alphabet), (F.instr(F.lit(alphabet), c) - 1 + by) % len(alphabet) + 1, F.lit(1))
            out = c
            for test, alphabet in alphabets.items():
                out = F.when(c.rlike(test), pick(alphabet)).otherwise(out)
            return out

        return F.array_join(F.transform(chars(half), one), "")

    cut = F.ceil(F.length(value) / 2).cast("int")
    state = lambda l, r: F.struct(l.alias("l"), r.alias("r"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(F.substr(value, F.lit(1), cut), F.substr(value, cut + 1)),
                      lambda s, i: F.when(i % 2 == 1, state(moved(s["l"], s["r"], i), s["r"])).otherwise(state(s["l"], moved(s["r"], s["l"], i))),
                      lambda s: F.concat(s["l"], s["r"]))
    return F.when(F.length(value) > 0, out).otherwise(value)


def luhn(digits: Column) -> Column:
    """The sum that a valid number has divisible by ten."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))),
                       F.lit(0), lambda s, d: s + d)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(pattern: Column, digits: Column) -> Column:
    """The digits in the places of the pattern's digits."""
    step = F.aggregate(F.filter(F.split(pattern, ""), lambda c: c != ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
                       lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["text"], F.substr(digits, s["at"], F.lit(1))).alias("text"), (s["at"] + 1).alias("at")))
                       .otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["at"].alias("at"))))
    return step["text"]


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d) - 2
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.element_at(F.array(*(F.lit(10 ** i) for i in range(1, 11))), k)
    p = feistel("card", key, F.substr(d, F.lit(2), half), F.substr(d, half + 2, n - half), size(half), size(n - half))
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _pad(p["l"], half), _pad(p["r"], n - half))
    check = (10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when((luhn(d) % 10 == 0) & (F.regexp_replace(d, "0", "") != ""), _refill(m, F.concat(body, check.cast("string"))))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    area, rest = F.substr(d, F.length(d) - 9, F.lit(3)).cast("int"), F.right(d, F.lit(7)).cast("long")
    # three domains that together hold all ten-digit numbers: valid ones, areas below 200, exchanges below 200 in other areas
    low_area, low_rest = area < 200, rest < 2_000_000
    first = F.when(low_area, 0).otherwise(200)
    from_rest = F.when(low_area | low_rest, 0).otherwise(2_000_000)
    p = feistel("phone", key, area - first, rest - from_rest, F.when(low_area, 200).otherwise(800).cast("long"),
                F.when(low_area, 10_000_000).when(low_rest, 2_000_000).otherwise(8_000_000).cast("long"))
    return _refill(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), _pad(p["l"] + first, 3), _pad(p["r"] + from_rest, 7)))


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    p = feistel("ip", key, o[0].cast("int") * 256 + o[1].cast("int"), o[2].cast("int") * 256 + o[3].cast("int"), 65536, 65536)
    return F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256)))


def _date(m: Column, key: str) -> Column:
    """28 years from 1901 on hold 10 227 = 21 x 487 days, whatever the window."""
    iso = m.rlike("^[0-9]{4}-")
    day = F.try_to_date(F.when(iso, m).otherwise(F.concat(F.substr(m, F.lit(7), F.lit(4)), F.lit("-"), F.substr(m, F.lit(4), F.lit(2)), F.lit("-"), F.substr(m, F.lit(1), F.lit(2)))), "yyyy-MM-dd")
    start = F.make_date(1901 + F.lit(28) * F.floor((F.year(day) - 1901) / 28).cast("int"), F.lit(1), F.lit(1))
    at = F.datediff(day, start)
    p = feistel("date", key, F.floor(at / 487), at % 487, 21, 487)
    to = F.date_add(start, (p["l"] * 487 + p["r"]).cast("int"))
    sep = F.substr(m, F.lit(3), F.lit(1))
    return F.when(day.isNotNull() & F.year(day).between(1901, 2096),
                  F.when(iso, F.date_format(to, "yyyy-MM-dd"))
                  .otherwise(F.concat(F.date_format(to, "dd"), sep, F.date_format(to, "MM"), sep, F.date_format(to, "yyyy"))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    p = feistel("ssn", key, area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    new = p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)
    return F.when(valid, F.concat_ws("-", _pad(new, 3), _pad(F.floor(p["r"] / 9999) + 1, 2), _pad(p["r"] % 9999 + 1, 4)))


def _email(m: Column, key: str) -> Column:
    return F.concat(letters("email", key, F.substring_index(m, "@", 1)), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    parts = r'^(AKIA|[^=:]*[=:] ?"?)([A-Za-z0-9_\-]*)("?)$'
    return F.concat(F.regexp_extract(m, parts, 1), letters("secret", key, F.regexp_extract(m, parts, 2)), F.regexp_extract(m, parts, 3))


def session_key(spark: SparkSession) -> str:
    """The key of the session's settings. A session without one gets a random key for as long as it lasts: equal values are
    then linked in all that it writes, and nobody can undo it or link it with what another session writes."""
    key = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str | None = None, column: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every value in ``column`` replaced by its pseudonym; ``count`` names a column for their number. The key is
    that of the session unless one is given."""
    if count in docs.columns:
        raise ValueError(f"{count} is a column already")
    key = key or session_key(docs.sparkSession)
    text = F.col(f"`{column}`")
    rules = {"secret": _secret, "email": _email, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}

    def replaced(m: Column) -> Column:
        kind = None
        for name, rule in rules.items():
            test = m.rlike(f"^(?:{KINDS[name]})$")
            kind = F.when(test, rule(m, key)) if kind is None else kind.when(test, rule(m, key))
        return kind

    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    values, out = "_pii_values", "_pii_new"
    while {values, out} & set(docs.columns):
        values, out = f"_{values}", f"_{out}"
    # an array is built once and stays one expression: generators keep the optimizer from copying it into each use
    staged = docs.select("*", F.explode(F.array(F.struct(found.alias("v")))).alias(values))
    staged = staged.withColumn(out, F.explode(F.array(F.struct(F.when(F.size(f"{values}.v") > 0, F.transform(F.col(f"{values}.v"), replaced)).alias("v")))))
    pieces = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.transform(pieces, lambda p, i: F.array(p, F.coalesce(F.get(F.col(f"{out}.v"), i), F.get(F.col(f"{values}.v"), i), F.lit(""))))), "")
    text_out = F.when(F.size(f"{values}.v") > 0, joined).otherwise(text)
    n = F.coalesce(F.size(F.filter(F.col(f"{out}.v"), lambda x: x.isNotNull())), F.lit(0))
    n = F.when(F.col(f"{out}.v").isNull(), 0).otherwise(n).cast("long")
    return staged.select(*(text_out.alias(c) if c == column else F.col(f"`{c}`") for c in docs.columns), *([n.alias(count)] if count else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(columns(table(spark, sf_dir, "documents"), "doc_id", "text"), count="n_values")
