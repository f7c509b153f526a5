"""DuckDB SQL for the same views and steps, written on its own from the rules.

The texts are whole; nothing is cut or sampled to keep a query cheap.
"""

from __future__ import annotations

from complaintflow.checks.views import OPENINGS, RAW_LABELS, TAXONOMY_ROWS
from complaintflow.functions import lexicon as lx

W = r"\p{L}\p{N}_"
SP = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def tuple_in(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


# --------------------------------------------------------------------------- views
REVIEWS = f"""reviews AS (
  SELECT 'r' || doc_id AS id, source AS username,
    CASE WHEN doc_id % 24 < 20 THEN {arr(OPENINGS)}[doc_id % 24 + 1] || ' ' || text ELSE text END AS review_text,
    CAST(nullif((doc_id // 24) % 6, 0) AS INTEGER) AS rating,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS review_date, lang AS app_version,
    TIMESTAMP '2024-02-01' + to_minutes(doc_id % 500) AS scraped_at
  FROM documents)"""

RAW_FEED = """raw AS (
  SELECT CASE WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 37 = 0 THEN NULL ELSE 'r' || doc_id END AS review_id,
    source AS user_name,
    CASE WHEN doc_id % 13 = 0 THEN source WHEN doc_id % 43 = 0 THEN NULL
      ELSE text || ' ' || copy END AS content,
    CAST(nullif((doc_id // 3) % 6, 0) AS INTEGER) AS score,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours(doc_id % 2000) END AS "at",
    nullif(lang, 'de') AS app_version, (doc_id * 7) % 101 AS relevance, doc_id * 2 + copy AS arrival
  FROM (SELECT *, unnest(CASE WHEN doc_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM documents))"""

RESULTS = """results AS (
  SELECT 'a' || event_id AS result_id, 'r' || (event_id // 9 * 2) AS review_id, props AS normalized_text,
    CASE WHEN event_type IN ('error', 'view') THEN 'Negatif' ELSE 'Positif' END AS sentiment,
    'fallback' AS sentiment_source,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 97) / 100.0::DOUBLE END AS sentiment_confidence,
    event_type IN ('error', 'view') AND event_id % 10 <> 0 AS is_complaint,
    CASE event_id % 4 WHEN 2 THEN '' WHEN 1 THEN 'LAYANAN' ELSE 'APLIKASI' END AS category,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'Sub' || (event_id % 3) END AS subcategory,
    (event_id % 50) / 50.0::DOUBLE AS classification_confidence, (event_id % 25) / 25.0::DOUBLE AS confidence,
    event_type AS reason, event_id % 6 = 0 AS escalated,
    CASE event_id % 4 WHEN 2 THEN '' WHEN 1 THEN 'LAYANAN' ELSE 'APLIKASI' END AS layer1,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'KETENAGALISTRIKAN' END AS layer2,
    CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'L' || (event_id % 5) END AS layer3,
    'M' || (event_id % 8) AS layer4, 'N' || (event_id % 9) AS layer5, 'q' || (event_id % 2) AS quality_param,
    date_trunc('second', ts) AS analyzed_at
  FROM events)"""

FLAG_EVENTS = """flag_events AS (
  SELECT 'a' || (event_id // 2 * 3) AS result_id, event_type = 'click' AS flagged,
    CASE WHEN event_id % 3 = 0 THEN '  ' ELSE ' note ' || event_id || ' ' END AS note, ts AS flagged_at
  FROM events WHERE event_type IN ('click', 'signup'))"""

FLAGS = FLAG_EVENTS + """, flags AS (
  SELECT result_id, flagged, nullif(trim(note), '') AS flag_note,
    CASE WHEN flagged THEN flagged_at END AS flagged_at
  FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY flagged_at DESC, flagged DESC, note DESC) AS rn
        FROM flag_events) WHERE rn = 1)"""

FEED_COLUMNS = """result_id, review_id, username, review_text, rating, review_date, normalized_text, sentiment,
  sentiment_confidence, is_complaint, category, subcategory, classification_confidence, reason, escalated,
  layer1, layer2, layer3, layer4, layer5, quality_param, analyzed_at, flagged, flag_note, flagged_at"""

FEED = f"""{REVIEWS}, {RESULTS}, {FLAGS}, feed AS (
  SELECT x.*, r.username, r.review_text, r.rating, r.review_date, coalesce(f.flagged, false) AS flagged,
    f.flag_note, f.flagged_at
  FROM results x JOIN reviews r ON r.id = x.review_id LEFT JOIN flags f USING (result_id))"""

TAXONOMY = "taxonomy(ord, l1, l2, l3, l4, l5, param) AS (VALUES " + ", ".join(
    f"({r[0]}, " + ", ".join(q(x) for x in r[1:]) + ")" for r in TAXONOMY_ROWS) + ")"

PART_TAXONOMY = """taxonomy AS (
  SELECT p_partkey AS ord, p_type AS l1, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_brand END AS l2,
    split_part(p_name, ' ', 1) AS l3, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS l4,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'size ' || (p_size % 5) END AS l5,
    CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'q' || (p_partkey % 4) END AS param
  FROM part)"""

ORDER_PATHS = """paths AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_orderkey, l_linenumber, p_type AS l1,
    'Brand#' || (1 + l_suppkey % 25) AS l2, split_part(p_name, ' ', 1) AS l3, split_part(p_name, ' ', 2) AS l4,
    'size ' || (l_suppkey % 6) AS l5
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

# option tables; a level counts only when it and all its parents are filled
OPTIONS = """
  p3 AS (SELECT DISTINCT l1, l2, l3 FROM taxonomy WHERE l1 <> '' AND l2 <> '' AND l3 <> ''),
  p4 AS (SELECT DISTINCT l1, l2, l3, l4 FROM taxonomy WHERE l1 <> '' AND l2 <> '' AND l3 <> '' AND l4 <> ''),
  p5 AS (SELECT DISTINCT l1, l2, l3, l4, l5 FROM taxonomy
         WHERE l1 <> '' AND l2 <> '' AND l3 <> '' AND l4 <> '' AND l5 <> ''),
  o3 AS (SELECT l1, l2, list(l3 ORDER BY l3) AS options FROM p3 GROUP BY ALL),
  o4 AS (SELECT l1, l2, l3, list(l4 ORDER BY l4) AS options FROM p4 GROUP BY ALL),
  o5 AS (SELECT l1, l2, l3, l4, list(l5 ORDER BY l5) AS options FROM p5 GROUP BY ALL),
  f4 AS (SELECT l3, list(DISTINCT l4 ORDER BY l4) AS options FROM p4 GROUP BY ALL),
  f5 AS (SELECT l4, list(DISTINCT l5 ORDER BY l5) AS options FROM p5 GROUP BY ALL),
  a3 AS (SELECT l3 AS label, count(*) AS n_paths FROM p3 GROUP BY ALL HAVING count(*) > 1),
  a4 AS (SELECT l4 AS label, count(*) AS n_paths FROM p4 GROUP BY ALL HAVING count(*) > 1),
  q5 AS (SELECT l1, l2, l3, l4, l5, arg_max(param, ord) AS param FROM taxonomy
         WHERE l1 <> '' AND l2 <> '' AND l3 <> '' AND l4 <> '' AND l5 <> '' AND param <> '' GROUP BY ALL),
  qf AS (SELECT l5, arg_max(param, ord) AS param FROM taxonomy
         WHERE l1 <> '' AND l2 <> '' AND l3 <> '' AND l4 <> '' AND l5 <> '' AND param <> '' GROUP BY ALL)"""

MODEL_SCORES = """scores AS (
  SELECT 'r' || doc_id AS review_id, 'sentiment' AS target, o AS ord, 'LABEL_' || o AS label,
    (doc_id * [7, 11, 13][o + 1]) % 100 / 100.0::DOUBLE AS score
  FROM documents, (VALUES (0), (1), (2)) t(o) WHERE lang <> 'de'
  UNION ALL
  SELECT 'r' || doc_id, t, 0, CASE WHEN t = 'layer1' THEN CASE WHEN doc_id % 2 = 1 THEN 'LAYANAN' ELSE 'APLIKASI' END
      ELSE CASE WHEN doc_id % 3 = 1 THEN 'Pengaduan' WHEN doc_id % 7 = 5 THEN '' ELSE 'Token & Pembayaran' END END,
    (doc_id * 3) % 100 / 100.0::DOUBLE
  FROM documents, (VALUES ('layer1'), ('layer3')) t(t) WHERE lang IN ('en', 'es')
  UNION ALL
  SELECT 'r' || doc_id, CASE WHEN o < 4 THEN 'layer4' ELSE 'layer5' END, o,
    ['Gagal Bayar', 'Token Tidak Masuk', 'Padam', 'Respon Petugas', 'Padam Meluas', 'Padam Rumah', 'Saldo Terpotong',
     'Metode Ditolak', 'not in the taxonomy'][o + 1], (doc_id * (o + 2)) % 100 / 100.0::DOUBLE
  FROM documents, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) t(o) WHERE lang <> 'fr')"""

_raw_label = "[" + ", ".join(arr(r) for r in RAW_LABELS) + "]"
LABELLED = f"""labelled AS (
  SELECT doc_id AS row, CASE WHEN doc_id % 41 = 0 THEN NULL ELSE text END AS text,
    {", ".join(f'{_raw_label}[doc_id % 11 + 1][{i}] AS raw{i}' for i in range(1, 6))}
  FROM documents)"""

TRAINING = """training AS (
  SELECT doc_id AS row, text, CASE WHEN doc_id % 47 = 0 THEN NULL WHEN lang = 'en' THEN lang
    ELSE lang || '-' || source END AS label FROM documents)"""

PREDICTIONS = """predictions AS (
  SELECT lang AS actual, CASE WHEN doc_id % 7 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'other' ELSE lang END AS predicted
  FROM documents)"""


# --------------------------------------------------------------------------- text steps
def emoji(t: str) -> str:
    for k, v in lx.EMOJI.items():
        t = f"replace({t}, {q(k)}, {q(' ' + v + ' ')})"
    return t


def urls(t: str) -> str:
    return rf"regexp_replace({t}, 'https?://[^{SP}]+|www\.[^{SP}]+', '', 'g')"


def lower_trim(t: str) -> str:
    return f"regexp_replace(lower({t}), '^[{SP}]+|[{SP}]+$', '', 'g')"


def reduplicate(t: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({t}, '[{W}]+|[^{W}]+'), lambda x: "
            f"CASE WHEN x IN ('berkali2', 'brkali2') THEN 'berkali-kali' WHEN regexp_full_match(x, '[{W}]{{3,}}2') "
            "THEN left(x, length(x) - 1) || '-' || left(x, length(x) - 1) ELSE x END), '')")


def digits(t: str) -> str:
    return (rf"regexp_replace(regexp_replace({t}, '(\p{{Nd}})([a-zA-Z])', '\1 \2', 'g'), "
            r"'([a-zA-Z])(\p{Nd})', '\1 \2', 'g')")


def repeats(chars: str) -> str:
    """Over a column that holds the list of characters."""
    return (f"array_to_string(list_filter({chars}, lambda c, i: c = chr(10) OR c IS DISTINCT FROM {chars}[i - 1] "
            f"OR ({chars}[i - 2] IS DISTINCT FROM c AND {chars}[i + 1] IS DISTINCT FROM c)), '')")


def chars(t: str) -> str:
    return f"regexp_extract_all({t}, '(?s).')"


def noise(t: str) -> str:
    return rf"regexp_replace({t}, '[^{W}{SP}.,!?\-/]', ' ', 'g')"


def punctuation(t: str) -> str:
    t = rf"regexp_replace(regexp_replace({t}, '!{{2,}}', '!', 'g'), '\?{{2,}}', '?', 'g')"
    return rf"regexp_replace(regexp_replace({t}, '\.{{2,}}', '...', 'g'), '[{SP}]([.,!?])', '\1', 'g')"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{SP}]+', ' ', 'g'))"


SLANG_MAP = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in lx.SLANG.items()) + "}"
ACR = tuple_in(lx.ACRONYMS)


def cleaned(src: str, text: str, out: str, key: str = "id") -> str:
    """CTEs from ``src`` to ``out(key, t)`` with the text-level steps done."""
    first = digits(reduplicate(lower_trim(urls(emoji(f"coalesce({text}, '')")))))
    return f"""{out}_1 AS (SELECT {key}, {chars(first)} AS cs FROM {src}),
  {out}_2 AS (SELECT {key}, {repeats('cs')} AS t FROM {out}_1),
  {out} AS (SELECT {key}, {squeeze(punctuation(noise('t')))} AS t FROM {out}_2)"""


def slang_steps(src: str, out: str, key: str = "id") -> str:
    """CTEs from single-blank texts ``src(key, t)`` to ``out(key, t)``: pairs, fillers, single words."""
    return f"""{out}_w AS (SELECT {key}, string_split(t, ' ') AS tk,
      string_split(lower(regexp_replace(t, '[^{W} ]', '', 'g')), ' ') AS w FROM {src}),
  {out}_x AS (SELECT *, list_transform(w, lambda x, i: CASE WHEN i < len(w) THEN trim(x || ' ' || w[i + 1]) END) AS pairs
      FROM {out}_w),
  {out}_f AS (SELECT *, string_split(regexp_replace(array_to_string(list_transform(pairs, lambda x:
      CASE WHEN x IS NOT NULL AND x IN {tuple_in(lx.SLANG)} THEN '1' ELSE '0' END), ''), '1.', 'px', 'g'), '') AS g FROM {out}_x),
  {out}_p AS (SELECT {key}, list_transform(w, lambda x, i: CASE WHEN g[i] = 'x' THEN ''
      WHEN g[i] = 'p' THEN {SLANG_MAP}[pairs[i]] WHEN x IN {tuple_in(lx.FILLERS)} THEN ''
      WHEN x IN {tuple_in(lx.SLANG)} THEN {SLANG_MAP}[x] ELSE tk[i] END) AS parts FROM {out}_f),
  {out} AS (SELECT {key}, trim(regexp_replace(array_to_string(parts, ' '), ' +', ' ', 'g')) AS t FROM {out}_p)"""


def acronym_steps(src: str, out: str, key: str = "id") -> str:
    return f"""{out}_w AS (SELECT {key}, string_split(t, ' ') AS tk,
      string_split(lower(regexp_replace(t, '[^{W} ]', '', 'g')), ' ') AS w FROM {src}),
  {out} AS (SELECT {key}, array_to_string(list_transform(w, lambda x, i:
      CASE WHEN x IN {ACR} THEN upper(x) ELSE tk[i] END), ' ') AS t FROM {out}_w)"""


def normalized(src: str, text: str, out: str, key: str = "id") -> str:
    """CTEs from ``src`` to ``out(key, t)`` with the whole normaliser."""
    return f"""{cleaned(src, text, out + '_c', key)},
  {slang_steps(out + '_c', out + '_s', key)},
  {acronym_steps(out + '_s', out + '_a', key)},
  {out} AS (SELECT {key}, upper(left(t, 1)) || substring(t, 2) AS t FROM {out}_a)"""


# --------------------------------------------------------------------------- sentiment
def phrase_test(low: str, phrases) -> str:
    body = "|".join(phrases)
    return f"regexp_matches({low}, '(^|[^{W}])({body})([^{W}]|$)')"


def weight_case(x: str) -> str:
    neg = [(p, w) for p, w in lx.NEGATIVE.items() if " " not in p]
    pos = [(p, w) for p, w in lx.POSITIVE.items() if " " not in p]
    parts = [f"WHEN {x} IN {tuple_in(p for p, v in neg if v == n)} THEN -{n}.0" for n in (3, 2, 1)]
    parts += [f"WHEN {x} IN {tuple_in(p for p, v in pos if v == n)} THEN {n}.0" for n in (3, 2, 1)]
    return "CASE " + " ".join(parts) + " ELSE 0.0 END"


def phrase_sum(low: str, lexicon) -> str:
    return " + ".join(f"CASE WHEN contains({low}, {q(p)}) THEN {w}.0::DOUBLE ELSE 0.0::DOUBLE END"
                      for p, w in lexicon.items() if " " in p)


def token_scores(src: str, out: str, key: str = "id") -> str:
    """CTEs to ``out(key, neg, pos)`` from the lower-case texts ``src(key, low)``: one row per token."""
    return f"""{out}_t AS (SELECT {key}, unnest(w) AS x, generate_subscripts(w, 1) AS i
      FROM (SELECT {key}, string_split({squeeze('low')}, ' ') AS w FROM {src})),
  {out}_n AS (SELECT {key}, CAST({weight_case('x')} AS DOUBLE) AS v, coalesce(bool_or(x IN {tuple_in(lx.NEGATORS)})
      OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), false) AS negated FROM {out}_t),
  {out}_v AS (SELECT {key}, CASE WHEN negated THEN -0.5 * v ELSE v END AS v FROM {out}_n),
  {out} AS (SELECT {key}, sum(greatest(-v, 0.0)) AS neg, sum(greatest(v, 0.0)) AS pos FROM {out}_v GROUP BY ALL)"""


def lexicon_label(neg: str, pos: str) -> str:
    return f"CASE WHEN {pos} > {neg} THEN 'Positif' ELSE 'Negatif' END"


def lexicon_confidence(neg: str, pos: str) -> str:
    return (f"CASE WHEN {neg} + {pos} = 0 THEN 0.60 WHEN {neg} = {pos} THEN 0.62 ELSE least(round(0.55::DOUBLE + "
            f"greatest({neg}, {pos}) / ({neg} + {pos}) * 0.38::DOUBLE, 3), 0.92::DOUBLE) END::DOUBLE")


def lexicon_steps(src: str, out: str, key: str = "id") -> str:
    """CTEs from ``src(key, low)`` to ``out(key, neg, pos, strong, explicit)``."""
    neg, pos = phrase_sum("low", lx.NEGATIVE), phrase_sum("low", lx.POSITIVE)
    return f"""{token_scores(src, out + '_k', key)},
  {out} AS (SELECT {key}, low, neg + {neg} AS neg, pos + {pos} AS pos, {phrase_test('low', lx.STRONG_POSITIVE)} AS strong,
      {phrase_test('low', lx.EXPLICIT_NEGATIVE)} AS explicit FROM {src} JOIN {out}_k USING ({key}))"""


# --------------------------------------------------------------------------- classification
def hit_sum(low: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({low}, {q(w)}) AS INTEGER)" for w in words) + ")"


def layer_steps(src: str, out: str, key: str = "id") -> str:
    """CTEs from ``src(key, low)`` to ``out(key, layer1, layer2, layer3, hits, conf)``."""
    l3 = list(lx.L3_KEYWORDS.items())
    sums = ", ".join(f"{hit_sum('low', w)} AS h{i}" for i, (_, w) in enumerate(l3))
    best = "greatest(" + ", ".join(f"h{i}" for i in range(len(l3))) + ")"
    pick = " ".join(f"WHEN h{i} = {best} THEN {q(label)}" for i, (label, _) in enumerate(l3))
    a, b = lx.L1_KEYWORDS.values()
    return f"""{out}_h AS (SELECT {key}, {sums}, {hit_sum('low', a)} AS a, {hit_sum('low', b)} AS b FROM {src}),
  {out} AS (SELECT {key}, CASE WHEN b > a THEN 'LAYANAN' ELSE 'APLIKASI' END AS layer1, 'KETENAGALISTRIKAN' AS layer2,
      CASE WHEN {best} = 0 THEN 'Pengaduan' {pick} END AS layer3, {best} AS hits,
      CASE WHEN {best} = 0 THEN 0.50 ELSE least(0.55::DOUBLE + {best} * 0.1::DOUBLE, 0.85::DOUBLE) END::DOUBLE AS conf
    FROM {out}_h)"""


# --------------------------------------------------------------------------- whole analysis
def analysis(with_scores: bool) -> str:
    """CTEs up to ``record`` with the 17 record fields and the review columns."""
    scored = with_scores
    model = f""", {MODEL_SCORES},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY review_id, target ORDER BY score DESC, ord) AS rn FROM scores),
  top AS (SELECT review_id AS id, max(CASE WHEN target = 'sentiment' THEN label END) AS s_label,
      max(CASE WHEN target = 'sentiment' THEN score END) AS s_score,
      max(CASE WHEN target = 'layer1' THEN label END) AS l1_label, max(CASE WHEN target = 'layer3' THEN label END) AS l3_label,
      max(CASE WHEN target = 'layer3' THEN score END) AS l3_score FROM ranked WHERE rn = 1 GROUP BY ALL)""" if scored else ""
    s_label = ("CASE s_label WHEN 'LABEL_0' THEN 'Positif' WHEN 'LABEL_1' THEN 'Netral' WHEN 'LABEL_2' THEN 'Negatif' ELSE "
               + lexicon_label("neg", "pos") + " END") if scored else lexicon_label("neg", "pos")
    s_conf = f"CASE WHEN s_label IS NOT NULL THEN round(s_score, 4) ELSE {lexicon_confidence('neg', 'pos')} END" if scored \
        else lexicon_confidence("neg", "pos")
    s_source = "CASE WHEN s_label IS NOT NULL THEN 'IndoBERT-local' ELSE 'fallback' END" if scored else "'fallback'"
    l1 = "CASE WHEN l1_label <> '' THEN l1_label ELSE k.layer1 END" if scored else "k.layer1"
    l3 = "CASE WHEN l3_label <> '' THEN l3_label ELSE k.layer3 END" if scored else "k.layer3"
    cc = "CASE WHEN l3_label <> '' THEN l3_score ELSE k.conf END" if scored else "k.conf"
    join = "LEFT JOIN top USING (id)" if scored else ""
    score4 = "(SELECT review_id AS id, label AS l4, max(score) AS sc FROM scores WHERE target = 'layer4' GROUP BY ALL)" if scored \
        else "(SELECT NULL::VARCHAR AS id, NULL::VARCHAR AS l4, NULL::DOUBLE AS sc)"
    score5 = score4.replace("layer4", "layer5").replace("l4", "l5")
    return f"""{REVIEWS}, {TAXONOMY}, {OPTIONS}{model},
  {normalized('reviews', 'review_text', 'norm')},
  low AS (SELECT id, t AS normalized, lower(t) AS low FROM norm),
  {lexicon_steps('low', 'lex')}, {layer_steps('low', 'k')},
  s0 AS (SELECT r.*, l.normalized, x.strong, x.explicit, x.neg, x.pos, {l1} AS k1, k.layer2 AS k2, {l3} AS k3, {cc} AS cconf,
      {s_label} AS label0, {s_conf} AS sconf, {s_source} AS source0
    FROM reviews r JOIN low l USING (id) JOIN lex x USING (id) JOIN k USING (id) {join}),
  s1 AS (SELECT *, CASE WHEN label0 = 'Netral' THEN 'Negatif' WHEN label0 = 'Negatif' AND strong AND NOT explicit
      THEN 'Positif' ELSE label0 END AS label1 FROM s0),
  s2 AS (SELECT *, label1 = 'Negatif' AND coalesce(rating, 0) >= 4 AND NOT explicit AS rescue FROM s1),
  s3 AS (SELECT *, label1 = 'Negatif' AND NOT rescue AS complaint FROM s2),
  s4 AS (SELECT *, complaint AND coalesce(rating, 9) <= 2 AND strong AND NOT explicit AS misread FROM s3),
  s5 AS (SELECT *, complaint AND NOT misread AND k1 <> '' AND NOT contains(upper(k1), 'UMUM')
      AND len(list_filter(string_split(normalized, ' '), lambda x: x <> '')) >= 3 AS esc FROM s4),
  e4 AS (SELECT s.id, s.k1, s.k2, s.k3, unnest(coalesce(o4.options, f4.options)) AS l4 FROM s5 s
      LEFT JOIN o4 ON o4.l1 = k1 AND o4.l2 = k2 AND o4.l3 = k3 LEFT JOIN f4 ON f4.l3 = k3 WHERE esc),
  c4 AS (SELECT * FROM (SELECT e4.*, row_number() OVER (PARTITION BY e4.id ORDER BY coalesce(sc, -1) DESC, e4.l4) AS rn
      FROM e4 LEFT JOIN {score4} z ON z.id = e4.id AND z.l4 = e4.l4) WHERE rn = 1),
  e5 AS (SELECT c.*, unnest(coalesce(o5.options, f5.options)) AS l5 FROM c4 c
      LEFT JOIN o5 ON o5.l1 = k1 AND o5.l2 = k2 AND o5.l3 = k3 AND o5.l4 = c.l4 LEFT JOIN f5 ON f5.l4 = c.l4),
  c5 AS (SELECT * FROM (SELECT e5.* EXCLUDE (rn), row_number() OVER (PARTITION BY e5.id ORDER BY coalesce(sc, -1) DESC, e5.l5) AS rn
      FROM e5 LEFT JOIN {score5} z ON z.id = e5.id AND z.l5 = e5.l5) WHERE rn = 1),
  lower_levels AS (SELECT c4.id, c4.l4, coalesce(c5.l5, '') AS l5, coalesce(q5.param, qf.param, '') AS param
    FROM c4 LEFT JOIN c5 USING (id) LEFT JOIN q5 ON q5.l1 = c4.k1 AND q5.l2 = c4.k2 AND q5.l3 = c4.k3 AND q5.l4 = c4.l4
      AND q5.l5 = c5.l5 LEFT JOIN qf ON qf.l5 = c5.l5),
  record AS (SELECT id, username, review_text, rating, review_date, app_version, scraped_at, normalized,
      CASE WHEN rescue THEN 'Positif' ELSE label1 END AS sentiment, round(sconf, 3) AS sentiment_confidence,
      CASE WHEN rescue THEN source0 || '+rating_rescue' ELSE source0 END AS sentiment_source,
      CASE WHEN misread THEN 'UMUM' WHEN complaint THEN k1 ELSE '' END AS category,
      CASE WHEN misread THEN 'Salah Mengartikan Bintang 1' WHEN complaint THEN k3 ELSE '' END AS subcategory,
      CASE WHEN misread THEN 0.85 WHEN complaint THEN round(cconf, 3) ELSE 0.0 END::DOUBLE AS classification_confidence,
      CASE WHEN misread THEN 'UMUM' WHEN complaint THEN k1 ELSE '' END AS layer1,
      CASE WHEN misread THEN 'UMUM' WHEN complaint THEN k2 ELSE '' END AS layer2,
      CASE WHEN misread THEN 'Salah Mengartikan Bintang 1' WHEN complaint THEN k3 ELSE '' END AS layer3,
      coalesce(l4, '') AS layer4, coalesce(l5, '') AS layer5, coalesce(param, '') AS quality_param,
      esc AS escalated, complaint AS is_complaint,
      CASE WHEN misread THEN round(least(sconf, 0.85::DOUBLE), 3) WHEN complaint THEN round(least(sconf, cconf), 3)
        ELSE round(sconf, 3) END AS confidence,
      CASE WHEN rescue THEN 'Rating ' || rating || '★ tanpa keluhan eksplisit — model sentimen awal salah baca istilah domain PLN, dikoreksi jadi Positif.'
        WHEN NOT complaint THEN label1 || ' review — not classified as a complaint.'
        WHEN misread THEN 'Rating ' || rating || '★ dengan teks positif — terdeteksi sebagai ''Salah Mengartikan Bintang 1'' (inkonsistensi rating vs konten).'
        ELSE 'Negative complaint: ' || k1 || ' > ' || k3 || CASE WHEN coalesce(l4, '') <> '' THEN ' > ' || l4 ELSE '' END END AS reason
    FROM s5 LEFT JOIN lower_levels USING (id))"""


RECORD = ("id, normalized, sentiment, sentiment_confidence, sentiment_source, category, subcategory, classification_confidence, "
          "layer1, layer2, layer3, layer4, layer5, quality_param, escalated, is_complaint, confidence, reason")
