"""Rows without doc_id and doc_ids with several texts: no text and no link is lost."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from complaintflow.llm import decontamination, sentence_dedup, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(4)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def test_links_through_rows_without_id(spark, monkeypatch):
    texts = {"none": 0, "three": 7, "six": 63, "far": 255 << 40, "near far": 255 << 40 | 1}
    monkeypatch.setattr(simhash, "fingerprint", lambda t, shingle=3: texts[t.decode()])
    rows = [(1, "none"), (None, "three"), (2, "six"), (None, "far"), (None, "near far"), (None, "three")]
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(1, 0): 1, (None, 7): 1, (2, 63): 1, (None, 255 << 40): None, (None, 255 << 40 | 1): None}
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    assert len(kept) == 2 and (1, "none") in [(r["doc_id"], r["text"]) for r in kept]


def test_near_duplicates_stage_against_brute_force(spark):
    rng = random.Random(15)
    rows = []
    for i in range(60):
        base = prose(rng, rng.randint(60, 400)).split()
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((10 * i + k if rng.random() < 0.7 else None, " ".join(copy)))
    rows += [(5, prose(rng, 50)), (5, prose(rng, 50)), (None, prose(rng, 50)), (None, prose(rng, 50)), (None, ""), (3, None), (7, "x " * 100_000)]
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[a] == group[b] for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3):
            break
    wanted = {}
    for g, (i, t) in zip(group, rows):
        wanted.setdefault(g, []).append((i is None, i or 0))
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(min(x) for x in wanted.values())
    assert 60 < len(kept) < len(rows) and {(r["doc_id"], r["text"]) for r in kept} <= set(rows)


def test_each_row_is_judged_by_its_own_text(spark):
    rng = random.Random(16)
    clean, item = prose(rng, 80), prose(rng, 40)
    rows = [(7, f"{clean} {item}"), (7, clean), (None, f"{item} {clean}"), (None, clean), (8, clean), (8, clean), (9, None)]
    for n in (40, 600):
        items = [(0, item)] + [(i, prose(random.Random(1000 + i), 20)) for i in range(1, n)]
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = sorted((r["doc_id"] or -1, r["contaminated"]) for r in decontamination.contamination(frame(spark, rows), bench).collect())
        assert got == [(-1, False), (-1, True), (7, False), (7, True), (8, False), (8, False), (9, False)]
        assert len(list(decontamination._blocks(bench, list(range(n))))) == (1 if n == 40 else 2)


def test_decontaminate_keeps_clean_rows(spark, tmp_path):
    rng = random.Random(17)
    clean, item = prose(rng, 80), prose(rng, 40)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(7, f"{clean} {item}"), (7, clean), (None, f"{item} {clean}"), (None, clean), (9, clean)]
    docs = frame(spark, rows).selectExpr("*", "'mine' AS contaminated", "1 AS shares")
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] == clean, r["contaminated"]) for r in kept.collect()) == [(-1, True, "mine"), (7, True, "mine"), (9, True, "mine")]


# --------------------------------------------------------------------------- removal of repeats
def in_order(rows):
    """The distinct documents, smaller first: null, then by doc_id, then by the digest of the text."""
    return sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))


def without_repeats(rows, match=100):
    """Every byte under a ``match``-byte string that starts earlier is removed."""
    seen, kept = set(), {}
    for i, t in in_order(rows):
        text = (t or "").encode()
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - match + 1):
            window = text[at:at + match]
            if window in seen:
                gone[at:at + match] = True
            seen.add(window)
        kept[i, t] = bytes(b for b, g in zip(text, gone) if not g)
    return kept


def clashing(rng):
    x, a, b = prose(rng, 60), prose(rng, 50), prose(rng, 50)
    rows = [(None, f"{a} {x}"), (None, f"{x} {b}"), (5, f"{a} {x}"), (5, f"{x} {prose(rng, 40)}"), (4, f"{prose(rng, 30)} {b}"), (6, f"{b} {a}"),
            (6, f"{b} {a}"), (None, None), (7, None), (7, ""), (7, "short"), (8, f"{a} {a}"), (None, f"{x} {b}")]
    return rows + [(rng.choice([None, 1, 2, 3, 4, 5]), " ".join(rng.choice([a, b, x, prose(rng, 20)]) for _ in range(3))) for _ in range(30)]


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_repeated_bytes_with_null_and_repeated_ids(spark, batches):
    rows = clashing(random.Random(18))
    want = without_repeats(rows)
    got = suffix_dedup.remove(frame(spark, rows), batches).collect()
    assert sorted(((r["doc_id"], bytes(r["kept"])) for r in got), key=str) == sorted(((i, want[i, t]) for i, t in rows), key=str)


def test_a_text_that_stands_nowhere_else_stays(spark):
    rng = random.Random(19)
    x, a, b = prose(rng, 60), prose(rng, 50), prose(rng, 50)
    for ids in ((None, None), (5, 5), (5, 6), (None, 1)):
        rows = list(zip(ids, (f"{a} {x}", f"{x} {b}")))
        kept = b"".join(bytes(r["kept"]) for r in suffix_dedup.remove(frame(spark, rows)).collect()).decode()
        assert a in kept and b in kept and kept.count(x) == 1


def sentences_without_repeats(rows):
    """Sentences under a run that an earlier document, or an earlier place, has as well."""
    seen, out = {}, {}
    docs = in_order(rows)
    for i, t in docs:
        found, _, halves = sentence_dedup.runs((t or "").encode())
        for (first, _), h in zip(found, halves):
            seen.setdefault(h, (i, t, first))
    for i, t in docs:
        text = (t or "").encode()
        found, _, halves = sentence_dedup.runs(text)
        gone = {k for (first, n), h in zip(found, halves) if seen[h] != (i, t, first) for k in range(first, first + n)}
        out[i, t] = None if t is None else b"".join(text[a:b] for k, (a, b) in enumerate(sentence_dedup.sentences(text)) if k not in gone).decode()
    return out


def test_repeated_sentences_with_null_and_repeated_ids(spark):
    rng = random.Random(20)
    lines = [". ".join(prose(rng, 9) for _ in range(4)) + ".\n" for _ in range(6)]
    rows = [(rng.choice([None, 1, 2, 3]), "".join(rng.choices(lines, k=3)) + prose(rng, 5)) for _ in range(40)] + [(None, None), (1, None), (2, "")]
    rows += rows[:3]
    want = sentences_without_repeats(rows)
    got = sentence_dedup.remove(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((i, want[i, t]) for i, t in rows), key=str)
    assert sum(r["n_removed"] for r in got) > 100
