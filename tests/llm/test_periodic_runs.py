"""Periodic runs against every period tried at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from complaintflow.llm import periodic_runs as op

SMALL = "/root/testdata/sf0.001"


def brute(words, least=24, periods=3):
    n, found = len(words), {}
    for p in range(1, n):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(least, periods * p):
                found.setdefault((start, i + p - start), p)
            i += 1
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, kinds, longest=250):
    words = []
    while len(words) < rng.randint(0, longest):
        if rng.random() < 0.5:
            words += [rng.randrange(kinds) for _ in range(rng.randint(1, 10))]
        else:
            unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 40))]
            words += (unit * 10)[:rng.randint(1, 6 * len(unit))]
    return np.array(words, np.int64)


@pytest.mark.parametrize("least, periods", [(24, 3), (2, 2), (10, 4), (40, 2)])
def test_all_runs_are_caught_whatever_is_appended_at_a_time(least, periods):
    rng = random.Random(least)
    seen = 0
    for trial in range(150):
        words = repetitive(rng, rng.choice([1, 2, 3, 5]))
        wanted = brute(words.tolist(), least, periods)
        seen += len(wanted)
        assert op.find_runs(words, least, periods) == wanted
        step = rng.choice([1, 7, 50]) if trial % 10 == 0 else rng.choice([13, 64])
        catcher = op.SquareCatcher(least, periods)
        for at in range(0, len(words), step):
            catcher.append(words[at:at + step])
            if at // step % 5 == 0:  # what is reported halfway is right, too
                assert catcher.runs() == brute(words[:at + step].tolist(), least, periods)
        assert len(words) == 0 or catcher.runs() == wanted
    assert seen > 100


def test_a_word_that_ends_a_stretch_closes_it():
    catcher = op.SquareCatcher()
    for k in range(40):
        catcher.append(np.array([k % 4]))
    assert catcher.runs() == [(0, 40, 4)] and catcher.open
    catcher.append(np.array([9]))
    assert catcher.runs() == [(0, 40, 4)] and not catcher.open


def test_hash_collisions_are_found_out(monkeypatch):
    words = np.array([*range(100), *([1, 2, 3] * 10), *range(200, 260)])
    grow = op.SquareCatcher._grow

    def poor(self, numbers):
        grow(self, numbers)
        if self.seed == 0:  # every window of eight looks alike
            self.levels[3][:] = 0

    monkeypatch.setattr(op.SquareCatcher, "_grow", poor)
    assert op.find_runs(words) == brute(words.tolist()) == [(100, 30, 3)]


def test_long_texts_in_proportion():
    for words in (np.zeros(300_000, np.int64), np.arange(300_000) % 1000, np.arange(300_000)):
        assert len(op.find_runs(words)) == (len(set(words[:2000].tolist())) < 2000)


def digests(runs, words):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def contract(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return digests(brute(words), words)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"])
                   for r in df.collect()), key=str)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{x}" for x in repetitive(rng, rng.choice([2, 3, 400])))) for i in range(150)]
    rows += [(None, None), (None, "a b " * 30), (7, ""), (7, " \t\n\x0b\x0c\r "), (8, "é é " * 30), (9, "x " * 3000), (9, "x " * 3000), (-4, "a b c " * 50)]
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t in rows], "doc_id long, text string, runs string, h int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(op.query(spark, str(tmp_path))) == sorted(((i, *contract(i, t)) for i, t in rows), key=str)
    assert op.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        op.periodic_runs(docs, ("doc_id", "runs"))


def test_query_over_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    short = [r for r in docs if len(r["text"] or "") < 2500]
    got = {r[0]: r for r in rows_of(op.query(spark, SMALL))}
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[r["doc_id"]] == (r["doc_id"], *contract(r["doc_id"], r["text"])) for r in short)
    assert sum(r[1] > 0 for r in got.values()) > 5
