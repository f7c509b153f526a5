"""Cases of the second review: whole results where an operator did less."""

import random
import re

from complaintflow.llm import decontamination, pii, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(4)


# --------------------------------------------------------------------------- 7: decontamination
def test_every_verbatim_copy_of_many_items_is_found(spark):
    rng = random.Random(12)
    common = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: [rng.choice(common[:60] if rng.random() < 0.4 else common) for _ in range(n)]
    items = [prose(rng.randint(15, 59) if i % 2 else rng.randint(100, 200)) for i in range(540)]
    rows = [(i, " ".join(prose(rng.randint(0, 60)) + items[i] + prose(rng.randint(0, 60)))) for i in range(540)]
    rows += [(1000 + i, " ".join(prose(150))) for i in range(60)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.contamination(frame(spark, rows), bench).collect()}
    assert [i for i in range(540) if i not in got[i]] == []
    assert not any(got[1000 + i] for i in range(60)) and len(got) == 600


def test_blocks_hold_all_items_and_few_passages(spark):
    items = [(i, "w " * (30 + i % 300)) for i in range(700)] + [(701, "w " * 30_000), (5, "again"), (None, "no id"), (702, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    ids = [r["item_id"] for r in bench.select("item_id").distinct().orderBy("item_id").collect()]
    blocks = list(decontamination._blocks(bench, ids))
    assert sorted((i or -1, len(h)) for b in blocks for i, h in b) == sorted((i or -1, len(t.split())) for i, t in items if t)
    for b in blocks:
        assert sum(len(decontamination.windows(len(h))) for _, h in b) <= decontamination.PASSAGES or {i for i, _ in b} == {701}


def test_any_place_of_an_item_may_prove_it(spark):
    item = [f"item{i}" for i in range(100)]
    filler = " ".join(f"filler{i}" for i in range(500))
    answered, fuller = " ".join(item[45:]), " ".join(item[:60])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(1, f"{answered} {filler} {fuller}"), (2, f"{fuller} {filler} {answered}"), (3, f"{filler} {fuller}"), (4, answered)]
    got = {r["doc_id"]: r for r in decontamination.contamination(frame(spark, rows), bench).collect()}
    assert {i: r["contaminated"] for i, r in got.items()} == {1: True, 2: True, 3: False, 4: True}
    assert got[1]["best_share"] == got[2]["best_share"] == 0.6


# --------------------------------------------------------------------------- 2: pseudonyms
def test_phone_numbers_of_all_areas_are_permuted(spark):
    rng = random.Random(13)
    numbers = {f"+1 ({a}) 555-{n}" for a, n in (("017", "7713"), ("132", "1352"), ("000", "0000"), ("199", "9999"), ("200", "0000"))}
    numbers |= {f"+1 ({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}" for _ in range(300)}
    numbers |= {f"({a}) 199-{n:04d}" for a in (200, 999) for n in range(20)} | {"017-055-1234", "1 099.555.1234"}
    numbers = sorted(numbers)
    out = pii.pseudonymise(frame(spark, [(i, f"call {n}.") for i, n in enumerate(numbers)]), count="n")
    got = {r["doc_id"]: (r["text"][5:-1], r["n"]) for r in out.collect()}
    assert all(n == 1 for _, n in got.values()) and sum(got[i][0] == x for i, x in enumerate(numbers)) <= 1
    digits = lambda x: re.sub("[0-9]", "0", x[2:] if x.startswith(("+1", "1 ")) else x)
    dialled = lambda x: re.sub("[^0-9]", "", x)[-10:][0] > "1" and re.sub("[^0-9]", "", x)[-7] > "1"
    for i, x in enumerate(numbers):
        assert digits(got[i][0]) == digits(x) and dialled(got[i][0]) == dialled(x)
    values = [re.sub("[^0-9]", "", x)[-10:] for x in numbers]
    assert len({re.sub("[^0-9]", "", y)[-10:] for y, _ in got.values()}) == len(set(values))


# --------------------------------------------------------------------------- 8: quality rules
def test_milder_junk_is_rejected(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 9)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(rng.randint(80, 400))]
        if i % 20 == 0:  # half the words with one symbol
            words = [x + "#" * (rng.random() < 0.5) for x in words]
        if i % 20 == 1:  # a sixth of the words in capitals
            words = [x.upper() if rng.random() < 0.17 else x for x in words]
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.assess(frame(spark, rows)).collect()}
    assert [i for i in range(600) if got[i] == (i % 20 < 2)] == []
