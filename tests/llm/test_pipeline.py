"""The five stages over the small tables and over awkward rows."""

import re

import corpus_pipeline
from complaintflow.llm import decontamination, simhash

SMALL = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, before = docs.columns, docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mixture":
            assert docs.columns == names
        assert docs.count() == len(kept[name]) <= before
        before = docs.count()
    good = [i for i in labels if labels[i]]
    assert sum(i in kept["quality"] for i in good) >= 0.98 * len(good)
    assert sum(i in kept["quality"] for i in labels if not labels[i]) <= 0.1 * (len(labels) - len(good))
    # one of each group, and only clean ones
    fps = [simhash.fingerprint((r["text"] or "").encode()) for r in kept["near_duplicates"].values()]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(fps) for b in fps[:k])
    items = [" ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    plain = {i: " ".join(re.findall(r"[^\W_]+", r["text"].lower())) for i, r in kept["near_duplicates"].items()}
    dirty = {i for i, t in plain.items() if any(x in t for x in items)}
    assert dirty and set(kept["near_duplicates"]) - set(kept["decontaminate"]) == dirty
    changed = {i for i, r in kept["pseudonyms"].items() if r["text"] != kept["decontaminate"][i]["text"]}
    assert changed and set(kept["pseudonyms"]) == set(kept["decontaminate"])
    assert not {i for i in kept["pseudonyms"] if i not in changed and "@mail" in kept["pseudonyms"][i]["text"]}
    assert all(r["taken"] > 0 for r in kept["mixture"].values())


def test_awkward_rows_pass_through(spark):
    rows = [(1, None, None, None, None, 0), (2, "", "en", "s", 0, 0), (3, "the same text here", "en", "s", 18, 0), (3, "the same text here", "en", "s", 18, 0),
            (None, "no id at all", "en", "s", 12, 0), (4, "x " * 60_000, "en", "s", 120_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, SMALL)
        assert name == "mixture" or out.columns == docs.columns
        ids = sorted(r["doc_id"] or 0 for r in out.collect())
        if name == "near_duplicates":  # null and empty texts are one group; the repeated row stays once
            assert ids == [0, 1, 3, 4]
    assert corpus_pipeline.STAGES[0][1](spark, docs, SMALL).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_words_are_told_apart():
    assert len(decontamination.words("One, two; ONE!")) == 3 and decontamination.words("One")[0] == decontamination.words("oNE")[0]
