"""The pipeline's stages, each against its operator's brute force on its own input."""

import re

import pytest

from chronoframe.llm import toxicity as T
from chronoframe.llm.common import table

pipeline = pytest.importorskip("corpus_pipeline")


def has_window(text, items):
    """Whether 13 words of an item stand in the text, one after the other."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    whole = f" {' '.join(words(text))} "
    return any(f" {' '.join(w[j : j + 13])} " in whole for _, t in items for w in [words(t)] for j in range(len(w) - 12))


def test_stages(spark, sf, tmp_path):
    from test_operators import brute_contamination
    from test_similarity import brute_kept

    docs = table(spark, sf, "documents")
    columns = docs.columns
    model = T.fit(docs, table(spark, sf, "labels"))
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "toxicity":
            assert set(after) == {i for i, r in before.items() if model.probability(model.passages(model.token_scores(r.text.encode()))) < 0.3}
        elif name == "near_duplicates":
            assert set(after) == brute_kept([(i, r.text) for i, r in before.items()])
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
            assert set(after) == {i for i, r in before.items() if not has_window(r.text, items) and not brute_contamination(r.text, items)[-1]}
        else:
            assert set(after) == set(before)
    assert all(r.round_trip for r in after.values())
    whole = pipeline.run(spark, sf).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in whole} == {(i, tuple(r.ids)) for i, r in after.items()}


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_odd_rows_pass_all_stages(spark, sf, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, and columns with names that stages use."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, fp long, size int, root long, label string, _text string, _row int"
    rest = (None, None, None, 7, 7, 7, "x", "y", 1)
    unlike = " ".join(f"w{i}" for i in range(20_000))
    data = [(1, None, *rest), (2, "", *rest), (3, "   ", *rest), (None, "no id here", *rest), (None, None, *rest), (4, "same text twice", *rest), (4, "same text twice", *rest), (4, "another text under one id", *rest), (5, unlike, *rest), (6, unlike + " more", *rest), (7, "write to a@b.org", *rest)]
    docs = spark.createDataFrame(data, columns)
    counts = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts[name] = docs.count()
        if name != "sentencepiece":
            assert docs.columns == columns.replace(",", "").split()[::2]
    # texts without a word are one component (1 stays), copies and near copies leave one, a row without an id stays if no copy has one
    assert counts == {"toxicity": 11, "near_duplicates": 6, "decontamination": 6, "pii": 6, "sentencepiece": 6}
    kept = spark.read.parquet(str(tmp_path / "3")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "4", "5", "7", "None"]
    assert {r.text for r in kept if r.doc_id == 7} == {"write to [EMAIL]"} and all(r.fp == 7 and r._text == "y" for r in kept)
