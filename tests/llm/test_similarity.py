"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random
import time
from pathlib import Path

import pytest

from chronoframe.llm import similarity
from chronoframe.llm.common import materialize, scratch, shared_dir, table

pipeline = pytest.importorskip("corpus_pipeline")


def brute_kept(rows):
    """The smallest id of each component of pairs at 0.8 or more."""

    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if 9 * len(s & t) >= 4 * (len(s) + len(t)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if find(i) == i}


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def test_stage_links_all_similar_pairs(spark, sf, monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "a b", "A  b", "a b c"]
    for _ in range(8):  # copies on both sides of the threshold, with a common passage
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))]
        texts += [edited(rng, base, k) for k in range(0, len(base) // 25 + 3) for _ in range(2)]
        texts.append("common passage of many words that all hold here " * 3 + " ".join(base))
    hot = [f"h{i}" for i in range(150)]
    texts += [edited(rng, hot, rng.randrange(3)) for _ in range(40)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_kept(list(enumerate(texts)))
    for rest in (similarity.REST, -1):  # all pairs at once, and by chains first
        monkeypatch.setattr(similarity, "REST", rest)
        assert {r.doc_id for r in pipeline.near_duplicates(spark, made, sf).collect()} == expected
    docs = table(spark, sf, "documents")
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, sf).collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def joined(nodes, pairs):
    """The components of ``nodes`` under ``pairs``, as sets."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    found = {}
    for n in nodes:
        found.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, found.values()))


def test_balls_join_all_near_fingerprints(spark):
    rng = random.Random(3)
    values = []
    for _ in range(10):
        x = rng.getrandbits(64)
        for _ in range(12):
            values += [x] * rng.randrange(1, 4)
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << bit
    nodes = spark.createDataFrame([(i, 50, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "fp long, size int, simhash long")
    pairs = [(r.fp, r._fp) for r in similarity.JaccardLinks()._balls(nodes).collect() if r._fp is not None]
    near = [(i, j) for i, v in enumerate(values) for j in range(i) if (v ^ values[j]).bit_count() <= 2]
    assert joined(range(len(values)), pairs) == joined(range(len(values)), near)


def test_stage_links_by_simhash_what_prefixes_would_miss(spark, sf, monkeypatch):
    """With prefix filtering off the stage still links texts whose SimHash is near, and only similar ones."""
    rng = random.Random(5)
    rule, texts = similarity.JaccardLinks(), []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        texts += [edited(rng, base, 1) for _ in range(5)] + [" ".join(base[:900])]
    marks = [similarity.majority(rule.shingles(t.encode())) for t in texts]
    near = [(i, j) for i, v in enumerate(marks) for j in range(i) if (v ^ marks[j]).bit_count() <= 2]
    expected = {c[0] for c in joined(range(len(texts)), near)}
    assert 12 <= len(expected) < len(texts)
    met = similarity.JaccardLinks._met
    monkeypatch.setattr(similarity.JaccardLinks, "_met", lambda *a: met(*a).limit(0))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_duplicates(spark, made, sf).collect()} == expected


def test_large_groups_of_near_copies_make_few_pairs(spark, sf, monkeypatch):
    """Sets that meet and end in one component are linked along chains, and not compared in all pairs."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [edited(rng, base, 1 + (i % 4 > 0)) for i in range(500)]
    made, rows = [], similarity.JaccardLinks._near
    monkeypatch.setattr(similarity.JaccardLinks, "_near", lambda rule, pairs: (made.append(pairs.where("root <> _root").where(rule._may()).count()), rows(rule, pairs))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, sf).collect()} == brute_kept(list(enumerate(texts)))
    assert made[-1] <= 5_000, made


@pytest.mark.parametrize("few", [similarity.FEW, 0])
def test_components_are_the_same_in_one_task_and_by_rounds(spark, monkeypatch, few):
    rng = random.Random(9)
    monkeypatch.setattr(similarity, "FEW", few)
    path = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)]
    some = [sorted(rng.sample(path[100:], 2)) for _ in range(60)] + [sorted(x) for x in zip(path[:100], path[1:100], strict=False)]
    for pairs in (some, []):
        links = spark.createDataFrame([tuple(x) for x in pairs], "a long, b long")
        got = {r.node: r.root for r in similarity._roots(links).collect()}
        assert got == {n: c[0] for c in joined({x for p in pairs for x in p}, pairs) for n in c[1:]}


def names(folder):
    return {p.name.rpartition("-")[0]: p for p in folder.iterdir()}


def test_stage_leaves_few_tables(spark, sf, monkeypatch):
    """Rounds must not fill the disk: what they write goes when it is read."""
    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    docs = spark.createDataFrame([(i, edited(rng, base, 1 + i % 4)) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(similarity, "REST", -1)
    there = Path(shared_dir(spark).removeprefix("file://"))
    before = set(there.iterdir())
    pipeline.near_duplicates(spark, docs, sf)
    assert {p.name.rpartition("-")[0] for p in set(there.iterdir()) - before} == {"fingerprints", "labels", "ids"}


def test_scratch_deletes_what_is_not_kept(spark):
    there = Path(shared_dir(spark).removeprefix("file://"))
    blocks = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    shuffles = set(blocks.rglob("shuffle_*.data"))
    with scratch(spark):
        with scratch(spark):
            materialize(spark.range(9), "scratch_inner")
            kept = materialize(spark.range(9).repartition(3, "id"), "scratch_kept", keep=True)
        assert "scratch_inner" not in names(there) and kept.count() == 9
        last = materialize(kept.groupBy("id").count(), "scratch_last", keep=True)
    assert "scratch_kept" not in names(there) and last.count() == 9
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    ours, deadline = set(blocks.rglob("shuffle_*.data")) - shuffles, time.time() + 20
    while len(ours) > 4 and time.time() < deadline:  # they go in the background; the counts outside may have theirs
        time.sleep(0.2)
        ours = set(blocks.rglob("shuffle_*.data")) - shuffles
    assert len(ours) <= 4
