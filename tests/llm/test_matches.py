"""Longest verbatim matches and shared windows against plain Python."""

import random

import pyarrow as pa

from chronoframe.llm import decontaminate as DC


def brute(text, items, window):
    """(words hit, items, longest match) of a text."""
    words, hit, ids, longest = text.split(), set(), set(), 0
    for name, t in items:
        w = t.split()
        k = min(window, len(w))
        for i in range(len(words)):
            for j in range(len(w)):
                n = 0
                while i + n < len(words) and j + n < len(w) and words[i + n] == w[j + n]:
                    n += 1
                if k and n >= k:
                    hit |= set(range(i, i + n))
                    ids.add(name)
                    longest = max(longest, n)
    return len(hit), ids, longest


def test_shards_against_brute_force():
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    for _ in range(60):
        preamble = make(6)
        items = [(f"i{k}", (preamble + " " if k % 2 else "") + make(rng.randrange(12))) for k in range(6)] + [("same", preamble), ("again", preamble), ("none", "")]
        texts = [make(rng.randrange(40)) for _ in range(5)] + ["", preamble + " x " + preamble, make(80)]
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
        for shard_words in (1, 30, 10**6):
            for cut in (len(items), 3):
                blocks = [DC.TestBlock([(n, t.encode()) for n, t in items[i : i + cut]], 5) for i in range(0, len(items), cut)]
                at = 0
                for held, shard in DC._shards(iter([batch.slice(0, 3), batch.slice(3)]), 5, shard_words):
                    f = DC.Found(shard, iter(blocks))
                    for r in range(sum(b.num_rows for b in held)):
                        assert (int(f.n_hit[r]), f.items[r], int(f.longest[r])) == brute(texts[at], items, 5)
                        at += 1
                    assert DC.Found(shard, iter(blocks), names=False).n_hit.tolist() == f.n_hit.tolist()
                assert at == len(texts)


def test_an_item_under_many_ids_costs_its_names_only():
    words = " ".join(f"w{i}" for i in range(3000))
    block = DC.TestBlock([(str(i), words.encode()) for i in range(300)], 13)
    shard = DC.Shard(13)
    for _ in range(5):
        shard.add(words.encode())
    f = DC.Found(shard, iter([block]))
    assert f.longest.tolist() == [3000] * 5 and all(len(x) == 300 for x in f.items) and f.n_hit.tolist() == [3000] * 5
