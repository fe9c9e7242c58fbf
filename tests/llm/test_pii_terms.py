"""Terms that disclose entities: where they are counted, and where they are marked."""

from chronoframe.llm import pii
from chronoframe.llm.common import materialize


def filler(i, n=60):
    return " ".join(f"w{(i * 7 + k) % 40}" for k in range(n))


def test_terms_far_from_the_entity_and_without_it(spark):
    data = [(i, f"Zorblax {filler(i)} zed@corp.org") for i in range(6)] + [(10, f"{filler(1)} zorblax, ZORBLAX")]
    data += [(20 + i, filler(i)) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert all("term:0:7" in got[i].spans and got[i].n_term == 1 for i in range(6))
    s = data[6][1].index("zorblax")
    assert got[10].spans == f"term:{s}:{s + 7},term:{s + 9}:{s + 16}" and got[10].n_term == 2 and got[10].n_email == 0
    assert all(got[i].spans == "" for i in got if i >= 20)
    clean = {r.doc_id: r.text.lower() for r in pii.sanitise(df).collect()}
    assert not any("zorblax" in t for t in clean.values())


def test_terms_of_entities_that_occur_once(spark):
    data = [(i, f"{filler(i)} hotline +1 555 010 {1000 + i}") for i in range(4)] + [(10 + i, f"{filler(i)} sysop at 10.20.{i}.7") for i in range(4)]
    data += [(20 + i, f"{filler(i)} payroll p{i}@corp.example") for i in range(4)] + [(30, "the payroll")] + [(40 + i, filler(i)) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    texts = dict(data)
    for ids, word in ((range(4), "hotline"), (range(10, 14), "sysop"), ([*range(20, 24), 30], "payroll")):
        for i in ids:
            s = texts[i].index(word)
            assert f"term:{s}:{s + len(word)}" in got[i].spans and got[i].n_term == 1
    assert all(got[i].spans == "" for i in got if i >= 40)


def test_terms_are_counted_before_they_are_joined(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, "abc ghi abc"), (3, None)], "doc_id long, text string")
    wanted = materialize(spark.createDataFrame([("abc",), ("abc",), ("def",), ("none",)], "term string"), "wanted").distinct()
    counts = pii._term_counts(docs, wanted)
    assert {(r.term, r.n_t) for r in counts.collect()} == {("abc", 2), ("def", 1)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join, generate = (next(i for i, line in enumerate(plan) if w in line) for w in ("Join", "Generate"))
    assert any("count(" in line for line in plan[join:generate])
