"""Text commands, end to end on one engine."""

import math

import pytest

from chronoframe.engine import COMMANDS, CommandError, Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, folder=str(tmp_path_factory.mktemp("engine")), clock=lambda: 100_000)
    e.execute("TS.CREATE t1 LABELS sensor temp room kitchen DUPLICATE_POLICY last RETENTION 1h")
    e.execute("TS.CREATE t2 METRIC 'humid{room=\"kitchen\"}'")
    e.execute("TS.ADDBULK t1 '{\"values\": [10.1, 20.2, 30.3, 40.4, 50.5], \"timestamps\": [1000, 2000, 3000, 4000, 5000]}'")
    e.execute("TS.MADD t2 1000 1 t2 2000 2 t2 2500 7 missing 1 1 t2 2000 9")
    return e


def rows(df):
    return [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect()]


def test_ranges(engine):
    run = lambda c: rows(engine.execute(c))
    assert run("TS.RANGE t1 2000 4000 COUNT 2") == [(2000, 20.2), (3000, 30.3)]
    assert run("TS.REVRANGE t1 - + COUNT 1") == [(5000, 50.5)]
    assert run("TS.RANGE t1 - + FILTER_BY_TS 1000 3000 9000 FILTER_BY_VALUE 20 99") == [(3000, 30.3)]
    assert run("TS.RANGE t1 - + AGGREGATION sum,count(> 15) 2s") == [(0, 10.1, 0.0), (2000, 50.5, 2.0), (4000, 90.9, 2.0)]
    assert run("TS.RANGE t1 1500 + ALIGN start AGGREGATION max 2000 BUCKETTIMESTAMP end EMPTY") == [(3500, 30.3), (5500, 50.5)]
    assert run("TS.RANGE t2 - +") == [(1000, 1.0), (2000, 2.0), (2500, 7.0)]
    assert run("TS.GET t2") == [(2500, 7.0)]
    assert run("TS.READ t1 3500 MAX_COUNT 5 CONDITION < 50") == [(4000, 40.4)]
    assert run("TS.NRANGE 2 t1 t2 - 2000") == [(1000, 10.1, 1.0), (2000, 20.2, 2.0)]
    assert run("TS.NREVRANGE 2 t2 t1 - + COUNT 2 AGGREGATION last 1s") == [(5000, "nan", 50.5), (4000, "nan", 40.4)]


def test_many(engine):
    run = lambda c: rows(engine.execute(c))
    assert run("TS.MGET SELECTED_LABELS room FILTER room=kitchen") == [("t1", 5000, 50.5, {"room": "kitchen"}), ("t2", 2500, 7.0, {"room": "kitchen"})]
    assert run("TS.MRANGE - + AGGREGATION count 1m FILTER room=kitchen GROUPBY room REDUCE sum") == [("room=kitchen", 0, 8.0)]
    assert run("TS.MREVRANGE 4000 + FILTER room=kitchen") == [("t1", 5000, 50.5), ("t1", 4000, 40.4), ("t2", None, None)]
    assert run("TS.MRANGE 4000 + FILTER room=kitchen EXCLUDEEMPTY COUNT 1") == [("t1", 4000, 40.4)]
    assert run("TS.JOIN t1 t2 - + REDUCE sub") == [(1000, pytest.approx(9.1)), (2000, pytest.approx(18.2))]
    assert run("TS.JOIN t1 t2 - + ASOF PREVIOUS 600 COUNT 9") == [(1000, 10.1, 1000, 1.0), (2000, 20.2, 2000, 2.0), (3000, 30.3, 2500, 7.0)]
    assert run("TS.JOIN t1 t2 - + ANTI AGGREGATION count 1m") == [(0, 3.0)]
    assert run("TS.OUTLIERS t1 - + METHOD mad THRESHOLD 1") == [(1000, 10.1, pytest.approx(2 / 3, abs=0.01), -1), (5000, 50.5, pytest.approx(2 / 3, abs=0.01), 1)]
    assert len(run("TS.OUTLIERS t1 - + OUTPUT full METHOD esd CLASSIC ALPHA 0.1")) == 5


def test_labels(engine):
    run = lambda c: rows(engine.execute(c))
    assert run("TS.QUERYINDEX FILTER_BY_RANGE NOT 4000 5000 FILTER room=kitchen") == [("t2",)]
    assert run("TS.CARD FILTER sensor=temp") == [(1,)] and run("TS.CARD") == [(2,)]
    assert run("TS.QUERYLABELS LABELS") == [("__name__",), ("room",), ("sensor",)]
    assert run("TS.QUERYLABELS VALUES room FILTER humid") == [("kitchen",)]
    assert run("TS.LABELNAMES SEARCH OO IGNORE_CASE INCLUDE_METADATA") == [("room", 1.0, 2)]
    assert run("TS.LABELVALUES sensor SEARCH tmp FUZZY_THRESHOLD 0.5 SORTBY score") == [("temp",)]
    assert run("TS.METRICNAMES LIMIT 5") == [("humid",)]
    assert ("total", "series", 2) in run("TS.LABELSTATS LABEL room LIMIT 3")


def test_writes_and_rules(engine):
    run = lambda c: rows(engine.execute(c))
    run("TS.CREATE s DUPLICATE_POLICY sum"), run("TS.CREATE d")
    run("TS.CREATERULE s d AGGREGATION sum 1s")
    for t, v in ((0, 1), (500, 2), (1500, 4), (400, 8), (500, 16), (2600, 32)):
        run(f"TS.ADD s {t} {v}")
    assert run("TS.RANGE d - +") == [(0, 27.0), (1000, 4.0)]
    assert run("TS.RANGE d - + LATEST") == [(0, 27.0), (1000, 4.0), (2000, 32.0)]
    assert run("TS.DEL s 400 500") == [(2,)] and run("TS.RANGE d - +") == [(0, 1.0), (1000, 4.0)]
    info = engine.execute("TS.INFO s").first()
    assert info.total_samples == 3 and info.rules[0].dest == "d" and engine.execute("TS.INFO d").first().source_key == "s"
    run("TS.DELETERULE s d")
    run("TS.INCRBY c 5 TIMESTAMP 10 LABELS kind counter"), run("TS.DECRBY c 2")
    assert run("TS.RANGE c - +") == [(10, 5.0), (100_000, 3.0)]
    run("TS.ALTER c LABELS kind gauge")
    assert run("TS.QUERYINDEX FILTER kind=gauge") == [("c",)]
    assert run("TS.MDEL 0 50 FILTER kind=gauge") == [(1,)] and run("TS.MDEL FILTER kind=gauge") == [(1,)]
    assert run("TS.QUERYINDEX FILTER kind=gauge") == []
    for bad in ("TS.ADD t2 1000 5", "TS.CREATE t1", "TS.RANGE nothing - +", "TS.RANGE t1 - + WHAT", "TS.NOPE", "TS.JOIN t1 t1 - +", "TS.INCRBY t1 1 TIMESTAMP 5", "TS.MRANGE - + FILTER a!=b", "TS.ADDBULK t1 '{}'", "TS.DELETERULE s d", ""):
        with pytest.raises(CommandError):
            engine.execute(bad)
    assert all(hasattr(engine, f"_{c}") for c in COMMANDS) and len(COMMANDS) == 30
