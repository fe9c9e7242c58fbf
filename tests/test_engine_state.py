"""What a folder keeps for the next engine, what a blocking read sees, and rules that new series get by themselves."""

import threading

import pytest

from chronoframe.engine import CommandError, Engine


def test_an_engine_begins_with_what_the_folder_holds(spark, tmp_path):
    folder = str(tmp_path / "state")
    e = Engine(spark, folder=folder, clock=lambda: 0)
    for c in ("TS.CREATE a LABELS x 1 DUPLICATE_POLICY last", "TS.CREATE b", "TS.CREATE c", "TS.CREATERULE a b AGGREGATION countif(> 1.5) 1000", "TS.CREATERULE a c AGGREGATION sum 1000", "TS.DELETERULE a c", "TS.MADD a 100 1 a 200 2 a 1500 3"):
        e.execute(c)
    again = Engine(spark, folder=folder, clock=lambda: 0)
    assert again.rules == e.rules and len(again.rules) == 1
    assert [tuple(r) for r in again.execute("TS.RANGE b - +").collect()] == [(0, 1.0)]
    again.execute("TS.ADD a 2100 5")
    assert [tuple(r) for r in again.execute("TS.RANGE b - +").collect()] == [(0, 1.0), (1000, 1.0)]
    assert Engine(spark, folder=folder).series.count() == 3
    assert Engine(spark, folder=str(tmp_path / "other")).series.count() == 0


def test_a_blocking_read_sees_what_another_engine_writes(spark, tmp_path):
    folder = str(tmp_path / "blocked")
    writer = Engine(spark, folder=folder, clock=lambda: 0)
    writer.execute("TS.CREATE a")
    writer.execute("TS.ADD a 100 1")
    reader = Engine(spark, folder=folder, clock=lambda: 0)
    later = threading.Timer(1.0, lambda: writer.execute("TS.ADD a 200 2"))
    later.start()
    got = [tuple(r) for r in reader.execute("TS.READ a $ BLOCK 60000 1").collect()]
    later.join()
    assert got == [(200, 2.0)]


def test_new_series_get_rules(spark, tmp_path):
    e = Engine(spark, folder=str(tmp_path / "auto"), clock=lambda: 0, auto=[("cpu:.*", "avg:1s:0;max:1s:5000")])
    e.execute("TS.CREATE cpu:1 LABELS host h")
    e.execute("TS.ADD cpu:1 100 1")
    e.execute("TS.ADD mem:1 100 1")
    e.execute("TS.MADD cpu:1 300 3 cpu:1 1200 9")
    assert {(r.source, r.dest) for r in e.rules} == {("cpu:1", "cpu:1_AVG_1000"), ("cpu:1", "cpu:1_MAX_1000")}
    assert [tuple(r) for r in e.execute("TS.RANGE cpu:1_AVG_1000 - +").collect()] == [(0, 2.0)]
    info = e.series.where("key = 'cpu:1_MAX_1000'").first()
    assert info.retention_ms == 5000 and info.labels == {"host": "h"}
    with pytest.raises(CommandError):
        e.execute("TS.CREATERULE cpu:1 cpu:1_AVG_1000 AGGREGATION sum 1000")
