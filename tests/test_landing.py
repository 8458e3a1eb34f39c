"""Landing with quarantine, and dated atomic publishing."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.sources import landing as L
from cartlift.sources import publish as P

SCHEMA = T.StructType([T.StructField("client_id", T.StringType()), T.StructField("at", T.StringType()),
                       T.StructField("amount", T.DoubleType()), T.StructField("n", T.IntegerType())])


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("client_id,at,amount,n\n" + "\n".join(lines) + "\n")


def test_lines_are_set_aside_by_reason_and_files_taken_once(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "out")
    put(src, "a.csv", "c1,2024-01-01 10:00:00,1.5,1", "c2,2024-01-01", "c3,2024-01-01,1,2,3,4", ",2024-01-01,1,1",
        "c5,gestern,2,2", "c6,2024-01-01,two,1", "c7,,,", "c8,2024-01-01,1.0,1.5", "c9,2024-02-30,NaN,4", '"c,10",2024-01-01,3,5')
    assert L.land(spark, str(src), root, SCHEMA, ("at",))
    got = {r.client_id: (r.at and str(r.at)[:16], r.amount, r.n) for r in L.landed(spark, root, SCHEMA).collect()}
    assert got == {"c1": ("2024-01-01 10:00", 1.5, 1), "c5": (None, 2.0, 2), "c7": (None, None, None), "c9": (None, None, 4),
                   "c,10": ("2024-01-01 00:00", 3.0, 5)}
    want = {"columns": 2, "no_client": 1, "number:amount": 1, "number:n": 1, "time": 2, "landed": 5}
    assert {r.reason: r.n for r in L.landing_report(spark, root).collect()} == want
    lines = {r.line: r.reason for r in L.quarantined(spark, root).collect()}
    assert lines["c2,2024-01-01"] == "columns" and lines["c6,2024-01-01,two,1"] == "number:amount" and len(lines) == 5
    # nothing new; then one more file, and only that
    assert L.land(spark, str(src), root, SCHEMA, ("at",)) is None
    put(src, "b.csv", "c11,2024-01-03,7,7")
    assert L.land(spark, str(src), root, SCHEMA, ("at",))
    assert L.landed(spark, root, SCHEMA).count() == 6
    assert {r.reason: r.n for r in L.landing_report(spark, root).collect()} == {**want, "landed": 6}


def test_a_landing_that_dies_is_invisible_and_repeated(spark, tmp_path, monkeypatch):
    src, root = tmp_path / "in", str(tmp_path / "out")
    put(src, "a.csv", "c1,2024-01-01,1,1")
    L.land(spark, str(src), root, SCHEMA, ("at",))
    put(src, "b.csv", "c2,2024-01-01,1,1", "broken")

    class Died(Exception):
        pass

    real = type(spark).createDataFrame

    def die(*a, **k):
        raise Died
    monkeypatch.setattr(type(spark), "createDataFrame", die)
    with pytest.raises(Died):
        L.land(spark, str(src), root, SCHEMA, ("at",))
    monkeypatch.setattr(type(spark), "createDataFrame", real)
    assert [r.client_id for r in L.landed(spark, root, SCHEMA).collect()] == ["c1"]
    assert L.quarantined(spark, root).count() == 0
    assert L.land(spark, str(src), root, SCHEMA, ("at",))
    assert sorted(r.client_id for r in L.landed(spark, root, SCHEMA).collect()) == ["c1", "c2"]
    assert {r.reason: r.n for r in L.landing_report(spark, root).collect()} == {"landed": 2, "columns": 1}


def test_a_run_that_dies_between_two_tables_leaves_the_former_run(spark, tmp_path):
    root = str(tmp_path / "results")
    with pytest.raises(Exception):
        P.read_published(spark, root, "a")
    one = {"a": spark.range(3), "b": lambda: spark.range(30)}
    P.publish_run(spark, one, root, "2024-01-01")

    def dies():
        raise RuntimeError("between two tables")
    with pytest.raises(RuntimeError):
        P.publish_run(spark, {"a": spark.range(4), "b": dies}, root, "2024-01-02")
    assert P.read_published(spark, root, "a").count() == 3 and P.read_published(spark, root, "b").count() == 30
    P.publish_run(spark, {"a": spark.range(5), "b": spark.range(50)}, root, "2024-01-02")
    assert (P.read_published(spark, root, "a").count(), P.read_published(spark, root, "b").count()) == (5, 50)
    # an older date published later doesn't become the newest; a date published again is replaced
    P.publish_run(spark, {"a": spark.range(7), "b": spark.range(70)}, root, "2024-01-01")
    assert P.read_published(spark, root, "a").count() == 5 and P.read_published(spark, root, "a", "2024-01-01").count() == 7
    with pytest.raises(LookupError):
        P.read_published(spark, root, "c")
    with pytest.raises(LookupError):
        P.read_published(spark, root, "a", "2023-01-01")
    assert P.runs(spark, root).select(F.countDistinct("run")).first()[0] == 3
