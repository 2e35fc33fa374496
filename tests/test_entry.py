import __spark_entry__ as entry
from plumbline import catalogue
from plumbline.plans import ordering


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_positions_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    df = spark.range(2500).selectExpr("(id * 7919) % 1000 AS a", "id AS b")
    got = [(r.a, r.b) for r in ordering.positions(df, ["a", "b"]).orderBy("pos").collect()]
    assert got == sorted(got)
    assert [r.pos for r in ordering.positions(df, ["a", "b"]).orderBy("pos").collect()] == list(range(2500))
