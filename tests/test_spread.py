"""Tables dealt by a key over as many partitions as their rows ask for."""

from pyspark.sql import functions as F

from factmill.plans import queries, views
from factmill.sources import shared

SF = "/root/testdata/sf0.001"


def test_records_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    before = sorted(map(tuple, views.records(spark, SF).collect()))
    monkeypatch.setattr(shared, "ROWS_A_TASK", 300, raising=False)
    records = views.records(spark, SF)
    sizes = [r["n"] for r in records.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 3 * 300
    assert sorted(map(tuple, records.collect())) == before


def test_pairs_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    before = sorted(map(str, queries.truth_rules_pairwise(spark, SF).collect()))
    monkeypatch.setattr(shared, "ROWS_A_TASK", 300, raising=False)
    pairs = queries.truth_rules_pairwise(spark, SF)
    assert pairs.select(F.spark_partition_id()).distinct().count() > 8
    assert sorted(map(str, pairs.collect())) == before
